"""Queries over the music tables, each with the SQL that must give the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels
from ..functions import measures as M
from ..functions import text as T
from ..operators import albums, catalog, cleaning, components, incremental, joins, kernels, packed, sequences, votes
from ..session import cut
from ..session import table as t
from ..sources import files
from . import templates, terms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- ranking and votes


@query("""
SELECT p_partkey, l_orderkey, l_linenumber, unknown, score FROM (
 SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY unknown, score, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) rn FROM (
  SELECT p.p_partkey, l.*, CAST((nullif(l_tax, 0) IS NULL) AS BIGINT) unknown,
   CAST(10000 * floor(l_extendedprice / 2000) - 10 * floor(l_discount / 0.02) + coalesce(floor(nullif(l_tax, 0) / 0.02), 0) AS BIGINT) score
  FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey)) WHERE rn = 1
""")
def best_source(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "part").select("p_partkey").join(t(s, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    tax = F.nullif("l_tax", F.lit(0.0))
    unknown, score = votes.weighted_score([(10000, M.step_bucket(F.col("l_extendedprice"), 2000)), (-10, M.step_bucket(F.col("l_discount"), 0.02)), (1, M.step_bucket(tax, 0.02))])
    m = m.withColumns({"unknown": unknown, "score": score})
    rest = ["l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return votes.argmin(m, ["p_partkey"], [F.col(c) for c in ("unknown", "score", "l_orderkey", "l_linenumber", *rest)]).select("p_partkey", "l_orderkey", "l_linenumber", "unknown", "score")


@query("""
SELECT song_no, claim_no, unknown, score FROM (SELECT *, row_number() OVER (PARTITION BY song_no ORDER BY unknown, score, claim_no) rn FROM (
 SELECT song_no, claim_no, CAST(length_ms IS NULL AS BIGINT) unknown, CAST(10000 * (3 - trust) + coalesce(floor(length_ms / 60000.0), 0) AS BIGINT) score FROM claims)) WHERE rn = 1
""")
def best_claim(s, d):
    c = t(s, d, "claims")
    unknown, score = votes.weighted_score([(10000, F.lit(3) - F.col("trust")), (1, M.step_bucket(F.col("length_ms"), 60000.0))])
    return votes.argmin(c.withColumns({"unknown": unknown, "score": score}), ["song_no"], [F.col("unknown"), F.col("score"), F.col("claim_no")]).select("song_no", "claim_no", "unknown", "score")


@query("""
SELECT info_no, CASE WHEN trust = 3 OR m IS NULL THEN duration_s ELSE least(duration_s, m) END AS bounded_s FROM (
 SELECT info_no, trust, duration_s, min(CASE WHEN trust = 3 THEN duration_s END) OVER (PARTITION BY source_key) m FROM video_infos) WHERE duration_s IS NOT NULL
""")
def bounded_measure(s, d):
    v = t(s, d, "video_infos").withColumn("bounded_s", votes.bounded(F.col("duration_s"), F.col("trust") == 3, ["source_key"]))
    return v.filter("duration_s IS NOT NULL").select("info_no", "bounded_s")


_VOTED = "SELECT song_no, field, v FROM (SELECT song_no, field, unnest(vals) v FROM agreed) WHERE v IS NOT NULL"


@query(f"""
SELECT song_no, field, v, votes FROM (SELECT *, row_number() OVER (PARTITION BY song_no, field ORDER BY votes DESC, w DESC, c, v) rn FROM (
 SELECT song_no, field, v, count(*) votes, len(list_filter(regexp_split_to_array(v, '\\s+'), lambda x: regexp_matches(x, '^\\p{{Lu}}'))) w, len(regexp_extract_all(v, '\\p{{Lu}}')) c
 FROM ({_VOTED}) GROUP BY song_no, field, v)) WHERE rn = 1
""")
def majority_vote(s, d):
    return votes.majority(t(s, d, "agreed").select("song_no", "field", F.explode("vals").alias("v")), ["song_no", "field"], "v")


@query("""
WITH n AS (SELECT user_id, event_type, count(*) votes FROM events GROUP BY ALL), m AS (SELECT user_id, max(votes) votes FROM n GROUP BY user_id)
SELECT user_id, min(event_type) event_type, votes FROM n JOIN m USING (user_id, votes) WHERE votes >= 2 GROUP BY user_id, votes HAVING count(*) = 1
""")
def unique_plurality(s, d):
    return votes.plurality(t(s, d, "events"), ["user_id"], "event_type")


@query("SELECT record_no, CAST(len(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: regexp_matches(x, '^\\p{Lu}'))) AS BIGINT) words, CAST(len(regexp_extract_all(title, '\\p{Lu}')) AS BIGINT) capitals FROM records WHERE title IS NOT NULL")
def casing_rank(s, d):
    w, c = votes.casing(F.col("title"))
    return t(s, d, "records").filter("title IS NOT NULL").select("record_no", w.alias("words"), c.alias("capitals"))


@query("""
WITH v AS (SELECT info_no, release_year, CASE WHEN trim(album) <> '' THEN lower(album) END n FROM video_infos), y AS (SELECT n, min(release_year) a, max(release_year) b FROM v GROUP BY n)
SELECT info_no, CASE WHEN v.n IS NOT NULL THEN concat_ws('|', v.n, CAST(coalesce(release_year, CASE WHEN a = b THEN a END) AS VARCHAR)) END album_key FROM v LEFT JOIN y ON v.n = y.n
""")
def album_key(s, d):
    v = t(s, d, "video_infos").select("info_no", "release_year", "album")
    return votes.album_key(v, F.when(F.trim("album") != "", F.lower("album")), "release_year").select("info_no", "album_key")


@query("""
WITH b AS (SELECT song_no, max(trust) m FROM claims GROUP BY song_no)
SELECT song_no, count(DISTINCT source_key) groups FROM claims JOIN b USING (song_no) WHERE trust = m GROUP BY song_no HAVING count(DISTINCT source_key) > 1
""")
def contested(s, d):
    return votes.contested(t(s, d, "claims"), ["song_no"], "source_key", [-F.col("trust")])


@query("""
WITH r AS (SELECT record_id, name, votes, row_number() OVER (PARTITION BY record_id ORDER BY votes DESC, name) rk FROM (SELECT record_id, name, max(votes) votes FROM genres WHERE votes > 0 GROUP BY ALL)),
m AS (SELECT record_id, votes AS top FROM r WHERE rk = 1)
SELECT record_id, name, votes, CAST(rk AS INT) AS "rank" FROM r JOIN m USING (record_id) WHERE rk <= 3 AND 2 * votes >= top
""")
def genre_top(s, d):
    g = t(s, d, "genres").filter("votes > 0").groupBy("record_id", "name").agg(F.max("votes").alias("votes"))
    return votes.top_votes(g, ["record_id"], "name", "votes")


@query("SELECT channel, genre, count(DISTINCT album) albums, count(DISTINCT title) titles FROM video_infos GROUP BY ALL HAVING count(DISTINCT album) >= 3 AND count(DISTINCT title) >= 10")
def watermark_values(s, d):
    return votes.watermarks(t(s, d, "video_infos"), "channel", "genre", "album", "title")


@query("""
WITH n AS (SELECT lower(name) fold, name, count(DISTINCT record_id) songs FROM genres GROUP BY ALL)
SELECT fold, name, songs FROM n WHERE fold IN (SELECT fold FROM n GROUP BY fold HAVING count(*) > 1)
""")
def spelled_ways(s, d):
    return votes.spelled_ways(t(s, d, "genres"), F.lower("name"), "name", "record_id")


# --- evidence


def _evidence(s, d):
    a = t(s, d, "claims").select("song_no", "claim_no", F.get(F.col("offers")["title"], F.lit(0)).alias("ta"), F.col("offers")["artist"].alias("ca"), F.col("length_ms").alias("la"), F.get(F.col("offers")["album"], F.lit(0)).alias("ra"), F.get(F.col("offers")["isrc"], F.lit(0)).alias("ia"))
    b = votes.argmin(t(s, d, "claims").filter("length_ms IS NOT NULL"), ["song_no"], [-F.col("trust"), F.col("claim_no")])
    b = b.select("song_no", F.col("claim_no").alias("other_no"), F.get(F.col("offers")["title"], F.lit(0)).alias("tb"), F.col("offers")["artist"].alias("cb"), F.col("length_ms").alias("lb"), F.get(F.col("offers")["album"], F.lit(0)).alias("rb"), F.get(F.col("offers")["isrc"], F.lit(0)).alias("ib"))
    m = a.join(b, "song_no").filter("claim_no != other_no")
    gap = F.abs(F.col("la") - F.col("lb"))
    same = lambda x, y: F.when((x != "") & (y != ""), F.lower(x) == F.lower(y))
    e = {
        "identifier": F.when((F.col("ia") != "") & (F.col("ia") == F.col("ib")), True), "title": same(F.col("ta"), F.col("tb")),
        "credits": F.when((F.size("ca") > 0) & (F.size("cb") > 0), F.arrays_overlap("ca", "cb")), "length": F.when(gap <= 3000, True).when(gap >= 30000, False), "release": same(F.col("ra"), F.col("rb")),
    }
    return m.withColumns({f"e_{k}": v for k, v in e.items()})


_EVIDENCE = """
WITH c AS (SELECT song_no, claim_no, trust, length_ms, offers['title'][1] t, offers['artist'] c, offers['album'][1] r, offers['isrc'][1] i FROM claims),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_no ORDER BY trust DESC, claim_no) rn FROM c WHERE length_ms IS NOT NULL) WHERE rn = 1),
e AS (SELECT a.song_no, a.claim_no, CASE WHEN a.i <> '' AND a.i = b.i THEN true END e_identifier, CASE WHEN a.t <> '' AND b.t <> '' THEN lower(a.t) = lower(b.t) END e_title,
 CASE WHEN len(a.c) > 0 AND len(b.c) > 0 THEN list_has_any(a.c, b.c) END e_credits, CASE WHEN abs(a.length_ms - b.length_ms) <= 3000 THEN true WHEN abs(a.length_ms - b.length_ms) >= 30000 THEN false END e_length,
 CASE WHEN a.r <> '' AND b.r <> '' THEN lower(a.r) = lower(b.r) END e_release FROM c a JOIN b ON a.song_no = b.song_no AND a.claim_no <> b.claim_no)
"""


@query(_EVIDENCE + """, p AS (SELECT *, CAST(CASE WHEN e_identifier THEN 12 ELSE 0 END + CASE WHEN e_title THEN 5 WHEN NOT e_title THEN -8 ELSE 0 END + CASE WHEN e_credits THEN 3 WHEN NOT e_credits THEN -5 ELSE 0 END
 + CASE WHEN e_length THEN 2 WHEN NOT e_length THEN -3 ELSE 0 END + CASE WHEN e_release THEN 5 ELSE 0 END AS BIGINT) points FROM e)
SELECT claim_no, points, CASE WHEN (coalesce(NOT e_title AND NOT e_credits, false) AND NOT coalesce(e_identifier, false)) OR points <= -10 THEN 'other' WHEN points <= -3 OR coalesce(NOT e_credits AND NOT e_release, false) THEN 'unsure' ELSE 'same' END verdict FROM p
""")
def evidence_verdict(s, d):
    m = _evidence(s, d)
    e = {k: F.col(f"e_{k}") for k in ("identifier", "title", "credits", "length", "release")}
    m = m.withColumn("points", votes.points(e))
    return m.select("claim_no", "points", votes.verdict(e, F.col("points")).alias("verdict"))


def _tally(s, d):
    m = _evidence(s, d).select(F.coalesce("e_identifier", F.lit(False)).alias("same"), "e_title", "e_credits", "e_length", "e_release")
    return votes.tally(m, "same", ["e_title", "e_credits", "e_length", "e_release"])


_TALLY = _EVIDENCE + """, l AS (SELECT coalesce(e_identifier, false) same, unnest(['e_title', 'e_credits', 'e_length', 'e_release']) kind, unnest([e_title, e_credits, e_length, e_release]) v FROM e),
 y AS (SELECT kind, same, count(*) FILTER (v) agreed, count(*) FILTER (NOT v) disagreed, count(*) FILTER (v IS NULL) silent FROM l GROUP BY ALL)
"""


@query(_TALLY + "SELECT kind, same, agreed, disagreed, silent FROM y")
def calibration_tally(s, d):
    return _tally(s, d)


_ODDS = "2 * log2(((sum(CASE WHEN same THEN {c} ELSE 0 END) + 1) / (sum(CASE WHEN same THEN n ELSE 0 END) + 2)) / ((sum(CASE WHEN same THEN 0 ELSE {c} END) + 1) / (sum(CASE WHEN same THEN 0 ELSE n END) + 2)))"


@query(_TALLY + f""", z AS (SELECT *, agreed + disagreed + silent n FROM y)
SELECT kind, CAST(round({_ODDS.format(c='agreed')} - {_ODDS.format(c='silent')}) AS BIGINT) agrees, CAST(round({_ODDS.format(c='disagreed')} - {_ODDS.format(c='silent')}) AS BIGINT) disagrees
FROM z GROUP BY kind HAVING sum(CASE WHEN same THEN n ELSE 0 END) >= 20 AND sum(CASE WHEN same THEN 0 ELSE n END) >= 20
""")
def suggested_points(s, d):
    return votes.suggested_points(_tally(s, d), "same")


@query()
def logistic_fit(s, d):
    side = lambda c: F.when(F.col(c), 1.0).when(~F.col(c), -1.0).otherwise(0.0)
    m = _evidence(s, d).select(F.coalesce("e_identifier", F.lit(False)).cast("double").alias("same"), *[side(f"e_{k}").alias(k) for k in ("title", "credits", "length", "release")])
    return kernels.logistic_fit(m, "same", ["title", "credits", "length", "release"])


@query("SELECT claim_no, count(*) others FROM (SELECT a.claim_no FROM claims a JOIN claims b ON a.song_no = b.song_no AND a.source_key <> b.source_key) GROUP BY claim_no")
def leave_one_out(s, d):
    """Each claim with how many claims of its song come from other sources: by counts, not by pairs."""
    c = t(s, d, "claims").filter("song_no IS NOT NULL AND source_key IS NOT NULL")
    per = c.groupBy("song_no", "source_key").agg(F.count("*").alias("own"))
    song = per.groupBy("song_no").agg(F.sum("own").alias("all"))
    return c.join(per, ["song_no", "source_key"]).join(song, "song_no").select("claim_no", (F.col("all") - F.col("own")).alias("others")).filter("others > 0")


# --- the query language and listing


def _views(s, d):
    c = t(s, d, "claims")
    per = c.select("song_no", F.explode("offers").alias("f", "vs")).select("song_no", "f", F.explode("vs").alias("v")).filter("v != ''").groupBy("song_no", "f").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    tags = per.groupBy("song_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "vs")))).alias("tags"))
    songs = t(s, d, "songs").select("song_no", F.col("sources").alias("keys"), F.concat(F.lit("songs/"), F.col("song_no").cast("string"), F.lit(".opus")).alias("path"), F.col("lyrics_offset_ms").isNotNull().alias("lyrics"), (F.col("lyrics_offset_ms") > 0).alias("timed"), F.col("album").isNotNull().alias("cover"), F.lit(False).alias("soft_cover"), F.map_keys("tags").alias("given"), F.transform("sources", lambda k: F.regexp_extract(k, "^([^:]*):", 1)).alias("from"))
    return songs.join(tags, "song_no", "left")


_VIEW = """
WITH o AS (SELECT song_no, unnest(map_keys(offers)) f, unnest(map_values(offers)) vs FROM claims), x AS (SELECT DISTINCT song_no, f, v FROM (SELECT song_no, f, unnest(vs) v FROM o) WHERE v <> ''),
 g AS (SELECT song_no, f, string_agg(v, '; ' ORDER BY v) j FROM x GROUP BY ALL)
"""
_FOLD = "strip_accents(lower(replace(replace(replace(replace({}, '’', ''''), '“', '\"'), '”', '\"'), '–', '-')))"
SCHEMES = {"youtube", "soundcloud", "bandcamp", "vimeo", "archive"}


@query(_VIEW + f"""
SELECT s.song_no, concat(coalesce(sources[1], ''), ' | ', coalesce((SELECT j FROM g WHERE g.song_no = s.song_no AND f = 'artist'), ''), ' | ', coalesce((SELECT j FROM g WHERE g.song_no = s.song_no AND f = 'title'), '')) line
FROM songs s WHERE EXISTS (SELECT 1 FROM x WHERE x.song_no = s.song_no AND f = 'artist' AND contains({_FOLD.format('v')}, 'er'))
 AND NOT EXISTS (SELECT 1 FROM x WHERE x.song_no = s.song_no AND f = 'genre' AND {_FOLD.format('v')} = 'jazz') AND EXISTS (SELECT 1 FROM x WHERE x.song_no = s.song_no AND f = 'date' AND regexp_matches(v, '^20'))
""")
def query_terms(s, d):
    q = terms.parse_text('artist:er "^genre:=Jazz" date::^20', SCHEMES)
    return _views(s, d).filter(terms.predicate(q)).select("song_no", terms.output("{key} | {artist} | {title}").alias("line"))


@query(_VIEW + f"""
SELECT s.song_no FROM songs s WHERE EXISTS (SELECT 1 FROM x WHERE x.song_no = s.song_no AND f IN ('title', 'artist', 'album', 'albumartist') AND contains({_FOLD.format('v')}, 'cafe'))
 AND lyrics_offset_ms IS NULL AND list_contains(list_transform(sources, lambda k: regexp_extract(k, '^([^:]*):', 1)), 'youtube')
""")
def query_words(s, d):
    return _views(s, d).filter(terms.predicate(terms.parse_text("Café lyrics:none from:youtube", SCHEMES))).select("song_no")


@query(_VIEW + """
SELECT s.song_no FROM songs s WHERE (list_contains(sources, (SELECT min(k) FROM (SELECT unnest(sources) k FROM songs))) OR list_contains(sources, (SELECT max(k) FROM (SELECT unnest(sources) k FROM songs))))
""")
def query_keys(s, d):
    """Several keys are alternatives; the first and the last key of all are asked for."""
    ends = t(s, d, "songs").select(F.explode("sources").alias("k")).agg(F.min("k"), F.max("k")).first()
    return _views(s, d).filter(terms.predicate(terms.parse([x for x in ends if x], SCHEMES))).select("song_no")


@query(_VIEW + "SELECT DISTINCT song_no FROM x WHERE f = 'date' AND substr(v, 1, 4) = '2010'")
def query_year(s, d):
    return _views(s, d).filter(terms.predicate(terms.parse(["year:=2010"], SCHEMES))).select("song_no")


@query("""SELECT song_no, CASE WHEN track > 10 THEN true ELSE false END changed, CASE WHEN track > 10 THEN 'late' ELSE array_to_string(tags['grouping'], '; ') END "grouping" FROM songs""")
def set_assignment(s, d):
    sets, _ = terms.assignments(["grouping=late", "track:>10"])
    v = t(s, d, "songs").withColumn("was", F.col("tags"))
    v = v.withColumn("tags", terms.assigned(sets, F.coalesce(F.col("track") > 10, F.lit(False))))
    return v.select("song_no", F.coalesce(F.col("track") > 10, F.lit(False)).alias("changed"), F.array_join(F.col("tags")["grouping"], "; ").alias("grouping"))


# --- joins and differences


@query("SELECT song_no, CAST(n AS INT) n, info_no FROM (SELECT song_no, unnest(sources) k, unnest(range(len(sources))) n FROM songs) JOIN video_infos ON k = source_key")
def song_sources(s, d):
    x = joins.exploded(t(s, d, "songs").select("song_no", "sources"), "sources", "n", "k")
    return x.join(t(s, d, "video_infos").select("source_key", "info_no"), F.col("k") == F.col("source_key")).select("song_no", "n", "info_no")


@query("SELECT info_no FROM video_infos v WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(sources) k FROM songs) WHERE k = v.source_key)")
def foreign_rows(s, d):
    listed = t(s, d, "songs").select(F.explode("sources").alias("source_key"))
    return t(s, d, "video_infos").join(listed, "source_key", "left_anti").select("info_no")


@query("SELECT DISTINCT source_key FROM video_infos WHERE source_key NOT IN (SELECT unnest(sources) FROM songs) AND source_key NOT IN (SELECT source_key FROM claims WHERE source_key IS NOT NULL)")
def purgeable(s, d):
    used = t(s, d, "songs").select(F.explode("sources").alias("source_key")).unionByName(t(s, d, "claims").select("source_key"))
    return t(s, d, "video_infos").select("source_key").filter("source_key IS NOT NULL").distinct().join(used, "source_key", "left_anti")


_ENDS = "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY seen_at, info_no) rn FROM video_infos) WHERE rn = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY seen_at DESC, info_no DESC) rn FROM video_infos) WHERE rn = 1)"


def _ends(s, d):
    v = t(s, d, "video_infos").filter("source_key IS NOT NULL")
    first = votes.argmin(v, ["source_key"], [F.col("seen_at"), F.col("info_no")])
    return first, sequences.latest(v, ["source_key"], ["seen_at", "info_no"])


@query(f"WITH {_ENDS}, l AS (SELECT a.source_key, unnest(['title', 'album', 'genre']) field, unnest([a.title, a.album, a.genre]) was, unnest([b.title, b.album, b.genre]) \"now\" FROM a JOIN b USING (source_key)) SELECT source_key, field, was, \"now\" FROM l WHERE was IS DISTINCT FROM \"now\"")
def source_diff(s, d):
    first, last = _ends(s, d)
    return joins.changed_fields(first, last, "source_key", ["title", "album", "genre"])


@query(f"WITH {_ENDS}, l AS (SELECT unnest(['title', 'album', 'genre']) field, unnest([a.title, a.album, a.genre]) was, unnest([b.title, b.album, b.genre]) w FROM a JOIN b USING (source_key)) SELECT field, count(*) n FROM l WHERE was IS DISTINCT FROM w GROUP BY field")
def changes_by_field(s, d):
    first, last = _ends(s, d)
    return joins.changed_fields(first, last, "source_key", ["title", "album", "genre"]).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT record_no, a.alias_no FROM records LEFT JOIN (SELECT lower(name) n, min(alias_no) alias_no FROM aliases GROUP BY lower(name) HAVING count(*) = 1) a ON a.n = lower(credit)")
def unique_name_join(s, d):
    return joins.unique_name_join(t(s, d, "records").select("record_no", "credit"), F.lower("credit"), t(s, d, "aliases"), F.lower("name"), "alias_no").select("record_no", "alias_no")


@query("SELECT a.record_no key_a, b.record_no key_b FROM records a JOIN records b ON a.title = b.title AND a.record_no < b.record_no AND a.length_ms > 0 AND b.length_ms > 0 AND least(a.length_ms, b.length_ms) >= 0.8 * greatest(a.length_ms, b.length_ms)")
def length_band_pairs(s, d):
    return joins.length_band_pairs(t(s, d, "records").select("record_no", "title", "length_ms"), "record_no", "length_ms", 0.8, ["title"])


_W = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SH = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


@query(f"""
WITH t AS (SELECT item_id, {_W} w FROM eval_items), u AS (SELECT doc_id, {_W} w FROM documents), a AS (SELECT item_id, {_SH} s FROM t), b AS (SELECT doc_id, {_SH} s FROM u),
x AS (SELECT item_id, len(s) na, unnest(s) s FROM a), y AS (SELECT doc_id, len(s) nb, unnest(s) s FROM b)
SELECT item_id, doc_id, round(count(*) / least(any_value(na), any_value(nb)), 6) AS share FROM x JOIN y USING (s) GROUP BY item_id, doc_id HAVING count(*) / least(any_value(na), any_value(nb)) >= 0.8
""")
def shingle_containment(s, d):
    m = joins.shared_shingles(t(s, d, "eval_items"), "item_id", t(s, d, "documents"), "doc_id", T.words(F.col("text")), T.words(F.col("text")), 5, 0.8)
    return m.withColumn("share", F.round("share", 6))


@query(f"""
WITH RECURSIVE u AS (SELECT doc_id, {_W} w FROM documents), b AS (SELECT doc_id, {_SH} s FROM u), y AS (SELECT doc_id, len(s) n, unnest(s) s FROM b),
q AS (SELECT a.doc_id x, c.doc_id z FROM y a JOIN y c ON a.s = c.s AND a.doc_id <> c.doc_id GROUP BY a.doc_id, c.doc_id HAVING count(*) / (any_value(a.n) + any_value(c.n) - count(*)) >= 0.8),
r AS (SELECT doc_id, doc_id l FROM b WHERE len(s) > 0 UNION SELECT q.z, r.l FROM r JOIN q ON q.x = r.doc_id)
SELECT doc_id, min(l) class_id FROM r GROUP BY doc_id
""")
def near_duplicate_docs(s, d):
    return joins.near_duplicate_classes(t(s, d, "documents"), "doc_id", T.words(F.col("text"))).select("doc_id", "class_id")


@query()
def nearest_item(s, d):
    m = joins.shared_shingles(t(s, d, "documents"), "doc_id", t(s, d, "eval_items"), "item_id", T.words(F.col("text")), T.words(F.col("text")), 5, 0.8).withColumn("distance", F.round(1 - F.col("share"), 6))
    return joins.nearest_with_lead(m, "doc_id", "item_id", "distance")


@query("""
WITH g AS (SELECT source_key k, any_value(webpage_url) u, count(*) n, min(title) title FROM video_infos WHERE source_key LIKE 'youtube%' GROUP BY 1), h AS (SELECT source_key k, min(title) title FROM video_infos WHERE source_key LIKE 'soundcloud%' GROUP BY 1),
a AS (SELECT title, min(k) gone FROM g GROUP BY title HAVING count(*) = 1), b AS (SELECT title, min(k) "new" FROM h GROUP BY title HAVING count(*) = 1)
SELECT gone, "new", 'title' AS "by" FROM a JOIN b USING (title) WHERE title IS NOT NULL
""")
def moved_pairs(s, d):
    v = t(s, d, "video_infos").groupBy("source_key").agg(F.min("title").alias("title"))
    return joins.pair_by_unique_evidence(v.filter("source_key LIKE 'youtube%'").withColumnRenamed("source_key", "gone"), v.filter("source_key LIKE 'soundcloud%'").withColumnRenamed("source_key", "new"), "gone", "new", ["title"])


@query()
def embedding_search(s, d):
    """Queries are the rows whose id is divisible by 50, against all rows; the five nearest by the Hamming distance of sign bits."""
    e = t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("bits").alias("q"))
    met = q.hint("shuffle_replicate_nl").join(e, F.lit(True)).filter("query_id != vec_id")
    dist = met.withColumn("distance", F.aggregate(F.zip_with("q", "bits", lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda a, b: a + b))
    return joins.best_match(dist, ["query_id", "vec_id"], [F.col("distance")]).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("r <= 5").select("query_id", "vec_id", F.col("distance").cast("bigint").alias("distance"))


# --- windows and time


@query("""
WITH r AS (SELECT *, sum(CASE WHEN event_type = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) run FROM (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events))
SELECT user_id, CAST(run AS BIGINT) run, min(event_type) event_type, count(*) run_length FROM r GROUP BY user_id, run HAVING count(*) >= 3
""")
def static_runs(s, d):
    e = t(s, d, "events")
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = sequences.runs(e.withColumn("_same", F.col("event_type") == prev), ["user_id"], ["ts", "event_id"], F.col("_same"), 3)
    return r.filter("masked").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("run_length"))


@query("SELECT source_key, info_no, title FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY seen_at DESC, info_no DESC) rn FROM video_infos) WHERE rn = 1")
def newest_read(s, d):
    return sequences.latest(t(s, d, "video_infos").select("source_key", "seen_at", "info_no", "title"), ["source_key"], ["seen_at", "info_no"]).select("source_key", "info_no", "title")


@query("""
SELECT info_no FROM (SELECT info_no, sum(duration_s) OVER w s, row_number() OVER w i, count(*) OVER (PARTITION BY uploader) n FROM video_infos WHERE duration_s IS NOT NULL AND uploader IS NOT NULL
 WINDOW w AS (PARTITION BY uploader ORDER BY info_no ROWS UNBOUNDED PRECEDING)) WHERE round(s, 3) <= 600 AND i < n
""")
def budget_prefix(s, d):
    v = t(s, d, "video_infos").filter("duration_s IS NOT NULL AND uploader IS NOT NULL").withColumn("ms", F.round(F.col("duration_s") * 1000).cast("bigint"))
    return sequences.budget_prefix(v, ["uploader"], ["info_no"], "ms", F.lit(600_000)).select("info_no")


@query("""
SELECT record_no, CAST(row_number() OVER (PARTITION BY id ORDER BY d IS NULL, substr(d, 1, 4) NULLS FIRST, length(d) DESC NULLS LAST, d NULLS FIRST, record_no) AS INT) place FROM (SELECT record_no, id, CASE WHEN trim(on_release.release_date) <> '' THEN on_release.release_date END d FROM records)
""")
def date_order(s, d):
    r = t(s, d, "records").select("record_no", "id", F.when(F.trim("on_release.release_date") != "", F.col("on_release.release_date")).alias("d"))
    k = M.date_key(F.col("d"))
    return r.select("record_no", F.row_number().over(Window.partitionBy("id").orderBy(k["none"], k["year"], k["full"], k["date"], "record_no")).alias("place"))


_LINES = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) line FROM documents WHERE source = 'lyrics'),
x AS (SELECT doc_id, CAST(line AS INT) line, CASE WHEN regexp_matches(raw, '^\[\d{1,3}:[0-5]\d[.:]\d\d\]') THEN CAST(regexp_extract(raw, '^\[(\d{1,3}):', 1) AS BIGINT) * 60000 + CAST(regexp_extract(raw, '^\[\d{1,3}:(\d\d)', 1) AS BIGINT) * 1000 + CAST(regexp_extract(raw, '^\[\d{1,3}:\d\d[.:](\d\d)', 1) AS BIGINT) * 10 END ms,
 trim(regexp_replace(raw, '^(\s*\[\d{1,3}:\d{2}([.:]\d{1,3})?\])+', '')) words FROM l)
"""


def _lines(s, d):
    return sequences.timed_lines(t(s, d, "documents").filter("source = 'lyrics'"), "doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, line, ms, words FROM x")
def timed_lines(s, d):
    return _lines(s, d)


@query(f"WITH {_LINES} SELECT doc_id, count(*) lines, min(ms) first_ms, max(ms) last_ms FROM x WHERE ms IS NOT NULL AND words <> '' GROUP BY doc_id")
def lyrics_timing(s, d):
    return sequences.timing(_lines(s, d), "doc_id")


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, line, CAST(round(ms * 1.0005 - 20000) AS BIGINT) ms, words FROM x WHERE ms IS NOT NULL)
SELECT doc_id, line, ms, words FROM m WHERE ms >= 0 UNION ALL SELECT doc_id, line, CAST(0 AS BIGINT), words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ms DESC, line DESC, words DESC) rn FROM m WHERE ms < 0) WHERE rn = 1""")
def shifted_lines(s, d):
    return sequences.shifted(_lines(s, d), "doc_id", -20000, 500)


@query(f"WITH {_LINES} SELECT doc_id, line, ms, words FROM x WHERE ms IS NULL OR ms <= 32000")
def lines_until(s, d):
    return sequences.until(_lines(s, d), F.lit(30000))


@query(f"""WITH {_LINES}, a AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, ms) i FROM x WHERE ms IS NOT NULL), b AS (SELECT doc_id, ms, words, row_number() OVER (PARTITION BY doc_id ORDER BY ms, line) i FROM x WHERE ms IS NOT NULL)
SELECT doc_id, line, ms, words FROM a JOIN b USING (doc_id, i) UNION ALL SELECT doc_id, line, ms, words FROM x WHERE ms IS NULL""")
def ordered_lines(s, d):
    return sequences.ordered(_lines(s, d), "doc_id")


_FRAMES = f"""WITH {_LINES}, w AS (SELECT * FROM x WHERE ms IS NOT NULL),
g AS (SELECT doc_id, ms, list(DISTINCT words) ws FROM w WHERE words <> '' GROUP BY ALL),
h AS (SELECT doc_id, ms, CASE WHEN ms - lag(ms) OVER o < {sequences.FRAME_MS} THEN lag(ws) OVER o END was FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY ms)),
m AS (SELECT w.*, words <> '' AND (coalesce(list_contains(was, words), false) OR row_number() OVER (PARTITION BY w.doc_id, w.ms, words ORDER BY line) > 1) gone FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.ms = w.ms),
n AS (SELECT *, coalesce(first_value(CASE WHEN words <> '' THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line, ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) soon FROM m),
k AS (SELECT *, lag(words) OVER o before, lag(CASE WHEN words <> '' THEN ms END) OVER o a, lead(CASE WHEN words <> '' THEN ms END) OVER o b FROM n WHERE NOT gone WINDOW o AS (PARTITION BY doc_id ORDER BY line, ms))
SELECT doc_id, line, ms, words FROM k WHERE NOT (words = '' AND (soon OR coalesce(before = '', false) OR coalesce(a = ms, false) OR coalesce(b = ms, false)))"""


@query(_FRAMES)
def merged_frames(s, d):
    return sequences.merged_frames(_lines(s, d), "doc_id")


@query()
def typed_out_lines(s, d):
    return sequences.typed_out(_lines(s, d), "doc_id")


@query(f"""WITH {_LINES}, a AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) = 1 one, regexp_extract(words, '\\p{{L}}') opens FROM x),
b AS (SELECT *, coalesce(lag(ms) OVER o = ms AND one AND lag(one) OVER o AND regexp_matches(opens, '^\\p{{Ll}}') AND trim(lag(words) OVER o) <> '' AND NOT regexp_matches(trim(lag(words) OVER o), '[.!?…。！？"”)]$'), false) onward FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY line, ms)),
c AS (SELECT *, sum(CASE WHEN onward THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line, ms) run FROM b),
e AS (SELECT *, regexp_matches(first_value(opens) OVER (PARTITION BY doc_id, run ORDER BY line, ms), '^\\p{{Lu}}') head, row_number() OVER (PARTITION BY doc_id, run ORDER BY line, ms) nth FROM c)
SELECT doc_id, min(line) line, min(ms) ms, CASE WHEN count(*) > 1 THEN string_agg(trim(words), ' ' ORDER BY line, ms) ELSE min(words) END words FROM e GROUP BY doc_id, run, CASE WHEN head THEN 0 ELSE nth END""")
def wrapped_lines(s, d):
    return sequences.wrapped(_lines(s, d), "doc_id")


@query()
def print_pairs(s, d):
    """Documents of one song laid over each other as prints of 32-bit words: each with every later one of its song.

    Documents of equal prints are laid over others once, as one. Prints and pairs are cut, so that no join of them is a
    broadcast and the words are run through once.
    """
    docs = t(s, d, "documents").filter("song_no IS NOT NULL").select("song_no", "doc_id", F.transform(T.words(F.col("text")), lambda x: F.crc32(x.cast("binary"))).alias("words"))
    docs = cut(docs.withColumn("print", F.sha2(F.array_join("words", " "), 256)))
    first = docs.groupBy("print").agg(F.min("doc_id").alias("rep"), F.any_value("words").alias("words"))
    of = cut(docs.select("song_no", "doc_id", "print").join(first.select("print", "rep"), "print"))
    one, two = of.select("song_no", F.col("doc_id").alias("a"), F.col("rep").alias("p")), of.select("song_no", F.col("doc_id").alias("b"), F.col("rep").alias("q"))
    pairs = cut(one.join(two, "song_no").filter("a < b").select("a", "b", "p", "q"))
    paired = pairs.select(F.explode(F.array("p", "q")).alias("rep")).dropDuplicates()
    p = cut(sequences.prints_long(first.filter("size(words) > 0").join(paired, "rep", "left_semi"), "rep", "words"))
    met = sequences.print_matches(p, "rep", pairs.select("p", "q").dropDuplicates(), "p", "q")
    return pairs.join(met, ["p", "q"]).drop("p", "q")


@query("SELECT event_type, CAST(floor((value + 70) / 0.1) AS BIGINT) AS bin, count(*) n FROM events WHERE value >= -70 GROUP BY ALL")
def histogram_pool(s, d):
    return sequences.histogram(t(s, d, "events"), ["event_type"], "value", -70.0, 0.1)


@query("""
WITH h AS (SELECT event_type, floor((v + 70) / 0.1) b, count(*) n FROM (SELECT event_type, value - 100 * floor(value / 100) - 70 v FROM events) GROUP BY ALL), e AS (SELECT *, pow(10, (-70 + (b + 0.5) * 0.1 + 0.691) / 10) e FROM h), m AS (SELECT event_type, sum(n * e) / sum(n) m FROM e GROUP BY 1)
SELECT event_type, round(-0.691 + 10 * log10(sum(n * e) / sum(n)), 6) AS "level" FROM e JOIN m USING (event_type) WHERE e >= m / 10 GROUP BY 1
""")
def gated_level(s, d):
    e = t(s, d, "events").select("event_type", (F.col("value") - 100 * F.floor(F.col("value") / 100) - 70).alias("v"))
    return sequences.gated_level(sequences.histogram(e, ["event_type"], "v", -70.0, 0.1), ["event_type"]).withColumn("level", F.round("level", 6))


@query("""
WITH h AS (SELECT event_type, CAST(floor((value + 70) / 0.1) AS BIGINT) b, count(*) n FROM events WHERE value >= -70 GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b DESC ROWS UNBOUNDED PRECEDING) s, sum(n) OVER (PARTITION BY event_type) a FROM h)
SELECT event_type, max(b) AS bin FROM r WHERE s >= ceil(a * 0.001) GROUP BY event_type
""")
def peak_bin(s, d):
    return sequences.peak_bin(sequences.histogram(t(s, d, "events"), ["event_type"], "value", -70.0, 0.1), ["event_type"])


@query("SELECT user_id, CAST(count(*) AS BIGINT) failures, CAST(least(3600 * pow(2, least(count(*) - 1, 16)), 604800) AS BIGINT) wait_s FROM events WHERE event_type = 'error' GROUP BY user_id")
def backoff_wait(s, d):
    return t(s, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures")).select("user_id", "failures", M.backoff_s(F.col("failures")).alias("wait_s"))


@query("""
WITH f AS (SELECT user_id, count(*) n, CAST(floor(max(epoch(ts))) AS BIGINT) l FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, CAST(CASE user_id % 3 WHEN 0 THEN l + least(3600 * pow(2, least(n - 1, 16)), 604800) WHEN 1 THEN l + 2592000 ELSE l + least(2592000 * pow(2, least(n, 16)), 7776000) END AS BIGINT) due_at FROM f
""")
def lookup_due(s, d):
    f = t(s, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("l"))
    outcome = F.when(F.col("user_id") % 3 == 0, "failed").when(F.col("user_id") % 3 == 1, "missing").otherwise("short")
    return f.select("user_id", incremental.lookup_due(outcome, F.col("l"), F.col("n"), F.col("n"), 30 * 86400).alias("due_at"))


@query("SELECT extractor_key, info_no FROM (SELECT *, row_number() OVER (PARTITION BY extractor_key ORDER BY trust DESC, info_no) rn FROM video_infos) WHERE rn <= 5")
def per_run_cap(s, d):
    return incremental.per_run(t(s, d, "video_infos").withColumn("_k", -F.col("trust")), "extractor_key", ["_k", "info_no"], 5).select("extractor_key", "info_no")


# --- incremental


@query("SELECT info_no FROM video_infos v WHERE NOT EXISTS (SELECT 1 FROM video_infos m WHERE m.loaded_at < TIMESTAMP '2024-01-01' AND m.source_key = v.source_key AND m.format_id IS NOT DISTINCT FROM v.format_id AND v.format_id IS NOT NULL)")
def incremental_measure(s, d):
    v = t(s, d, "video_infos")
    done = v.filter(F.col("loaded_at") < F.expr("timestamp_ntz'2024-01-01'"))
    return incremental.unmeasured(v, done, ["source_key"], ["format_id"]).select("info_no")


def _snapshots(s, d):
    v = t(s, d, "video_infos")
    cut = F.expr("timestamp_ntz'2024-01-01'")
    old = sequences.latest(v.filter(F.col("seen_at") < cut), ["source_key"], ["seen_at", "info_no"])
    new = sequences.latest(v.filter(F.col("seen_at") >= cut), ["source_key"], ["seen_at", "info_no"])
    return old, new


_SNAP = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY seen_at DESC, info_no DESC) rn FROM video_infos WHERE seen_at < TIMESTAMP '2024-01-01') WHERE rn = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY seen_at DESC, info_no DESC) rn FROM video_infos WHERE seen_at >= TIMESTAMP '2024-01-01') WHERE rn = 1)"


@query(f"WITH {_SNAP} SELECT source_key, CASE WHEN o.info_no IS NULL THEN 'insert' WHEN n.info_no IS NULL THEN 'delete' WHEN o.title IS DISTINCT FROM n.title OR o.album IS DISTINCT FROM n.album THEN 'update' ELSE 'keep' END AS \"action\" FROM o FULL JOIN n USING (source_key)")
def run_history_diff(s, d):
    old, new = _snapshots(s, d)
    return incremental.diff_merge(old.select("source_key", "title", "album"), new.select("source_key", "title", "album"), "source_key")


@query(f"WITH {_SNAP} SELECT source_key, coalesce(n.info_no, o.info_no) info_no FROM o FULL JOIN n USING (source_key)")
def cache_absorb(s, d):
    old, new = _snapshots(s, d)
    cols = ["source_key", "seen_at", "info_no"]
    return incremental.merged(old.select(*cols), new.select(*cols), ["source_key"], "seen_at").select("source_key", "info_no")


_STATUS = f"WITH {_SNAP}, v AS (SELECT source_key, CASE WHEN o.info_no IS NULL THEN 'new' WHEN n.info_no IS NULL THEN 'left' WHEN o.title IS DISTINCT FROM n.title THEN 'changed' WHEN o.channel IS DISTINCT FROM n.channel THEN 'moved' ELSE 'kept' END verdict FROM o FULL JOIN n USING (source_key))"


@query(_STATUS + " SELECT source_key, verdict FROM v")
def status_verdicts(s, d):
    old, new = _snapshots(s, d)
    return incremental.song_verdicts(new, old, "source_key", "title", "channel")


@query(_STATUS + " SELECT verdict, count(*) n FROM v GROUP BY verdict")
def status_tally(s, d):
    return status_verdicts(s, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT info_no, CASE WHEN r = 1 THEN p ELSE concat(p, ' [', info_no, ']') END path_out FROM (SELECT info_no, p, row_number() OVER (PARTITION BY upper(p) ORDER BY info_no) r FROM (SELECT info_no, concat(coalesce(artist, ''), '/', coalesce(title, '')) p FROM video_infos))")
def separate_paths(s, d):
    v = t(s, d, "video_infos").select("info_no", F.concat(F.coalesce("artist", F.lit("")), F.lit("/"), F.coalesce("title", F.lit(""))).alias("path"))
    return incremental.separate_paths(v, "path", "info_no", "info_no").select("info_no", "path_out")


@query("SELECT CAST(m AS VARCHAR) AS month, n, sum(n) OVER (ORDER BY m DESC ROWS UNBOUNDED PRECEDING) <= 8000 AS kept FROM (SELECT strftime(loaded_at, '%Y-%m') m, count(*) n FROM video_infos GROUP BY 1)")
def history_budget(s, d):
    runs = t(s, d, "video_infos").groupBy(F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return incremental.history_budget(runs, "month", "n", 8000)


# --- catalog


@query("""
WITH r AS (SELECT id, on_release.id release_id, CASE WHEN trim(on_release.release_date) <> '' THEN on_release.release_date END d, on_release.types ty,
 CAST(NOT coalesce(on_release.credit = credit, false) AS INT) o, CAST(NOT coalesce(on_release.status = 'Official', false) AS INT) u FROM records WHERE id IS NOT NULL AND on_release.id IS NOT NULL),
q AS (SELECT *, coalesce(CAST(list_has_any(ty, ['Compilation', 'Live', 'Remix', 'Soundtrack', 'DJ-mix', 'Mixtape/Street', 'Demo', 'Spokenword', 'Interview', 'Audiobook']) AS INT), 0) sec, CASE WHEN list_contains(ty, 'Album') THEN 0 WHEN list_contains(ty, 'EP') THEN 1 WHEN list_contains(ty, 'Single') THEN 2 ELSE 3 END k FROM r)
SELECT id, release_id, d AS release_date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, sec, u, k, d IS NULL, substr(d, 1, 4) NULLS FIRST, length(d) DESC NULLS LAST, d NULLS FIRST, release_id) rn FROM q) WHERE rn = 1
""")
def release_rank(s, d):
    return catalog.best_release(t(s, d, "records"))


@query("SELECT record_no, trim(string_split(credit, ', ')[1]) artist FROM records WHERE credit IS NOT NULL")
def first_artists(s, d):
    r = t(s, d, "records").filter("credit IS NOT NULL")
    return r.select("record_no", catalog.first_artist(F.col("credit")).alias("artist"))


@query("WITH l AS (SELECT id, record_no, unnest(languages) x, unnest(range(len(languages))) i FROM records WHERE id IS NOT NULL), f AS (SELECT id, x, min((record_no, i)) p FROM l WHERE x IS NOT NULL GROUP BY ALL) SELECT id, string_agg(x, ',' ORDER BY p) languages FROM f GROUP BY id")
def work_languages(s, d):
    """Languages of all rows of a recording, each once, in the order first seen."""
    return catalog.work_languages(t(s, d, "records").filter("id IS NOT NULL"), "id", "record_no", "languages").select("id", F.array_join("languages", ",").alias("languages"))



@query()
def print_fits(s, d):
    """Uploads and recordings of one title: whether the recording may be the print's, and whether title and artist both speak against it."""
    v = t(s, d, "video_infos").filter("track IS NOT NULL").select("info_no", "track", "artist", "duration_s", T.letters_key(F.col("track")).alias("k"))
    r = t(s, d, "records").filter("title IS NOT NULL").select("record_no", "id", "title", "credit", (F.col("length_ms") / 1000).alias("seconds"), F.lit(1).alias("sources"), T.letters_key(F.col("title")).alias("k"))
    both = v.filter("k != ''").join(r, "k")
    fit = catalog.print_fits(F.col("id"), F.col("seconds"), F.col("sources"), F.col("duration_s"))
    return both.select("info_no", "record_no", fit.alias("fits"), catalog.another_song(F.col("title"), F.col("credit"), F.col("track"), F.col("artist")).alias("another"))


@query("SELECT a.info_no, b.record_no FROM video_infos a JOIN records b ON abs(a.duration_s - b.length_ms / 1000.0) <= 2 AND a.track = b.title AND a.artist = b.credit WHERE trim(a.track) <> '' AND trim(a.artist) <> ''")
def exact_lyrics_fits(s, d):
    """Records that may be an upload's by names written alike and a length within two seconds."""
    v, r = t(s, d, "video_infos").filter("trim(track) != '' AND trim(artist) != ''"), t(s, d, "records")
    both = v.join(r.select("record_no", "length_ms", r["title"].alias("r_title"), "credit"), (v["track"] == F.col("r_title")) & (v["artist"] == F.col("credit")))
    return both.filter(catalog.lyrics_fits(F.col("r_title"), F.col("credit"), F.col("length_ms") / 1000, F.col("track"), F.col("artist"), F.col("duration_s"))).select("info_no", "record_no")


@query()
def upload_candidates(s, d):
    """Of each recording's uploads in order of their number: the first that is its song by name and length, those to be compared, and whether the artist's own channel."""
    v = t(s, d, "video_infos").select("info_no", "title", F.coalesce("channel", "uploader").alias("channel"), "track", "duration_s")
    r = t(s, d, "records").filter("title IS NOT NULL").select("record_no", F.col("title").alias("name"), F.element_at("artists", 1).alias("by"), (F.col("length_ms") / 1000).alias("seconds"), T.letters_key(F.col("title")).alias("k"))
    both = v.withColumn("k", T.letters_key(F.col("track"))).filter("k != ''").join(r, "k")
    named = catalog.named(F.col("title"), F.col("channel"), F.col("name"), F.col("by"))
    return catalog.upload_choice(both.withColumn("_named", F.coalesce(named, F.lit(False))), "record_no", "info_no", "_named", "duration_s", "seconds", "channel", "by")


@query()
def other_editions(s, d):
    return catalog.other_editions(t(s, d, "records"))


@query()
def first_release(s, d):
    return catalog.first_release(t(s, d, "records"))


@query("""
SELECT c.claim_no, c.song_no, CASE WHEN abs(c.length_ms - b.length_ms) <= 3000 THEN 0 WHEN c.length_ms IS NOT NULL AND b.length_ms IS NOT NULL THEN 1 ELSE 2 END AS class
FROM claims c JOIN (SELECT song_no, length_ms FROM (SELECT *, row_number() OVER (PARTITION BY song_no ORDER BY trust DESC, claim_no) rn FROM claims) WHERE rn = 1) b ON c.song_no = b.song_no
""")
def length_fit(s, d):
    c = t(s, d, "claims")
    b = votes.argmin(c, ["song_no"], [-F.col("trust"), F.col("claim_no")]).select("song_no", F.col("length_ms").alias("lb"))
    return c.join(b, "song_no").select("claim_no", "song_no", M.length_class(F.col("length_ms"), F.col("lb")).alias("class"))


@query()
def named_uploads(s, d):
    """Uploads whose title carries the track's name, with the artist as channel or in the title."""
    v = t(s, d, "video_infos").filter("trim(track) != '' AND trim(artist) != ''")
    return v.select("info_no", catalog.named(F.col("title"), F.regexp_replace(F.coalesce("channel", F.lit("")), " - Topic$", ""), F.col("track"), F.col("artist")).alias("named"), catalog.is_release_upload(F.col("channel")).alias("release"))


@query()
def recording_rank(s, d):
    """The best recording of the catalog for each song's title by one ranked order."""
    want = votes.argmin(t(s, d, "claims").filter("length_ms IS NOT NULL AND size(offers['title']) > 0"), ["song_no"], [-F.col("trust"), F.col("claim_no")]).select("song_no", F.col("offers")["title"][0].alias("wanted"), F.col("length_ms").alias("lw"))
    r = t(s, d, "records").groupBy("id").agg(F.min("title").alias("title"), F.max("length_ms").alias("lr"), F.count("*").alias("releases"), F.min("original_date").alias("d"), F.max("disambiguation").alias("comment"))
    met = want.withColumn("k", T.letters_key(F.col("wanted"))).join(r.withColumn("k", T.letters_key(F.col("title"))), "k").withColumn("gap", F.abs(F.col("lw") - F.col("lr"))).filter("gap <= 3000")
    order = catalog.recording_rank(F.col("title"), F.col("wanted"), F.col("gap"), F.lit(0), F.col("releases"), F.col("d"), F.col("comment"), F.col("id"))
    return joins.best_match(met, ["song_no"], order).select("song_no", "id")


# --- summaries


@query("SELECT count(*) songs, count(album) with_album, count(DISTINCT album) albums, count(*) FILTER (len(sources) = 1) one_source, count(*) FILTER (len(sources) = 2) two_sources, count(*) FILTER (len(sources) >= 3) more_sources, count(track) tracks FROM songs")
def overview(s, d):
    n = F.size("sources")
    return t(s, d, "songs").agg(F.count("*").alias("songs"), F.count("album").alias("with_album"), F.count_distinct("album").alias("albums"), F.count_if(n == 1).alias("one_source"), F.count_if(n == 2).alias("two_sources"), F.count_if(n >= 3).alias("more_sources"), F.count("track").alias("tracks"))


@query("SELECT least(len(sources), 3) sources, count(*) songs FROM songs WHERE sources IS NOT NULL GROUP BY 1")
def source_buckets(s, d):
    return t(s, d, "songs").filter("sources IS NOT NULL").groupBy(F.least(F.size("sources"), F.lit(3)).cast("bigint").alias("sources")).agg(F.count("*").alias("songs"))


@query("SELECT count(*) n, count(*) FILTER (artist IS NULL OR trim(artist) = '') no_artist, count(*) FILTER (album IS NULL OR trim(album) = '') no_album, count(*) FILTER (duration_s IS NULL) no_length, count(*) FILTER (duration_s > 600) very_long, count(*) FILTER (genre IS NULL) no_genre, count(*) FILTER (title IS NULL) no_title, count(*) FILTER (trust = 1) least_trusted FROM video_infos")
def health_counts(s, d):
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    v = t(s, d, "video_infos")
    return v.agg(F.count("*").alias("n"), F.count_if(empty("artist")).alias("no_artist"), F.count_if(empty("album")).alias("no_album"), F.count_if(F.col("duration_s").isNull()).alias("no_length"), F.count_if(F.col("duration_s") > 600).alias("very_long"), F.count_if(F.col("genre").isNull()).alias("no_genre"), F.count_if(F.col("title").isNull()).alias("no_title"), F.count_if(F.col("trust") == 1).alias("least_trusted"))


@query("SELECT regexp_extract(k, '^([^:]*):', 1) site, count(*) n FROM (SELECT unnest(sources) k FROM songs) GROUP BY 1")
def sites_count(s, d):
    return t(s, d, "songs").select(F.explode("sources").alias("k")).groupBy(F.regexp_extract("k", "^([^:]*):", 1).alias("site")).agg(F.count("*").alias("n"))


@query("""
SELECT 'claim of no song' problem, count(*) n FROM claims c WHERE NOT EXISTS (SELECT 1 FROM songs s WHERE s.song_no = c.song_no) UNION ALL SELECT 'source never read', count(*) FROM (SELECT unnest(sources) k FROM songs) WHERE k NOT IN (SELECT source_key FROM video_infos)
 UNION ALL SELECT 'agreed on no song', count(*) FROM agreed a WHERE NOT EXISTS (SELECT 1 FROM songs s WHERE s.song_no = a.song_no) UNION ALL SELECT 'genre of no record', count(*) FROM genres g WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.id = g.record_id)
""")
def check_library(s, d):
    songs = t(s, d, "songs")
    read = t(s, d, "video_infos").select(F.col("source_key").alias("k"))
    parts = {
        "claim of no song": t(s, d, "claims").join(songs, "song_no", "left_anti"), "source never read": songs.select(F.explode("sources").alias("k")).join(read, "k", "left_anti"),
        "agreed on no song": t(s, d, "agreed").join(songs, "song_no", "left_anti"), "genre of no record": t(s, d, "genres").join(t(s, d, "records").select(F.col("id").alias("record_id")), "record_id", "left_anti"),
    }
    out = None
    for k, v in parts.items():
        one = v.agg(F.count("*").alias("n")).select(F.lit(k).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT album, count(*) songs, count(DISTINCT track) tracks, count(*) > count(DISTINCT track) AS twice FROM songs WHERE album IS NOT NULL AND track IS NOT NULL GROUP BY album HAVING count(*) > 1")
def album_twice(s, d):
    return t(s, d, "songs").filter("album IS NOT NULL AND track IS NOT NULL").groupBy("album").agg(F.count("*").alias("songs"), F.count_distinct("track").alias("tracks"), (F.count("*") > F.count_distinct("track")).alias("twice")).filter("songs > 1")


@query("WITH x AS (SELECT album, k, min(song_no * 100 + n) f FROM (SELECT album, song_no, unnest(sources) k, unnest(range(len(sources))) n FROM songs WHERE album IS NOT NULL) GROUP BY album, k) SELECT album, string_agg(k, '; ' ORDER BY f, k) sources FROM x GROUP BY album")
def merge_union(s, d):
    x = t(s, d, "songs").filter("album IS NOT NULL").select("album", "song_no", F.posexplode("sources").alias("n", "k")).groupBy("album", "k").agg(F.min(F.col("song_no") * 100 + F.col("n")).alias("f"))
    return x.groupBy("album").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "k"))), lambda v: v["k"]), "; ").alias("sources"))


@query("SELECT album, tag, count(DISTINCT v) ways FROM (SELECT album, unnest(map_keys(tags)) tag, array_to_string(unnest(map_values(tags)), '; ') v FROM songs WHERE album IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT v) > 1")
def tag_clashes(s, d):
    x = t(s, d, "songs").filter("album IS NOT NULL").select("album", F.explode("tags").alias("tag", "vs")).withColumn("v", F.array_join("vs", "; "))
    return x.groupBy("album", "tag").agg(F.count_distinct("v").alias("ways")).filter("ways > 1")


@query("WITH RECURSIVE e AS (SELECT a.song_no x, b.song_no y FROM (SELECT song_no, unnest(sources) k FROM songs) a JOIN (SELECT song_no, unnest(sources) k FROM songs) b ON a.k = b.k), r AS (SELECT DISTINCT x AS node, x AS l FROM e UNION SELECT e.y, r.l FROM r JOIN e ON e.x = r.node) SELECT node AS song_no, min(l) AS label FROM r GROUP BY node")
def shared_source_groups(s, d):
    """Songs linked by sources they share: each song and source is a node, so a source of many songs makes no pairs."""
    x = t(s, d, "songs").select("song_no", F.explode("sources").alias("k"))
    src = x.groupBy("k").agg(F.min("song_no").alias("first"))
    return components.components(x.join(src, "k").select(F.col("song_no").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("song_no"), "label")


@query("SELECT count(*) n, CAST(sum(n_chars) AS BIGINT) chars, CAST(sum(ceil(n_chars / 4096) * 4096) AS BIGINT) in_blocks FROM documents")
def size_total(s, d):
    return t(s, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum(M.blocks(F.col("n_chars"), 4096)).alias("in_blocks"))


# --- expressions


@query()
def fold_text(s, d):
    """Every artist, whatever its script."""
    return t(s, d, "video_infos").filter("artist IS NOT NULL").select("info_no", T.folded(F.col("artist")).alias("fold"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM documents")
def alnum_key(s, d):
    return t(s, d, "documents").select("doc_id", T.alnum(F.col("text")).alias("k"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) digest, CAST(len(string_split(text, ' ')) AS INT) pieces FROM documents")
def digest128(s, d):
    return t(s, d, "documents").select("doc_id", T.digest128(F.col("text")).alias("digest"), F.size(F.split("text", " ")).alias("pieces"))


@query("SELECT info_no, regexp_replace(regexp_extract(lower(webpage_url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '') AS host, regexp_replace(webpage_url, '[?#].*$', '') AS bare FROM video_infos WHERE contains(webpage_url, '.')")
def url_domain(s, d):
    return t(s, d, "video_infos").filter(F.contains("webpage_url", F.lit("."))).select("info_no", T.url_domain(F.col("webpage_url")).alias("host"), T.hide_query(F.col("webpage_url")).alias("bare"))


@query("SELECT info_no, regexp_replace(release_date, '^(\\d{4})(\\d{2})(\\d{2})$', '\\1-\\2-\\3') AS iso, substr(release_date, 1, 4) AS year FROM video_infos WHERE release_date IS NOT NULL")
def iso_dates(s, d):
    return t(s, d, "video_infos").filter("release_date IS NOT NULL").select("info_no", M.iso_date(F.col("release_date")).alias("iso"), F.substring("release_date", 1, 4).alias("year"))


@query("SELECT record_no, concat(length_ms // 60000, ':', lpad(CAST((length_ms // 1000) % 60 AS VARCHAR), 2, '0')) clock, CAST(floor(length_ms / 5000.0) AS BIGINT) steps, CAST(floor(ln(length_ms) / ln(1.1)) AS BIGINT) log_steps, CAST(least(floor(length_ms / 30000.0), 10) AS BIGINT) capped FROM records WHERE length_ms > 0")
def buckets(s, d):
    x = F.col("length_ms")
    return t(s, d, "records").filter("length_ms > 0").select("record_no", M.clock_text(x).alias("clock"), M.step_bucket(x, 5000.0).alias("steps"), M.log_bucket(x, 0.1).alias("log_steps"), M.capped_bucket(x, 30000.0).alias("capped"))


_SIZED = [("MB", 1000**2), ("KiB", 1024), ("K", 1024), ("kb", 1000), ("", 1), ("TiB", 1024**4), ("lions", None)]


@query("SELECT l_orderkey, l_linenumber, concat(CAST(l_quantity AS BIGINT), ' ', u) size, CAST(CAST(l_quantity AS BIGINT) * f AS BIGINT) bytes FROM lineitem JOIN (VALUES " + ", ".join(f"({i}, '{u}', {'NULL' if f is None else f})" for i, (u, f) in enumerate(_SIZED)) + ") v(i, u, f) ON l_orderkey % 7 = i")
def unit_parse(s, d):
    """Every line's quantity as a size in one of seven units, one of them none."""
    x = t(s, d, "lineitem").withColumn("u", F.element_at(F.array(*[F.lit(u) for u, _ in _SIZED]), (F.col("l_orderkey") % 7 + 1).cast("int")))
    x = x.select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.col("l_quantity").cast("bigint"), "u").alias("size"))
    return x.withColumn("bytes", M.size_bytes(F.col("size")))


@query("SELECT c_custkey, concat(round(CAST(c_acctbal AS DOUBLE) / 100, 1) + 0.0, ' dB') gain, CAST(round(CAST(c_acctbal AS DOUBLE) / 100, 1) * 100 AS BIGINT) cdb FROM customer")
def gain_parse(s, d):
    """Every customer's balance read as a gain."""
    x = t(s, d, "customer").select("c_custkey", F.concat((F.round(F.col("c_acctbal").cast("double") / 100, 1) + F.lit(0.0)).cast("string"), F.lit(" dB")).alias("gain"))
    return x.withColumn("cdb", M.gain_cdb(F.col("gain")))


@query()
def edit_distance(s, d):
    """Whole titles, empty ones too, by code points; SQL counts bytes."""
    r = t(s, d, "records").select("record_no", F.col("title").alias("x"), F.col("on_release.title").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return r.select("record_no", F.levenshtein("x", "y").cast("bigint").alias("edits"), T.edit_share(F.col("x"), F.col("y")).alias("share"))


@query()
def name_distances(s, d):
    r = t(s, d, "records").select("record_no", F.col("credit").alias("a"), F.col("on_release.credit").alias("b"))
    out = kernels.name_distances(r, "a", "b")
    return out.select("record_no", "distance", "conflicts", "agrees")


@query(r"SELECT record_no, credit, CAST(len(artists) AS INT) n, array_to_string(list_filter(list_transform(regexp_split_to_array(credit, '(?i)\s*(?:;|/|\s&\s|\s\+\s|,|\s(?:and|x|vs\.?|feat\.?|ft\.?|featuring|with)\s)\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM records WHERE credit IS NOT NULL")
def credit_split(s, d):
    """Every credit, those with feat., with, x, vs. and + too."""
    return t(s, d, "records").filter("credit IS NOT NULL").select("record_no", "credit", F.size("artists").alias("n"), F.array_join(T.credit_parts(F.col("credit")), "|").alias("parts"))


@query("SELECT song_no, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), '|') AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS within, NOT list_has_any(a, b) AS disjoint FROM (SELECT s.song_no, s.sources a, c.ks b FROM songs s JOIN (SELECT song_no, list(DISTINCT source_key) ks FROM claims GROUP BY song_no) c ON s.song_no = c.song_no)")
def source_sets(s, d):
    c = t(s, d, "claims").groupBy("song_no").agg(F.collect_set("source_key").alias("b"))
    m = t(s, d, "songs").select("song_no", F.col("sources").alias("a")).join(c, "song_no")
    either = F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))
    return m.select("song_no", F.array_join(F.array_sort(either), "|").alias("either"), (F.size(F.array_except("a", "b")) == 0).alias("within"), (~F.arrays_overlap("a", "b")).alias("disjoint"))


@query("SELECT DISTINCT scheme FROM (SELECT regexp_extract(k, '^([^:]*):', 1) scheme FROM (SELECT unnest(sources) k FROM songs) UNION ALL SELECT regexp_extract(source_key, '^([^:]*):', 1) FROM video_infos WHERE source_key IS NOT NULL)")
def known_schemes(s, d):
    a = t(s, d, "songs").select(F.explode("sources").alias("k")).unionByName(t(s, d, "video_infos").filter("source_key IS NOT NULL").select(F.col("source_key").alias("k")))
    return a.select(F.regexp_extract("k", "^([^:]*):", 1).alias("scheme")).distinct()


@query(r"SELECT info_no, regexp_replace(title, '(?i)\s*[(\[]\s*(?:(?:official )?(?:music |lyrics? )?(?:video|audio|visuali[sz]er|clip)|lyrics?|hd|hq|4k|with lyrics)\s*[)\]]\s*$', '') AS title FROM video_infos WHERE title IS NOT NULL AND length(trim(regexp_replace(title, '(?i)\s*[(\[]\s*(?:(?:official )?(?:music |lyrics? )?(?:video|audio|visuali[sz]er|clip)|lyrics?|hd|hq|4k|with lyrics)\s*[)\]]\s*$', ''))) > 0")
def clean_video_tags(s, d):
    v = t(s, d, "video_infos").filter("trim(title) != ''")
    rules = [r for r in cleaning.TITLE_RULES if r[0] == "packaging.video_tags"]
    return cleaning.cleaned(v.select("info_no", "title"), "title", rules).select("info_no", "title")


@query()
def clean_titles(s, d):
    v = t(s, d, "video_infos").select("info_no", "title", "artist", "album")
    out = cleaning.cleaned(v, "title", cleaning.TITLE_RULES, context={"artist": F.col("artist")})
    return out.select("info_no", "title", F.array_join("title_rules", ",").alias("rules"))


@query()
def clean_artists(s, d):
    """Artists, else channels, cleaned; whether an artist is an album of the album's artist is told by all rows."""
    every = t(s, d, "video_infos")
    v = every.select("info_no", F.coalesce("artist", "channel").alias("artist"), "album_artist", F.col("artist").isNotNull().alias("structured"))
    owned = every.select(T.letters_key(F.col("album_artist")).alias("_o"), T.letters_key(F.col("album")).alias("_k")).filter("_o != '' AND _k != ''").dropDuplicates().withColumn("own_album", F.lit(True))
    v = v.withColumns({"_o": T.letters_key(F.col("album_artist")), "_k": T.letters_key(F.col("artist"))}).join(owned, ["_o", "_k"], "left")
    out = cleaning.cleaned(v, "artist", cleaning.ARTIST_RULES, context={c: F.col(c) for c in ("own_album", "album_artist", "structured")})
    return out.select("info_no", "artist", F.array_join("artist_rules", ",").alias("rules"))


@query()
def clean_albums(s, d):
    return cleaning.cleaned(t(s, d, "video_infos").select("info_no", "album"), "album", cleaning.ALBUM_RULES).select("info_no", "album", T.disc_of_album(F.col("album")).alias("disc"), F.array_join("album_rules", ",").alias("rules"))


@query()
def clean_genres(s, d):
    return cleaning.cleaned(t(s, d, "genres").select("genre_no", "name"), "name", cleaning.GENRE_RULES).select("genre_no", "name", F.array_join("name_rules", ",").alias("rules"))


@query()
def clean_lines(s, d):
    lines = cleaning.cleaned_lines(_lines(s, d))
    return lines.select("doc_id", "line", "ms", "words", F.array_join("rules", ",").alias("rules"))


@query(r"""SELECT info_no, len(regexp_extract_all(title, '[(\[][^)\]]*[)\]]')) + len(regexp_extract_all(title, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][|–—-][\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS decorations FROM video_infos WHERE title IS NOT NULL""")
def decoration_count(s, d):
    """Every title, with spaces and dashes of any kind."""
    return t(s, d, "video_infos").filter("title IS NOT NULL").select("info_no", T.decoration_count(F.col("title")).cast("bigint").alias("decorations"))


@query()
def title_scripts(s, d):
    r = t(s, d, "records")
    return r.select("record_no", T.main_script(F.col("title")).alias("script"), T.latin_only(F.col("title")).alias("latin"), T.is_mbid(F.col("id")).alias("mbid"), F.array_join(T.version_kinds(F.concat_ws(" ", "title", "disambiguation")), ",").alias("versions"), T.field_value_kind(F.col("on_release.barcode")).alias("barcode_kind"), T.utf16_units(F.col("title")).alias("utf16"))


@query()
def offers_long(s, d):
    return files.offers(t(s, d, "video_infos"), "info_no").select("info_no", "field", F.array_join("vals", "; ").alias("vals"))


@query("""
WITH r AS (SELECT record_no, unnest(['title', 'artist', 'isrc', 'album', 'label']) field, unnest([CASE WHEN trim(title) <> '' THEN title END, CASE WHEN len(artists) > 0 THEN array_to_string(artists, '; ') END, CASE WHEN len(isrcs) > 0 THEN array_to_string(isrcs, '; ') END, CASE WHEN trim(on_release.title) <> '' THEN on_release.title END, CASE WHEN trim(on_release.label) <> '' THEN on_release.label END]) vals FROM records)
SELECT record_no, field, vals FROM r WHERE vals IS NOT NULL
""")
def record_offers(s, d):
    r = files.record_offers(t(s, d, "records")).filter(F.col("field").isin("title", "artist", "isrc", "album", "label"))
    return r.select("record_no", "field", F.array_join("vals", "; ").alias("vals"))


@query("SELECT song_no, field, coalesce(a.v, b.v) AS v FROM (SELECT song_no, lower(field) field, min(array_to_string(vals, '; ')) v FROM agreed WHERE from_what = 'record' AND len(vals) > 0 GROUP BY ALL) a FULL JOIN (SELECT song_no, lower(field) field, min(array_to_string(vals, '; ')) v FROM agreed WHERE from_what = 'vote' AND len(vals) > 0 GROUP BY ALL) b USING (song_no, field)")
def merged_tags(s, d):
    def side(name):
        a = t(s, d, "agreed").filter((F.col("from_what") == name) & (F.size("vals") > 0))
        return a.groupBy("song_no", F.lower("field").alias("field")).agg(F.min(F.array_join("vals", "; ")).alias("vals"))

    return files.merged_tags(side("record"), side("vote"), ["song_no", "field"]).withColumnRenamed("vals", "v")


@query()
def track_assignment(s, d):
    """Songs of an album to its track places at the least cost: 4 for another number, up to 10 for lengths apart."""
    songs = t(s, d, "songs").filter("album IS NOT NULL").select("album", "song_no", "track")
    length = t(s, d, "claims").groupBy("song_no").agg(F.max("length_ms").alias("ls"))
    places = t(s, d, "records").select(F.col("on_release.title").alias("album"), F.col("on_release.track").alias("place"), F.col("length_ms").alias("lr")).filter("album IS NOT NULL AND place IS NOT NULL").groupBy("album", "place").agg(F.max("lr").alias("lr"))
    met = songs.join(length, "song_no", "left").join(places, "album")
    cost = F.when(F.col("track").isNull(), 2).when(F.col("track") == F.col("place"), 0).otherwise(4) + F.least(F.coalesce(F.floor(F.abs(F.col("ls") - F.col("lr")) / 2000), F.lit(5)), F.lit(10))
    return kernels.assign(met.withColumn("cost", cost.cast("double")), "album", "song_no", "place", "cost")


@query()
def allocate_budget(s, d):
    """Each uploader's songs fitted into 20 MB: rungs of falling bitrate, the loss growing with what is saved."""
    v = t(s, d, "video_infos").filter("duration_s > 0 AND uploader IS NOT NULL").groupBy("uploader", "source_key").agg(F.max("duration_s").alias("sec"))
    r = v.select("uploader", "source_key", "sec", F.posexplode(F.array(*map(F.lit, (192, 128, 96, 64)))).alias("rung", "kbps")).withColumn("bytes", M.stream_bytes(F.col("kbps"), F.col("sec")).cast("double"))
    table = [(64.0, 3.0), (96.0, 1.5), (128.0, 0.6), (192.0, 0.0)]
    r = r.withColumn("loss", F.round(M.log_interpolated(F.col("kbps").cast("double"), table) * F.col("sec") / 60, 6))
    return kernels.allocate_groups(r, "uploader", "source_key", "rung", "bytes", "loss", 20e6)


@query()
def redacted_texts(s, d):
    v = t(s, d, "video_infos").select("info_no", F.concat(F.lit("get https://user:pw@"), F.regexp_replace("webpage_url", "^https://", ""), F.lit(" token="), F.col("id")).alias("x"))
    return v.select("info_no", T.redacted(F.col("x")).alias("text"))


# --- albums, covers, lookups


@query("SELECT info_no FROM video_infos WHERE lower(trim(artist)) IN ('unknown', 'unknown artist', 'unknown album', 'unknown title', 'untitled', 'no artist', 'no album', 'no title', 'no label', '[no label]', '[unknown]', 'n/a', 'none', 'various', 'track 1', 'new folder')")
def placeholder_values(s, d):
    return t(s, d, "video_infos").filter(labels.placeholder(F.col("artist"))).select("info_no")


@query("WITH n AS (SELECT id, credit, count(*) records FROM records WHERE id IS NOT NULL AND credit IS NOT NULL GROUP BY ALL), m AS (SELECT id, max(records) records FROM n GROUP BY id) SELECT id, credit, records FROM n JOIN m USING (id, records)")
def artist_spelling(s, d):
    """Every spelling of a credit has its vote, whatever its script."""
    return albums.artist_spelling(t(s, d, "records").filter("id IS NOT NULL AND credit IS NOT NULL"), "id", "credit")


@query("WITH n AS (SELECT album, count(DISTINCT song_no) n FROM songs WHERE album IS NOT NULL GROUP BY album), x AS (SELECT album, unnest(sources) k, song_no FROM songs WHERE album IS NOT NULL), r AS (SELECT album, regexp_extract(k, '^([^:]*):', 1) site, count(DISTINCT song_no) songs FROM x GROUP BY ALL) SELECT album, site, songs FROM r JOIN n USING (album) WHERE songs >= 0.6 * n")
def settled_site(s, d):
    """The site most of an album's songs have a source on: the rule of settled releases."""
    x = t(s, d, "songs").filter("album IS NOT NULL").select("album", "song_no", F.explode_outer("sources").alias("k")).withColumn("site", F.regexp_extract("k", "^([^:]*):", 1))
    return albums.settled_release(x, "album", "song_no", "site")


@query()
def unit_releases(s, d):
    songs = t(s, d, "songs").filter("album IS NOT NULL").select(F.col("album").alias("unit"), "song_no", F.explode("sources").alias("source_key"))
    v = t(s, d, "video_infos").select("source_key", "album").filter("album IS NOT NULL").dropDuplicates()
    return albums.unit_releases(songs.join(v, "source_key").withColumnRenamed("album", "release"), "unit", "song_no", "release", [])


@query("SELECT source_key, count(DISTINCT song_no) songs, min(song_no) first_song FROM claims WHERE source_key IS NOT NULL GROUP BY source_key HAVING count(DISTINCT song_no) > 0")
def owners(s, d):
    return t(s, d, "claims").filter("source_key IS NOT NULL").groupBy("source_key").agg(F.count_distinct("song_no").alias("songs"), F.min("song_no").alias("first_song")).filter("songs > 0")


@query("SELECT v.source_key, CAST(floor(median((v.duration_s * 1000 - c.length_ms) / c.length_ms * 1000000)) AS BIGINT) ppm FROM video_infos v JOIN claims c ON v.source_key = c.source_key WHERE c.length_ms > 0 AND v.duration_s IS NOT NULL GROUP BY v.source_key")
def median_speed(s, d):
    c = t(s, d, "claims").filter("length_ms > 0").select("source_key", "length_ms")
    m = t(s, d, "video_infos").filter("duration_s IS NOT NULL").join(c, "source_key").withColumn("ppm", (F.col("duration_s") * 1000 - F.col("length_ms")) / F.col("length_ms") * 1000000)
    return albums.median_speed(m, "source_key", "ppm")


@query()
def whole_word(s, d):
    """Every title, with accents, wide letters and unseen characters."""
    return t(s, d, "records").filter(labels.whole_word(F.col("title"), "River")).select("record_no")


@query()
def path_stems(s, d):
    return _views(s, d).select("song_no", templates.path_stem("{albumartist|artist}/{album}/{title}").alias("path"))


@query()
def lookup_verdicts(s, d):
    v = _views(s, d)
    verdict = templates.lookup_verdict([["genre:=jazz"]], [["lyrics:timed"], ["cover:yes"]], SCHEMES, F.lit(False), F.col("song_no") % 2 == 0, F.col("song_no") % 3 == 0)
    return v.select("song_no", verdict.alias("verdict"))


@query("SELECT s.song_no, 'removed' state FROM songs s WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.song_no = s.song_no) UNION ALL SELECT DISTINCT song_no, 'listed' FROM claims WHERE song_no IN (SELECT song_no FROM songs)")
def tombstones(s, d):
    songs, claims = t(s, d, "songs").select("song_no"), t(s, d, "claims").select("song_no")
    return songs.join(claims, "song_no", "left_anti").withColumn("state", F.lit("removed")).unionByName(songs.join(claims, "song_no", "left_semi").withColumn("state", F.lit("listed")))


@query("SELECT c.claim_no FROM claims c JOIN (SELECT source_key, count(*) n, max(seen_at) l FROM video_infos GROUP BY 1) f ON c.source_key = f.source_key WHERE epoch(f.l) + least(3600 * pow(2, least(f.n - 1, 16)), 604800) <= epoch(TIMESTAMP '2024-06-01') AND NOT c.vetted")
def due_sources(s, d):
    f = t(s, d, "video_infos").groupBy("source_key").agg(F.count("*").alias("count"), F.max(F.unix_micros(F.col("seen_at").cast("timestamp")) / 1e6).alias("last"))
    late = incremental.due(f, F.lit(1717200000))
    return t(s, d, "claims").filter("NOT vetted").join(late, "source_key", "left_semi").select("claim_no")


@query()
def genre_votes(s, d):
    """Every genre, a packed name's votes going to each of its values once; votes are null where none is known."""
    g = t(s, d, "genres").filter("name IS NOT NULL")
    split = packed.split_values(g.select(F.col("name").alias("text")).dropDuplicates(), packed.label_lexicon(g.select("name")))
    each = F.coalesce(F.transform("items", lambda x: packed.key(x["item"])), F.array(packed.key(F.col("name"))))
    names = g.join(split, F.col("name") == F.col("text"), "left").select("votes", F.explode(F.array_distinct(each)).alias("name")).filter("name != ''")
    return names.groupBy("name").agg(F.sum("votes").alias("votes"))
