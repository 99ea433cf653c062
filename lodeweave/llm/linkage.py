"""Uploads and recordings without a shared key: blocking, voting functions and a label model over their votes."""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .lookalike import mapped

# What titles of uploads carry besides the title, and the takes a recording may be.
DECORATION = re.compile(
    r"[(\[]\s*(?:official\s+)?(?:music\s+|lyric\s+)?(?:video|audio|lyrics?|visuali[sz]er|clip|hd|hq|4k|full\s+track)\s*[)\]]|\|\s*full\s+track\b|\b(?:hd|hq|4k)\s*$|\bfull\s+track\s*$", re.I
)
VERSION = re.compile(r"[(\[]\s*((?:live|demo|radio|extended|acoustic|remix|instrumental|karaoke|cover|edit|club|single|alternate)\b[^)\]]*)[)\]]", re.I)
FEATURED = re.compile(r"[(\[]?\s*(?:\bfeat\.?|\bft\.?|\bfeaturing|\bw/)\s+([^()\[\]|]*)[)\]]?", re.I)
SPLIT = re.compile(r"\s+[-–—|]\s+|:\s+|\s+\|\s*|\s+by\s+|\s*[\"“”＂]\s*", re.I)
NAMES = re.compile(r"[;|\t\n\\、·/]+|\s+&\s+|,\s+|\s+and\s+|\s+\+\s+|\s+x\s+|\s+(?:feat|ft|vs)\.?\s+|\s+(?:featuring|with)\s+", re.I)
#: Names (words in order) that stand for nobody.
NOBODY = {"artistunknown", "artistsvarious", "artistvarious"}
BUCKET_S = 6
#: Letters by which titles of one recording may differ at most.
SLIPS = 3
UPLOAD = "title_keys array<string>, names array<bigint>, tokens array<bigint>, version string, track bigint, topic bigint"
RECORD = "title_key string, title bigint, names array<bigint>, tokens array<bigint>, version string"
#: Votes with the number of their outcomes; 0 is always "says nothing".
VOTES = {"title": 4, "artist": 4, "length": 6, "version": 5, "track": 3, "channel": 3, "take": 3}
ROUNDS, PRIOR, BELIEF, GROWTH = 100, 0.5, 0.05, 3.0
ACCEPT = 0.5


def letters(text: str | None) -> str:
    """Letters and digits alone, lower case, look-alikes and accents brought to one form."""
    if not text:
        return ""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", mapped(text)) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", "", text.lower())


def words(text: str) -> list[str]:
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", mapped(text)) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.lower())


def name_forms(text: str | None) -> tuple[str, str]:
    """The name's words in order of the alphabet, joined, and its longest word."""
    w = words(text or "")
    return "".join(sorted(w)), max(w, key=lambda x: (len(x), x), default="")


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def version_of(text: str | None) -> str:
    m = VERSION.search(text or "")
    return " ".join(words(m[1])) if m else ""


def upload_features(title, artist, creator, channel, track) -> dict:
    text = DECORATION.sub(" ", title or "")
    version = version_of(text)
    text = VERSION.sub(" ", text)
    guests = [m[1] for m in FEATURED.finditer(text)]
    text = FEATURED.sub(" ", text)
    parts = [p for p in SPLIT.split(text) if p and re.search(r"\w", p)]
    runs = {"": parts}
    if len(parts) > 1:
        runs |= {parts[0]: parts[1:], parts[-1]: parts[:-1]}
    known = [n for f in (artist, creator) for n in [f or "", *NAMES.split(f or "")] if n.strip()]
    topic = None
    if channel and channel.endswith(" - Topic"):
        known.append(channel[:-8])
        topic = name_forms(channel[:-8])[1]
    titles, names, tokens = {}, set(), set()
    for n in [*known, *(x for g in guests for x in NAMES.split(g))]:
        full, token = name_forms(n)
        if token and full not in NOBODY:
            names.add(full)
            tokens.add(token)
    for who, run in runs.items():
        if not run:
            continue
        k = letters("".join(run))
        if not k or k in titles:
            continue
        full, token = name_forms(who)
        own = {token} if token else set()
        if own:
            names.add(full)
        titles[k] = own
    track_key = letters(VERSION.sub(" ", track)) if track else ""
    if (k := track_key) and k not in titles:
        titles[k] = set()
    every = tokens | {t for own in titles.values() for t in own}
    hashed = lambda xs: sorted(_hash(x) for x in xs)
    return {"title_keys": list(titles), "names": hashed(names), "tokens": hashed(every), "track": _hash(track_key) if track_key else None, "topic": _hash(topic) if topic else None, "version": version}


def record_features(title, artists, version) -> dict:
    k = letters(title)
    forms = [name_forms(a) for a in (artists if artists is not None else [])]
    tokens = {t for _, t in forms if t}
    return {"title_key": k, "title": _hash(k), "names": sorted({_hash(f) for f, t in forms if t}), "tokens": sorted(map(_hash, tokens)), "version": " ".join(words(version or ""))}


def _rows(f, columns: list[str]):
    def series(df: pd.DataFrame) -> pd.DataFrame:
        rows = [f(*r) for r in zip(*[df[c].astype(object).where(df[c].notna(), None) for c in columns], strict=True)]
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="Int64" if c in ("track", "topic", "title") else object) for c in (rows[0] if rows else [])})

    return series


def uploads(videos: DataFrame) -> DataFrame:
    """One row for each source_key: of each field the value of the row that is trusted most and seen last."""
    rank = lambda c: F.max(F.when(F.trim(c.cast("string")) != "", F.struct("trust", "seen_at", "info_no", c.alias("v"))))["v"]
    fields = ["title", "artist", "creator", "channel", "track", "duration_s"]
    one = videos.filter(F.col("source_key").isNotNull()).groupBy("source_key").agg(*[rank(F.col(c)).alias(c) for c in fields])
    f = F.pandas_udf(_rows(upload_features, fields[:5]), UPLOAD)
    return one.select(F.xxhash64("source_key").alias("uid"), "source_key", "duration_s", f(F.struct(*fields[:5])).alias("u"))


def recordings(records: DataFrame) -> DataFrame:
    """One row for each id, with the names of all its rows."""
    per = records.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.when(F.trim("title") != "", F.struct("trust", "seen_at", "record_no", "title")))["title"].alias("title"),
        F.array_distinct(F.flatten(F.collect_set("artists"))).alias("artists"),
        F.max(F.when(F.trim("disambiguation") != "", F.col("disambiguation"))).alias("version"),
        F.max("length_ms").alias("length_ms"),
    )
    fields = ["title", "artists", "version"]
    f = F.pandas_udf(_rows(record_features, fields), RECORD)
    return per.filter(F.col("title").isNotNull()).select(F.xxhash64("id").alias("rid"), "id", "length_ms", f(F.struct(*fields)).alias("r"))


def candidates(u: DataFrame, r: DataFrame, cuts: list | None = None) -> DataFrame:
    """uid, rid, title: pairs that share a title and an artist's word, or a title and about a length (title 3), and pairs
    that share an artist's word and whose titles are some slips apart (2, or 1 where their numbers differ).

    Every key is narrow, so no title, artist or length alone makes a block. uid and rid are 64-bit hashes of the keys, so
    that pairs stay small; among a billion uploads the chance that any two share one is one in forty.
    """
    b = F.floor(F.col("duration_s") / BUCKET_S)
    mine = u.filter("duration_s IS NOT NULL AND NOT isnan(duration_s)").select("uid", F.explode(F.array(b - 1, b, b + 1)).alias("b"), F.col("u.title_keys").alias("ks")).select("uid", "b", F.explode("ks").alias("k")).select("uid", F.xxhash64("k", "b").alias("p"))
    theirs = r.filter("length(r.title_key) > 0 AND length_ms IS NOT NULL").select("rid", F.xxhash64("r.title_key", F.floor(F.col("length_ms") / (1000 * BUCKET_S))).alias("p"))
    timed = mine.join(theirs, "p").select("uid", "rid", F.lit(3).alias("title"))
    return timed.unionByName(_of_artist(u, r, cuts)).groupBy("uid", "rid").agg(F.max("title").alias("title"))


def _of_artist(u: DataFrame, r: DataFrame, cuts: list | None = None) -> DataFrame:
    """uid, rid, title of all pairs that share an artist's word and hold equal titles, or titles up to SLIPS and a quarter of the upload's letters apart.

    Titles that differ by n slips have one of n + 1 pieces of either in common, moved by n letters at most; so pieces of
    the upload's title meet the substrings of the recording's. Each title of an artist's word is taken once, however many
    rows hold it.
    """
    theirs = r.filter("length(r.title_key) > 0").select("rid", F.col("r.title_key").alias("x"), F.explode("r.tokens").alias("t")).withColumn("g", F.xxhash64("t", "x"))
    known = theirs.groupBy("t").agg(F.min(F.length("x")).alias("least"), F.max(F.length("x")).alias("most"))
    mine = u.select("uid", F.explode("u.tokens").alias("t"), F.col("u.title_keys").alias("ks")).join(known, "t")
    mine = mine.select("uid", "t", "least", "most", F.explode("ks").alias("k")).filter(F.length("k").between(F.col("least") - SLIPS, F.col("most") + SLIPS))
    mine = cut(mine.select("uid", "t", "k", F.xxhash64("t", "k").alias("h")))
    if cuts is not None:
        cuts.append(mine)
    asked = mine.filter("length(k) >= 4").dropDuplicates(["h"])
    a = _pieces(asked.withColumn("n", F.length("k"))).select("h", F.expr("xxhash64(t, n, i, substring(k, f + 1, w))").alias("p"))
    # For each length n of an upload's title, each piece at each place where it can be: i slips before it and m - i after it at most.
    lengths = asked.groupBy("t").agg(F.collect_set(F.length("k")).alias("ns"))  # only lengths that an upload of the word has
    b = theirs.dropDuplicates(["g"]).join(lengths, "t").select("*", F.explode(F.expr(f"sequence(-{SLIPS}, {SLIPS})")).alias("o")).withColumn("n", F.length("x") - F.col("o")).filter("n >= 4 AND array_contains(ns, n)").drop("ns")
    b = _pieces(b).filter("abs(o) <= m").selectExpr("*", "greatest(0, f - i, f + o - m + i) AS least", "least(length(x) - w, f + i, f + o + m - i) AS most").filter("least <= most")
    b = b.withColumn("f", F.explode(F.sequence("least", "most"))).select("g", F.expr("xxhash64(t, n, i, substring(x, f + 1, w))").alias("p"))
    # Pieces travel as hashes; texts join the pairs that share one.
    met = a.join(b, "p").filter("h != g").select("h", "g").dropDuplicates()
    met = met.join(asked.select("h", "k"), "h").join(theirs.select("g", "x").dropDuplicates(["g"]), "g").filter(F.levenshtein("k", "x", SLIPS).between(1, F.length("k") / 4))
    number = lambda c: F.trim(F.regexp_replace(c, r"\D+", " "))
    met = met.select("h", "g", F.when(number("k") == number("x"), 2).otherwise(1).alias("title")).dropDuplicates(["h", "g"])
    pair = mine.select("uid", "h"), theirs.select("rid", "g")
    same = pair[0].join(pair[1], F.col("h") == F.col("g")).select("uid", "rid", F.lit(3).alias("title"))
    return same.unionByName(met.join(pair[0], "h").join(pair[1], "g").select("uid", "rid", "title"))


def _pieces(titles: DataFrame) -> DataFrame:
    """A title of n letters, up to m slips, in m + 1 pieces: piece i begins at f (0 the first) and is w letters wide."""
    df = titles.withColumn("m", F.expr(f"CAST(least(n div 4, {SLIPS}) AS INT)")).withColumn("i", F.explode(F.expr("sequence(0, m)")))
    return df.withColumn("f", F.expr("CAST(i * (n div (m + 1)) + greatest(0, i - (m + 1 - n % (m + 1))) AS INT)")).withColumn("w", F.expr("CAST(n div (m + 1) + if(i >= m + 1 - n % (m + 1), 1, 0) AS INT)"))


def vote_columns(pairs: DataFrame, title: Column) -> DataFrame:
    """The pairs with a vote of each function: 0 says nothing, else 1 (against) and up."""
    artist = (
        F.when((F.size("u.tokens") == 0) | (F.size("r.tokens") == 0), 0)
        .when(F.arrays_overlap("u.names", "r.names"), 3)
        .when(F.arrays_overlap("u.tokens", "r.tokens"), 2)
        .otherwise(1)
    )
    gap = F.abs(F.col("duration_s") * 1000 - F.col("length_ms"))
    length = F.when(gap.isNull(), 0).when(gap <= 1100, 5).when(gap <= 3100, 4).when(gap <= 8100, 3).when(gap <= 20000, 2).otherwise(1)
    a, b = F.col("u.version"), F.col("r.version")
    version = F.when((a == "") & (b == ""), 3).when(a == b, 4).when(a == "", 2).otherwise(1)
    track = F.when(F.col("u.track").isNull(), 0).when(F.col("u.track") == F.col("r.title"), 2).otherwise(1)
    channel = F.when(F.col("u.topic").isNull(), 0).when(F.array_contains("r.tokens", F.col("u.topic")), 2).otherwise(1)
    # A length that is far off is another take; one that is off, under another name, another song.
    off = (length == 1) | (artist == 1) & (length == 2)
    take = F.when(length == 0, 0).when(off, 1).otherwise(2)
    votes = {"title": title, "artist": artist, "length": length, "version": version, "track": track, "channel": channel, "take": take}
    return pairs.select("uid", "rid", gap.alias("gap"), *[v.cast("int").alias(f"v_{n}") for n, v in votes.items()])


def judged(u: DataFrame, r: DataFrame, cuts: list | None = None) -> DataFrame:
    """uid, rid, gap and the votes of all candidate pairs. Tables cut on the way are added to cuts."""
    part = lambda df, key, side, *more: df.select(key, "duration_s" if side == "u" else "length_ms", F.struct(*[F.col(f"{side}.{c}") for c in ("names", "tokens", "version", *more)]).alias(side))
    both = candidates(u, r, cuts).join(part(r, "rid", "r", "title"), "rid").join(part(u, "uid", "u", "track", "topic"), "uid")
    return vote_columns(both, F.col("title"))


def _correlated(votes: np.ndarray, n: np.ndarray, post: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Of each function the sum of its positive correlations with the others within the classes, where both say something."""
    said = [tables[j][votes[:, j]] for j in range(len(tables))]
    out = np.zeros(len(tables))
    for j, i in itertools.combinations(range(len(tables)), 2):
        num = da = db = 0.0
        both = (votes[:, i] > 0) & (votes[:, j] > 0)
        for w in (n * post * both, n * (1 - post) * both):
            if w.sum() > 0:
                a, b = said[j] - (w * said[j]).sum() / w.sum(), said[i] - (w * said[i]).sum() / w.sum()
                num, da, db = num + (w * a * b).sum(), da + (w * a * a).sum(), db + (w * b * b).sum()
        if da > 0 and db > 0:
            out[[i, j]] += max(0.0, num / np.sqrt(da * db))
    return out


def label_model(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Posterior of each pattern of votes, and what was learned of each function.

    Expectation-maximization of two latent classes over counts of vote patterns; a vote of 0 tells nothing. Functions
    that vote alike beyond what the classes explain share their weight: in every round each one's log-odds are divided by
    one plus the sum of its positive correlations with the others within the classes, so posterior and correlations are
    learned together.
    """
    votes = np.array([p for p, _ in patterns], dtype=int)
    n = np.array([c for _, c in patterns], dtype=float)
    sizes = list(VOTES.values())[: votes.shape[1]]
    hold = BELIEF * n.sum()  # how much the prior belief that higher votes speak for a match weighs in each table
    good = [np.array([0.0, *(GROWTH**i for i in range(k - 1))]) for k in sizes]
    good = [g / g.sum() * hold for g in good]
    bad = [np.concatenate([[0.0], g[:0:-1]]) for g in good]
    total = lambda prior, tables, share: np.log(prior / (1 - prior)) + sum(tables[j][votes[:, j]] * share[j] for j in range(len(sizes)))
    tables = [np.concatenate([[0.0], np.log(g[1:] / b[1:])]) for g, b in zip(good, bad, strict=True)]
    share, prior = np.ones(len(sizes)), PRIOR
    post = 1 / (1 + np.exp(-np.clip(total(prior, tables, share), -40, 40)))
    for _ in range(ROUNDS):
        tables = []
        for j, k in enumerate(sizes):
            m = np.bincount(votes[:, j], weights=n * post, minlength=k) + good[j]
            u = np.bincount(votes[:, j], weights=n * (1 - post), minlength=k) + bad[j]
            m[0] = u[0] = 0
            tables.append(np.concatenate([[0.0], np.log(m[1:] / m.sum()) - np.log(u[1:] / u.sum())]))
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-6, 1 - 1e-6))
        share = 1 / (1 + _correlated(votes, n, post, tables))
        new = 1 / (1 + np.exp(-np.clip(total(prior, tables, share), -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    learned = [{"vote": v, "share": float(share[j]), "weights": [float(x) for x in tables[j]]} for j, v in enumerate(list(VOTES)[: len(sizes)])]
    return {tuple(int(x) for x in p): float(q) for (p, _), q in zip(patterns, post, strict=True)}, learned


def link(videos: DataFrame, records: DataFrame) -> DataFrame:
    """source_key, record_id, confidence: at most one recording for each upload.

    Vote patterns are counted over all candidate pairs; only the counts, one row a pattern (a few hundred whatever the
    input), reach the driver. An upload without a title and a recording without one are linked to nothing, and no upload
    is linked with a posterior under one half. Equal posteriors: the nearest length, then the smallest id. Nulls in
    other columns make their vote say nothing. Empty tables give no rows.
    """
    u, r = cut(uploads(videos)), cut(recordings(records))
    cuts: list[DataFrame] = []
    voted = cut(judged(u, r, cuts))
    for table in cuts:
        discard(table)  # voted is written
    names = [f"v_{v}" for v in VOTES]
    counted = [(tuple(row[c] for c in names), row["n"]) for row in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    if not counted:
        return u.join(r, F.lit(False)).select("source_key", F.col("id").alias("record_id"), F.lit(0.0).alias("confidence"))
    posterior, _ = label_model(sorted(counted))
    spark = videos.sparkSession
    table = spark.createDataFrame([(*p, q) for p, q in posterior.items()], ", ".join(f"{c} int" for c in names) + ", confidence double")
    scored = voted.join(F.broadcast(table), names).filter(F.col("confidence") >= ACCEPT)
    kept = scored.join(r.select("rid", "id"), "rid")
    best = kept.groupBy("uid").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.coalesce("gap", F.lit(1e12)).alias("g"), F.col("id"))).alias("first"))
    return best.join(u.select("uid", "source_key"), "uid").select("source_key", F.col("first.id").alias("record_id"), F.round(-F.col("first.c"), 6).alias("confidence"))


def found(videos: DataFrame, records: DataFrame) -> DataFrame:
    return link(videos, records).select("source_key", "record_id")

