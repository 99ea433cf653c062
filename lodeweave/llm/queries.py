"""The queries of the training-data operators."""

from __future__ import annotations

from ..session import table as t
from . import leaks, linkage, lookalike, merkle, mixing, names, pii, residue, survivor


def queries() -> dict:
    return {
        "p1_found": lambda s, d: names.found(t(s, d, "records"), t(s, d, "aliases"), t(s, d, "video_infos")),
        "p1_canonical": lambda s, d: names.canonical(t(s, d, "records"), t(s, d, "aliases"), t(s, d, "video_infos")),
        "p2_found": lambda s, d: residue.found(t(s, d, "video_infos"), t(s, d, "records")),
        "p2_left_out": lambda s, d: residue.clean(t(s, d, "video_infos"), t(s, d, "records")),
        "p3_found": lambda s, d: linkage.found(t(s, d, "video_infos"), t(s, d, "records")),
        "p3_links": lambda s, d: linkage.link(t(s, d, "video_infos"), t(s, d, "records")),
        "p5_found": lambda s, d: survivor.found(t(s, d, "video_infos"), t(s, d, "records"), t(s, d, "claims"), residue.album_residue(t(s, d, "video_infos"))),
        "p5_survivors": lambda s, d: survivor.all_survivors(t(s, d, "video_infos"), t(s, d, "records"), t(s, d, "claims"), residue.album_residue(t(s, d, "video_infos"))),
        "p5_without_albums": lambda s, d: survivor.found_without_albums(t(s, d, "records"), t(s, d, "claims")),
        "p6_found": lambda s, d: merkle.found(t(s, d, "video_infos"), t(s, d, "agreed")),
        "p6_collapsed": lambda s, d: merkle.collapsed(t(s, d, "video_infos"), t(s, d, "agreed")),
        "p7_found": lambda s, d: lookalike.found(t(s, d, "video_infos"), t(s, d, "records")),
        "p8_found": lambda s, d: leaks.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_items": lambda s, d: leaks.item_report(leaks.leaks(t(s, d, "documents"), t(s, d, "eval_items")), t(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.shares(mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets")), t(s, d, "mix_targets")),
        "p10_found": lambda s, d: pii.find(t(s, d, "documents"), t(s, d, "aliases")),
        "p10_redacted": lambda s, d: pii.redact(t(s, d, "documents"), pii.find(t(s, d, "documents"), t(s, d, "aliases"))),
    }


_N = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".replace("\\\\", "\\")
_GROUPS = f"""
WITH v AS (SELECT info_no, {_N.format('title')} a, {_N.format('artist')} b, {_N.format('album')} c, {_N.format('channel')} d, upload_date e, duration_s f FROM video_infos),
x AS (SELECT 'video_infos' tab, info_no row_no, min(info_no) OVER w first_no, count(*) OVER w copies FROM v WHERE c <> '' WINDOW w AS (PARTITION BY a, b, c, d, e, f)),
g AS (SELECT agreed_no, song_no, field, list_sort(list_transform(vals, lambda z: {_N.format('z')})) k FROM agreed WHERE len(vals) > 0),
y AS (SELECT 'agreed' tab, agreed_no row_no, min(agreed_no) OVER w first_no, count(*) OVER w copies FROM g WINDOW w AS (PARTITION BY song_no, field, k)),
z AS (SELECT * FROM x UNION ALL SELECT * FROM y)
"""


# 18 words or more, one in twelve of them replaced, hold 8 words in a row that are not: such runs give the shifts, and of
# each shift a window is good where equal words (1 each) make up for replaced ones (-11 each).
_LEAKS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '\\[\\d{1,3}:\\d{2}(?:[.:]\\d{1,3})?\\]', ' ', 'g'), '[^\\p{L}\\p{N}]+'), lambda y: y <> '') w FROM documents), i AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '\\[\\d{1,3}:\\d{2}(?:[.:]\\d{1,3})?\\]', ' ', 'g'), '[^\\p{L}\\p{N}]+'), lambda y: y <> '') w FROM eval_items),
dl AS (SELECT doc_id, generate_subscripts(w, 1) pos, unnest(w) x FROM d), il AS (SELECT item_id, generate_subscripts(w, 1) pos, unnest(w) x FROM i),
dg AS (SELECT doc_id, pos, hash(w[pos:pos + 7]) g FROM (SELECT doc_id, w, generate_subscripts(w, 1) pos FROM d) WHERE pos + 7 <= len(w)),
ig AS (SELECT item_id, pos, hash(w[pos:pos + 7]) g FROM (SELECT item_id, w, generate_subscripts(w, 1) pos FROM i) WHERE pos + 7 <= len(w)),
s AS (SELECT DISTINCT doc_id, item_id, dg.pos - ig.pos shift FROM dg JOIN ig USING (g)),
m AS (SELECT s.doc_id, s.item_id, s.shift, il.pos, sum(CASE WHEN dl.x = il.x THEN 1 ELSE -11 END) OVER (PARTITION BY s.doc_id, s.item_id, s.shift ORDER BY il.pos) c,
        row_number() OVER (PARTITION BY s.doc_id, s.item_id, s.shift ORDER BY il.pos) n
      FROM s JOIN il USING (item_id) JOIN dl ON dl.doc_id = s.doc_id AND dl.pos = il.pos + s.shift),
z AS (SELECT doc_id, item_id, c, n, min(c) OVER (PARTITION BY doc_id, item_id, shift ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 18 PRECEDING) before FROM m)
"""
_LEAKED = "SELECT DISTINCT doc_id, item_id FROM z WHERE n >= 18 AND c >= least(0, coalesce(before, 0))"


_R = ("title", "release_date", "country", "label", "barcode")
_C = ("title", "artist", "album", "date", "genre", "isrc")
_REAL = "trim(regexp_replace({}, '\\s+', ' ', 'g')) <> ''"
_LATEST = f"""
WITH r AS (SELECT 'records' tab, id k, record_no row_no, seen_at, trust, unnest({list(_R)}) field, unnest([{', '.join(f'on_release.{f}' for f in _R)}]) v FROM records WHERE id IS NOT NULL),
c AS (SELECT 'claims' tab, concat(song_no, ' ', source_key) k, claim_no row_no, seen_at, trust, unnest({list(_C)}) field, unnest([{', '.join(f"list_filter(offers['{f}'], lambda z: {_REAL.format('z')})" for f in _C)}]) v
      FROM claims WHERE song_no IS NOT NULL AND source_key IS NOT NULL),
n AS (SELECT tab, k FROM (SELECT DISTINCT tab, k, row_no FROM r UNION ALL SELECT DISTINCT tab, k, row_no FROM c) GROUP BY tab, k HAVING count(*) > 1),
x AS (SELECT tab, k, row_no, seen_at, trust, field FROM r WHERE {_REAL.format('v')} UNION ALL SELECT tab, k, row_no, seen_at, trust, field FROM c WHERE len(v) > 0)
SELECT tab, row_no, field FROM x a SEMI JOIN n USING (tab, k)
WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.tab = a.tab AND b.k = a.k AND b.field = a.field AND b.row_no <> a.row_no AND (b.seen_at >= a.seen_at OR b.trust > a.trust))
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say of the problems: copies, leaks, and survivors of rows that all have a time."""
    return {
        "p8_found": _LEAKS + _LEAKED,
        "p8_items": _LEAKS + f"SELECT item_id, count(doc_id) documents FROM eval_items LEFT JOIN ({_LEAKED}) USING (item_id) GROUP BY item_id",
        "p5_without_albums": _LATEST,
        "p6_found": _GROUPS + "SELECT tab, first_no, row_no FROM z WHERE row_no > first_no",
        "p6_collapsed": _GROUPS + """, r AS (SELECT 'video_infos' tab, info_no row_no FROM video_infos UNION ALL SELECT 'agreed', agreed_no FROM agreed)
SELECT tab, row_no, coalesce(copies, 1) copies FROM r LEFT JOIN z USING (tab, row_no) WHERE first_no IS NULL OR first_no = row_no""",
    }
