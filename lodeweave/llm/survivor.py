"""One surviving row of each group, field by field: currency reasoning over partial orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A value is learned to come before another where it did so at least so often, and so many times as often as after it.
LEAST_SEEN, TIMES = 3, 2
EPOCH = "timestamp_ntz'0001-01-01'"
RECORD_FIELDS = ("title", "release_date", "country", "label", "barcode")
CLAIM_FIELDS = ("title", "artist", "album", "date", "genre", "isrc")


def real_text(c: Column) -> Column:
    """The text itself where it is a real value, else null."""
    return F.when(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", c)


def real_list(c: Column) -> Column:
    """The list as one text where it holds at least one real element, else null."""
    return F.when(F.exists(c, lambda x: F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")) != "", F.lit(False))), F.to_json(c))


def tops(rows: DataFrame, fields: list[str], order: dict[str, dict[str, set[str]]] | None = None) -> DataFrame:
    """key, field, row_no, value, sure, rows, real: the latest row of each group and field.

    rows: key, row_no, seen_at, trust and a column for each field, null where the value isn't real. Rows are in a partial
    order: one comes before another where it is seen earlier or, where a time is missing, where the kind of its value is
    learned to come before the other's, and it is trusted no more. The latest row is the last of a topological order:
    dated rows by seen_at, then trust, then row_no; an undated one by the length of the learned way to its kind, before
    the dated rows of that or more, so it is the latest only where all dated rows are of less and the latest of them of a
    learned kind. sure: every other row with a real value comes before it, by time or by a learned way. order holds of
    each field the kinds with those before them, directly or not. Null trust counts as none. Groups are reduced with
    partial sums alone (no window and no list of a group; kinds are few), so a hot key costs no more than others. A null
    key is no group; groups without a real value in a field give no row for it; empty input gives no rows.
    """
    aggs = [F.count("*").alias("rows")]
    for f in fields:
        real = F.col(f).isNotNull()
        seen = F.coalesce("seen_at", F.expr(EPOCH))
        trust = F.coalesce("trust", F.lit(0))
        dated = F.col("seen_at").isNotNull()
        place, kind = F.lit(0), F.lit("")
        if order is not None:
            place, kind = F.coalesce(F.col(f"_rank_{f}"), F.lit(0)), F.col(f"_kind_{f}")
            aggs += [F.collect_set(F.when(real & dated, kind)).alias(f"_k_{f}"), F.collect_set(F.when(real & ~dated, kind)).alias(f"_l_{f}")]
        aggs += [
            F.max(F.when(real & dated, F.struct(seen.alias("at"), trust.alias("trust"), F.col("row_no"), F.col(f).alias("value"), place.alias("rank"), kind.alias("kind")))).alias(f"_a_{f}"),
            F.max(F.when(real & ~dated, F.struct(place.alias("rank"), trust.alias("trust"), F.col("row_no"), F.col(f).alias("value"), kind.alias("kind")))).alias(f"_d_{f}"),
            F.max(F.when(real & dated, place)).alias(f"_r_{f}"),
            F.max(F.when(real & dated, F.struct(seen.alias("at"), (-F.col("row_no")).alias("other")))).alias(f"_b_{f}"),
            F.max(F.when(real & dated, F.struct(seen.alias("at"), F.col("row_no").alias("other")))).alias(f"_c_{f}"),
            F.max(F.when(real & ~dated, F.struct(place.alias("rank"), (-F.col("row_no")).alias("other")))).alias(f"_e_{f}"),
            F.max(F.when(real & ~dated, F.struct(place.alias("rank"), F.col("row_no").alias("other")))).alias(f"_g_{f}"),
            F.max(F.when(real, trust)).alias(f"_t_{f}"),
            F.count(F.when(real, 1)).alias(f"_n_{f}"),
            F.count(F.when(real & ~dated, 1)).alias(f"_u_{f}"),
        ]
    groups = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(*aggs)
    per = []
    for f in fields:
        a, d = F.col(f"_a_{f}"), F.col(f"_d_{f}")
        late = a.isNull() | F.coalesce((d["rank"] > F.col(f"_r_{f}")) & (a["rank"] > 0), F.lit(False))
        of = lambda c, a=a, d=d, late=late: F.when(late, d[c]).otherwise(a[c])
        sole = lambda x, y, f=f: F.coalesce(F.col(f"_{x}_{f}")["other"] == -F.col(f"_{y}_{f}")["other"], F.lit(False))
        by_kind = F.lit(False)
        if order is not None and order.get(f):
            before = F.create_map(*[F.lit(x) for k, xs in sorted(order[f].items()) for x in (k, sorted(xs))])
            known = F.coalesce(F.element_at(before, of("kind")), F.array().cast("array<string>"))
            others = F.when(late, F.array_union(f"_k_{f}", F.array_except(f"_l_{f}", F.array(d["kind"])))).otherwise(F.col(f"_l_{f}"))
            by_kind = (F.size(F.array_except(others, known)) == 0) & F.when(late, sole("g", "e")).otherwise(sole("c", "b"))
        last = F.when(F.col(f"_u_{f}") == 0, sole("c", "b")).otherwise(by_kind) & (of("trust") >= F.col(f"_t_{f}"))
        sure = (F.col(f"_n_{f}") == 1) | F.coalesce(last, F.lit(False))
        per.append(F.struct(F.lit(f).alias("field"), of("row_no").alias("row_no"), of("value").alias("value"), sure.alias("sure"), F.col(f"_n_{f}").alias("real")))
    return groups.select("key", "rows", F.inline(F.array(*per))).filter("real > 0")


def transitions(rows: DataFrame, field: str, kind: Column) -> DataFrame:
    """field, earlier, later: kinds of value that are learned to follow each other from rows with a time.

    Each change from one time of a group to the next counts, for all kinds seen at both; rows of one time are in no order.
    Kinds of a time are few, so a long history costs its rows and no pairs of them. Times are put in order within a day
    of a group and days within the group, so no task sorts a hot group's whole history.
    """
    dated = rows.filter(F.col("seen_at").isNotNull() & F.col(field).isNotNull() & F.col("key").isNotNull())
    dated = dated.select("key", F.to_date("seen_at").alias("day"), "seen_at", kind.alias("kind")).dropDuplicates()
    times = dated.withColumn("at", F.dense_rank().over(Window.partitionBy("key", "day").orderBy("seen_at")))
    days = times.groupBy("key", "day").agg(F.max("at").alias("last")).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("day")))
    placed = times.join(days, ["key", "day"])
    ends = F.col("at") == F.col("last")
    first = placed.select("key", F.when(ends, F.col("nth") + 1).otherwise(F.col("nth")).alias("nth"), F.when(ends, 1).otherwise(F.col("at") + 1).alias("at"), F.col("kind").alias("earlier"))
    then = placed.select("key", "nth", "at", F.col("kind").alias("later"))
    steps = first.join(then, ["key", "nth", "at"]).filter("earlier != later").groupBy("earlier", "later").agg(F.count("*").alias("n"))
    back = steps.select(F.col("earlier").alias("later"), F.col("later").alias("earlier"), F.col("n").alias("m"))
    net = steps.join(back, ["earlier", "later"], "left").filter(f"n >= {LEAST_SEEN} AND n > {TIMES} * coalesce(m, 0)")
    return net.select(F.lit(field).alias("field"), "earlier", "later", "n")


#: Words that tell what a bracket at the end of a value adds; others are one kind.
ADDED = ("remaster", "remastered", "reissue", "deluxe", "live", "demo", "demos", "edition", "bonus", "expanded", "anniversary", "mono", "stereo", "single", "ep", "disc", "vol", "version", "pressing", "mix", "remix")


def value_kind(c: Column) -> Column:
    """What a value is like, for learning: under a thousand kinds (shapes, codes of two letters, what a bracket adds), whatever the number of values."""
    bracket = F.regexp_extract(F.lower(c), r"[(\[]([^)\]]*)[)\]]\s*$", 1)
    added = F.regexp_extract(bracket, r"\b(" + "|".join(ADDED) + r")\b", 1)
    shape = F.when(c.rlike(r"^\d{4}$"), "year").when(c.rlike(r"^\d{4}-\d\d$"), "month").when(c.rlike(r"^\d{4}-\d\d-\d\d$"), "day").when(c.rlike(r"^[A-Z]{2}$"), F.concat(F.lit("code "), c))
    return F.coalesce(shape, F.when(bracket != "", F.concat(F.lit("("), added)), F.when(F.upper(c) == c, "upper"), F.lit("plain"))


def learned_order(edges: DataFrame) -> tuple[dict[str, dict[str, int]], dict[str, dict[str, set[str]]]]:
    """Of each field the rank of each kind (the longest way to it over learned steps) and the kinds before it.

    Steps are taken from the most frequent on; one that would close a ring is left out. Kinds are few by construction
    (see value_kind), so their steps are read by the driver.
    """
    ranks: dict[str, dict[str, int]] = {}
    befores: dict[str, dict[str, set[str]]] = {}
    for r in edges.orderBy("field", F.desc("n"), "earlier", "later").collect():
        before = befores.setdefault(r["field"], {})
        a, b = r["earlier"], r["later"]
        if b == a or b in before.get(a, ()):
            continue
        new = {a} | before.get(a, set())
        before.setdefault(a, set())
        for kind in [k for k, xs in before.items() if k == b or b in xs] or [b]:
            before[kind] = before.get(kind, set()) | new
    for field, before in befores.items():
        rank = ranks.setdefault(field, {})
        for kind in sorted(before, key=lambda k: (len(before[k]), k)):  # a kind has fewer before it than those it is before of
            rank[kind] = 1 + max((rank[x] for x in before[kind]), default=0)
    return ranks, befores


def survivors(rows: DataFrame, fields: list[str]) -> DataFrame:
    """tops() with precedence learned from the dated rows. Where no row lacks a time it has no say, and isn't learned."""
    if rows.filter(F.col("seen_at").isNull()).limit(1).count() == 0:
        return tops(rows, fields)
    ranks, before = learned_order(reduce(DataFrame.unionByName, [transitions(rows, f, value_kind(F.col(f))) for f in fields]))
    for f in fields:
        held = F.create_map(*[F.lit(x) for kv in sorted(ranks[f].items()) for x in kv]) if ranks.get(f) else F.lit(None).cast("map<string,int>")
        rows = rows.withColumn(f"_kind_{f}", value_kind(F.col(f))).withColumn(f"_rank_{f}", F.element_at(held, F.col(f"_kind_{f}")))
    return tops(rows, fields, before)


def video_rows(videos: DataFrame, residue: DataFrame | None = None) -> DataFrame:
    v = videos.select(F.col("source_key").alias("key"), F.col("info_no").alias("row_no"), "seen_at", "trust", real_text(F.col("album")).alias("album"))
    if residue is None:
        return v
    bad = residue.filter("tab = 'video_infos' AND field = 'album'").select("row_no", F.lit(True).alias("_bad"))
    return v.join(bad, "row_no", "left").withColumn("album", F.when(F.col("_bad").isNull(), F.col("album"))).drop("_bad")


def record_rows(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("key"), F.col("record_no").alias("row_no"), "seen_at", "trust", *[real_text(F.col(f"on_release.{f}")).alias(f) for f in RECORD_FIELDS])


def claim_rows(claims: DataFrame) -> DataFrame:
    key = F.when(F.col("song_no").isNotNull() & F.col("source_key").isNotNull(), F.struct("song_no", "source_key"))
    return claims.select(key.alias("key"), F.col("claim_no").alias("row_no"), "seen_at", "trust", *[real_list(F.col("offers")[f]).alias(f) for f in CLAIM_FIELDS])


def all_survivors(videos: DataFrame, records: DataFrame, claims: DataFrame, residue: DataFrame | None) -> DataFrame:
    """tab, group, field, row_no, value, sure, rows, real of all three tables."""
    return _named(("video_infos", survivors(video_rows(videos, residue), ["album"])), *_recorded(records, claims))


def _recorded(records: DataFrame, claims: DataFrame) -> list[tuple[str, DataFrame]]:
    return [("records", survivors(record_rows(records), list(RECORD_FIELDS))), ("claims", survivors(claim_rows(claims), list(CLAIM_FIELDS)))]


def _named(*parts: tuple[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(F.lit(tab).alias("tab"), F.to_json(F.struct("key")).alias("group_key"), "field", "row_no", "value", "sure", "rows", "real") for tab, p in parts])


def found(videos: DataFrame, records: DataFrame, claims: DataFrame, residue: DataFrame) -> DataFrame:
    """The row of each field that comes after every other, in groups of two rows or more."""
    return all_survivors(videos, records, claims, residue).filter("sure AND rows > 1").select("tab", "row_no", "field")


def found_without_albums(records: DataFrame, claims: DataFrame) -> DataFrame:
    """found() of records and claims, whose real values don't depend on residue."""
    return _named(*_recorded(records, claims)).filter("sure AND rows > 1").select("tab", "row_no", "field")
