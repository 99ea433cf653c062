"""Joins in shapes the optimizer doesn't derive by itself."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def exploded(df: DataFrame, array: str, position: str, value: str) -> DataFrame:
    """A row for each element with its position; rows of a null or empty array are dropped."""
    return df.select("*", F.posexplode(array).alias(position, value))


def length_band_pairs(df: DataFrame, key: str, length: str, ratio: float, block: list[str]) -> DataFrame:
    """key_a < key_b of rows of one block whose shorter length is at least ratio of the longer.

    Rows meet in logarithmic bands: a row is probed in its own band and the next, so each pair meets once and no block is
    compared as a whole. Null or non-positive lengths meet nothing.
    """
    band = F.floor(F.log(F.col(length)) / math.log(1 / ratio)).cast("bigint")
    rows = df.filter(F.col(length) > 0).select(*block, F.col(key).alias("k"), F.col(length).alias("n"), band.alias("band"))
    left = rows.select(*block, F.col("k").alias("key_a"), F.col("n").alias("na"), F.explode(F.array("band", F.col("band") + 1, F.col("band") - 1)).alias("band"))
    right = rows.select(*block, F.col("k").alias("key_b"), F.col("n").alias("nb"), "band")
    met = left.join(right, [*block, "band"]).filter("key_a < key_b")
    return met.filter(F.least("na", "nb") >= ratio * F.greatest("na", "nb")).select("key_a", "key_b")


def unique_name_join(left: DataFrame, left_name: Column, right: DataFrame, right_name: Column, right_key: str) -> DataFrame:
    """left with right_key where exactly one key of right holds the name, else null. A null name joins nothing."""
    one = right.select(right_name.alias("_n"), F.col(right_key)).groupBy("_n").agg(F.min(right_key).alias(right_key), F.max(right_key).alias("_x")).filter(F.col(right_key) == F.col("_x")).drop("_x")
    return left.withColumn("_n", left_name).join(one, "_n", "left").drop("_n")


def best_match(pairs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first pair of each key in the order given, which has to be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def nearest_with_lead(pairs: DataFrame, key: str, cand: str, distance: str, strong: float = 0.04, ask: float = 0.25, lead: float = 0.1) -> DataFrame:
    """The nearest candidate of each key: strong where it is near and leads the next, ask where it is not too far."""
    w = Window.partitionBy(key).orderBy(distance, cand)
    near = pairs.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead(distance).over(w)).filter(F.col("_r") == 1)
    leads = F.col("_next").isNull() | (F.round(F.col("_next") - F.col(distance), 6) >= lead)
    verdict = F.when((F.col(distance) <= strong) & leads, "strong").when(F.col(distance) <= ask, "ask").otherwise("none")
    return near.select(key, cand, distance, verdict.alias("verdict"))


def weighted_distance(parts: list[tuple[float, Column]]) -> Column:
    """Sum of weight times distance over the sum of weights, of the fields both sides have; null where there is none."""
    num = reduce(lambda a, b: a + b, [F.when(d.isNotNull(), w * d).otherwise(0.0) for w, d in parts])
    den = reduce(lambda a, b: a + b, [F.when(d.isNotNull(), w).otherwise(0.0) for w, d in parts])
    return F.when(den > 0, num / den)


def pair_by_unique_evidence(gone: DataFrame, new: DataFrame, key: str, other: str, evidence: list[str]) -> DataFrame:
    """key, other, by: gone rows paired with new ones by the first evidence that singles both out; the rest pass to the next."""
    out = []
    left, right = gone, new
    for e in evidence:
        a = left.filter(F.col(e).isNotNull()).groupBy(e).agg(F.min(key).alias(key), F.count("*").alias("_a")).filter("_a = 1").drop("_a")
        b = right.filter(F.col(e).isNotNull()).groupBy(e).agg(F.min(other).alias(other), F.count("*").alias("_b")).filter("_b = 1").drop("_b")
        met = a.join(b, e).select(key, other, F.lit(e).alias("by"))
        out.append(met)
        left, right = left.join(met.select(key), key, "left_anti"), right.join(met.select(other), other, "left_anti")
    return reduce(DataFrame.unionByName, out)


def trailing_folders(a: Column, b: Column) -> Column:
    """How many folders from the end two paths share."""
    x, y = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("bigint")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, was, now of each field that differs; a row on one side only differs in all its stated fields."""
    long = lambda df, name: df.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", name))
    met = long(old, "was").join(long(new, "now"), [key, "field"], "full")
    return met.filter(~F.col("was").eqNullSafe(F.col("now")))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row: a lambda's variable isn't inlined where it is used again and again."""
    return F.transform(F.array(value), use)[0]


def shingles(words: Column, k: int) -> Column:
    """Runs of k words, or all as one where there are fewer; none of no words."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n >= k, F.array_distinct(many)).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return once(words, runs)


def containment(shared: Column, a: Column, b: Column) -> Column:
    """Share of the smaller set the other holds."""
    return shared / F.least(a, b)


def shared_shingles(left: DataFrame, lkey: str, right: DataFrame, rkey: str, words_l: Column, words_r: Column, k: int, least: float) -> DataFrame:
    """lkey, rkey, share of pairs of which the smaller set is held by the other by the least share or more.

    Sets meet by their shingles' hashes; sizes travel along, so no text is shuffled.
    """
    sets = lambda df, key, w: df.select(F.col(key), once(shingles(w, k), lambda v: F.transform(v, lambda s: F.xxhash64(s))).alias("s")).select(key, F.size("s").alias(f"n_{key}"), F.explode("s").alias("s"))
    met = sets(left, lkey, words_l).join(sets(right, rkey, words_r), "s").groupBy(lkey, rkey).agg(F.count("*").alias("c"), F.first(f"n_{lkey}").alias("a"), F.first(f"n_{rkey}").alias("b"))
    return met.withColumn("share", containment(F.col("c"), F.col("a"), F.col("b"))).filter(F.col("share") >= least).select(lkey, rkey, "share")


def similar_sets(df: DataFrame, key: str, words: Column, k: int = 5, least: float = 0.8) -> DataFrame:
    """key_a < key_b, share of different texts whose sets of k-word shingles have a Jaccard share of the least or more.

    Exact by prefix filtering: a set's shingles are ordered from the rarest, and pairs of that share must meet in the first
    n - ceil(share * n) + 1 of them, so the commonest shingles make no block. Sets of equal shingles are one class, with the
    smallest key; classes() gives the members. Texts without words are in no class.
    """
    return similar_reps(classes_of_sets(df, key, words, k)[0], least)


def similar_reps(reps: DataFrame, least: float) -> DataFrame:
    """similar_sets() of sets that are made already: rep, s (distinct hashes), n."""
    long = reps.select("rep", "n", F.explode("s").alias("s"))
    df_ = long.groupBy("s").agg(F.count("*").alias("df"))
    ordered = long.join(df_, "s").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    take = (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int")
    prefix = ordered.select("rep", "n", F.explode(F.transform(F.slice("o", F.lit(1), take), lambda x: x["s"])).alias("s"))
    a = prefix.select(F.col("rep").alias("key_a"), F.col("n").alias("na"), "s")
    b = prefix.select(F.col("rep").alias("key_b"), F.col("n").alias("nb"), "s")
    met = a.join(b, "s").filter((F.col("key_a") < F.col("key_b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("key_a", "key_b").dropDuplicates()
    sets = reps.select("rep", "s")
    both = met.join(sets.select(F.col("rep").alias("key_a"), F.col("s").alias("sa")), "key_a").join(sets.select(F.col("rep").alias("key_b"), F.col("s").alias("sb")), "key_b")
    common = F.size(F.array_intersect("sa", "sb"))
    share = common / (F.size("sa") + F.size("sb") - common)
    return both.withColumn("share", share).filter(F.col("share") >= least).select("key_a", "key_b", "share")


def classes_of_sets(df: DataFrame, key: str, words: Column, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rep, s, n) of each set of shingle hashes and (key, rep) of each row: copies are one set."""
    hashed = once(shingles(words, k), lambda v: F.array_sort(F.transform(v, lambda x: F.xxhash64(x))))
    rows = cut(df.select(F.col(key).alias("key"), hashed.alias("s")).filter(F.size("s") > 0)).withColumn("h", F.md5(F.array_join(F.transform("s", lambda x: x.cast("string")), ",")))
    reps = rows.groupBy("h").agg(F.min(F.struct("key", "s")).alias("m")).select("h", F.col("m.key").alias("rep"), F.col("m.s").alias("s"))
    return reps.select("rep", "s", F.size("s").alias("n")), rows.select("key", "h").join(reps.select("h", "rep"), "h").select("key", "rep")


def near_duplicate_classes(df: DataFrame, key: str, words: Column, k: int = 5, least: float = 0.8) -> DataFrame:
    """key, class_id, links of every row with words: the smallest key of its class, and to how many other texts it is linked."""
    from .components import components

    reps, member = classes_of_sets(df, key, words, k)
    pairs = cut(similar_reps(reps, least))
    label = components(pairs, "key_a", "key_b")
    ends = pairs.select(F.col("key_a").alias("rep")).unionByName(pairs.select(F.col("key_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    met = member.join(label.withColumnsRenamed({"node": "rep"}), "rep", "left").join(ends, "rep", "left")
    return met.select(F.col("key").alias(key), F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
