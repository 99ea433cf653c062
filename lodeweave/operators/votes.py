"""Ranking, votes and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_score(measures: list[tuple[int, Column]]) -> tuple[Column, Column]:
    """Count of missing measures and the weighted sum of the others; a weight of 0 counts neither way."""
    used = [(w, m) for w, m in measures if w]
    unknown = reduce(lambda a, b: a + b, [m.isNull().cast("bigint") for _, m in used], F.lit(0).cast("bigint"))
    total = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0)).cast("bigint") * w for w, m in used], F.lit(0).cast("bigint"))
    return unknown, total


def argmin(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order, by partial minimum: no group is sorted or gathered."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_m")).select(*key, "_m.*")


def bounded(value: Column, clean: Column, key: list[str]) -> Column:
    """A value that isn't clean counts no more than the least clean one of its group."""
    least = F.min(F.when(clean, value)).over(Window.partitionBy(*key))
    return F.when(clean | least.isNull(), value).otherwise(F.least(value, least))


def casing(c: Column) -> tuple[Column, Column]:
    """Words that open with a capital, and capitals in all."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))).cast("bigint"), F.regexp_count(c, F.lit(r"\p{Lu}")).cast("bigint")


def majority(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most common value of each key; ties: more words with a capital, fewer capitals, then the text. Nulls don't vote."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("votes"))
    words, capitals = casing(F.col(value))
    return argmin(n, key, [-F.col("votes"), -words, capitals, F.col(value)]).select(*key, value, "votes")


def plurality(df: DataFrame, key: list[str], value: str, least: int = 2) -> DataFrame:
    """The leader of each key where it has so many votes and no equal; else the key is left out."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("votes"))
    top = n.groupBy(*key).agg(F.max("votes").alias("votes"))
    best = n.join(top, [*key, "votes"]).groupBy(*key, "votes").agg(F.min(value).alias(value), F.count("*").alias("_n"))
    return best.filter(F.col("_n") == 1).filter(F.col("votes") >= least).select(*key, value, "votes")


def top_votes(df: DataFrame, key: list[str], value: str, votes: str, most: int = 3) -> DataFrame:
    """At most so many values of each key, each with half the leader's votes or more; ties by value. Only positive votes count."""
    w = Window.partitionBy(*key).orderBy(F.desc(votes), value)
    ranked = df.filter(F.col(votes) > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    lead = ranked.withColumn("_lead", F.first(votes).over(w))
    return lead.filter(2 * F.col(votes) >= F.col("_lead")).select(*key, value, votes, "rank")


def contested(df: DataFrame, key: list[str], group: str, rank: list[Column]) -> DataFrame:
    """Keys whose best rank is held by more than one group, with the number of groups."""
    r = df.withColumn("_r", F.struct(*rank))
    best = r.groupBy(*key).agg(F.min("_r").alias("_b"))
    met = r.join(best, key).filter(F.col("_r") == F.col("_b"))
    return met.groupBy(*key).agg(F.count_distinct(group).alias("groups")).filter("groups > 1")


def spelled_ways(df: DataFrame, fold: Column, value: str, song: str) -> DataFrame:
    """Folded names written more than one way, with each spelling's number of songs."""
    n = df.withColumn("fold", fold).groupBy("fold", value).agg(F.count_distinct(song).alias("songs"))
    many = n.groupBy("fold").agg(F.count("*").alias("ways")).filter("ways > 1")
    return n.join(many.select("fold"), "fold")


def watermarks(df: DataFrame, group: str, value: str, album: str, title: str, albums: int = 3, titles: int = 10) -> DataFrame:
    """Values seen on so many albums and titles of one group: whoever shared them, not the work."""
    return df.groupBy(group, value).agg(F.count_distinct(album).alias("albums"), F.count_distinct(title).alias("titles")).filter((F.col("albums") >= albums) & (F.col("titles") >= titles))


# Points of each kind of evidence where it agrees and where it doesn't.
POINTS = {"identifier": (12, 0), "title": (5, -8), "credits": (3, -5), "length": (2, -3), "release": (5, 0), "unit": (4, -7)}
UNSURE_AT, OTHER_AT = -3, -10


def points(evidence: dict[str, Column]) -> Column:
    """Sum over three-valued evidence: null says nothing."""
    return reduce(lambda a, b: a + b, [F.when(e, POINTS[k][0]).when(~e, POINTS[k][1]).otherwise(0) for k, e in evidence.items()]).cast("bigint")


def verdict(evidence: dict[str, Column], total: Column) -> Column:
    """same, unsure or other."""
    no = lambda k: F.coalesce(~evidence[k], F.lit(False)) if k in evidence else F.lit(False)
    yes = lambda k: F.coalesce(evidence[k], F.lit(False)) if k in evidence else F.lit(False)
    other = (((no("title") & no("credits")) | yes("voiceless")) & ~yes("identifier")) | (total <= OTHER_AT)
    unsure = (total <= UNSURE_AT) | (no("credits") & no("release")) | (no("unit") & ~yes("release"))
    return F.when(other, "other").when(unsure, "unsure").otherwise("same")


def tally(df: DataFrame, label: str, kinds: list[str]) -> DataFrame:
    """kind and label with how often the evidence agreed, disagreed and said nothing."""
    long = df.select(label, F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("kind", "e"))
    return long.groupBy("kind", label).agg(F.count_if("e").alias("agreed"), F.count_if(~F.col("e")).alias("disagreed"), F.count_if(F.col("e").isNull()).alias("silent"))


def log_odds(same: Column, same_all: Column, other: Column, other_all: Column) -> Column:
    """2 log2 of the smoothed odds of one outcome."""
    return 2 * F.log2(((same + 1) / (same_all + 2)) / ((other + 1) / (other_all + 2)))


def suggested_points(tallies: DataFrame, label: str, least: int = 20) -> DataFrame:
    """kind with the points for agreeing and disagreeing, less silence's, rounded; kinds seen too seldom are left out."""
    s = tallies.groupBy("kind").agg(*[F.sum(F.when(F.col(label) == v, F.col(c)).otherwise(0)).alias(f"{c}_{n}") for v, n in ((True, "s"), (False, "o")) for c in ("agreed", "disagreed", "silent")])
    total = lambda n: F.col(f"agreed_{n}") + F.col(f"disagreed_{n}") + F.col(f"silent_{n}")
    odds = lambda c: log_odds(F.col(f"{c}_s"), total("s"), F.col(f"{c}_o"), total("o"))
    return s.filter((total("s") >= least) & (total("o") >= least)).select("kind", F.round(odds("agreed") - odds("silent")).cast("bigint").alias("agrees"), F.round(odds("disagreed") - odds("silent")).cast("bigint").alias("disagrees"))


def album_key(df: DataFrame, name: Column, year: str) -> DataFrame:
    """df with album_key: the name in its year; an undated row joins a year only where the name has exactly one."""
    named = df.withColumn("_name", name)
    years = named.groupBy("_name").agg(F.min(year).alias("_y"), F.max(year).alias("_z"))
    met = named.join(years, "_name", "left")
    only = F.when(F.col("_y") == F.col("_z"), F.col("_y"))
    return met.withColumn("album_key", F.when(F.col("_name").isNotNull(), F.concat_ws("|", "_name", F.coalesce(F.col(year), only).cast("string")))).drop("_name", "_y", "_z")
