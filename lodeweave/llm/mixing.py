"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Blocks of tokens the whole mix is apportioned in, at least; more where a shard would hold fewer than a hundred.
BLOCKS = 10_000
#: Documents of a shard, about.
SHARD_ROWS = 200_000
#: Divisors tried at once when the quotas of shards are sought, and how often.
TRIED, SEARCHES = 64, 9
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(path: str = VOCABULARY):
    """A UDF that counts tokens of a public byte-level BPE; the file at path is read on each worker once."""
    held: dict = {}

    def count(text: pd.Series) -> pd.Series:
        if "e" not in held:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            held["e"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = held["e"].encode_ordinary
        return text.map(lambda x: len(encode(x)), na_action="ignore").fillna(0).astype("int64")

    return F.pandas_udf(count, "bigint")


def apportion(weights: dict[str, Fraction], caps: dict[str, int], seats: int) -> dict[str, int]:
    """Seats by highest quotients weight / (2 n + 1), each party at most its cap; ties by name.

    A party has round(weight / d) seats when all quotients of d / 2 and more are served; the search begins at such a
    divisor that serves no more than there are, so the rounds don't grow with the seats.
    """
    parties = [s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0]
    served = lambda d: {s: min(caps[s], int(weights[s] / d + Fraction(1, 2))) for s in parties}
    got = dict.fromkeys(weights, 0)
    if parties and seats > 0:
        low, high = Fraction(0), sum(weights[s] for s in parties) * 2
        for _ in range(64):
            d = (low + high) / 2
            low, high = (d, high) if sum(served(d).values()) > seats else (low, d)
        got |= served(high)
    heap = [(-weights[s] / (2 * got[s] + 1), s) for s in parties if got[s] < caps[s]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        if not heap:
            break
        _, s = heapq.heappop(heap)
        got[s] += 1
        if got[s] < caps[s]:
            heapq.heappush(heap, (-weights[s] / (2 * got[s] + 1), s))
    return got


def largest(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> int:
    """Tokens of the largest mix whose shares hold under the caps.

    A source that can't fill its share bounds the whole: min over sources of tokens * max_repeats / share. A source
    without tokens is left out, and so bounds nothing.
    """
    held = {s: sizes.get(s, 0) * max(0, r or 0) for s, w, r in targets if w and w > 0}
    return int(min((Fraction(t) / Fraction(str(w)) for s, w, _ in targets if w and w > 0 and (t := held[s]) > 0), default=0))


def shard_quotas(shards: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """source, shard, quota: of each source's wanted blocks an integer quota for each shard, by highest quotients.

    shards: source, shard, blocks. No shard gets more than its blocks; where fewer are wanted than a source has, all are
    given out. The divisor that serves about so many is sought by sums over all shards; only those sums, one row a source
    and divisor tried, reach the driver. What is then left, less than a block a shard, goes to the next quotients, ties
    by shard: an order over one row a shard.
    """
    spark = shards.sparkSession
    served = lambda d: F.least(F.col("blocks"), F.floor(F.col("blocks") / d + 0.5)).cast("bigint")
    low, high = {s: 0.0 for s in wanted}, {r["source"]: 2.0 * r["most"] + 1 for r in shards.groupBy("source").agg(F.max("blocks").alias("most")).collect()}
    for _ in range(SEARCHES):
        tried = [(s, low[s] + (high[s] - low[s]) * k / TRIED) for s in wanted if s in high and low[s] < high[s] for k in range(1, TRIED + 1)]
        if not tried:
            break
        exact = {}
        ds = F.broadcast(spark.createDataFrame(tried, "source string, d double"))  # TRIED rows a source
        for r in shards.join(ds, "source").groupBy("source", "d").agg(F.sum(served(F.col("d"))).alias("n")).collect():
            if r["n"] > wanted[r["source"]]:
                low[r["source"]] = max(low[r["source"]], r["d"])
            elif r["n"] == wanted[r["source"]]:
                exact[r["source"]] = r["d"]
        high = {s: min([d for t, d in tried if t == s and d > low[s]], default=high[s]) for s in wanted if s in high} | exact
        low |= exact
    ds = F.broadcast(spark.createDataFrame([(s, d, wanted[s]) for s, d in high.items() if s in wanted], "source string, d double, wanted bigint"))
    first = shards.join(ds, "source").withColumn("quota", served(F.col("d")))
    left = F.col("wanted") - F.sum("quota").over(Window.partitionBy("source"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.when(F.col("quota") < F.col("blocks"), -F.col("blocks") / (2 * F.col("quota") + 1)).otherwise(0), "shard"))
    more = (F.col("quota") < F.col("blocks")) & (nth <= left)
    return first.select("source", "shard", "blocks", (F.col("quota") + more.cast("int")).alias("quota"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = VOCABULARY, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, shard, block, n_tokens, copies: the documents chosen, each with how often it is repeated.

    Targets are a few rows (source, target_share, max_repeats) and are read by the driver. Documents of a source not
    listed, of a null source and without text are left out. The mix is a number of equal-token blocks, of which each
    source gets its quota; whole rounds repeat all its blocks, and of the last round each shard gives its own quota. In
    a shard documents stand in seeded order, each in the block that holds its middle, and the first blocks are taken; no
    source is sorted in one task, nor is anything read by the driver but a row a source.
    """
    counted = documents.select("doc_id", "source", token_counter(path)("text").alias("n_tokens")).filter("n_tokens > 0")
    goals = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    counted = counted.filter(F.col("source").isin([s for s, _, _ in goals]))
    counted = cut(counted.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")))
    held = {r["source"]: r for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    every, total = sum(r["n"] for r in held.values()), largest({s: r["t"] for s, r in held.items()}, goals)
    block = max(1, min(total // blocks, sum(r["t"] for r in held.values()) * shard_rows // (100 * max(1, every))))
    counted = counted.withColumn("shard", F.pmod("_order", F.lit(every // shard_rows + 1)).cast("int"))
    whole = F.greatest(F.lit(1), F.round(F.col("t") / F.lit(block))).cast("bigint")
    sizes = cut(counted.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).withColumn("blocks", whole))
    supply = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
    weights = {s: Fraction(str(w)) for s, w, _ in goals if w and w > 0 and supply.get(s)}
    seats = apportion(weights, {s: supply[s] * max(0, r or 0) for s, _, r in goals if s in weights}, total // block)
    quota = shard_quotas(sizes.select("source", "shard", "blocks"), {s: n % supply[s] for s, n in seats.items()})
    rounds = documents.sparkSession.createDataFrame([(s, n // supply[s]) for s, n in seats.items()], "source string, rounds bigint")
    q = quota.join(sizes.select("source", "shard", "t"), ["source", "shard"]).join(F.broadcast(rounds), "source")  # a row a source
    w = Window.partitionBy("source", "shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = counted.join(q, ["source", "shard"]).withColumn("_middle", F.sum("n_tokens").over(w) - F.col("n_tokens") / 2)
    run = run.withColumn("block", F.least(F.col("blocks") - 1, F.floor(F.col("_middle") * F.col("blocks") / F.col("t"))))
    chosen = run.withColumn("copies", (F.col("rounds") + (F.col("block") < F.col("quota")).cast("int")).cast("bigint")).filter("copies > 0")
    return chosen.select("doc_id", "source", "shard", "block", "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each listed source with its target and actual share of the mix."""
    n = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"), F.count("*").alias("documents"))
    out = targets.select("source", "target_share", "max_repeats").join(n, "source", "left").withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # a row a source
    return out.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("_all"), 6).alias("actual_share"))
