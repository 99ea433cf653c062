"""Evaluation texts that leak into training text: spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.joins import once
from ..session import cut

#: Positions (1: compared, 0: ignored) of the seeds. Any run of 18 words or more of which at most one in twelve is
#: replaced holds a hit of one of them (the tests go through all cases).
MASKS = ("11111111", "1110110110111")
LEAST, ONE_IN = 18, 12
#: A test set of at most so many seed hashes is broadcast; a larger one is joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Parts that the rows of a seed are split in where they are shuffled.
SALTS = 8
_STAMP = r"\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\]"


def leak_words(c: Column) -> Column:
    """Words of a text, line marks (time stamps of lyrics) aside. Null and empty texts have none."""
    return F.coalesce(words(F.regexp_replace(c, _STAMP, " ")), F.array().cast("array<string>"))


def seeds(tokens: Column, mask: str, k: int) -> Column:
    """Struct of position and hash at each place where the mask fits."""
    span, at = len(mask), [i for i, x in enumerate(mask) if x == "1"]
    last = F.size(tokens) - span
    one = lambda i: F.struct(i.cast("int").alias("pos"), F.xxhash64(F.lit(k), *[F.get(tokens, i + p) for p in at]).alias("seed"))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))


def _long(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words, and a seed of the text: a row for each seed. Texts of fewer than LEAST words have none."""
    # once(): a seed looks at many words, which are made once a text and not once a seed.
    every = lambda w: F.struct(w.alias("w"), F.when(F.size(w) >= LEAST, F.concat(*[seeds(w, m, k) for k, m in enumerate(MASKS)])).alias("s"))
    return df.select(F.col(key), once(leak_words(F.col(text)), every).alias("t")).select(key, F.col("t.w").alias("w"), F.explode("t.s").alias("s"))


def _overlaps(doc: pd.Series, item: pd.Series, shift: pd.Series) -> pd.Series:
    """Whether the words of a document agree with the item they lie under for 18 words or more of which one in twelve may differ.

    A shift below 0: the document begins so many words within the item.
    """
    out = []
    for d, i, s in zip(doc, item, shift, strict=True):
        lo = max(0, -s)
        n = min(len(i) - lo, len(d))
        if n < LEAST:
            out.append(False)
            continue
        same = np.asarray(d[:n], dtype=object) == np.asarray(i[lo : lo + n], dtype=object)
        sums = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - ONE_IN))])
        out.append(bool((sums[LEAST:] >= np.minimum.accumulate(sums)[: len(sums) - LEAST]).any()))
    return pd.Series(out)


def _under(words_: Column, shift: Column, n: Column) -> Column:
    """The words of a document that lie under an item of n words at the shift."""
    return F.slice(words_, F.greatest(F.lit(0), shift) + 1, F.greatest(F.lit(0), F.least(F.size(words_), shift + n) - F.greatest(F.lit(0), shift)))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id: the document holds a passage of the item.

    A null text, or one with fewer than 18 words, holds nothing. A document or item stored twice is reported under each
    of its numbers. The test set is broadcast only where its hashes are counted and few; then seeds and texts of the
    documents aren't shuffled, and a hit brings along the words that lie under the item. Else seeds are shuffled, equal
    seeds of many documents being split by their document, and only documents with a hit are laid over items. A passage
    that is common to many documents costs a row for each. Empty input gives no rows.
    """
    test = _long(items.select(F.col(item_id), F.col("text")), item_id, "text")
    small = test.select(F.col("s.seed").alias("seed"), F.col(item_id), F.col("s.pos").alias("at"), F.size("w").alias("n")).dropDuplicates(["seed", item_id, "at"])
    train = _long(documents.select(F.col(doc_id), F.col("text")), doc_id, "text")
    i = items.select(item_id, leak_words(F.col("text")).alias("item")).dropDuplicates([item_id])
    shift = (F.col("pos") - F.col("at")).alias("shift")
    if small.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        met = train.select(doc_id, "w", F.col("s.seed").alias("seed"), F.col("s.pos").alias("pos")).join(F.broadcast(small), "seed").select(doc_id, item_id, shift, "w", "n")
        hits = met.select(doc_id, item_id, "shift", _under(F.col("w"), F.col("shift"), F.col("n")).alias("doc")).dropDuplicates([doc_id, item_id, "shift"])
        near = hits.join(F.broadcast(i), item_id)
    else:
        salt = F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).alias("salt")
        few = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = train.select(doc_id, F.col("s.seed").alias("seed"), F.col("s.pos").alias("pos"), salt).join(few, ["seed", "salt"])
        hits = cut(met.select(doc_id, item_id, shift, "n").dropDuplicates([doc_id, item_id, "shift"]))
        held = documents.join(hits.select(doc_id).dropDuplicates(), doc_id, "left_semi").select(doc_id, leak_words(F.col("text")).alias("w")).dropDuplicates([doc_id])
        near = hits.join(held, doc_id).withColumn("doc", _under(F.col("w"), F.col("shift"), F.col("n"))).join(i, item_id)
    return near.filter(F.pandas_udf(_overlaps, "boolean")("doc", "item", "shift")).select(doc_id, item_id).dropDuplicates()


def item_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Each test item with the number of documents that hold it."""
    n = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
