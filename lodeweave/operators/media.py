"""Measures of pictures and sound that are decoded already, and checks of stated lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import perceptual_hashes


def integrity(stated_ms: Column, decoded_ms: Column, outside_ms: Column) -> Column:
    """cut where much less is decoded than stated, padded where much lies outside the song, whole else; null where a length is missing."""
    return F.when(stated_ms.isNull() | decoded_ms.isNull(), None).when(decoded_ms < 0.98 * stated_ms - 1000, "cut").when(F.coalesce(outside_ms, F.lit(0)) > 5000, "padded").otherwise("whole")


def chapters_within(chapters: Column, length_ms: Column) -> Column:
    """Chapters (start, end, title) that begin within the length, their ends cut to it."""
    kept = F.filter(chapters, lambda c: c["start"] < length_ms)
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.least(c["end"], length_ms).alias("end"), c["title"].alias("title")))


def packet_bytes(dump: Column) -> Column:
    """Sum of the sizes listed one a line; lines that are no number count nothing."""
    return F.aggregate(F.transform(F.split(dump, r"\s+"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0))), F.lit(0).cast("bigint"), lambda a, b: a + b)


def carried_bandwidth(codec: Column, hz: Column) -> Column:
    return F.when(codec == "he-aac", F.least(hz, F.lit(11025.0))).otherwise(hz)


def fill_allowance(codec: Column) -> Column:
    return F.when(codec.isin("mp3", "aac", "he-aac"), 500.0).when(codec.isin("opus", "vorbis"), 1000.0).otherwise(0.0)


def sound_quality(samples: np.ndarray, rate: int) -> tuple[float, float]:
    """Hz up to which sound is carried, and the share of samples at full scale."""
    n = min(len(samples), 1 << 15)
    if n < 64:
        return 0.0, 0.0
    # Windows over all samples, the last one ending with them.
    starts = sorted({*range(0, len(samples) - n + 1, n), len(samples) - n})
    power = sum(np.abs(np.fft.rfft(samples[i : i + n] * np.hanning(n))) ** 2 for i in starts)
    total = np.cumsum(power) / max(power.sum(), 1e-30)
    top = int(np.searchsorted(total, 0.999))
    return float(top * rate / n), float((np.abs(samples) >= 0.9999).mean())


def sound_measures(df: DataFrame, key: str, samples: str, rate: str) -> DataFrame:
    """key, bandwidth_hz, clipping of decoded samples (array<double>)."""

    def batches(it):
        for b in it:
            rows = [(k, *sound_quality(np.asarray(x, float), int(r))) for k, x, r in zip(b[key], b[samples], b[rate], strict=True) if x is not None]
            yield pd.DataFrame(rows, columns=[key, "bandwidth_hz", "clipping"])

    return df.select(key, samples, rate).mapInPandas(batches, f"{key} {df.schema[key].dataType.simpleString()}, bandwidth_hz double, clipping double")


def picture_measures(df: DataFrame, key: str, pixels: str, width: str) -> DataFrame:
    """key, dct, diff, flat of decoded gray pixels (array<int>, row by row)."""

    def batches(it):
        for b in it:
            rows = []
            for k, p, w in zip(b[key], b[pixels], b[width], strict=True):
                if p is None or not w or len(p) < w * 8:
                    continue
                g = np.asarray(p, float)[: len(p) // int(w) * int(w)].reshape(-1, int(w))
                rows.append((k, *perceptual_hashes(g), bool(g.std() < 2)))
            yield pd.DataFrame(rows, columns=[key, "dct", "diff", "flat"])

    return df.select(key, pixels, width).mapInPandas(batches, f"{key} {df.schema[key].dataType.simpleString()}, dct bigint, diff bigint, flat boolean")


def outside_ms(frames: DataFrame, group: str, at: str, level: str, start: Column, end: Column, floor_db: float, frame_ms: int) -> DataFrame:
    """group, outside: audible time before and after the stretch shared."""
    loud = frames.filter((F.col(level) > floor_db) & ((F.col(at) < start) | (F.col(at) >= end)))
    return loud.groupBy(group).agg((F.count("*") * frame_ms).alias("outside"))
