"""Dates, numbers, units, loudness and picture measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a unit; K alone is binary, KB decimal.
UNITS = {"": 1, "b": 1, "k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1024, "mib": 1024**2, "gib": 1024**3, "tib": 1024**4}
DURATIONS_MS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def _table(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])


def size_bytes(c: Column) -> Column:
    """'32 GiB' as bytes, rounded; null where it is no size."""
    n, unit = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 1), F.lower(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 2))
    return F.when(n != "", F.round(n.try_cast("double") * _table(UNITS)[unit]).cast("bigint"))


def duration_ms(c: Column) -> Column:
    """'90 s' or '2h' as milliseconds; null where it is none."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*$"
    n, unit = F.regexp_extract(c, pattern, 1), F.lower(F.regexp_extract(c, pattern, 2))
    return F.when(n != "", F.round(n.try_cast("double") * _table(DURATIONS_MS)[unit]).cast("bigint"))


def iso_date(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD, anything else as it is."""
    return F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def partial_date(c: Column) -> Column:
    """A calendar-checked YYYY[-MM[-DD]] of YYYYMMDD, YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY or YYYY-MM; null where it is none."""
    t = F.regexp_replace(iso_date(F.trim(c)), "/", "-")
    t = F.regexp_replace(t, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(t.try_cast("date"), "yyyy-MM-dd"))
    month = F.when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), t)
    return F.coalesce(day, month, F.when(t.rlike(r"^\d{4}$"), t))


def date_key(c: Column) -> Column:
    """Sorts stated dates before none, then by year, then the fuller text, then the text."""
    return F.struct(c.isNull().alias("none"), F.substring(c, 1, 4).alias("year"), (-F.length(c)).alias("full"), c.alias("date"))


def clock_text(ms: Column) -> Column:
    """m:ss of milliseconds."""
    s = F.floor(ms / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def duration_text(ms: Column) -> Column:
    """The two largest of days, hours, minutes and seconds."""
    s = F.floor(ms / 1000)
    d, h, m, r = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f" {x} "), b.cast("string"), F.lit(f" {y}"))
    return F.when(d > 0, two(d, "d", h, "h")).when(h > 0, two(h, "h", m, "min")).otherwise(two(m, "min", r, "s"))


def stream_bytes(kbps: Column, seconds: Column) -> Column:
    return F.floor(kbps * 1000 / 8 * seconds).cast("bigint")


def ppm_ratio(ppm: Column) -> Column:
    return 1 + ppm / 1_000_000


def blocks(n: Column, block: int) -> Column:
    """Bytes rounded up to whole blocks."""
    return (F.ceil(n / block) * block).cast("bigint")


def step_bucket(x: Column, step: float) -> Column:
    return F.floor(x / step).cast("bigint")


def log_bucket(x: Column, step: float) -> Column:
    return F.floor(F.log(x) / F.log1p(F.lit(step))).cast("bigint")


def capped_bucket(x: Column, step: float, cap: int = 10) -> Column:
    return F.least(F.floor(x / step), F.lit(cap)).cast("bigint")


def cutoffs_reached(x: Column, cutoffs: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: x >= c)).cast("bigint")


def log_interpolated(x: Column, table: list[tuple[float, float]]) -> Column:
    """Value between the rows of a table (ascending) by straight lines in ln x; flat outside."""
    table = sorted(table)
    out = F.when(x <= table[0][0], F.lit(table[0][1]))
    for (a, u), (b, v) in zip(table, table[1:], strict=False):
        out = out.when(x <= b, u + (v - u) * (F.log(x) - F.log(F.lit(a))) / (F.log(F.lit(b)) - F.log(F.lit(a))))
    return out.otherwise(table[-1][1])


def gain_cdb(c: Column) -> Column:
    """'-7.52 dB' in hundredths of a dB; null where it is none."""
    n = F.regexp_extract(c, r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:dB)?\s*$", 1)
    return F.when(n != "", F.round(n.try_cast("double") * 100).cast("int"))


def gain_text(cdb: Column) -> Column:
    sign = F.when(cdb < 0, "-").otherwise("+")
    return F.concat(sign, F.floor(F.abs(cdb) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cdb) % 100).cast("string"), 2, "0"), F.lit(" dB"))


def capped_gain(wanted_cdb: Column, peak: Column, ceiling_db: float = -1.0) -> Column:
    """A raising gain no higher than the peak allows under the ceiling; a lowering one as it is."""
    room = F.floor((ceiling_db - 20 * F.log10(peak)) * 100).cast("int")
    return F.when(wanted_cdb > 0, F.greatest(F.least(wanted_cdb, room), F.lit(0))).otherwise(wanted_cdb).cast("int")


def q8(cdb: Column) -> Column:
    """Hundredths of a dB as 256ths."""
    return F.round(cdb * 256 / 100).cast("int")


def backoff_s(failures: Column) -> Column:
    """Wait after so many failures: an hour, doubled each time, a week at most."""
    return F.least(F.lit(3600) * F.pow(F.lit(2), F.least(F.greatest(failures, F.lit(1)) - 1, F.lit(16))), F.lit(604800)).cast("bigint")


def recheck_s(unchanged: Column, recheck: int) -> Column:
    """Wait before a short find is asked again: doubled for each find unchanged, to 90 days or the recheck if longer."""
    return F.least(F.lit(recheck) * F.pow(F.lit(2), F.least(unchanged, F.lit(16))), F.lit(max(90 * 86400, recheck))).cast("bigint")


def stated_confidence(gap_ms: Column) -> Column:
    return F.greatest(F.lit(0.9) * (1 - gap_ms / 4000), F.lit(0.0))


def length_close(a: Column, b: Column, slack_ms: int) -> Column:
    """Both lengths stated and within the slack; false where one is missing."""
    return F.coalesce(F.abs(a - b) <= slack_ms, F.lit(False))


def length_class(a: Column, b: Column) -> Column:
    """0 within three seconds, 1 further, 2 where one is missing."""
    return F.when(F.abs(a - b) <= 3000, 0).when(a.isNotNull() & b.isNotNull(), 1).otherwise(2)


def near_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def alike_look(dct: Column, diff: Column) -> Column:
    """Pictures of one design by distance of their two hashes."""
    return F.when((dct <= 6) & (diff <= 20), True).when((dct <= 10) & (diff <= 10), True).when((dct >= 24) | (diff >= 24), False)


def quality_flags(width: Column, effective: Column, padded: Column) -> Column:
    return F.array_compact(F.array(F.when(effective < width * 0.9, F.lit("upsampled")), F.when(padded, F.lit("padded"))))


def is_banner(width: Column, height: Column) -> Column:
    return F.greatest(width, height) > 2 * F.least(width, height)


def magic_kind(content: Column) -> Column:
    """Media type of a picture by its first bytes, null where unknown."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("47494638"), "image/gif").when(h.rlike("^52494646.{8}57454250"), "image/webp")
