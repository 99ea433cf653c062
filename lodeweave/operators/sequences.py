"""Runs, offsets, budgets and timed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, key: list[str], order: list, same: Column, least: int) -> DataFrame:
    """df with run (number), run_length and masked (a run of so many rows or more); same: the row goes on with the last."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return numbered.withColumn("run_length", F.count("*").over(Window.partitionBy(*key, "run"))).withColumn("masked", F.col("run_length") >= least)


def budget_prefix(df: DataFrame, key: list[str], order: list, cost: str, most: Column) -> DataFrame:
    """Rows kept from the start while the running cost fits; always fewer than all."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = df.withColumn("_s", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return run.filter((F.col("_s") <= most) & (F.col("_i") < F.col("_n"))).drop("_s", "_i", "_n")


def latest(df: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """The row of each key with the greatest values of at (a total order), by partial maximum."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(a).alias(f"_a{i}") for i, a in enumerate(at)])).alias("_m")).select(*key, "_m.*")


def stamp_ms(text: Column) -> Column:
    """mm:ss.xx as milliseconds, with one to three fraction digits; null where seconds pass 59."""
    p = r"^(\d{1,3}):([0-5]\d)(?:[.:](\d{1,3}))?$"
    part = lambda i: F.regexp_extract(text, p, i)
    return F.when(part(1) != "", part(1).cast("bigint") * 60000 + part(2).cast("bigint") * 1000 + F.coalesce(F.rpad(F.nullif(part(3), F.lit("")), 3, "0").cast("bigint"), F.lit(0)))


def timed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), ms (null where untimed), words; a line with several stamps comes once for each."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw"))
    opened = F.regexp_extract("raw", r"^((?:\s*\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\])+)", 1)
    stamps = F.regexp_extract_all(opened, F.lit(r"\[(\d{1,3}:\d{2}(?:[.:]\d{1,3})?)\]"), 1)
    cut = lines.select(key, (F.col("line") + 1).alias("line"), stamps.alias("stamps"), F.trim(F.regexp_replace("raw", r"^(?:\s*\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\])+", "")).alias("words"))
    return cut.select(key, "line", F.explode_outer("stamps").alias("stamp"), "words").select(key, "line", stamp_ms(F.col("stamp")).alias("ms"), "words")


def timing(lines: DataFrame, key: str) -> DataFrame:
    """Timed lines that sing, the first and the last ms."""
    return lines.filter("ms IS NOT NULL AND words != ''").groupBy(key).agg(F.count("*").alias("lines"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def shifted(lines: DataFrame, key: str, offset_ms: int, stretch_ppm: int) -> DataFrame:
    """Lines moved and stretched; of those before zero only the last stays, at zero, as it is still sung."""
    moved = lines.filter("ms IS NOT NULL").withColumn("ms", F.round(F.col("ms") * (1 + stretch_ppm / 1_000_000) + offset_ms).cast("bigint"))
    before = moved.filter("ms < 0").groupBy(key).agg(F.max(F.struct("ms", "line", "words")).alias("m")).select(key, F.col("m.line").alias("line"), F.lit(0).cast("bigint").alias("ms"), F.col("m.words").alias("words"))
    return moved.filter("ms >= 0").select(key, "line", "ms", "words").unionByName(before)


def until(lines: DataFrame, end_ms: Column, slack_ms: int = 2000) -> DataFrame:
    """Lines no later than the end and a little more; untimed lines stay."""
    return lines.filter(F.col("ms").isNull() | (F.col("ms") <= end_ms + slack_ms))


def ordered(lines: DataFrame, key: str) -> DataFrame:
    """Timed lines sorted into the timed places; untimed lines keep theirs."""
    timed = lines.filter("ms IS NOT NULL")
    by_place = timed.select(key, "line", F.row_number().over(Window.partitionBy(key).orderBy("line", "ms")).alias("i"))
    by_time = timed.select(key, "ms", "words", F.row_number().over(Window.partitionBy(key).orderBy("ms", "line")).alias("i"))
    return by_place.join(by_time, [key, "i"]).select(key, "line", "ms", "words").unionByName(lines.filter("ms IS NULL").select(key, "line", "ms", "words"))


#: Fixed value: how soon (ms) a line may follow itself and be another frame of one subtitle.
FRAME_MS = 250


def merged_frames(lines: DataFrame, key: str, gap_ms: int = FRAME_MS) -> DataFrame:
    """Timed lines without those written again: in the subtitle (the lines of one time) that starts under gap_ms after it, or twice at one time.

    A time without words goes where another ends the line already, where the next words are gone, or where words start at it.
    """
    timed, worded = lines.filter("ms IS NOT NULL"), F.col("words") != ""
    by_time = Window.partitionBy(key).orderBy("ms")
    groups = timed.filter(worded).groupBy(key, "ms").agg(F.collect_set("words").alias("_ws"))
    groups = groups.select(key, "ms", F.when(F.col("ms") - F.lag("ms").over(by_time) < gap_ms, F.lag("_ws").over(by_time)).alias("_was"))
    twice = F.row_number().over(Window.partitionBy(key, "ms", "words").orderBy("line")) > 1
    marked = timed.join(groups, [key, "ms"], "left").withColumn("_gone", worded & (F.coalesce(F.array_contains("_was", F.col("words")), F.lit(False)) | twice))
    by_line = Window.partitionBy(key).orderBy("line", "ms")
    after = F.first(F.when(worded, F.col("_gone")), ignorenulls=True).over(by_line.rowsBetween(1, Window.unboundedFollowing))
    kept = marked.withColumn("_after", F.coalesce(after, F.lit(False))).filter("NOT _gone")
    at = F.when(worded, F.col("ms"))
    near = lambda c: F.coalesce(c == F.col("ms"), F.lit(False))
    drop = ~worded & (F.col("_after") | F.coalesce(F.lag("words").over(by_line) == "", F.lit(False)) | near(F.lag(at).over(by_line)) | near(F.lead(at).over(by_line)))
    return kept.withColumn("_drop", drop).filter("NOT _drop").drop("_was", "_gone", "_after", "_drop")


def typed_out(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Runs of lines that each extend the last become their last line."""
    w = Window.partitionBy(key).orderBy("ms", "line")
    goes_on = F.col("words").startswith(F.lag("words").over(w)) & (F.lag("words").over(w) != "") & (F.length("words") > F.length(F.lag("words").over(w)))
    r = runs(lines.filter("ms IS NOT NULL"), [key], ["ms", "line"], goes_on, least)
    last = F.row_number().over(Window.partitionBy(key, "run").orderBy(F.desc("ms"), F.desc("line")))
    return r.withColumn("_l", last).filter("NOT masked OR _l = 1").drop("run", "run_length", "masked", "_l")


def wrapped(lines: DataFrame, key: str) -> DataFrame:
    """Lines wrapped in two or more at one time, joined: the first opens in capitals, none but the last closes a sentence, the others open in small letters.

    Only neighbours of one stamp each are joined; two lines of one time that each open a sentence stay two.
    """
    opens = F.regexp_extract("words", r"\p{L}", 0)
    w = Window.partitionBy(key).orderBy("line", "ms")
    one = F.count("*").over(Window.partitionBy(key, "line")) == 1
    marked = lines.withColumn("_one", one)
    same = (F.lag("ms").over(w) == F.col("ms")) & F.col("_one") & F.lag("_one").over(w)
    goes_on = same & opens.rlike(r"^\p{Ll}") & ~F.lag(F.trim("words")).over(w).rlike("[.!?…。！？\"”)]$") & (F.lag(F.trim("words")).over(w) != "")
    marked = marked.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.first(opens.rlike(r"^\p{Lu}")).over(Window.partitionBy(key, "_run").orderBy("line", "ms"))
    marked = marked.withColumn("_part", F.when(head, F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(key, "_run").orderBy("line", "ms"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "ms", "words"))), lambda x: F.trim(x["words"])), " ")
    joined = marked.groupBy(key, "_run", "_part").agg(F.min("line").alias("line"), F.first("ms").alias("ms"), F.count("*").alias("_n"), F.first("words").alias("_one"), whole.alias("_whole"))
    return joined.select(key, "line", "ms", F.when(F.col("_n") > 1, F.col("_whole")).otherwise(F.col("_one")).alias("words"))


def coverage_tenths(first: Column, last: Column, duration_ms: Column) -> Column:
    return F.floor((last - first) / duration_ms * 10).cast("bigint")


def halves(word: Column) -> Column:
    """The high half of a 32-bit word, and its low half marked by bit 16."""
    return F.array(F.shiftright(word, 16).bitwiseAND(F.lit(0xFFFF)), word.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(0x10000)))


def prints_long(df: DataFrame, key: str, words: str, still: int = 8) -> DataFrame:
    """key, pos, word, sounding: runs of eight words or more, each within a bit of the last, are silent."""
    long = df.select(key, F.posexplode(words).alias("pos", "word"))
    prev = F.lag("word").over(Window.partitionBy(key).orderBy("pos"))
    r = runs(long, [key], ["pos"], F.bit_count(F.col("word").bitwiseXOR(prev)) <= 1, still)
    return r.select(key, "pos", "word", (~F.col("masked")).alias("sounding"))


def print_matches(prints: DataFrame, key: str, pairs: DataFrame, a: str, b: str, stop: int = 32, tries: int = 8, bits: int = 4) -> DataFrame:
    """a, b, offset, agreeing, share, coverage, verdict of pairs of fingerprints.

    prints: prints_long(). Equal half-words of sounding places vote for an offset, those of a print seen more than 32 times
    aside; of the eight offsets with most votes the one with most near words counts, of equal ones the greatest.
    """
    sounding = prints.filter("sounding")
    half = sounding.select(key, "pos", F.explode(halves(F.col("word"))).alias("half"))
    seldom = half.groupBy(key, "half").agg(F.count("*").alias("n")).filter(F.col("n") <= stop).select(key, "half")
    half = half.join(seldom, [key, "half"], "left_semi")
    x = half.select(F.col(key).alias(a), "half", F.col("pos").alias("i"))
    y = half.select(F.col(key).alias(b), "half", F.col("pos").alias("j"))
    votes = pairs.join(x, a).join(y.hint("merge"), [b, "half"]).groupBy(a, b, (F.col("i") - F.col("j")).alias("offset")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(a, b).orderBy(F.desc("votes"), "offset")
    few = votes.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= tries)
    p = sounding.select(F.col(key).alias(a), F.col("pos").alias("i"), F.col("word").alias("u"))
    q = sounding.select(F.col(key).alias(b), F.col("pos").alias("j"), F.col("word").alias("v"))
    laid = few.join(p, a).withColumn("j", F.col("i") - F.col("offset")).join(q, [b, "j"])
    near = laid.groupBy(a, b, "offset").agg(F.count_if(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).alias("agreeing"), F.count("*").alias("overlap"))
    best = near.groupBy(a, b).agg(F.max(F.struct("agreeing", "offset", "overlap")).alias("m")).select(a, b, "m.*")
    size = prints.groupBy(key).agg(F.count_if("sounding").alias("s"), F.count("*").alias("n"))
    met = best.join(size.select(F.col(key).alias(a), F.col("s").alias("sa"), F.col("n").alias("na")), a).join(size.select(F.col(key).alias(b), F.col("s").alias("sb"), F.col("n").alias("nb")), b)
    share = F.col("agreeing") / F.least("sa", "sb")
    cover = F.col("overlap") / F.greatest("na", "nb")
    out = met.select(a, b, "offset", "agreeing", F.round(share, 6).alias("share"), F.round(cover, 6).alias("coverage"))
    return out.withColumn("verdict", print_verdict(F.col("agreeing"), F.col("share"), F.col("coverage")))


def print_verdict(n: Column, share: Column, cover: Column) -> Column:
    """same, unsure or different."""
    return (
        F.when((n >= 48) & (share >= 0.3) & (cover >= 0.8), "same")
        .when((n < 48) & (n >= 8) & (cover >= 0.8) & (share >= 0.5), "same")
        .when((n < 48) & (n >= 8) & (cover >= 0.8) & (share >= 0.3), "unsure")
        .when((n >= 48) & ((share >= 0.3) | ((share >= 0.1) & (cover >= 0.8))), "unsure")
        .otherwise("different")
    )


def histogram(df: DataFrame, key: list[str], x: str, low: float, step: float) -> DataFrame:
    """key, bin, n: counts in steps from low; values below low are left out."""
    return df.filter(F.col(x) >= low).groupBy(*key, F.floor((F.col(x) - low) / step).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def gated_level(hist: DataFrame, key: list[str], low: float = -70.0, step: float = 0.1) -> DataFrame:
    """key, level: energy mean over bin centres, a gate 10 below it, the mean again; pooled over all rows of a key."""
    centre = low + (F.col("bin") + 0.5) * step
    energy = F.pow(F.lit(10.0), (centre + 0.691) / 10)
    e = hist.withColumn("_e", energy)
    mean = e.groupBy(*key).agg((F.sum(F.col("n") * F.col("_e")) / F.sum("n")).alias("_mean"))
    gate = e.join(mean, key).filter(F.col("_e") >= F.col("_mean") / 10)
    return gate.groupBy(*key).agg((-0.691 + 10 * F.log10(F.sum(F.col("n") * F.col("_e")) / F.sum("n"))).alias("level"))


def peak_bin(hist: DataFrame, key: list[str], share: float = 0.001) -> DataFrame:
    """key, bin: the bin reached when the highest are summed downward until they hold the share of all, rounded up."""
    w = Window.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("_s", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*key)))
    return run.filter(F.col("_s") >= F.ceil(F.col("_all") * share)).groupBy(*key).agg(F.max("bin").alias("bin"))


def line_fit(windows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, slope: the median of the slopes between all pairs of a few windows."""
    a, b = windows.select(key, F.col(x).alias("xa"), F.col(y).alias("ya")), windows.select(key, F.col(x).alias("xb"), F.col(y).alias("yb"))
    return a.join(b, key).filter("xa < xb").groupBy(key).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"))
