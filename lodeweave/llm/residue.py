"""Template residue and error-page text: positive-unlabelled naive Bayes fitted by expectation-maximization."""

from __future__ import annotations

import re
import unicodedata
from math import exp, fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .lookalike import mapped

# Forms that are trusted to be residue: marks of template languages, filler Latin, status lines of HTTP and idioms of error
# pages. They only start the model; other kinds are learned.
STATUS = "bad request|unauthorized|forbidden|not found|method not allowed|request timeout|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout"
TRUSTED = (
    r"\$\{|\{\{|\{%|<%|<\?|%\(\w|#\{|\[\[|@@|__\w+__|^\W*\{\w*\}|^\W*&\w+;\W*$|^\W*<[\w ]*(?:artist|album|title|track|name)[\w ]*>",
    r"lorem ipsum|dolor sit amet|\bplaceholder\b",
    rf"\b(?:http|error|erreur|fehler)\W{{0,2}}\d{{3}}\b|^\W*[45]\d\d (?:{STATUS})|^\W*(?:gateway timeout|too many requests|service unavailable|internal server error)\b",
    r"\bpage not found|\brequested url\b|\btimed out\W|\baccess denied\W+\w+ \d|\bsession expired|\brequest blocked|\bsomething went wrong|\ban error occurred",
    r"javascript|\bcookies\b|\w(?:exception|error) (?:at|in) |traceback \(",
)
TRUST = "(?i)" + "|".join(TRUSTED)
#: Names that stand for no one in particular but are names by convention.
CONVENTIONAL = {"unknown artist", "various artists"}
#: The model is fitted on about so many texts at most, trusted ones and others, drawn by drawn(); every text is scored.
FIT_TRUSTED, FIT_OTHERS = 4_000, 30_000
#: Of texts that the first model holds for names, the second draws sqrt(EASY) times as many as of those it holds for residue.
EASY = 1e-4
#: How far an unlabelled text counts for residue at most while the model is fitted.
BELIEF, ROUNDS = 0.5, 30
#: Features of a text overlap (a word, its pairs and runs, and their forms), so each tells a quarter of what it would alone. SMOOTH: pseudo-count.
#: FEW: what speaks for residue counts less the fewer texts it was learned from.
OVERLAP, SMOOTH, FEW = 4.0, 0.5, 0.2
#: A field is residue from this probability on.
ACCEPT = 0.8
_SLOT = {"artist", "album", "title", "track", "name", "song", "albumtitle", "artistname", "tracktitle"}
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def _raw(text: str) -> list[str]:
    """Words, numbers and marks; look-alikes in one form, a line between words taken as a space."""
    if not text.isascii():
        text = mapped(unicodedata.normalize("NFKC", text))
    return _TOKEN.findall(re.sub(r"(?<=[^\W_])_(?=[^\W_])", " ", text.strip()))


def _plain(raw: list[str]) -> list[str]:
    return ["0" * min(len(w), 4) if w.isdigit() else "<slot>" if w.lower() in _SLOT else w.lower() for w in raw]


def tokens(text: str) -> list[str]:
    """Lower-case words, digits as 0, slot words as one and marks."""
    return _plain(_raw(text))


def _form(w: str) -> str:
    if not w[0].isalpha():
        return "0" if w.isdigit() else w
    return "X" if len(w) == 1 and w.isupper() else "XX" if w.isupper() else "x" if w.islower() else "Xx" if w[0].isupper() and w[1:].islower() else "xX"


def _features(raw: list[str], known: set[str] | None) -> set[str]:
    """Words and runs of two and three, pairs of their forms, and how many there are; each once, so a long text weighs no more than its words."""
    low = _plain(raw)
    if known is not None:
        low = [w if w in known else "<new>" for w in low]
    ends, forms = ["^", *low, "$"], ["^", *map(_form, raw), "$"]
    pairs, runs = (f"{a} {b}" for a, b in zip(ends, ends[1:], strict=False)), (f"{a} {b} {c}" for a, b, c in zip(ends, ends[1:], ends[2:], strict=False))
    return {*low, *pairs, *runs, *(f"form {a} {b}" for a, b in zip(forms, forms[1:], strict=False)), f"size {min(len(raw), 8)}"}


def fit(trusted: list[str], others: list[str], stands: list[float] | None = None) -> dict:
    """Weights of features: log-odds of residue against the rest.

    The rest is unlabelled: each round, texts of it count for residue as far as the last round believed them to be.
    stands: how many values each text stands for, trusted ones first; only their proportions count, so a larger table of
    the same kinds gives the same model. A word seen in one text alone is taken as new. With no trusted text nothing
    counts for residue.
    """
    if not trusted:
        return {"known": set(), "weights": {}, "bias": -40.0}
    docs = [_raw(x) for x in [*trusted, *others]]
    seen: dict[str, int] = {}
    for d in docs:
        for w in set(_plain(d)):
            seen[w] = seen.get(w, 0) + 1
    known = {w for w, n in seen.items() if n > 1}
    index: dict[str, int] = {}
    rows, cols = [], []
    for i, d in enumerate(docs):
        for f in sorted(_features(d, known)):
            rows.append(i)
            cols.append(index.setdefault(f, len(index)))
    r, c, n, k = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), len(docs), len(trusted)
    stands = np.ones(n) if stands is None else np.array(stands, dtype=float) * (n / sum(stands))
    p = np.zeros(n)
    p[:k] = 1.0
    weights, bias = np.zeros(len(index)), 0.0
    for _ in range(ROUNDS):
        good, rest = stands * p, stands * (1 - p)
        pos, neg = np.bincount(c, weights=good[r], minlength=len(index)), np.bincount(c, weights=rest[r], minlength=len(index))
        share = float(np.clip(good.sum() / stands.sum(), 1e-6, 1 - 1e-6))  # smoothed towards the classes' own shares, so a rare feature tells little
        weights = (np.log((pos + SMOOTH * share) / (neg + SMOOTH * (1 - share))) - np.log(share / (1 - share))) / OVERLAP
        weights = np.where(weights > 0, weights * pos / (pos + FEW), weights)
        bias = np.log((good.sum() + 1) / (rest.sum() + 1))
        new = BELIEF / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=weights[c], minlength=n), -40, 40)))
        new[:k] = 1.0
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    keep = {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 0.01}
    return {"known": known, "weights": keep, "bias": float(bias)}


def score(text: str, model: dict) -> float:
    """Probability that the text is residue. An empty or blank text has none, nor has a conventional name."""
    raw = _raw(text)
    if not raw or " ".join(_plain(raw)) in _NO_RESIDUE:
        return 0.0
    get = model["weights"].get
    z = model["bias"] + fsum(get(f, 0.0) for f in _features(raw, model["known"]))
    return 1 / (1 + exp(-max(-40.0, min(40.0, z))))


_NO_RESIDUE = {" ".join(tokens(x)) for x in CONVENTIONAL}


def passages(videos: DataFrame, records: DataFrame) -> DataFrame:
    """tab, row_no, field, text of each value that may be residue; an array field has a passage for each element."""
    v = videos.select(F.lit("video_infos").alias("tab"), F.col("info_no").alias("row_no"), F.expr("stack(2, 'artist', artist, 'album', album) AS (field, text)"))
    r = records.select(F.lit("records").alias("tab"), F.col("record_no").alias("row_no"), F.lit("artists").alias("field"), F.explode("artists").alias("text"))
    return v.unionByName(r).filter(F.trim("text") != "")


def drawn(texts: DataFrame, trusted: int, others: int) -> tuple[dict, bool]:
    """The model fitted on texts drawn by their size q (text, n, q; distinct), and whether those are all texts.

    A text is drawn with a chance in proportion to q, at most 1, and stands for its n values divided by that chance, so
    what is often written is in whatever the size of the table. Where all texts are drawn each counts once, as few of so
    small a table are written often. Chances come from hashes; the driver reads the drawn texts and one row a power of two of q.
    """
    sure = F.coalesce(F.col("text").rlike(TRUST), F.lit(False))
    marked = texts.withColumn("sure", sure)
    bins = marked.groupBy("sure", F.floor(F.log2("q")).alias("b")).agg(F.count("*").alias("c"), F.sum("q").alias("q")).collect()

    def scale(kind: bool, most: int) -> float | None:
        # The factor of q at which about so many are drawn; none where all are.
        own = [(r["c"], r["q"]) for r in bins if r["sure"] == kind]
        if sum(c for c, _ in own) <= most:
            return None
        low, high = 0.0, max(c / q for c, q in own)
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(c, q * mid) for c, q in own) < most else (low, mid)
        return float(f"{high:.6g}")  # sums of parts in any order give one value

    scales = {True: scale(True, trusted), False: scale(False, others)}
    chance = lambda x: F.lit(1.0) if x is None else F.least(F.lit(1.0), F.col("q") * x)
    u = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(2.0**53)
    few = marked.withColumn("chance", F.when(F.col("sure"), chance(scales[True])).otherwise(chance(scales[False]))).filter(u < F.col("chance"))
    rows = sorted((not r["sure"], r["text"], r["stands"]) for r in few.select("sure", "text", (F.col("n") / F.col("chance")).alias("stands")).collect())
    whole = scales == {True: None, False: None}
    model = fit([t for other, t, _ in rows if not other], [t for other, t, _ in rows if other], None if whole else [w for *_, w in rows])
    return model, whole


def _probability(texts: DataFrame, model: dict) -> DataFrame:
    """texts with p, the probability of residue by the model."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    def series(values: pd.Series) -> pd.Series:
        m = held.value
        return values.map(lambda x: score(x, m))

    return texts.withColumn("p", F.pandas_udf(series, "double")("text"))


def model_of(texts: DataFrame) -> dict:
    """The model fitted on texts (distinct; text, and n, how many values it is).

    Where not all texts are fitted, a first model tells which are like residue, and a second is fitted on more of those,
    as most of a large table are names that teach nothing.
    """
    model, whole = drawn(texts.withColumn("q", F.col("n").cast("double")), FIT_TRUSTED, FIT_OTHERS)
    if whole or not model["weights"]:
        return model
    first = cut(_probability(texts, model))
    model, _ = drawn(first.withColumn("q", F.col("n") * F.sqrt(F.col("p") + EASY)), FIT_TRUSTED, FIT_OTHERS)
    discard(first)
    return model


def scored(passage_rows: DataFrame, least: float = ACCEPT, many: str | None = None) -> DataFrame:
    """The rows of passage_rows (with a column text) whose text is residue with a probability p of least or more.

    many: the column that has how many values a row is, else each is one. Null and blank texts have to be filtered out
    before. Works on any number of rows of one text: each distinct text is scored once and joined back. Trusted texts
    are residue for certain. With no trusted text nothing is found.
    """
    texts = cut(passage_rows.groupBy("text").agg((F.sum(many) if many else F.count("*")).alias("n")))
    good = _probability(texts.select("text"), model_of(texts))
    good = good.withColumn("p", F.when(F.coalesce(F.col("text").rlike(TRUST), F.lit(False)), 1.0).otherwise(F.col("p")))
    return passage_rows.join(good.filter(F.col("p") >= least), "text")


def decided(videos: DataFrame, records: DataFrame) -> DataFrame:
    """tab, row_no, field, texts of each field that is residue: the chance that any of its passages is one, each of them half likely at least."""
    likely = scored(passages(videos, records), 0.5).dropDuplicates(["tab", "row_no", "field", "text"])
    none = F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-9)))))
    return likely.groupBy("tab", "row_no", "field").agg(none.alias("none"), F.collect_set("text").alias("texts")).filter(1 - F.col("none") >= ACCEPT).drop("none")


def album_residue(videos: DataFrame) -> DataFrame:
    """found() for albums alone."""
    rows = videos.select(F.lit("video_infos").alias("tab"), F.col("info_no").alias("row_no"), F.lit("album").alias("field"), F.col("album").alias("text"))
    return scored(rows.filter(F.trim("text") != "")).select("tab", "row_no", "field")


def found(videos: DataFrame, records: DataFrame) -> DataFrame:
    return decided(videos, records).select("tab", "row_no", "field")


def clean(videos: DataFrame, records: DataFrame) -> DataFrame:
    """tab and all columns of both tables: every row, with residue fields null and residue elements of records' artists removed.

    Columns that a table doesn't have are null in its rows. A row whose number is null keeps its fields.
    """
    bad = decided(videos, records).groupBy("tab", "row_no").agg(F.collect_set("field").alias("_fields"), F.flatten(F.collect_set("texts")).alias("_texts"))
    of = lambda tab, no: bad.filter(F.col("tab") == tab).select(F.col("row_no").alias(no), "_fields", "_texts")
    out = lambda c: F.when(~F.coalesce(F.array_contains("_fields", c), F.lit(False)), F.col(c))
    v = videos.join(of("video_infos", "info_no"), "info_no", "left").withColumns({c: out(c) for c in ("artist", "album")})
    left = F.filter("artists", lambda x: x.isNull() | ~F.array_contains("_texts", x))
    r = records.join(of("records", "record_no"), "record_no", "left").withColumn("artists", F.when(F.col("_texts").isNull(), F.col("artists")).otherwise(left))
    parts = [x.drop("_fields", "_texts").withColumn("tab", F.lit(tab)) for tab, x in (("video_infos", v), ("records", r))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
