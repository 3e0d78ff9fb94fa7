"""Operator 6: quality rules with risk-controlled cutoffs.

Each rule is a share between 0 and 1 (of symbols, repeated lines, repeated
words, capitals, punctuation, digits); a document is rejected when a share is
above the rule's cutoff in its stratum (its language). Cutoffs come from a
labelled holdout: for a stratum and rule, ever lower cutoffs of a fixed grid are
tested in order. A cutoff passes when k of n good documents above it let the
exact binomial tail P(X <= k; n, alpha) be at most delta, that is when the
Clopper-Pearson upper bound of the false rejection rate is at most alpha; the
first that fails ends the sequence. alpha is the stratum's risk divided by the
number of rules, delta is divided by the number of rules and strata (Bonferroni),
so that with confidence 1-delta no stratum falsely rejects more than ``risk`` of
its good documents. Of the cutoffs that passed, the one is taken that rejects
most bad documents less good ones, the highest among equals. A stratum with too
few labels to pass any test rejects nothing.

Defined results: null text has no words; texts are read whole, however long; a
null stratum is a stratum; a labelled id counts once in the holdout, however many
rows it has, with the greatest of their shares and the least stratum; labels for
one id that disagree, and null labels, are left out; without labels the rules
reject nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import row_of, shared_table, whole_text

RULES = ("symbols", "dup_lines", "repeats", "capitals", "punctuation", "digits")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
#: Above this many strata the cutoffs are joined by shuffle, not broadcast.
BROADCAST_STRATA = 10_000


def repeated_words(words: list[bytes], size: int) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    window, done = ids, 1
    while done < size:  # exact numbers of the windows of twice the length, then of the rest
        step = min(done, size - done)
        pair = window[:-step] * (int(window.max()) + 1) + window[step:]
        window, done = np.unique(pair, return_inverse=True)[1], done + step
    often = np.bincount(window)[window] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> list[float]:
    """COUNTS, then RULES, of one text."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes: ASCII white space only
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\f"))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup, filled = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            filled += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words, 5)
    kinds = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=5)
    share = lambda a, b: a / b if b else 0.0
    return [len(words), chars, symbols, dup, repeats, min(1.0, share(symbols, chars)), share(dup, filled),
            share(repeats, len(words)), share(kinds[1], kinds[1] + kinds[2]), share(kinds[3], kinds[1:].sum()),
            share(kinds[4], kinds[1:].sum())]


def byte_classes() -> np.ndarray:
    """0 white space, 1 capital, 2 other letter or non-ASCII, 3 punctuation, 4 digit."""
    kinds = np.full(256, 3, np.uint8)
    for b in range(256):
        c = chr(b)
        kinds[b] = 0 if c in " \t\n\r\x0b\f" else 2 if b >= 128 or c.islower() else 1 if c.isupper() else 4 if c.isdigit() else 3
    return kinds


CLASS = byte_classes()


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs`` but the text), the counts and the rules' shares."""
    rows = docs.select(row_of(docs, text).alias("row"), whole_text(text).alias("text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in COUNTS],
                           *[T.StructField(c, T.DoubleType()) for c in RULES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[statistics(x.as_py()) for x in batch.column(1)], strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in found[:5]],
                 *[pa.array(map(float, x), pa.float64()) for x in found[5:]]], ["row", *COUNTS, *RULES])

    return rows.mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p)."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> tuple[int, int, int, int]:
    """good, bad: documents by grid cell. The cutoff cell (reject above; len: nothing), and counts above it and in all."""
    n, cells = int(good.sum()), len(good)
    best, gain = (cells, 0, 0, n), 0
    for cut in range(cells - 2, -1, -1):
        k = int(good[cut + 1:].sum())
        if k > alpha * n or binomial_tail(k, n, alpha) > delta:
            break
        value = int(bad[cut + 1:].sum()) - k
        if value > gain:
            best, gain = (cut, k, int(bad[cut + 1:].sum()), n), value
    return best


def cutoffs(stats: DataFrame, labels: DataFrame, doc_id: str, stratum: str, risk: float, delta: float, cells: int) -> DataFrame:
    """stratum, rule, cutoff (null: none), rejected_good, rejected_bad, n_good.

    labels: doc_id and label (1 good, 0 bad). The histogram has strata x rules x cells rows at most.
    """
    agreed = (labels.filter("label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
              .filter("label = most").select(F.col("doc_id").alias("labelled_id"), "label"))
    shares = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in RULES]))
    # an id counts once however many rows it has, else the trials would not be independent: it is rejected if one of them is
    once = (stats.join(agreed, F.col("row")[doc_id] == F.col("labelled_id")).groupBy("labelled_id")
            .agg(F.min(F.col("row")[stratum]).alias("stratum"), F.min("label").alias("label"), *[F.max(r).alias(r) for r in RULES]))
    held = (once.select("stratum", "label", shares.alias("s"))
            .groupBy("stratum", F.col("s.rule").alias("rule"), F.ceil(F.col("s.share") * cells).cast("int").alias("cell"))
            .agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad")))
    held = shared_table(held, "holdout")
    strata = held.select("stratum").distinct().count()
    alpha, each = risk / len(RULES), delta / (len(RULES) * max(1, strata))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(part["cell"], part[c], cells + 1).astype(np.int64) for c in ("good", "bad"))
        cut, k, rejected, n = certified_cutoff(good, bad, alpha, each)
        return pd.DataFrame({"stratum": [part["stratum"].iloc[0]], "rule": [part["rule"].iloc[0]],
                             "cutoff": [cut / cells if cut <= cells else None], "rejected_good": [k],
                             "rejected_bad": [rejected], "n_good": [n]})

    kind = held.schema["stratum"].dataType.simpleString()
    return held.groupBy("stratum", "rule").applyInPandas(
        choose, f"stratum {kind}, rule string, cutoff double, rejected_good long, rejected_bad long, n_good long")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang",
          risk: float = 0.05, delta: float = 0.05, cells: int = 200) -> DataFrame:
    """One row per document: row (its columns but the text), counts, shares, base_failed, failed (rules), kept."""
    stats = shared_table(text_statistics(docs, text), "statistics")
    found = cutoffs(stats, labels, doc_id, stratum, risk, delta, cells)
    found = shared_table(found.filter("cutoff is not null").groupBy("stratum")
                         .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "cutoffs")
    if found.count() <= BROADCAST_STRATA:
        found = F.broadcast(found)
    joined = stats.join(found, F.col("row")[stratum].eqNullSafe(F.col("stratum")), "left")
    # a share in the cell of the cutoff is at most the cutoff, as in the histogram
    failed = F.array_compact(F.array(*[F.when(F.ceil(F.col(r) * cells) > F.round(F.col("cutoffs")[r] * cells), F.lit(r)) for r in RULES]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (joined.withColumn("base_failed", base).withColumn("failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("stratum", "cutoffs"))
