"""Operator 10: quality rules whose cutoffs are proven on labelled holdouts.

Method. Each rule rejects texts with a statistic beyond a cutoff. The labelled good texts are the
holdout. Per stratum (band of length) and rule, each cutoff of a fixed grid is tested: its false
rejections among the stratum's good texts give an exact (Clopper-Pearson) upper bound of the rate, at a
confidence that Bonferroni's correction spreads over all strata, rules and cutoffs. The strictest cutoff
with a bound of at most ``RISK`` / rules is chosen; where none is proven, the rule stays off. So, with
probability ``CONFIDENCE``, no stratum loses more than ``RISK`` of its good texts to all rules together.

Counts cover all labelled documents. Two numbers per (stratum, rule, cutoff) pass the driver: 4 x 5 x 19.

Defined cases: null, empty or wordless text has zero counts and fails the base rule; labels without a
document, or null, do not count; a document with several labels is good if all say so; documents that
repeat a ``doc_id`` count each; without labels only the base rule rejects; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import (
    SPACED, all_windows, mix, prefix_sums, range_hashes, slices, word_bounds, word_sums,
)
from crmkiln.llm.common import saved

RISK = 0.05
CONFIDENCE = 0.95

#: Statistic of each rule, in [0, 1]; large values are bad.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "1 - exp(-word_chars / greatest(n_words, 1) / 20)",
    "short_words": "exp(-word_chars / greatest(n_words, 1) / 4)",
}
CUTOFFS = [round(0.05 * k, 2) for k in range(1, 20)]
#: Bands of length, in words; each begins at its number.
STRATA = (0, 100, 300, 1000)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def counted(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags in each of the runs that ``bounds`` delimit."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def later(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    found = np.zeros(len(keys), bool)
    found[order[1:][ordered[1:] == ordered[:-1]]] = True
    return found


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n_texts = len(offsets) - 1
    starts, ends, firsts = word_bounds(data, offsets, SPACED)
    sums = prefix_sums(data)
    salts = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    n_words = np.diff(firsts)
    word_chars = counted(SPACED[data] & ((data & 0xC0) != 0x80), offsets)
    n_symbols = counted(_SYMBOL[data], offsets)

    # Lines end at \n and at the end of a text; a line of one text never equals one of another.
    breaks = np.flatnonzero(data == 10)
    line_ends = np.concatenate([breaks, offsets[1:]])
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    line_texts = np.concatenate([
        np.searchsorted(offsets, breaks, "right") - 1, np.arange(n_texts)])
    start_texts = np.concatenate([np.arange(n_texts), line_texts[:len(breaks)]])
    # A text has as many starts as ends; in order of (text, place) they pair up.
    order = np.lexsort((line_ends, line_texts))
    line_ends, line_texts = line_ends[order], line_texts[order]
    line_starts = line_starts[np.lexsort((line_starts, start_texts))]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_texts = line_starts[worded], line_ends[worded], line_texts[worded]
    duplicate = later(range_hashes(sums, line_starts, line_ends) ^ salts[line_texts])
    n_lines = np.bincount(line_texts, minlength=n_texts)
    n_dup_lines = np.bincount(line_texts[duplicate], minlength=n_texts)

    words = range_hashes(sums, starts, ends)
    texts = np.repeat(np.arange(n_texts), n_words)
    windows = all_windows(word_sums(words), 3)
    inside = texts[2:] == texts[:-2] if len(words) > 2 else np.empty(0, bool)
    places = np.flatnonzero(inside)
    places = places[repeated(windows[places] ^ salts[texts[places]])]
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[places + step] = True
    return [n_words, word_chars, n_symbols, n_lines, n_dup_lines, counted(covered, firsts)]


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every row."""

    def measure(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                values = [pa.array(x, pa.int64()) for x in text_statistics(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *values], ["doc_id", *_STATISTICS])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pairs.mapInArrow(measure, "doc_id long, " + ", ".join(f"{x} long" for x in _STATISTICS))


def stratum() -> str:
    return "CASE " + " ".join(
        f"WHEN n_words >= {least} THEN {number}" for number, least in reversed(list(enumerate(STRATA)))) + " END"


def upper_bound(failures: int, trials: int, error: float) -> float:
    """Largest rate at which ``failures`` or fewer of ``trials`` have a probability of ``error``."""
    if trials == 0 or failures >= trials:
        return 1.0

    def tail(rate: float) -> float:
        # Terms from the largest count downwards; they fall geometrically once below the mean.
        log = (math.lgamma(trials + 1) - math.lgamma(failures + 1) - math.lgamma(trials - failures + 1)
               + failures * math.log(rate) + (trials - failures) * math.log1p(-rate))
        total = term = 1.0
        for k in range(failures, 0, -1):
            term *= k / (trials - k + 1) * (1 - rate) / rate
            total += term
            if term < 1e-17 * total:
                break
        return math.exp(min(0.0, log + math.log(total)))

    low, high = max(failures / trials, 1e-300), 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if tail(middle) < error else (middle, high)
    return high


def chosen_cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE
) -> dict[tuple[int, str], float]:
    """The strictest proven cutoff of each (stratum, rule) that has one."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    held = measured.where(f"NOT ({BASE_FAILED})").join(good.select("doc_id"), "doc_id", "left_semi")
    rules = [F.expr(rule).alias(name) for name, rule in RULES.items()]
    rejected = [
        F.sum(F.when(F.col(name) > cutoff, 1).otherwise(0)).alias(f"{name}:{cutoff}")
        for name in RULES for cutoff in CUTOFFS
    ]
    rows = held.select(F.expr(stratum()).alias("stratum"), *rules).groupBy("stratum").agg(
        F.count("*").alias("n"), *rejected).collect()
    error = (1 - confidence) / (len(STRATA) * len(RULES) * len(CUTOFFS))
    chosen = {}
    for row in rows:
        for name in RULES:
            for cutoff in CUTOFFS:
                if upper_bound(row[f"{name}:{cutoff}"], row["n"], error) <= risk / len(RULES):
                    chosen[row["stratum"], name] = cutoff
                    break
    return chosen


def verdicts(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Statistics of every row, ``base_failed``, ``rules`` (names of those that reject it), ``kept``."""
    measured = saved(statistics(docs), "statistics")
    chosen = chosen_cutoffs(measured, labels, **bounds)
    fired = [
        f"CASE WHEN ({stratum()}) = {number} AND {RULES[name]} > {cutoff}D THEN '{name}' END"
        for (number, name), cutoff in sorted(chosen.items())
    ]
    rules = f"array_compact(array({', '.join(fired)}))" if fired else "CAST(array() AS array<string>)"
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), F.expr(rules).alias("rules"),
    ).withColumn("kept", F.expr("NOT base_failed AND size(rules) = 0"))
