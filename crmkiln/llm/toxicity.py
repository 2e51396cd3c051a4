"""Operator 11: toxicity by a factorization machine over hashed terms.

Method. A text is the set of its words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased), each
hashed to 64 bits. The score is the logistic function of

    bias + sum of w[t] + sum over pairs t < u of <v[t], v[u]>

so that two terms, such as an insult and the mention of a group, may count for more, or less, than the sum
of what each counts for alone. ``w`` and ``v`` have normal priors; they are fitted to the labelled
rows of the fold, those of ``SAMPLE`` ids at most, by full-batch Adam. A step is a Spark job: tasks add up the gradient of their rows, Spark
sums them by term, and the driver takes the step.

Which terms have parameters is decided by counts over these rows: those whose share of toxic rows
differs from the share of all rows by more than chance allows among so many terms (a z-score
above ``sqrt(2 ln terms)``), and those that do so among the rows which hold a term of the
first kind that speaks for toxicity; these act in company only. ``TERMS`` bounds the size of the model: beyond it the terms
with the largest z-scores are taken. Rows with the same terms are combined before the fit.

Memory. The model has ``TERMS`` x (``FACTORS`` + 1) numbers at most, which are what the driver and each task hold.
The labels of the sample, which are sent to all tasks too, take 16 bytes each. Term counts are Spark's.

Defined cases: a null, empty or wordless text has the score of a text without known terms; labels without a
document, without an id, or null, do not count; a document with several labels is toxic if one of them says so; documents
that repeat a ``doc_id`` count each, and have a row each; a null ``doc_id`` counts as an empty text in the fold and has no label; without any label the score
is ``PRIOR``; an empty table gives no rows; other columns are ignored. A text is taken whole, in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import ALNUM, FOLDED_VALUES, prefix_sums, range_hashes, slices, word_bounds
from crmkiln.llm.common import saved

#: Labelled ids that the model is fitted to, at most (but for the chance of their hashes).
SAMPLE = 1 << 17
#: Numbers of a term's factor, largest number of terms, steps of the fit and their first length.
FACTORS = 4
TERMS = 1 << 15
STEPS = 40
RATE = 0.4
#: Inverse variances of the priors of weights and factors.
WEIGHT_DECAY, FACTOR_DECAY = 1.0, 1.0
#: Rate of toxicity that is assumed of one unseen row.
PRIOR = 0.1
#: Scores of at least this predict 1.
CUTOFF = 0.3
#: Term counts that a task holds before it passes them on.
HELD_COUNTS = 1 << 20

HELD_OUT = "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 4 = 2"


@dataclass(frozen=True)
class Model:
    """``terms``: sorted hashes; ``weights`` and ``factors``: a row for each."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: np.ndarray, places: np.ndarray, n_rows: int):
        """Log-odds of every row, and the sums of its terms' factors. A row is a set of terms, given by
        their ``places`` in ``terms``."""
        sums = np.empty((n_rows, self.factors.shape[1]))
        for k in range(sums.shape[1]):
            sums[:, k] = np.bincount(rows, self.factors[places, k], n_rows)
        alone = np.bincount(rows, self.weights[places] - (self.factors[places] ** 2).sum(1) / 2, n_rows)
        return self.bias + alone + (sums ** 2).sum(1) / 2, sums


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text, in this order."""
    starts, ends, firsts = word_bounds(data, offsets, ALNUM)
    hashes = range_hashes(prefix_sums(data, FOLDED_VALUES), starts, ends).view(np.int64)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    return texts[new], hashes[new]


def _known(texts: np.ndarray, hashes: np.ndarray, terms: np.ndarray):
    """The rows whose hash is among the sorted terms, and the places there."""
    places = np.searchsorted(terms, hashes)
    places[places == len(terms)] = 0
    held = terms[places] == hashes if len(terms) else np.zeros(len(hashes), bool)
    return texts[held], places[held]


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text`` and ``toxic`` of the labelled rows outside the held-out fold.

    The labels of about ``sample`` ids at most, those with the smallest hashes, are sent to all tasks, so that no
    text is shuffled.
    """
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    said = saved(said.where(f"NOT ({HELD_OUT})"), "said")
    n = said.count()
    if n > sample:
        said = said.where(f"pmod(xxhash64(doc_id), {1 << 40}) < {(sample << 40) // n}")
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pairs.join(F.broadcast(said), "doc_id").select("text", "toxic")


def term_counts(rows: DataFrame, company: np.ndarray | None = None) -> DataFrame:
    """``term``, ``n`` rows with it, ``toxic`` ones among them. With ``company``, only rows that hold one of these terms count."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, ones, toxic = (np.concatenate(x) for x in zip(*held))
            keys, place = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays([
                pa.array(keys), pa.array(np.bincount(place, ones).astype(np.int64)),
                pa.array(np.bincount(place, toxic).astype(np.int64))], ["term", "n", "toxic"])

        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in slices(batch.column(0)):
                texts, terms = text_terms(data, offsets)
                if company is not None:
                    among = np.zeros(end - first, bool)
                    among[_known(texts, terms, company)[0]] = True
                    texts, terms = texts[among[texts]], terms[among[texts]]
                keys, place = np.unique(terms, return_inverse=True)
                held.append((keys, np.bincount(place, minlength=len(keys)).astype(np.int64),
                             np.bincount(place, marks[first:end][texts], len(keys)).astype(np.int64)))
                size += len(keys)
                if size > HELD_COUNTS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.select("text", "toxic").mapInArrow(count, "term long, n long, toxic long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("n > 1")


def telling(counts: DataFrame, n_rows: int, n_toxic: int, limit: int) -> list[tuple[int, float]]:
    """Terms with a share of toxic rows that chance does not explain, and their z-scores. At most ``limit``
    pass the driver."""
    if not 0 < n_toxic < n_rows:
        return []
    rate = n_toxic / n_rows
    counts = saved(counts, "term-counts")
    bar = math.sqrt(2 * math.log(max(counts.count(), 2)))
    excess = f"(toxic - n * {rate!r}D)"
    z = f"sign{excess} * greatest(abs{excess} - 0.5D, 0D) / sqrt(n * {rate * (1 - rate)!r}D)"
    found = counts.selectExpr("term", f"{z} AS z").where(f"abs(z) > {bar!r}D")
    return [(row["term"], row["z"]) for row in found.orderBy(F.abs("z").desc(), "term").limit(limit).collect()]


def term_sets(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """``places`` (of a row's terms in ``terms``), ``n`` rows with just these, ``toxic`` ones among them."""

    def sets(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(0)):
                texts, places = _known(*text_terms(data, offsets), terms)
                order = np.lexsort((places, texts))
                bounds = np.searchsorted(texts[order], np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(places[order], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [lists, batch.column(1).slice(first, end - first)], ["places", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(sets, "places array<int>, toxic long")
    return found.groupBy("places").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def gradient(sets: DataFrame, model: Model) -> np.ndarray:
    """Gradient of the negative log-likelihood: a row per term (weight, factors), and a last one whose first number is
    that of the bias."""
    size, width = len(model.terms), model.factors.shape[1] + 1

    def add(batches):
        total = np.zeros((size + 1, width))
        for batch in batches:
            lists = batch.column(0)
            n, toxic = (batch.column(k).to_numpy().astype(float) for k in (1, 2))
            places = lists.flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            margins, sums = model.margins(rows, places, batch.num_rows)
            slope = n * logistic(margins) - toxic
            total[:size, 0] += np.bincount(places, slope[rows], size)
            for k in range(width - 1):
                rest = sums[rows, k] - model.factors[places, k]
                total[:size, k + 1] += np.bincount(places, slope[rows] * rest, size)
            total[size, 0] += slope.sum()
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(total[used, k]) for k in range(width))],
            ["place", *(f"g{k}" for k in range(width))])

    parts = sets.select("places", "n", "toxic").mapInArrow(
        add, "place long, " + ", ".join(f"g{k} double" for k in range(width)))
    total = np.zeros((size + 1, width))
    for row in parts.groupBy("place").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(width)]).collect():
        total[row["place"]] = row[1:]
    return total


def fit(sets: DataFrame, terms: np.ndarray, rate: float, factors: int = FACTORS, steps: int = STEPS) -> Model:
    """The most likely model under the priors, by Adam with a falling step length."""
    size = len(terms)
    values = np.zeros((size + 1, factors + 1))
    # Factors that all are zero would stay so.
    values[:size, 1:] = np.random.default_rng(11).normal(0, 0.1, (size, factors))
    values[size, 0] = math.log(rate / (1 - rate))
    decay = np.full(values.shape, FACTOR_DECAY)
    decay[:, 0] = WEIGHT_DECAY
    decay[size] = 0

    def model() -> Model:
        return Model(terms, values[size, 0], values[:size, 0].copy(), values[:size, 1:].copy())

    mean, square = np.zeros(values.shape), np.zeros(values.shape)
    for step in range(1, steps + 1 if size else 1):
        slope = gradient(sets, model()) + decay * values
        mean += 0.2 * (slope - mean)
        square += 0.05 * (slope ** 2 - square)
        length = RATE * (1 - (step - 1) / steps)
        values -= length * (mean / (1 - 0.8 ** step)) / (np.sqrt(square / (1 - 0.95 ** step)) + 1e-12)
    return model()


def trained(docs: DataFrame, labels: DataFrame, factors: int = FACTORS, terms: int = TERMS) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    rows = saved(labelled(docs, labels), "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (toxic + PRIOR) / (n + 1)
    found = dict(telling(term_counts(rows), n, toxic, terms))
    company = np.sort(np.array([term for term, z in found.items() if z > 0], np.int64))
    if len(company):
        counted = term_sets(rows, company).where("size(places) > 0")
        near_n, near_toxic = counted.agg(F.sum("n"), F.sum("toxic")).first()
        for term, z in telling(term_counts(rows, company), near_n, near_toxic, terms):
            found[term] = max(abs(z), abs(found.get(term, 0)))
    # Beyond the size of the model the strongest stay, whichever count they come from.
    strongest = sorted(found, key=lambda term: (-abs(found[term]), term))[:terms]
    chosen = np.sort(np.array(strongest, np.int64))
    sets = saved(term_sets(rows, chosen), "term-sets")
    return fit(sets, chosen, rate, factors)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def score(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                rows, places = _known(*text_terms(data, offsets), model.terms)
                margins, _ = model.margins(rows, places, end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(logistic(margins))], ["doc_id", "score"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pairs.mapInArrow(score, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""
    return scores(docs, trained(docs, labels)).selectExpr(
        "doc_id", f"{HELD_OUT} AS held_out", "score", f"CAST(score >= {CUTOFF}D AS INT) AS predicted")
