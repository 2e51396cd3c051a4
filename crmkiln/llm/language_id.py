"""Operator 3: language identification by interpolated Kneser-Ney models of letter sequences.

Method. Letters are lower-cased and mapped to at most 64 symbols: the ``OWN_SYMBOLS`` most frequent
letters of the training texts have their own, all others share the rest by code point, and everything
between words is one boundary symbol. Four symbols make a key of 24 bits. Spark counts the keys of all
training texts per language, derives the continuation counts of the lower orders and interpolates
(absolute discount per order and language, from the counts of ones and twos). The result is, per order,
a sorted array of keys with the log probability in every language, and one of contexts with their
back-off weights; a text's cross-entropy is the mean over its symbols, one binary search each. The
lowest cross-entropy wins. A text is rejected where that lies above its language's mark: the level that
all but ``REJECTED`` of the language's training texts stay under, plus ``SLACK``.

Size: keys have 24 bits, so no array has more than 2**24 entries; the model's size grows with the number
of languages and letters, not with the corpus. Counts cover all training texts.

Defined cases: null text, or one without a letter, is ``und`` with score 0 and rejected; a text with no
symbol known in training has the first language, by name, of the lowest entropy; ties go to the first name; without training
rows every text is ``und``; a null ``doc_id`` is never learned from and never held out; repeated rows are
judged each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import slices
from crmkiln.llm.common import saved

UNKNOWN = "und"
ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
OWN_SYMBOLS = 48
REJECTED = 0.001
SLACK = 1.0
#: Keys of a run of texts that are scored at once, each in all languages.
KEYS_AT_ONCE = 1 << 16

HELD_OUT = "coalesce(crc32(CAST(doc_id AS string)) % 3 = 1, false)"
TRAINING = "coalesce(crc32(CAST(doc_id AS string)) % 3 <> 1, false) AND lang IS NOT NULL AND text IS NOT NULL"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(texts: pa.Array):
    """(first row, last row + 1, lower-cased code points, offsets) of runs of texts."""
    for first, end, data, offsets in slices(texts):
        parts = [data[a:b].tobytes().decode().lower() for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield first, end, points, np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def symbol_table(own: list[int]) -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, then own symbols, then shared ones."""
    points = np.arange(0x110000)
    table = np.where(letters(), OWN_SYMBOLS + 1 + points % (SYMBOLS - OWN_SYMBOLS - 1), 0).astype(np.uint8)
    table[own] = np.arange(1, len(own) + 1)
    return table


def keys(points: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Keys of four symbols, and the offsets of each text's keys. Every letter and every first
    boundary after one ends a key; before a text lie boundaries."""
    symbols = table[points]
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (texts[1:] != texts[:-1])
    first = np.zeros(len(symbols), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    keep &= ~(first & (symbols == 0))
    symbols, texts = symbols[keep].astype(np.uint32), texts[keep]
    bounds = np.searchsorted(texts, np.arange(len(offsets)))
    found = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.zeros(len(symbols), np.uint32)
        if len(symbols) > back:
            same = texts[back:] == texts[:-back]
            earlier[back:] = np.where(same, symbols[:-back], 0)
        found |= earlier << np.uint32(BITS * back)
    return found, bounds


def frequent_letters(training: DataFrame) -> list[int]:
    """The most frequent letters of all training texts; ties by code point."""

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for _, _, points, _ in code_points(batch.column(0)):
                used, n = np.unique(points, return_counts=True)
                total[used] += n
        used = np.flatnonzero(total * letters())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["point", "n"])

    counted = training.select("text").mapInArrow(count, "point long, n long").groupBy("point")
    most = counted.agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(OWN_SYMBOLS)
    return sorted(row["point"] for row in most.collect())


def key_counts(training: DataFrame, table: np.ndarray) -> DataFrame:
    """``lang``, ``key`` and how often it occurs; tasks count before they send."""

    def count(batches):
        held: dict[str, list] = {}

        def reduced(parts):
            merged, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
            return [(merged, sums)]

        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), object)
            for first, end, points, offsets in code_points(batch.column(0)):
                found, bounds = keys(points, offsets, table)
                row_languages = languages[first:end]
                for language in sorted(set(row_languages)):
                    mine = np.repeat(row_languages == language, np.diff(bounds))
                    held.setdefault(language, []).append(np.unique(found[mine], return_counts=True))
                    if len(held[language]) >= 16:
                        held[language] = reduced(held[language])
        for language, parts in held.items():
            (merged, sums), = reduced(parts)
            for first in range(0, len(merged), 50_000):
                part = merged[first:first + 50_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([language] * len(part)), pa.array(part),
                    pa.array(sums[first:first + 50_000])], ["lang", "key", "n"])

    counted = training.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        count, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Probabilities (``what`` = 1) and back-off weights (0) of every language, order and key."""
    orders = {ORDER: saved(counts, "grams")}
    for order in range(ORDER - 1, 0, -1):
        # How many different symbols precede.
        shorter = (1 << BITS * order) - 1
        orders[order] = orders[order + 1].groupBy(
            "lang", F.col("key").bitwiseAND(F.lit(shorter)).alias("key")).agg(F.count("*").alias("n"))
    found, lower = None, None
    for order in range(1, ORDER + 1):
        grams = orders[order].withColumn("context", F.shiftright("key", BITS))
        discounts = grams.groupBy("lang").agg(F.expr(
            "least(0.95D, greatest(0.05D, try_divide(count_if(n = 1), count_if(n = 1) + 2 * count_if(n = 2))))"
        ).alias("discount")).withColumn("discount", F.coalesce("discount", F.lit(0.5)))
        contexts = grams.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.count("*").alias("types")).join(discounts, "lang").withColumn(
            "weight", F.expr("discount * types / total"))
        shorter = (1 << BITS * (order - 1)) - 1
        joined = grams.withColumn("suffix", F.col("key").bitwiseAND(F.lit(shorter))).join(
            contexts, ["lang", "context"])
        if lower is None:
            joined = joined.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            joined = joined.join(lower, ["lang", "suffix"])
        level = joined.select(
            "lang", "key", F.expr("(n - discount) / total + weight * below").alias("value"))
        weights = contexts.select("lang", F.col("context").alias("key"), F.col("weight").alias("value"))
        rows = level.withColumn("what", F.lit(1)).unionByName(weights.withColumn("what", F.lit(0)))
        rows = saved(rows.withColumn("order", F.lit(order)), "model")
        found = rows if found is None else found.unionByName(rows)
        lower = rows.where("what = 1").select("lang", F.col("key").alias("suffix"), F.col("value").alias("below"))
    return found


class LanguageModel:
    """Sorted key arrays per order, with a column per language."""

    def __init__(self, languages: list[str], table: np.ndarray, arrays: dict):
        self.languages, self.own = languages, np.flatnonzero((table > 0) & (table <= OWN_SYMBOLS))
        self._table, self.arrays = None, {}
        floor = np.full(len(languages), np.log(1.0 / SYMBOLS))
        for order in range(1, ORDER + 1):
            contexts, weights = self._columns(arrays, order, 0, 0.0)
            self.arrays[order, 0] = contexts, weights
            grams, known = self._columns(arrays, order, 1, np.nan)
            self.arrays[order, 1] = grams, known
            # What a language has not seen after a context comes from the order below.
            missing = np.isnan(known)
            backed = self._below(grams, order, floor)
            known[missing] = backed[missing]

    @staticmethod
    def _columns(arrays, order, what, default):
        parts = arrays.get((order, what), [])
        every = np.unique(np.concatenate([k for _, k, _ in parts])) if parts else np.empty(0, np.uint32)
        columns = np.full((len(every), max([c for c, _, _ in parts], default=-1) + 1), default, np.float32)
        for column, own_keys, values in parts:
            columns[np.searchsorted(every, own_keys), column] = np.log(values)
        return every, columns

    def _below(self, grams, order, floor):
        contexts, weights = self.arrays[order, 0]
        lower = self.scores(grams & np.uint32((1 << BITS * (order - 1)) - 1), order - 1) if order > 1 else floor
        return self._look(contexts, weights, grams >> np.uint32(BITS), 0.0)[0] + lower

    @staticmethod
    def _look(known, columns, wanted, default):
        if not len(known):
            return np.full((len(wanted), columns.shape[1]), default, np.float32), np.zeros(len(wanted), bool)
        place = np.searchsorted(known, wanted)
        place[place == len(known)] = 0
        hit = known[place] == wanted
        values = columns[place]
        values[~hit] = default
        return values, hit

    def scores(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each key's last symbol in every language."""
        values, hit = self._look(*self.arrays[order, 1], grams, 0.0)
        if not hit.all():
            rest = ~hit
            floor = np.full(len(self.languages), np.log(1.0 / SYMBOLS), np.float32)
            values[rest] = self._below(grams[rest], order, floor)
        return values

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = symbol_table(self.own)
        return self._table

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def entropies(self, points: np.ndarray, offsets: np.ndarray):
        """Cross-entropy per symbol of each text in each language, and the number of letters."""
        found, bounds = keys(points, offsets, self.table)
        sums = np.zeros((len(bounds), len(self.languages)))
        total = np.zeros(len(self.languages))
        for first in range(0, len(found), KEYS_AT_ONCE):
            values = self.scores(found[first:first + KEYS_AT_ONCE])
            running = np.cumsum(np.concatenate([total[None], values]), axis=0)
            total = running[-1]
            low, high = np.searchsorted(bounds, first), np.searchsorted(bounds, first + len(values), "right")
            sums[low:high] = running[bounds[low:high] - first]
        n = np.diff(bounds)
        has_letter = np.concatenate([[0], np.cumsum(letters()[points])])
        n_letters = has_letter[offsets[1:]] - has_letter[offsets[:-1]]
        return -(sums[1:] - sums[:-1]) / np.maximum(n, 1)[:, None], n_letters


def trained(docs: DataFrame, training: str = TRAINING) -> LanguageModel:
    """Model of all rows of ``docs`` that the condition names."""
    rows = docs.select("doc_id", "text", "lang").where(training)
    own = frequent_letters(rows)
    table = symbol_table(own)
    model = kneser_ney(key_counts(rows, table))
    languages = [row["lang"] for row in model.select("lang").distinct().orderBy("lang").collect()]
    arrays: dict = {}
    for column, language in enumerate(languages):
        values = model.where(F.col("lang") == language).select("order", "what", "key", "value").toPandas()
        for (order, what), part in values.sort_values("key").groupby(["order", "what"]):
            arrays.setdefault((order, what), []).append(
                (column, part["key"].to_numpy(np.uint32), part["value"].to_numpy()))
    return LanguageModel(languages, table, arrays)


def predicted(docs: DataFrame, model: LanguageModel, keep=("doc_id",)) -> DataFrame:
    """``row`` (a struct of the columns to keep), ``lang_pred``, ``score``, ``entropy`` of every row."""
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()

    def predict(batches):
        for batch in batches:
            for first, end, points, offsets in code_points(batch.column(1)):
                if model.languages:
                    entropies, n_letters = model.entropies(points, offsets)
                    best = entropies.argmin(axis=1)
                    least = entropies[np.arange(len(best)), best]
                    weight = np.minimum(np.diff(offsets), 20)[:, None]
                    scores = 1 / np.exp(-weight * (entropies - least[:, None])).sum(axis=1)
                else:
                    n_letters = np.zeros(end - first)
                    best, least, scores = n_letters.astype(int), n_letters, n_letters
                known = n_letters > 0
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), pa.array(names, pa.string()),
                    pa.array(np.where(known, scores, 0.0)), pa.array(least.astype(float), mask=~known),
                ], ["row", "lang_pred", "score", "entropy"])

    return rows.mapInArrow(predict, f"row {kind}, lang_pred string, score double, entropy double")


def marks(scored: DataFrame, training: str) -> dict[str, float]:
    """Per language, the cross-entropy above which a text is rejected; from all training rows."""
    rows = scored.where(training).where(F.col("lang_pred") != UNKNOWN).groupBy("lang_pred").agg(
        F.percentile_approx("entropy", 1 - REJECTED, 10_000).alias("mark"))
    return {row["lang_pred"]: row["mark"] + SLACK for row in rows.collect()}


def rejected(limits: dict[str, float]) -> str:
    """Condition on ``lang_pred`` and ``entropy``."""
    cases = " ".join(
        "WHEN lang_pred = '" + name.replace("\\", "\\\\").replace("'", "\\'") + f"' THEN {limit!r}D"
        for name, limit in limits.items())
    return f"lang_pred = '{UNKNOWN}' OR " + (f"entropy > CASE {cases} ELSE double('inf') END" if cases else "false")


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``entropy``, ``rejected`` of every row."""
    scored = saved(
        predicted(docs, trained(docs), ("doc_id", "lang")).select("row.*", "lang_pred", "score", "entropy"),
        "languages")
    limits = marks(scored, TRAINING.replace(" AND text IS NOT NULL", ""))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.expr(HELD_OUT).alias("held_out"),
        "lang_pred", "score", "entropy", F.expr(rejected(limits)).alias("rejected"))


def accepted(docs: DataFrame, columns) -> DataFrame:
    """The rows whose language is not rejected, unchanged."""
    scored = saved(
        predicted(docs, trained(docs), columns).select("row", "lang_pred", "entropy", "row.doc_id", "row.lang"),
        "languages")
    limits = marks(scored, TRAINING.replace(" AND text IS NOT NULL", ""))
    return scored.where(f"NOT ({rejected(limits)})").select("row.*")
