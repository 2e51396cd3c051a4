"""Operator 9: benchmark decontamination with a generalised suffix automaton.

Method. Test items are normalised to words and joined, with separators that no text has, into one
suffix automaton. Training texts stream through it: each word moves the automaton on, or back along
suffix links, so the length of the longest match that ends at the word is always known. Where it reaches
the window length, the window's items are looked up. Only runs of words that all occur in the benchmark,
at least as long as the shortest window, are streamed; no other run can hold a match.

An automaton has at most two states per item word. Items are dealt into as many automata of at most
``AUTOMATON_WORDS`` words as the benchmark needs; what is sent to the executors is bounded, whatever the
benchmark's size. A longer item goes in pieces, which share all but one word of a window, so no window is lost.

Spans are as long as a window, or a whole shorter item, and ``clean_documents`` cuts all of them out of the text; documents
over the limit of coverage go as a whole.

Defined cases: null or wordless text has no words, and null or wordless items no windows; repeated
items and item ids count once, null item ids are never counted though their windows hit; rows that
repeat a ``doc_id`` are judged each by itself; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import (
    ALNUM, FOLDED_VALUES, prefix_sums, range_hashes, slices, word_bounds,
)
from crmkiln.llm.common import saved

WINDOW_WORDS = 13
AUTOMATON_WORDS = 500_000


def hashed_words(texts: pa.Array):
    """(first row, word hashes, index of each text's first word) of runs of texts."""
    for first, end, data, offsets in slices(texts):
        starts, ends, firsts = word_bounds(data, offsets, ALNUM)
        yield first, end, range_hashes(prefix_sums(data, FOLDED_VALUES), starts, ends), firsts


class ItemAutomaton:
    """Suffix automaton of items (lists of word hashes) and the windows to look up in it."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.array([w for _, words in items for w in words], np.uint64))
        self.next, self.link, self.length, self.owners = [{}], [-1], [0], {}
        last = 0
        for number, (name, words) in enumerate(items):
            ids = np.searchsorted(self.vocabulary, np.array(words, np.uint64)).tolist()
            for word in ids:
                last = self._extend(last, word)
            last = self._extend(last, -1 - number)
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                self.owners.setdefault(tuple(ids[k:k + size]), set()).update([name] if name else [])
        self.sizes = sorted({len(words) for words in self.owners}, reverse=True)

    def _extend(self, last: int, word: int) -> int:
        state = self._state({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            if self.length[known] == self.length[at] + 1:
                self.link[state] = known
            else:
                copy = self._state(dict(self.next[known]), self.link[known], self.length[at] + 1)
                self.link[known] = self.link[state] = copy
                while at >= 0 and self.next[at].get(word) == known:
                    self.next[at][word] = copy
                    at = self.link[at]
        return state

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def matches(self, words: list[int]):
        """(first word, end, items) of every window that occurs in ``words``."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for k, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(word, 0)
            matched = matched + 1 if state else 0
            for size in self.sizes:
                if matched >= size:
                    owners = self.owners.get(tuple(words[k + 1 - size:k + 1]))
                    if owners is not None:
                        yield k + 1 - size, k + 1, owners

    def text_matches(self, hashes: np.ndarray, firsts: np.ndarray):
        """(text, first word, end, items) of every window that occurs, words counted in the text."""
        if not self.sizes or not len(hashes):
            return
        ids = np.searchsorted(self.vocabulary, hashes)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == hashes
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        ends[:-1] &= ~known[1:]
        edges = firsts[(firsts > 0) & (firsts < len(known))]
        begins[edges] = known[edges]
        ends[edges - 1] = known[edges - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long_enough = ends - begins >= self.sizes[-1]
        begins, ends = begins[long_enough], ends[long_enough]
        texts = np.searchsorted(firsts, begins, "right") - 1
        for text, begin, end in zip(texts.tolist(), begins.tolist(), ends.tolist()):
            before = begin - int(firsts[text])
            for start, stop, owners in self.matches(ids[begin:end].tolist()):
                yield text, before + start, before + stop, owners


def item_automata(benchmark: DataFrame, window: int):
    """Automata over all items, one after the other, each of at most ``AUTOMATON_WORDS`` words."""

    most = AUTOMATON_WORDS
    step = most - window + 1

    def words(batches):
        for batch in batches:
            for first, end, hashes, firsts in hashed_words(batch.column(1)):
                pieces = [(text, x, min(b, x + most)) for text, (a, b) in enumerate(zip(firsts[:-1], firsts[1:]))
                          for x in (range(a, b - window + 1, step) if b - a > most else [a])]
                lists = [hashes[a:b].view(np.int64) for _, a, b in pieces]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([first + text for text, _, _ in pieces], pa.int64())),
                     pa.array(lists, pa.list_(pa.int64())),
                     pa.array([len(x) for x in lists], pa.int64())], ["name", "words", "n"])

    items = saved(benchmark.select(F.col("item_id").cast("string").alias("name"), "text").mapInArrow(
        words, "name string, words array<long>, n long").where("n > 0"), "items")
    if items.isEmpty():
        yield ItemAutomaton([], window)
        return
    held, size = [], 0
    # Items come to the driver a partition at a time and leave it with their automaton.
    for row in items.toLocalIterator():
        if held and size + row["n"] > AUTOMATON_WORDS:
            yield ItemAutomaton(held, window)
            held, size = [], 0
        held.append((row["name"], [word & (1 << 64) - 1 for word in row["words"]]))
        size += row["n"]
    yield ItemAutomaton(held, window)


_SPAN = "struct<first:bigint,end:bigint>"


def _scan(rows: DataFrame, automaton: ItemAutomaton) -> DataFrame:
    """Add an automaton's matches to those the rows have."""

    def scan(batches):
        for batch in batches:
            for first, end, hashes, firsts in hashed_words(batch.column("text")):
                part = batch.slice(first, end - first)
                spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                for text, start, stop, owners in automaton.text_matches(hashes, firsts):
                    own = spans[text]
                    if own and own[-1]["first"] <= start <= own[-1]["end"]:
                        own[-1]["end"] = max(stop, own[-1]["end"])
                    else:
                        own.append({"first": start, "end": stop})
                    items[text] = sorted(owners.union(items[text])) if owners.difference(items[text]) else items[text]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("text"), pa.array(np.diff(firsts), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ], ["row", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(scan, rows.schema)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, keep=("doc_id",)
) -> DataFrame:
    """``row``, a struct of the columns to keep, with its ``n_words``, the hit ``spans`` (words from 0,
    disjoint, in order), ``n_hit``, and the sorted ``items``."""
    rows = docs.select(
        F.struct(*keep).alias("row"), "text", F.lit(0).cast("long").alias("n_words"),
        F.expr(f"CAST(array() AS array<{_SPAN}>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"))
    for number, automaton in enumerate(item_automata(benchmark, window)):
        # One automaton at a time is in the executors' memory.
        rows = _scan(saved(rows, "scanned") if number else rows, automaton)
    merged = f"""aggregate(array_sort(spans), CAST(array() AS array<{_SPAN}>), (done, x) ->
        CASE WHEN size(done) > 0 AND x.first <= element_at(done, -1).end
             THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first,
                  'end', greatest(x.end, element_at(done, -1).end))))
             ELSE concat(done, array(x)) END)"""
    return rows.withColumn("spans", F.expr(f"CASE WHEN size(spans) > 1 THEN {merged} ELSE spans END")).select(
        "row", "n_words", "spans",
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.first)").alias("n_hit"), "items")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def judged(hits: DataFrame) -> DataFrame:
    """Digest columns; contaminated where a twentieth of the words or more is hit."""
    return hits.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int, end: int, spans) -> str:
    """A text's bytes (``begin`` to ``end``) without the spans of its words, at ``starts`` and ``ends``."""
    kept, at = [], begin
    for span in spans:
        kept.append(data[at:starts[span["first"]]].tobytes())
        at = ends[span["end"] - 1]
    return b"".join([*kept, data[at:end].tobytes()]).decode()


def without_spans(hits: DataFrame, columns) -> DataFrame:
    """The rows of the hits with their spans cut out of the text; ``n_chars`` follows the text."""
    rows = hits.select("row.*", "spans")

    def cut(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                part = batch.slice(first, end - first)
                starts, ends, firsts = word_bounds(data, offsets, ALNUM)
                texts = part.column("text").to_pylist()
                for k, spans in enumerate(part.column("spans").to_pylist()):
                    if spans:
                        own = slice(firsts[k], firsts[k + 1])
                        texts[k] = _without(data, starts[own], ends[own], offsets[k], offsets[k + 1], spans)
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", pa.array(texts, part.column(at).type))

    found = rows.mapInArrow(cut, rows.schema)
    if "n_chars" in columns:
        kind = rows.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(
            F.col("n_chars")))
    return found.select(*columns)


def clean_documents(docs: DataFrame, benchmark: DataFrame, columns) -> DataFrame:
    """The rows that are not contaminated, without the passages of the benchmark they hold."""
    hits = benchmark_hits(docs, benchmark, keep=columns)
    return without_spans(hits.where(f"NOT ({CONTAMINATED})"), columns)
