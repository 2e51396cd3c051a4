"""Operator 7: removal of repeated word sequences with prefix-partitioned suffix trees.

Method. Suffixes (word positions with the ``WINDOW`` words after them) are dealt out by prefixes. The first
prefix is the window's anchor, a gram of ``GRAM`` words that equal windows share, so neighbouring suffixes
travel as one row (see ``repeats``). A prefix that occurs once leads to a leaf and is dropped; equal rows
are settled at once. Prefixes still shared by more than ``GROUP`` rows are lengthened to the full
window, so that each remaining group fits in memory. In each group the suffixes are sorted by their words
with the longest common prefixes of neighbours, which is its subtree: intervals of common prefixes of a
window or more are its deep internal nodes, the maximal repeats. The first suffix of each stays.

Words are compared by 64-bit hashes, whole contexts by those and the anchor's.

Defined cases: null text has no words, nothing is removed, and what is kept is empty; rows that repeat a ``doc_id`` are documents one after the other
(by text; null ids last); overlapping repeats inside a document count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import (
    SPACED, all_windows, prefix_sums, range_hashes, slices, window_hashes, word_bounds, word_sums,
)
from crmkiln.llm.common import ROW, keyed, saved
from crmkiln.llm.repeats import CONTEXTS, context_batch, contexts, covered, per_row, resolved

WINDOW = 20
GRAM = 8
GROUP = 20_000


def word_hashes(texts: pa.Array):
    """(first row, last row + 1, word hashes, first word of each text) of runs of texts."""
    for first, end, data, offsets in slices(texts):
        starts, ends, firsts = word_bounds(data, offsets, SPACED)
        yield first, end, range_hashes(prefix_sums(data), starts, ends), firsts


def context_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def build(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, end, words, firsts in word_hashes(batch.column(1)):
                sums = word_sums(words)
                grams = all_windows(sums, gram)
                found = contexts(grams, gram, window, firsts)
                starts, counts = found[2], found[3]
                yield context_batch(
                    keys[first:end], found, grams, window_hashes(sums, starts, starts + counts + window - 1),
                    firsts, window_hashes(sums, firsts[:-1], firsts[1:]), window, seen, True)

    return rows.select(ROW, "text").mapInArrow(build, CONTEXTS)


_SUFFIXES = f"prefix long, whole boolean, {ROW} long, pos long, lead int, n int, words binary"


def suffix_rows(rows: DataFrame, open_rows: DataFrame, window: int, group: int) -> DataFrame:
    """The open contexts with their words, under their prefix; one row per suffix where that is a
    whole window."""
    large = open_rows.groupBy("anchor").count().where(f"count > {group}").select(
        "anchor", F.lit(True).alias("large"))
    places = per_row(open_rows.join(large, "anchor", "left"), ["anchor", "pos", "lead", "n", "large"])

    def build(batches):
        for batch in batches:
            keys, places = batch.column(0).to_numpy(), batch.column(2)
            for first, end, words, firsts in word_hashes(batch.column(1)):
                out = [[] for _ in range(7)]
                sums = word_sums(words)
                for k in range(first, end):
                    base = int(firsts[k - first])
                    for place in places[k].as_py():
                        at, count = base + place["pos"], place["n"]
                        if place["large"]:
                            starts = np.arange(at, at + count)
                            names = window_hashes(sums, starts, starts + window).view(np.int64).tolist()
                            new = (names, [True] * count, [keys[k]] * count,
                                   list(range(place["pos"], place["pos"] + count)),
                                   [0] * count, [1] * count, [b""] * count)
                        else:
                            new = ([place["anchor"]], [False], [keys[k]], [place["pos"]], [place["lead"]],
                                   [count], [words[at:at + count + window - 1].tobytes()])
                        for values, more in zip(out, new):
                            values += more
                yield pa.RecordBatch.from_arrays([
                    pa.array(values, kind) for values, kind in zip(out, (
                        pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))
                ], ["prefix", "whole", ROW, "pos", "lead", "n", "words"])

    return rows.select(ROW, "text").join(places, ROW).mapInArrow(build, _SUFFIXES)


def later_suffixes(prefix, row, pos, lead, n, words, window):
    """(row, pos) of the suffixes of some prefix groups that are not the first of their node."""
    n_words = n + window - 1
    text = np.frombuffer(b"".join(words), np.uint64)
    base = np.cumsum(n_words) - n_words
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    suffix = text[(base[of] + step)[:, None] + np.arange(window)]
    row, pos, depth = row[of], pos[of] + step, lead[of] - step
    order = np.lexsort((pos, row, *suffix.T[::-1], depth, prefix[of]))
    suffix, group, depth = suffix[order], prefix[of][order], depth[order]
    # Longest common prefix with the suffix before, in words; suffixes of other groups share none.
    differs = suffix[1:] != suffix[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), window)
    common[(group[1:] != group[:-1]) | (depth[1:] != depth[:-1])] = 0
    later = np.flatnonzero(common >= window) + 1
    return row[order][later], pos[order][later]


def tree_repeats(suffixes: DataFrame, window: int) -> DataFrame:
    """Row and place of every suffix that repeats an earlier one."""

    def search(batches):
        held, last_whole = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.column(1).to_numpy(zero_copy_only=False)
            if whole.any():
                # Suffixes under a whole window are equal: all but the first repeat it.
                part = batch.filter(pa.array(whole))
                names = part.column(0).to_numpy()
                again = np.concatenate([[names[0] == last_whole], names[1:] == names[:-1]])
                last_whole = names[-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).filter(pa.array(again)), part.column(3).filter(pa.array(again)),
                     pa.array(np.ones(int(again.sum()), np.int32))], [ROW, "pos", "n"])
                batch = batch.filter(pa.array(~whole))
                if not batch.num_rows:
                    continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            names = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])), len(names))
            yield from subtrees(batch, edges[:-1])
            held = batch.slice(int(edges[-2]))
        if held is not None:
            yield from subtrees(held, np.array([0, held.num_rows]))

    def subtrees(batch, edges):
        """Groups, several at a time, that lie between the edges."""
        at = 0
        while at < len(edges) - 1:
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + 4096, "right")) - 1)
            part = batch.slice(int(edges[at]), int(edges[end] - edges[at]))
            prefix, row, pos = (part.column(k).to_numpy() for k in (0, 2, 3))
            lead, n = (part.column(k).to_numpy().astype(np.int64) for k in (4, 5))
            rows, places = later_suffixes(prefix, row, pos, lead, n, part.column(6).to_pylist(), window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(places), pa.array(np.ones(len(rows), np.int32))], [ROW, "pos", "n"])
            at = end

    return suffixes.repartition("prefix").sortWithinPartitions("whole", "prefix", ROW, "pos").mapInArrow(
        search, f"{ROW} long, pos long, n int")


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``pos`` and ``n``: runs of windows of each row that repeat an earlier window; -1 for a whole text."""
    found = resolved(context_rows(rows, window, gram), keep_first=True)
    suffixes = saved(suffix_rows(rows, found.where("open"), window, group), "suffixes")
    settled = found.where("NOT open").select(ROW, "pos", "n")
    return saved(settled.unionByName(tree_repeats(suffixes, window)), "repeats")


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` of every row."""
    return _removal(docs, window, "kept_text string", lambda kept: kept.decode())


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return _removal(docs, window, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _removal(docs: DataFrame, window: int, column: str, result) -> DataFrame:
    rows = keyed(docs)
    places = per_row(repeated_windows(rows, window), ["pos", "n"])

    def remove(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if places.is_valid:
                    cover = covered([(x["pos"], x["n"]) for x in places.as_py()], len(words), window)
                    gone = int(cover.sum())
                    words = [w for w, out in zip(words, cover.tolist()) if not out]
                sizes.append(len(words) + gone)
                removed.append(gone)
                kept.append(result(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", column.split()[0]])

    return rows.join(places, ROW, "left").select("doc_id", "text", "places").mapInArrow(
        remove, f"doc_id long, n_words long, n_removed long, {column}")
