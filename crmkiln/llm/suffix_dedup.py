"""Operator 5: removal of repeated byte strings by external induced sorting with common prefixes.

Method. Suffix order is induced from a sample. The sample suffixes begin at anchors: in each window of
``WINDOW`` bytes the gram with the smallest hash. Equal windows have equal anchors, so windows travel as
contexts of anchors, and contexts that are equal as a whole, or alone, are settled before any sorting (see
``repeats``). The rest is dealt out by anchor; Spark's external sort orders the sample suffixes of a
shard, and neighbours' common prefixes follow from one pass. Then each level induces the suffixes one byte
further left from those of the level before: in their order, each appends (suffix, common prefix) to the queue of
the byte before it. Queues in byte order are the next level, already sorted; a common prefix is one
more than the least since the queue's last entry. Neighbours with ``WINDOW`` bytes in common are repeats.

Queues, suffix tuples, left bytes and results lie in files that are read and written in blocks of ``BLOCK``
entries, so a shard may be far larger than memory. The files are in the task's own folder and go with it:
a lost executor's shard is simply sorted again.

Whole contexts are compared by 64-bit hashes and their anchor's; common prefixes are of the bytes themselves.

Defined cases: null text has no bytes; strings never cross documents; overlapping repeats inside a document
count; rows that repeat a ``doc_id`` are documents of their own, so repeated rows lose all strings of
``WINDOW`` bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crmkiln.llm.arrays import mix, powers, prefix_sums, range_hashes, slices
from crmkiln.llm.arrays import _BASE_INVERSE as INVERSE
from crmkiln.llm.common import ROW, keyed, saved
from crmkiln.llm.repeats import CONTEXTS, context_batch, contexts, covered, per_row, resolved

WINDOW = 200
GRAM = 64
BLOCK = 1 << 16


def byte_grams(sums: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at every byte where one fits."""
    n = len(sums) - gram
    return mix((sums[gram:] - sums[:-gram]) * powers(INVERSE, n)) if n > 0 else np.empty(0, np.uint64)


def context_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def build(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, end, data, offsets in slices(batch.column(1)):
                sums = prefix_sums(data)
                grams = byte_grams(sums, gram)
                found = contexts(grams, gram, window, offsets)
                starts, counts = found[2], found[3]
                yield context_batch(
                    keys[first:end], found, grams, range_hashes(sums, starts, starts + counts + window - 1),
                    offsets, range_hashes(sums, offsets[:-1], offsets[1:]), window, seen, False)

    return rows.select(ROW, "text").mapInArrow(build, CONTEXTS)


_SAMPLE = f"anchor long, {ROW} long, pos long, lead int, n int, left binary, right binary"


def sample_rows(rows: DataFrame, open_rows: DataFrame, window: int) -> DataFrame:
    """The open contexts: bytes before the anchor, last first, and bytes from the anchor on."""
    places = per_row(open_rows, ["anchor", "pos", "lead", "n"])

    def build(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = [[] for _ in range(7)]
                for key, text, places in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    data = text.as_py().encode()
                    for x in places.as_py():
                        anchor = x["pos"] + x["lead"]
                        new = (x["anchor"], key, x["pos"], x["lead"], x["n"], data[x["pos"]:anchor][::-1],
                               data[anchor:x["pos"] + x["n"] + window - 1])
                        for values, value in zip(out, new):
                            values.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(out, kinds)],
                    ["anchor", ROW, "pos", "lead", "n", "left", "right"])

    return rows.select(ROW, "text").join(places, ROW).mapInArrow(build, _SAMPLE)


def padded(values: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of a matrix, filled up with zeros."""
    return np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in values), np.uint8).reshape(-1, width)


class Shard:
    """Sample suffixes of a shard, in order, and the levels induced from them, in files."""

    def __init__(self, folder: str, window: int):
        self.folder, self.window, self.size, self.last = folder, window, 0, None
        self.files = {name: open(os.path.join(folder, name), "wb") for name in ("left", "lead", "n", "common")}

    def append(self, lead, n, left: list[bytes], right: list[bytes]) -> None:
        """More sample suffixes, in the order of ``right``."""
        texts = padded(right, self.window)
        lengths = np.array([len(x) for x in right])
        before = self.last or (np.zeros((1, self.window), np.uint8), np.zeros(1, np.int64))
        differs = texts != np.concatenate([before[0], texts[:-1]])
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), self.window)
        common = np.minimum(common, np.minimum(lengths, np.concatenate([before[1], lengths[:-1]])))
        self.last = texts[-1:], lengths[-1:]
        for name, values in (("left", padded(left, self.window)), ("lead", lead.astype(np.int32)),
                             ("n", n.astype(np.int32)), ("common", common.astype(np.int32))):
            self.files[name].write(values.tobytes())
        self.size += len(lead)

    def _array(self, name: str, kind, width: int = 1, new: int = 0) -> np.ndarray:
        path = os.path.join(self.folder, name)
        shape = (new or self.size, width) if width > 1 else (new or self.size,)
        return np.memmap(path, kind, "w+" if new else "r", shape=shape)

    def repeats(self) -> np.ndarray:
        """For each sample suffix and each number of bytes before it: whether that window is a repeat."""
        for file in self.files.values():
            file.close()
        left = self._array("left", np.uint8, self.window)
        lead, n = self._array("lead", np.int32), self._array("n", np.int32)
        found = np.memmap(os.path.join(self.folder, "found"), np.uint8, "w+", shape=(self.size, self.window))
        level = (None, self._array("common", np.int32))
        for depth in range(self.window):
            queue, common = level
            size = len(common)
            ends = np.zeros(257, np.int64)
            last = None
            for at in range(0, size, BLOCK):
                ids = np.arange(at, min(at + BLOCK, size)) if queue is None else queue[at:at + BLOCK]
                equal = np.asarray(common[at:at + BLOCK]) >= self.window
                again = np.flatnonzero(equal)
                if len(again):
                    found[ids[again], depth] = 1
                    previous = ids[again - 1]
                    if again[0] == 0:
                        previous[0] = last
                    found[previous, depth] = 1
                last = ids[-1]
                further = ids[lead[ids] > depth]
                ends[1:] += np.bincount(left[further, depth], minlength=256)
            ends = np.cumsum(ends)
            if not ends[-1]:
                break
            level = self._induced(queue, common, left, lead, depth, ends[:-1].copy(), int(ends[-1]))
        valid = np.arange(self.window)
        for at in range(0, self.size, BLOCK):
            span = slice(at, at + BLOCK)
            last_place = lead[span][:, None] - valid
            found[span] &= (last_place >= 0) & (last_place < n[span][:, None])
        return found

    def _induced(self, queue, common, left, lead, depth, cursor, total):
        """The suffixes one byte further left. ``cursor``: where the queue of each byte goes on."""
        name = str(depth % 2)
        next_ids = self._array(f"ids{name}", np.int64, new=total)
        next_common = self._array(f"common{name}", np.int32, new=total)
        least = np.full(256, -1, np.int64)  # common prefix with a queue's last entry; -1: it has none
        for at in range(0, len(common), BLOCK):
            part = np.asarray(common[at:at + BLOCK]).astype(np.int64)
            ids = np.arange(at, at + len(part)) if queue is None else np.asarray(queue[at:at + BLOCK])
            bytes_before = left[ids, depth].astype(np.int64)
            bytes_before[lead[ids] <= depth] = 256
            order = np.argsort(bytes_before.astype(np.uint16), kind="stable")
            edges = np.searchsorted(bytes_before[order], np.arange(257))
            whole = part.min()
            for byte in range(256):
                places = order[edges[byte]:edges[byte + 1]]
                if not len(places):
                    least[byte] = min(least[byte], whole)
                    continue
                cuts = np.concatenate([[0], places + 1])
                tail = cuts[-1] < len(part)
                lows = np.minimum.reduceat(part, cuts if tail else cuts[:-1])
                values = lows[:len(places)]
                values[0] = min(values[0], least[byte])
                where = slice(cursor[byte], cursor[byte] + len(places))
                next_ids[where], next_common[where] = ids[places], values + 1
                cursor[byte] += len(places)
                least[byte] = lows[-1] if tail else self.window
        return next_ids, next_common


def induced_repeats(samples: DataFrame, window: int) -> DataFrame:
    """Runs of windows of the open contexts that occur elsewhere."""

    def search(batches):
        with tempfile.TemporaryDirectory() as folder:
            shard = Shard(folder, window)
            with open(os.path.join(folder, "names"), "wb") as names:
                for batch in batches:
                    for first in range(0, batch.num_rows, 4096):
                        part = batch.slice(first, 4096)
                        shard.append(part.column(2).to_numpy(), part.column(3).to_numpy(),
                                     part.column(4).to_pylist(), part.column(5).to_pylist())
                        np.stack([part.column(k).to_numpy() for k in (0, 1)], axis=1).tofile(names)
            if not shard.size:
                return
            found = shard.repeats()
            names = np.memmap(os.path.join(folder, "names"), np.int64, "r", shape=(shard.size, 2))
            lead = shard._array("lead", np.int32)
            for at in range(0, shard.size, BLOCK):
                # From left to right in the text is from the deepest level to level 0.
                flags = np.asarray(found[at:at + BLOCK])[:, ::-1]
                edge = np.zeros((len(flags), 1), np.uint8)
                change = np.diff(np.concatenate([edge, flags, edge], axis=1).astype(np.int8), axis=1)
                which, begin = np.nonzero(change == 1)
                _, end = np.nonzero(change == -1)
                pos = names[at + which, 1] + lead[at + which] - (window - 1 - begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at + which, 0]), pa.array(pos.astype(np.int64)),
                     pa.array((end - begin).astype(np.int32))], [ROW, "pos", "n"])

    dealt = samples.repartition("anchor").sortWithinPartitions("right")
    return dealt.select(ROW, "pos", "lead", "n", "left", "right").mapInArrow(
        search, f"{ROW} long, pos long, n int")


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``pos`` and ``n``: runs of windows of each row that occur elsewhere too; -1 for a whole text."""
    found = resolved(context_rows(rows, window, gram), keep_first=False)
    samples = saved(sample_rows(rows, found.where("open"), window), "samples")
    settled = found.where("NOT open").select(ROW, "pos", "n")
    return saved(settled.unionByName(induced_repeats(samples, window)), "repeats")


def _removal(docs: DataFrame, window: int, column: str, kind, result) -> DataFrame:
    rows = keyed(docs)
    places = per_row(repeated_windows(rows, window), ["pos", "n"])

    def remove(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                if places.is_valid:
                    cover = covered([(x["pos"], x["n"]) for x in places.as_py()], len(data), window)
                    removed.append(int(cover.sum()))
                    spans.append(int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()))
                    data = np.frombuffer(data, np.uint8)[~cover].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(result(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, kind)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", column.split()[0]])

    return rows.join(places, ROW, "left").select("doc_id", "text", "places").mapInArrow(
        remove, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")


def kept_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) of every row."""
    return _removal(docs, window, "kept binary", pa.binary(), bytes)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return _removal(docs, window, "kept_sha256 string", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())
