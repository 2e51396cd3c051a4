"""Operator 1: token ids in a binary format of canonical, length-limited Huffman codes.

Method. Every text is encoded by a public tokenizer and gets an end id. The ids of all documents are
counted; package-merge gives optimal code lengths of at most 16 bits, from which the codes follow in
canonical order, so a file needs the lengths only. Documents are sorted by id over range partitions
and coded into blocks of at most ``block_ids`` ids. A block is decoded without any other: it names
its first id's place, its documents, and the bit offset of every 64th id. These checkpoints are
decoded side by side, each step one look-up in a table of 2**16 entries.

The files are Parquet rows, one per block (and one table of code lengths), so Spark's writers commit
them and any executor can read any block. Nothing but the 50 thousand counts passes the driver.

A document with more than ``block_ids`` ids has blocks of its own, and is put together from them (its digest from theirs) when read.
A text is encoded whole in one task, which takes some 60 bytes per byte of the longest text; coding and decoding hold a block.

Defined cases: null text is empty, and has the end id alone; rows that repeat a ``doc_id`` are coded one after the other, by a hash of their ids; null ``doc_id`` is last;
an empty table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import gc
import sys
import threading
import types
import uuid
import zlib
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm import common
from crmkiln.llm.word_cache import WordEncoder, id_type

MAX_BITS = 16
CHECKPOINT = 64
BLOCK_IDS = 1 << 16
#: After so many seconds without use a process lets go of its tokenizer and words.
IDLE_SECONDS = 2


@contextmanager
def _encoder(path: str):
    """The process's encoder, with the words it remembers, until no task has used it for ``IDLE_SECONDS``.

    It hangs on a module of its own, because the globals of functions that are sent to tasks last no longer than a
    task, and travel with them.
    """
    held = sys.modules.setdefault("crmkiln_encoders", types.ModuleType("crmkiln_encoders")).__dict__
    if "timer" in held:
        held.pop("timer").cancel()

    def let_go():
        held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()

    try:
        yield held.get(path) or held.setdefault(path, WordEncoder(path))
    finally:
        held["timer"] = timer = threading.Timer(IDLE_SECONDS, let_go)
        timer.daemon = True
        timer.start()


# ---------------------------------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit into codes of {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, levels = leaves[:0], []
    for _ in range(max_bits):
        weights = np.concatenate([leaves, packages])
        by_weight = np.argsort(weights, kind="stable")
        levels.append(by_weight < len(leaves))
        weights = weights[by_weight]
        pairs = len(weights) // 2
        packages = weights[0:2 * pairs:2] + weights[1:2 * pairs:2]
    take, chosen = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        leaf_count = int(is_leaf[:take].sum())
        chosen[:leaf_count] += 1
        take = 2 * (take - leaf_count)
    lengths[order] = chosen
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = np.uint64(1) << (np.uint64(32) - lengths[order].astype(np.uint64))
    firsts = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64) if len(order) else spans
    codes[order] = (firsts >> (np.uint64(32) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Bits of the ids, most significant first, and the bit offsets of every 64th id."""
    sizes = lengths[ids].astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    # A code lies in the two 32-bit words from the one its first bit is in. Codes share no bits, so
    # sums are unions, and below 2**53 they are exact.
    shifted = codes[ids].astype(np.uint64) << (64 - (offsets & 31) - sizes).astype(np.uint64)
    words = -(-total // 32) + 1
    place = offsets >> 5
    bits = np.bincount(place, (shifted >> np.uint64(32)).astype(np.float64), words)
    bits[1:] += np.bincount(place, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    return bits.astype(np.uint64).astype(">u4").tobytes(), offsets[::CHECKPOINT].astype("<u4").tobytes()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next 16 bits."""
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    order = used[np.argsort(codes[used].astype(np.uint64) << (MAX_BITS - lengths[used]).astype(np.uint64))]
    repeats = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids = np.zeros(1 << MAX_BITS, np.uint32)
    bits = np.ones(1 << MAX_BITS, np.int64)
    ids[:repeats.sum()] = np.repeat(order, repeats)
    bits[:repeats.sum()] = np.repeat(lengths[order], repeats)
    return ids, bits


def decode_block(
    bits: bytes, checkpoints: bytes, n_ids: int, tables: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    by_bits, widths = tables
    data = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
    ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    ids = np.zeros((len(at), CHECKPOINT), np.uint32)
    last = n_ids - (len(at) - 1) * CHECKPOINT  # ids after the last checkpoint
    for step in range(min(CHECKPOINT, n_ids)):
        if step == last:
            at = at[:-1]
        next_bits = (ahead[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        ids[:len(at), step] = by_bits[next_bits]
        at = at + widths[next_bits]
    return ids.ravel()[:n_ids]


# ----------------------------------------------------------------------------------------- jobs


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` (of ``id_type``, with the end id) of every row."""

    def encode(batches):
        with _encoder(tokenizer_path) as encoder:
            width = np.dtype(encoder.kind).itemsize
            for batch in batches:
                for first, end, ids, bounds in encoder.encode(batch.column(1), end_id):
                    coded = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), end - first, [None, pa.py_buffer(bounds * width), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, end - first), coded.cast(pa.binary())], ["doc_id", "ids"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pairs.mapInArrow(encode, "doc_id long, ids binary")


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs. Tasks count all they read; one row per id passes the driver."""

    kind = id_type(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            _, where, held = column.buffers()
            ends = np.frombuffer(where, np.int64)[[column.offset, column.offset + len(column)]]
            if held is not None:
                total += np.bincount(np.frombuffer(held, np.uint8)[ends[0]:ends[1]].view(kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in counted.collect():
        counts[row["id"]] = row["n"]
    return counts


BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids long, part int, doc_first long, doc_ids array<long>, "
    "doc_sizes array<long>, bits binary, checkpoints binary"
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS
) -> None:
    """Write ``<path>/blocks`` and ``<path>/lengths``, documents in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    ids = common.saved(encoded(docs, tokenizer_path, end_id), "ids")
    with _encoder(tokenizer_path) as encoder:
        vocabulary = encoder.tokenizer.get_vocab_size()
    if not 0 <= end_id < vocabulary:
        raise ValueError(f"the end id must be one of the {vocabulary} ids of the tokenizer")
    counts, kind = id_counts(ids, vocabulary), id_type(vocabulary)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame(
        [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)], "id int, length int"
    ).coalesce(1).write.parquet(f"{path}/lengths")

    def pack(batches):
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, sizes, parts, held = [], [], [], 0

        def row(ids, names, sizes, part=None, doc_first=None):
            nonlocal block, first
            bits, checkpoints = encode_block(ids, codes, lengths)
            values = shard, block, first, len(ids), part, doc_first, names, sizes, bits, checkpoints
            block, first = block + 1, first + len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(values, kinds)], labels)

        labels = [field.split()[0] for field in BLOCK_SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(coded.as_buffer(), kind)
                if held and held + len(ids) > block_ids:
                    yield row(np.concatenate(parts), names, sizes)
                    names, sizes, parts, held = [], [], [], 0
                if len(ids) > block_ids:
                    # A long document has blocks of its own.
                    doc_first = first
                    for part, at in enumerate(range(0, len(ids), block_ids)):
                        piece = ids[at:at + block_ids]
                        yield row(piece, [doc_id], [len(piece)], part, doc_first)
                    continue
                names.append(doc_id)
                sizes.append(len(ids))
                parts.append(ids)
                held += len(ids)
        if held:
            yield row(np.concatenate(parts), names, sizes)

    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    hashed = ids.select("doc_id", F.xxhash64("ids").alias("hash"), "ids")
    in_order = common.in_ranges(hashed, order, "ids").drop("hash")
    in_order.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of every document in the files."""
    return _read(spark, path, "ids", "binary", lambda ids: ids.tobytes(), lambda parts, _: b"".join(parts))


def read_digests(spark, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids of every document."""
    return _read(spark, path, "ids_crc32", "long", zlib.crc32, lambda parts, sizes: reduce(
        lambda a, b: (crc32_joined(a[0], *b), None), zip(parts, (4 * n for n in sizes)))[0])


def _read(spark, path: str, name: str, kind: str, of_ids, of_parts) -> DataFrame:
    """``name`` is what ``of_ids`` says of a document's ids, or ``of_parts`` of the values of its parts in order, and their sizes."""
    tables, starts = _reading(spark, path)
    columns, arrow = ["doc_id", "start", "n_tokens", name], pa.binary() if kind == "binary" else pa.int64()
    schema = f"doc_id long, start long, n_tokens long, {name} {kind}"

    def frame(doc_ids, begins, sizes, values):
        kinds = pa.int64(), pa.int64(), pa.int64(), arrow
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((doc_ids, begins, sizes, values), kinds)], columns)

    def whole(batches):
        for block, ids in _blocks(batches, tables):
            ends = np.cumsum(block["doc_sizes"])
            begins = ends - block["doc_sizes"]
            yield frame(block["doc_ids"], begins + starts[block["shard"]] + block["first"], block["doc_sizes"],
                        [of_ids(ids[a:b]) for a, b in zip(begins, ends)])

    def part(batches):
        for block, ids in _blocks(batches, tables):
            yield pa.RecordBatch.from_arrays([
                pa.array([block["shard"]], pa.int32()), pa.array([block["doc_first"]], pa.int64()),
                pa.array([block["part"]], pa.int32()), pa.array(block["doc_ids"], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([of_ids(ids)], arrow),
            ], ["shard", "doc_first", "part", "doc_id", "n", "value"])

    def join(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = [p["n"] for p in row["parts"]]
                yield frame([row["doc_id"]], [starts[row["shard"]] + row["doc_first"]], [sum(sizes)],
                            [of_parts([p["value"] for p in row["parts"]], sizes)])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    short = blocks.where("part IS NULL").mapInArrow(whole, schema)
    parts = blocks.where("part IS NOT NULL").mapInArrow(
        part, f"shard int, doc_first long, part int, doc_id long, n long, value {kind}")
    # One row per block of a long document; the document is a row of its own in the end.
    long = parts.groupBy("shard", "doc_first", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "n", "value"))).alias("parts")).mapInArrow(join, schema)
    return short.unionAll(long)


def crc32_joined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two texts put together, from that of each and the bytes of the second: the first goes on over ``size``
    zero bytes, which is a linear map, found by squaring."""

    def times(matrix, vector):
        out = 0
        for k in range(32):
            if vector >> k & 1:
                out ^= matrix[k]
        return out

    # A zero bit shifts to the right and folds what falls out back in (the reversed polynomial of CRC-32).
    step = [0xEDB88320] + [1 << k for k in range(31)]
    bits = 8 * size
    while bits:
        if bits & 1:
            first = times(step, first)
        step, bits = [times(step, column) for column in step], bits >> 1
    return first ^ second


def _reading(spark, path: str):
    """Decoding table, and the place of each shard's first id (one number per written shard)."""
    table = spark.read.schema("id int, length int").parquet(f"{path}/lengths").collect()
    lengths = np.zeros(max((row["id"] for row in table), default=0) + 1, np.uint8)
    for row in table:
        lengths[row["id"]] = row["length"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    starts, total = {}, 0
    for row in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        starts[row["shard"]] = total
        total += row["n"]
    return decode_table(lengths), starts


def _blocks(batches, tables):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ids = decode_block(row["bits"], row["checkpoints"], row["n_ids"], tables)
            row["doc_sizes"] = np.array(row["doc_sizes"], np.int64)
            # Digests are over unsigned 32-bit integers.
            yield row, ids.astype("<u4", copy=False)


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents to fresh token files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_digests(spark, path)
