"""Operator 8: exact Jaccard join of shingle sets by universe partition and pigeonhole.

Method. A document's set is that of its distinct shingles, of four words unless told otherwise, as 64-bit hashes; equal sets are one
node from then on. Sets within the threshold differ in at most H tokens, H following from the sizes. Per
band of sizes, a hash deals the token universe into segments; each segment has an allocation, 1 (its subset
must be equal) or 2 (it may differ by one token: the subset and its one-deletion neighbourhood are indexed).
Allocations of more than H in total leave at least one segment in which two such sets meet. Which
allocation a band gets follows from its cost: index entries, plus accidental meetings of short subsets. A set
is indexed in its own band, and in the next where partners reach into it. Empty subsets are not
indexed; the allocation has room for the few that occur, and sets with more share one more key.

Keys are dealt out by hash and sorted; one streaming pass drops those with one node. Candidates of a key are
not paired with each other. The node in most shared keys leads; each node is verified against the leader it
meets most often, and verified links give components. Only keys that still hold several components are
searched for further pairs, behind an exact lower bound of the difference (xor of parity sketches), then
verified and joined in. Pairs inside one component need no check: the classes are the same. Verification
intersects the whole sets.

At low thresholds the index has more entries than the sets have tokens. A join may first drop the sets that cannot link:
a token that no other set has is in no intersection, so a set has no partner if the others are fewer than the threshold's
share of it. Such lone tokens are counted in a part of the token universe only; what is not counted drops nothing.
Copies and frequent tokens combine in the tasks before that count's shuffle.

Node ids and tokens are 64-bit hashes (tokens keep 48 bits within a pair): among n different texts the
chance that any two share an id is about n**2 / 2**65.

Defined cases: null or wordless text has an empty set, size 0, and is a component of its own; fewer words than a
shingle's are one shingle; repeated rows link and share their smallest ``doc_id``; a null ``doc_id`` comes last, and is
the component of rows linked with null ids only (null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import (
    FOLDED_VALUES, SPACED, mix, prefix_sums, range_hashes, slices, window_hashes, word_bounds, word_sums,
)
from crmkiln.llm.common import ROW, components, keyed, saved, scratch

SHINGLE = 4
#: Similarity threshold in hundredths.
THRESHOLD = 85
#: Ratio of the sizes of a band, in powers of the threshold's inverse.
BAND_POWER = 2
ACCIDENT = 256
SKETCH_WORDS = 16
#: Hundredths of the token universe in which lone tokens are counted, where they are.
PROBED = 30


def bands(largest: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(first size, differences H, segments, of them allocated 2) per band, up to a size."""
    found, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * (100 / threshold) ** BAND_POWER))
        most = (100 - threshold) * 2 * (high - 1) // (100 + threshold)
        need = most + 2 + most // 20
        best = None
        for twos in range(need // 2 + 1):
            segments = need - twos
            length = low / segments
            entries = segments + twos * length
            accidents = (need - 2 * twos) * 4.0 ** -length + twos * 4.0 ** (1 - length)
            cost = entries + ACCIDENT * accidents
            if best is None or cost < best[0]:
                best = cost, segments, twos
        found.append((low, most, best[1], best[2]))
        low = high
    return found


def token_sets(texts: pa.Array, shingle: int = SHINGLE):
    """(first row, last row + 1, tokens, bounds): the sorted distinct shingles of each text."""
    for first, end, data, offsets in slices(texts):
        starts, ends, firsts = word_bounds(data, offsets, SPACED)
        words = range_hashes(prefix_sums(data, FOLDED_VALUES), starts, ends)
        n_words = np.diff(firsts)
        n_windows = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
        rows = np.repeat(np.arange(end - first), n_windows)
        begins = np.arange(len(rows)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + firsts[rows]
        windows = window_hashes(word_sums(words), begins, begins + np.minimum(n_words, shingle)[rows])
        order = np.lexsort((windows, rows))
        windows, rows = windows[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (windows[1:] != windows[:-1]) | (rows[1:] != rows[:-1])
        windows, rows = windows[new], rows[new]
        yield first, end, windows, np.searchsorted(rows, np.arange(end - first + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def node_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sizes = np.diff(bounds).astype(np.uint64)
    return mix(_sums(mix(tokens), bounds) + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def index_keys(tokens, bounds, plan, threshold):
    """(row, key) of every index entry of the sets."""
    sizes = np.diff(bounds)
    lows = np.array([band[0] for band in plan])
    own = np.searchsorted(lows, sizes, "right") - 1
    found_rows, found_keys = [], []
    for shift in (0, 1):
        rows = np.flatnonzero(sizes > 0)
        if shift:
            upper = np.append(lows[1:], np.iinfo(np.int64).max)
            rows = rows[(own[rows] + 1 < len(plan))]
            rows = rows[100 * sizes[rows] >= threshold * upper[own[rows]]]
        instance = own[rows] + shift
        most = np.array([band[1] for band in plan])[instance]
        # Sets that may not differ at all are one node already.
        rows, instance, most = rows[most > 0], instance[most > 0], most[most > 0]
        if not len(rows):
            continue
        segments = np.array([band[2] for band in plan])[instance]
        twos = np.array([band[3] for band in plan])[instance]
        n = sizes[rows]
        member = np.repeat(np.arange(len(rows)), n)
        places = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n) + bounds[rows][member]
        value = tokens[places]
        salt = mix(instance.astype(np.uint64) + np.uint64(1))
        segment = ((mix(value ^ salt[member]) >> np.uint64(32)) * segments[member].astype(np.uint64)
                   >> np.uint64(32)).astype(np.int64)
        base = np.cumsum(segments) - segments
        slot = base[member] + segment
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], mix(value[order])
        edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        edges = np.append(edges, len(slot))
        full, filled = _sums(value, edges), slot[edges[:-1]]
        owner = np.searchsorted(base, filled, "right") - 1
        name = mix(salt[owner] + (filled - base[owner]).astype(np.uint64))
        found_rows.append(rows[owner])
        found_keys.append(mix(full + name))
        # One token less, where the allocation is 2 and something remains.
        subset = np.diff(edges)
        double = (filled - base[owner]) < twos[owner]
        shorter = double & (subset > 1)
        if shorter.any():
            of = np.repeat(np.flatnonzero(shorter), subset[shorter])
            inside = np.arange(len(of)) - np.repeat(
                np.cumsum(subset[shorter]) - subset[shorter], subset[shorter]) + edges[of]
            found_rows.append(rows[owner[of]])
            found_keys.append(mix(full[of] - value[inside] + name[of]))
        # Room for subsets that are empty (or hold one token that may be missing).
        lost = segments + twos
        lost = lost - np.bincount(owner, np.where(double, np.where(subset > 1, 2, 1), 1), len(rows)).astype(np.int64)
        crowded = lost > segments + twos - (most + 1)
        if crowded.any():
            found_rows.append(rows[crowded])
            found_keys.append(mix(~salt[crowded]))
    if not found_rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(found_rows), np.concatenate(found_keys)


def nodes_of(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Row key, ``doc_id``, ``n_shingles`` and node of every document."""

    def build(batches):
        for batch in batches:
            for first, end, tokens, bounds in token_sets(batch.column(2), shingle):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first),
                    pa.array(np.diff(bounds), pa.int64()), pa.array(node_ids(tokens, bounds)),
                ], [ROW, "doc_id", "n_shingles", "node"])

    return rows.select(ROW, "doc_id", "text").mapInArrow(
        build, f"{ROW} long, doc_id long, n_shingles long, node long")


def index_entries(rows: DataFrame, largest: int, threshold: int, shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``node`` of every index entry; a task indexes equal sets once."""
    plan = bands(largest, threshold)

    def build(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, tokens, bounds in token_sets(batch.column(0), shingle):
                nodes = node_ids(tokens, bounds)
                owners, keys = index_keys(tokens, bounds, plan, threshold)
                new = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
                keep = new[owners]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[keep].view(np.int64)), pa.array(nodes[owners[keep]])], ["key", "node"])

    return rows.select("text").mapInArrow(build, "key long, node long")


def linkable(rows: DataFrame, nodes: DataFrame, threshold: int, shingle: int, probed: int) -> DataFrame:
    """One row (of ``nodes``) of every set that may link, by the lone tokens among ``probed`` hundredths of all."""
    limit = np.uint64(min((1 << 64) * probed // 100, (1 << 64) - 1))

    def build(batches):
        for batch in batches:
            for _, _, tokens, bounds in token_sets(batch.column(0), shingle):
                chosen = tokens < limit
                owners = np.repeat(node_ids(tokens, bounds), np.diff(bounds))[chosen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[chosen].view(np.int64)), pa.array(owners)], ["token", "node"])

    lone = rows.select("text").mapInArrow(build, "token long, node long").groupBy("token").agg(
        F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(
        F.count("*").alias("lone"))
    sets = nodes.where("n_shingles > 0").groupBy("node", "n_shingles").agg(F.min(ROW).alias(ROW))
    return sets.join(lone, "node", "left").where(
        f"100 * (n_shingles - coalesce(lone, 0)) >= {threshold} * n_shingles").drop("lone")


def shared_keys(entries: DataFrame) -> DataFrame:
    """The entries of keys with several nodes, each once. One pass over sorted entries; a key of any
    size streams through."""

    def several(batches):
        last_key = last_node = None
        alone = False
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            if last_key is not None:
                keys, nodes = np.append(last_key, keys), np.append(last_node, nodes)
            else:
                alone = True
            new_key = np.concatenate([[alone], keys[1:] != keys[:-1]])
            new_node = np.concatenate([[True], new_key[1:] | (nodes[1:] != nodes[:-1])])
            if last_key is not None:
                new_key[0] = alone
            keys, nodes, new_key = keys[new_node], nodes[new_node], new_key[new_node]
            followed = np.append(~new_key[1:], False)
            out = ~new_key | followed
            # The last entry waits for the next batch; if it was written already it opens no new run.
            wait = len(keys) - 1
            out[wait] = ~new_key[wait]
            if last_key is not None and not alone:
                out[0] = False
            last_key, last_node, alone = keys[wait], nodes[wait], bool(new_key[wait])
            yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(nodes[out])], ["key", "node"])

    return entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        several, "key long, node long")


_SKETCH = ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))


def _packed(tokens: np.ndarray) -> bytes:
    return (tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    whole = np.zeros((len(held) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(held, np.uint8).reshape(-1, 6)
    return whole.view(np.uint64).ravel()


def candidate_sets(rows: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Set, size and parity sketch of the wanted rows (row key, ``node``, ``leader``)."""

    def build(batches):
        for batch in batches:
            for first, end, tokens, bounds in token_sets(batch.column(0), shingle):
                # Bit b of a sketch is the parity of the tokens with hash b: each token that two sets do
                # not share flips one bit of their xor.
                bits = (mix(tokens + np.uint64(7)) >> np.uint64(54)).astype(np.int64) % (64 * SKETCH_WORDS)
                owner = np.repeat(np.arange(end - first), np.diff(bounds))
                parity = np.bincount(owner * 64 * SKETCH_WORDS + bits, minlength=(end - first) * 64 * SKETCH_WORDS) & 1
                sketch = np.packbits(parity.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little")
                sketch = sketch.reshape(end - first, SKETCH_WORDS, 8).view(np.int64)[:, :, 0]
                sets = [_packed(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(first, end - first), batch.column(2).slice(first, end - first),
                    pa.array(np.diff(bounds), pa.int64()), pa.array(sets, pa.binary()),
                    *[pa.array(sketch[:, k]) for k in range(SKETCH_WORDS)],
                ], ["node", "leader", "n", "tokens", *[f"s{k}" for k in range(SKETCH_WORDS)]])

    texts = rows.select(ROW, "text").join(wanted, ROW).select("text", "node", "leader")
    return texts.mapInArrow(build, f"node long, leader long, n long, tokens binary, {_SKETCH}")


def verified(pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (``a``, ``b``, ``tokens_a``, ``tokens_b``) that are within the threshold."""

    def check(batches):
        for batch in batches:
            keep, known, other = [], None, None
            for own, held in zip(batch.column(2), batch.column(3)):
                held = held.as_py()
                if held != known:
                    known, other = held, _unpacked(held)
                mine = _unpacked(own.as_py())
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= threshold * (len(mine) + len(other) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(check, "a long, b long")


def links(
    rows: DataFrame, nodes: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, probed: int = 0,
) -> DataFrame:
    """``node`` and ``component`` of the nodes that are linked with others."""
    if probed:
        nodes = saved(linkable(rows, nodes, threshold, shingle, probed), "linkable")
        rows = saved(rows.select(ROW, "text").join(nodes.select(ROW), ROW, "left_semi"), "texts")
    largest = nodes.agg(F.max("n_shingles")).first()[0] or 0
    shared = saved(shared_keys(index_entries(rows, largest, threshold, shingle)), "shared")
    degrees = shared.groupBy("node").agg(F.count("*").alias("degree"))
    ranked = saved(shared.join(degrees, "node"), "ranked")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead")).select(
        "key", F.col("lead.node").alias("leader"))
    met = ranked.select("key", "node").join(leaders, "key").where("node <> leader").groupBy("node", "leader").agg(
        F.count("*").alias("times"))
    best = met.groupBy("node").agg(F.max(F.struct("times", "leader")).alias("best")).select(
        "node", F.col("best.leader").alias("leader"))
    first_rows = nodes.groupBy("node").agg(F.min(ROW).alias(ROW))
    wanted = first_rows.join(degrees.select("node"), "node", "left_semi").join(best, "node", "left")
    sets = saved(candidate_sets(rows, wanted, shingle), "sets")
    leading = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"), F.col("n").alias("n_b"))
    similar = f"100 * least(n, n_b) >= {threshold} * greatest(n, n_b)"
    edges = saved(verified(
        sets.select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("tokens").alias("tokens_a"), "n")
        .where("b IS NOT NULL").join(leading, "b").where(similar), threshold), "links")
    found = components(edges)

    # Keys that still hold several components: pairs between those, behind the sketches' lower bound.
    labelled = saved(shared.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "labelled")
    # Of keys with the same nodes one is enough; node sets are compared by count, ends and two xors of hashes.
    same_nodes = {
        "n_nodes": F.count("*"), "first": F.min("node"), "last": F.max("node"),
        "xor": F.bit_xor("node"), "xor_hashed": F.bit_xor(F.xxhash64("node")),
    }
    mixed = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        *[value.alias(name) for name, value in same_nodes.items()]).where("low < high").groupBy(*same_nodes).agg(
        F.min("key").alias("key")).select("key")
    sketches = sets.drop("tokens", "leader")
    open_keys = saved(labelled.join(mixed, "key", "left_semi").join(sketches, "node"), "open")
    right = open_keys.select("key", *[F.col(x).alias(f"{x}_b") for x in open_keys.columns if x != "key"])
    differing = " + ".join(f"bit_count(s{k} ^ s{k}_b)" for k in range(SKETCH_WORDS))
    pairs = saved(open_keys.join(right, [open_keys["key"] == right["key"], F.expr("node < node_b"), F.expr(
        f"component <> component_b AND {similar}"
        f" AND {100 + threshold} * ({differing}) <= {100 - threshold} * (n + n_b)")]).select(
        F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    own = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    other = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    more = saved(verified(pairs.join(own, "a").join(other, "b"), threshold), "links")
    if more.isEmpty():
        return found
    return components(edges.union(more))


def near_duplicates(
    rows: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, probed: int = 0,
) -> DataFrame:
    """Row key, ``doc_id``, ``n_shingles``, ``component_id`` and ``component_row`` (the component's
    first row) of every row that has a key. ``probed``: hundredths of the token universe in which lone tokens are
    counted first; the rows are the same for any."""
    nodes = saved(nodes_of(rows, shingle), "nodes")
    linked = links(rows, nodes, threshold, shingle, probed)
    labelled = nodes.where("n_shingles > 0").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    firsts = labelled.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.min(ROW).alias("component_row"))
    full = labelled.join(firsts, "component").select(ROW, "doc_id", "n_shingles", "component_id", "component_row")
    empty = nodes.where("n_shingles = 0").select(
        ROW, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col(ROW).alias("component_row"))
    return full.unionByName(empty)


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(keyed(docs)).select("doc_id", "n_shingles", "component_id")


def first_documents(docs: DataFrame, columns, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The first row of each component, unchanged. Only the keys of these rows stay in the shared folder."""
    rows = keyed(docs, columns)
    with scratch(rows.sparkSession):
        found = near_duplicates(rows, threshold, shingle, PROBED)
        firsts = saved(found.where(f"{ROW} = component_row").select(ROW), "firsts", keep=True)
    return rows.join(firsts, ROW, "left_semi").select(*columns)
