"""What the two operators on repeated passages share: anchored contexts, equal contexts, removal.

Every window of ``width`` tokens has one anchor, the smallest hash among its grams, so equal windows
have equal anchors at equal places. Successive windows with the same anchor travel as one row, their
context; rows of equal anchors meet in one partition, sorted, and a streaming pass tells them apart:

* rows whose whole context is equal to an earlier one hold nothing but repeats;
* the first rows of different contexts of one anchor stay open: some of their windows may be equal.

An anchor that occurs once ends here, as most do. Equal documents meet as a whole in the same pass
(position -1), and each task sends the windows of only one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.arrays import expand, mix, sliding_minima
from crmkiln.llm.common import ROW, saved

#: Position of a whole document; ``lead`` of a row that is known to hold nothing but repeats.
WHOLE = -1
SETTLED = -1
CONTEXTS = f"anchor long, context long, {ROW} long, pos long, lead int, n int"
_COLUMNS = ["anchor", "context", ROW, "pos", "lead", "n"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def contexts(grams: np.ndarray, gram: int, width: int, firsts: np.ndarray):
    """Runs of windows with one anchor: text, place of the anchor, first window, number of windows.

    ``grams``: hash of the gram at each token; ``firsts``: first token of each text.
    """
    n, texts = int(firsts[-1]), len(firsts) - 1
    sizes = np.diff(firsts)
    if n < width or not (sizes >= width).any():
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    values = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_minima(values, width - gram + 1)
    anchors = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A window lies in one text; grams that cross into the next text are in no such window.
    long_texts = np.flatnonzero(sizes >= width)
    starts = expand(firsts[long_texts], sizes[long_texts] - width + 1)
    owner = np.repeat(long_texts, sizes[long_texts] - width + 1)
    anchors = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(new)
    return owner[runs], anchors[runs], starts[runs], np.diff(np.append(runs, len(starts)))


def context_batch(rows, found, grams, context_hashes, firsts, digests, width, seen, keep_first):
    """Rows to send for a run of texts. ``seen``: smallest row so far of each document digest.

    Equal contexts, and equal documents, are combined before they are sent: one goes to their anchor's
    partition, the others are settled and go anywhere. So a passage that a third of all texts share
    arrives once per run of texts.
    """
    owner, anchors, starts, counts = found
    n_texts = len(rows)
    copies, repeated = np.zeros(n_texts, bool), []
    long_rows = np.diff(firsts) >= width
    for k, (row, digest) in enumerate(zip(rows.tolist(), digests.tolist())):
        earlier = seen.get(digest)
        if earlier is not None and earlier[0] < row:
            copies[k] = True
            if not keep_first and not earlier[1]:
                repeated.append((earlier[0], long_rows[k]))
            seen[digest] = earlier[0], True
        else:
            seen[digest] = row, False
    keep = ~copies[owner]
    owner, anchors, starts, counts = owner[keep], anchors[keep], starts[keep], counts[keep]
    lead = anchors - starts
    names = mix(context_hashes[keep] + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, row, pos = grams[anchors], rows[owner], starts - firsts[owner]

    order = np.lexsort((pos, row, names, keys))
    keys, names, row, pos = keys[order], names[order], row[order], pos[order]
    lead, counts = lead[order], counts[order]
    same = (keys[1:] == keys[:-1]) & (names[1:] == names[:-1])
    again = np.concatenate([[False], same])[:len(keys)]
    settled = again.copy()
    if not keep_first:
        settled[:-1] |= same[:max(len(keys) - 1, 0)]
    whole, copied = np.flatnonzero(long_rows & ~copies), np.flatnonzero(long_rows & copies)
    done_rows = np.concatenate([
        row[settled], rows[copied], np.array([r for r, fits in repeated if fits], np.int64)]).astype(np.int64)
    n_whole = len(done_rows) - int(settled.sum())
    done_pos = np.concatenate([pos[settled], np.full(n_whole, WHOLE)])
    done_counts = np.concatenate([counts[settled], np.zeros(n_whole, np.int64)])
    anywhere = mix(done_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + done_pos.astype(np.uint64))
    columns = (
        np.concatenate([keys[~again], mix(digests[whole] + np.uint64(1)), anywhere]).view(np.int64),
        np.concatenate([names[~again], mix(digests[whole] + np.uint64(2)), anywhere]).view(np.int64),
        np.concatenate([row[~again], rows[whole], done_rows]),
        np.concatenate([pos[~again], np.full(len(whole), WHOLE), done_pos]),
        np.concatenate([lead[~again], np.zeros(len(whole), np.int64), np.full(len(done_rows), SETTLED)]),
        np.concatenate([counts[~again], np.zeros(len(whole), np.int64), done_counts]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, _KINDS)], _COLUMNS)


def resolved(rows: DataFrame, keep_first: bool) -> DataFrame:
    """Rows that hold nothing but repeats (``open`` false) and rows to look into (``open`` true).

    ``keep_first``: the first of equal contexts is no repeat. Only the first row of the last context
    is held from batch to batch, so a context may have any number of rows.
    """

    def split(batches):
        held = None  # first row of the last context, and whether it was sent as a repeat, as open
        repeat_sent = open_sent = False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [column.to_numpy() for column in batch.columns]
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held, columns)]
            anchor, context = columns[0], columns[1]
            same_anchor = anchor[1:] == anchor[:-1]
            new = np.concatenate([[True], ~same_anchor | (context[1:] != context[:-1])])
            firsts = np.flatnonzero(new)
            settled = columns[4] == SETTLED
            repeat = ~new | settled
            if not keep_first:
                repeat[:-1] |= ~new[1:]
            meets = anchor[firsts[1:]] == anchor[firsts[:-1]]
            is_open = np.zeros(len(new), bool)
            is_open[firsts[1:][meets]] = True
            is_open[firsts[:-1][meets]] = True
            last = firsts[-1]
            last_open, last_repeat = bool(is_open[last]), bool(repeat[last])
            if held is not None:
                last_open |= last == 0 and open_sent
                last_repeat |= last == 0 and repeat_sent
                is_open[0] &= not open_sent
                repeat[0] &= not repeat_sent
            held = [c[last:last + 1] for c in columns]
            open_sent, repeat_sent = last_open, last_repeat
            is_open &= (columns[3] != WHOLE) & ~settled
            for chosen, flag in ((repeat, False), (is_open, True)):
                places = np.flatnonzero(chosen)
                if len(places):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[places]).cast(k) for c, k in zip(columns, _KINDS)]
                        + [pa.array(np.full(len(places), flag))], [*_COLUMNS, "open"])

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "context", ROW, "pos")
    return saved(ordered.mapInArrow(split, f"{CONTEXTS}, open boolean"), "contexts")


def per_row(places: DataFrame, columns: list[str]) -> DataFrame:
    """The places of each row as one array, which is no longer than the row's text."""
    return places.groupBy(ROW).agg(F.collect_list(F.struct(*columns)).alias("places"))


def covered(places, n: int, width: int) -> np.ndarray:
    """Tokens inside the windows of a text; ``places`` are (first window, number of windows)."""
    change = np.zeros(n + 1, np.int64)
    for pos, count in places:
        if pos == WHOLE:
            return np.ones(n, bool)
        change[pos] += 1
        change[pos + count + width - 1] -= 1
    return np.cumsum(change[:-1]) > 0
