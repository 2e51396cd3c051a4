"""Token ids of texts by way of their words, over arrays.

A byte-level tokenizer begins a new piece at every single space between two other characters, so a text
may be cut there and each distinct word encoded once. Words are told apart by a 64-bit hash and then compared byte by
byte. A space occurs at the start of a word only, and so marks the first token of each word when many
words are encoded as one text. What cannot be cut (other white space at a cut, the content of
an added token, two words of one hash) goes to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from crmkiln.llm.arrays import BYTE_VALUES, expand, prefix_sums, range_hashes, slices

#: Words, and bytes of words, that a cache keeps from one slice of texts to the next.
CACHED_WORDS = 1 << 19
CACHED_BYTES = 1 << 24
#: Bytes of texts that are encoded at once (more where a text is longer): their arrays fit into a core's own cache.
SLICE_BYTES = 1 << 18
#: Unseen words that are encoded as one text.
WORDS_AT_ONCE = 128

_U = np.uint64
#: White space of one byte, first bytes of wider white space, and the numbers that its two or three bytes make.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = np.array(sorted(
    int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big")
    for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LEADS = np.zeros(256, bool)
_LEADS[_WIDE >> 16] = True


def id_type(vocabulary: int) -> str:
    """Unsigned integers that hold all ids, and little more: ids are shuffled in this form."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.size = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            held = np.empty(max(end, 3 * len(self.held) // 2), self.held.dtype)
            held[:self.size] = self.held[:self.size]
            self.held = held
        self.held[self.size:end] = values
        self.size = end

    @property
    def values(self) -> np.ndarray:
        return self.held[:self.size]


class WordTable:
    """Words and their ids: arrays by word number, and a hash table of the numbers with open addressing."""

    def __init__(self, kind: str):
        self.kind = kind
        self.hashes, self.starts, self.sizes = _Column(_U), _Column(np.int32), _Column(np.int32)
        self.firsts, self.counts, self.used = _Column(np.int32), _Column(np.int32), _Column(np.int32)
        self.letters, self.ids = _Column(np.uint8), _Column(kind)
        self.slots = np.full(1 << 13, -1, np.int32)

    def __len__(self) -> int:
        return self.hashes.size

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word of each hash, or -1."""
        known, last = self.hashes.held, len(self.slots) - 1
        place = (hashes & _U(last)).astype(np.int64)
        found = self.slots[place]
        open_ = np.flatnonzero((found >= 0) & (known[found] != hashes))
        while len(open_):
            place[open_] = (place[open_] + 1) & last
            number = self.slots[place[open_]]
            found[open_] = number
            open_ = open_[(number >= 0) & (known[number] != hashes[open_])]
        return found

    def _place(self, numbers: np.ndarray) -> None:
        last = len(self.slots) - 1
        place = (self.hashes.held[numbers] & _U(last)).astype(np.int64)
        while len(numbers):
            free = self.slots[place] < 0
            self.slots[place[free]] = numbers[free]
            # Of words at one slot the last written has it.
            left = self.slots[place] != numbers
            numbers, place = numbers[left], (place[left] + 1) & last

    def add(self, hashes, letters, sizes, ids, counts, now: int) -> None:
        """New words, of distinct hashes."""
        begin = len(self)
        self.starts.extend(self.letters.size + np.cumsum(sizes) - sizes)
        self.firsts.extend(self.ids.size + np.cumsum(counts) - counts)
        for column, values in ((self.hashes, hashes), (self.sizes, sizes), (self.counts, counts),
                               (self.used, np.full(len(hashes), now, np.int32)),
                               (self.letters, letters), (self.ids, ids)):
            column.extend(values)
        if 2 * len(self) > len(self.slots):
            self.slots = np.full(1 << int(4 * len(self) - 1).bit_length(), -1, np.int32)
            begin = 0
        self._place(np.arange(begin, len(self), dtype=np.int32))

    def recent(self, share: float = 0.5) -> WordTable:
        """A table of the words used last."""
        limit = np.quantile(self.used.values, 1 - share)
        kept = np.flatnonzero(self.used.values > limit)
        table = WordTable(self.kind)
        sizes, counts = self.sizes.values[kept], self.counts.values[kept]
        table.add(self.hashes.values[kept], self.letters.values[expand(self.starts.values[kept], sizes)], sizes,
                  self.ids.values[expand(self.firsts.values[kept], counts)], counts, 0)
        table.used.values[:] = self.used.values[kept]
        return table


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word (a text's start, and its spaces), and which texts cannot be cut."""
    whole = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return np.empty(0, np.int64), whole
    filled = np.flatnonzero(np.diff(offsets))
    first = np.zeros(len(data) + 1, bool)  # whether a text begins here, or the last one ends
    first[offsets[filled]] = first[-1] = True
    space = data == 32
    spaces = np.flatnonzero(space)

    def cannot(places):
        whole[np.searchsorted(offsets, places, "right") - 1] = True

    # White space at the end of a text, and next to a space.
    whole[filled] = _BLANK[data[offsets[filled + 1] - 1]]
    before, after = _BLANK[data[spaces - 1]], _BLANK[data[np.minimum(spaces + 1, len(data) - 1)]]
    cannot(spaces[(before & ~first[spaces]) | (after & ~first[spaces + 1])])
    wide = np.flatnonzero(_LEADS[data])
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        two = padded[wide] == 0xC2
        number = padded[wide] << 16 | padded[wide + 1] << 8 | np.where(two, 0, padded[wide + 2])
        blank = _WIDE[np.searchsorted(_WIDE, number).clip(max=len(_WIDE) - 1)] == number
        wide, ends = wide[blank], (wide + np.where(two, 2, 3))[blank]
        cannot(wide[first[ends] | (padded[ends] == 32) | (space[wide - 1] & ~first[wide])])
    return np.flatnonzero(first[:-1] | space), whole


class WordEncoder:
    """Token ids of texts. ``table`` is what one slice of texts leaves to the next."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = id_type(self.tokenizer.get_vocab_size())
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]
        self.begins[[k for token, k in vocabulary.items() if token.startswith(space)]] = True
        self.table, self.now = WordTable(self.kind), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in coded]

    def _spaced(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin with a space, one after the other, and how many each has."""
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        edges = bounds[np.minimum(np.arange(0, len(sizes) + WORDS_AT_ONCE, WORDS_AT_ONCE), len(sizes))]
        groups = [letters[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:])]
        ids, counts = [], []
        for group, coded in zip(groups, self._whole(groups)):
            words = group.count(" ")
            begins = np.flatnonzero(self.begins[coded])
            if any(content in group for content in self.added):
                # Words of different texts make up an added token that has a space in it.
                parts = self._whole([" " + word for word in group.split(" ")[1:]])
                coded, counted = np.concatenate(parts), np.array([len(part) for part in parts])
            elif len(begins) != words:
                raise ValueError("the tokenizer does not begin a piece at every space")
            else:
                counted = np.diff(begins, append=len(coded))
            ids.append(coded)
            counts.append(counted)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, data, starts, ends, hashes) -> np.ndarray:
        """Number of each word; those that the table has not are added, one of each hash."""
        numbers = self.table.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers
        _, first = np.unique(hashes[missing], return_index=True)
        new = missing[first]
        spaced = data[starts[new]] == 32
        for chosen, is_spaced in ((new[spaced], True), (new[~spaced], False)):
            if not len(chosen):
                continue
            sizes = (ends - starts)[chosen]
            letters = data[expand(starts[chosen], sizes)]
            if is_spaced:
                ids, counts = self._spaced(letters, sizes)
            else:
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                parts = self._whole([letters[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])])
                ids, counts = np.concatenate(parts), np.array([len(part) for part in parts])
            self.table.add(hashes[chosen], letters, sizes, ids, counts, self.now)
        numbers[missing] = self.table.find(hashes[missing])
        return numbers

    def _slice(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None):
        """Ids of the texts of a slice, and the offsets of the texts in them."""
        n_texts, table = len(offsets) - 1, self.table
        self.now += 1
        held = data.tobytes()
        starts, whole = cuts(data, offsets)
        for content in map(str.encode, self.added):
            at = held.find(content)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = held.find(content, at + 1)
        texts = np.searchsorted(offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(data))[:len(starts)]
        cut = ~whole[texts]
        starts, ends, texts = starts[cut], ends[cut], texts[cut]
        hashes = range_hashes(prefix_sums(data, BYTE_VALUES), starts, ends)
        numbers = self._learn(data, starts, ends, hashes)
        table.used.values[numbers] = self.now

        # Words of one hash are one word where their bytes are.
        sizes = ends - starts
        same = table.sizes.values[numbers] == sizes
        compared = np.flatnonzero(same)
        in_text = data[np.repeat(~whole, np.diff(offsets))] if same.all() else data[
            expand(starts[compared], sizes[compared])]
        unlike = table.letters.values[expand(table.starts.values[numbers[compared]], sizes[compared])] != in_text
        if unlike.any():
            same[np.repeat(compared, sizes[compared])[unlike]] = False
        if not same.all():
            whole[texts[~same]] = True
            kept = ~whole[texts]
            numbers, texts = numbers[kept], texts[kept]

        counts = table.counts.values[numbers]
        lengths = np.bincount(texts, counts, n_texts).astype(np.int64)
        places = np.flatnonzero(whole)
        coded = self._whole([held[offsets[k]:offsets[k + 1]].decode() for k in places])
        lengths[places] = [len(ids) for ids in coded]
        lengths += end_id is not None
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(bounds[-1], self.kind)
        if end_id is not None:
            out[bounds[1:] - 1] = end_id
        # Within its text a word's ids follow those of the words before it.
        before = np.cumsum(counts) - counts
        first_of_text = np.searchsorted(texts, np.arange(n_texts))
        base = bounds[:-1] - np.append(before, 0)[np.minimum(first_of_text, len(before))]
        out[expand(before + base[texts], counts)] = table.ids.values[expand(table.firsts.values[numbers], counts)]
        for place, ids in zip(places, coded):
            out[bounds[place]:bounds[place] + len(ids)] = ids

        if len(table) > CACHED_WORDS or table.letters.size > CACHED_BYTES:
            self.table = table.recent()
            if len(self.table) > CACHED_WORDS or self.table.letters.size > CACHED_BYTES:
                self.table = WordTable(self.kind)
        return out, bounds

    def encode(self, texts: pa.Array, end_id: int | None = None):
        """(first row, last row + 1, ids, offsets) for runs of the texts; null counts as empty, and each text ends in
        ``end_id`` where one is given."""
        for first, end, data, offsets in slices(texts, SLICE_BYTES):
            yield first, end, *self._slice(data, offsets, end_id)
