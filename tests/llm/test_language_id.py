"""Scores of long runs of texts, in bounded memory."""

import tracemalloc

import numpy as np

from crmkiln.llm import language_id


def _model(rand, languages=12):
    table = language_id.symbol_table([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    arrays = {}
    for order in range(1, language_id.ORDER + 1):
        for what in (0, 1):
            for column in range(languages):
                grams = np.unique(rand.integers(0, 27 ** min(order, 3), 400).astype(np.uint32))
                arrays.setdefault((order, what), []).append((column, grams, rand.uniform(0.01, 1, len(grams))))
    return language_id.LanguageModel([f"l{k}" for k in range(languages)], table, arrays)


def _run(rand, n):
    points = rand.choice(np.array([ord(c) for c in "abcdefgh xyz"], np.uint32), n)
    return points, np.concatenate([[0, 0], np.sort(rand.integers(0, n, 50)), [n, n]])


def test_pieces_give_the_same_scores():
    rand = np.random.default_rng(1)
    model = _model(rand)
    points, offsets = _run(rand, 200_000)
    entropies, letters = model.entropies(points, offsets)
    found, bounds = language_id.keys(points, offsets, model.table)
    sums = np.zeros((len(found) + 1, len(model.languages)))
    np.cumsum(model.scores(found), axis=0, out=sums[1:])
    assert len(found) > 2 * language_id.KEYS_AT_ONCE
    expected = -(sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
    assert np.array_equal(entropies, expected)
    assert letters.sum() == (points != ord(" ")).sum()


def test_memory_of_a_run_of_texts():
    rand = np.random.default_rng(2)
    model = _model(rand)
    points, offsets = _run(rand, 1 << 20)
    model.entropies(*_run(rand, 100))
    tracemalloc.start()
    model.entropies(points, offsets)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100e6, peak
