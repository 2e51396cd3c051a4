"""Operator 13 against brute force, and its defined cases."""

import collections
import random
import re
import zlib

import pytest

from crmkiln.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def at_one_edit(s, t):
    if len(s) > len(t):
        s, t = t, s
    if len(s) == len(t):
        return sum(a != b for a, b in zip(s, t)) == 1
    return len(t) == len(s) + 1 and any(t[:k] + t[k + 1:] == s for k in range(len(t)))


def grouped(words):
    found = {}
    for word, n in words.items():
        near = [other for other in words if at_one_edit(word, other)]
        best = min(near, key=lambda other: (-words[other], other), default=None)
        found[word] = (n, len(near), best if near and words[best] >= 5 * n else None)
    rows = set()
    for word, (n, n_near, form) in found.items():
        root = word
        while found[root][2] is not None:
            root = found[root][2]
        rows.add((word, form, root, n, n_near, words.get(form)))
    return rows


def variants_of(seed, words, letters):
    rng = random.Random(seed)
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 11, 20]))) for _ in range(words)]
    found = {}
    for base in bases:
        found[base] = rng.choice([400, 60, 9, 5])
        for _ in range(rng.randint(0, 4)):
            word, place = rng.choice(list(found)[-3:]), 0
            place = rng.randrange(len(word) + 1)
            word = rng.choice([word[:place] + rng.choice(letters) + word[place:], word[:place] + word[place + 1:],
                               word[:place] + rng.choice(letters) + word[place + 1:]])
            found[word] = rng.choice([70, 12, 5, 5, 4])
    return found


@pytest.mark.parametrize("letters", ["ab", "abcdefghéÿ"])
@pytest.mark.parametrize("crowded", [0, 30, 20_000])
def test_groups_of_variants(spark, docs, letters, crowded):
    chosen = variants_of(len(letters), 40, letters)
    rng, rows = random.Random(1), []
    tokens = [word for word, n in chosen.items() for _ in range(n)]
    rng.shuffle(tokens)
    for k in range(0, len(tokens), 50):
        rows.append((k, rng.choice([" ", ", ", "\n", "9"]).join(tokens[k:k + 50])))
    got = spelling.variants(docs(rows), crowded)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(row) for row in got.collect()]
    assert len(got) == len(set(got)) and set(got) == grouped(counted(rows))
    assert any(row[1] for row in got) and any(row[4] > 1 for row in got)


def test_deleted_code_points_and_chains(docs):
    # A chain of three forms, upper-case letters outside A-Z, and a run that some ids shorten.
    rows = [(k, "abcdefg " * 4 + "Ététété ABCDEFG") for k in range(800)]
    rows += [(2000 + k, "abcdefx") for k in range(100)] + [(3000 + k, "abcdex") for k in range(7)]
    want = grouped(counted(rows))
    assert {row[0] for row in want} >= {"abcdefg", "abcdefx", "abcdex"} and any(len(row[0]) == 6 for row in want)
    assert {row[0]: row[2] for row in want}["abcdex"] == "abcdefg"
    assert {tuple(row) for row in spelling.variants(docs(rows)).collect()} == want


def test_one_key_with_most_words(spark, docs):
    # All words begin alike, and so share a chunk; few are near each other.
    rng = random.Random(2)
    words = {"begins" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)}
    words |= {word[:-1] for word in sorted(words)[:30]}
    rows = [(k, " ".join(sorted(words))) for k in range(5)]
    for crowded in (100, 20_000):
        assert {tuple(row) for row in spelling.variants(docs(rows), crowded).collect()} == grouped(counted(rows))


def test_odd_rows(odd, empty, docs):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(odd).count() == 0
    long = "x" * 30_000
    rows = [(None, f"{long} {long}y"), (1, None), (2, ""), (4, f"{long} {long}y")] + [(3, f"{long} {long}y")] * 4
    assert {tuple(row) for row in spelling.variants(docs(rows)).collect()} == grouped(counted(rows))
