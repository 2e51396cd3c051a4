"""The contracts' columns of op2, op7, op9 and op10 against plain Python, over all documents of the smallest tables
and rows of odd forms."""

import collections
import hashlib
import re

import pytest

from crmkiln.llm import decontaminate, license_scan, quality_rules, substring_dedup
from crmkiln.llm.common import table

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LONG = " ".join(f"w{k % 37}" for k in range(400))
EXTRA = [
    (900001, None), (900002, ""), (900003, " \n\t"), (900004, "Under the MIT  License, under-the-mit/license. CC BY\nNC"),
    (900005, "cc by nc " * 300 + "Apache License, Version 2.0"), (900006, "a b c " * 60 + "\n#* <x> | $5 & 3%\n#* <x> | $5 & 3%"),
    (900007, LONG), (900008, "x " + LONG + " y"), (900009, "é😀 Ünï a b " * 30), (900010, "line\n\nline\n line\nline "),
]


def words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def places(sequence, phrase):
    n = len(phrase)
    return [k for k in range(len(sequence) - n + 1) if sequence[k:k + n] == phrase]


@pytest.fixture(scope="module")
def every(spark, sf_dir):
    """All documents and the extra rows: the frame, and its (doc_id, text) in order."""
    docs = table(spark, sf_dir, "documents")
    extra = spark.createDataFrame([(k, text, None, None, None) for k, text in EXTRA],
                                  "doc_id long, text string, lang string, source string, n_chars int")
    frame = docs.unionByName(extra)
    return frame, sorted((row.doc_id, row.text) for row in frame.select("doc_id", "text").collect())


def test_licences_base(every):
    frame, texts = every
    got = {row.doc_id: row for row in license_scan.scanned(frame).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        sequence = words(ALNUM, text)
        found = {label: places(sequence, phrase.split()) for phrase, label in PHRASES.items()}
        starts = sorted(k for ks in found.values() for k in ks)
        labels = sorted(label for label, ks in found.items() if ks)
        row = got[doc_id]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (
            len(sequence), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels))
        own = row.labels.split(",") if row.labels else []
        assert own == sorted(set(own)) and set(labels) <= set(own) and 0 <= row.score <= 1


def test_word_windows(every):
    frame, texts = every
    seen, gone = set(), {}
    for doc_id, text in texts:
        sequence, removed = SPACED.findall(text or ""), set()
        for k in range(len(sequence) - 19):
            window = tuple(sequence[k:k + 20])
            if window in seen:
                removed |= set(range(k, k + 20))
            seen.add(window)
        kept = " ".join(word for k, word in enumerate(sequence) if k not in removed)
        gone[doc_id] = (len(sequence), len(removed), hashlib.sha256(kept.encode()).hexdigest())
    assert any(n for _, n, _ in gone.values())
    assert {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256)
            for row in substring_dedup.digests(frame).collect()} == gone


def test_benchmark_hits(spark, sf_dir, every):
    frame, texts = every
    items = table(spark, sf_dir, "benchmark")
    first = words(ALNUM, next(text for _, text in texts if len(words(ALNUM, text)) > 40))
    more = spark.createDataFrame([
        ("zz1", " ".join(first[5:25])), ("zz2", " ".join(first[3:6])), ("zz3", None), ("zz4", "...")],
        "item_id string, text string")
    items = items.select(items["item_id"].cast("string").alias("item_id"), "text").unionByName(more)
    windows = collections.defaultdict(set)
    for row in items.collect():
        sequence = words(ALNUM, row.text)
        for k in range(max(1, len(sequence) - 12)) if sequence else ():
            windows[tuple(sequence[k:k + 13])].add(row.item_id)
    sizes = {len(window) for window in windows}
    wanted = {}
    for doc_id, text in texts:
        sequence, hit, found = words(ALNUM, text), set(), set()
        for n in sizes:
            for k in range(len(sequence) - n + 1):
                owners = windows.get(tuple(sequence[k:k + n]))
                if owners:
                    hit |= set(range(k, k + n))
                    found |= owners
        wanted[doc_id] = (
            len(sequence), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(sequence))
    got = decontaminate.judged(decontaminate.benchmark_hits(frame, items)).collect()
    assert any(n for _, n, _, _, _ in wanted.values())
    assert {row.doc_id: (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) for row in got} == wanted


def test_quality_counts(spark, sf_dir, every):
    frame, texts = every
    wanted = {}
    for doc_id, text in texts:
        sequence = SPACED.findall(text or "")
        triples = collections.Counter(tuple(sequence[k:k + 3]) for k in range(len(sequence) - 2))
        covered = {j for k in range(len(sequence) - 2) if triples[tuple(sequence[k:k + 3])] > 1 for j in range(k, k + 3)}
        lines = [line for line in (text or "").split("\n") if SPACED.search(line)]
        n, repeats = len(sequence), len(covered)
        wanted[doc_id] = (n, sum(map(len, sequence)), len(re.findall(r"[#*$%&|<>]", text or "")),
                          len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n)
    got = quality_rules.verdicts(frame, table(spark, sf_dir, "labels")).collect()
    assert {row.doc_id: (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
            for row in got} == wanted
    assert not any(row.kept and row.base_failed for row in got)
