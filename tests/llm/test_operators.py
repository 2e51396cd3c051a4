"""The operators against brute force on small tables, and their defined cases."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from crmkiln.llm import (
    decontaminate, language_id, license_scan, mixing, ngram_join, pii, quality_rules, substring_dedup,
    suffix_dedup, token_files, word_cache,
)
from crmkiln.llm.common import DOCUMENT_COLUMNS
from crmkiln.llm.queries import tokenizer_path

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def noisy_copies(seed, sizes, copies=12):
    """Families of near copies of random word lists."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randint(0, 300)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, size // 30 + 1])):
                place = rng.randrange(len(words)) if words else 0
                words[place:place + 1] = rng.choice([[], ["new"], ["y", "z"]])
            rows.append((len(rows) + 10, " ".join(words)))
    return rows


def test_tokens_round_trip(spark, docs):
    texts = [(9, "Hello  world's\n\nend "), (3, None), (7, "A b. Über, " * 50), (5, "<|endoftext|>")]
    got = token_files.token_digests(docs(texts), tokenizer_path()).orderBy("start").collect()
    tokenizer = token_files.WordEncoder(tokenizer_path()).tokenizer
    start = 0
    for row, (doc_id, text) in zip(got, sorted(texts)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_are_those_of_the_library(spark, docs):
    from tokenizers import Tokenizer

    texts = [(1, "one <|endoftext|> two"), (2, "a b"), (3, "x<|endoftext|><|endoftext|>"), (4, "<| endoftext |> one two")]
    got = token_files.token_digests(docs(texts), tokenizer_path()).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert 50256 in tokenizer.encode(texts[0][1], add_special_tokens=False).ids
    start = 0
    for row, (doc_id, text) in zip(got, texts, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def library_rows(texts):
    """What the contract says of (doc_id, text) pairs with distinct ids, by the library alone."""
    from tokenizers import Tokenizer

    tokenizer, start, rows = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in sorted(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_token_files_with_documents_longer_than_a_block(spark, docs, tmp_path):
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choice(["ab", "the", "Éa", "x1"]) for _ in range(rng.choice([0, 3, 99, 100, 101, 450]))))
             for k in range(40)]
    token_files.write_tokens(docs(texts), f"{tmp_path}/t", tokenizer_path(), block_ids=100)
    want = library_rows(texts)
    assert [tuple(row) for row in token_files.read_digests(spark, f"{tmp_path}/t").orderBy("start").collect()] == want
    blocks = spark.read.parquet(f"{tmp_path}/t/blocks").collect()
    assert max(row.n_ids for row in blocks) <= 100 and max(row.part or 0 for row in blocks) >= 4
    tokens = token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [(row.doc_id, row.start, row.n_tokens, zlib.crc32(np.frombuffer(row.ids, "<u4").tobytes())) for row in tokens] == want


def test_crc32_of_joined_texts():
    rng = random.Random(9)
    for _ in range(50):
        a, b = (rng.randbytes(rng.choice([0, 1, 5, 1000])) for _ in range(2))
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_word_encoder_on_odd_white_space(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(word_cache, "CACHED_WORDS", 60)
    rng = random.Random(10)
    parts = [" ", " ", "  ", "a", "b", "\n", " \n", "\u2003", "\u3000", "\xa0", "é", "'s", "1", "<|endoftext|>", "!", "\t",
             "\x85", "\x1c", " x", " yé", "ß", "\0", "木"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [None, "", " ", "long" * 900]
    tokenizer, got = Tokenizer.from_file(tokenizer_path()), []
    encoder = word_cache.WordEncoder(tokenizer_path())
    for first in range(0, len(texts), 500):
        for _, _, ids, bounds in encoder.encode(pa.array(texts[first:first + 500], pa.string())):
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert len(encoder.table) < 1000


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    # Hashes of a few bits: nearly all words share theirs with others.
    true = word_cache.range_hashes
    monkeypatch.setattr(word_cache, "range_hashes", lambda *a: true(*a) & np.uint64(7))
    texts = ["one two three", "four five", "six", "one two", "ten eleven twelve", "one"]
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), word_cache.WordEncoder(tokenizer_path())
    for _, _, ids, bounds in encoder.encode(pa.array(texts), 0):
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [tokenizer.encode(text).ids + [0] for text in texts]


def test_codes_are_limited_complete_and_decodable():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765])
    lengths = token_files.code_lengths(counts, 8)
    assert lengths[0] == 0 and lengths[1:].max() == 8
    assert sum(2.0 ** -float(x) for x in lengths[1:]) == 1.0
    lengths = token_files.code_lengths(counts)
    ids = np.random.default_rng(1).integers(1, len(counts), 1000)
    bits, checkpoints = token_files.encode_block(ids, token_files.canonical_codes(lengths), lengths)
    for n in (1, 64, 65, 1000):
        bits, checkpoints = token_files.encode_block(ids[:n], token_files.canonical_codes(lengths), lengths)
        assert (token_files.decode_block(bits, checkpoints, n, token_files.decode_table(lengths)) == ids[:n]).all()


def test_licences(docs):
    text = "X Under-the MIT  License. under the mit license; CC BY-NC SA 4.0 SPDX-License-Identifier: GPL-3.0-only"
    row = license_scan.scanned(docs([(1, text)])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (22, 3, 1, 9, "cc-by-nc,mit")
    assert set(row.labels.split(",")) == {"cc-by-nc", "cc-by-nc-sa", "gpl-3", "mit"} and row.score == 1.0
    assert 200 <= len(license_scan.rules())


def test_licences_pass_the_gate_and_have_a_key():
    keys = {}
    for key, label, *_ in license_scan.rules():
        keys.setdefault(label, set()).add(key)
    for label, (_, identifier, name) in license_scan.LICENSES.items():
        for priority, form in license_scan.FORMS:
            for text in license_scan.spellings(identifier if priority == 0 else name):
                assert re.fullmatch(identifier if priority == 0 else name, text) and keys[label] & set(text.split()), text
    for _, form in license_scan.FORMS:
        for text in license_scan.spellings(form.format(identifier="mit", name="mit").replace("(?= )", "")):
            assert re.search(license_scan._GATE, text), text


def test_licences_in_all_spellings(docs):
    texts = {
        "released under MIT": "mit", "Distributed under GPL v3": "gpl-3", "available under BSD 3-Clause": "bsd-3",
        "provided to you under MPL 2.0": "mpl-2", "AGPLv3 license": "agpl-3", "agpl3 license": "agpl-3",
        "LGPLv2 license": "lgpl-2.1", "lgplv3 licence": "lgpl-3", "lgpl3 license": "lgpl-3", "gpl2 license": "gpl-2",
        "GPL3 License": "gpl-3", "Q Public License licence": "qpl-1", "shared under Responsible AI License": "openrail",
        "epl2 license": "epl-2", "license identifier IPL-1.0": "ipl-1",
    }
    rows = license_scan.scanned(docs(list(enumerate(texts)))).collect()
    got = {row.doc_id: (row.labels, row.score > 0) for row in rows}
    assert got == {k: (label, True) for k, label in enumerate(texts.values())}


def test_personal_data(docs):
    text = "a@b.c-x@d.e 1.2.3.4.5 999.1.2.3 card 4111 1111 1111 1111 +1 (234) 567-8901 é😀 q@w.e"
    row = pii.digests(docs([(1, text)])).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (2, 1, 1, 1)
    want = "email:0:7,ip:12:19,card:37:56,phone:57:74,email:78:83"
    assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and row.spans == want


def test_personal_data_in_long_runs(docs):
    rows = [(1, "7 " * 6000 + "x 4111 1111 1111 1111"), (2, "a@b" + ".c" * 6000 + " 1.2.3.4")]
    got = {row.doc_id: row.spans for row in pii.digests(docs(rows)).collect()}
    assert got == {1: "card:12002:12021", 2: "email:0:12003,ip:12004:12011"}


def test_personal_data_discovered_by_context(docs):
    rows = [(k, f"phone: +1 234 567 {k:04d} ok") for k in range(60)] + [(100, "phone: 55-99-22 ok"), (101, "no 55")]
    got = {row.doc_id: row.spans for row in pii.digests(docs(rows)).collect()}
    assert got[100] == "phone:7:15" and got[101] == ""


def test_personal_data_has_the_shape_of_its_kind(docs):
    rows = [(k, f"tel +1 234 567 {k:04d} ok") for k in range(60)]
    rows += [(100, "tel 2024 was a good year"), (101, "tel 555-9830 ok"), (102, "tel room7b555983 ok")]
    got = {row.doc_id: row.spans for row in pii.digests(docs(rows)).collect()}
    assert got[100] == "" and got[101] == "phone:4:12" and got[102] == ""


def test_words_before_a_candidate_may_be_candidates(docs):
    rows = [(k, f"ext 2 +1 234 567 {k:04d} ok") for k in range(60)] + [(100, "ext 2 55-99-22 ok")]
    got = {row.doc_id: row.spans for row in pii.digests(docs(rows)).collect()}
    assert got[100] == "phone:6:14"


def test_secrets_are_found_and_lead_to_shorter_ones(docs):
    digest = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(40)]
    rows = [(k, f'so token = "{word}" it') for k, word in enumerate(digest)]
    rows += [(100, "so token = k3y9xq71 it"), (101, "a" * 40 + " " + "7" * 40), (102, "so token = nothing it")]
    got = {row.doc_id: row for row in pii.digests(docs(rows)).collect()}
    assert got[0].spans == "secret:12:52" and got[0].n_spans == 1
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[100].spans == "secret:11:19" and got[101].spans == "" and got[102].spans == ""


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    """The base spans of a text by plain regular expressions: (start, rank, end)."""
    for rank, (kind, pattern) in enumerate(BASE):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            if {
                "email": True,
                "ip": kind != "ip" or all(int(part) <= 255 for part in match[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]:
                yield match.start(), rank, match.end()


def test_base_spans_are_those_of_plain_expressions(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {row.doc_id: row.text for row in frame.collect()}
    for row in pii.digests(frame).collect():
        found = sorted(base_spans(texts[row.doc_id]))
        want = [f"{BASE[rank][0]}:{start}:{end}" for start, rank, end in found]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(
            sum(rank == k for _, rank, _ in found) for k in range(4))
        assert set(want) <= set(row.spans.split(",")) or not want


def test_personal_data_in_a_text_of_many_matches(docs):
    one = "".join(f"user{k}@mail.example.com call +1 234 567 {k % 10000:04d} or {k} " for k in range(12000))
    started = time.monotonic()
    row = pii.digests(docs([(1, one)])).first()
    assert (row.n_email, row.n_phone) == (12000, 12000)
    assert time.monotonic() - started < 90  # growing arrays one by one takes many times that


def test_personal_data_of_many_patterns(docs):
    names = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)] + [f"z{x}" for x in "abcdefgh"]
    rows = [(k * 10 + n, f"{name} +1 234 {k:03d} {n:04d} ok") for k, name in enumerate(names) for n in range(5)]
    rows += [(k * 10 + 9, f"{name} 55-99-22 ok") for k, name in enumerate(names)]
    got = {row.doc_id: row.spans for row in pii.digests(docs(rows)).where("doc_id % 10 = 9").collect()}
    assert got == {k * 10 + 9: f"phone:{len(name) + 1}:{len(name) + 9}" for k, name in enumerate(names)}


def test_byte_repeats(docs):
    rows = noisy_copies(1, (60, 90), 8) + [(1, "a" * 500), (2, None), (3, "q" * 199), (4, "é" * 120)]
    counts = collections.Counter()
    held = {doc_id: (text or "").encode() for doc_id, text in rows}
    for data in held.values():
        counts.update(data[k:k + 200] for k in range(len(data) - 199))
    for row in suffix_dedup.digests(docs(rows)).collect():
        data = held[row.doc_id]
        gone = bytearray(len(data))
        for k in range(len(data) - 199):
            if counts[data[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(x for x, out in zip(data, gone) if not out)
        assert tuple(row) == (row.doc_id, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                              hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("group", [20_000, 3])
def test_word_repeats(docs, group):
    rows = noisy_copies(2, (25, 60), 8) + [(1, "a " * 100), (2, None)]
    first, wanted = {}, {}
    for doc_id, text in sorted(rows):
        words = SPACED.findall(text or "")
        gone = set()
        for k in range(len(words) - 19):
            if first.setdefault(tuple(words[k:k + 20]), (doc_id, k)) != (doc_id, k):
                gone.update(range(k, k + 20))
        wanted[doc_id] = gone
    found = collections.defaultdict(set)
    windows = substring_dedup.repeated_windows(substring_dedup.keyed(docs(rows)), group=group)
    for row in windows.collect():
        size = len(SPACED.findall(dict(rows)[row["__row"]] or ""))
        found[row["__row"]] |= set(range(size)) if row.pos < 0 else set(range(row.pos, row.pos + row.n + 19))
    assert {k: v for k, v in wanted.items() if v} == found


def test_mix_meets_targets(docs):
    rows = [(k, "w " * (20 + k % 50)) for k in range(300)]
    parts = [docs(rows[k::3], source=name) for k, name in enumerate(["b", "a", None])]
    got = mixing.taken(parts[0].union(parts[1]).union(parts[2])).collect()
    total = sum(row["size"] for row in got)
    by_source = collections.defaultdict(list)
    for row in got:
        assert row.taken <= 2 * row["size"]
        by_source[row.source].append(row)
    level = 1.5 * total / 6
    for source, weight in (("a", 3), ("b", 1), (None, 2)):
        own = by_source[source]
        assert own[0].target <= 2 * own[0].source_size + 1e-6
        assert abs(sum(row.taken for row in own) - own[0].target) <= 128
    assert abs(sum(own[0].target for own in by_source.values()) - 1.5 * total) < 1e-6
    assert by_source["b"][0].target >= level - 1e-6


def skewed_sources(docs):
    """Three sources whose documents are from one word to a third of the source; ids far apart."""
    rng = random.Random(8)
    sizes = [1, 3, 20, 127, 128, 129, 700, 4000, *[rng.randrange(400) for _ in range(60)]]
    parts = [docs([(rng.randrange(1 << 60), "\n".join(f"{name}{k}-{i} " for i in range(n))) for k, n in enumerate(sizes)],
                  source=name) for name in "abc"]
    return parts[0].union(parts[1]).union(parts[2])


def test_mixed_documents_meet_targets_with_skewed_lengths(docs):
    frame = skewed_sources(docs)
    texts = {row.doc_id: row.text for row in frame.collect()}
    wanted = {row.source: row.target for row in mixing.taken(frame).select("source", "target").distinct().collect()}
    found, whole = collections.Counter(), 0
    for row in mixing.mixed_documents(frame, DOCUMENT_COLUMNS).collect():
        assert row.text in texts[row.doc_id] and row.n_chars == len(row.text)
        whole += row.text == texts[row.doc_id]
        # A word occurs once in its text, so pieces of a row never hold one more often than twice.
        found.update(SPACED.findall(row.text))
    assert max(found.values()) == 2 and whole > 60
    per_source = collections.Counter()
    for word, n in found.items():
        per_source[word[0]] += n
    for source, target in wanted.items():
        assert abs(per_source[source] - target) <= mixing.STAGE_BLOCK_WORDS


def test_packed_slots_hold_what_is_taken(docs):
    frame = skewed_sources(docs)
    slots = mixing.packed(frame).collect()
    taken = {row.doc_id: row.taken for row in mixing.taken(frame).collect()}
    held = collections.Counter()
    for row in slots:
        words = [(piece.doc_id, word) for piece in row.pieces for word in SPACED.findall(piece.text)]
        assert len(words) == row.n_words <= mixing.BLOCK_WORDS and all(word[0] == row.source for _, word in words)
        held.update(doc_id for doc_id, _ in words)
    assert {k: n for k, n in taken.items() if n} == dict(held)
    assert len({(row.source, row.slot) for row in slots}) == len(slots)


def test_slots_are_dealt_to_shards_by_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 200)
    sources = spark.createDataFrame([(0, 64_000, 96_000.0), (1, 64_000, 32_000.0)], "rank int, source_size long, target double")
    counts = collections.Counter((row.shard, row["rank"]) for row in mixing.slots(sources).collect())
    shards = {shard for shard, _ in counts}
    assert len(shards) == 11 and sum(counts.values()) == 2000
    # Counts are drawn: they spread about the mean as multinomial ones do, and are not all the same.
    for k, mean in ((0, 1500 / 11), (1, 500 / 11)):
        own = [counts[shard, k] for shard in shards]
        assert len(set(own)) > 3 and all(abs(n - mean) < 5 * mean ** 0.5 for n in own)


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_places_are_one_stream_whatever_the_ids(docs, scale):
    frame = docs([(k * scale, "w " * (k % 7)) for k in range(500)] + [(None, "w")] * 3, source="a")
    rows, _ = mixing.stream(frame)
    at = 0
    for row in sorted(rows.where("size > 0").collect(), key=lambda row: row.start):
        assert row.start == at
        at += row["size"]
    assert at == sum(k % 7 for k in range(500)) + 3


def test_near_duplicates(docs):
    rows = noisy_copies(3, (3, 8, 10, 15, 40, 120)) + [(1, None), (2, "  "), (3, "A b"), (4, "a B")]
    sets, groups = {}, {doc_id: doc_id for doc_id, _ in rows}
    for doc_id, text in rows:
        words = SPACED.findall((text or "").translate(LOWER))
        sets[doc_id] = {tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set()

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                groups[high] = low
    got = {tuple(row) for row in ngram_join.digests(docs(rows)).collect()}
    assert got == {(k, len(sets[k]), root(k)) for k in sets}


def test_decontamination(spark, docs, monkeypatch):
    item = " ".join(f"t{k}" for k in range(30))
    benchmark = spark.createDataFrame(
        [(7, item), (7, item), (8, "Short Item"), (9, None), (None, "no name here"), (10, item[:60])], "item_id long, text string")
    rows = [(1, "x " + item[30:] + " y"), (2, "a short, ITEM b"), (3, "clean"), (4, None), (5, "no name here")]
    want = None
    for words in (500_000, 31):  # one automaton, several
        monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", words)
        got = sorted(map(tuple, decontaminate.judged(decontaminate.benchmark_hits(docs(rows), benchmark)).collect()))
        want = want or got
        assert got == want
    by_id = {row[0]: row for row in want}
    assert by_id[2][1:4] == (4, 2, 1) and by_id[2][5]
    assert by_id[1][3] == 1 and by_id[3][5] is False and by_id[4][1] == 0 and by_id[5][2:4] == (3, 0)


def test_benchmark_passages_are_cut_out(spark, docs):
    item = " ".join(f"t{k}" for k in range(30))
    benchmark = spark.createDataFrame([(7, item), (8, "Short Item")], "item_id long, text string")
    long = "é x, " * 400
    rows = [(1, f"{long}{item}. A SHORT-item! {long}"), (2, item), (3, long), (4, None), (5, " ".join(item.split()[:20]) + " " + long * 2)]
    got = {row.doc_id: (row.text, row.n_chars) for row in decontaminate.clean_documents(
        docs(rows), benchmark, DOCUMENT_COLUMNS).collect()}
    want = {1: f"{long}. A ! {long}", 3: long, 4: None, 5: " " + long * 2}
    assert got == {k: (text, len(text or "")) for k, text in want.items()}


def test_benchmark_items_longer_than_an_automaton(spark, docs, monkeypatch):
    item = [f"t{k}" for k in range(100)]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = [(k, "x " + " ".join(item[k:k + 13]) + " y") for k in range(88)] + [(200, " ".join(item[50:62]))]
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 31)
    got = {row.doc_id: (row.n_hit, row.n_items) for row in decontaminate.judged(
        decontaminate.benchmark_hits(docs(rows), benchmark)).collect()}
    assert got == {**{k: (13, 1) for k in range(88)}, 200: (0, 0)}


def test_quality_bounds():
    # Zero failures: the bound solves (1 - p)**n = error.
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    assert abs(quality_rules.upper_bound(3, 50, 0.05) - 0.14783) < 1e-4
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_quality_rules_find_proven_cutoffs(spark, docs):
    good = " ".join(f"word{k}" for k in range(80))
    bad = " ".join(f"word{k}" if k % 2 else f"###{k}" for k in range(80))
    rows = [(k, good + f" {k}") for k in range(1500)] + [(k, bad + f" {k}") for k in range(1500, 1600)]
    labels = spark.createDataFrame([(k, 1 if k < 1500 else 0) for k in range(1600)], "doc_id long, quality long")
    got = {row.doc_id: row for row in quality_rules.verdicts(docs(rows), labels).collect()}
    assert all(got[k].kept for k in range(1500)) and not any(got[k].kept for k in range(1500, 1600))


def test_language(spark, docs):
    rng = random.Random(5)
    words = {"xx": ["schlo", "grund", "zwerg"], "yy": ["aloha", "oia", "uea"]}
    rows = [(k, " ".join(rng.choice(words[lang]) + rng.choice("ab") for _ in range(30)), lang)
            for k, lang in enumerate(["xx", "yy"] * 60)]
    frame = docs([r[:2] for r in rows if r[2] == "xx"], lang="xx").union(
        docs([r[:2] for r in rows if r[2] == "yy"], lang="yy")).union(docs([(900, None), (901, "12 .")]))
    got = {row.doc_id: row for row in language_id.identified(frame).collect()}
    for doc_id, _, lang in rows:
        assert got[doc_id].lang_pred == lang and got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
    assert {got[k].lang_pred for k in (900, 901)} == {"und"} and got[901].score == 0 and got[900].rejected


def _run(spark, name, frame):
    benchmark = spark.createDataFrame([(1, "same row")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1), (5, None), (5, 1)], "doc_id long, quality long")
    return {
        "tokens": lambda: token_files.token_digests(frame, tokenizer_path()),
        "licences": lambda: license_scan.scanned(frame),
        "language": lambda: language_id.identified(frame),
        "pii": lambda: pii.digests(frame),
        "bytes": lambda: suffix_dedup.digests(frame),
        "mix": lambda: mixing.taken(frame),
        "mixed": lambda: mixing.mixed_documents(frame, DOCUMENT_COLUMNS),
        "packed": lambda: mixing.packed(frame),
        "words": lambda: substring_dedup.digests(frame),
        "join": lambda: ngram_join.digests(frame),
        "benchmark": lambda: decontaminate.judged(decontaminate.benchmark_hits(frame, benchmark)),
        "quality": lambda: quality_rules.verdicts(frame, labels),
    }[name]()


NAMES = ["tokens", "licences", "language", "pii", "bytes", "mix", "words", "join", "benchmark", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    """One result per row whatever the rows, and the same when run again; none for no rows."""
    once = sorted(map(repr, _run(spark, name, odd).collect()))
    assert len(once) == odd.count() and once == sorted(map(repr, _run(spark, name, odd).collect()))
    assert _run(spark, name, empty).collect() == []


@pytest.mark.parametrize("name", ["mixed", "packed"])
def test_mix_of_odd_rows(spark, odd, empty, name):
    once = sorted(map(repr, _run(spark, name, odd).collect()))
    assert once and once == sorted(map(repr, _run(spark, name, odd).collect()))
    assert _run(spark, name, empty).collect() == []
