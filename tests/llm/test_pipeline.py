"""The pipeline's stages on the smallest tables."""

import os
import random
import sys
import time

import pytest

import corpus_pipeline
from crmkiln.llm import ngram_join, token_files
from crmkiln.llm.common import DOCUMENT_COLUMNS, ROW, keyed, shared_folder, table
from crmkiln.llm.queries import tokenizer_path


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(DOCUMENT_COLUMNS), name
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == counts[-1]


def test_empty_input(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_near_copies_by_five_words(spark, docs):
    words = [f"w{k}" for k in range(94)]
    other = [f"v{k}" if k in (30, 60) else word for k, word in enumerate(words)]
    rows = docs([(1, " ".join(words)), (2, " ".join(other)), (3, "something else")])
    left = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert {row.doc_id for row in left.collect()} == {1, 3}
    # The query's contract is four words and 0.85.
    assert {row.component_id for row in ngram_join.digests(rows).collect()} == {1, 2, 3}


def _near_copies(seed):
    """Texts of 1 to 120 words: groups of near copies, exact copies, a passage that many share, odd ones."""
    rand = random.Random(seed)
    passage = " ".join(f"common{k}" for k in range(40))
    texts = [None, "", " \t ", "one", "one", "one two three four five", "one two three four five six"]
    for group in range(20):
        words = [f"g{group}w{k}" for k in range(rand.randint(3, 120))]
        for _ in range(rand.randint(1, 4)):
            copy = list(words)
            for _ in range(rand.randint(0, 3)):
                copy[rand.randrange(len(copy))] = f"r{rand.random()}"
            texts.append(" ".join(copy) + (f" {passage}" if rand.random() < 0.4 else ""))
        texts.append(texts[-1])
    rand.shuffle(texts)
    return list(enumerate(texts))


def _components(rows, threshold, size):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").lower().split()
        sets[doc_id] = {tuple(words[k:k + size]) for k in range(max(len(words) - size + 1, min(len(words), 1)))}
    label = {doc_id: doc_id for doc_id in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("seed, probed", [(1, 0), (1, 30), (2, 100), (3, 30)])
def test_components_whatever_is_probed(docs, seed, probed):
    rows = _near_copies(seed)
    got = ngram_join.near_duplicates(keyed(docs(rows)), 80, 5, probed)
    assert {row.doc_id: row.component_id for row in got.collect()} == _components(rows, 80, 5)


def test_sets_with_lone_tokens_are_not_indexed(docs, monkeypatch):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(300))) for k in range(30)]
    rows.append((30, rows[7][1] + " more"))
    entries, indexed = [], ngram_join.index_entries

    def counted(texts, *rest):
        found = indexed(texts, *rest)
        entries.append((texts.select(ROW).collect(), found.count()))
        return found

    monkeypatch.setattr(ngram_join, "index_entries", counted)
    left = corpus_pipeline.drop_near_duplicates(docs([]).sparkSession, docs(rows), "")
    assert {row.doc_id for row in left.collect()} == set(range(30))
    (kept, n_entries), = entries
    assert {row[0] for row in kept} == {7, 30}
    # Before, the index had more entries than the sets have tokens.
    assert n_entries < sum(len(text.split()) - 4 for _, text in rows) / 4


def test_keys_with_the_same_nodes_are_compared_once(docs, monkeypatch):
    # Two texts that share most of their shingles and yet are not linked share many keys.
    words = [f"w{k}" for k in range(200)]
    other = words[:170] + [f"v{k}" for k in range(30)]
    opened, keep = [], ngram_join.saved

    def noted(frame, name):
        found = keep(frame, name)
        if name == "open":
            opened.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "saved", noted)
    rows = docs([(1, " ".join(words)), (2, " ".join(other))])
    got = ngram_join.near_duplicates(keyed(rows), 80, 5)
    assert {row.component_id for row in got.collect()} == {1, 2}
    assert opened == [2]


def test_near_duplicates_leave_only_the_rows_to_keep(docs, tmp_path):
    rows = docs(_near_copies(4))
    spark = rows.sparkSession
    root = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root))
    left = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    new = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before if not name.startswith(".")}
    assert new == {"firsts"}
    firsts = set(_components(_near_copies(4), 80, 5).values())
    assert {row.doc_id for row in left.collect()} == firsts


def test_encoder_goes_soon_after_its_last_use(docs):
    rows = docs([(1, "some words"), (2, "more words")])

    def held(batches):
        import pyarrow as pa
        for _ in batches:
            pass
        names = [x for x in sys.modules.get("crmkiln_encoders", sys).__dict__ if str(x).endswith(".json")]
        yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    assert token_files.token_digests(rows, tokenizer_path()).count() == 2
    time.sleep(5)
    assert all(row.n == 0 for row in rows.select("doc_id").mapInArrow(held, "n long").collect())
