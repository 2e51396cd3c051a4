"""Operator 11: what the factorization machine learns, and its defined cases."""

import random
import zlib

import numpy as np
import pytest

from crmkiln.llm import toxicity
from crmkiln.llm.common import table

LABELS = "doc_id long, quality int, toxic int, text string, n long"


def labels_of(spark, pairs):
    return spark.createDataFrame([(k, 1, toxic, "clash", 7) for k, toxic in pairs], LABELS)


def made(seed, n, toxic_of):
    rng = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        words = [f"w{rng.randint(0, 2000)}" for _ in range(rng.randint(5, 60))]
        held = {word for word in ("insult", "group", "slur") if rng.random() < 0.3}
        rows.append((k, " ".join(rng.sample(words + sorted(held), len(words) + len(held)))))
        marks.append((k, int(toxic_of(held))))
    return rows, marks


def held_out(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_terms_of_texts():
    data = "Ab aB cÉ! cé É ab".encode()
    texts, terms = toxicity.text_terms(np.frombuffer(data, np.uint8), np.array([0, 5, len(data)]))
    # A-Z only are lower-cased: "ab" | "cÉ", "cé", "É", "ab"
    assert texts.tolist() == [0, 1, 1, 1, 1] and terms[0] in terms[1:] and len(set(terms.tolist())) == 4


def test_gradient_is_that_of_the_likelihood(spark):
    rng = np.random.default_rng(5)
    model = toxicity.Model(np.arange(6), -0.5, rng.normal(size=6), rng.normal(size=(6, 3)))
    sets = [([0, 2, 5], 4, 1), ([], 3, 1), ([1, 2, 3, 4], 2, 2)]
    frame = spark.createDataFrame(sets, "places array<int>, n long, toxic long").repartition(2)

    def loss(bias, weights, factors):
        total = 0.0
        for places, n, toxic in sets:
            margin = bias + weights[places].sum()
            margin += sum(factors[a] @ factors[b] for a in places for b in places if a < b)
            total += n * np.log1p(np.exp(margin)) - toxic * margin
        return total

    got, step = toxicity.gradient(frame, model), 1e-6
    for j in range(6):
        up, down = model.weights.copy(), model.weights.copy()
        up[j] += step
        down[j] -= step
        want = (loss(model.bias, up, model.factors) - loss(model.bias, down, model.factors)) / (2 * step)
        assert got[j, 0] == pytest.approx(want, abs=1e-5)
        for k in range(3):
            up, down = model.factors.copy(), model.factors.copy()
            up[j, k] += step
            down[j, k] -= step
            want = (loss(model.bias, model.weights, up) - loss(model.bias, model.weights, down)) / (2 * step)
            assert got[j, k + 1] == pytest.approx(want, abs=1e-5)
    want = (loss(model.bias + step, model.weights, model.factors) - loss(model.bias - step, model.weights, model.factors)) / (2 * step)
    assert got[6, 0] == pytest.approx(want, abs=1e-5)


def test_pairs_that_weights_alone_miss(spark, docs):
    # Toxic are an insult with the mention of a group, and a slur without an insult.
    rows, marks = made(3, 3000, lambda held: ("insult" in held) == ("group" in held) != ("slur" in held))
    frame, labels = docs(rows), labels_of(spark, marks)
    toxic = dict(marks)

    def right(factors):
        model = toxicity.trained(frame, labels, factors=factors)
        got = toxicity.scores(frame, model).collect()
        rows = [(row.score >= 0.5) == toxic[row.doc_id] for row in got if held_out(row.doc_id)]
        return sum(rows) / len(rows)

    assert right(factors=0) < 0.75 < 0.9 < right(factors=4)


def test_held_out_documents_are_never_learned(spark, docs):
    rows, marks = made(4, 400, lambda held: "slur" in held)
    other = [(k, 1 - toxic if held_out(k) else toxic) for k, toxic in marks]
    one, two = (toxicity.scored(docs(rows), labels_of(spark, m)).orderBy("doc_id").collect() for m in (marks, other))
    assert one == two and {row.held_out for row in one} == {True, False}
    assert all(row.held_out == held_out(row.doc_id) and row.predicted == (row.score >= 0.3) for row in one)
    wrong = [row for row in one if row.held_out and row.predicted != dict(marks)[row.doc_id]]
    assert len(wrong) < 0.05 * sum(row.held_out for row in one)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
    marks = {row.doc_id: row.toxic for row in table(spark, sf, "labels").collect()}
    rows = [row for row in got.collect() if row.held_out and row.doc_id in marks]
    toxic = [row.predicted for row in rows if marks[row.doc_id]]
    clean = [row.predicted for row in rows if not marks[row.doc_id]]
    # A tenth of the marks is set on texts like all others.
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.01


def test_odd_rows(spark, odd, empty):
    labels = labels_of(spark, [(None, 1), (5, 1), (5, 0), (6, None), (99, 1), (7, 0), (7, 0)])
    got = toxicity.scored(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= row.score <= 1 for row in rows)
    assert toxicity.scored(empty, labels).count() == 0
    rows = toxicity.scored(odd, labels_of(spark, [])).collect()
    assert all(row.score == pytest.approx(toxicity.PRIOR) for row in rows) and {row.predicted for row in rows} == {0}


def test_sample_is_bounded(spark, docs):
    rows, marks = made(6, 1000, lambda held: "slur" in held)
    n = toxicity.labelled(docs(rows), labels_of(spark, marks), 200).count()
    assert 150 < n < 250
    assert toxicity.labelled(docs(rows), labels_of(spark, marks)).count() == sum(not held_out(k) for k, _ in rows)
