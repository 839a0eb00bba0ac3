import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import classify
from cellweave.llm.classify import Voter, accepted, fit, score, terms

from .helpers import frame, words


@pytest.fixture(scope="module")
def table(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark, table):
    docs, labels = table
    got = score(docs, fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    print("auc", auc(held.score.to_numpy(), held.quality.to_numpy()), "accuracy", (held.predicted == held.quality).mean())
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.96
    assert held[held.quality == 1].predicted.mean() > 0.98


def brute_score(v, text):
    """All cosines one by one, sorted; the nearest vote."""
    x = classify._weighted(terms(pa.array([text], pa.string())), v.rarity)[0] @ v.projection
    x = x / max(float(np.linalg.norm(x)), 1e-12)
    c = sorted(((float(np.dot(x, o)), float(y)) for o, y in zip(v.vectors, v.labels)), reverse=True)[: classify.NEIGHBOURS]
    w = [max(a, 0) ** classify.POWER for a, _ in c]
    return (sum(k * y for k, (_, y) in zip(w, c)) + classify.PRIOR * v.labels.mean()) / (sum(w) + classify.PRIOR)


def test_nearest_vote_as_by_brute_force():
    rng = random.Random(5)
    make = lambda: " ".join(rng.choice(["ab", "cde", "FG!", "h|", "ijk", "x"]) + rng.choice("aeiou") for _ in range(rng.randint(1, 40)))
    for n in (18, 150):  # fewer and more than NEIGHBOURS
        texts = [make() for _ in range(n)] + [None, "", "word word word word", "x"]
        v = Voter.fit(terms(pa.array(texts)), np.array([rng.randrange(2) for _ in texts]), 6)
        assert np.allclose(v.scores(pa.array(texts), block=7), [brute_score(v, t) for t in texts], atol=2e-4)


def test_terms_as_by_brute_force(monkeypatch):
    texts = ["ab ab ab c ab", "é é x\nx x", "", None, "z", "ab", "one two three two two one " * 30]
    got = terms(pa.array(texts))
    for row, t in zip(got, texts):
        raw, w = (t or "").encode(), words(t)
        grams = Counter(raw[k : k + 3] for k in range(len(raw) - 2))
        assert round(float((row[: classify.CHARS] ** 2).sum())) == sum(grams.values())
        kinds = [2 if k and w[k - 1] == x else int(x in w[:k]) for k, x in enumerate(w)]
        want = Counter(zip(kinds, [*(k + 1 for k in kinds[1:]), 0]))
        pairs = row[classify.CHARS :].reshape(classify.KINDS, -1) ** 2
        assert {(a, b): round(float(pairs[a, b])) for a in range(3) for b in range(4) if pairs[a, b]} == dict(want)
    monkeypatch.setattr(classify, "STRETCH", 5)
    assert (terms(pa.array(texts)) == got).all()
    assert (np.concatenate([terms(pa.array([t], pa.string())) for t in texts]) == got).all()


def test_rows_of_one_id(spark):
    rows = [(4, "a b c"), (4, "d e f"), (8, "x y z"), (8, "x y z")]
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 0), (8, 1)], "doc_id long, quality int")
    one, two = (fit(frame(spark, r), labels) for r in (rows, rows[::-1]))
    assert len(one.labels) == 3 and (one.vectors == two.vectors).all() and (one.labels == two.labels).all()


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (4, "abc " * 100_000), (5, "é")]
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score(docs, fit(docs, none)).collect()} == {1.0}
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, None), (5, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    v = fit(docs, labels)
    assert len(score(docs, v).collect()) == 5 and all(0 <= r.score <= 1 for r in score(docs, v).collect())
    assert score(frame(spark, []), v).count() == 0
    assert accepted(docs, v).schema == docs.schema
