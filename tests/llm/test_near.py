import random

import numpy as np
import pytest

from cellweave.llm import near
from cellweave.llm.near import least_matches, links, near_duplicates, one_of_each

from .helpers import brute_near, frame


def check(spark, rows):
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_matches_brute_force_on_test_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 900))
    rows, base = [], [[word() for _ in range(rng.choice([3, 5, 40, 120]))] for _ in range(6)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows + [(100, None), (101, ""), (102, " \t"), (103, "one"), (104, "one"), (105, "one two"), (106, "x " * 500), (107, "x " * 700)]


def test_planted(spark):
    check(spark, planted(3))


def test_split_clusters(spark, monkeypatch):
    rows = planted(9, 90)
    monkeypatch.setattr(near, "BLOCK_DOCS", 7)
    check(spark, rows)


def test_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.class_id, r.n_links) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(False, 0, None, 0), (True, 1, 1, 1), (True, 2, 1, 1), (True, 3, 3, 0)]
    assert sorted(str(r.doc_id) for r in one_of_each(frame(spark, rows)).collect()) == ["1", "1", "3", "None"]


def test_rows_that_share_an_id(spark):
    """The words with the least hash stand for an id, in any order of the rows; what was not compared stays."""
    run = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    a, b, c = run("a", 40), run("b", 40), run("c", 30)
    rows = [(1, a), (2, a), (2, b), (2, a.replace(" ", "\n")), (3, b), (4, f"{b} x"), (5, c), (5, f"{c} y"), (6, c), (0, b + " z")]
    out, kept = [], []
    for some in (rows, rows[::-1], rows[4:] + rows[:4]):
        out.append(sorted(tuple(r) for r in near_duplicates(frame(spark, some)).collect()))
        kept.append(sorted((r.doc_id, r.text) for r in one_of_each(frame(spark, some)).collect()))
    assert out[0] == out[1] == out[2] and kept[0] == kept[1] == kept[2]
    keys = near._text_keys([t for _, t in rows])
    stand = {i: min((k, t) for k, (j, t) in zip(keys, rows) if j == i)[1] for i, _ in rows}
    want = brute_near(list(stand.items()))
    assert {r[0]: (r[3], r[1]) for r in out[0]} == want
    gone = lambda i, t: want[i][1] != i and t.split() == stand[i].split()
    assert kept[0] == sorted((i, t) for i, t in rows if not gone(i, t))


def test_bulk_and_single_verification_agree():
    texts = [" ".join(t.split()) for _, t in planted(11, 200) if t and t.split()]
    pairs = {tuple(p) for p in links(texts, np.full(len(texts), -1)).tolist()}
    want = brute_near(list(enumerate(texts)))
    assert {i: sum(i in p for p in pairs) for i in range(len(texts))} == {i: n for i, (n, _) in want.items()}


def test_pruning_rule():
    limits = least_matches(0.8, 1e-6)
    assert limits[16] < limits[160] and all(m / n < 0.8 for n, m in limits.items())
    assert limits[160] / 160 > 0.5


if __name__ == "__main__":
    pytest.main([__file__])
