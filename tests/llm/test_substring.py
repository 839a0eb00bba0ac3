import hashlib
import random

from cellweave.llm.substring import merge, repeated_passages, without_repeats

from .helpers import brute_repeats, frame, words


def check(spark, rows):
    got = {r.doc_id: r for r in repeated_passages(frame(spark, rows)).collect()}
    want = brute_repeats(rows)
    assert set(got) == set(want)
    for i, (n, gone, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), i


def test_matches_brute_force_on_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijkl") * rng.randint(1, 3) + str(rng.randint(0, 400))
    passage = [word() for _ in range(130)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 100)
            at = rng.randint(0, len(w))
            w[at:at] = passage[a : a + rng.choice([49, 50, 51, 80])]
        rows.append((i * 3 % 41, (" \t\n"[i % 3]).join(w)))
    rows += [(100, "rep " * 400), (101, "rep\n" * 60), (102, "x " + "rep " * 50 + "y"), (103, "rep " * 49), (104, " ".join(passage)), (105, " ".join(passage)), (106, None), (107, ""), (108, "é ü \x0b!")]
    check(spark, rows)


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (2, text), (2, text), (3, text), (4, None)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in repeated_passages(frame(spark, rows)).collect())
    assert got == [(False, 0, 0), (True, 2, 0), (True, 2, 0), (True, 3, 60), (True, 4, 0)]
    assert repeated_passages(frame(spark, [])).count() == 0
    left = without_repeats(frame(spark, rows + [(5, text + " more"), (6, "")]))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, text), (2, text), (4, None), (5, "more"), (6, "")}


def brute_rows(rows, size=50):
    """As brute_repeats, for rows that may share an id: [(id, kept words)], each row by its own text."""
    first = {}
    for i, t in rows:
        for k in range(len(words(t)) - size + 1):
            x = tuple(words(t)[k : k + size])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_rows_that_share_an_id_keep_their_own_words(spark, monkeypatch):
    run = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    a, b = run("a", 60), run("b", 70)
    rows = [(1, a), (2, f"{a} more"), (2, b), (2, f"x {a}"), (3, b), (3, f"{b} {a}"), (3, f"{b}\n{a}"), (4, f"{run('c', 55)} {b}"), (5, run("c", 80)), (5, "few words")]
    for piece in (256, 3):
        monkeypatch.setattr("cellweave.llm.substring.PIECE", piece)
        for some in (rows, rows[::-1]):
            want = brute_rows(some)
            got = repeated_passages(frame(spark, some)).collect()
            assert sorted((r.doc_id, r.kept_sha256) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
            left = without_repeats(frame(spark, some)).collect()
            assert sorted((r.doc_id, " ".join(words(r.text))) for r in left) == sorted(x for x in want if x[1])


def test_long_passages_go_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    w = [f"w{rng.randint(0, 9)}-{k}" for k in range(700)]
    rows = [(1, " ".join(w)), (2, " ".join(w[100:640] + ["x"] + w[20:75])), (3, " ".join(["y"] + w[:300] + w[280:500])), (4, " ".join(w[::-1])), (5, " ".join(w[300:] + w[:300]))]
    for piece in (256, 50, 7):
        monkeypatch.setattr("cellweave.llm.substring.PIECE", piece)
        check(spark, rows)


def test_merge():
    assert merge([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
