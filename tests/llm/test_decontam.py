import math
import random
from collections import defaultdict

import numpy as np

from cellweave.llm import decontam
from cellweave.llm.decontam import contaminated, uncontaminated

from .helpers import frame, words


def brute(rows, items):
    """{(doc, item): (best similarity, its first start)} over all item-sized windows, wherever they start"""
    items = [(i, words(t)) for i, t in items if words(t)]
    out = {}
    for size in {min(5, len(w)) for _, w in items}:
        sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for i, w in items if min(5, len(w)) == size}
        df = defaultdict(int)
        for s in sets.values():
            for x in s:
                df[x] += 1
        weigh = lambda s: sum(math.log1p(len(sets) / df.get(x, 1)) for x in s)  # noqa: B023, E731
        for d, t in rows:
            w = words(t)
            for i, iw in items:
                for b in range(len(w) - size + 1) if i in sets else ():
                    window = w[b : b + len(iw)]
                    own = {tuple(window[k : k + size]) for k in range(len(window) - size + 1)}
                    common = own & sets[i]
                    s = weigh(common) / max(weigh(own), weigh(sets[i])) if common else 0
                    if s >= 0.8 - 1e-9 and s > out.get((d, i), (0, 0))[0] + 1e-9:
                        out[d, i] = (s, b)
    return out


def check(spark, rows, items):
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(rows, items)
    assert got.keys() == want.keys()
    for k, (s, b) in want.items():
        assert abs(got[k][0] - s) < 1e-9 and got[k][1] == b, k


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 60))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(25)]
    items += [(30, "tiny one"), (31, None), (32, " "), (33, items[0][1]), (34, "a b c d e"), (35, "same " * 20)]
    rows = []
    for d in range(80):
        w = [word() for _ in range(rng.randint(0, 120))]
        if d % 2:
            x = rng.choice(items)[1]
            x = (x or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if x:
                    x[rng.randrange(len(x))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = x
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(w)))
    return rows + [(90, None), (91, ""), (92, "tiny one"), (93, "same " * 300), (94, items[3][1]), (95, items[3][1][:-3])], items


def test_planted(spark):
    for seed in (1, 2):
        check(spark, *planted(seed))


def test_table_leaks(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows, its = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    exact = {(d, i) for d, t in rows for i, x in its if f" {' '.join(words(x))} " in f" {' '.join(words(t))} "}
    assert exact and got >= exact
    left = {r.doc_id for r in uncontaminated(docs, items).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(frame(spark, [(1, "a b")]), none).count() == 0
    assert contaminated(frame(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    item = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    rows = [(None, "x a b c d e f g"), (2, "x a b c d e f g"), (2, "x a b c d e f g"), (3, "x")]
    assert sorted(str(r.doc_id) for r in contaminated(frame(spark, rows), item).collect()) == ["2", "2", "None"]
    assert [r.doc_id for r in uncontaminated(frame(spark, rows), item).collect()] == [3]
    rows = [(2, "x a b c d e f g"), (2, "other words"), (None, "clean"), (None, None)]
    assert sorted((str(r.doc_id), str(r.text)) for r in uncontaminated(frame(spark, rows), item).collect()) == [("2", "other words"), ("None", "None"), ("None", "clean")]
    assert uncontaminated(frame(spark, rows), none).count() == 4 and uncontaminated(frame(spark, []), item).count() == 0


def test_shifted_passages(spark):
    """Sentences of an item in another order, and planted ones: every window counts, not only those with a shingle on its place."""
    rng = random.Random(6)
    rows, items = planted(3)
    a, b = ([f"{x}{k}" for k in range(30)] for x in "ab")
    items = [*items, (50, " ".join(a + b))]
    rows = [*rows, (200, " ".join(["x"] * 9 + b + a + ["y"] * 9)), (201, " ".join(b + a)), (202, " ".join(a[:20] + ["x"] * 20 + b))]
    for d in range(40):
        w = (items[rng.randrange(25)][1]).split()
        cut = rng.randrange(1, len(w))
        rows.append((300 + d, " ".join(["z"] * rng.randint(0, 5) + w[cut:] + w[:cut] + ["z"] * rng.randint(0, 5))))
    want = brute(rows, items)
    assert (200, 50) in want and (201, 50) in want and (202, 50) not in want
    check(spark, rows, items)


def test_rounds_change_nothing(spark, monkeypatch):
    rows, items = planted(4)
    common = " ".join(f"c{k}" for k in range(9))
    items = [(i, f"{t} {common}" if t and i < 20 else t) for i, t in items]
    rows = [*rows, *((400 + i, f"x {t} y") for i, t in items[:25]), *((500 + i, f"x {t.rsplit(' ', 4)[0]} y z q") for i, t in items[:25])]
    run = lambda some: sorted(map(tuple, contaminated(frame(spark, rows), spark.createDataFrame(some, "item_id long, text string")).collect()))
    whole = run(items)
    for words_, some in ((200, items), (200, items[::-1]), (700, items)):
        monkeypatch.setattr(decontam, "ROUND_WORDS", words_)
        assert run(some) == whole
        left = uncontaminated(frame(spark, rows), spark.createDataFrame(some, "item_id long, text string")).collect()
        assert {r.doc_id for r in left} == {i for i, _ in rows} - {r[0] for r in whole}


def test_index_lists_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (300, decontam.BLOCKS), np.uint8)
    near = prints[rng.integers(0, 300, 500)] ^ np.packbits(rng.random((500, 8 * decontam.BLOCKS)) < rng.random((500, 1)) * 0.5, axis=1)
    group = decontam.Length.of(9, np.arange(300), np.ones(300), prints)
    window, item = group.candidates(near)
    far = np.unpackbits(near[:, None] ^ prints, axis=2).sum(axis=2)
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS))))


def test_null_and_repeated_item_ids_stay(spark):
    items = [(None, "a b c d e f g"), (-1, "a b c d e f g"), (5, "q r s"), (5, "t u v w x y z")]
    got = contaminated(frame(spark, [(1, "x a b c d e f g"), (2, "q r s t u v w x y z")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.item_id, r.start)) for r in got) == ["(1, -1, 1)", "(1, None, 1)", "(2, 5, 0)", "(2, 5, 3)"]


def test_recall_on_many_passages(spark):
    """Planted passages with words put in, left out and exchanged, at all similarities about the threshold: none is missed."""
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 3000))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 50)))) for i in range(60)]
    rows = []
    for d in range(400):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        rows.append((d, " ".join([word() for _ in range(rng.randint(0, 9))] + w + [word() for _ in range(rng.randint(0, 9))])))
    check(spark, rows, items)
