import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cellweave.llm import hmm
from cellweave.llm.hmm import MarkovScorer, Model, Recursion

from .helpers import frame, words

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*(w.translate(LOWER) for w in words(text)), None]


def brute_base(rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for i, x in rows}


def check(spark, rows, **kw):
    scorer = MarkovScorer(frame(spark, rows), **kw)
    got = {r.doc_id: r for r in scorer.scores().collect()}
    want = brute_base(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total), i
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)), i
        assert r.score < 0
    return got, scorer


def test_table(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got, scorer = check(spark, rows)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert scorer.history == sorted(scorer.history)
    # Words beyond the broadcast table have the same base; with fewer symbols of their own the model is another one.
    monkeypatch.setattr(hmm, "KNOWN", 3000)
    other, second = check(spark, rows)
    assert 0 < len(second.lexicon.hashes) <= 3000 < len(scorer.lexicon.hashes)
    assert sum(r.score for r in other.values()) > sum(r.base_score for r in other.values())


def test_states_earn_the_gain(spark):
    """Held-out texts are likelier under eight states than under one, which knows the symbols' shares only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = {k: MarkovScorer(docs, states=k).scores().where("held_out").selectExpr("sum(score) / sum(n_tokens)").first()[0] for k in (1, 8)}
    print("held-out log10 a token", total)
    assert total[8] > total[1] + 0.1


def random_model(rng, states):
    emit = rng.random((hmm.SYMBOLS, states)) * (rng.random((hmm.SYMBOLS, 1)) < 0.01) + 1e-9
    move = rng.random((states, states))
    start = rng.random(states)
    base = rng.random(hmm.SYMBOLS) + 1e-6
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), base / base.sum())


def all_paths(m, t):
    """{path: probability} of a text's symbols"""
    out = {}
    for p in itertools.product(range(len(m.start)), repeat=len(t)):
        x = m.start[p[0]] * m.emit[t[0], p[0]]
        for a, b, s in zip(p, p[1:], t[1:]):
            x *= m.move[a, b] * m.emit[s, b]
        out[p] = x
    return out


def test_recursion_matches_all_paths(monkeypatch):
    rng = np.random.default_rng(3)
    m = random_model(rng, 3)
    texts = [rng.integers(0, hmm.SYMBOLS, n).astype(np.uint16) for n in (1, 4, 7, 7, 2)]
    total, starts, moves, emits, each = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.SYMBOLS, 3)), []
    for t in texts:
        paths = all_paths(m, t)
        z = sum(paths.values())
        each.append(math.log(z) - m.log_base()[t].sum())
        total += each[-1]
        for p, x in paths.items():
            starts[p[0]] += x / z
            for a, b in zip(p, p[1:]):
                moves[a, b] += x / z
            for a, s in zip(p, t):
                emits[s, a] += x / z
    for scaled in (1, 2, 5):
        monkeypatch.setattr(hmm, "SCALED", scaled)
        assert np.allclose(Recursion(m, texts).log_likelihoods(), each, atol=1e-9)
        for kind, close in ((np.float64, 1e-9), (np.float32, 1e-4)):
            s, mv, e, fit = Recursion(m, texts, kind).expected()
            assert np.allclose(s, starts, atol=close) and np.allclose(mv, moves, atol=close) and np.allclose(e, emits, atol=close) and abs(fit - total) < 100 * close
        for size in (1, 2, 3, 100):
            got = [hmm.in_stretches(m, t, size=size) for t in texts]
            s, mv, e, fit = (sum(g[k] for g in got) for k in range(4))
            assert np.allclose(s, starts) and np.allclose(mv, moves) and np.allclose(e, emits) and abs(fit - total) < 1e-9
            assert np.allclose([hmm.log_likelihood(m, t, size) for t in texts], each, atol=1e-9)


def test_scores_are_all_paths_times_what_words_have_within_their_class(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" if rng.random() < 0.4 else f"r{rng.randint(0, 10**6)}{rng.choice('abc')}" for _ in range(rng.choice([1, 2, 3, 200])))) for i in range(700)]
    rows += [(1000, None), (1001, "A a"), (1002, "never-seen w1")]
    got, scorer = check(spark, rows, iterations=3)
    m, held = scorer.model, {i: r.held_out for i, r in got.items()}
    count = Counter(t for i, x in rows if not held[i] for t in tokens(x) if t is not None)
    assert len(count) > hmm.OWN
    of = {t: int(hmm.word_classes(hmm.words_of(*hmm.text_buffer(pa.array([t]))))[0]) for _, x in rows for t in tokens(x) if t is not None}
    own = dict(zip(scorer.lexicon.hashes.tolist(), scorer.lexicon.symbols.tolist()))
    hashed = lambda t: int(hmm.words_of(*hmm.text_buffer(pa.array([t]))).hashes()[0])
    symbol = {t: own.get(hashed(t), -1) for t in of}
    assert sum(x >= 0 for t, x in symbol.items() if t in count) == hmm.OWN == sum(x >= 0 for x in own.values())
    assert min(count[t] for t, x in symbol.items() if x >= 0) >= max(count[t] for t, x in symbol.items() if x < 0)
    mass, once = defaultdict(float), defaultdict(int)
    for t, c in count.items():
        if symbol[t] < 0:
            mass[of[t]] += c + 0.5
            once[of[t]] += c == 1
    within = lambda t: 0.0 if symbol[t] >= 0 else math.log10(((count[t] or once[of[t]]) + 0.5) / (mass[of[t]] + once[of[t]] + 0.5))
    for i, x in rows:
        if len(words(x)) <= 3:
            t = np.array([symbol[w] if symbol[w] >= 0 else hmm.OWN + of[w] for w in tokens(x)[:-1]] + [hmm.END])
            want = math.log10(sum(all_paths(m, t).values())) + sum(within(w) for w in tokens(x)[:-1])
            assert abs(got[i].score - want) < 1e-8 * abs(want), (i, x)


def test_long_texts_go_in_stretches(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    whole, one = check(spark, rows, iterations=4)
    monkeypatch.setattr(hmm, "STRETCH", 30)
    parts, two = check(spark, rows, iterations=4)
    assert np.allclose(one.model.emit, two.model.emit, rtol=1e-2, atol=1e-7) and np.allclose(one.history, two.history, rtol=1e-4)
    assert all(abs(whole[i].score - parts[i].score) < 2e-3 * abs(whole[i].score) for i in whole)


def test_model_is_a_distribution(spark):
    rows = [(i, "a b c d e f g"[: i % 14]) for i in range(60)]
    _, scorer = check(spark, rows)
    lex, model = scorer.lexicon, scorer.model
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    # Classes without words keep all for words never seen.
    assert np.allclose(lex.mass, 0.5) and not lex.once.any()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Ä ä A a"), (4, "x " * 50_000), (5, "a\x0bb"), (6, "z" * 100_000), (7, "a b"), (8, "a b"), (11, "unseen words")]
    check(spark, rows)
    assert MarkovScorer(frame(spark, [])).scores().count() == 0
    assert MarkovScorer(frame(spark, [(None, "a"), (None, None)])).scores().count() == 2
