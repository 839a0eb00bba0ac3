import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import packing
from cellweave.llm.lengths import at_limits, at_quantiles, token_counts
from cellweave.llm.packing import Frontier, pack
from cellweave.llm.tokens import WordTokenizer, tokenizer, vocabulary_path

from .helpers import frame

EXAMPLES = [None, "", " ", "Hello, World! it's", "é É ß İ ŉ", "a\x1cb \x85c\xa0d e​f", "<|endoftext|> x<|StartOfText|>", "ΟΔΟΣ ΟΔΟΣ.", "é ́e", "日本 語。", "x" * 300, "a\x00b", "5,000$ 'll 've\n\n!!"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def flat(t, texts):
    ids, bounds = t.encode_flat(pa.array(texts, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])]


def test_equals_whole_encoding(plain):
    for x in EXAMPLES:
        assert np.frombuffer(tokenizer().encode(x), "<u4").tolist() == plain(x), x
    assert flat(WordTokenizer(vocabulary_path(), 3), EXAMPLES) == [plain(x) for x in EXAMPLES]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_equals_whole_encoding_of_any_text(text):
    t = tokenizer()
    assert t.encode(text) == t._whole(text)
    some = [text, text.upper(), text + "İx", "a" + text + "!"]
    assert flat(t, some) == [np.frombuffer(t._whole(x), "<u4").tolist() for x in some]


def test_equals_whole_encoding_of_table(plain):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    t = WordTokenizer(vocabulary_path(), 5000)
    assert [x for k in range(0, len(texts), 50) for x in flat(t, texts[k : k + 50])] == [plain(x) for x in texts]


def test_token_counts(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + list(enumerate(EXAMPLES, 10_000))
    n = [len(plain(t)) for _, t in rows]
    sums = token_counts(frame(spark, rows))
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(n) and sum(r.n_docs for r in got.values()) == len(n)
    for limit, r in got.items():
        assert r.truncated_total == sum(min(x, limit) for x in n)
        assert (r.docs_within, r.docs_over) == (sum(x <= limit for x in n), sum(x > limit for x in n))
        assert (r.tokens_within, r.tokens_over) == (sum(x for x in n if x <= limit), sum(x for x in n if x > limit))
        assert abs(r["quantile"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    for r in at_limits(sums, [0, 7, 512, 4096, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in n) and r.docs_over == sum(x > r.limit for x in n)
    for r in at_quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(n)[int(np.ceil(r.share * len(n))) - 1]
    assert token_counts(frame(spark, [])).count() == 0


def check_pieces(rows, pieces, plain, limit):
    """Pieces cover each document's ids once; sequences are gapless; returns padding over tokens."""
    want = {i: [*plain(t), 2] for i, t in rows}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[i])
            assert p.ids_crc32 == zlib.crc32(np.array(want[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[i])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / sum(map(len, want.values()))


def test_packing(spark, plain, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + list(enumerate(EXAMPLES, 10_000)) + [(20_000, "word " * 30_000)]
    assert check_pieces(rows, pack(frame(spark, rows).coalesce(1)).collect(), plain, 4096) < 0.01
    docs = frame(spark, rows[:60])
    ids = {(r.doc_id, r.start): r.ids for r in pack(docs, with_ids=True).collect()}
    assert all(ids[i, 0] == [*plain(t), 2][: len(ids[i, 0])] for i, t in rows[:60])
    assert pack(frame(spark, [])).count() == 0
    assert [(r.doc_id, r.length) for r in pack(frame(spark, [(None, None)])).collect()] == [(None, 1)]


def packed(rows, **kw):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    return [r for b in packing._pack(iter([batch.slice(k, 100) for k in range(0, len(rows), 100)]), None, False, **kw) for r in b.to_pylist()]


def test_blocks_change_nothing(plain, monkeypatch):
    rows = [(k, "One two three. Four five six seven!  eight " * (k * k % 90)) for k in range(1500)] + [(5000, "word " * 30_000)] + [(6000 + k, "a b. " * k) for k in range(60)]
    whole = packed(rows)
    assert check_pieces(rows, [type("P", (), r) for r in whole], plain, 4096) < 0.005
    for tokens in (1, 20_000, 1 << 40):
        monkeypatch.setattr(packing, "BLOCK_TOKENS", tokens)
        assert packed(rows) == whole
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 50_000)
    some = rows[1490:1530]
    check_pieces(some, [type("P", (), r) for r in packed(some, step=1)], plain, 4096)


def price(n, length):
    return 0 if n & (n - 1) == 0 else length - n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 1, 16])), min_size=1, max_size=60), st.randoms(use_true_random=False))
def test_cuts_are_the_cheapest(gaps, rng):
    places = np.cumsum([0, *(g for g, _ in gaps)])
    penalty = np.array([0, *(p for _, p in gaps)])
    cost = lambda b, c: price(int(places[c] - places[b]), 32) + packing.SEQUENCE + penalty[c]
    best = [0.0] + [float("inf")] * len(gaps)
    for c in range(1, len(places)):
        best[c] = min(best[b] + cost(b, c) for b in range(c) if places[c] - places[b] <= 32)
    whole = Frontier(32)
    whole.extend(places[1:], penalty[1:])
    cuts = whole.finished()
    at = [0, *np.searchsorted(places, cuts)]
    assert cuts[-1] == places[-1] and sum(cost(b, c) for b, c in zip(at, at[1:])) == best[-1]
    parts, k, out = Frontier(32), 1, []
    while k < len(places):
        n = rng.randint(1, 9)
        parts.extend(places[k : k + n], penalty[k : k + n])
        out += parts.settled()
        k += n
    assert out + parts.finished() == cuts
