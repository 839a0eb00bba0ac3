import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm.session import Scratch, components
from cellweave.llm.words import doc_hashes, slices, sliding, text_buffer, valid_windows, window_hashes, words_of

from .helpers import words

TEXT = st.text(alphabet=st.sampled_from("ab \t\n\x0b\x0c\r\x1cé日 "), max_size=30)


def split(texts):
    return words_of(*text_buffer(pa.array(texts, pa.string())))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT, st.text(max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = split(texts)
    raw = w.data.tobytes()
    got = [[raw[s : s + n].decode() for s, n in zip(w.starts[i:j], w.lengths[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [words(t) for t in texts]
    h = w.hashes()
    flat = [x for t in texts for x in words(t)]
    seen = {}
    assert all(seen.setdefault(x, int(v)) == v for x, v in zip(flat, h)) and len(set(seen.values())) == len(seen)
    keys = doc_hashes(h, w.first)
    by = {}
    assert all(by.setdefault(tuple(words(t)), int(k)) == k for t, k in zip(texts, keys)) and len(set(by.values())) == len(by)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 6))
def test_windows(texts, size):
    w = split(texts)
    h = w.hashes()
    flat = [x for t in texts for x in words(t)]
    hashes, ok = window_hashes(h, size), valid_windows(w.first, size)
    seen = {}
    for p, v in enumerate(hashes):
        assert seen.setdefault(tuple(flat[p : p + size]), int(v)) == v
    assert len(set(seen.values())) == len(seen)
    doc = np.repeat(np.arange(len(texts)), w.counts)
    assert ok.tolist() == [p + size <= len(flat) and doc[p] == doc[p + size - 1] for p in range(len(flat))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 40))
def test_sliding(values, size):
    x = np.array(values)
    if size <= len(x):
        assert sliding(np.minimum, x, size).tolist() == [min(values[p : p + size]) for p in range(len(x) - size + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=30), st.integers(1, 60), st.integers(1, 9))
def test_slices_keep_every_row(texts, size, rows):
    parts = list(slices(pa.table({"text": pa.array(texts, pa.string())}), size=size, rows=rows))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts and all(p.num_rows <= rows for p in parts)


def test_upper_case_of_ascii_only():
    data, _ = text_buffer(pa.array(["ABC Éé Z"]), lower=True)
    assert data[:-8].tobytes().decode() == "abc Éé z"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=50))
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    with Scratch(spark) as tmp:
        got = {r.node: r.component for r in components(tmp, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_a_long_chain(spark):
    with Scratch(spark) as tmp:
        got = components(tmp, spark.range(300).selectExpr("id as a", "id + 1 as b")).collect()
    assert {r.node for r in got} == set(range(301)) and {r.component for r in got} == {0}
