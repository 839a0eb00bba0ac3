import corpus_pipeline
from cellweave.llm.classify import fit

from .helpers import brute_near, brute_repeats, frame, words
from .test_decontam import brute as brute_leaks
from .test_tokens import check_pieces, plain  # noqa: F401


def test_stages_match_brute_force(spark, plain, tmp_path):  # noqa: F811
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    states = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], d).write.parquet(str(tmp_path / str(k)))
        states.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(s.columns == docs.columns for s in states[:-1])
    rows = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in states[:-1]]

    import pyarrow as pa

    voter = fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    ids = sorted(rows[0])
    good = dict(zip(ids, voter.scores(pa.array([rows[0][i] for i in ids])) >= 0.7, strict=True))
    assert rows[1] == {i: t for i, t in rows[0].items() if good[i]}
    group = brute_near(list(rows[1].items()))
    assert rows[2] == {i: t for i, t in rows[1].items() if group[i][1] == i}
    cut = brute_repeats(list(rows[2].items()))
    want = {i: (t if not cut[i][1] else cut[i][2]) for i, t in rows[2].items() if not cut[i][0] or cut[i][1] < cut[i][0]}
    assert rows[3] == want
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {i for i, _ in brute_leaks(list(rows[3].items()), items)}
    assert leaks and rows[4] == {i: t for i, t in rows[3].items() if i not in leaks}
    check_pieces(list(rows[4].items()), states[-1].collect(), plain, 4096)
    check_pieces(list(rows[4].items()), corpus_pipeline.run(spark, d).collect(), plain, 4096)
    assert all(r.n_chars == len(r.text) for r in states[3].collect())


def test_odd_rows_pass_through(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts: what each stage keeps of each row."""
    d = "/root/testdata/sf0.001"
    item = next(r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if len(words(r.text)) > 9)
    good = next(r.text for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect() if len(words(r.text)) > 120)
    a, b = good, " ".join(reversed(words(good)))
    long = " ".join(f"{w}{k}" for k in range(400) for w in words(good)[:100])
    rows = [(None, None), (None, a), (1, None), (2, ""), (3, a), (4, a), (4, b), (4, f"{b} tail"), (5, f"{b} and {item}"), (6, long), (7, f"{item} {item}")]
    for name, stage in corpus_pipeline.STAGES:
        for n, some in (("rows", rows), ("none", [])):
            got = [(r.doc_id, r.text) for r in stage(spark, frame(spark, some), d).collect()] if name != "packing" else None
            if name == "quality classifier" and some:
                assert set(got) <= set(rows) and (6, long) in got and (3, a) in got
            elif name == "substring dedup" and some:
                want = [(i, t) for (i, _), t in zip(some, cut_rows(some))]
                assert sorted(map(str, got)) == sorted(str(x) for x in want if x[1] != "" or x[0] == 2)
            elif name == "benchmark decontamination" and some:
                assert sorted(map(str, got)) == sorted(map(str, rows[:8] + [(6, long)]))
            elif not some and got is not None:
                assert got == []
    near = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, frame(spark, rows), d).collect()]
    assert {(None, None), (None, a), (1, None), (2, ""), (3, a), (6, long), (7, f"{item} {item}")} <= set(near) and len(near) >= 9
    pieces = pack_rows(corpus_pipeline.STAGES[-1][1](spark, frame(spark, rows), d))
    assert len(pieces) >= len(rows) and corpus_pipeline.STAGES[-1][1](spark, frame(spark, []), d).count() == 0


def pack_rows(df):
    return [tuple(r) for r in df.collect()]


def cut_rows(rows, size=50):
    """Each row's text without the windows that a smaller id holds; as it is where nothing goes."""
    first = {}
    for i, t in rows:
        w = words(t) if i is not None else []
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t) if i is not None else []
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone) if gone else t)
    return out
