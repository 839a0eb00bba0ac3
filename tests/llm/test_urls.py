import random

from cellweave.llm import urls
from cellweave.llm.urls import judge

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    rules = [((h or "").lower(), p or "", v) for h, p, v in rules if v is not None]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or h == "" or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else default


URLS = [None, "", "x", "http://", "http://org", "HTTP://A.Org/x?y#z", "a://b://c/d", "http://example.org/es/1", "http://notexample.org/es/1", "http://m.example.org/en/12", "http://x.com/fr/", "http://x.com/de/a/b", "http://com/de/", "http://x.com?u=/de/", "http://org./a", "http://.org/a", "http://é.ORG/É\n/x", "http://a..org/"]


def run(spark, some, rules):
    df = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, rules).collect()}


def test_contract(spark):
    assert run(spark, URLS, RULES) == {k: brute(u, RULES) for k, u in enumerate(URLS)}


def test_random_nesting(spark, monkeypatch):
    rng = random.Random(2)
    name = lambda n: ".".join(rng.choice(["a", "b", "com", "org"]) for _ in range(rng.randint(1, n)))
    path = lambda n: "".join(rng.choice(["/x", "/y", "z"]) for _ in range(rng.randint(0, n)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((name(3), "/" + path(3)) for _ in range(60))}.values()) + [("", "/x/y", "block"), ("a", "", "allow")]
    some = [f"http://{name(4)}/{path(4)}" for _ in range(400)]
    want = {k: brute(u, rules) for k, u in enumerate(some)}
    assert run(spark, some, rules) == want
    as_table = spark.createDataFrame(rules, urls.RULE_SCHEMA)
    assert run(spark, some, as_table) == want
    monkeypatch.setattr(urls, "MAX_BROADCAST", 5)
    for sampled in (0.2, 20, 1000):
        monkeypatch.setattr(urls, "SAMPLED", sampled)
        assert run(spark, some, as_table) == run(spark, some, rules) == want
    assert run(spark, URLS, as_table) == {k: brute(u, rules) for k, u in enumerate(URLS)}


def test_any_number_of_rules_and_odd_ones(spark, monkeypatch):
    """Nulls in any field, one host with most of the urls, and more ranges than keys: the same rows broadcast or by ranges."""
    rules = [(None, "/x", "block"), ("A.org", None, "block"), ("a.org", "", "allow"), ("b.org", "/x", None), (None, None, "allow"), ("b.org", "/x/y", "allow"), ("", "/x", "allow"), ("é.c", "/", "block")]
    some = [f"http://{h}/{p}" for h in ["a.org"] * 40 + ["b.org", "x.b.org", "c", "é.c"] for p in ("", "x", "x/y/z", "q")] + URLS
    want = {k: brute(u, rules) for k, u in enumerate(some)}
    assert run(spark, some, rules) == want
    assert run(spark, some, []) == {k: brute(u, []) for k, u in enumerate(some)}
    monkeypatch.setattr(urls, "MAX_BROADCAST", 0)
    for places in (1, 2):
        monkeypatch.setattr(urls, "RANGE_RULES", places)
        assert run(spark, some, rules) == want
    assert run(spark, [], rules) == {}


def test_ranges():
    r = urls.Ranges(["b."] * 6 + ["a.", "c."], 8)
    assert r.ends == ["a.", "b.", "c."] or r.ends == ["b.", "c."] or r.ends == ["b."]
    for k in ("", "a.", "b.", "b.x.", "c.", "zz"):
        for salt in range(9):
            assert all(r.of_url(k, salt) in r.of_rule(k[:n]) for n in range(len(k) + 1))
    assert list(r.of_rule("")) == list(range(8)) and len({r.of_url("b.", s) for s in range(99)}) >= 5


def test_edges(spark):
    assert run(spark, [], RULES) == {}
    df = spark.createDataFrame([(1, "http://a.org/", "x", "y"), (1, "http://a.org/", "x", "y"), (None, None, None, None)], "page_id long, url string, host string, rule string")
    got = judge(df, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and sorted(map(str, got.collect())) == sorted(map(str, [*got.collect()])) and got.count() == 3
