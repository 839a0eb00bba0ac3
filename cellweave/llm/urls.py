"""URL filters by a sort-merge range join over reversed-host keys.

A rule is (host, path, verdict).  It fits a url if the url's host is the rule's or a subdomain of it and the url's path starts with
the rule's path; of the fitting rules the longest (host and path together, then host) wins.

With its labels reversed, a host becomes a key (`a.example.org` -> `org.example.a.`) under which a host and all its
subdomains are one interval, and intervals are nested or apart.  Each partition sorts its urls by (key, path) and sweeps them
together with the sorted rules: a rule host is pushed when the sweep enters its interval and popped when it leaves, so
the stack holds just the hosts that fit, outermost first.  On each host of the stack the same holds for
paths, whose prefixes are intervals too: the host's rules are kept sorted and looked up by falling back along
nested prefixes.  Nothing is shuffled.

At most MAX_BROADCAST rules are broadcast and nothing is shuffled.  Beyond that rules and urls are dealt to the same ranges of keys,
bounded by a sample of the urls' keys, and each range is swept in the same way: a rule goes to all ranges that its interval meets, and a key so
frequent that it bounds several ranges has its urls dealt among them by a hash.  The result is the same.

An empty or null rule host fits every host, the empty one too, and an empty or null path every path; a rule with a null verdict does not count, and
of rules with the same host and path the greater verdict holds, so blocking goes before allowing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MAX_BROADCAST = 200_000
#: Keys sampled for each range, rules that one range should hold at most.
SAMPLED, RANGE_RULES = 20, 50_000
ALLOW, BLOCK = "allow", "block"
RULE_SCHEMA = "host string, path string, verdict string"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class RuleSweep:
    """Rules sorted by reversed host; urls must be asked for in rising order of their keys."""

    def __init__(self, rules: list[tuple[str | None, str | None, str | None]]):
        hosts: dict[str, dict[str, tuple]] = {}
        for host, path, verdict in rules:
            if verdict is None:
                continue
            host, path = (host or "").translate(_LOWER), path or ""
            at = hosts.setdefault(reversed_key(host), {})
            if path not in at or verdict > at[path][3]:
                at[path] = (len(host) + len(path), len(host), host + path, verdict)
        self.keys = sorted(hosts)
        self.rules = []
        for k in self.keys:
            paths, above, open_ = sorted(hosts[k]), [], []
            for i, p in enumerate(paths):
                while open_ and not p.startswith(paths[open_[-1]]):
                    open_.pop()
                above.append(open_[-1] if open_ else -1)
                open_.append(i)
            self.rules.append((paths, above, [hosts[k][p] for p in paths]))
        self.next, self.stack, self.last = 0, [], ""

    def find(self, key: str, path: str) -> tuple | None:
        if key < self.last:
            self.next, self.stack = 0, []
        self.last = key
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            if key.startswith(self.keys[self.next]):
                self.stack.append(self.next)
            self.next += 1
        best = None
        for k in self.stack:
            paths, above, found = self.rules[k]
            i = bisect_right(paths, path) - 1
            while i >= 0 and not path.startswith(paths[i]):
                i = above[i]
            if i >= 0 and (best is None or found[i][:2] > best[:2]):
                best = found[i]
        return best


def _sweep(batches: Iterator[pa.RecordBatch], rules: list[tuple[str, str, str]], default: str) -> Iterator[pa.RecordBatch]:
    sweep = RuleSweep(rules)
    for batch in batches:
        *kept, keys = batch.columns
        hits = [sweep.find(k, p) for k, p in zip(keys.to_pylist(), kept[-1].to_pylist(), strict=True)]
        cols = [*kept, pa.array([h and h[2] for h in hits], pa.string()), pa.array([h[3] if h else default for h in hits], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "rule", "verdict"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """A row for each page: its id, host, path, rule (host and path of the one that decides, else null) and verdict.

    A null url, or one without `://`, has an empty host and path.  Where no rule fits the verdict is the default.  Repeated rows and null ids are judged
    like others; columns besides the two are not read.
    """
    out = pages.select(F.col(id_col), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path"))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit(".")))
    urls = out.withColumn("__key", key)
    schema = T.StructType([*out.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    some = rules[: MAX_BROADCAST + 1] if isinstance(rules, list) else [tuple(r) for r in rules.select("host", "path", "verdict").limit(MAX_BROADCAST + 1).collect()]
    if len(some) > MAX_BROADCAST:
        table = pages.sparkSession.createDataFrame(rules, RULE_SCHEMA) if isinstance(rules, list) else rules.select("host", "path", "verdict")
        return _by_ranges(urls, table, default, schema)
    return urls.sortWithinPartitions("__key", "path").mapInArrow(lambda b: _sweep(b, some, default), schema)


class Ranges:
    """Ranges of keys, each with as many places as the sampled keys that end it are many."""

    def __init__(self, sample: list[str], places: int):
        sample = sorted(sample)
        ends = [sample[k * len(sample) // places] for k in range(1, places)] if sample else []
        self.ends = sorted(set(ends))
        many = [ends.count(e) for e in self.ends] + [1]
        self.first = [sum(many[:k]) for k in range(len(many) + 1)]

    def of_url(self, key: str, salt: int) -> int:
        k = bisect_left(self.ends, key)
        return self.first[k] + salt % (self.first[k + 1] - self.first[k])

    def of_rule(self, key: str) -> range:
        """All places of the ranges that the interval of a key and what lies under it meets."""
        return range(self.first[bisect_left(self.ends, key)], self.first[bisect_left(self.ends, key + chr(0x10FFFF)) + 1])


def _by_ranges(urls: DataFrame, rules: DataFrame, default: str, schema: T.StructType) -> DataFrame:
    """The same sweep for any number of rules."""
    spark, (id_name, id_type) = urls.sparkSession, (urls.columns[0], urls.schema[0].dataType.simpleString())
    n_urls, n_rules = urls.count(), rules.count()
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rules // RANGE_RULES))
    sample = urls.select("__key").sample(min(1.0, SAMPLED * places / max(n_urls, 1)), 7).toArrow().column(0).to_pylist()
    box = spark.sparkContext.broadcast(Ranges(sample, places))
    row = f"place int, kind int, __key string, path string, host string, verdict string, id {id_type}"

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, host, path, key, salt in (b.columns for b in batches):
            at = [box.value.of_url(k, s) for k, s in zip(key.to_pylist(), salt.to_pylist(), strict=True)]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([1] * n, pa.int32()), key, path, host, pa.nulls(n, pa.string()), ids], names=names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, 0, k, path or "", host or "", verdict) for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in [reversed_key((host or "").translate(_LOWER))] for p in box.value.of_rule(k)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.nulls(len(rows), id_kind)], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known, at = None, [], None
        for batch in batches:
            out = []
            for p, kind, key, path, host, verdict, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != place:
                    place, known, at = p, [], None
                if not kind:
                    known.append((host, path, verdict))
                    continue
                at = at or RuleSweep(known)
                hit = at.find(key, path)
                out.append((i, host, path, hit and hit[2], hit[3] if hit else default))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_kind), *(pa.array(c, pa.string()) for c in cols[1:])], names=schema.names)

    names = [x.split()[0] for x in row.split(", ")]
    id_kind = to_arrow_type(urls.schema[0].dataType)
    salt = F.pmod(F.xxhash64(F.col(id_name), F.col("path")), F.lit(1 << 30)).alias("salt")
    both = urls.select(id_name, "host", "path", "__key", salt).mapInArrow(deal_urls, row).unionByName(rules.where("verdict is not null").mapInArrow(deal_rules, row))
    return both.repartition(places, "place").sortWithinPartitions("place", "kind", "__key", "path").mapInArrow(sweep, schema)
