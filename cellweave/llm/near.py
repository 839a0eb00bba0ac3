"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of at
least 0.8.  A text of one to four words has one shingle, all of its words; a text without words
(empty, blank, null) has none and is linked with nothing.

1. *Copies.*  Documents with the same words become one class, named by its least id; only that
   document goes on, with the size of its class.
2. *Buckets.*  160 MinHash values, 32 bands of five.  At similarity 0.8 two documents share no band with
   probability 3e-6.  Each bucket is joined to its least member, a star, never to all its pairs;
   the components of these stars are clusters that hold every candidate pair whole.
3. *Pruning and proof.*  A cluster is dealt by hash to blocks of bounded size, and each pair of blocks is
   one unit of work, so a cluster of any size is spread over many tasks.  Within a unit, pairs that share a
   band have their MinHash values compared 16 at a time; with a uniform prior the posterior of the
   similarity after m matches in n is Beta(m + 1, n - m + 1), and a pair goes as soon as its
   probability of reaching 0.8 falls below the tolerance (1e-6).  The rest are verified exactly on their
   shingles, in bulk by a product of incidence matrices where that is cheaper.
   A unit returns one row per document, its number of links and its root, never the pairs.
4. *Groups.*  A cluster of one unit is grouped there; the roots of split clusters, a forest, are joined by
   components().

Of rows that share an id, the words with the least hash stand for it, whatever the order of the rows; other words under that
id are compared with nothing, and one_of_each() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.session import Scratch, components, id_and_text, list_array
from cellweave.llm.words import Words, doc_hashes, mix, slices, text_buffer, valid_windows, window_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-6
#: What one block of a cluster holds, about, and shingles for one task.
BLOCK_SHINGLES, BLOCK_DOCS, TASK_SHINGLES = 1_000_000, 1024, 400_000


@lru_cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all documents in turn, repeats included, and their number in each."""
    h, n = words.hashes(), words.counts
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out = np.zeros(int(counts.sum()), np.uint64)
    at = np.cumsum(counts) - counts
    short = (n < SHINGLE) & (n > 0)
    out[at[short]] = doc_hashes(h, words.first, 3)[short]
    is_long = np.ones(len(out), bool)
    is_long[at[short]] = False
    if is_long.any():
        ok = valid_windows(words.first, SHINGLE)
        ok[words.first[:-1][short]] = False
        full = window_hashes(h, SHINGLE)
        out[is_long] = full[ok[: len(full)]]
    return out, counts


def minhash(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of HASHES values for each document; all ones where it has no shingle."""
    out = np.full((HASHES, len(counts)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        x, at = (shingles >> np.uint64(32)).astype(np.uint32), (np.cumsum(counts) - counts)[some]
        for k, (a, b) in enumerate(zip(*_family(), strict=True)):
            out[k, some] = np.minimum.reduceat((x ^ b) * a, at)
    return out.T


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each document; different bands never share keys but by chance."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(BANDS):
        out[:, k] = k + 1
        for j in range(k * ROWS, k * ROWS + ROWS):
            out[:, k] = mix(out[:, k] * np.uint64(0x9FB21C651E98DF25) ^ signature[:, j].astype(np.uint64))
    return out


@lru_cache
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the least matches that leave a pair in the running.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=1 << 19):
            words = words_of(*text_buffer(part.column(1)))
            h = words.hashes()
            shingles, counts = shingle_hashes(words)
            keys = bands(minhash(shingles, counts))
            some = counts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(doc_hashes(h, words.first, 1).view(np.int64)),
                    pa.array(doc_hashes(h, words.first, 2).view(np.int64)),
                    pa.array(counts, pa.int64()),
                    list_array(keys[some].view(np.int64).ravel(), np.where(some, BANDS, 0), pa.int64()),
                ],
                names=["doc_id", "th", "k1", "k2", "n", "bands"],
            )


def _candidates(keys: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of rows that share a band, in two columns, each once; rows of equal side >= 0 aren't paired."""
    n = len(keys)
    shared = np.zeros((n, n), bool)  # two blocks at most, so a few MB
    for band in keys.T:
        order = np.argsort(band, kind="stable")
        x = band[order]
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        sizes = np.diff(np.r_[starts, n])
        for at, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            rows = order[at : at + size]
            shared[rows[:, None], rows] = True
    shared &= (side[:, None] != side) | (side < 0)
    return np.argwhere(np.triu(shared, 1))


def _verified(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (two columns of rows) reach the threshold exactly."""
    sizes = np.array([len(s) for s in sets])
    used = np.unique(pairs)
    if len(pairs) > 4 * len(used) and len(pairs) * 4e-5 > len(used) ** 2 * sizes[used].sum() * 2e-11:
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        rows = np.repeat(np.arange(len(used)), sizes[used])
        _, cols = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
        common = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        for low in range(0, int(cols[-1]) + 1, 4096):
            i, j = np.searchsorted(cols, [low, low + 4096])
            block = np.zeros((len(used), 4096), np.float32)
            block[rows[i:j], cols[i:j] - low] = 1
            common += block @ block.T
        shared = common[place[pairs[:, 0]], place[pairs[:, 1]]]
    else:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs])
    return shared >= threshold * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - shared) - 1e-6


def links(texts: list[str | None], side: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Linked pairs among the texts, two columns of rows; those of equal side >= 0 aren't compared."""
    counts, sigs, sets = [], [], []
    for part in slices(pa.table({"text": pa.array(texts, pa.string())}), size=1 << 19):
        shingles, n = shingle_hashes(words_of(*text_buffer(part.column(0))))
        counts.append(n)
        sigs.append(minhash(shingles, n))
        sets += [np.unique(x) for x in np.split(shingles, np.cumsum(n)[:-1])]
    signature = np.concatenate(sigs)
    live = np.flatnonzero(np.concatenate(counts))
    pairs = live[_candidates(bands(signature[live]), side[live])]
    matches = np.zeros(len(pairs), np.int32)
    for n, least in least_matches(threshold, tolerance).items():
        for at in range(0, len(pairs), 1 << 16):
            p = pairs[at : at + (1 << 16)]
            matches[at : at + (1 << 16)] += (signature[p[:, 0], n - STEP : n] == signature[p[:, 1], n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        pairs, matches = pairs[keep], matches[keep]
    return pairs[_verified(sets, pairs, threshold)] if len(pairs) else pairs


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    parent = list(range(n))
    for a, b in pairs.tolist():
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    for k in range(n):
        parent[k] = parent[parent[k]]
    return parent


def _text_keys(texts: list[str | None]) -> list[tuple[int, int]]:
    """The hashes k1, k2 of each text's words."""
    words = words_of(*text_buffer(pa.array(texts, pa.string())))
    h = words.hashes()
    return list(zip(*(doc_hashes(h, words.first, k).view(np.int64).tolist() for k in (1, 2)), strict=True))


def _one_text_each(rows: list[tuple]) -> list[tuple]:
    """Rows (block, id, copies, text) in the order of their ids: of those that share an id the one with the least hash."""
    again = {a[1] for a, b in zip(rows, rows[1:], strict=False) if a[1] == b[1]}
    if not again:
        return rows
    some = [r for r in rows if r[1] in again]
    best = {}
    for r, k in zip(some, _text_keys([r[3] for r in some]), strict=True):
        if r[1] not in best or k < best[r[1]][0]:
            best[r[1]] = k, r
    return sorted([r for r in rows if r[1] not in again] + [r for _, r in best.values()], key=lambda r: r[1])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cluster, i, j, parts, block, doc_id, copies, text) -> (doc_id, links, root, whole) for each unit (cluster, i, j)."""
    unit, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = _one_text_each(sorted(held, key=lambda r: r[1]))
        if len(rows) < 2:
            return
        block, ids, copies = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        pairs = links([r[3] for r in rows], block if unit[1] != unit[2] else np.full(len(rows), -1))
        if len(pairs):
            n = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(rows)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(rows))
            some = np.flatnonzero(n)
            roots = np.array(_roots(len(rows), pairs))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(ids[roots[some]]), pa.array(np.full(len(some), unit[3] == 1))], names=["doc_id", "links", "root", "whole"])

    for batch in batches:
        for *key, block, doc, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(key) != unit:
                yield from flush()
                unit, held = tuple(key), []
            held.append((block, doc, copies, text))
    yield from flush()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each id: doc_id, class_id (least id of its group), copy_id (least id with the same words), n_links.

    n_links counts the other documents that are linked with it directly, copies among them.  A row whose id is null
    stands alone: it keeps nulls for its class, and no links.
    """
    return _near(docs, id_col, text_col, False)


def _near(docs: DataFrame, id_col: str, text_col: str, to_drop: bool) -> DataFrame:
    """near_duplicates(), or with to_drop (doc_id, th) of the rows that have a smaller document in their group; th: 0, or where the id is repeated a hash of the text."""
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col, F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    with Scratch(spark) as tmp:
        rows = tmp.table(source.where("doc_id is not null").mapInArrow(_profile, "doc_id long, th long, k1 long, k2 long, n long, bands array<long>"), "profile")
        seen = rows
        again = tmp.table(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
        if not again.isEmpty():
            least = F.min_by(F.struct("k1", "k2", "n", "bands"), F.struct("k1", "k2")).alias("x")
            several = rows.join(again, "doc_id").groupBy("doc_id").agg(least).select("doc_id", "x.*")
            seen = tmp.table(rows.drop("th").join(again, "doc_id", "left_anti").unionByName(several), "seen")
        copies = seen.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies")).where("copies > 1")
        copies = tmp.table(copies, "copies")  # a table, so that the join below can split a hot class
        classes = tmp.table(seen.drop("bands").join(copies, ["k1", "k2"], "left").select("doc_id", "k1", "k2", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("copies", F.lit(1)).alias("copies"), "n"), "classes")
        reps = classes.where("doc_id = copy_id and n > 0").select("doc_id", "copies", "n")

        members = seen.select("doc_id", "bands").join(reps.select("doc_id"), "doc_id").select("doc_id", F.explode("bands").alias("band"))
        members = tmp.table(members, "members")
        stars = members.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1")
        clusters = tmp.table(components(tmp, members.join(stars, "band").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))), "clusters")

        held = reps.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
        size = held.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("parts"))
        held = held.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = held.select("doc_id", "copies", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "parts", "block", "n")
        held = tmp.table(held, "held")
        tasks = (held.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES + 1
        work = source.select("doc_id", "text").join(held, "doc_id").select("cluster", "i", "j", "parts", "block", "doc_id", "copies", "text")
        work = work.repartition(min(tasks, 20000), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        found = tmp.table(work.mapInArrow(_unit, "doc_id long, links long, root long, whole boolean"), "links")

        groups = components(tmp, found.where("not whole").select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("doc_id").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
        counts = counts.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "links", F.coalesce("component", "root").alias("component"))
        counts = tmp.table(counts, "counts")  # a table too, for the same reason
        out = classes.join(counts.withColumnRenamed("doc_id", "copy_id"), "copy_id", "left")
        out = out.select("doc_id", F.coalesce("component", "copy_id").alias("class_id"), "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "k1", "k2")
        if to_drop:
            out = tmp.table(out.where("doc_id <> class_id").select("doc_id", "k1", "k2"), "later")
            zero = F.lit(0).cast("long").alias("th")
            several = rows.join(again, "doc_id").select("doc_id", "th", "k1", "k2").join(out, ["doc_id", "k1", "k2"]).select("doc_id", "th").distinct()
            single = out.join(again, "doc_id", "left_anti").select("doc_id", zero)
            return tmp.keep((out.select("doc_id", zero) if again.isEmpty() else single.unionByName(several)).repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "drop")
        none = F.lit(None).cast("long")
        alone = source.where("doc_id is null").select("doc_id", none.alias("class_id"), none.alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
        return tmp.keep(out.drop("k1", "k2").unionByName(alone), "near")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a smaller one in their group.

    Rows with a null id stay, and so do words that were not compared as another row with their id stood for it.
    """
    rest = _near(docs, id_col, text_col, True).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = (F.col(id_col).cast("long") == F.col("__id")) & F.col("__th").isin(F.lit(0), F.xxhash64(F.col(text_col).cast("string")))
    return docs.join(rest, same, "left_anti")
