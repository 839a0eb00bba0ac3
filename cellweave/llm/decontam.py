"""Benchmark decontamination by SimHash over item-sized windows.

The similarity of a benchmark item and a window of as many words is taken on their sets of five-word shingles, weighted by rarity
among the items, w(s) = ln(1 + items / items that hold s):

    similarity = weight in common / the greater of both weights,

and a window of at least 0.8 is a hit.  An item of one to four words is one shingle, all of its words.

1. *Windows.*  Every window as long as an item (or up to the text's end) counts, for each length that items have.  One is left out only if the
   weights of its shingles that any item holds, each time they occur, are below 0.8 of the least weight of the items of its length: its
   similarity with each of them is below 0.8 then.
2. *Fingerprints.*  The 128-bit SimHash of each window and item over their weighted shingles.  Two fingerprints within Hamming
   radius 47 differ by at most two bits in one of sixteen 8-bit blocks; an index for each block gives, for each of its 256 values,
   the items of that length within two bits, so the union over the blocks holds every item within the radius.  These are the candidates.
   At similarity 0.8 the expected distance is 26 bits with a deviation of 4.6, between strangers 64 with 5.7.
3. *Proof.*  Candidates within the radius have their similarity computed exactly.

Items are taken in rounds of bounded size, each broadcast to one pass over the documents; documents are never shuffled.  Weights are
those of the whole benchmark in every round, so results do not depend on the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.session import id_and_text, small_batches
from cellweave.llm.words import Words, mix, slices, text_buffer, valid_windows, window_hashes, words_of

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 47, 16
#: Words of items in one round, each item counting ITEM more for its place in the index, positions whose votes are summed up at once, and pairs of windows and items whose candidates are.
ROUND_WORDS, ITEM, CHUNK, PAIRS = 1_000_000, 16, 8192, 1 << 24
SCHEMA = "doc_id long, item_id long, start long, n_words long, similarity double"


def _shingles(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each position, and whether a shingle of that size starts there."""
    hashes = np.zeros(len(h), np.uint64)
    if len(h) >= size:
        hashes[: len(h) - size + 1] = window_hashes(h, size)
    return hashes, valid_windows(words.first, size)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of weighted hashes, as BLOCKS bytes, by prefix sums of votes; runs must not be empty.

    Weights are taken in steps of 2**-20, so that sums are exact and equal runs have equal fingerprints.
    """
    out, votes = np.zeros((len(starts), BLOCKS), np.uint8), np.rint(weights * (1 << 20)).astype(np.int64)
    if not len(starts):
        return out
    by_start = np.argsort(starts, kind="stable")
    begin = starts[by_start]
    reach = np.maximum.accumulate(begin + counts[by_start])
    new = np.maximum(begin, np.r_[0, reach[:-1]])  # what earlier runs do not hold
    at = _ranges(new, reach - new)
    low = np.searchsorted(at, starts)
    high, order = low + counts, np.argsort(low, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(low[order] // CHUNK)) + 1):
        begin, x = low[part[0]], at[low[part[0]] : high[part].max()]
        wide = np.stack([hashes[x], mix(hashes[x] ^ np.uint64(0x9E3779B97F4A7C15))], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(-1, BLOCKS), axis=1)
        sums = np.zeros((len(x) + 1, 8 * BLOCKS), np.int64)
        np.cumsum(np.where(bits, votes[x, None], -votes[x, None]), axis=0, out=sums[1:])
        for k in range(0, len(part), CHUNK):
            some = part[k : k + CHUNK]
            out[some] = np.packbits(sums[high[some] - begin] > sums[low[some] - begin], axis=1)
    return out


def _ranges(low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """low, low + 1 and so on, as many as counted, one range behind the other"""
    return np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


#: By shingle size: weight of a shingle that at most one item holds, hashes of the others, sorted, and their weights.
Weights = dict[int, tuple[float, np.ndarray, np.ndarray]]


def _find(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are known, and where among the known ones (sorted) they are; most others fail at a table of their top bits."""
    if not len(known):
        return (np.zeros(0, np.int64),) * 2
    top = np.zeros(1 << 20, bool)
    top[known >> np.uint64(44)] = True
    at = np.flatnonzero(top[hashes >> np.uint64(44)])
    place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    same = known[place] == hashes[at]
    return at[same], place[same]


def _weigh(hashes: np.ndarray, plain: float, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight of each shingle."""
    out = np.full(len(hashes), plain)
    at, place = _find(hashes, known)
    out[at] = weight[place]
    return out


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of items -> (size, hash) of their distinct shingles, and a null hash for each item with words"""
    for batch in batches:
        words = words_of(*text_buffer(batch.column(0)))
        h, sizes = words.hashes(), np.minimum(words.counts, SHINGLE)
        for size in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == size)
            counts = words.counts[mine] - size + 1
            x = _shingles(words, h, size)[0][_ranges(words.first[mine], counts)]
            own = np.unique(np.stack([x, np.repeat(mine, counts).astype(np.uint64)], axis=1), axis=0)[:, 0].view(np.int64) if len(x) else np.zeros(0, np.int64)
            hashes = pa.concat_arrays([pa.nulls(len(mine), pa.int64()), pa.array(own, pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), size), pa.int32()), hashes], names=["size", "hash"])


def _weights(texts: DataFrame) -> Weights:
    """Weights over all items.  Only shingles that two items hold at least reach the driver."""
    n = texts.mapInArrow(_item_shingles, "size int, hash long").groupBy("size", "hash").agg(F.count("*").alias("df"))
    table = n.where("df > 1 or hash is null").toArrow()
    size, df = (table.column(c).to_numpy() for c in ("size", "df"))
    item, hashes = table.column("hash").is_null().to_numpy(), table.column("hash").fill_null(0).to_numpy().view(np.uint64)
    out = {}
    for k in np.unique(size).tolist():
        items, mine = df[(size == k) & item].sum(), (size == k) & ~item
        order = np.argsort(hashes[mine])
        out[k] = (float(np.log1p(items)), hashes[mine][order], np.log1p(items / df[mine][order]))
    return out


@dataclass
class Length:
    """The items of one length, with an index of their fingerprints: near[k, v] has a bit for each item within RADIUS // BLOCKS of v in block k."""

    words: int
    items: np.ndarray
    totals: np.ndarray
    prints: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, words: int, items: np.ndarray, totals: np.ndarray, prints: np.ndarray) -> Length:
        values = np.arange(256, dtype=np.uint8)
        close = np.unpackbits(values[:, None] ^ values, axis=1).reshape(256, 256, 8).sum(axis=2) <= RADIUS // BLOCKS
        return cls(words, items, totals, prints, np.stack([np.packbits(close[:, prints[:, k]], axis=1) for k in range(BLOCKS)]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of the item) of all pairs within the radius, from the union of the blocks' lists."""
        out = [(np.zeros(0, np.int64),) * 2]
        step = max(1, PAIRS // (8 * self.near.shape[2]))
        for low in range(0, len(prints), step):
            some = prints[low : low + step]
            listed = self.near[0, some[:, 0]].copy()
            for k in range(1, BLOCKS):
                listed |= self.near[k, some[:, k]]
            window, item = np.nonzero(np.unpackbits(listed, axis=1, count=len(self.items)))
            within = np.unpackbits(some[window] ^ self.prints[item], axis=1).sum(axis=1) <= RADIUS
            out.append((window[within] + low, item[within]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Items:
    """A round of benchmark items, ready to search.

    `weights` has, by shingle size, the weight of a shingle that at most one item holds, and hashes (sorted) and weights of the others;
    without it the round is the whole benchmark.
    """

    def __init__(self, rows: list[tuple[int | None, str]], weights: Weights | None = None):
        words = words_of(*text_buffer(pa.array([t for _, t in rows], pa.string())))
        h, n = words.hashes(), words.counts
        self.ids, self.words = pa.array([i for i, _ in rows], pa.int64()), n
        sizes = np.minimum(n, SHINGLE)
        self.by_size, self.weights = {}, {} if weights is None else None
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            hashes, _ = _shingles(words, h, size)
            counts = n[mine] - size + 1
            x, ends = hashes[_ranges(words.first[mine], counts)], np.cumsum(counts)
            place = np.repeat(np.arange(len(mine)), counts)
            pairs = np.unique(np.stack([x, place.astype(np.uint64)], axis=1), axis=0)
            known, df = np.unique(pairs[:, 0], return_counts=True)
            if weights is None:
                self.weights[size] = (float(np.log1p(len(mine))), known[df > 1], np.log1p(len(mine) / df[df > 1]))
            weight = _weigh(known, *(weights or self.weights)[size])
            totals = np.bincount(pairs[:, 1].astype(np.int64), np.repeat(weight, df), len(mine))
            prints = fingerprints(x, weight[np.searchsorted(known, x)], ends - counts, counts)
            runs = dict(zip(mine.tolist(), (np.unique(r) for r in np.split(x, ends[:-1])), strict=True))
            groups = [Length.of(k, mine[at], totals[at], prints[at]) for k in np.unique(n[mine]).tolist() for at in [np.flatnonzero(n[mine] == k)]]
            self.by_size[size] = (known, weight, groups, runs)

    def search(self, words: Words, weights: Weights | None = None) -> tuple[np.ndarray, ...]:
        """document, item, start and similarity of the best window of every document and item with a hit"""
        h, out = words.hashes(), []
        doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
        for size, (known, weight, groups, runs) in self.by_size.items():
            hashes, ok = _shingles(words, h, size)
            hit, place = _find(hashes, known)
            hit, place = hit[ok[hit]], place[ok[hit]]
            if not len(hit):
                continue
            w = _weigh(hashes, *(weights or self.weights)[size])
            cum = np.zeros(len(hashes) + 1)
            cum[hit + 1] = weight[place]
            cum = np.cumsum(cum)
            first, last = words.first[doc_of[hit]], words.first[doc_of[hit] + 1]
            laid = []
            for group in groups:
                least = THRESHOLD * group.totals.min() - 1e-6
                # Every window around a shared shingle, but for those that cannot hold enough.
                low, high = np.maximum(hit - (group.words - size), first), np.minimum(hit + group.words, last) - size
                rich = cum[np.maximum(high, hit) + 1] - cum[low] >= least
                pos, low = hit[rich], low[rich]
                low = np.maximum(low, np.r_[-1, pos[:-1]] + 1)
                begin = _ranges(low, pos - low + 1)
                end = np.minimum(begin + group.words, words.first[doc_of[begin] + 1])
                most = cum[end - size + 1] - cum[begin]
                rich = most >= least
                laid.append((begin[rich], end[rich], most[rich]))
            # Windows of all lengths together, as they share their votes.
            begin, end, _ = (np.concatenate(c) for c in zip(*laid, strict=True))
            prints = np.split(fingerprints(hashes, w, begin, end - begin - size + 1), np.cumsum([len(x) for x, _, _ in laid])[:-1])
            for group, mine, (begin, end, most) in zip(groups, prints, laid, strict=True):
                if not len(begin):
                    continue
                window, at = group.candidates(mine)
                begin, end, most, total, item = begin[window], end[window], most[window], group.totals[at], group.items[at]
                # The most promising windows first; one that cannot be better than the best so far is passed over.
                order = np.lexsort((begin, -most, item, doc_of[begin]))
                order = order[most[order] >= THRESHOLD * total[order] - 1e-6]
                best: dict[tuple, tuple] = {}
                for d, i, b, e, m, t in zip(*(c[order].tolist() for c in (doc_of[begin], item, begin, end, most, total)), strict=True):
                    so_far = best.get((d, i))
                    if so_far and (m / t < so_far[0] - 1e-9 or (b > -so_far[1] and min(m / t, 1) < so_far[0] + 1e-9)):
                        continue
                    own, where = np.unique(hashes[b : e - size + 1], return_index=True)
                    s = w[b + where][np.isin(own, runs[i], assume_unique=True)].sum() / max(w[b + where].sum(), t)
                    if s >= THRESHOLD - 1e-9:
                        found = (min(round(s, 9), 1.0), -b)
                        best[d, i] = max(found, so_far or found)
                out += [(d, i, -b, s) for (d, i), (s, b) in best.items()]
        if not out:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        d, i, b, s = (np.array(c) for c in zip(*out, strict=True))
        return d, i, b - words.first[d], s


def _search(batches: Iterator[pa.RecordBatch], items: Items, weights: Weights | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = words_of(*text_buffer(part.column(1)))
            d, i, b, s = items.search(words, weights)
            order = np.lexsort((i, d))
            d, i, b, s = d[order], i[order], b[order], s[order]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(d, pa.int64())), items.ids.take(pa.array(i, pa.int64())), pa.array(b, pa.int64()), pa.array(np.minimum(items.words[i], words.counts[d] - b), pa.int64()), pa.array(s, pa.float64())],
                names=["doc_id", "item_id", "start", "n_words", "similarity"],
            )


def _rounds(benchmark: DataFrame, item_col: str, item_text: str) -> list[tuple[Broadcast, Broadcast | None]]:
    """The items in rounds of bounded size, and the weights of the whole benchmark where there are several."""
    spark = benchmark.sparkSession
    out, held, size, weights = [], [], 0, None
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        n = len((row[1] or "").encode().translate(None, b" \t\n\v\f\r")) and len(row[1].split()) + 1
        if n:
            if size >= ROUND_WORDS:
                # More than one round: weights are those of the whole benchmark in each.
                weights = weights or spark.sparkContext.broadcast(_weights(benchmark.select(F.col(item_text).cast("string"))))
                out.append((spark.sparkContext.broadcast(Items(held, weights.value)), weights))
                held, size = [], 0
            held.append((row[0], row[1]))
            size += n + ITEM
    if held:
        out.append((spark.sparkContext.broadcast(Items(held, weights and weights.value)), weights))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item with a hit, at its best window: of those most similar (to nine places) the first.

    Items without words and rows with null texts hit nothing; ids, null ones and repeated ones too, are passed on as they are, a row for each row.
    """
    source, result = id_and_text(docs, id_col, text_col), None
    for items, weights in _rounds(benchmark, item_col, item_text):
        found = source.mapInArrow(lambda batches, items=items, weights=weights: _search(batches, items.value, weights and weights.value), SCHEMA)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return source.where("false").select("doc_id", *(F.lit(0).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")[1:])))
    return result


def _clean(batches: Iterator[pa.RecordBatch], text_col: str, items: Items, weights: Weights | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index(text_col)
        for part in slices(batch, text_col):
            keep = np.ones(part.num_rows, bool)
            keep[items.search(words_of(*text_buffer(part.column(at))), weights)[0]] = False
            yield part.filter(pa.array(keep))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without a hit, as they are; each is judged by its own text, whatever its id.  Documents are read once, whatever the rounds, and not shuffled."""
    small_batches(docs.sparkSession)
    for items, weights in _rounds(benchmark, item_col, item_text):
        docs = docs.mapInArrow(lambda batches, items=items, weights=weights: _clean(batches, text_col, items.value, weights and weights.value), docs.schema)
    return docs
