"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

*Terms* of a text, all of it, in two families: character trigrams of its UTF-8 bytes, hashed to CHARS terms; and pairs of neighbouring
words, each word taken as new to the text, seen before in it, or the same as the one before.  Counts are damped by a square root, weighted by
rarity, and each family is brought to unit length.

*Space.*  A bounded sample of labelled documents (SAMPLE, by hash of the id) is decomposed by a randomised SVD; terms are projected
on the first DIMENSIONS right singular vectors.  The projection and the sample's vectors are broadcast; their size is bounded by those
two parameters.

*Vote.*  Every document meets every labelled vector in blocked matrix products of unit vectors, exact cosines.  Its NEIGHBOURS nearest
vote with weight max(cosine, 0) ** POWER, and a little weight (PRIOR) goes to the sample's mean label:

    score = (sum of weight * label + PRIOR * mean) / (sum of weight + PRIOR).

A text without terms (empty, null) has no direction and gets the mean.  Without labels every score is 1: nothing speaks against a text.  A text is
handled in stretches of STRETCH bytes, so a very long one costs some ten bytes for each byte of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.session import id_and_text, small_batches
from cellweave.llm.words import Words, mix, slices, text_buffer, words_of

SAMPLE, DIMENSIONS, NEIGHBOURS, PRIOR, POWER = 6000, 64, 24, 0.05, 8
THRESHOLD = 0.7
#: Rows whose terms are held at once, some 40 kB each, and bytes whose trigrams are.
ROWS, STRETCH = 512, 1 << 20
CHARS, KINDS = 4096, 3
FAMILIES = (slice(0, CHARS), slice(CHARS, CHARS + KINDS * (KINDS + 1)))
TERMS = FAMILIES[-1].stop


def word_kinds(words: Words, of: np.ndarray) -> np.ndarray:
    """0: a word new to its text, 1: seen before, 2: the same as the word before it."""
    h = words.hashes()
    order = np.lexsort((h, of))  # stable, so the first of equal words comes first
    again, seen = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    seen[order[1:]] = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    return np.where(again, 2, seen.astype(np.int64))


def terms(texts: pa.Array) -> np.ndarray:
    """Damped counts of each term, a row for each text."""
    data, offsets = text_buffer(texts)
    n, size = len(offsets) - 1, int(offsets[-1])
    counts = np.zeros(n * CHARS, np.int64)
    for low in range(0, max(size - 2, 0), STRETCH):
        at = np.arange(low, min(low + STRETCH, size - 2))
        x = data[low : at[-1] + 3].astype(np.uint64)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[doc + 1]
        term = mix(x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)) >> np.uint64(40)
        counts += np.bincount((doc * CHARS + (term % np.uint64(CHARS)).astype(np.int64))[inside], minlength=len(counts))
    words = words_of(data, offsets)
    of = np.repeat(np.arange(n), words.counts)
    kind = word_kinds(words, of)
    after = np.zeros(len(kind), np.int64)  # 0: the text ends
    after[:-1] = np.where(of[1:] == of[:-1], kind[1:] + 1, 0)
    pairs = np.bincount(of * KINDS * (KINDS + 1) + kind * (KINDS + 1) + after, minlength=n * KINDS * (KINDS + 1))
    return np.sqrt(np.concatenate([counts.reshape(n, -1), pairs.reshape(n, -1)], axis=1).astype(np.float32))


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted terms, each family counting the same."""
    return _unit(np.concatenate([_unit(counts[:, f] * rarity[f]) for f in FAMILIES], axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Voter:
    """All that scoring needs."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Voter:
        if not len(labels):
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
        rarity = np.log1p(len(counts) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
        x = _weighted(counts, rarity)
        q = np.random.default_rng(11).standard_normal((x.shape[1], min(dimensions + 8, *x.shape))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        projection = (q @ vt.T)[:, :dimensions]
        return cls(rarity, projection, _unit(x @ projection), labels.astype(np.float32))

    def scores(self, texts: pa.Array, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(texts))
        v, mean = _unit(_weighted(terms(texts), self.rarity) @ self.projection), float(self.labels.mean())
        out, k = np.empty(len(v)), min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(v), block):
            cosine = v[low : low + block] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:] if k < cosine.shape[1] else np.broadcast_to(np.arange(k), cosine.shape)
            w = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** POWER
            out[low : low + block] = ((w * self.labels[near]).sum(axis=1) + PRIOR * mean) / (w.sum(axis=1) + PRIOR)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Voter:
    """Learn from at most `sample` rows of labels (null ids, null or other labels than 0 and 1 left out), never from held-out ids.

    An id with both labels counts for both; of several texts with the same id the one with the least terms counts.
    """
    picked = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = picked.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=ROWS):
                x = terms(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for r in x], pa.binary()), pa.array([r[r != 0].tobytes() for r in x], pa.binary())], names=["doc_id", "y", "at", "value"])

    # The sample is bounded, so it may be broadcast; the documents are read once and not shuffled.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, at binary, value binary")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("at", "value")).alias("x")).select("doc_id", "y", "x.*").toPandas().sort_values(["doc_id", "y"])
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return Voter.fit(x, rows["y"].to_numpy())


def score(docs: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted.  A null id is never held out; equal texts have equal scores."""
    box = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=1 << 20, rows=ROWS):
                s = box.value.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs, id_col, text_col, held_out(F.col(id_col)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, voter: Voter, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, as they are, whatever their ids."""
    small_batches(docs.sparkSession)
    box, at = docs.sparkSession.sparkContext.broadcast(voter), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20, ROWS):
                yield part.filter(pa.array(box.value.scores(part.column(at)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
