"""Packing documents into token sequences by order-preserving dynamic programming.

The documents of a partition, each with an end token, form one stream in their given order.  Cuts are chosen
among document ends, sentence ends and, in stretches without either, places HARD_STEP tokens apart (with step=1, after any token).
With f(c) the least cost of the stream up to cut c, and a window (b, c] of at most 4096 tokens,

    f(c) = penalty(c) + SEQUENCE + min over b of f(b) + padding(c - b).

A sequence is padded to 4096, so padding is linear in b: the minimum of f(b) + b over a sliding window, kept by a monotone
queue in amortised constant time.  Windows whose length is a power of two need no padding; those
are at most thirteen more transitions for each cut.  The penalty is nothing at a document's end, one token at a
sentence's end and sixteen elsewhere, so texts are truncated only where that saves padding.

The program runs over the whole stream of a partition.  Windows are given out as soon as all cuts from which it may go on agree on them,
and only what lies behind them is held; how often that is tried (BLOCK_TOKENS) changes nothing in the result.  Partitions are packed on their own,
so nothing is shuffled; the end of each partition ends a sequence, which is the one way in which the layout of the input matters.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cellweave.llm.session import id_and_text
from cellweave.llm.tokens import tokenizer
from cellweave.llm.words import slices

LENGTH = 4096
END_ID = 2
SENTENCE, HARD, SEQUENCE = 1, 16, 32
HARD_STEP = 64
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Frontier:
    """The dynamic program over cuts (rising places, gaps of at most `length`) that arrive in parts, from place 0 on."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        # Of all cuts behind the last one that is settled, and of that one itself: place, f, f + place, and the cut before.
        self.place, self.cost, self.value, self.came = [0], [0], [0], [0]
        self.queue = deque([0])

    def extend(self, cuts: np.ndarray, penalty: np.ndarray) -> None:
        known, first = len(self.place), bisect_left(self.place, int(cuts[0]) - self.length) if len(cuts) else 0
        places = np.concatenate([np.array(self.place[first:], np.int64), cuts])
        at = np.full(int(places[-1] - places[0]) + 1, -1, np.int64)
        at[places - places[0]] = np.arange(len(places)) + first
        ends, begins, step = [], [], 1
        while step <= self.length:
            before = cuts - step - places[0]
            b = np.where(before >= 0, at[np.maximum(before, 0)], -1)
            ends.append(np.flatnonzero(b >= 0))
            begins.append(b[b >= 0])
            step *= 2
        ends, begins = np.concatenate(ends), np.concatenate(begins)
        begins, bounds = begins[np.argsort(ends, kind="stable")].tolist(), np.r_[0, np.cumsum(np.bincount(ends, minlength=len(cuts)))].tolist()
        place, cost, value, came, queue, length = self.place, self.cost, self.value, self.came, self.queue, self.length
        for k, (c, price) in enumerate(zip(cuts.tolist(), (penalty + SEQUENCE).tolist(), strict=True)):
            while place[queue[0]] < c - length:
                queue.popleft()
            b = queue[0]
            least = value[b] + length - c
            for i in begins[bounds[k] : bounds[k + 1]]:
                if cost[i] < least:
                    least, b = cost[i], i
            v = least + price + c
            place.append(c)
            cost.append(v - c)
            value.append(v)
            came.append(b)
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(known + k)

    def _path(self, k: int) -> list[int]:
        out = []
        while k:
            out.append(self.place[k])
            k = self.came[k]
        return out[::-1]

    def settled(self) -> list[int]:
        """Ends of windows that every way to go on has in common; what lies before them is forgotten."""
        n = len(self.place)
        live = bytearray(n)
        first = bisect_left(self.place, self.place[-1] - self.length)
        live[first:] = b"\1" * (n - first)
        count, k = n - first, n - 1
        while count > 1:
            if live[k]:
                count -= 1
                b = self.came[k]
                count += not live[b]
                live[b] = 1
            k -= 1
        while not live[k]:
            k -= 1
        out = self._path(k)
        self.place, self.cost, self.value = self.place[k:], self.cost[k:], self.value[k:]
        self.came = [max(b - k, 0) for b in self.came[k:]]
        self.queue = deque(i - k for i in self.queue)
        return out

    def finished(self) -> list[int]:
        """Ends of the windows up to the last cut."""
        return self._path(len(self.place) - 1)


def cut_places(stream: np.ndarray, bounds: np.ndarray, ending: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream of documents that end at `bounds` may be cut, and their penalties."""
    sentence = np.flatnonzero(ending[stream]) + 1
    places = np.unique(np.concatenate([[0], sentence, bounds]))
    wide = np.flatnonzero(np.diff(places) > (4 * step if step > 1 else 1))
    if len(wide):
        extra = [np.arange(places[k] + step, places[k + 1], step) for k in wide]
        places = np.unique(np.concatenate([places, *extra]))
    penalty = np.full(len(places), HARD)
    penalty[np.searchsorted(places, sentence)] = SENTENCE
    penalty[np.searchsorted(places, bounds)] = 0
    return places[1:], penalty[1:]


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, with_ids: bool, step: int = HARD_STEP) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    ending, frontier = t.ending(), Frontier(LENGTH)
    sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    held: deque[tuple] = deque()  # (doc_id, ids, start, doc_tokens) of what is not given out yet
    at = end = held_tokens = 0  # where the stream is given out up to, and where it ends

    def give(windows: list[int]) -> pa.RecordBatch:
        nonlocal sequence, at, held_tokens
        rows, ids_out, begin = [], [], at
        for w in windows:
            while at < w:
                doc, ids, start, tokens = held.popleft()
                take = min(len(ids), w - at)
                piece = ids[:take]
                if take < len(ids):
                    held.appendleft((doc, ids[take:], start + take, tokens))
                rows.append((doc, start, take, zlib.crc32(piece.tobytes()), tokens, sequence, at - begin))
                if with_ids:
                    ids_out.append(piece)
                at += take
            begin, sequence = w, sequence + 1
        held_tokens = end - at
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if with_ids:
            cols.append(pa.array([x.astype(np.int32) for x in ids_out], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in batches:
        for part in slices(batch):
            flat, bounds = t.encode_flat(part.column(1))
            flat, bounds = np.insert(flat, bounds[1:], END_ID), bounds + np.arange(len(bounds))
            cuts, penalty = cut_places(flat, bounds[1:], ending, step)
            frontier.extend(cuts + end, penalty)
            held.extend((doc, flat[i:j], 0, j - i) for doc, i, j in zip(part.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False))
            end += len(flat)
            held_tokens += len(flat)
            if held_tokens >= BLOCK_TOKENS:
                yield give(frontier.settled())
    if held:
        yield give(frontier.finished())


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False, step: int = HARD_STEP) -> DataFrame:
    """A row for each piece of a document; with_ids adds the piece's token ids; step=1 allows cuts after any token.

    A null or empty text is its end token alone; a null id stays null.  Rows that repeat an id are packed as documents of their own, and of equally
    cheap ways the longest last window is taken, or one that needs no padding only if it is cheaper.  Other columns, whatever their names, are not
    read.  A very long text is held as a whole, with some ten bytes for each of its tokens.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda batches: _pack(batches, path, with_ids, step), schema)
