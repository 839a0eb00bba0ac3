"""Language-model scoring by a hidden Markov model over words.

Tokens are words, A-Z lower-cased, and one end token for each text.  The unigram base and the model learn from the training
documents only, from all of them:

* *Counts.*  Every task counts words by their 64-bit hash; the counts are summed over all tasks and kept as a table, however
  many words there are.
* *Symbols.*  The OWN most frequent words are symbols of their own, the end token is one, and every other word falls in one of 256
  classes by its last bytes.  Within its class a word has probability (c + 0.5) / (sum of c + 0.5 over the class + s + 0.5), and a word never seen
  (s + 0.5) / (same), s being how many of the class's words were seen once.  So the model is a proper one over
  all words, while its parameters are of a fixed size.
* *Baum-Welch.*  The model starts from the symbols' shares in all training documents times seeded noise, which makes the states differ.  Each
  iteration runs the scaled forward-backward recursion over all training documents, whole ones; expected counts are summed within each task and
  then, in blocks of symbols, across partitions in two steps; only the model, of fixed size, reaches the driver.
* *Scores.*  The scaled forward recursion gives the exact likelihood of each whole text's symbols, to which the within-class
  probabilities of its words are added.

The counts of the KNOWN most frequent words are broadcast (a bounded table); the rest of a text's words, a few in a
hundred, meet their counts in a join.  Texts are encoded once; later passes read two bytes a token.  A recursion holds some hundred bytes for each of
about BATCH_TOKENS tokens; a text longer than STRETCH goes in stretches, from states kept at their edges, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.session import Scratch, id_and_text, list_array
from cellweave.llm.words import Words, slices, text_buffer, words_of

STATES, ITERATIONS, SEED = 8, 10, 5
OWN, CLASSES, KNOWN = 12_000, 256, 1 << 18
END = OWN + CLASSES
SYMBOLS = OWN + CLASSES + 1
#: Share of each state's emissions that follows the base, so that no symbol is impossible.
SMOOTH = 0.01
#: Tokens that one recursion handles, tokens of a long text that it does, entries that a task's counts hold, symbols in a block of counts.
BATCH_TOKENS, STRETCH, HELD_WORDS, BLOCK = 500_000, 1 << 18, 400_000, 512
#: Steps after which a recursion is scaled again, at most.  Emissions are taken over the symbols' shares, so they stay near one in between.
SCALED = 8
#: Tasks whose counts are added up in the first of two steps.
FAN_IN = 64
LOG10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def word_classes(words: Words) -> np.ndarray:
    """A class for each word, by its last two bytes."""
    last = words.data[words.starts + words.lengths - 1].astype(np.uint32)
    before = np.where(words.lengths > 1, words.data[words.starts + words.lengths - 2], 0).astype(np.uint32)
    return ((last * 257 + before) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word hash, class, count), as many times as a task's counts grow too long."""
    keys, classes, counts = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(classes, pa.int64()), pa.array(counts)], names=["wh", "class", "c"])

    for batch in batches:
        for part in slices(batch):
            words = words_of(*text_buffer(part.column(0), lower=True))
            k, first, c = np.unique(words.hashes(), return_index=True, return_counts=True)
            all_k, all_class = np.concatenate([keys, k]), np.concatenate([classes, word_classes(words)[first]])
            keys, first, at = np.unique(all_k, return_index=True, return_inverse=True)
            classes, counts = all_class[first], np.bincount(at, np.concatenate([counts, c]), len(keys)).astype(np.int64)
            if len(keys) > HELD_WORDS:
                yield out()
                keys, classes, counts = keys[:0], classes[:0], counts[:0]
    yield out()


@dataclass
class Lexicon:
    """What encoding needs: the most frequent words, sorted by hash, and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # of words with a symbol of their own; -1: their class's
    docs: int
    total: int  # N
    distinct: int  # V
    mass: np.ndarray  # of each class: sum of (c + 0.5) + once seen + 0.5
    once: np.ndarray

    def __post_init__(self):
        # Place of the first hash with each value of the top bits, so that a look-up is a few steps.
        self.bits = max(1, int(np.log2(max(len(self.hashes), 2))))
        top = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(top, np.arange((1 << self.bits) + 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[top], self.starts[top + 1]
        rest = np.flatnonzero(at < stop)
        while len(rest):
            same = self.hashes[at[rest]] == h[rest]
            out[rest[same]] = at[rest[same]]
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < stop[rest]]
        return out

    @property
    def z(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def _encode(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held_out, row) -> symbols as bytes, sums over known words, and hashes and classes of the others."""
    end = (lexicon.docs, np.log10((lexicon.docs + 0.5) / lexicon.z))
    base_of = np.log10((lexicon.counts + 0.5) / lexicon.z)
    for batch in batches:
        for part in slices(batch):
            words = words_of(*text_buffer(part.column(1), lower=True))
            h, classes, n = words.hashes(), word_classes(words), words.counts
            at = lexicon.find(h)
            found = at >= 0
            own = np.where(found, lexicon.symbols[at] if len(lexicon.symbols) else -1, -1)
            symbols = np.where(own >= 0, own, OWN + classes)
            base, inner = np.zeros(len(h)), np.zeros(len(h))
            base[found] = base_of[at[found]]
            shared = found & (own < 0)
            inner[shared] = np.log10((lexicon.counts[at[shared]] + 0.5) / lexicon.mass[classes[shared]])
            doc = np.repeat(np.arange(part.num_rows), n)
            with_end = np.full(len(h) + part.num_rows, END, np.uint16)
            with_end[np.arange(len(h)) + doc] = symbols
            bounds = (words.first + np.arange(part.num_rows + 1)) * 2
            blob = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(with_end)])
            rest = np.bincount(doc[~found], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(3), part.column(0), part.column(2), pa.array(n + 1, pa.int64()),
                    pa.array(np.bincount(doc[found], minlength=part.num_rows) + (end[0] > 0), pa.int64()),
                    pa.array(np.bincount(doc, base, part.num_rows) + end[1], pa.float64()), pa.array(np.bincount(doc, inner, part.num_rows), pa.float64()),
                    blob, list_array(h[~found].view(np.int64), rest, pa.int64()), list_array(classes[~found].astype(np.int32), rest, pa.int32()),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "symbols", "others", "classes"],
            )


_ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, symbols binary, others array<long>, classes array<int>"


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states
    base: np.ndarray  # each symbol's share

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Model:
        start, move = start + 1, move + 1
        share = emit / np.maximum(emit.sum(axis=0), 1e-300)
        share = (1 - SMOOTH) * share + SMOOTH * base[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), share / share.sum(axis=0), base)

    @classmethod
    def first(cls, base: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """Shares times noise, and states that last."""
        noise = np.random.default_rng(seed).exponential(size=(len(base), states))
        return cls.from_counts(np.zeros(states), 30 * np.eye(states), base[:, None] * noise, base)

    def ratios(self, kind: type) -> np.ndarray:
        """Emissions over the symbols' shares; a symbol without a share occurs nowhere."""
        return (self.emit / np.where(self.base > 0, self.base, 1)[:, None]).astype(kind)

    def steps(self, kind: type) -> int:
        """Steps without scaling in which alpha times beta stays in the range of numbers."""
        largest = float(np.log10(max(self.ratios(kind).max(initial=1), 10)))
        return int(np.clip(np.log10(np.finfo(kind).max) / 2 / largest - 1, 1, SCALED))

    def log_base(self) -> np.ndarray:
        return np.log(np.where(self.base > 0, self.base, 1))


class Recursion:
    """Scaled forward and backward recursion of many texts at once: step t handles all texts longer than t.

    Rows lie step by step, the longest text first.  enter: for each text the chances of its first state (else the model's start), leave: for each
    text what follows its last state (else nothing).
    """

    def __init__(self, model: Model, texts: list[np.ndarray], kind: type = np.float64, ratios: np.ndarray | None = None, enter: np.ndarray | None = None, leave: np.ndarray | None = None, scaled: int | None = None):
        sizes = np.array([len(t) for t in texts])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.model, self.kind, self.leave = model, kind, leave if leave is None else leave[self.order]
        live = np.searchsorted(-self.sizes, -np.arange(1, self.sizes[0] + 1), side="right")
        at = np.r_[0, np.cumsum(live)]
        self.live, self.at = live.tolist(), at.tolist()
        rank = np.repeat(np.arange(len(sizes)), self.sizes)
        step = np.arange(len(rank)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.symbols = np.empty(len(rank), np.int64)
        self.symbols[at[step] + rank] = np.concatenate([texts[k] for k in self.order])
        self.last = at[self.sizes - 1] + np.arange(len(sizes))
        self.followed = np.arange(len(rank)) - np.repeat(at[:-1], live) < np.repeat(np.r_[live[1:], 0], live)
        self.enter = np.broadcast_to(model.start, (len(sizes), len(model.start))) if enter is None else enter[self.order]
        self.emit = (model.ratios(kind) if ratios is None else ratios)[self.symbols]
        self.scaled = model.steps(kind) if scaled is None else scaled

    def forward(self) -> None:
        """Fills alpha, and logs, the logarithm of each text's likelihood over its symbols' shares."""
        live, at, emit, move = self.live, self.at, self.emit, self.model.move.astype(self.kind)
        alpha, logs = np.empty_like(emit), np.zeros(len(self.sizes))
        now = alpha[: live[0]]
        np.multiply(emit[: live[0]], self.enter, out=now, casting="same_kind")
        for t in range(1, len(live)):
            n, before = live[t], now
            now = alpha[at[t] : at[t + 1]]
            np.matmul(before[:n], move, out=now)
            now *= emit[at[t] : at[t + 1]]
            if t % self.scaled == 0:
                scale = now.sum(axis=1)
                now /= scale[:, None]
                logs[:n] += np.log(scale)
        self.alpha = alpha
        self.logs = logs + np.log(alpha[self.last].sum(axis=1, dtype=np.float64))

    def log_likelihoods(self) -> np.ndarray:
        """Natural logarithms, in the given order; exact but for rounding."""
        self.forward()
        out = np.empty(len(self.logs))
        out[self.order] = self.logs
        return out

    def ends(self) -> np.ndarray:
        """Chances of the last state of each text, in the given order."""
        out = np.empty((len(self.sizes), len(self.model.start)))
        out[self.order] = self.alpha[self.last]
        return out / out.sum(axis=1, keepdims=True)

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the log likelihood over the symbols' shares."""
        self.forward()
        live, at, back = self.live, self.at, np.ascontiguousarray(self.model.move.T).astype(self.kind)
        beta, ahead = np.empty_like(self.emit), self.emit  # emissions become beta times emission
        ones = np.ones((len(self.sizes), len(back)), self.kind) if self.leave is None else self.leave.astype(self.kind)
        now = beta[at[-2] :]
        now[:] = ones[: len(now)]
        for t in range(len(live) - 2, -1, -1):
            n, then = live[t + 1], ahead[at[t + 1] : at[t + 2]]
            then *= now
            now = beta[at[t] : at[t + 1]]
            np.matmul(then, back, out=now[:n])
            if t % self.scaled == 0:
                scale = now[:n].sum(axis=1)[:, None]
                now[:n] /= scale
                then /= scale
            now[n:] = ones[n : live[t]]
        self.first_ahead = ahead[: live[0]] * now
        beta *= self.alpha
        total = beta.sum(axis=1)[:, None]
        move = (self.alpha[self.followed] / total[self.followed]).T @ ahead[live[0] :]
        beta /= total
        emit = np.stack([np.bincount(self.symbols, beta[:, z], SYMBOLS) for z in range(len(back))], axis=1)
        return beta[: live[0]].sum(axis=0, dtype=np.float64), move.astype(np.float64) * self.model.move, emit, float(self.logs.sum())


def in_stretches(model: Model, text: np.ndarray, kind: type = np.float64, ratios: np.ndarray | None = None, scaled: int | None = None, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Recursion.expected() of one text, holding the rows of one stretch at a time."""
    parts = [text[k : k + (size or STRETCH)] for k in range(0, len(text), size or STRETCH)]
    enter, ends, fit = [model.start[None]], [], 0.0
    for part in parts:
        r = Recursion(model, [part], kind, ratios, enter[-1], scaled=scaled)
        r.forward()
        fit += float(r.logs.sum())
        ends.append(r.ends())
        enter.append(ends[-1] @ model.move)
    move, emit, leave = np.zeros_like(model.move), np.zeros_like(model.emit), None
    for k in range(len(parts) - 1, -1, -1):
        r = Recursion(model, [parts[k]], kind, ratios, enter[k], leave, scaled)
        start, m, e, _ = r.expected()
        move, emit = move + m, emit + e
        if k:
            over = ends[k - 1].T * model.move * r.first_ahead
            move += over / over.sum()
            leave = r.first_ahead @ model.move.T
            leave = leave / leave.sum()
    return start, move, emit, fit


def log_likelihood(model: Model, text: np.ndarray, size: int = 0) -> float:
    """Natural logarithm of one text's likelihood over its symbols' shares, stretch by stretch."""
    enter, total = model.start[None], 0.0
    for k in range(0, len(text), size or STRETCH):
        r = Recursion(model, [text[k : k + (size or STRETCH)]], enter=enter)
        total += float(r.log_likelihoods()[0])
        enter = r.ends() @ model.move
    return total


def _pools(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Group rows whose last value is a text's symbols into batches, of texts of like length but for the last few; a text longer than STRETCH is alone."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}
    for row in rows:
        n = len(row[-1])
        if n > STRETCH:
            yield [row]
            continue
        k = (2 * n).bit_length() // 2
        held.setdefault(k, []).append(row)
        size[k] = size.get(k, 0) + n
        if size[k] >= BATCH_TOKENS:
            yield held.pop(k)
            del size[k]
    rest, n = [], 0
    for k in sorted(held, reverse=True):
        rest, n = rest + held[k], n + size[k]
        if n >= BATCH_TOKENS:
            yield rest
            rest, n = [], 0
    if rest:
        yield rest


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple]:
    for batch in batches:
        others = [batch.column(k).to_pylist() for k in range(batch.num_columns) if k != column]
        for k, blob in enumerate(batch.column(column)):
            yield *(o[k] for o in others), np.frombuffer(blob.as_py(), np.uint16)


def _expect(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Symbols -> expected counts of the task: block -1 holds likelihood, starts and moves, the others emissions of BLOCK symbols each."""
    states = len(model.start)
    start, move, emit, fit = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states)), 0.0
    ratios, scaled = model.ratios(np.float32), model.steps(np.float32)
    for pool in _pools(_texts(batches)):
        texts = [r[-1] for r in pool]
        s, m, e, f = in_stretches(model, texts[0], np.float32, ratios, scaled) if len(texts[0]) > STRETCH else Recursion(model, texts, np.float32, ratios, scaled=scaled).expected()
        start, move, emit, fit = start + s, move + m, emit + e, fit + f
    blobs = [np.r_[fit, start, move.ravel()].tobytes(), *(emit[k : k + BLOCK].tobytes() for k in range(0, SYMBOLS, BLOCK))]
    team = (TaskContext.get().partitionId() if TaskContext.get() else 0) // FAN_IN
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blobs) - 1), pa.int32()), pa.array([team] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "team", "counts"])


_COUNTS = "block int, team int, counts binary"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for block, team, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.frombuffer(blob.as_py())
            total[block, team] = total[block, team] + x if (block, team) in total else x
    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "team", "counts"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(row, symbols) -> (row, log10 probability of the symbols)"""
    ratios, scaled, log_base = model.ratios(np.float64), model.steps(np.float64), model.log_base()
    for pool in _pools(_texts(batches, 1)):
        texts = [r[-1] for r in pool]
        ll = np.array([log_likelihood(model, texts[0])]) if len(texts[0]) > STRETCH else Recursion(model, texts, ratios=ratios, scaled=scaled).log_likelihoods()
        own = np.array([log_base[t].sum() for t in texts])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in pool], pa.int64()), pa.array((ll + own) / LOG10)], names=["row", "markov"])


class MarkovScorer:
    """Learns from the documents that are not held out, and scores all."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS):
        self.docs, self.spark = id_and_text(docs, id_col, text_col, held_out(F.col(id_col)).alias("held_out")), docs.sparkSession
        self.states, self.iterations, self.history = states, iterations, []

    def _lexicon(self, tmp: Scratch) -> tuple[Lexicon, DataFrame]:
        train = self.docs.where("not held_out")
        words = train.select("text").mapInArrow(_count, "wh long, class long, c long").groupBy("wh").agg(F.min("class").alias("class"), F.sum("c").alias("c"))
        words = tmp.table(words, "words")
        per_class = words.groupBy("class", (F.col("c") == 1).alias("once")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).toPandas()
        docs = train.count()
        # The least count that leaves at most KNOWN words, from a histogram of a few hundred rows; nothing is sorted.
        octave = F.floor(F.log2("c") * 8).alias("octave")
        sizes = sorted(((r[0], r[1]) for r in words.groupBy(octave).count().collect()), reverse=True)
        reach = np.cumsum([n for _, n in sizes])
        low = [o for (o, _), x in zip(sizes, reach, strict=True) if x <= KNOWN]
        top = words.where(octave >= (low[-1] if low else 1 << 30)).select("wh", "class", "c").toArrow().sort_by([("c", "descending"), ("wh", "ascending")])
        h, classes, c = (top.column(k).to_numpy() for k in range(3))
        n, v = per_class.groupby("class")["n"].sum(), per_class.groupby("class")["v"].sum()
        mass, once = np.zeros(CLASSES), np.zeros(CLASSES)
        mass[n.index], once[per_class["class"][per_class["once"]]] = n + 0.5 * v, per_class["v"][per_class["once"]]
        np.subtract.at(mass, classes[:OWN], c[:OWN] + 0.5)  # words with a symbol of their own are not in their class
        np.subtract.at(once, classes[:OWN][c[:OWN] == 1], 1)
        symbols = np.full(len(h), -1, np.int32)
        symbols[:OWN] = np.arange(min(OWN, len(h)))
        order = np.argsort(h.view(np.uint64))
        total, distinct = int(n.sum()) + docs, int(v.sum()) + (docs > 0)
        return Lexicon(h.view(np.uint64)[order], c[order], symbols[order], docs, total, distinct, mass + once + 0.5, once), words

    def scores(self) -> DataFrame:
        """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

        A null text has its end token only.  A null id is never held out.  Without training documents every word is as likely as its class
        makes it, and base_score is what the formula gives for N = 0.
        """
        sc = self.spark.sparkContext
        with Scratch(self.spark) as tmp:
            lexicon, words = self._lexicon(tmp)
            box = sc.broadcast(lexicon)
            source = self.docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"))
            encoded = tmp.table(source.mapInArrow(lambda b: _encode(b, box.value), _ENCODED), "encoded")

            each = encoded.where("size(others) > 0").select("row", F.explode(F.arrays_zip("others", "classes")).alias("w")).select("row", F.col("w.others").alias("wh"), F.col("w.classes").alias("class"))
            classes = self.spark.createDataFrame([(k, float(m), float(o)) for k, (m, o) in enumerate(zip(lexicon.mass, lexicon.once, strict=True))], "class int, mass double, once double")
            met = each.join(words.select("wh", "c"), "wh", "left").join(F.broadcast(classes), "class")
            c = F.coalesce("c", F.lit(0))
            rest = met.groupBy("row").agg(
                F.count("c").alias("known2"),
                F.sum(F.log10((c + 0.5) / F.lit(float(lexicon.z)))).alias("base2"),
                F.sum(F.log10(F.coalesce(F.col("c"), F.col("once")) + 0.5) - F.log10("mass")).alias("inner2"),
            )
            rest = tmp.table(rest, "rest")

            train = encoded.where("not held_out").select("symbols")
            base = np.zeros(SYMBOLS)
            own = lexicon.symbols >= 0
            base[lexicon.symbols[own]], base[OWN:END], base[END] = lexicon.counts[own] + 0.5, lexicon.mass, lexicon.docs + 0.5
            base /= base.sum()
            model, tasks = Model.first(base, self.states), train.rdd.getNumPartitions()
            for _ in range(self.iterations):
                held = sc.broadcast(model)
                parts = train.mapInArrow(lambda b, held=held: _expect(b, held.value), _COUNTS)
                summed = parts.repartition("block", "team").mapInArrow(_add_up, _COUNTS)
                if tasks > FAN_IN:
                    summed = summed.withColumn("team", F.lit(0)).repartition("block").mapInArrow(_add_up, _COUNTS)
                summed = summed.collect()
                held.destroy()
                got = {r.block: np.frombuffer(r.counts) for r in summed}
                s = self.states
                if got:
                    emit = np.concatenate([got[k] for k in range(len(got) - 1)]).reshape(SYMBOLS, s)
                    self.history.append(float(got[-1][0] + emit.sum(axis=1) @ model.log_base()))
                    model = Model.from_counts(got[-1][1 : s + 1], got[-1][s + 1 :].reshape(s, s), emit, base)
            self.model, self.lexicon = model, lexicon
            held = sc.broadcast(model)
            markov = tmp.table(encoded.select("row", "symbols").mapInArrow(lambda b: _score(b, held.value), "row long, markov double"), "markov")
            out = encoded.drop("symbols", "others", "classes").join(markov, "row").join(rest, "row", "left")
            zero = F.lit(0.0)
            out = out.select(
                "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
                (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("markov") + F.col("inner") + F.coalesce("inner2", zero)).alias("score"),
            )
            return tmp.keep(out, "scores")
