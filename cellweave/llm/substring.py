"""Substring dedup by repeated-phrase automata.

A window is 50 consecutive words of one document.  A word goes if a window that covers it has
a word sequence that also starts in a document with a smaller id.  Windows are judged on the
input, so the order in which documents are handled does not matter.

1. *Recurring anchors.*  From every run of 26 consecutive 25-word phrases, all inside one window, the
   least hash is the window's anchor.  Equal windows have equal anchors, so a window can recur
   only if its anchor occurs in two documents.  About one position in ten is an anchor.
   Texts that are exact copies are settled here: all but the smallest id lose every word of theirs
   that a window covers, which is all of them or none.
2. *Confirmed passages.*  Only windows with a recurring anchor are hashed, counted and traced to
   the smallest document that holds them.  The runs of such windows in that document, as far as
   some later document shares them, are the recurring passages.
3. *Sharded automata.*  Documents are dealt to shards by a hash of their id; a passage, cut into pieces
   of at most PIECE windows first, goes to those shards where a document needs it.  Each shard compiles its
   passages, in 25-word blocks, into Aho-Corasick automata of bounded size and streams its documents through them.  A
   window of a passage always holds a whole block; each occurrence of a block is extended
   left and right, word by word, against the passage, so what is removed is compared as text.

Rows with a null id lose nothing and are nobody's source.  A null text has no words.  Rows that
share an id are one document as far as they never cause each other's removal; each is judged by its own text,
so rows of one id with different texts keep different words, in any order.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.session import Scratch, id_and_text, list_array
from cellweave.llm.words import Words, doc_hashes, sliding, slices, text_buffer, valid_windows, window_hashes, words_of

WINDOW = 50
BLOCK = 25
PIECE = 256
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Text that one shard's documents hold, and passage characters in one automaton (some 80 bytes each when compiled).
SHARD_BYTES, AUTOMATON_CHARS = 1 << 20, 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def joined(words: Words) -> Iterator[memoryview]:
    """The words of each document, joined by one space, as bytes."""
    data, n = words.data.copy(), len(words.starts)
    keep = np.zeros(len(data), bool)
    ends = words.starts + words.lengths
    delta = np.zeros(len(data) + 1, np.int8)
    np.add.at(delta, words.starts, 1)
    np.add.at(delta, ends, -1)
    keep[:] = np.cumsum(delta[:-1])
    last = np.zeros(n, bool)
    last[words.first[1:][words.counts > 0] - 1] = True
    data[ends[~last]], keep[ends[~last]] = 0x20, True
    size = words.lengths + ~last
    total = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=total[1:])
    flat = memoryview(np.ascontiguousarray(data[keep]))
    for i, j in zip(total[words.first[:-1]], total[words.first[1:]], strict=True):
        yield flat[i:j]


def _anchor_hash(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 25-word phrases, and for each window the least of its phrases' (0: no window starts there)."""
    phrases = window_hashes(h, BLOCK)
    least = sliding(np.minimum, phrases, WINDOW - BLOCK + 1) if len(h) >= WINDOW else phrases[:0]
    ok = valid_windows(first, WINDOW)[: len(least)]
    return phrases, np.where(ok, least, np.uint64(0))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, th) -> what pass one keeps of a document."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(*text_buffer(part.column(1)))
            h = words.hashes()
            _, least = _anchor_hash(h, words.first)
            at = np.flatnonzero(least)
            doc = np.searchsorted(words.first, at, side="right") - 1
            change = np.r_[True, (least[at][1:] != least[at][:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
            pairs = np.unique(np.rec.fromarrays([doc[change], least[at][change]], names="d,a")) if len(at) else None
            d, a = (pairs.d, pairs.a) if pairs is not None else (doc, least[at])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(words.counts, pa.int64()),
                    pa.array(doc_hashes(h, words.first, 1).view(np.int64)),
                    pa.array(doc_hashes(h, words.first, 2).view(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined(words)], pa.string()),
                    list_array(np.asarray(a).view(np.int64), np.bincount(d, minlength=part.num_rows), pa.int64()),
                ],
                names=["doc_id", "th", "n_words", "k1", "k2", "sha", "anchors"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, th, recurring anchors) -> (window hash, doc_id, th, position), once for each window of a text."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(*text_buffer(part.column(1)))
            h = words.hashes()
            _, least = _anchor_hash(h, words.first)
            anchors = part.column(3)
            known = np.unique(anchors.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            at = np.flatnonzero(least)
            at = at[np.isin(least[at], known)]
            hashes = window_hashes(h, WINDOW)[at]
            doc = np.searchsorted(words.first, at, side="right") - 1
            order = np.lexsort((at, hashes, doc))
            at, hashes, doc = at[order], hashes[order], doc[order]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
            of = pa.array(doc[new], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[new].view(np.int64)), part.column(0).take(of), part.column(2).take(of), pa.array((at - words.first[doc])[new], pa.int64())],
                names=["wh", "doc_id", "th", "pos"],
            )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, pieces: piece, first and last window) -> (src, sth, piece, passage)"""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out: list[tuple] = []
        for doc, th, text, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = WORD.findall(text or "")
            out += [(doc, th, p["piece"], " ".join(words[p["lo"] : p["hi"] + WINDOW])) for p in pieces]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["src", "sth", "piece", "passage"])


class PassageAutomaton:
    """Passages of earlier documents, compiled block by block."""

    def __init__(self, passages: list[tuple[int, list[str]]]):
        self.passages, self.blocks = passages, ahocorasick.Automaton()
        for k, (_, words) in enumerate(passages):
            for at in range(0, len(words) - BLOCK + 1, BLOCK):
                block = f" {' '.join(words[at : at + BLOCK])} "
                if block in self.blocks:
                    self.blocks.get(block).append((k, at))
                else:
                    self.blocks.add_word(block, [(k, at)])
        self.blocks.make_automaton()

    def spans(self, doc: int, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of at least a window that a passage of a smaller document shares."""
        text = f" {' '.join(words)} "
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
        done: dict[tuple[int, int], int] = {}
        out = []
        for end, found in self.blocks.iter(text):
            at = bisect_left(ends, end) + 1 - BLOCK
            for k, block_at in found:
                source, other = self.passages[k]
                if source >= doc or at < done.get((k, at - block_at), -1):
                    continue
                i, j = at, block_at
                while i and j and words[i - 1] == other[j - 1]:
                    i, j = i - 1, j - 1
                stop, j = at + BLOCK, block_at + BLOCK
                while stop < len(words) and j < len(other) and words[stop] == other[j]:
                    stop, j = stop + 1, j + 1
                done[k, at - block_at] = stop
                if stop - i >= WINDOW:
                    out.append((i, stop))
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


_LOCATED = "doc_id long, th long, n_words long, n_removed long, removed array<long>, kept_sha256 string, kept string"


def _locate(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, doc_id, th, text), sorted, passages before documents -> a row for each document; texts: with the kept words, where some go."""
    names, kinds = [x.split()[0] for x in _LOCATED.split(", ")], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
    shard, passages, docs = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in docs]
        if passages and docs:
            groups, size = [[]], 0
            for p in dict.fromkeys((doc, text) for doc, _, text in passages):
                if size + len(p[1]) > AUTOMATON_CHARS and groups[-1]:
                    groups.append([])
                    size = 0
                groups[-1].append(p)
                size += len(p[1])
            for group in groups:
                automaton = PassageAutomaton([(s, text.split(" ")) for s, text in group])
                for k, (doc, _, text) in enumerate(docs):
                    found[k] += automaton.spans(doc, WORD.findall(text or ""))
                del automaton
        rows = []
        for (doc, th, text), spans in zip(docs, found, strict=True):
            words, spans = WORD.findall(text or ""), merge(spans)
            kept, at = [], 0
            for i, j in spans:
                kept += words[at:i]
                at = j
            kept = " ".join(kept + words[at:])
            gone = sum(j - i for i, j in spans)
            rows.append((doc, th, len(words), gone, [x for s in spans for x in s], hashlib.sha256(kept.encode()).hexdigest(), kept if texts and gone else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for s, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                yield from flush()
                shard, passages, docs = s, [], []
            (docs if kind else passages).append(row)
    yield from flush()


def _repeats(docs: DataFrame, id_col: str, text_col: str, texts: bool) -> DataFrame:
    """A row for each row of docs: doc_id, th, n_words, n_removed, removed, kept_sha256, kept (with texts, where some words go but not all).

    th is a hash of the text where the id is repeated, else 0, so that (doc_id, th) tells rows apart and costs next to nothing.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col, F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    key = ["doc_id", "th"]
    with Scratch(spark) as tmp:
        seen = tmp.table(source.mapInArrow(_profile, "doc_id long, th long, n_words long, k1 long, k2 long, sha string, anchors array<long>"), "profile")
        again = tmp.table(seen.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
        if again.isEmpty():
            told = lambda df: df.withColumn("th", F.lit(0).cast("long"))
        else:
            told = lambda df: df.join(again.withColumn("__again", F.lit(True)), "doc_id", "left").withColumn("th", F.when(F.col("__again"), F.col("th")).otherwise(F.lit(0))).drop("__again")
        copies = tmp.table(seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
        # Tables on both sides, so that the join can split a hot class.  Repeated ids are not settled here: their rows may differ.
        later = seen.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"]).where("doc_id > rep").select("doc_id")
        later = tmp.table(later.join(again, "doc_id", "left_anti"), "later")
        anchors = seen.where("size(anchors) > 0 and doc_id is not null").join(later, "doc_id", "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
        shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
        recurring = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        candidates = tmp.table(told(source.join(recurring, "doc_id")).select("doc_id", "text", "th", "anchors"), "candidates")

        windows = tmp.table(candidates.mapInArrow(_windows, "wh long, doc_id long, th long, pos long"), "windows")
        confirmed = windows.groupBy("wh").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("hi"), F.min_by("th", "doc_id").alias("sth"), F.min_by("pos", "doc_id").alias("at"))
        confirmed = tmp.table(confirmed.where("src < hi").drop("hi"), "confirmed")
        total = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES))
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
        needed = windows.select("wh", "doc_id").join(confirmed, "wh").where("doc_id > src")
        needed = needed.groupBy("src", "sth", F.floor(F.col("at") / PIECE).alias("piece"), shard).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
        needed = tmp.table(needed, "needed")
        # The text of a piece is cut once; only then it is copied for the shards.
        pieces = needed.groupBy("src", "sth", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        pieces = pieces.groupBy(F.col("src").alias("doc_id"), F.col("sth").alias("th")).agg(F.collect_list(F.struct("piece", "lo", "hi")).alias("pieces"))
        cut = candidates.select("doc_id", "th", "text").join(pieces, key).mapInArrow(_passages, "src long, sth long, piece long, passage string")
        cut = tmp.table(cut.dropDuplicates(["src", "sth", "piece"]), "passages")
        passages = needed.join(cut, ["src", "sth", "piece"]).select("shard", F.lit(0).cast("int").alias("kind"), F.col("src").alias("doc_id"), F.col("sth").alias("th"), F.col("passage").alias("text"))
        rows = passages.unionByName(candidates.select(shard, F.lit(1).cast("int").alias("kind"), "doc_id", "th", "text"))
        rows = rows.repartition(max(1, min(shards, 20000)), "shard").sortWithinPartitions("shard", "kind")
        located = tmp.table(rows.mapInArrow(lambda b: _locate(b, texts), _LOCATED), "located")

        whole = F.col("later") & (F.col("n_words") >= WINDOW)
        rest = told(seen.drop("anchors")).join(later.withColumn("later", F.lit(True)), "doc_id", "left").join(located.select(key).distinct(), key, "left_anti")
        rest = rest.select(
            *key,
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
            F.when(whole, F.array(F.lit(0).cast("long"), "n_words")).otherwise(F.array().cast("array<long>")).alias("removed"),
            F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"),
            F.lit(None).cast("string").alias("kept"),
        )
        return tmp.keep(located.unionByName(rest), "repeats")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, removed (starts and ends of word ranges, flat), kept_sha256."""
    return _repeats(docs, id_col, text_col, False).drop("th", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated words cut out; those of which nothing is left go.  Other texts stay byte for byte.

    A row is cut by its own id and text, so rows that share an id never lose words of each other.
    """
    found = _repeats(docs, id_col, text_col, True).where("n_removed > 0").dropDuplicates(["doc_id", "th"])
    found = found.select(F.col("doc_id").alias("__cut_id"), F.col("th").alias("__cut_th"), (F.col("n_removed") < F.col("n_words")).alias("__cut_some"), F.col("kept").alias("__cut_kept"))
    same = (F.col(id_col).cast("long") == F.col("__cut_id")) & F.col("__cut_th").isin(F.lit(0), F.xxhash64(F.col(text_col).cast("string")))
    left = docs.join(found, same, "left").where("__cut_id is null or __cut_some")
    return left.withColumn(text_col, F.coalesce("__cut_kept", text_col)).select(docs.columns)
