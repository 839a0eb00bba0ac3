"""Encoding with a public word-level BPE vocabulary, remembering the ids of words."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from cellweave.llm.words import Words, text_buffer, words_of

VOCABULARY = "word_bpe_49k.json"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stems that are encoded as one text, words that are remembered, and punctuation that is.
GROUP, REMEMBERED, SMALL = 200, 1_000_000, 50_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps a vocabulary file; called on executors, so each looks for its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Word hash -> place and number of its ids, sorted by hash, with an index on the top bits."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.at, self.n = keys[order], at[order], n[order]
        self.bits = max(1, len(keys).bit_length())
        self.starts = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[top], self.starts[top + 1]
        rest = np.flatnonzero(at < stop)
        while len(rest):
            same = self.keys[at[rest]] == h[rest]
            out[rest[same]] = at[rest[same]]
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < stop[rest]]
        return out


class WordTokenizer:
    """Equal to encoding whole texts: the vocabulary's pattern never joins what white space parts.

    Nor does it join letters with the ASCII punctuation behind them, so a word of both has the ids of its letters and then of its
    punctuation; letters that are new are encoded many at a time and told apart by the vocabulary's word-end mark.  Words are remembered by
    their 64-bit hash in two tables, a large one and one of recent words that is merged into it as it grows.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.small: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")
        self.old, self.fresh = _Table(none.astype(np.uint64), none, none), _Table(none.astype(np.uint64), none, none)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        stems = [w.rstrip(_PUNCTUATION) for w in words]
        stems = [(s.lower() if s.isascii() else s) if s.isalpha() else "" for s in stems]
        new = list(set(stems) - {""})
        groups = [new[k : k + GROUP] for k in range(0, len(new), GROUP)]
        learned: dict[str, bytes] = {}
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            bounds = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(bounds) == len(group):
                raw = ids.tobytes()
                learned.update(zip(group, map(raw.__getitem__, map(slice, [0, *bounds[:-1]], bounds)), strict=True))
            else:  # some letter is parted by lower-casing
                learned.update((s, self._whole(s)) for s in group)
        if len(self.small) > SMALL:
            self.small.clear()
        out = []
        for w, s in zip(words, stems, strict=True):
            if not s:
                out.append(self._whole(w))
            elif len(w) == len(s):
                out.append(learned[s])
            else:
                rest = w[len(s) :]
                ids = self.small.get(rest)
                if ids is None:
                    ids = self.small[rest] = self._whole(rest)
                out.append(learned[s] + ids)
        return out

    def _find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of the ids of each word."""
        h = words.hashes()
        if len(self.old.keys) + len(self.fresh.keys) > self.remembered:
            self._forget()
        at, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        missing = np.arange(len(h))
        for table in (self.old, self.fresh):
            if len(table.keys) and len(missing):
                row = table.find(h[missing])
                found = row >= 0
                at[missing[found]], n[missing[found]] = table.at[row[found]], table.n[row[found]]
                missing = missing[~found]
        if len(missing):
            keys, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            starts, raw = words.starts[missing[first]], words.data.tobytes()
            stops = starts + words.lengths[missing[first]]
            ids = self._ids([raw[i:j].decode() for i, j in zip(starts.tolist(), stops.tolist(), strict=True)])
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            place = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            at[missing], n[missing] = place[which], size[which]
            f = self.fresh
            self.fresh = _Table(np.concatenate([f.keys, keys]), np.concatenate([f.at, place]), np.concatenate([f.n, size]))
            if len(self.fresh.keys) * 4 > len(self.old.keys):
                o, f = self.old, self.fresh
                self.old = _Table(np.concatenate([o.keys, f.keys]), np.concatenate([o.at, f.at]), np.concatenate([o.n, f.n]))
                self.fresh = _Table(f.keys[:0], f.at[:0], f.n[:0])
        return at, n

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's start (one more at the end).  Null: none."""
        words = words_of(*text_buffer(texts))
        at, n = self._find(words)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends]).astype(np.int64)[words.first]

    def encode(self, text: str | None) -> bytes:
        return self.encode_flat(pa.array([text], pa.string()))[0].tobytes()

    def ending(self) -> np.ndarray:
        """For each id, whether it is punctuation that ends a sentence."""
        out = np.zeros(len(self.ends), bool)
        for token, k in self.tokenizer.get_vocab().items():
            mark = token.removesuffix("</w>")
            out[k] = mark != token and any(c in ".!?" for c in mark) and all(c in _PUNCTUATION for c in mark)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> WordTokenizer:
    """One per Python worker, so that its memory serves all tasks."""
    return WordTokenizer(path or vocabulary_path())
