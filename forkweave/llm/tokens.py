"""Token ids of whole texts, by a public tokenizer, with a cache of chunks."""

from __future__ import annotations

import os
import re
from itertools import accumulate, chain, islice

import numpy as np

from .textnum import LOWER, SPACE, Words, prefix_sums

SAME = np.arange(256, dtype=np.uint8)

#: White space of four kinds and the other characters behind it.
_PLAIN = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space of any kind that is none of these four; texts that hold it are encoded whole.
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x85\u180e\u200b\ufeff]")
_LATIN_SPACE = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
#: The letters of Latin-1.
_LETTERS = np.array([chr(x).isalpha() for x in range(256)])
_APOSTROPHE = 39
#: What stands before a run is part of it: nothing, a newline or a space; and its part of the run's hash.
_LEADS = ("", "\n", " ")
_LEAD_BITS = np.array([0x1F0E3DA5C7, 0x5AC7D3, 0], np.uint64)
#: Byte-level vocabularies write a byte as the character of that number if it is printable, else from 256 on in order.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Runs encoded as one text, and what parts them there: no run holds it.
_JOINED, BETWEEN = 256, "\n"
_KEPT: dict[str, ChunkEncoder] = {}


class Table:
    """Ids of words by 64-bit hash: open addressing, looked up for many words at once; where in a pool of ids each word's are."""

    def __init__(self, dtype: np.dtype, keep: int):
        self.keep, bits = keep, max(8, (2 * keep - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 16, dtype), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is not there."""
        slot = (h >> self.shift).astype(np.int64)
        out = np.full(len(h), -1)
        key = self.keys[slot]
        hit = key == h
        out[hit] = slot[hit]
        rest = np.flatnonzero(~hit & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.last
            key = self.keys[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (key != 0)]
        return out

    def halve(self) -> None:
        """Drops the words learnt in the later half: the first ones seen are the commonest."""
        kept = np.flatnonzero((self.keys != 0) & (self.at < self.used // 2))
        keys, at, n = self.keys[kept], self.at[kept], self.n[kept]
        self.keys[:] = 0
        self._put(keys, at, n)
        self.used, self.words = int((at + n).max(initial=0)), len(kept)

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New, different hashes and their ids; there must be room for them."""
        new = np.frombuffer(b"".join(ids), self.pool.dtype)
        n = np.array([len(x) for x in ids], np.int64) // self.pool.dtype.itemsize
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(new), self.pool.dtype)])
        self.pool[self.used : self.used + len(new)] = new
        self._put(h, self.used + np.cumsum(n) - n, n)
        self.used, self.words = self.used + len(new), self.words + len(h)

    def _put(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        slot, rest = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[rest[free]]  # of several the last one stays
            mine = self.keys[s] == h[rest]
            self.at[s[mine]], self.n[s[mine]] = at[rest[mine]], n[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & self.last


class ChunkEncoder:
    """Encodes texts run by run and keeps the ids of runs.

    The pre-tokenizers of the two kinds of vocabulary never join a character to white space behind it, nor letters to
    other characters, except a space before and a contraction's apostrophe. So the ids of a text are those of its runs of
    letters and of others, in order, each with the white space before it; letters behind an apostrophe stay with it.
    Most runs repeat: they are found by hash, many at once, and only new ones reach the tokenizer, runs of letters many
    in one text with a token of their own between them. A vocabulary with word ends drops white space and lower-cases.
    Texts beyond Latin-1 or with unusual white space are split by patterns. A run is known by its 64-bit hash alone: of
    the `keep` runs that a worker holds at most, two share a hash with a chance below keep^2 / 2^65, 3e-8 at a million.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tok.model)  # for what is one pre-token already
        self.model.add_special_tokens([BETWEEN])
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.bare = getattr(self.tok.model, "end_of_word_suffix", None) is not None
        self.keep, self.runs, self.chunks = keep, Table(self.dtype, keep), {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """The process's encoder: a worker keeps its cache from task to task."""
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by the tokenizer itself."""
        out: list[bytes] = []
        for i in range(0, len(texts), 512):
            ids = [e.ids for e in self.tok.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
            ends = list(accumulate(map(len, ids), initial=0))
            raw, k = np.fromiter(chain.from_iterable(ids), self.dtype, ends[-1]).tobytes(), self.dtype.itemsize
            out += [raw[k * s : k * e] for s, e in zip(ends, ends[1:], strict=False)]
        return out

    def _model_ids(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that are one pre-token each, by the tokenizer's model, many in one text."""
        out: list[bytes] = []
        between, k = self.model.token_to_id(BETWEEN), self.dtype.itemsize
        for i in range(0, len(runs), _JOINED):
            ids = np.array(self.model.encode_batch_fast([BETWEEN.join(runs[i : i + _JOINED])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.append(np.flatnonzero(ids == between), len(ids))
            raw = ids.astype(self.dtype).tobytes()
            out += [raw[k * s : k * e] for s, e in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]
        return out

    def _learn(self, runs: list[str]) -> list[bytes]:
        """Ids of runs. A run of letters, with one space before it or none, is one pre-token: the model alone will do."""
        one = [(x[1:] if x[0] == " " else x).isalpha() for x in runs]
        plain = [("Ġ" + x[1:] if x[0] == " " else x) if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_CHARS) for x, ok in zip(runs, one, strict=True) if ok]
        by_model, by_tok = iter(self._model_ids(plain)), iter(self._ids([x for x, ok in zip(runs, one, strict=True) if not ok]))
        return [next(by_model if ok else by_tok) for ok in one]

    def _latin(self, t: str) -> bytes | None:
        """The text in Latin-1, if it has plain white space, and single (for vocabularies that keep it)."""
        try:
            raw = t.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if len(raw.translate(None, _LATIN_SPACE)) < len(raw) or b"<|" in raw:
            return None
        if self.bare or not (b"  " in raw or b"\n\n" in raw or b" \n" in raw or b"\n " in raw or b"\t" in raw or b"\r" in raw or raw[:1] in b" \n" or raw[-1:] in b" \n"):
            return raw
        return None

    def _missing(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and a place of each different one that is not there."""
        slot = self.runs.find(h)
        new = np.flatnonzero(slot < 0)
        return slot, new[np.unique(h[new], return_index=True)[1]]

    def _fast(self, texts: list[bytes]) -> list[bytes]:
        """The ids of plain texts in Latin-1."""
        raw = b"\n".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes + 1) - sizes - 1
        inside, letter = np.zeros(len(buf) + 2, bool), _LETTERS[buf]
        inside[1:-1] = ~SPACE[buf]
        fresh = np.ones(len(buf) + 1, bool)  # where a run ends or begins
        fresh[1:-1] = (letter[1:] != letter[:-1]) & ~(letter[1:] & (buf[:-1] == _APOSTROPHE))
        first = inside[1:-1] & ~inside[:-2]
        start = np.flatnonzero(first | (inside[1:-1] & fresh[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
        sums = prefix_sums(buf, LOWER if self.bare else SAME)
        h = Words.span(sums, start, end)
        lead = np.zeros(len(start), np.int8)
        if not self.bare:
            lead[first[start]] = 2
            lead[(lead == 2) & (buf[start - 1] == 10)] = 1
            lead[np.isin(start, begins, assume_unique=True)] = 0
            h = h ^ _LEAD_BITS[lead]
        h[h == 0] = 1  # 0 marks a free slot
        slot, some = self._missing(h)
        if self.runs.words + len(some) > self.runs.keep:
            self.runs.halve()
            slot, some = self._missing(h)
            if self.runs.words + len(some) > self.runs.keep:  # a text with more runs than are kept
                self.runs = Table(self.dtype, max(self.keep, len(np.unique(h))))
                slot, some = self._missing(h)
        if len(some):
            new = [raw[s:e].decode("latin-1") for s, e in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            new = [x.lower() for x in new] if self.bare else [_LEADS[k] + x for k, x in zip(lead[some].tolist(), new, strict=True)]
            self.runs.add(h[some], self._learn(new))
            late = np.flatnonzero(slot < 0)
            slot[late] = self.runs.find(h[late])
        at, n = self.runs.at[slot].astype(np.int64), self.runs.n[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.runs.pool[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        per = (ends[np.searchsorted(start, np.append(begins, len(buf)))] * self.dtype.itemsize).tolist()
        return [ids[s:e] for s, e in zip(per, per[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian numbers of self.dtype."""
        out: list[bytes] = [b""] * len(texts)
        plain = [self._latin(t) for t in texts]
        held, size = [], 0
        for i, raw in enumerate(plain):
            if raw:
                held.append(i)
                size += len(raw)
            if held and (size > 1 << 21 or i == len(plain) - 1):
                for k, x in zip(held, self._fast([plain[k] for k in held]), strict=True):
                    out[k] = x
                held, size = [], 0
        rest = [i for i, raw in enumerate(plain) if raw is None]
        odd = [[t] if _OTHER_SPACE.search(t) or "<|" in t else _PLAIN.findall(t) for t in (texts[i] for i in rest)]
        whole = list(set().union(*odd).difference(self.chunks))
        self.chunks.update(zip(whole, self._ids(whole), strict=True))
        for i, chunks in zip(rest, odd, strict=True):
            out[i] = b"".join(map(self.chunks.__getitem__, chunks))
        if len(self.chunks) > 150_000:  # the first ones seen are the commonest
            self.chunks = dict(islice(self.chunks.items(), 75_000))
        return out
