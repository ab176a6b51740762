"""Packing documents into sequences by lexical retrieval.

Every text is encoded once, whole. A document's full windows stand alone and leave at once, without a shuffle; what is
left of it (less than a window) is packed with others by retrieval. Documents that share rare token ids lie together:
they are ordered by a sketch, the token of the least exponential key -ln(u) / idf^4 among theirs, then a second such
token, then a salt, which also parts repeated rows. The frequencies are those of all documents. Ranges of that order go
to tasks, and each task cuts its range into shards of `shard_docs` documents, one in memory at a time. In each shard a
BM25 inverted index over the token ids of the whole documents returns, for each seed document, its neighbours by score;
those not used yet fill the seed's window greedily. A window that no whole neighbour fits is filled by a cut of the best
one, whose rest stays in play, so that only the last window of a shard has padding.

A seed asks its own shard alone: what the sketch parts does not meet. The README gives measured shares.

Defined results: a null text counts as empty (the end id alone); a text of any length is one document, of which a task
holds one at a time and a shard less than a window and its distinct ids; repeated rows are packed each, in as many
shards as they fill; null doc_ids are kept, ids of any 64 bits as they are; ties of score go by place in the order; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, flagged, saved
from .textnum import mix
from .tokens import ChunkEncoder

SHARD_DOCS = 512
#: Bits of the order's first token, second token and salt.
BITS = (18, 15, 20)


class Bm25:
    """An inverted index over the token ids of one shard's documents.

    counted: ids and counts of documents that stand for more than their ids here; idf: by id, else the shard's own.
    """

    def __init__(self, docs: list[np.ndarray], counted: dict | None = None, idf: np.ndarray | None = None, k1: float = 1.2, b: float = 0.75, query_terms: int = 32):
        n = self.n = len(docs)
        counted = counted or {}
        lengths = np.array([counted[i][1].sum() if i in counted else len(d) for i, d in enumerate(docs)], np.int64)
        plain = [d for i, d in enumerate(docs) if i not in counted]
        owner = np.repeat([i for i in range(n) if i not in counted], [len(d) for d in plain])
        ids = np.concatenate(plain).astype(np.int64) if plain else np.zeros(0, np.int64)
        narrow = len(ids) and int(ids.max() + 1) * n < 1 << 31  # small numbers sort faster
        pairs, tf = np.unique((ids * n + owner).astype(np.int32 if narrow else np.int64), return_counts=True)
        pairs = pairs.astype(np.int64)
        if counted:
            pairs = np.concatenate([pairs, *(t.astype(np.int64) * n + i for i, (t, _) in counted.items())])
            tf = np.concatenate([tf, *(c for _, c in counted.values())])
            order = np.argsort(pairs)
            pairs, tf = pairs[order], tf[order]
        term, self.doc = pairs // n, pairs % n
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        weight = np.log1p((n - df + 0.5) / (df + 0.5)) if idf is None else idf[self.terms]
        norm = k1 * (1 - b + b * lengths / max(1.0, lengths.mean()))
        self.weight = np.repeat(weight, df) * tf * (k1 + 1) / (tf + norm[self.doc])
        # the strongest terms of each document are its query; a term that no other document has finds nothing
        slot = np.repeat(np.arange(len(self.terms)), df)
        use = np.flatnonzero(np.repeat(df, df) > 1)
        # by document, then descending weight (bits of positive floats ascend as they do), then term
        use = use[np.argsort((self.doc[use] << 32) - self.weight[use].astype(np.float32).view(np.int32), kind="stable")]
        starts = np.searchsorted(self.doc[use], np.arange(n + 1))
        self.query = [slot[use[s : min(e, s + query_terms)]] for s, e in zip(starts[:-1], starts[1:], strict=True)]

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents by descending score against the seed; ties by place."""
        spans = [slice(self.first[t], self.last[t]) for t in self.query[seed].tolist()]
        if not spans:
            return np.arange(self.n)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return np.argsort(-score, kind="stable")


def fill(lengths: list[int], neighbours, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that together hold each document once."""
    out, at = [], [0] * len(lengths)
    for i, n in enumerate(lengths):
        for _ in range(n // window):
            out.append([(i, at[i], window)])
            at[i] += window
    left = [n - a for n, a in zip(lengths, at, strict=True)]
    open_ = {i for i, x in enumerate(left) if x}

    def take(seq, i, n):
        seq.append((i, at[i], n))
        at[i] += n
        left[i] -= n
        if not left[i]:
            open_.discard(i)

    for seed in sorted(open_, key=lambda i: (-left[i], i)):
        if seed not in open_:
            continue
        seq: list[tuple[int, int, int]] = []
        take(seq, seed, left[seed])
        space = window - seq[0][2]
        if space:
            near = [i for i in neighbours(seed).tolist() if i in open_]
            for i in near:
                if left[i] <= space:
                    space -= left[i]
                    take(seq, i, left[i])
                    if not space:
                        break
            if space and (rest := next((i for i in near if i in open_), None)) is not None:
                take(seq, rest, space)
        out.append(seq)
    return out


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, no_doc_id, n, salt, ids of each document with the end id; and for each task a row (n = -1) of terms and in how many documents each is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = ChunkEncoder.of(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        size, at = max(enc.size, end_id + 1), 0
        found = np.zeros(size, np.int64)
        for b in batches:
            if not len(b):
                continue
            ids = [x + end for x in enc.encode(b["text"].tolist())]
            n = np.array([len(x) // enc.dtype.itemsize for x in ids])
            all_ids = np.frombuffer(b"".join(ids), enc.dtype)
            key = np.repeat(np.arange(len(ids), dtype=np.int32 if size * len(ids) < 1 << 31 else np.int64), n) * size + all_ids
            found += np.bincount(np.unique(key) % size, minlength=size)
            salt = mix(np.arange(at, at + len(b), dtype=np.uint64) + np.uint64(_partition() << 40)) >> np.uint64(64 - BITS[2])
            at += len(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "no_doc_id": b["no_doc_id"], "n": n, "salt": salt.astype(np.int64), "ids": ids, "terms": None, "counts": None})
        if at:
            terms = np.flatnonzero(found)
            yield pd.DataFrame({"doc_id": [0], "no_doc_id": [True], "n": [-1], "salt": [0], "ids": [None], "terms": [terms.astype("<u4").tobytes()], "counts": [found[terms].astype("<u4").tobytes()]})

    rows = docs.select(*flagged("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, no_doc_id boolean, n long, salt long, ids binary, terms binary, counts binary")


def frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """In how many documents each token id is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for t, c in zip(b["terms"], b["counts"], strict=True):
                total[np.frombuffer(t, "<u4")] += np.frombuffer(c, "<u4")
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    # at most a row for each id of the vocabulary
    rows = tokens.where("n < 0").select("terms", "counts").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def rankings(df: np.ndarray, idf: np.ndarray, seed: int) -> np.ndarray:
    """Each token's place by the exponential key -ln(u) / idf^4, u a hash of the token: a document's token is that of the least."""
    u = ((mix(np.arange(len(df), dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    out = np.empty(len(df), np.int64)
    out[np.lexsort((np.arange(len(df)), -np.log(u) / np.maximum(idf, 1e-9) ** 4))] = np.arange(len(df))
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, padded_to, ids (little-endian unsigned 32-bit).

    Sequences of one shard have one sequence_id divided by shard_docs; those of full windows have 2^62 and more.
    """
    bounded_batches(spark)
    enc = ChunkEncoder.of(tokenizer_path)
    kind, size = enc.dtype, max(enc.size, end_id + 1)
    tokens = saved(spark, tokenized(docs, tokenizer_path, end_id), "tokens")
    rows = tokens.where("n >= 0").select("doc_id", "no_doc_id", "n", "salt", "ids")
    df = frequencies(tokens, size)
    total = rows.count()
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    tables = spark.sparkContext.broadcast((rankings(df, idf, 1), rankings(df, idf, 2), idf))  # bounded by the vocabulary

    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two, _ = tables.value
        for b in batches:
            if not len(b):
                continue
            n = b["n"].to_numpy()
            all_ids = np.frombuffer(b"".join(b["ids"]), kind)
            starts = np.cumsum(n) - n
            # hashed, as a long text's place is low: long texts shall not meet in one shard
            first, second = (mix(np.minimum.reduceat(r[all_ids], starts).astype(np.uint64)) >> np.uint64(64 - bits) for r, bits in ((one, BITS[0]), (two, BITS[1])))
            order = (first.astype(np.int64) << (BITS[1] + BITS[2])) + (second.astype(np.int64) << BITS[2]) + b["salt"].to_numpy()
            keep = np.flatnonzero(n % window)
            tail, terms, counts = [], [], []
            for s, m in zip(starts[keep].tolist(), n[keep].tolist(), strict=True):
                tail.append(all_ids[s + m // window * window : s + m].tobytes())
                t, c = np.unique(all_ids[s : s + m], return_counts=True) if m > window else (None, None)
                terms.append(None if t is None else t.tobytes())
                counts.append(None if c is None else c.astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[keep], "no_doc_id": b["no_doc_id"].to_numpy()[keep], "n": n[keep], "order": order[keep], "ids": tail, "terms": terms, "counts": counts})

    def framed(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["doc_id", "no_doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_to", "ids"])
        return frame.astype({"no_doc_id": bool}) if out else frame

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = 1 << 62 | _partition() << 36
        for b in batches:
            out, size = [], 0
            for doc, none, n, raw in zip(b["doc_id"].tolist(), b["no_doc_id"].tolist(), b["n"].tolist(), b["ids"], strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                for s in range(0, n // window * window, window):
                    out.append((doc, none, s, window, n, k, 0, window, ids[s : s + window].tobytes()))
                    k, size = k + 1, size + window
                if size >= 1 << 20:
                    yield framed(out)
                    out, size = [], 0
            if out:
                yield framed(out)

    def shard(held: pd.DataFrame, k: int) -> pd.DataFrame:
        ids = [np.frombuffer(x, kind) for x in held["ids"]]
        counted = {i: (np.frombuffer(t, kind), np.frombuffer(c, "<u4").astype(np.int64)) for i, (t, c) in enumerate(zip(held["terms"], held["counts"], strict=True)) if t is not None}
        index = Bm25(ids, counted, tables.value[2])
        names, none, n = held["doc_id"].tolist(), held["no_doc_id"].tolist(), held["n"].tolist()
        out = []
        for q, seq in enumerate(fill([len(x) for x in ids], index.neighbours, window)):
            used, offset = sum(m for _, _, m in seq), 0
            padded = used if used & (used - 1) == 0 else window
            for i, s, m in seq:
                out.append((names[i], none[i], n[i] - len(ids[i]) + s, m, n[i], k + q, offset, padded, ids[i][s : s + m].astype("<u4").tobytes()))
                offset += m
        return framed(out)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, held, count = _partition() << 36, [], 0
        for b in batches:
            while count + len(b) >= shard_docs:
                cut = shard_docs - count
                yield shard(pd.concat([*held, b.iloc[:cut]], ignore_index=True), k)
                k += shard_docs  # each window ends a document
                b, held, count = b.iloc[cut:], [], 0
            if len(b):
                held.append(b)
                count += len(b)
        if held:
            yield shard(pd.concat(held, ignore_index=True), k)

    schema = "doc_id long, no_doc_id boolean, start long, length long, doc_tokens long, sequence_id long, offset long, padded_to long, ids binary"
    left = saved(spark, rows.mapInPandas(rests, "doc_id long, no_doc_id boolean, n long, order long, ids binary, terms binary, counts binary"), "rests")
    left = left.repartitionByRange("order").sortWithinPartitions("order", "no_doc_id", "doc_id", "n", "ids")
    pieces = rows.where(F.col("n") >= window).mapInPandas(whole, schema).unionAll(left.mapInPandas(shards, schema))
    return pieces.withColumn("doc_id", F.when(~F.col("no_doc_id"), F.col("doc_id"))).drop("no_doc_id")
