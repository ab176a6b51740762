"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Every id is replaced by its rank by frequency in the whole corpus, so that common ids take one byte. Four ranks
share a control byte of two bits each (length less one); the data bytes follow apart from the control bytes, so
that a block decodes by numpy table lookup, without a loop over ids.

A file holds blocks: magic, documents, control bytes, data bytes (u4 each), then doc_ids (i8), null flags (u1),
counts of ids (u4), control bytes, data bytes. Each document starts a control byte of its own; unused slots hold
rank 0. Files are named by ascending range of doc_id and sorted within; equal doc_ids are ordered by their ids.

Defined results: a null text counts as empty (the end id alone); null doc_ids come first; ids of any 64 bits are kept
as they are; repeated rows are kept; a text of any length is one document of one block; an empty table gives no files
and no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, flagged, fresh_dir, quantile_bounds, range_bucket, saved, scratch
from .tokens import ChunkEncoder

MAGIC = 0x31425653
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
BLOCK_IDS = 1 << 17


def pack(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control and data bytes of each document; ranks are those of all documents in order."""
    padded = -(-counts // 4) * 4
    ends = np.cumsum(padded)
    full = np.zeros(int(padded.sum()), np.dtype("<u4"))
    at = np.arange(len(ranks)) + np.repeat(ends - padded - (np.cumsum(counts) - counts), counts)
    full[at] = ranks
    size = 1 + (full > 0xFF).astype(np.uint8)
    short = not len(full) or full.max() <= 0xFFFF  # ranks of a small vocabulary
    if not short:
        size += (full > 0xFFFF).astype(np.uint8) + (full > 0xFFFFFF)
    codes = (size - 1).reshape(-1, 4).astype(np.uint8)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8)
    wide = full.astype("<u2").view(np.uint8).reshape(-1, 2) if short else full.view(np.uint8).reshape(-1, 4)
    data = wide[np.arange(wide.shape[1]) < size[:, None]]
    bounds = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    return [(control[(e - p) // 4 : e // 4].tobytes(), data[bounds[e - p] : bounds[e]].tobytes()) for e, p in zip(ends.tolist(), padded.tolist(), strict=True)]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents of a block, in order."""
    size = LENGTHS[control].ravel()
    at = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    out = data[at]
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k] << np.uint32(8 * k)
    padded = -(-counts // 4) * 4
    keep = np.arange(len(out)) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(counts, padded)
    return out[keep]


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(p.rpartition("/")[0], recursive=True)
    return system, p


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, no_doc_id (it is null), n, ids (packed 16- or 32-bit) of each whole text with the end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = ChunkEncoder.of(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b["text"].tolist())]
            yield pd.DataFrame({"doc_id": b["doc_id"], "no_doc_id": b["no_doc_id"], "n": [len(x) // enc.dtype.itemsize for x in ids], "ids": ids})

    return docs.select(*flagged("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, no_doc_id boolean, n long, ids binary")


def _wide(spark: SparkSession, path: str) -> np.dtype:
    return ChunkEncoder.of(path).dtype


def write_corpus(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, docs_per_file: int = 1000, max_files: int = 20_000) -> DataFrame:
    """Writes the files to out_dir; returns one row per file: bucket, path, n_docs, n_ids, and the ranks file's path."""
    bounded_batches(spark)
    with scratch(spark):
        return _write(spark, docs, out_dir, tokenizer_path, end_id, docs_per_file, max_files)


def _write(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, docs_per_file: int, max_files: int) -> DataFrame:
    dtype = _wide(spark, tokenizer_path)
    toks = saved(spark, tokenized(docs, tokenizer_path, end_id), "tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b["ids"]), dtype))
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    # at most a row for each id of the vocabulary
    freq = toks.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    order = freq.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    system, p = _open(f"{out_dir}/ranks.bin", write=True)
    with system.open_output_stream(p) as f:
        f.write(order.astype("<u4").tobytes())

    n_docs = toks.count()
    toks = toks.withColumn("at", F.when(~F.col("no_doc_id"), F.col("doc_id")))
    bounds = quantile_bounds(toks, "at", min(max_files, -(-n_docs // docs_per_file)))
    ranks = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            parts = pack(ranks.value[np.frombuffer(b"".join(b["ids"]), dtype)], b["n"].to_numpy(np.int64))
            yield pd.DataFrame({"bucket": b["bucket"], "doc_id": b["doc_id"], "no_doc_id": b["no_doc_id"], "n": b["n"], "control": [c for c, _ in parts], "data": [d for _, d in parts]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sink, name, bucket, docs_in, ids_in, held, held_ids = None, "", None, 0, 0, [], 0

        def flush():
            nonlocal held, held_ids
            if held:
                control, data = b"".join(x[3] for x in held), b"".join(x[4] for x in held)
                sink.write(np.array([MAGIC, len(held), len(control), len(data)], "<u4").tobytes() + np.array([x[0] for x in held], "<i8").tobytes() + np.array([x[1] for x in held], np.uint8).tobytes() + np.array([x[2] for x in held], "<u4").tobytes())
                sink.write(control)
                sink.write(data)
            held, held_ids = [], 0

        def close():
            flush()
            sink.close()
            system.move(name + tmp, name)  # whole files only, also after a retry
            return pd.DataFrame({"bucket": [bucket], "path": [f"{out_dir}/part-{bucket:08d}.svb"], "n_docs": [docs_in], "n_ids": [ids_in]})

        import uuid

        tmp = f".{uuid.uuid4().hex}"
        system, _ = _open(out_dir)
        for b in batches:
            for bk, doc, null, n, c, d in zip(b["bucket"].tolist(), b["doc_id"].tolist(), b["no_doc_id"].tolist(), b["n"].tolist(), b["control"], b["data"], strict=True):
                if bk != bucket:
                    if sink is not None:
                        yield close()
                    bucket, docs_in, ids_in = bk, 0, 0
                    name = _open(f"{out_dir}/part-{bk:08d}.svb")[1]
                    sink = system.open_output_stream(name + tmp)
                held.append((doc, null, n, c, d))
                held_ids, docs_in, ids_in = held_ids + n, docs_in + 1, ids_in + n
                if held_ids >= BLOCK_IDS:
                    flush()
        if sink is not None:
            yield close()

    coded = toks.withColumn("bucket", range_bucket(F.col("at"), bounds)).drop("at").mapInPandas(code, "bucket int, doc_id long, no_doc_id boolean, n long, control binary, data binary")
    files = coded.repartition("bucket").sortWithinPartitions("bucket", F.desc("no_doc_id"), "doc_id", "control", "data").mapInPandas(write, "bucket int, path string, n_docs long, n_ids long")
    return saved(spark, files, "files", lasting=True)


def read_corpus(spark: SparkSession, files: DataFrame, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document, decoded from the files."""
    bounded_batches(spark)
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, p = _open(f"{out_dir}/ranks.bin")
        with system.open_input_stream(p) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for path, base in zip(b["path"], b["base"].tolist(), strict=True):
                with system.open_input_stream(_open(path)[1]) as f:
                    while head := f.read(16):
                        _, n, nc, nd = np.frombuffer(head, "<u4").astype(np.int64).tolist()
                        docs, null = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8)
                        counts = np.frombuffer(f.read(4 * n), "<u4").astype(np.int64)
                        ids = id_of[unpack(np.frombuffer(f.read(nc), np.uint8), np.frombuffer(f.read(nd), np.uint8), counts)].astype("<u4")
                        ends = np.cumsum(counts)
                        raw, starts_in = ids.tobytes(), ends - counts
                        doc = pd.array(docs, dtype="Int64")
                        doc[null.astype(bool)] = pd.NA
                        yield pd.DataFrame({"doc_id": doc, "start": starts_in + base, "n_tokens": counts, "ids": [raw[4 * s : 4 * e] for s, e in zip(starts_in.tolist(), ends.tolist(), strict=True)]})
                        base += int(ends[-1])

    return starts.select("path", "base").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the corpus and returns what its files hold."""
    out = fresh_dir(spark, "token-files")
    return read_corpus(spark, write_corpus(spark, docs, out, tokenizer_path, end_id), out)
