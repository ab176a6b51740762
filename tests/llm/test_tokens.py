"""Token output and packing, against the tokenizer itself and exact round trips."""

import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from forkweave.llm import binary, packing
from forkweave.llm.queries import tokenizer
from forkweave.llm.tokens import ChunkEncoder

TEXTS = ["", None, "a", " a  b\n\nc ", "It's the THE\tend.", "x  y \nz", " \n", "né Σίσυφος ΟΔΟΣ ", "é ̈a", "a\x1cb \x85", "<|endoftext|> a<|endoftext|>", "12 345,6", "word " * 3000, "   ", "\n", "　x", "日本語 text 🙂🙂"]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string")


def test_chunks_give_the_ids_of_whole_texts():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer(name)
        own, enc = Tokenizer.from_file(path), ChunkEncoder(path, keep=10)
        for _ in range(2):
            for t, got in zip(TEXTS, enc.encode([t or "" for t in TEXTS]), strict=True):
                assert np.frombuffer(got, enc.dtype).tolist() == own.encode(t or "", add_special_tokens=False).ids, (name, t)


def test_code_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 3, 4, 5, 100, 0])
    ranks = (rng.integers(0, 2**32, counts.sum(), dtype=np.uint64) >> rng.integers(0, 33, counts.sum(), dtype=np.uint64)).astype(np.uint32)
    parts = binary.pack(ranks, counts)
    got = binary.unpack(np.frombuffer(b"".join(c for c, _ in parts), np.uint8), np.frombuffer(b"".join(d for _, d in parts), np.uint8), counts)
    assert got.tolist() == ranks.tolist()


def test_corpus_round_trip(spark, tmp_path):
    ids = [*range(100, 100 + len(TEXTS) - 2), 7, None]
    df = frame(spark, TEXTS, ids).unionByName(frame(spark, ["dup", "dup"], [50, 50])).repartition(3)
    path = tokenizer("word_bpe_49k.json")
    own, out = Tokenizer.from_file(path), f"file://{tmp_path}/x"
    files = binary.write_corpus(spark, df, out, path, 1, docs_per_file=3)
    assert files.count() > 2
    want = [(i, [*own.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in [*zip(ids, TEXTS, strict=True), (50, "dup"), (50, "dup")]]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    at, expect = 0, []
    for i, x in want:
        expect.append((i, at, len(x), np.array(x, "<u4").tobytes()))
        at += len(x)
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in binary.read_corpus(spark, files, out).collect()), key=lambda r: r[1])
    assert got == expect
    empty = binary.round_trip(spark, df.limit(0), path)
    assert empty.count() == 0


def test_packing_keeps_each_id_once(spark):
    path = tokenizer("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = [*TEXTS, *[f"alpha beta {i} " * (7 * i % 300) for i in range(60)]]
    df = frame(spark, texts).withColumnRenamed("bucket", "shard")
    rows = packing.pack(spark, df, path, 0, 64, shard_docs=20).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids and parts[0].doc_tokens == len(ids) // 4
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
    pad = 0
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        total = sum(r.length for r in seq)
        assert [r.offset for r in seq] == list(np.cumsum([0] + [r.length for r in seq])[:-1]) and total <= 64
        pad += seq[0].padded_to - total
    assert pad < 64 * 8
    assert packing.pack(spark, df.limit(0), path).count() == 0


def test_near_copies_share_a_shard_at_any_size(spark):
    rng = np.random.default_rng(5)
    own = [[f"w{x}" for x in rng.integers(0, 10**6, 20)] for _ in range(400)]
    text = lambda i, w: " ".join(["the of and"] * 5 + w + [f"x{i}"])
    rows = [(i + 1000 * c, text(i + 1000 * c, own[i])) for i in range(400) for c in (0, 1)]
    rows += [(5000 + i, "the same text") for i in range(200)]  # a sketch with more documents than a shard takes
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rest = packing.pack(spark, df, tokenizer("byte_bpe_50k.json"), 0, 64, shard_docs=20).where("start + length = doc_tokens")
    shard = {r.doc_id: r.sequence_id // 20 for r in rest.collect() if r.sequence_id < 1 << 62}
    sizes = Counter(shard.values())
    assert len(shard) > 950 and max(sizes.values()) <= 20 and len(sizes) >= 48  # a few documents are full windows and nothing else
    assert sum(i in shard and shard[i] == shard.get(1000 + i) for i in range(400)) > 280  # hashed ids: about 8


def test_equal_rows_fill_many_shards(spark):
    df = spark.createDataFrame([(7, "one and the same text")] * 3000, "doc_id long, text string").repartition(5)
    rows = packing.pack(spark, df, tokenizer("byte_bpe_50k.json"), 0, 64, shard_docs=100).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.length == r.doc_tokens) <= 3000 * rows[0].doc_tokens == sum(r.length for r in rows)
    assert max(Counter(r.sequence_id // 100 for r in rows).values()) <= 150 and len({r.sequence_id // 100 for r in rows}) >= 30


def test_long_texts_leave_full_windows_and_keep_all_their_terms():
    own = np.arange(50, dtype=np.uint16)
    index = packing.Bm25([own[:3], own[10:14]], {0: (own[[0, 10, 11]], np.array([5, 1, 1]))}, np.ones(50), query_terms=10)
    assert index.neighbours(1).tolist() == [1, 0] and sorted(index.terms[index.query[0]].tolist()) == [10, 11]


def test_fill_against_brute_force():
    """Every window but the last is full; a piece that ends its document follows the order of neighbours among those that fit."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = rng.integers(1, 30, 40).tolist()
        near = {i: rng.permutation(40) for i in range(40)}
        left, want = lengths.copy(), []
        for seed in sorted(range(40), key=lambda i: (-lengths[i], i)):
            if not left[seed]:
                continue
            seq, space = [(seed, lengths[seed] - left[seed], left[seed])], 32 - left[seed]
            left[seed] = 0
            free = [i for i in near[seed].tolist() if left[i]]
            for i in free:
                if space and left[i] <= space:
                    seq.append((i, lengths[i] - left[i], left[i]))
                    space, left[i] = space - left[i], 0
            rest = next((i for i in free if left[i]), None)
            if space and rest is not None:
                seq.append((rest, lengths[rest] - left[rest], space))
                left[rest] -= space
            want.append(seq)
        assert packing.fill(lengths, near.__getitem__, 32) == want


def test_ids_beyond_doubles_survive_a_null(spark, tmp_path):
    big = [9007199254740993, 9007199254740995, None, -9223372036854775807]
    df = spark.createDataFrame([(i, f"text {i}") for i in big], "doc_id long, text string").coalesce(1)
    path = tokenizer("byte_bpe_50k.json")
    assert {r.doc_id for r in packing.pack(spark, df, path, 0, 64).collect()} == set(big)
    assert [r.doc_id for r in sorted(binary.round_trip(spark, df, path, 1).collect(), key=lambda r: r.start)] == [None, big[3], big[0], big[1]]


def test_neighbours_match_brute_force():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 30, n).astype(np.uint32) for n in (5, 9, 14, 3, 8)]
    index = packing.Bm25(docs, query_terms=1000)
    mean = np.mean([len(d) for d in docs])
    for q, d in enumerate(docs):
        score = []
        for e in docs:
            s = 0.0
            for t in set(d.tolist()):
                df = sum(t in x for x in docs)
                tf = int((e == t).sum())
                if df > 1 and tf:
                    s += np.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(e) / mean))
            score.append(s)
        assert np.allclose(np.array(score)[index.neighbours(q)], np.sort(score)[::-1])


def test_crc_is_of_the_ids(spark):
    from pyspark.sql import functions as F

    x = np.array([1, 2, 70000], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(x),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(x)
