"""Queries with SQL against DuckDB; no data of this repository is needed beyond the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from forkweave.llm import queries
from test_native import sketch, water
from test_pii import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)


PLAIN = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_token_binary": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_lexical_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(name: str, texts: list, end: int) -> list[list[int]]:
    tok = Tokenizer.from_file(queries.tokenizer(name))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_without_sql(spark, name):
    """The registered query itself, on its whole table, against plain Python where the contract fixes values."""
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[: len(PLAIN[name])] == PLAIN[name]
    rows = got.collect()
    docs = sorted(((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])
    text = {i: t or "" for i, t, _ in docs}
    if name != "op3_lexical_packing":
        assert sorted(r.doc_id for r in rows) == [i for i, _, _ in docs]
    if name == "op1_mixing":
        size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in text.items()}
        total = Counter()
        for i, _, s in docs:
            total[s] += size[i]
        want = water(total)
        for r in rows:
            s = next(s for i, _, s in docs if i == r.doc_id)
            assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        assert abs(sum(r.taken for r in rows) - sum(want.values())) <= len(want)
    if name == "op2_token_binary":
        at, want = 0, []
        for (i, _, _), x in zip(docs, ids_of("word_bpe_49k.json", [t for _, t, _ in docs], 1), strict=True):
            want.append((i, at, len(x), crc(x)))
            at += len(x)
        assert sorted(tuple(r)[:4] for r in rows) == want
    if name == "op3_lexical_packing":
        ids = dict(zip(text, ids_of("byte_bpe_50k.json", list(text.values()), 0), strict=True))
        at, used = Counter(), Counter()
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
            at[r.doc_id] += r.length
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == used[r.sequence_id]
            used[r.sequence_id] += r.length
        assert at == {i: len(x) for i, x in ids.items()} and max(used.values()) <= 1024 and sum(used.values()) >= 0.95 * 1024 * len(used)
    if name in ("op6_quality", "op7_toxicity"):
        least = 0.5 if name == "op6_quality" else 0.7
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    if name == "op8_pii":
        for r in rows:
            base = brute(text[r.doc_id])
            kinds = Counter(x.partition(":")[0] for x in base.split(",") if x)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    if name == "op10_fingerprint":
        down = sorted(text, reverse=True)
        after = dict(zip(down, down[1:] + down[:1], strict=True))
        for r in rows:
            t, n = text[r.doc_id], text[after[r.doc_id]]
            m = len(t) // 3
            edited = t[: len(t) - m] + n[:m]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = sketch(t), sketch(edited), sketch(n)
            assert abs(r.near_edited - (1.0 if t == edited else len(a & b) / max(1, len(a | b)))) < 1e-9 and abs(r.near_next - (1.0 if t == n else len(a & c) / max(1, len(a | c)))) < 1e-9
