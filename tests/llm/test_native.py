"""Mixing and fingerprints against plain Python, and their plans."""

import hashlib
import math
import re

import xxhash
from forkweave.llm import fingerprint, mixing
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Targets by sharing again and again."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    target, open_, left = {}, set(keys), share * sum(sizes.values())
    while open_:
        total = sum(w[k] for k in open_)
        above = {k for k in open_ if left * w[k] / total > most * sizes[k]}
        if not above:
            return target | {k: left * w[k] / total for k in open_}
        for k in above:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in above)
        open_ -= above
    return target


def mixed(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, mix_note string").repartition(3)
    return mixing.mix(spark, mixing.measure(df))


def test_targets_and_takes(spark):
    rows = [(i, "w " * (i % 90) or None, ("hot", "b", "é", None, "a", "Z", "zero")[min(i % 11, 5)]) for i in range(2000)]
    rows += [(3, None, "zero"), (5000, "long " * 20000, "a"), (7, "dup dup", "b"), (7, "dup dup", "b")]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = water(sizes)
    taken: dict = {}
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_source_size == sizes[r.source]
        assert abs(r.mix_target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.mix_taken <= 2 * r.mix_size and abs(r.mix_copies * r.mix_size - r.mix_taken) <= r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    once = {(r.doc_id, r.source, r.mix_size): r.mix_taken for r in got if r.doc_id != 7}
    assert once == {(r.doc_id, r.source, r.mix_size): r.mix_taken for r in mixed(spark, rows[::-1]).collect() if r.doc_id != 7}
    assert mixed(spark, []).count() == 0


def test_takes_match_brute_force(spark):
    """Within a source, the documents in the order of -ln(u)/quality up to the budget, the last one in part."""
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i * 7 % 40)) + " 12 !!" * (i % 4), "ab"[i % 5 // 4]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = mixing.measure(df)
    u = {(r.doc_id): (((r.h & (1 << 64) - 1) >> 11) + 0.5) / 2.0**53 for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    facts = {r.doc_id: (r.mix_size, r.mix_quality) for r in measured.collect()}
    got = {r.doc_id: r for r in mixing.mix(spark, measured).collect()}
    for i, t, _ in rows:
        plain = len(re.sub(r"[0-9!-+/:-@\[-`{-~]", "", t))
        assert facts[i] == (len(WORD.findall(t)), 0.25 + 0.75 * plain / len(t))
    for source in "ab":
        mine = [i for i, _, s in rows if s == source]
        total, target = sum(facts[i][0] for i in mine), got[mine[0]].mix_target
        rest = round(target - int(target // total) * total)
        for i in sorted(mine, key=lambda i: (-math.log(u[i]) / facts[i][1], i)):
            take = max(0, min(rest, facts[i][0]))
            assert got[i].mix_taken == int(target // total) * facts[i][0] + take
            rest -= facts[i][0]


def test_mixing_keeps_columns_and_null_ids_apart(spark):
    own = {n: F.lit("mine") for n in ("mix_target", "mix_buckets", "mix_other")}
    df = spark.createDataFrame([(None, f"text {i} " * (i % 9), "s") for i in range(500)], "doc_id long, text string, source string").withColumns(own)
    got = mixing.mix(spark, mixing.measure(df)).collect()
    assert len(got) == 500 and {r.mix_other for r in got} == {"mine"} and len({r.mix_target for r in got}) == 1
    assert abs(sum(r.mix_taken for r in got) - got[0].mix_target) <= 1
    weighed = mixing.mix(spark, mixing.measure(df, F.when(F.length("text") > 20, 1.0))).collect()
    assert abs(sum(r.mix_taken for r in weighed) - weighed[0].mix_target) <= 1


def test_epochs_come_first_and_quality_counts(spark):
    rows = [(i, ("good words here " if i % 2 else "#$%& 1234 !!?? ") * 5, "stu"[i // 4000]) for i in range(12000)]
    got = [r for r in mixed(spark, rows).collect() if r.source == "t"]  # its target is a part of its size
    target = got[0].mix_target
    assert all(r.mix_taken >= r.mix_size * int(target // got[0].mix_source_size) for r in got)
    extra = [r.mix_taken - r.mix_size * int(target // got[0].mix_source_size) for r in got]
    good = sum(x for x, r in zip(extra, got, strict=True) if r.doc_id % 2)
    assert good > 1.5 * (sum(extra) - good)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketch(text: str) -> set:
    """The retained hashes by plain Python: XXH64 with seed 42, chained over the words of a run."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    h = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in w]
    out = set()
    for i in range(len(h) - 4):
        seed = 42
        for x in h[i : i + 5]:
            seed = xxhash.xxh64(x.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        out.add(signed(seed))
    if 0 < len(h) < 5:
        out.add(signed(xxhash.xxh64(" ".join(map(str, h)).encode(), seed=42).intdigest()))
    return {x for x in out if x < -(1 << 62)}


def test_edited_texts_and_likeness(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(i % 150))) for i in range(0, 600, 2)]
    rows += [(1, None), (3, "é🙂 ü"), (5, "same text of some words here"), (7, "same text of some words here"), (9, "x " * 9000), (11, "a"), (13, " ".join(f"long{j}" for j in range(8000)))]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, bucket string, sketch string").repartition(4)
    for size in (256, 7):
        out = {r.doc_id: r for r in fingerprint.with_next(spark, df, rows_per_bucket=size).collect()}
        order = sorted(rows, reverse=True)
        for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
            assert out[i].text == (t or "") and out[i].next_text == (n or ""), i
            assert set(out[i].next_sketch.kept) == sketch(n), i
    got = {r.doc_id: r for r in fingerprint.compare_edited(spark, df).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n, r = t or "", n or "", got[i]
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch(t), sketch(edited), sketch(n)
        for have, other, same in ((r.near_edited, b, edited == t), (r.near_next, c, n == t)):
            want = 1.0 if same else len(a & other) / len(a | other) if a | other else 0.0
            assert abs(have - want) < 1e-9, (i, have, want)
        want = 1.0 if edited == t else len(a & b) / len(a) if a else 0.0
        assert abs(r.kept_in_edited - want) < 1e-9
        assert r.fingerprint.partition(":")[2] == "".join(f"{x & (1 << 64) - 1:016x}" for x in sorted(a))
    assert got[5].fingerprint == got[7].fingerprint != got[9].fingerprint and got[1].fingerprint.endswith(":")
    assert fingerprint.compare_edited(spark, df.limit(0)).count() == 0
    one = fingerprint.compare_edited(spark, df.where("doc_id = 3")).first()
    assert one.near_next == 1.0
    twice = fingerprint.compare_edited(spark, df.where("doc_id = 3").unionAll(df.where("doc_id in (3, 5)"))).collect()
    assert len(twice) == 3


def test_containment_and_merge_of_unequal_texts(spark):
    words = [f"u{i}" for i in range(20000)]
    parts = [" ".join(words[1000:1100]), " ".join(words[5000:9000]), "few words", ""]
    rows = [(" ".join(words), p) for p in parts]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprint.add_sketch(fingerprint.add_sketch(df, "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    out = df.select("x", "y", fingerprint.containment(y, x).alias("inside"), fingerprint.containment(x, y).alias("covers"), fingerprint.merge(x, y).alias("both"), fingerprint.containment(y, fingerprint.merge(x, y)).alias("in_both")).collect()
    for r, p in zip(out, parts, strict=True):
        a, b = sketch(rows[0][0]), sketch(p)
        assert set(r.x.kept) == a and set(r.y.kept) == b and r.both.kept == sorted(a | b) and r.both.anchor is None
        assert r.covers == len(a & b) / len(a) and r.inside == (len(a & b) / len(b) if b else 0.0) and r.in_both == (1.0 if b else 0.0)
    assert out[0].inside == out[1].inside == 1.0 and abs(out[1].covers - 0.2) < 0.02


def test_plans_are_native(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for out in (mixing.mix(spark, mixing.measure(df)), fingerprint.compare_edited(spark, df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert mixing.measure(df).select(F.sum("mix_size")).first()[0] == 2
