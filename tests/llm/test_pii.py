import math
import random
import re
import time

from forkweave.llm import pii
from pyspark.sql import functions as F

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 12 <= len(d := re.sub(r"\D", "", v)) <= 19 and sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
)


def brute(t):
    out = [(m.start(), k, m.end()) for k, (_, r, ok) in enumerate(BASE) for m in r.finditer(t or "") if ok(m.group())]
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(out))


TEXTS = [
    None, "", "x", "a@b.c", "a@b.c.@x.y z@", "ü a.b+c@d-e.f.g, 1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 1",
    "+1 (386) 555-3733 and +12 3", "+4111111111111111", "🙂 4111111111111111🙂 @ a@@b.c", "a" * 5000 + "@b" + ".c" * 3000, "1" * 40 + " 0000000000000", "+1.1.1.1 1.1.1.1@a.b", "x@y.z " * 200, "12 34-56 78 90 12 34 50",
]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id int, text string, pattern string")
    for r in pii.found(df).select("doc_id", pii.listed("pii_base").alias("s")).collect():
        assert r.s == brute(TEXTS[r.doc_id]), r.doc_id


def test_terms_that_disclose(spark):
    rows = [(i, f"Zorblax wrote to ann.lee@mail.example.com about number {chr(97 + i)} of the plan today") for i in range(5)]
    rows += [(10 + i, f"nothing about number {chr(97 + i)} of the plan today wrote to nobody") for i in range(20)]
    rows += [(40, "here ZORBLAX alone"), (41, None), (42, "zorblaxian")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pii.spans(spark, df)
    got = {r.doc_id: r.s for r in out.select("doc_id", pii.listed("pii_spans").alias("s")).collect()}
    assert got[0] == "term:0:7,email:17:41" and got[40] == "term:5:12" and got[10] == got[41] == got[42] == "" and len(got) == len(rows)
    text = {r.doc_id: r.text for r in pii.sanitised(out).select("doc_id", "text").collect()}
    assert text[0] == "[TERM] wrote to [EMAIL] about number a of the plan today" and text[40] == "here [TERM] alone" and text[41] is None
    assert pii.spans(spark, df.limit(0)).count() == 0


def test_rare_entities_and_writings(spark, monkeypatch):
    rows = [(0, "Quillon can be called at +1 (386) 555-3733 about the plan"), (1, "call +1 386 555 3733 or the plan of Quillon"), (2, "Vexatrix had 4111 1111 1111 1111 for the plan")]
    rows += [(10 + i, f"nothing had or can be called or call about the plan at {chr(97 + i % 26)}{chr(97 + i // 26)} for of") for i in range(60)]
    df = spark.createDataFrame(rows + rows[2:3] * 3, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.s for r in pii.spans(spark, df).select("doc_id", pii.listed("pii_spans").alias("s")).collect()}
    assert got[0].startswith("term:0:7,phone:") and got[1].endswith(",term:36:43") and got[2] == "term:0:8,card:13:32" and got[10] == ""
    monkeypatch.setattr(pii, "BROADCAST_KEYS", 0)  # other ways to join, same spans
    assert got == {r.doc_id: r.s for r in pii.spans(spark, df).select("doc_id", pii.listed("pii_spans").alias("s")).collect()}
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert got == {r.doc_id: r.s for r in pii.spans(spark, df).select("doc_id", pii.listed("pii_spans").alias("s")).collect()}
    values = [(2, "4111-1111 11"), (3, "+1 (386) 5"), (1, "001.0.20.000"), (0, "A@B.c")]
    norm = spark.createDataFrame(values, "k int, v string").select(pii.normal(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in norm] == ["4111111111", "13865", "1.0.20.0", "a@b.c"]


def test_many_spans_of_one_text(spark):
    """Spans in slices: whole against folds by plain Python, and in time that follows their number."""
    texts = [" ".join(f"m{i}@x.yz +1 386 555 {i:04d} ü" for i in range(n)) for n in (31, 32, 33, 64, 65, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = pii.spans(spark, df)
    got = {r.doc_id: (r.s, r.t) for r in pii.sanitised(out).select("doc_id", pii.listed("pii_base").alias("s"), F.col("text").alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == brute(t)
        want, pos = "", 0
        for span in brute(t).split(","):
            kind, s, e = span.split(":")
            if int(s) >= pos:
                want, pos = want + t[pos : int(s)] + f"[{kind.upper()}]", int(e)
            pos = max(pos, int(e))
        assert got[i][1] == want + t[pos:]

    def seconds(n):
        df = spark.createDataFrame([(0, "a@b.cd " * n)], "doc_id int, text string")
        began = time.time()
        text = pii.sanitised(pii.found(df).withColumn("pii_spans", F.col("pii_base"))).first().text
        assert text == "[EMAIL] " * n
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.3)


def test_overlaps_and_own_columns(spark):
    df = spark.createDataFrame([(1, "1.1.1.1@a.b 4111111111111111@x.y", "mine")], "doc_id long, text string, pii_terms string").withColumn("pii_near", F.lit(1)).withColumn("pii_text", F.lit("t"))
    r = pii.sanitised(pii.spans(spark, df)).first()
    assert r.text == "[EMAIL] [EMAIL]" and r.pii_text.startswith("1.1")


def test_shares_match_brute_force(spark):
    """Shares over all different texts, counted by plain Python."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmn"]
    texts = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        if i % 3 == 0:
            w.insert(rng.randint(0, len(w)), f"u{rng.randint(0, 9)}@mail.org")
        texts.append(" ".join(w))
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = pii.found(df)
    got = {r.term: r.share for r in pii.disclosing(spark, marked, generalise=-10.0).collect()}
    once = sorted(set(texts))
    terms_of = [{w for w in re.split(r"[^a-z]+", t.lower()) if len(w) >= 3} for t in once]
    entity, near = [], []
    for t in once:
        m = re.search(r"u[0-9]@mail\.org", t)
        entity.append(m and m.group())
        around = t[max(0, m.start() - 80) : m.start()] + "\n" + t[m.end() : m.end() + 80] if m else ""
        if m and m.start() > 80:
            around = re.sub(r"^[a-z]+", "", around)
        if m and len(t) - m.end() >= 80:
            around = re.sub(r"[a-z]+$", "", around)
        near.append({w for w in re.split(r"[^a-z]+", around) if len(w) >= 3})
    n = len(once)
    want: dict = {}
    for e in {x for x in entity if x}:
        with_e = entity.count(e)
        for term in set().union(*(near[i] for i in range(n) if entity[i] == e)):
            both = sum(entity[i] == e and term in near[i] for i in range(n))
            with_t = sum(term in s for s in terms_of)
            given = both / with_t if both >= 3 else (both + with_e / n) / (with_t + 1)
            want[term] = max(want.get(term, -99.0), math.log(given * n / with_e) / math.log(n / with_e))
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_native(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.spans(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.found(df).select(F.size("pii_base")).first()[0] == 1
