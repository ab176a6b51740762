"""Trees, calibration, features and held-out accuracy."""

import re
import zlib

import numpy as np
import pytest

from forkweave.llm import gbt, learn, quality, toxicity
from forkweave.llm.textnum import Words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    t = gbt.fit(x, y, trees=30)
    assert ((t.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        out = t.base
        for f, th, v in zip(t.feature, t.threshold, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > th[node])
            out += v[node - len(f)]
        return out

    assert np.allclose(t.margin(x[:50]), [walk(r) for r in x[:50]])
    flat = gbt.fit(x[:5], np.ones(5))
    assert (flat.score(x) > 0.99).all() and gbt.fit(np.zeros((0, 1)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    s = rng.random(4000)
    y = (rng.random(4000) < s**2).astype(float)
    xs, ys = gbt.isotonic(s, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert abs(np.interp(0.7, xs, ys) - 0.49) < 0.12


def test_words_match_plain_python():
    texts = ["", "A  bé\tc\n", " x ", "one", "\x0b", "É a🙂b"]
    w = Words([t.encode() for t in texts])
    assert w.count.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    h = w.span(w.sums(), w.start, w.end)
    assert h[0] == Words([b"zz a"]).span(Words([b"zz a"]).sums(), np.array([3]), np.array([4]))[0]
    sets = Words([b"a b c d", b"A B c\nd", b"a b", b"a b c", b"b c d"]).shingle_sets(3)
    assert (sets[0] == sets[1]).all() and len(sets[2]) == 1 and set(sets[0]) == {*sets[3], *sets[4]} and not set(sets[2]) & set(sets[0])


WORDLIKE = re.compile(r"[0-9A-Za-z]|[^\x00-\x7f]")


def pieces(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def low(w: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), w)


PROSE = ["", "One two, two THREE three. Four!\n\nfour five 66 a-b é|x\n", "x", "  ", "Same line here\nSame line here\nIdiot! You 1d1ot", "wordwordwordword ok? #$% @me\t~~", "É È ab"]


def test_statistics_match_plain_python():
    got = quality.statistics([t.encode() for t in PROSE])
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".,", "!?", "|", "#$%&*@^~=+<>\\/_{}"]

    def kind(c: int) -> int:
        return 11 if c >= 128 else next((k for k, s in enumerate(kinds) if chr(c) in s), 10)

    for t, row in zip(PROSE, got, strict=True):
        raw, w = t.encode(), [x.encode() for x in pieces(t)]
        n, words = len(raw), max(1, len(w))
        want = [np.log1p(n), np.log1p(len(w))] + [sum(kind(c) == k for c in raw) / max(n, 1) for k in range(12)]
        size = [len(x) for x in w]
        mean = sum(size) / words
        want += [mean, np.sqrt(max(sum(x * x for x in size) / words - mean**2, 0)), sum(x <= 3 for x in size) / words, sum(x >= 14 for x in size) / words]
        up, small = [sum(65 <= c <= 90 for c in x) for x in w], [sum(97 <= c <= 122 for c in x) for x in w]
        first, last = [kind(x[0]) for x in w], [kind(x[-1]) for x in w]
        want += [sum(a > 0 and b == 0 for a, b in zip(up, small, strict=True)) / words, first.count(1) / words, last.count(6) / words, last.count(7) / words, (last.count(8) + last.count(9)) / words, last.count(11) / words]
        lower = [low(x) for x in pieces(t)]
        runs = [tuple(lower[i : i + 3]) for i in range(len(lower) - 2)] or ([tuple(lower)] if lower else [])
        lines = [x for x in t.split("\n") if x]
        lines = [low(x) for x in lines]
        top = lambda x: max((x.count(y) for y in x), default=0)
        line_n = max(1, len(lines))
        want += [len(set(lower)) / words, top(lower) / words, len(set(runs)) / max(1, len(runs)), top(runs) / max(1, len(runs)), len(set(lines)) / line_n, np.log1p(line_n), len(w) / line_n, sum(c in b".," for c in raw) / words]
        want += [sum(a > 0 and b > 0 and f != 1 for a, b, f in zip(up, small, first, strict=True)) / words]
        assert np.allclose(row, want, rtol=1e-5, atol=1e-6), (t, [(i, a, b) for i, (a, b) in enumerate(zip(row, want, strict=True)) if abs(a - b) > 1e-5])


def test_features_match_plain_python():
    texts = [*PROSE, "you are 1diot and $tupid ****idiot!!!! m o r o n s", "idiots at you!!!! (you)", "%% $tup1d-moron a1 z9z 7up"]
    learnt = {"two": 2.5, "idio": 3.0, "moron": 4.0}
    hashed = lambda ws: {w: int(toxicity._hashes([w])[0]) for w in ws}
    ends = {"two": None, "idio": 4, "moron": 5}  # stems by length, and a whole word
    keys = []
    for w, m in ends.items():
        h = np.array([hashed([w])[w]], np.uint64)
        if m is not None:
            c = Words([w.encode()])
            h = toxicity.mix(c.span(c.sums(), c.start, c.end) + np.uint64(m))
        keys.append(int(h[0]))
    model = toxicity.Model(toxicity.Lexicon(np.array(keys, np.uint64), np.array(list(learnt.values()))), None, None)
    got = model.features([t.encode() for t in texts])
    leet = str.maketrans("013457@$!", "oieastasi")

    def core(w: str) -> str:
        at = [m.start() for m in WORDLIKE.finditer(w)]
        return w[at[0] : at[-1] + 1] if at else w

    for t, row in zip(texts, got, strict=True):
        w = [low(x) for x in pieces(t)]
        cores = [core(x) for x in w]
        n, words = len(t.encode()), max(1, len(w))
        odds = [max([learnt["idio"] if len(c.encode()) >= 4 and c.encode()[:4] == b"idio" else 0.0, learnt["moron"] if len(c.encode()) >= 5 and c.encode()[:5] == b"moron" else 0.0, learnt["two"] if c == "two" else 0.0]) for c in cores]
        insult = [c in toxicity.INSULTS for c in cores]
        letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
        odd = [letter(c[0]) and not all(map(letter, c)) for c in cores]
        masked = [not all(map(letter, x)) and not y and (c.translate(leet) in toxicity.INSULTS or x.translate(leet) in toxicity.INSULTS) for x, c, y in zip(w, cores, insult, strict=True)]
        you = [c in toxicity.SECOND for c in cores]
        bad = [a > 0 or b or c for a, b, c in zip(odds, insult, masked, strict=True)]
        near = [any(you[j] for j in range(max(0, i - 3), min(len(w), i + 4))) for i in range(len(w))]
        both = sum(a and b for a, b in zip(bad, near, strict=True))
        single = [len(c.encode()) == 1 and letter(c) for c in cores]
        spaced = sum(single[i] and single[i - 1] and single[i - 2] for i in range(2, len(w)))
        raw = t.encode()
        signs = sum(not (chr(c).isascii() and chr(c).isalnum() or c >= 128 or c in b" \t\n\v\f\r") for c in raw)
        hits = sum(x > 0 for x in odds)
        want = [np.log1p(len(w)), hits, hits / words, sum(odds), sum(odds) / words, max(odds, default=0), sum(insult), sum(insult) / words, sum(masked), sum(masked) / words, sum(you) / words, both, both / words]
        want += [sum(65 <= c <= 90 for c in raw) / max(n, 1), signs / max(n, 1), sum(c in b"!?" for c in raw) / max(n, 1), sum(odd) / words, spaced / words]
        assert np.allclose(row, want, rtol=1e-5, atol=1e-6), (t, [(i, a, b) for i, (a, b) in enumerate(zip(row, want, strict=True)) if abs(a - b) > 1e-5])


def test_lexicons_leave_a_fold_out(spark):
    rows = [(i, ("slurry " if i % 2 else "") + f"text t{i} " + ("foldzero" if i % 6 == 1 else ""), i % 2, i % 3) for i in range(60)]
    sample = spark.createDataFrame([*rows, *rows[:7]], "doc_id long, text string, y int, fold int")
    terms = toxicity.term_counts(sample).cache()
    texts = {f: (10, 20) for f in range(3)}
    word = lambda x: int(toxicity._hashes([x])[0])
    counts = {r.h & (1 << 64) - 1: r for r in terms.collect()}
    assert [counts[word("slurry")][c] for c in ("pos_0", "n_0", "pos_1", "n_1")] == [10, 10, 10, 10] and counts[word("text")]["n_2"] == 20
    whole, rest = toxicity.lexicon(terms, texts), toxicity.lexicon(terms, texts, without=1)
    assert word("foldzero") in whole.keys.tolist() and word("foldzero") not in rest.keys.tolist() and word("slurry") in rest.keys.tolist()


def test_fold(spark):
    ids = [0, 7, 123456789, -4]
    got = spark.createDataFrame([(i,) for i in ids], "d long").select(learn.fold(F.col("d")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(i).encode()) % 3 for i in ids]


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_held_out_accuracy(spark, what):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    if what == "quality":
        out = quality.score(spark, docs, quality.learn(spark, docs, labels))
    else:
        out = toxicity.score(spark, docs, toxicity.learn(spark, docs, labels))
    rows = quality.predicted(out, 0.5).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.predicted == r[what] for r in rows]) > (0.97 if what == "quality" else 0.93)
    assert out.count() == docs.count()


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (4, "x" * 200_000, 5), (5, "you idiot", 5), (5, "you idiot", 5), (6, " \n\t", 5), (7, "é" * 3, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for lab in (labels, none):
        a = quality.score(spark, df, quality.learn(spark, df, lab))
        b = toxicity.score(spark, df, toxicity.learn(spark, df, lab))
        for out in (a, b):
            got = out.collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and out.columns == ["doc_id", "text", "score"]
    assert quality.score(spark, df.limit(0), quality.learn(spark, df.limit(0), none)).count() == 0
