"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features: densities of a fixed and a learnt lexicon (stems of words and their odds among labelled texts), lexicon
words near second-person words, rates of capitals, punctuation and obfuscation (digits or signs inside words, spaced
letters). The learnt lexicon (the `size` = 4000 terms of the highest odds) and the trees come from a bounded,
deterministic sample of labelled rows (parameter `most`); calibration uses scores of lexicons and trees that have not
seen the row's fold. Folds go by the text's hash, so that copies share one.

Defined results: null and empty texts score as texts without words; a null doc_id matters to no score; repeated rows and
equal texts score alike, ties of odds go by count, then hash; texts of any length are scored whole, one at a time; without
labelled rows, or with one class only, every score is that class's clipped share before calibration; an empty table gives
no rows; further columns are kept unless named score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import bounded_batches, saved, scratch
from .learn import labelled, scored
from .textnum import LOWER, SPACE, Words, batches, mix

MOST = 20_000
#: Plain insults and second-person words.
INSULTS = "idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting imbecile fool ugly vermin filth".split()
SECOND = "you your yours yourself you're youre u du dich dir dein deine deinen ihr euch tu toi te ton ta tes vous votre vos usted ustedes ti tú vosotros".split()
STEMS = (4, 5, 6, 7)
FOLDS = 3
_LEET = LOWER.copy()
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _LEET[ord(_a)] = ord(_b)
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = _WORDLIKE.copy()
_LETTER[48:58] = False


class Cores(Words):
    """Words without signs at either end; words of signs alone are left as they are."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        like = np.flatnonzero(_WORDLIKE[self.buf])
        low, high = np.searchsorted(like, self.start), np.searchsorted(like, self.end)
        some = high > low
        self.core_start, self.core_end = self.start.copy(), self.end.copy()
        self.core_start[some], self.core_end[some] = like[low[some]], like[high[some] - 1] + 1

    def stems(self, sums: np.ndarray) -> list[np.ndarray]:
        """Hashes of the first bytes of each core, 0 where it is shorter, and of the whole core."""
        out = []
        for m in STEMS:
            ok = self.core_end - self.core_start >= m
            h = np.zeros(len(self.start), np.uint64)
            h[ok] = mix(self.span(sums, self.core_start[ok], self.core_start[ok] + m) + np.uint64(m))
            out.append(h)
        return [*out, self.span(sums, self.core_start, self.core_end)]


def _hashes(words: list[str]) -> np.ndarray:
    w = Words([x.encode() for x in words])
    return np.sort(w.span(w.sums(), w.start, w.end))


class Lexicon:
    """Sorted hashes with odds; a bit table in front of the search."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray | None = None):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], (np.ones(len(keys)) if odds is None else odds)[order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        if len(self.keys):
            maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = self.odds[at[hit]]
        return out


def features(texts: list[bytes], learnt: Lexicon, fixed: Lexicon, second: Lexicon) -> np.ndarray:
    w = Cores(texts)
    n = w.n
    count = w.count.astype(float)
    words = np.maximum(count, 1)
    each = lambda v: np.bincount(w.doc, v, n)
    stems = w.stems(w.sums())
    odds = np.zeros(len(w.start))
    for h in stems:
        odds = np.maximum(odds, learnt(h))
    insult = fixed(stems[-1]) > 0
    inner = np.concatenate([[0], np.cumsum(~_LETTER[w.buf])])
    odd = (inner[w.core_end] - inner[w.core_start] > 0) & _LETTER[w.buf[w.core_start]]
    # a word with signs or digits anywhere, with those read as the letters that they stand for, with its ends and without
    mixed = np.flatnonzero(inner[w.end] - inner[w.start] > 0)
    sums = w.sums(_LEET)
    masked = np.zeros(len(w.start), bool)
    masked[mixed] = ((fixed(w.span(sums, w.core_start[mixed], w.core_end[mixed])) > 0) | (fixed(w.span(sums, w.start[mixed], w.end[mixed])) > 0)) & ~insult[mixed]
    bad = (odds > 0) | insult | masked
    you = second(stems[-1]) > 0
    # words from the last second-person word of the same text, and to the next
    at = np.flatnonzero(you)
    near = np.zeros(len(w.start), bool)
    if len(at):
        place = np.arange(len(w.start))
        k = np.searchsorted(at, place)
        for j in (np.maximum(k - 1, 0), np.minimum(k, len(at) - 1)):
            near |= (np.abs(at[j] - place) <= 3) & (w.doc[at[j]] == w.doc)
    top = np.zeros(n)
    np.maximum.at(top, w.doc, odds)
    size = np.maximum(w.doc_end - w.doc_start, 1).astype(float)
    owner = np.repeat(np.arange(n), w.doc_end - w.doc_start + 1)[: len(w.buf)]
    share = lambda mask: np.bincount(owner[mask[w.buf]], minlength=n) / size
    upper, bang = np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91] = True
    bang[[33, 63]] = True
    single = (w.core_end - w.core_start == 1) & _LETTER[w.buf[w.core_start]]
    spaced = np.zeros(len(single), bool)
    if len(single) > 2:
        spaced[2:] = single[2:] & single[1:-1] & single[:-2] & (w.doc[2:] == w.doc[:-2])
    cols = [np.log1p(count), each(odds > 0), each(odds > 0) / words, each(odds), each(odds) / words, top, each(insult), each(insult) / words, each(masked), each(masked) / words]
    cols += [each(you) / words, each(bad & near), each(bad & near) / words, share(upper), share(~_WORDLIKE & ~SPACE), share(bang), each(odd) / words, each(spaced) / words]
    return np.stack(cols, 1).astype(np.float32)


class Model:
    def __init__(self, learnt: Lexicon, trees: gbt.Trees, curve: tuple[np.ndarray, np.ndarray]):
        self.learnt, self.fixed, self.second, self.trees, self.curve = learnt, Lexicon(_hashes(INSULTS)), Lexicon(_hashes(SECOND)), trees, curve

    def features(self, texts: list[bytes]) -> np.ndarray:
        return features(texts, self.learnt, self.fixed, self.second)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.interp(self.trees.score(self.features(texts).astype(np.float64)), *self.curve)


def term_counts(sample: DataFrame) -> DataFrame:
    """h, and for each fold pos_k and n_k: in how many toxic and in how many different texts of the fold each term is. sample: with fold."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            y, folds = b["y"].to_numpy(), b["fold"].to_numpy(np.int64)
            hs, ps, fs = [], [], []
            for first, texts in batches(b["text"].tolist()):
                w = Cores(texts)
                h = np.concatenate(w.stems(w.sums()))
                d = np.tile(w.doc, len(STEMS) + 1)
                keep = h != 0
                order = np.lexsort((d[keep], h[keep]))
                h, d = h[keep][order], d[keep][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                hs.append(h[new])
                ps.append(y[first + d[new]])
                fs.append(folds[first + d[new]])
            if hs:
                keys, at = np.unique(np.concatenate(hs), return_inverse=True)
                pos, k = np.concatenate(ps), np.concatenate(fs)
                out = {"h": keys.view(np.int64)}
                for f in range(FOLDS):
                    out[f"pos_{f}"] = np.bincount(at[k == f], pos[k == f], len(keys)).astype(np.int64)
                    out[f"n_{f}"] = np.bincount(at[k == f], minlength=len(keys))
                yield pd.DataFrame(out)

    once = sample.groupBy(F.xxhash64("text").alias("k")).agg(F.max("y").alias("y"), F.first("fold").alias("fold"), F.first("text").alias("text"))
    names = [f"{x}_{f}" for f in range(FOLDS) for x in ("pos", "n")]
    terms = once.select("y", "fold", "text").mapInPandas(run, "h long, " + ", ".join(f"{c} long" for c in names))
    return terms.groupBy("h").agg(*[F.sum(c).alias(c) for c in names])


def lexicon(terms: DataFrame, texts: dict[int, tuple[int, int]], without: int | None = None, size: int = 4000, least: int = 4) -> Lexicon:
    """The stems and words with the highest odds among toxic texts, at most `size`, but for one fold. texts: toxic and all texts of each fold."""
    folds = [f for f in range(FOLDS) if f != without]
    pos, n = sum(texts.get(f, (0, 0))[0] for f in folds), sum(texts.get(f, (0, 0))[1] for f in folds)
    total = lambda x: sum((F.col(f"{x}_{f}") for f in folds), F.lit(0))
    terms = terms.select("h", total("pos").alias("pos"), total("n").alias("n"))
    odds = F.log((F.col("pos") + 0.1) / (pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.1) / (n - pos + 1))
    top = terms.withColumn("odds", odds).where((F.col("pos") >= least) & (F.col("odds") > 2)).orderBy(F.desc("odds"), F.desc("pos"), "h").limit(size).toPandas()
    return Lexicon(top["h"].to_numpy(np.int64).view(np.uint64), top["odds"].to_numpy(np.float64))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST) -> Model:
    """The model from the labelled sample; its features (at most `most` rows) come to the driver."""
    bounded_batches(spark)
    with scratch(spark):
        fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
        sample = saved(spark, labelled(docs, labels, label, most).withColumn("fold", fold), "labelled")
        counts = sample.groupBy(F.xxhash64("text"), "fold").agg(F.max("y").alias("y")).groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
        texts = {r["fold"]: (int(r["p"] or 0), int(r["n"])) for r in counts}
        terms = saved(spark, term_counts(sample), "terms")
        # the last model has all folds, the others leave one out
        models = [Model(lexicon(terms, texts, f), None, None) for f in [*range(FOLDS), None]]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in parts:
                ids, y, folds = b["doc_id"].to_numpy(), b["y"].to_numpy(), b["fold"].to_numpy()
                for first, raw in batches(b["text"].tolist()):
                    x = np.stack([m.features(raw) for m in models], 1)
                    at = slice(first, first + len(raw))
                    yield pd.DataFrame({"doc_id": ids[at], "y": y[at], "fold": folds[at], "x": [r.tobytes() for r in x]})

        rows = sample.mapInPandas(run, "doc_id long, y int, fold int, x binary").toPandas().sort_values(["doc_id", "x"])
    y, part = rows["y"].to_numpy(np.float64), rows["fold"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), FOLDS + 1, -1).astype(np.float64) if len(rows) else np.zeros((0, FOLDS + 1, 1))
    unseen = np.zeros(len(rows))
    for f in range(FOLDS):
        if (part == f).any():
            unseen[part == f] = gbt.fit(x[part != f, f], y[part != f], trees=60, depth=3).score(x[part == f, f])
    model = models[-1]
    model.trees, model.curve = gbt.fit(x[:, -1], y, trees=60, depth=3), gbt.isotonic(unseen, y)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with the double column score, from 0 to 1."""
    kept = spark.sparkContext.broadcast(model)
    return scored(spark, docs, lambda texts: kept.value.score(texts))
