"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are learnt from a bounded, deterministic sample of labelled rows (parameter `most`), flattened into arrays
and walked by vectorised numpy for every text of the table. Only the text is an input.

Defined results: null and empty texts score by the same trees as texts without words; a null doc_id matters to no
score; repeated rows and equal texts score alike; a score of exactly the threshold is predicted 1; texts of any length
are scored whole, one at a time; without labelled rows, or with one class only, the score is that class's clipped share
(0.5 without rows); an empty table gives no rows; further columns are kept as they are unless named score, which is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import bounded_batches
from .learn import fold, labelled, scored
from .textnum import Words, batches

MOST = 20_000
_CLASS = np.full(256, 10, np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".,", "!?", "|", "#$%&*@^~=+<>\\/_{}"]):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 11
_KINDS = 12


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text."""
    w = Words(texts)
    n, size = w.n, (w.doc_end - w.doc_start).astype(float)
    owner = np.repeat(np.arange(n), (w.doc_end - w.doc_start + 1))[: len(w.buf)]
    kind = _CLASS[w.buf]
    chars = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    chars[:-1, 4] -= 1  # the joints between texts
    per = chars / np.maximum(size, 1)[:, None]
    count = w.count.astype(float)
    words = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    cum = lambda c: np.concatenate([[0], np.cumsum(kind == c)])
    up, low = cum(1), cum(0)
    ups, lows = up[w.end] - up[w.start], low[w.end] - low[w.start]
    last, first = kind[w.end - 1], kind[w.start]
    each = lambda v: np.bincount(w.doc, v, n)
    h = w.span(w.sums(), w.start, w.end)
    mean = each(length) / words

    def distinct(owner: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and the count of its commonest."""
        order = np.lexsort((g, owner))
        o, v = owner[order], g[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, o[at], np.diff(np.append(at, len(v))))
        return np.bincount(o[at], minlength=n).astype(float), top

    kinds, top = distinct(w.doc, h)
    so, sg = w.shingles(3, h)
    runs, run_top = distinct(so, sg)
    run_n = np.maximum(np.bincount(so, minlength=n), 1)
    # lines: spans between newlines, hashed whole
    brk = np.flatnonzero(w.buf == 10)
    ls, le = np.concatenate([[0], brk + 1]), np.append(brk, len(w.buf))
    full = le > ls
    ls, le = ls[full], le[full]
    lo = np.searchsorted(w.doc_start, ls, "right") - 1
    line_n = np.maximum(np.bincount(lo, minlength=n), 1).astype(float)
    line_kinds, _ = distinct(lo, w.span(w.sums(), ls, le))
    out = [np.log1p(size), np.log1p(count), *per.T, mean, np.sqrt(np.maximum(each(length**2) / words - mean**2, 0)), each(length <= 3) / words, each(length >= 14) / words]
    out += [each((ups > 0) & (lows == 0)) / words, each(first == 1) / words, each(last == 6) / words, each(last == 7) / words, each((last == 8) | (last == 9)) / words, each(last == 11) / words]
    out += [kinds / words, top / words, runs / run_n, run_top / run_n, line_kinds / line_n, np.log1p(line_n), count / line_n, chars[:, 6] / words, each((ups > 0) & (lows > 0) & (first != 1)) / words]
    return np.stack(out, 1).astype(np.float32)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> gbt.Trees:
    """Trees from the labelled sample; its statistics (at most `most` rows) come to the driver."""
    bounded_batches(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            ids, y = b["doc_id"].to_numpy(), b["y"].to_numpy()
            for first, texts in batches(b["text"].tolist()):
                x = statistics(texts)
                yield pd.DataFrame({"doc_id": ids[first : first + len(texts)], "y": y[first : first + len(texts)], "x": [r.tobytes() for r in x]})

    rows = labelled(docs, labels, label, most).mapInPandas(run, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)
    return gbt.fit(x.astype(np.float64), rows["y"].to_numpy(np.float64))


def score(spark: SparkSession, docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """docs with the double column score, from 0 to 1."""
    kept = spark.sparkContext.broadcast(trees)
    return scored(spark, docs, lambda texts: kept.value.score(statistics(texts).astype(np.float64)))


def predicted(scored: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
