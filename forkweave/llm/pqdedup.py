"""Embedding near-dedup by product quantisation.

Vectors are compared only within a label. Equal vectors of a label (by two 64-bit hashes) form a class, represented by
its smallest vec_id; all else works on classes. Coarse centroids, fine centroids of the residuals and residual subspace
codes are fitted on a bounded, deterministic sample (parameter `fit_rows`); every class is indexed: its inverted list
(coarse and fine), its code and the norm of its coding error. There are as many lists as make `list_rows` rows a list of
the largest label, coarse and fine ones each about the root of that number, so that finding a list costs the root too.

Every class is a query. It probes each list whose cell lies within t of it, at both levels (the distance to the bisecting
hyperplane of the own and the other centroid). The cosine allows a distance r; t is r times min(1, sigmas / sqrt(d)): in
up to sigmas^2 dimensions probes suffice by proof; beyond, a link that leaves its cell by more than t must point `sigmas`
standard deviations of a random direction towards the bisector. Recall is measured against brute force in the tests and
the README. In a list, the asymmetric distance from lookup tables, less the member's coding error, bounds the true
distance from below, first over a few subspaces, then over all; what remains is reranked by the exact cosine.

Lists of a coarse cell lie together in units of about UNIT rows, cut into blocks of BLOCK members; a unit's queries are
cut into parts of VISITORS rows, so that no task holds a large group. A block gives the number of links of each query
and a spanning forest of its links, not the links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; vectors of different lengths do not link; a null vec_id has a null component, does not link and is kept; rows
that share a vec_id are judged by their own vectors; repeated rows are links of each other; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch
from .components import components, forest

UNIT = 4096
BLOCK = 2048
VISITORS = 16_384
PARTS = 16
#: Subspaces of the first bound.
LEAD = 4
CODES = 64


def _squares(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((u * u).sum(1)[:, None] - 2 * u @ c.T + (c * c).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], k) / np.maximum(n, 1), c[:, j])
    return c


def _gaps(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how far each other centroid's cell is at least."""
    d2 = _squares(u, c)
    own, rows = d2.argmin(1), np.arange(len(u))
    apart = np.sqrt(_squares(c[own], c))
    gap = (d2 - d2[rows, own][:, None]) / np.maximum(2 * apart, 1e-12)
    gap[rows, own] = 0
    return own, gap


class Index:
    """Coarse centroids, fine centroids of their residuals, and codes of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        side = max(1, round(math.sqrt(lists)))
        self.coarse = kmeans(sample, side)
        rest = sample - self.coarse[_squares(sample, self.coarse).argmin(1)]
        self.fine = kmeans(rest, -(-lists // side), seed=4)
        self.width = -(-sample.shape[1] // PARTS)
        self.parts = -(-sample.shape[1] // self.width)
        split = self.split(rest)
        self.codes = [kmeans(split[:, p], CODES, seed=p) for p in range(self.parts)]

    def split(self, r: np.ndarray) -> np.ndarray:
        """Rows by subspace: rows, parts, width."""
        r = np.pad(r, ((0, 0), (0, self.width * self.parts - r.shape[1])))
        return r.reshape(len(r), self.parts, self.width)

    def encode(self, u: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, and the norms of the coding errors of the first LEAD subspaces and of all."""
        r = self.split(u - self.coarse[cell])
        codes, left = np.zeros((len(u), self.parts), np.uint8), np.zeros((len(u), self.parts))
        for p, book in enumerate(self.codes):
            d2 = _squares(r[:, p], book)
            codes[:, p] = d2.argmin(1)
            left[:, p] = d2[np.arange(len(u)), codes[:, p]]
        return codes, np.sqrt(left[:, :LEAD].sum(1)), np.sqrt(left.sum(1))

    def place(self, u: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's own list, and the lists whose cells come within `most` of it at both levels. A list is coarse * fines + fine."""
        fines = len(self.fine)
        own, gap = _gaps(u, self.coarse)
        home = own * fines
        out: list[list[np.ndarray]] = [[] for _ in range(len(u))]
        near = gap <= most[:, None]
        for c in np.flatnonzero(near.any(0)).tolist():
            at = np.flatnonzero(near[:, c])
            fine, fine_gap = _gaps(u[at] - self.coarse[c], self.fine)
            mine = own[at] == c
            home[at[mine]] += fine[mine]
            for i, row in zip(at.tolist(), fine_gap <= most[at][:, None], strict=True):
                out[i].append(c * fines + np.flatnonzero(row))
        return home, [np.concatenate(x) for x in out]

    def candidates(self, u: np.ndarray, cell: int, codes: np.ndarray, lead: np.ndarray, err: np.ndarray, i: np.ndarray, j: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of exact rows i and coded members j of one coarse cell that their asymmetric distances leave possible."""
        r = self.split(u - self.coarse[cell])
        tables = [_squares(r[:, p], book).astype(np.float32) for p, book in enumerate(self.codes)]
        sums = np.zeros(len(i), np.float32)
        for p in range(min(LEAD, self.parts)):
            sums += tables[p][i, codes[j, p]]
        keep = np.sqrt(sums) - lead[j] <= reach + 1e-4
        i, j, sums = i[keep], j[keep], sums[keep]
        for p in range(LEAD, self.parts):
            sums += tables[p][i, codes[j, p]]
        keep = np.sqrt(sums) - err[j] <= reach + 1e-4
        return i[keep], j[keep]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs have the cosine, in double precision."""
    hit = np.zeros(len(i), bool)
    norm_q, norm_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    for k in range(0, len(i), 1 << 15):
        p, r = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        hit[k : k + (1 << 15)] = (q[p] * x[r]).sum(1) / (norm_q[p] * norm_x[r]) >= cosine
    return hit


def link(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, fit_rows: int = 20_000, list_rows: int = 32, sigmas: float = 4.0) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    bounded_batches(spark)
    with scratch(spark):
        return _link(spark, vectors, cosine, fit_rows, list_rows, sigmas)


def _link(spark: SparkSession, vectors: DataFrame, cosine: float, fit_rows: int, list_rows: int, sigmas: float) -> DataFrame:
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")  # as exact as the table's own
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("x", F.when(F.coalesce(ok, F.lit(False)), F.transform("x", lambda v: v + F.lit(0.0))))
    rows = rows.withColumns({"k1": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), "x")), "k2": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(2), "x"))})
    key = ["label", "k1", "k2"]
    classes = rows.where("x is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x"))
    classes = saved(spark, classes, "classes")
    shape = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    dim = shape["d"] or 1
    # two angles, three roundings: a little more than the cosine allows
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6

    def padded(xs) -> np.ndarray:
        out = np.zeros((len(xs), dim))
        for k, x in enumerate(xs):
            out[k, : len(x)] = x
        return out

    def held(raw) -> np.ndarray:
        return padded([np.frombuffer(r, kind) for r in raw])

    sample = classes.orderBy(F.xxhash64("rep", *key[1:]), "rep").limit(fit_rows).select("rep", "k1", "x").toPandas().sort_values(["rep", "k1"])
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = Index(_unit(padded(sample["x"])), max(1, shape["n"] // list_rows))
    shared = spark.sparkContext.broadcast(index)  # bounded by fit_rows: no more centroids than rows
    fines = len(index.fine)
    span = max(1, min(fines, UNIT // list_rows))  # fine lists in a unit
    units = -(-fines // span)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            if len(b):
                u = _unit(padded(b["x"]))
                d = np.array([len(x) for x in b["x"]])
                home, near = shared.value.place(u, reach * np.minimum(1, sigmas / np.sqrt(d)))
                codes, lead, err = shared.value.encode(u, home // fines)
                raw = [np.asarray(x, kind).tobytes() for x in b["x"]]
                yield pd.DataFrame({"label": b["label"], "d": d, "rep": b["rep"], "n": b["n"], "x": raw, "home": home, "codes": [c.tobytes() for c in codes], "lead": lead, "err": err, "probes": near})

    placed = classes.select("label", "rep", "n", "x").mapInPandas(place, "label string, d int, rep long, n long, x binary, home long, codes binary, lead double, err double, probes array<long>")
    placed = saved(spark, placed, "index")
    unit = lambda cell: F.floor(cell / fines) * units + F.floor(F.pmod(cell, F.lit(fines)) / span)
    group = ["label", "d", "unit"]
    members = placed.withColumn("unit", unit(F.col("home")))
    visits = placed.select("*", F.explode(F.array_distinct(F.transform("probes", unit))).alias("unit"))
    blocks = members.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts_of = visits.groupBy(*group).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    sizes = saved(spark, blocks.join(parts_of, group), "sizes")
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = members.join(sizes, group).withColumn("block", deal(1, "blocks")).withColumn("part", all_of("parts"))
    members = members.select(*group, "block", "part", F.lit(0).alias("role"), "rep", "n", "x", "codes", "lead", "err", F.array("home").alias("cells"))
    visits = visits.join(sizes, group).withColumn("part", deal(2, "parts")).withColumn("block", all_of("blocks"))
    nothing = [F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("lead"), F.lit(0.0).alias("err")]
    visits = visits.select(*group, "block", "part", F.lit(1).alias("role"), "rep", "n", "x", *nothing, F.filter("probes", lambda c: unit(c) == F.col("unit")).alias("cells"))
    place_of = [*group, "block", "part"]
    dealt = members.unionByName(visits).withColumn("gid", F.xxhash64(*place_of)).repartition("gid").sortWithinPartitions("gid", *place_of, "role")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, None
        for b in parts:
            if not len(b):
                continue
            names = list(zip(*(b[c].tolist() for c in place_of), strict=True))
            starts = [0, *[k for k in range(1, len(b)) if names[k] != names[k - 1]]]
            a_out, b_out, n_out = [], [], []
            for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                part = b.iloc[s:e]
                if names[s] != now:
                    now, kept = names[s], None
                coarse, first = now[2] // units, now[2] // units * fines + now[2] % units * span
                new = part[part["role"] == 0]
                if len(new):
                    home = np.concatenate(new["cells"].tolist()) - first
                    mine = (new["rep"].to_numpy(), new["n"].to_numpy(), held(new["x"]), np.frombuffer(b"".join(new["codes"]), np.uint8).reshape(len(new), -1), new["lead"].to_numpy(), new["err"].to_numpy(), home)
                    kept = mine if kept is None else tuple(np.concatenate(z) for z in zip(kept, mine, strict=True))
                asked = part[part["role"] == 1]
                if not len(asked) or kept is None:
                    continue
                rep, n, x, codes, lead, err, home = kept
                step = max(1, (1 << 21) // len(rep))
                for k in range(0, len(asked), step):
                    some = asked.iloc[k : k + step]
                    q, ids = held(some["x"]), some["rep"].to_numpy()
                    probed = np.zeros((len(some), span), bool)
                    cells = some["cells"].tolist()
                    probed[np.repeat(np.arange(len(some)), [len(c) for c in cells]), np.concatenate(cells) - first] = True
                    i, j = np.nonzero(probed[:, home] & (ids[:, None] != rep))
                    i, j = shared.value.candidates(_unit(q), coarse, codes, lead, err, i, j, reach)
                    hit = _links(q, x, i, j, cosine)
                    i, j = i[hit], j[hit]
                    if not len(i):
                        continue
                    found = np.bincount(i, n[j], len(ids)).astype(np.int64)
                    at = np.flatnonzero(found)
                    tree = np.array(forest(ids[i], rep[j]), np.int64).reshape(-1, 2)
                    a_out += [ids[at], tree[:, 0]]
                    b_out += [np.full(len(at), -1), tree[:, 1]]
                    n_out += [found[at], np.zeros(len(tree), np.int64)]
            if a_out:
                yield pd.DataFrame({"a": np.concatenate(a_out), "b": np.concatenate(b_out), "links": np.concatenate(n_out)})

    found = dealt.select("gid", *place_of, "role", "rep", "n", "x", "codes", "lead", "err", "cells").mapInPandas(search, "a long, b long, links long")
    found = saved(spark, found, "found")
    label = components(spark, found.where("links = 0").select("a", "b"))
    number = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    done = classes.select(*key, "rep", "n").join(number, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    done = done.select(*key, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", *key).join(done, key, "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return saved(spark, out, "linked", lasting=True)
