"""MinHash near-dedup by bottom-k sketches from one hash function.

A document's set holds the distinct runs of `words` words (A-Z as a-z); a text with fewer words has them all as one run,
a text without words an empty set, which links with nothing. Equal sets form a class, represented by its smallest
doc_id; all else works on classes.

1. Inverted lists: each of a class's KEYS smallest hashes is a key. Two sets of similarity t miss each other only if none
   of the KEYS smallest hashes of their union is in both: (1 - t)^KEYS, 6e-9 at 0.85, 1e-7 at 0.80.
2. Round one links each list's members to its smallest member, a hub, so it makes as many candidates as list entries.
   Union sketches of SKETCH hashes estimate the similarity and filter far below the threshold; exact Jaccard on full sets
   confirms. Confirmed links give components.
   Hot lists (more than HOT members) have two more hubs: another member of the first hub's component, and one outside.
3. Round two compares the members of a list that are in different components: first by sketches, which tells who has a
   candidate at all, then those by full sets. A list that is not hot is a block; a pair is met in the list of its smallest
   common key alone, and a block gives a spanning forest of its confirmed links. Members of hot lists (a passage that many
   documents share) are compared but for pairs of far classes, which have more than MISSES keys that are not hot: such a
   pair meets in a list that is not hot, unless all that it shares is hot and yet more than MISSES of the KEYS keys of each
   lie in what the other lacks, at most 3e-12 at 0.85 and 2e-10 at 0.80. All hot lists are compared together, each class
   once however many of them it is in: the members are written in order of set size and dealt evenly, and each task reads
   the members of a size that may do. So rows grow with the members; what tasks read of those files, and the comparisons
   of sketches within tasks, still grow with the near members times the members of such a size.

The estimate that a candidate must reach is 5.5 standard errors below the threshold: of pairs at the threshold itself it
rejects about 4e-6. Sets hold 64-bit hashes of runs and classes go by 128 bits of their sets, so "equal" and "exact" hold
but for collisions: two of n different runs share a hash with a chance below n^2 / 2^65.

Defined results of link(): a null text has no words; a null doc_id links with nothing, has a null component_id and is
kept; ids of any 64 bits are kept as they are; rows that share a doc_id are judged by their own texts; repeated rows are
kept; ties of similarity at the threshold are links; texts of any length are one set, held whole by one task; an empty
table gives no rows; further columns are not read. Of survivors(): see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, flagged, saved, saved_at, scratch
from .components import components, forest
from .textnum import Words, batches

KEYS = 10
SKETCH = 32
HOT = 256
MISSES = 6
#: Members of hot lists that ABREAST others are compared with in a go.
VISITORS = 1024
ABREAST = 64
#: Rows of a file of members of hot lists, and bytes of their sets, about.
PLACED, PLACED_BYTES = 4096, 16 << 20
#: Broadcast a table of ids up to this many rows (8 bytes each, and a set's key of 16); beyond it, it is joined by shuffle.
BROADCAST_IDS = 200_000


def _key(s: np.ndarray) -> bytes:
    """128 bits of a set of mixed hashes."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), (s * s * np.uint64(0x9E3779B97F4A7C15) + (s >> np.uint64(7))).sum(dtype=np.uint64)], np.uint64).tobytes()


def sketches(spark: SparkSession, docs: DataFrame, words: int) -> DataFrame:
    """doc_id (null: 0), no_doc_id, h (the text's hash), n (set size), key (of the set), sketch (its smallest hashes, ascending)."""
    bounded_batches(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for first, texts in batches(b["text"].tolist()):
                sets = Words(texts).shingle_sets(words)
                low = [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]  # signed, in the same order
                at = slice(first, first + len(texts))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at].to_numpy(), "no_doc_id": b["no_doc_id"].iloc[at].to_numpy(), "h": b["h"].iloc[at].to_numpy(), "n": [len(s) for s in sets], "key": [_key(s) for s in sets], "sketch": low})

    return docs.select(*flagged("doc_id"), "text", F.xxhash64("text").alias("h")).mapInPandas(run, "doc_id long, no_doc_id boolean, h long, n long, key binary, sketch array<long>")


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose union sketch does not speak against it."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    shared = F.size(F.filter(F.array_intersect("s_a", "s_b"), lambda x: x <= F.element_at(F.col("union"), -1)))
    both = both.where(small >= large * F.lit(least)).withColumn("union", union)
    floor = _floor(least)
    return both.where(shared >= F.size("union") * F.lit(floor)).select("a", "b")


def _floor(least: float) -> float:
    """The lowest estimate that is not yet evidence against the similarity: 5.5 standard errors below it."""
    return max(0.05, least - 5.5 * math.sqrt(least * (1 - least) / SKETCH))


def _sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """rep, set (sorted 64-bit hashes) of the classes in ids, made anew from their texts."""
    ids = saved(spark, ids.distinct().join(reps.select("rep", "key"), "rep"), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(ids) if few else ids, "rep")

    def full(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for first, texts in batches(b["text"].tolist()):
                out = [(r, s.tobytes()) for r, k, s in zip(b["rep"].iloc[first:], b["key"].iloc[first:], Words(texts).shingle_sets(words), strict=False) if _key(s) == bytes(k)]
                yield pd.DataFrame(out, columns=["rep", "set"])

    return saved(spark, wanted.mapInPandas(full, "rep long, set binary").dropDuplicates(["rep"]), "sets")


def _confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs with den * intersection >= num * union on full sets."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return saved(spark, both.mapInPandas(exact, "a long, b long"), "confirmed")


def _similar(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    small, large = (p, q) if len(p) < len(q) else (q, p)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return den * both >= num * (len(p) + len(q) - both)


def _marks(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(values)), np.float32)
    for k, s in enumerate(sets):
        out[k, np.searchsorted(values, s)] = 1
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray], wide: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections of sorted sets, over slices of the values so that memory stays bounded."""
    values = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(values), wide):
        part = values[at : at + wide]
        cut = lambda s, part=part: s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
        out += _marks([cut(s) for s in left], part) @ _marks([cut(s) for s in right], part).T
    return out


def _candidates(rows: pd.DataFrame, sketch: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of row pairs of one block that are in different components, may be similar and have the list's value as smallest common key.

    Two far rows meet in lists that are not hot alone: for them those alone count as common (own).
    """
    n, label, far = rows["n"].to_numpy(), rows["label"].to_numpy(), rows["far"].to_numpy()
    v, at = rows["v"].iloc[0], np.arange(len(rows))
    large, small = np.maximum(n[:, None], n), np.minimum(n[:, None], n)
    ok = (label[:, None] != label) & (small >= least * large) & (at[:, None] < at)
    if not ok.any():
        return at[:0], at[:0]
    ok &= _shared(sketch, sketch) >= _floor(least) * np.minimum(SKETCH, large)
    both_far = far[:, None] & far
    for column, pairs in (("keys", ~both_far), ("own", both_far)):
        if (ok & pairs).any():
            before = [np.asarray(s, np.int64)[np.asarray(s, np.int64) < v] for s in rows[column]]
            if any(len(x) for x in before):
                ok &= ~pairs | (_shared(before, before) == 0)
    return np.nonzero(ok)


def _small(rows: pd.DataFrame, sketch: np.ndarray, keys: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Places of rows that have a candidate in their list; all short lists of a batch at once."""
    first, second = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        first.append((at + i).ravel())
        second.append((at + j).ravel())
    a, b = np.concatenate(first), np.concatenate(second)
    n, label, v, far = rows["n"].to_numpy(), rows["label"].to_numpy(), rows["v"].to_numpy(), rows["far"].to_numpy()
    large = np.maximum(n[a], n[b])
    ok = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= least * large)
    a, b, large = a[ok], b[ok], large[ok]
    out = []
    for k in range(0, len(a), 1 << 14):
        p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
        x, y = sketch[p], sketch[q]
        both = np.sort(np.concatenate([x, y], 1), 1)
        same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
        both_far = (far[p] & far[q])[:, None]
        listed = np.sort(np.concatenate([np.where(both_far, own[p], keys[p]), np.where(both_far, own[q], keys[q])], 1), 1)
        twice = (listed[:, 1:] == listed[:, :-1]) & (listed[:, 1:] < v[p][:, None])
        good = (same.sum(1) >= _floor(least) * np.minimum(SKETCH, large[k : k + (1 << 14)])) & ~twice.any(1)
        out += [p[good], q[good]]
    return np.unique(np.concatenate(out)) if out else a[:0]


_NONE = np.iinfo(np.int64).max
SHORT = 48


def _padded(lists: list, width: int) -> np.ndarray:
    out = np.full((len(lists), width), _NONE, np.int64)
    for k, s in enumerate(lists):
        out[k, : len(s)] = s
    return out


def _have_candidates(least: float):
    """The rows that have a candidate in their block."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_blocks(parts):
            v = rows["v"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1])
            sizes = np.diff(np.append(starts, len(v)))
            lists = rows["sketch"].tolist()
            short = sizes <= SHORT
            keep = []
            if short.any():
                keep.append(_small(rows, _padded(lists, SKETCH), _padded(rows["keys"].tolist(), KEYS), _padded(rows["own"].tolist(), KEYS), starts[short], sizes[short], least))
            for s, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
                i, j = _candidates(rows.iloc[s : s + n], [np.asarray(x) for x in lists[s : s + n]], least)
                keep.append(np.unique(np.concatenate([i, j])) + s)
            at = np.concatenate(keep).astype(np.int64) if keep else np.zeros(0, np.int64)
            yield rows.iloc[np.unique(at)][["v", "rep", "n", "label", "far", "keys", "own"]]

    return task


def _whole_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in pieces that end where a block ends."""
    held: list[pd.DataFrame] = []
    for b in parts:
        if not len(b):
            continue
        v = b["v"].to_numpy()
        cuts = np.flatnonzero(v != v[-1])
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if held and (cut or held[-1]["v"].iloc[-1] != v[0]):
            if cut:
                held.append(b.iloc[:cut])
            yield pd.concat(held, ignore_index=True)
            held = [b.iloc[cut:]]
        elif cut:
            yield b.iloc[:cut].reset_index(drop=True)
            held = [b.iloc[cut:]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def _exact(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) of full sets have den * intersection >= num * union."""
    if len(i) <= 20_000:
        return np.array([_similar(left[p], right[q], num, den) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
    some, others = np.unique(i), np.unique(j)
    shared = _shared([left[k] for k in some], [right[k] for k in others])[np.searchsorted(some, i), np.searchsorted(others, j)]
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    return den * shared >= num * (n[i] + m[j] - shared)


def _links_in_blocks(least: float, num: int, den: int):
    """A spanning forest of each block's confirmed links, from full sets."""

    def block(rows: pd.DataFrame) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        sketch = [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
        i, j = _candidates(rows, sketch, least)
        if not len(i):
            return []
        good = _exact(sets, sets, i, j, num, den)
        rep = rows["rep"].to_numpy()
        return forest(rep[i[good]], rep[j[good]]) if good.any() else []

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_blocks(parts):
            v = rows["v"].to_numpy()
            cuts = np.flatnonzero(np.diff(v)) + 1
            out = [p for at in np.split(np.arange(len(v)), cuts) for p in block(rows.iloc[at])]
            yield pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return task


def _small_side(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table of hot lists (or their bands), written; broadcast up to BROADCAST_IDS rows, so that their members stay where they lie."""
    df = saved(spark, df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _labelled(lists: DataFrame, found: DataFrame) -> DataFrame:
    """lists with the label of each member's component."""
    return lists.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")


def _edges(found: DataFrame) -> DataFrame:
    """Components as links to their least member."""
    return found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def _more_stars(spark: SparkSession, lists: DataFrame) -> DataFrame:
    """a, b: the members of hot lists with two more hubs of other components."""
    hot = lists.where(F.col("members") > HOT)
    main = hot.groupBy("v").agg(F.min_by("label", "rep").alias("main"))
    hot = hot.join(_small_side(spark, main, "mains"), "v")
    inside = F.max(F.when(F.col("label") == F.col("main"), F.col("rep"))).alias("inside")
    outside = F.min(F.when(F.col("label") != F.col("main"), F.struct("rep", "label"))).alias("outside")
    hot = hot.join(_small_side(spark, hot.groupBy("v").agg(inside, outside), "hubs"), "v")
    one = hot.where("label <> main").select("rep", F.col("inside").alias("hub"))
    two = hot.where("label <> outside.label").select("rep", F.col("outside.rep").alias("hub"))
    both = one.unionAll(two).where("hub is not null")
    return both.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sketches; work in proportion to what they share."""
    x, y = np.concatenate(left), np.concatenate(right)
    i, j = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(y)
    y, j = y[order], j[order]
    first = np.searchsorted(y, x)
    times = np.searchsorted(y, x, "right") - first
    at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
    return np.bincount(np.repeat(i, times) * len(right) + j[at], minlength=len(left) * len(right)).reshape(len(left), len(right))


def _met(some: pd.DataFrame, rows: pd.DataFrame, mine: list[np.ndarray], theirs: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of members, not both far, that are in different components and may be similar."""
    n, m = some["n"].to_numpy()[:, None], rows["n"].to_numpy()
    large = np.maximum(n, m)
    ok = (some["label"].to_numpy()[:, None] != rows["label"].to_numpy()) & (np.minimum(n, m) >= least * large)
    ok &= ~(some["far"].to_numpy()[:, None] & rows["far"].to_numpy())
    if ok.any():
        ok &= _common(mine, theirs) >= _floor(least) * np.minimum(SKETCH, large)
    return np.nonzero(ok)


def _members(files: list[tuple[str, int, int]], lo: float, hi: float, most: int, near: bool = False) -> Iterator[pd.DataFrame]:
    """The written members of hot lists (near ones alone) with set sizes from lo to hi, at most `most` in a go. files: path, least and largest size."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for path, smallest, largest in files:
        if largest < lo or smallest > hi:
            continue
        system, p = fs.FileSystem.from_uri(path)
        with system.open_input_file(p) as f:
            for b in pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20).iter_batches(batch_size=most):
                rows = b.to_pandas()
                rows = rows[(rows["n"] >= lo) & (rows["n"] <= hi) & ~(near & rows["far"])]
                if len(rows):
                    yield rows


def _placed(spark: SparkSession, members: DataFrame, parts: int) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """members written in order of set size; the files, with their least and largest size."""
    table, path = saved_at(spark, members.repartitionByRange(parts, "n", "rep").sortWithinPartitions("n", "rep"), "hot")
    files = table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return table, [(f"{path}/{r.file}", r.lo, r.hi) for r in files.collect()]  # a row per file


def _dealt(members: DataFrame, count: int) -> DataFrame:
    return members.repartitionByRange(max(1, -(-count // (4 * ABREAST))), "far", "n", "rep").sortWithinPartitions("far", "n", "rep")


def _hot_met(spark: SparkSession, members: DataFrame, least: float) -> DataFrame:
    """rep: the members of hot lists (rep, n, label, far, sketch) that have a candidate among them."""
    table, files = _placed(spark, members, max(1, -(-members.count() // PLACED)))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for k in range(0, len(b), ABREAST):
                some = b.iloc[k : k + ABREAST]
                met, mine = np.zeros(len(some), bool), some["sketch"].tolist()
                for rows in _members(files, some["n"].min() * least, some["n"].max() / least, VISITORS, some["far"].all()):
                    met[_met(some, rows, mine, rows["sketch"].tolist(), least)[0]] = True
                yield some.loc[met, ["rep"]]

    return saved(spark, _dealt(table, table.count()).mapInPandas(task, "rep long"), "met-hot")


def _hot_links(spark: SparkSession, members: DataFrame, least: float, num: int, den: int) -> DataFrame:
    """a, b: a spanning forest by task of the confirmed links among members of hot lists (rep, n, label, far, set)."""
    count, ids, near = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(~F.col("far"), 1))).first()
    table, files = _placed(spark, members, max(1, -(-count // PLACED), -(-8 * ids // PLACED_BYTES)))
    most = max(1, min(VISITORS, PLACED_BYTES * count // max(1, 8 * ids)))

    def low(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]

    def thinned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return forest(*np.array(pairs, np.int64).T) if pairs else []

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: list[tuple[int, int]] = []
        for b in parts:
            for k in range(0, len(b), min(ABREAST, most)):
                some = b.iloc[k : k + min(ABREAST, most)]
                sets = [np.frombuffer(s, np.uint64) for s in some["set"]]
                for rows in _members(files, some["n"].min() * least, some["n"].max() / least, most):
                    others = [np.frombuffer(s, np.uint64) for s in rows["set"]]
                    i, j = _met(some, rows, low(sets), low(others), least)
                    a, b_ = some["rep"].to_numpy()[i], rows["rep"].to_numpy()[j]
                    once = rows["far"].to_numpy()[j] | (a < b_)  # two near ones meet twice
                    good = np.flatnonzero(once)[_exact(sets, others, i[once], j[once], num, den)] if once.any() else i[:0]
                    pairs += zip(a[good].tolist(), b_[good].tolist(), strict=True)
                    if len(pairs) > 1 << 16:
                        pairs = thinned(pairs)
        yield pd.DataFrame(thinned(pairs), columns=["a", "b"], dtype="int64")

    return saved(spark, _dealt(table.where("not far"), near).mapInPandas(task, "a long, b long").distinct(), "across-hot")


def link(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept: documents whose sets have den * intersection >= num * union are linked."""
    bounded_batches(spark)
    with scratch(spark):
        return saved(spark, _link(spark, docs, words, num, den), "linked", lasting=True)


def _link(spark: SparkSession, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    least = num / den
    rows = saved(spark, sketches(spark, docs, words), "sketches").withColumn("doc_id", F.when(~F.col("no_doc_id"), F.col("doc_id")))
    known = rows.where("doc_id is not null and n > 0")
    reps = saved(spark, known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    values = reps.select("rep", "n", F.least(F.size("sketch"), F.lit(KEYS)).alias("own"), F.explode(F.slice("sketch", 1, KEYS)).alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("members"), F.min("rep").alias("hub")).where("members > 1")
    lists = saved(spark, values.join(counts, "v"), "lists")

    stars = lists.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = saved(spark, _estimated(stars, reps, least), "stars")
    ends = stars.select(F.col("a").alias("rep")).unionAll(stars.select(F.col("b").alias("rep")))
    first = _confirmed(spark, stars, _sets(spark, docs, ends, reps, words), num, den)

    found = components(spark, first)
    if not lists.where(F.col("members") > HOT).isEmpty():
        more = saved(spark, _estimated(_more_stars(spark, _labelled(lists, found)), reps, least), "stars")
        ends = more.select(F.col("a").alias("rep")).unionAll(more.select(F.col("b").alias("rep")))
        found = components(spark, _edges(found).unionAll(_confirmed(spark, more, _sets(spark, docs, ends, reps, words), num, den)))

    # keys that no other class has are not hot either
    bare = lists.groupBy("rep").agg((F.first("own") - F.count("*") + F.sum((F.col("members") <= HOT).cast("int"))).alias("not_hot"))
    open_ = _labelled(lists, found).drop("hub", "own").join(bare, "rep").withColumn("far", F.col("not_hot") > MISSES).drop("not_hot")
    meets = F.max((F.col("members") <= HOT) | ~F.col("far")).alias("meets")  # a hot list of far classes alone compares nothing
    mixed = open_.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), meets).where("lo < hi and meets").select("v")
    open_ = saved(spark, open_.join(mixed, "v"), "open")
    # the lists that a class is compared in, and those where far ones are: a pair is met in the smallest of those that both are in
    own = F.when((F.col("members") <= HOT) | ~F.col("far"), F.col("v"))
    keys = open_.groupBy("rep").agg(F.array_sort(F.collect_set("v")).alias("keys"), F.array_sort(F.collect_set(own)).alias("own"))
    blocks = open_.where(F.col("members") <= HOT).select("v", "rep", "n", "label", "far")
    dealt = blocks.join(reps.select("rep", "sketch").join(keys, "rep"), "rep").repartition("v").sortWithinPartitions("v", "rep")
    met = saved(spark, dealt.mapInPandas(_have_candidates(least), "v long, rep long, n long, label long, far boolean, keys array<long>, own array<long>"), "met")
    wanted = met.select("rep")
    hot = open_.where(F.col("members") > HOT).select("rep", "n", "label", "far").distinct()
    some = not hot.isEmpty()
    if some:
        hot = saved(spark, hot.join(_hot_met(spark, hot.join(reps.select("rep", "sketch"), "rep"), least), "rep"), "hot-met")
        wanted = wanted.unionAll(hot.select("rep"))
    sets = _sets(spark, docs, wanted, reps, words)
    full = met.join(sets, "rep").repartition("v").sortWithinPartitions("v", "rep")
    second = saved(spark, full.mapInPandas(_links_in_blocks(least, num, den), "a long, b long").distinct(), "across")
    if some:
        second = second.unionAll(_hot_links(spark, hot.join(sets, "rep"), least, num, den))

    final = saved(spark, components(spark, _edges(found).unionAll(second)), "components")
    classes = reps.select("key", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "h", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key")).join(classes, "key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def survivors(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the documents that are not kept: of each group, the one with the smallest doc_id stays.

    Of rows that share both doc_id and text one stays, that whose columns as JSON come first. Rows with a null doc_id, or
    without words, stay all but for such repeats of a doc_id that is not null. Columns of any name pass as they are.
    """
    with scratch(spark):
        found = link(spark, docs, words, num, den).select("doc_id", "h", "kept").where("doc_id is not null")
        gone = saved(spark, found.where(~F.col("kept")).select("doc_id", "h").distinct(), "gone", lasting=True)
        twice = found.where("kept").groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "h")
        twice = saved(spark, twice, "twice", lasting=True)
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # the user's columns in a struct: no name of theirs meets one of these
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(bounded(gone), ["doc_id", "h"], "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    twice = bounded(twice)
    once = rows.join(twice, ["doc_id", "h"], "left_anti").select("row")
    again = rows.join(twice, ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionAll(again.select("row")).select("row.*")
