import random
import re

from forkweave.llm import components, neardup
from pyspark.sql import functions as F


def brute(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, s) in enumerate(zip(rows, sets, strict=True)):
        for j in range(i):
            if s and sets[j] and a[0] is not None and rows[j][0] is not None and den * len(s & sets[j]) >= num * len(s | sets[j]):
                parent[top(i)] = top(j)
    out = []
    for i, (r, s) in enumerate(zip(rows, sets, strict=True)):
        c = r[0] if r[0] is None else min(rows[k][0] for k in range(len(rows)) if rows[k][0] is not None and top(k) == top(i))
        out.append((r[0], len(s), c, r[0] == c))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.4:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        elif kind < 0.7:
            w = passage + rng.choices(words, k=rng.randint(0, 30))
        else:
            w = rng.choices(words, k=rng.choice([0, 1, 2, 3, 8, 60, 200]))
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, " \n"), (None, rows[5][1]), (n + 2, "A b"), (n + 3, "a B\n"), (n + 4, "x " * 3000)]


def test_links_match_brute_force(spark, monkeypatch):
    for seed, words, num, hot, misses, short in ((1, 3, 85, 256, 6, 48), (2, 5, 80, 12, 6, 48), (3, 3, 85, 5, 10, 3), (4, 3, 85, 5, 6, 48), (5, 3, 80, 4, 2, 3)):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "MISSES", misses)
        monkeypatch.setattr(neardup, "SHORT", short)
        monkeypatch.setattr(neardup, "VISITORS", 2 * hot)
        rows = corpus(seed, 220)
        df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
        got = sorted((tuple(r) for r in neardup.link(spark, df, words, num, 100).drop("h").collect()), key=str)
        want = [(d, n, c, True if d is None else k) for d, n, c, k in brute(rows, words, num, 100)]
        assert got == sorted(want, key=str)
    assert neardup.link(spark, df.limit(0)).count() == 0


def test_a_passage_that_is_most_of_a_text(spark, monkeypatch):
    """Texts that are one common passage, alone or with tails: links through hot lists alone, with far classes among them."""
    monkeypatch.setattr(neardup, "HOT", 6)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join(passage + [f"t{i}_{j}" for j in range(rng.choice([0, 10, 30, 45, 60, 200]))])) for i in range(90)]
    rows += [(100 + i, " ".join(passage[: 300 - 7 * i])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for misses in (6, 1):
        monkeypatch.setattr(neardup, "MISSES", misses)
        got = sorted((tuple(r) for r in neardup.link(spark, df, 3, 85, 100).drop("h").collect()), key=str)
        assert got == brute(rows, 3, 85, 100)


def test_ids_beyond_doubles_survive_a_null(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big + 2, "a b c d"), (big, "a b c d"), (None, "a b c d")], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.link(spark, df, 3, 85, 100).collect()}
    assert got == {(big, big, True), (big + 2, big, False), (None, None, True)}


def test_many_equal_rows(spark):
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("one and the same text of ten words in all rows").alias("text"))
    out = neardup.link(spark, df, 3, 85, 100)
    assert out.where("kept").count() == 1 and out.agg(F.max("component_id")).first()[0] == 0
    assert neardup.survivors(spark, df.unionAll(df)).count() == 1


def test_components(spark):
    rng = random.Random(4)
    edges = {(i, i + 1) for i in range(100, 160)} | {(0, i) for i in range(1, 40)} | {tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(40)}
    got = {r.id: r.component for r in components.components(spark, spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def made(spark, since):
    """Most rows that one operator of a plan made in the SQL executions after the first `since`; and how many there are now."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    each = lambda xs: [xs.apply(i) for i in range(xs.size())]
    for run in each(runs)[since:]:
        values = store.executionMetrics(run.executionId())
        for node in each(store.planGraph(run.executionId()).allNodes()):
            for metric in each(node.metrics()):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most, runs.size()


def test_rows_grow_with_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 8)
    rng, rows = random.Random(5), {}
    for m in (60, 240):
        base = [f"w{k}" for k in range(60)]
        rows[m] = []
        for i in range(m):
            t = list(base)
            for k in rng.sample(range(60), rng.choice([1, 1, 6, 6, 6, 6, 9])):
                t[k] = f"x{i}_{k}"
            if i % 11 == 10:  # a near copy of one that is not near the group
                t = [*rows[m][i - 4][1].split()[:-1], f"y{i}"]
            rows[m].append((i, " ".join(t)))
    most = {}
    for m in rows:
        since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        df = spark.createDataFrame(rows[m], "doc_id long, text string")
        got = sorted((tuple(r) for r in neardup.link(spark, df, 3, 85, 100).drop("h").collect()), key=str)
        most[m], _ = made(spark, since)
        assert got == brute(rows[m], 3, 85, 100)
    assert most[240] <= 6 * most[60], most
