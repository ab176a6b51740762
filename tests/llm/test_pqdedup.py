import math

import numpy as np

from forkweave.llm import pqdedup


def brute(rows, cosine):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    use = [good(v, label) and i is not None for i, v, label in rows]
    links = [[j for j in range(n) if j != i and use[i] and use[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and (rows[i][1] == rows[j][1] or np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= cosine)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[label[i]] = min(low.get(label[i], rows[i][0]), rows[i][0])
    return sorted(((r[0], len(links[i]), None if r[0] is None else low[label[i]], r[0] is None or r[0] == low[label[i]]) for i, r in enumerate(rows)), key=str)


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pqdedup, "BLOCK", 16)
    monkeypatch.setattr(pqdedup, "VISITORS", 24)
    monkeypatch.setattr(pqdedup, "UNIT", 32)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 12))
    rows = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.normal(size=12) * rng.choice([0, 0.05, 0.12, 1])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 50 else None))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 12, 1), (303, [float("nan")] * 12, 1), (304, [1.0, None], 1), (305, [float("inf"), 1.0], 1), (306, rows[7][1], rows[7][2]), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (309, [-0.0, 1.0], 2), (310, [0.0, 1.0], 2), (None, rows[7][1], rows[7][2]), (311, [1e300] * 12, 1), (312, [1e300] * 12, 1)]
    df = spark.createDataFrame([(i, v, x, "c") for i, v, x in rows], "vec_id long, embedding array<float>, label int, cell string")
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding), r.label) for r in df.collect()]
    for list_rows in (512, 10):
        got = sorted((tuple(r) for r in pqdedup.link(spark, df.repartition(3), 0.98, list_rows=list_rows).collect()), key=str)
        assert got == brute(rows, 0.98)
    assert pqdedup.link(spark, df.limit(0)).count() == 0


def test_probes_of_many_dimensions_find_the_links(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:500] + rng.normal(size=(500, 64)) * 0.024  # cosines about 0.98
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in pqdedup.link(spark, df, list_rows=8).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    found = sum(got.values())
    assert all(got[i] <= want[i] for i in got) and want.sum() > 300
    assert found >= 0.99 * want.sum()


def test_a_hot_group_of_near_vectors(spark):
    rng = np.random.default_rng(7)
    x = (np.ones(64) + rng.normal(size=(3000, 64)) * 0.01).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = pqdedup.link(spark, df).collect()
    assert len(got) == 3000 and {(r.n_links, r.component_id) for r in got} == {(2999, 0)}
