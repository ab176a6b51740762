import hashlib

import pytest

from forkweave.llm import warc


def expected(rows, least):
    groups = {}
    for p, _, h in rows:
        b = (h or "").encode()
        groups.setdefault(b, []).append(p)
    out = []
    for b, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        for k, p in enumerate(ids):
            again = len(b) >= least and k > 0
            out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_in", [2, 256])
def test_round_trip(spark, tmp_path, fan_in):
    rows = [(i, f"http://www.h{i % 7}.example/p{i}?Q", ("x" * (i % 5 * 40)) or None) for i in range(60)]
    rows += [(60, None, "é" * 60), (61, "a b\r\nc", "é" * 60), (62, "", "é" * 60 + "\r\n"), (62, "u", "z" * 200), (62, "u", "z" * 200), (5, "v", "z" * 200), (70, "w", "y" * 150), (70, "w", "y" * 150), (None, "n", "q" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({}).repartition(5)
    out = f"file://{tmp_path}/w"
    runs = warc.write_archives(spark, df, out)
    lines = warc.merged(spark, runs, out, fan_in=fan_in, parts=4)
    got = lines.orderBy("part", "at").collect()
    assert [(r.k, r.t, r.p is None, r.p or 0) for r in got] == sorted((r.k, r.t, r.p is None, r.p or 0) for r in got) and len(got) == len(rows)
    back = [tuple(r)[:5] for r in warc.read_records(spark, lines, out).collect()]
    assert sorted(back, key=str) == expected(rows, 100)


def test_histories_are_ordered_by_time_and_one_url_is_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPARSE", 8)
    rows = [(i, "http://one.example/" if i % 10 else f"http://x{i}.example/", f"page {i} " * 20, None if i % 17 == 0 else f"2020-01-{1 + i * 7 % 28:02d} 10:00:00") for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, seen string").repartition(4)
    out = f"file://{tmp_path}/w"
    lines = warc.merged(spark, warc.write_archives(spark, df, out, time="seen"), out, parts=10)
    got = lines.orderBy("part", "at").collect()
    stamp = {i: warc.STAMP if t is None else t.replace(" ", "T") + "Z" for i, _, _, t in rows}
    want = sorted((warc.url_key(u), stamp[i], i) for i, u, _, _ in rows)
    assert [(r.k, r.t, r.p) for r in got] == want
    sizes = {}
    for r in got:
        sizes[r.part] = sizes.get(r.part, 0) + 1
    assert len(sizes) >= 8 and max(sizes.values()) < 300


def test_repeated_rows_have_one_response_and_ids_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(warc, "REPEATS", 7)
    for broadcast in (100_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
        big = 9007199254740993
        rows = [(big, "u", "a" * 200)] * 50 + [(big, "t", "a" * 200), (big + 2, "v", "a" * 200), (None, "w", "a" * 200), (big + 2, "v", "b" * 300), (None, "w", "c" * 10)]
        got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
        assert len(got) == len(rows)
        of_a = [r for r in got if r.payload_bytes == 200]
        assert [r.page_id for r in of_a if r.record_type == "response"] == [big]
        assert sorted((r.page_id is None, r.page_id or 0) for r in of_a) == sorted((p is None, p or 0) for p, _, h in rows if len(h) == 200)
        assert {r.refers_to for r in of_a if r.record_type == "revisit"} == {big}
        assert {(r.page_id, r.record_type) for r in got if r.payload_bytes != 200} == {(big + 2, "response"), (None, "response")}


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    runs = [[1, 4, 4, 9], [], [0, 4], [2], [9, 9]]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([], lambda x: x)) == []


def test_keys():
    assert warc.url_key("https://www.Example.com:8080/A?b=C") == "com,example:8080)/a?b=c"
    assert warc.url_key("example.com") == "com,example)/"
