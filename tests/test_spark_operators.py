"""Set-based operators against the kernel, sources, table functions and the stream."""

import json
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from forkweave.functions import content, settings, tables
from forkweave.operators import auth, formats, graph, kernel as k, lattice, order, reports, resolve as r, state, state as s
from forkweave.sources import events as src, generate

JOINED = {"!r0", "!r1"}


@pytest.fixture(scope="module")
def records(spark):
    return generate.churning(spark, rooms=6, events=60).cache()


def rooms_of(records):
    out = {}
    for row in records.select(*r.COLUMNS).collect():
        out.setdefault(row.room_id, []).append(tuple(row))
    return {room: r.events_of(rows) for room, rows in out.items()}


@pytest.mark.parametrize("version", k.VERSIONS)
def test_resolution_is_the_kernels_and_does_not_depend_on_partitions(spark, records, version):
    want = set()
    for room, events in rooms_of(records).items():
        if version in ("V1", "V2", "V2_2"):
            k.stamp_levels(events, version)
        want |= {(room, *key, x) for key, x in k.resolve_heads(k.heads_of(events), events, version).items()}
    for parts in (1, 7):
        assert {tuple(x) for x in r.resolved(records.repartition(parts, "event_id"), version).collect()} == want


@pytest.mark.parametrize("version", ["V2", "V2_1"])
def test_joins_give_the_kernels_verdicts(records, version):
    rows = content.typed(records).withColumn("n_prev", F.size("prev_events")).withColumn("n_auth", F.size("auth_events"))
    last = s.last_per_key(rows)
    got = {x.event_id: (x.code, x.required, x.actual) for x in auth.verdicts(rows, rows.join(last.select("room_id", "event_id"), ["room_id", "event_id"], "left_semi"), version).collect()}
    state = {}
    for x in last.collect():
        state.setdefault(x.room_id, {})[x.type, x.state_key] = x.event_id
    n = 0
    for room, events in rooms_of(records).items():
        find = lambda t, key, room=room, events=events: events.get(state[room].get((t, key)))
        for e in events.values():
            no = k.check(e, find, version)
            assert got[e.id] == ((None, None, None) if no is None else (no.code, no.required, no.actual)), (e, no)
            n += no is not None
    assert n > 20


def test_states_and_reach(spark, records):
    targets = records.where("depth % 20 = 0")
    got = {}
    for x in r.states_at(records, targets, "V2").collect():
        got.setdefault(x.target, {})[x.type, x.state_key] = x.event_id
    for events in rooms_of(records).values():
        for x, want in k.states_at([e.id for e in events.values() if e.depth % 20 == 0], events, "V2"):
            assert got[x] == want
    edges = records.select("room_id", F.col("event_id").alias("child"), F.explode("auth_events").alias("parent"))
    seeds = records.where("depth = 60").select("room_id", "event_id")
    loop = {(x.room_id, x.event_id) for x in graph.reach(spark, edges, seeds).collect()}
    assert loop == {(x.room_id, x.event_id) for x in graph.reachable(edges, seeds).collect()}


def test_walks_match_the_closure(spark, records):
    edges = records.select("room_id", F.col("event_id").alias("child"), F.explode("auth_events").alias("parent"))
    closed = {(x.room_id, x.event_id, x.ancestor_id): x.hops for x in graph.closure(edges).collect()}
    seeds = records.where("depth % 17 = 3").select("room_id", "event_id")
    starts = {tuple(x) for x in seeds.collect()}
    for most in (None, 1, 2):
        near = {(r, y): min(n for (q, x, z), n in closed.items() if (q, z) == (r, y) and (q, x) in starts) for (r, x, y) in closed if (r, x) in starts}
        below = starts | {k for k, n in near.items() if most is None or n <= most}
        above = starts | {(r, x) for (r, x, y) in closed if (r, y) in starts}
        assert {(x.room_id, x.event_id) for x in graph.reachable(edges, seeds, most).collect()} == below
        assert {tuple(x) for x in graph.subgraph(edges, seeds, most).collect()} == below & above
    assert {(x.room_id, x.event_id): x.hops for x in graph.reachable(edges, seeds, strict=True).collect()} == near
    assert {tuple(x) for x in graph.chains(edges, seeds).collect()} == {(r, x, y) for (r, x, y) in closed if (r, x) in starts}


def test_a_long_room_is_walked_in_linear_time(spark):
    """One linear room of 10,000 events: walks, chains, positions, depths and domination take seconds."""
    n = 10_000
    e = spark.range(n).select(F.lit(1).alias("room_id"), F.col("id").alias("event_id"), (F.col("id") + 1).alias("depth"))
    prev = e.where("event_id > 0").select("room_id", F.col("event_id").alias("child"), (F.col("event_id") - 1).alias("parent"))
    head = e.where(f"event_id = {n - 1}")
    began = time.time()
    assert graph.reachable(prev, head).agg(F.max("hops")).first()[0] == n - 1
    assert graph.chains(prev, head).count() == n - 1
    assert graph.subgraph(prev, e.where(f"event_id in (0, {n - 1})")).count() == n
    assert graph.depths(e, prev).agg(F.max("depth")).first()[0] == n
    assert graph.merge_base(prev, e.where(f"event_id >= {n - 2}"), e).first().event_id == n - 2
    levels = e.withColumns({"type": F.when(F.col("event_id") % 10 == 0, "m.room.power_levels").otherwise("m.room.topic"), "state_key": F.lit(""), "ts": F.col("event_id")})
    top = levels.where("event_id = 9990")
    at = {x.event_id: x.position for x in order.mainline_positions(levels, prev.withColumn("ord", F.lit(0)), top).collect()}
    assert all(at[i] == 999 - i // 10 for i in range(n))
    chain = state.linear_chain(levels, 100)
    whole = state.reconstruct(chain, state.snapshots(chain), chain.select("room_id", F.col("seq").alias("target")))
    assert whole.count() == n + n - 1
    assert time.time() - began < 60


def test_ids_beyond_doubles_beside_nulls(spark):
    big = 9007199254740993
    e = spark.createDataFrame([(1, big, 1), (1, big + 2, 2), (2, 5, 1)], "room_id long, event_id long, depth long")
    edges = spark.createDataFrame([(1, big + 2, big)], "room_id long, child long, parent long")
    assert {tuple(x) for x in graph.components(e, edges).collect()} == {(1, big, big), (1, big + 2, big), (2, 5, 5)}
    levels = e.withColumns({"type": F.lit("m.room.power_levels"), "state_key": F.lit("")})
    line = order.mainline(levels, edges.withColumn("ord", F.lit(0)), levels.where(f"event_id = {big + 2}"))
    assert {tuple(x) for x in line.collect()} == {(1, big + 2, 0), (1, big, 1)}


def test_domination_matches_plain_python(spark):
    rng = random.Random(5)
    rows, edges = [], []
    for room in range(6):
        for i in range(40):
            x = room * 100 + i
            for p in rng.sample(range(i), min(i, rng.randint(0, 2))):
                edges.append((room, x, room * 100 + p))
            kind = rng.choice(["m.room.member", "m.room.power_levels", "m.room.join_rules", "m.room.topic"])
            user, target = rng.choice("abc"), rng.choice("abc")
            membership = rng.choice(["join", "ban", "leave"]) if kind == "m.room.member" else None
            rows.append((room, x, kind, target if kind == "m.room.member" else "", user, i, rng.choice([0, 50]), membership, rng.choice(["invite", "public"]) if kind == "m.room.join_rules" else None, [rng.choice("abc")] if kind == "m.room.power_levels" else []))
    df = spark.createDataFrame(rows, "room_id long, event_id long, type string, state_key string, sender string, ts long, power_level long, membership string, join_rule string, demoted array<string>")
    got = {tuple(x) for x in order.domination_candidates(df, spark.createDataFrame(edges, "room_id long, child long, parent long")).collect()}
    below = {r[1]: set() for r in rows}
    for r in rows:
        for room, x, p in edges:
            if x == r[1]:
                below[x] |= {p} | below[p]
    rank = lambda r: (-r[6], {"m.room.power_levels": 0, "m.room.join_rules": 1}.get(r[2], 2), r[5], r[1])
    want = set()
    for a in rows:
        for t in rows:
            if a[0] != t[0] or rank(a) >= rank(t) or t[1] in below[a[1]] or a[1] in below[t[1]]:
                continue
            removes = a[2] == "m.room.member" and a[7] in ("ban", "leave") and a[3] != a[4] and a[3] == t[4]
            if removes or (a[2] == "m.room.power_levels" and t[4] in a[9]) or (a[8] == "invite" and t[7] == "join"):
                want.add((a[0], a[1], t[1]))
    assert got == want and len(got) > 50


def test_content_types(spark):
    c = {"users": {"@a:x": "7", "@b:x": 1 << 63, "@c:x": 5.0, "@d:x": [], "@e:x": 3}, "ban": "+12", "kick": 50.0, "membership": 5, "additional_creators": ["@a:x", 3]}
    row = content.typed(spark.createDataFrame([(json.dumps(c),)], "content string")).first()
    assert row.users == {"@a:x": 7, "@b:x": content.TOP, "@e:x": 3} and row.ban == 12 and row.kick is None and row.membership is None and row.additional_creators == ["@a:x"]


def test_sources(spark, tmp_path):
    lines = [{"event_id": "$a", "type": "m.room.create", "state_key": "", "prev_events": [["$x", {}], {"event_id": "$y"}, "$z", 5], "content": {"b": 1}}, {"_source": {"event_id": "$b", "type": "t", "power_level": "12", "depth": -3}}]
    (tmp_path / "x.jsonl").write_text("// note\n\n" + "\n".join(map(json.dumps, lines)) + "\n")
    got = {x.event_id: x for x in src.load(spark, f"{tmp_path}/x.jsonl", "!r").collect()}
    assert got["$a"].prev_events == ["$x", "$y", "$z"] and got["$a"].state_key == "" and got["$a"].content == '{"b":1}' and got["$b"].power_level == 12 and got["$b"].depth == 0 and got["$b"].state_key is None
    (tmp_path / "doc.json").write_text(json.dumps({"events": [lines[0], {"event_id": "$c", "type": "t"}], "heads": ["$c"]}))
    assert src.load(spark, f"{tmp_path}/doc.json").count() == 2 and src.read_documents(spark, f"{tmp_path}/doc.json")[1].first().event_id == "$c"
    merged = src.load_all(spark, [f"{tmp_path}/x.jsonl", f"{tmp_path}/doc.json"])
    assert {x.event_id for x in merged.collect()} == {"$a", "$b", "$c"}
    (tmp_path / "y.jsonl").write_text(json.dumps({"event_id": "$q", "type": "t"}))
    with pytest.raises(ValueError, match="Disjoint"):
        src.load_all(spark, [f"{tmp_path}/x.jsonl", f"{tmp_path}/y.jsonl"])
    bad = ["nonsense", "[1]", '{"event_id":"$x"}', '{"type":"t"}', '{"event_id":"$x","type":"t","power_level":1.5}', '{"event_id":"$x","type":"t","power_level":true}']
    good, out = src.parse(spark.createDataFrame([(b,) for b in bad], "raw string"))
    assert good.count() == 0 and out.count() == len(bad)
    hashed, _ = src.parse(spark.createDataFrame([('{"type":"t","unsigned":{"x":1},"a":1}',), ('{"a":1, "type":"t"}',)], "raw string"), hashing=True)
    ids = {x.event_id for x in hashed.collect()}
    assert len(ids) == 1 and len(ids.pop()) == 44
    src.write_lines(src.load(spark, f"{tmp_path}/x.jsonl", "!r"), f"{tmp_path}/out.jsonl")
    assert src.load(spark, f"{tmp_path}/out.jsonl", "!r").count() == 2
    src.write_cache(merged, f"{tmp_path}/cache.parquet")
    assert src.load(spark, f"{tmp_path}/cache.parquet").count() == 3
    later = src.chase(merged.drop("ord").withColumn("room_id", F.lit("!r")).withColumn("auth_events", F.array(F.lit("$new"))), lambda ids: ids.join(merged.limit(1).drop("room_id", "event_id", "ord"), how="cross").select(*[c for c in merged.columns if c != "ord"]))
    assert later.where("event_id = '$new'").count() == 1


def test_export_and_generators(spark):
    rows = generate.linear(spark, 100)
    edges = rows.select("room_id", F.explode("prev_events").alias("parent"))
    heads = graph.heads(rows, edges)
    assert sorted(x.event_id for x in heads.collect()) == ["$0000000098", "$0000000099"]
    out = src.exported(rows, heads).first()
    assert out.total == 100 and out.senders == 1 and out.by_type["m.room.create"] == 1 and len(out.heads) == 2


def test_table_functions(spark, records):
    tables.register(spark)
    records.select(*r.COLUMNS).createOrReplaceTempView("records")
    got = {tuple(x) for x in spark.sql("SELECT * FROM resolve_room(TABLE(records) PARTITION BY (room_id), 'V2_1')").collect()}
    assert got == {tuple(x) for x in r.resolved(records, "V2_1").collect()}
    one = records.where("depth = 30").first()
    got = {(x.type, x.state_key, x.event_id) for x in spark.sql(f"SELECT * FROM state_at(TABLE(records) PARTITION BY (room_id), 'V2', '{one.event_id}')").collect()}
    events = rooms_of(records)[one.room_id]
    assert got == {(*key, x) for key, x in dict(k.states_at([one.event_id], events, "V2"))[one.event_id].items()}


def test_stream(spark, records, tmp_path):
    from forkweave.streaming import rooms

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rooms.STORE)

    rows = records.select(*r.COLUMNS).where(F.col("room_id").isin(*JOINED)).cache()
    rows.where("depth > 40").coalesce(1).write.parquet(f"{tmp_path}/in/a")  # late events first
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = rooms.resolved(stream, "V2_1").writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows.where("depth <= 40").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    q = rooms.resolved(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*"), "V2_1").writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.where("n_events = 60").select("room_id", "type", "state_key", "event_id")
    assert {tuple(x) for x in last.collect()} == {tuple(x) for x in r.resolved(rows, "V2_1", stamp=False).collect()}


def test_checkpoints_verifiers_and_sinks(spark, records, tmp_path):
    rooms = rooms_of(records)
    snapshot, wanted, want = [], [], {}
    for room, events in rooms.items():
        agreed, disputed = k.partition([k.last_state(h, events) for h in k.heads_of(events)])
        snapshot += [(room, *key, x) for key, x in agreed.items()] + [(room, "x.trusted", "", "$unknown")]
        wanted += [(room, x) for x in disputed]
        base = {**agreed, ("x.trusted", ""): "$unknown"}
        want[room] = k.resolve(base, {x: events[x] for x in disputed}, events, "V2")
    snap = spark.createDataFrame(snapshot, "room_id string, type string, state_key string, event_id string")
    ids = spark.createDataFrame(wanted, "room_id string, event_id string")
    got: dict = {}
    for x in r.from_checkpoint(records, snap, ids, "V2").collect():
        got.setdefault(x.room_id, {})[x.type, x.state_key] = x.event_id
    assert got == want
    cut = records.where("type <> 'm.room.create'")
    with pytest.raises(Exception, match="is incomplete"):
        r.from_checkpoint(cut, snap, ids, "V2").collect()
    order = records.select("room_id", "event_id", F.row_number().over(Window.partitionBy("room_id").orderBy("depth", "event_id")).cast("long").alias("pos"))
    empty = snap.limit(0)
    plain = {(x.room_id, x.event_id): x.accepted for x in r.checked_chain(records, order, empty, "V2").collect()}
    for room, events in rooms.items():
        yes, _ = k.check_in_order(sorted(events.values(), key=lambda e: (e.depth, e.id)), {}, "V2")
        assert {x for (q, x), ok in plain.items() if q == room and ok} == set(yes)
    strict = r.checked_chain(records, order, empty, "V2", verify=lambda step, e: "bad signature" if step == "signatures" and e.type == "m.room.topic" else None)
    why = {(x.type if hasattr(x, "type") else x.message) for x in strict.join(records.select("room_id", "event_id", "type"), ["room_id", "event_id"]).where("type = 'm.room.topic'").select("message").distinct().collect()}
    assert why == {"InvalidSyntax: bad signature"}
    no_topics = r.resolved(records, "V2_1", verify=lambda step, e: "no" if e.type == "m.room.topic" else None)
    assert no_topics.count() < r.resolved(records, "V2_1").count()
    target = str(tmp_path)
    states = r.states_at(records, records.where("depth = 30"), "V2")

    def write(room, at, state):
        with open(f"{target}/{room}-{at}".replace("!", "").replace("$", ""), "w") as f:
            f.write(str(len(state)))

    r.for_each_state(states, write)
    assert len(list(tmp_path.iterdir())) == states.select("room_id", "target").distinct().count() > 0


def test_formats_settings_and_reports(spark, records, tmp_path):
    rows = {kind: formats.report(records, "V2", kind, origin="here").count() for kind in formats.FORMATS}
    assert rows["default"] == 6 and rows["events"] <= rows["federation"] and rows["deltas"] == records.count() and rows["timeline"] > 0
    with pytest.raises(ValueError, match="unknown format"):
        formats.report(records, "V2", "pdf")
    one = formats.report(records, "V2").where("room_id = '!r0'")
    src.write_report(one, f"{tmp_path}/plain")
    src.write_report(one, f"{tmp_path}/pretty", pretty=True)
    text = "".join(p.read_text() for p in (tmp_path / "pretty").glob("part*"))
    assert json.loads(text)["status"] == "success" and text.count("\n") > 5
    assert settings.settings(spark).version == "V2"
    spark.conf.set("forkweave.version", "V9")
    with pytest.raises(ValueError, match="V9"):
        settings.settings(spark)
    spark.conf.unset("forkweave.version")
    ours = r.resolved(records, "V2")
    assert reports.unlike(ours, ours, ours.columns).isEmpty() and reports.unlike(ours, ours.limit(3), ours.columns).count() == ours.count() - 3


def test_a_room_is_one_group_whatever_its_rows_came_from(spark):
    """Two tables that lie by room already, of unequal size: their shuffles are merged unequally."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    old = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        edges = spark.range(40_000).selectExpr("id div 40 AS room_id", "id AS child", "id - 1 AS parent").where("child % 40 > 0").groupBy("room_id").agg(F.collect_list(F.struct("child", "parent")).alias("e")).select("room_id", F.inline("e"))
        seeds = spark.range(40_000).where("id % 40 IN (20, 30)").selectExpr("id div 40 AS room_id", "id AS event_id").groupBy("room_id").agg(F.collect_list("event_id").alias("e")).select("room_id", F.explode("e").alias("event_id"))
        assert graph.subgraph(edges, seeds).count() == 1000 * 11
        assert graph.subgraph(edges, seeds, most=2).count() == 1000 * 4
        assert graph.bounded_difference(edges, seeds.where("event_id % 40 = 30"), seeds.where("event_id % 40 = 20")).count() == 1000 * 10
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


@pytest.mark.parametrize("version", ["V2", "V2_1"])
def test_checked_chain_moves_the_records_once(records, version):
    """Onto each room's last state: as the kernel has it, with events that are unknown, unplaced or both placed and held."""
    state = s.last_per_key(records).select("room_id", "type", "state_key", "event_id")
    order = records.where("depth % 3 = 0").selectExpr("room_id", "event_id", "depth AS pos").unionByName(records.selectExpr("room_id", "'$none' AS event_id", "1L AS pos").distinct())
    got = r.checked_chain(records, order, state, version)
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    seen = r.checked_chain(records, order, state, version, verify=lambda step, e: "odd" if step == "signatures" and e.depth % 2 and e.prev else None)
    rows, strict, n = {(x.room_id, x.event_id): x for x in got.collect()}, {(x.room_id, x.event_id): x for x in seen.collect()}, 0
    for room, events in rooms_of(records).items():
        base = {(x.type, x.state_key): events[x.event_id] for x in state.where(F.col("room_id") == room).collect()}
        chain = sorted((e.depth, e.id) for e in events.values() if e.depth % 3 == 0)
        _, refused = k.check_in_order((events[x] for _, x in chain), base, version)
        for pos, x in chain:
            no = dict(refused).get(x)
            y = rows.pop((room, x))
            assert (y.pos, y.accepted, y.code, y.message) == (pos, no is None, no and no.code, no and str(no))
            assert (strict.pop((room, x)).message == "InvalidSyntax: odd") == bool(events[x].depth % 2 and events[x].prev)
            n += 1
    assert n > 50 and not rows and not strict


def test_lattice_joins_work_out_their_records_once(spark, records):
    """Whatever the records come from is in the plan of one cached table alone; the result is the kernel's."""
    asked = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    counted = records.select(*r.COLUMNS).mapInArrow(tell, records.select(*r.COLUMNS).schema)
    got = {tuple(x) for x in lattice.fold(counted, "V2").collect()}
    assert asked.value == records.count()
    assert got == {tuple(x) for x in r.lattice(records, "V2").collect()}


def test_reconstruction_shuffles_no_result(records):
    """Targets meet entries that hold at them; what is rebuilt is neither shuffled nor aggregated, and is each place's state."""
    chain = s.linear_chain(records, 7)
    got = s.reconstruct(chain, s.snapshots(chain), chain.select("room_id", F.col("seq").alias("target")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    states, want = {}, set()
    for x in sorted(chain.collect(), key=lambda x: (x.room_id, x.seq)):
        if x.state_key is not None:
            states.setdefault(x.room_id, {})[x.type, x.state_key] = x.event_id
        want |= {(x.room_id, x.seq, *at, y) for at, y in states.get(x.room_id, {}).items()}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
