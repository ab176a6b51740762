"""Resolution queries: order-dependent folds, held against recursive SQL where that can say what a version does.

Resolution at every fork of a room (state_at_targets, delta_report, compacted_chain) and V2_1_1, which drops dominated
events first, have no SQL; on linear rooms the same operators have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formats, graph, lattice, reports
from ..operators import resolve as r
from ..operators.state import last_per_key
from ..sources import derived as d
from . import resolution_sql as sql
from .registry import query


def _resolve(version: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return r.resolved(d.records(spark, sf_dir), version)

    return run


for _name, _version in (("resolve_v1", "V1"), ("resolve_v2", "V2"), ("resolve_v21", "V2_1"), ("resolve_v211", "V2_1_1"), ("resolve_v22", "V2_2")):
    _run = _resolve(_version)
    _run.__name__ = _name
    query(None if _version == "V2_1_1" else sql.resolved(_version))(_run)


@query(sql.lattice("V2"))
def resolve_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.lattice(d.records(spark, sf_dir), "V2")


@query(sql.lattice("V2"))
def resolve_lattice_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-key fold with everything but the power phase as joins and aggregates."""
    return lattice.fold(d.records(spark, sf_dir), "V2")


_CHAIN = ", chain AS (SELECT res.room_id, count(DISTINCT ancestor_id) AS n FROM res JOIN cl ON cl.event_id = res.id GROUP BY 1)"


@query(sql.resolved_as("V2") + _CHAIN + f""" SELECT res.room_id, 'success' AS status, 'V2' AS version, count(*) AS resolved_state_size, any_value(n) AS auth_chain_size, string_agg({sql.NAME.format("id")}, ',' ORDER BY split_part(key, '|', 1), substr(key, strpos(key, '|') + 1)) AS state_event_ids
FROM res JOIN chain USING (room_id) GROUP BY res.room_id""")
def default_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default report, by the dispatcher."""
    return formats.report(d.records(spark, sf_dir), "V2").withColumn("state_event_ids", F.array_join("state_event_ids", ","))


_ORACLE = ", orc AS (SELECT room_id, type || '|' || state_key AS key, arg_min(event_id, event_id - depth * 1000000000) AS theirs FROM ev WHERE state_key IS NOT NULL AND type <> 'm.room.topic' GROUP BY ALL)"


@query(sql.resolved_as("V2") + _ORACLE + """ SELECT room_id, outcome, count(*) AS entries FROM (SELECT coalesce(res.room_id, orc.room_id) AS room_id, CASE WHEN theirs IS NULL THEN 'added' WHEN id = theirs THEN 'same' WHEN theirs IN (SELECT event_id FROM ev WHERE membership = 'ban') THEN 'absent' WHEN id IS NULL THEN 'lost' ELSE 'differs' END AS outcome
  FROM res FULL JOIN orc ON res.room_id = orc.room_id AND res.key = orc.key) GROUP BY ALL""")
def oracle_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved states against the events of the greatest depth, which lack topics; bans count as not exported."""
    rows = d.records(spark, sf_dir)
    state = rows.where("state_key IS NOT NULL AND type <> 'm.room.topic'")
    oracle = state.groupBy("room_id", "type", "state_key").agg(F.max_by("event_id", F.struct(F.col("depth"), -F.substring("event_id", 2, 20).cast("long"))).alias("event_id"))
    events = rows.where("NOT (type = 'm.room.member' AND content LIKE '%\"ban\"%')")
    return reports.compared(r.resolved(rows, "V2"), oracle, events)


@query(sql.resolved_as("V2") + """, total AS (SELECT count(DISTINCT id) AS n FROM res), src AS (SELECT CAST(head % 50 - 48 AS INTEGER) AS src, event_id FROM st)
SELECT src, count(DISTINCT res.id) AS hits, CAST(round(count(DISTINCT res.id) * 1e6 / any_value(n)) AS BIGINT) AS accuracy_ppm FROM src LEFT JOIN res ON res.id = src.event_id, total GROUP BY src""")
def state_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the resolved state each head has by itself."""
    rows = d.records(spark, sf_dir)
    prev = lattice.edges(rows, "prev_events")
    met = graph.chains(prev, graph.heads(rows, prev), reflexive=True).withColumnRenamed("start", "head")
    last = last_per_key(met.join(rows.select("room_id", "event_id", "type", "state_key", "depth"), ["room_id", "event_id"]), "room_id", "head")
    states = last.withColumn("src", (F.substring("head", 2, 20).cast("long") % d.ROOM - 48).cast("int"))
    return reports.accuracy(states, r.resolved(rows, "V2"))


@query(sql.traced("V2"))
def resolution_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.trace(d.records(spark, sf_dir), "V2")


@query()
def state_at_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states after every event of each room."""
    rows = d.records(spark, sf_dir)
    return r.states_at(rows, rows, "V2")


@query(sql.kahn("V2_2"))
def kahn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.priority_order(d.records(spark, sf_dir), "V2_2")


_LAST = ", st AS (SELECT room_id, type, state_key, " + sql.NAME.format("arg_max(event_id, depth * 1000000000 + event_id)") + " AS event_id FROM ev WHERE state_key IS NOT NULL GROUP BY ALL)"


@query(_LAST + sql.hashed("st", "room_id", 128) + " SELECT room_id, h AS state_hash FROM hashes")
def state_hash128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.hashes(last_per_key(d.records(spark, sf_dir)))


@query()
def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.delta_report(d.records(spark, sf_dir), "V2")


@query()
def compacted_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.compacted(d.records(spark, sf_dir), "V2", 10).drop("entries")


def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events, each behind the one before: rooms without forks."""
    rows = d.records(spark, sf_dir)
    number = F.substring("event_id", 2, 20).cast("long")
    before = F.concat(F.lit("$"), F.lpad((number - 1).cast("string"), 8, "0"))
    first = number % d.ROOM == 0
    return rows.withColumns({"prev_events": F.when(first, F.array().cast("array<string>")).otherwise(F.array(before)), "depth": (number % d.ROOM + 1).cast(rows.schema["depth"].dataType)})


_AT = f", held AS (SELECT t.room_id, t.event_id AS target, e.type, e.state_key, arg_max(e.event_id, e.seq) AS event_id FROM ev t JOIN ev e ON e.room_id = t.room_id AND e.seq <= t.seq AND e.state_key IS NOT NULL GROUP BY ALL), named AS (SELECT room_id, target, type, state_key, {sql.NAME.format('event_id')} AS event_id FROM held)"


@query(_AT + f" SELECT room_id, {sql.NAME.format('target')} AS target, type, state_key, event_id FROM named")
def state_at_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states after every event of rooms without forks."""
    rows = _linear(spark, sf_dir)
    return r.states_at(rows, rows, "V2")


@query(_AT + sql.hashed("named", "room_id, target", 128) + f""" SELECT h.room_id, CAST(e.seq AS INTEGER) AS seq, h.h AS state_hash, lag(h.h) OVER (PARTITION BY h.room_id ORDER BY e.seq) AS parent_hash, {sql.NAME.format('e.event_id')} AS event_id,
  e.seq % 10 = 0 AS is_snapshot, CAST(CASE WHEN e.seq % 10 = 0 THEN (SELECT count(*) FROM held WHERE held.target = e.event_id) ELSE CASE WHEN e.state_key IS NULL THEN 0 ELSE 1 END END AS INTEGER) AS n_entries, true AS rebuilds FROM hashes h JOIN ev e ON e.event_id = h.target""")
def compacted_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted chains of rooms without forks, with 128-bit hashes of every state."""
    return r.compacted(_linear(spark, sf_dir), "V2", 10).drop("entries")


@query(_AT + sql.hashed("named", "room_id, target", 64) + f""" SELECT h.room_id, CAST(e.seq AS INTEGER) AS seq, {sql.NAME.format('e.event_id')} AS event_id, h.h AS hash, lag(h.h) OVER (PARTITION BY h.room_id ORDER BY e.seq) AS parent,
  CAST(CASE WHEN e.state_key IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_deltas, CASE WHEN e.state_key IS NULL THEN '[]' ELSE '[{{"type":"' || e.type || '","state_key":"' || e.state_key || '","event_id":"' || {sql.NAME.format('e.event_id')} || '"}}]' END AS deltas FROM hashes h JOIN ev e ON e.event_id = h.target""")
def delta_report_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta report of rooms without forks, with 64-bit hashes of every state."""
    return r.delta_report(_linear(spark, sf_dir), "V2")


@query(_AT + " SELECT n.room_id, e.seq, n.type, n.state_key, n.event_id FROM named n JOIN ev e ON e.event_id = n.target")
def rebuilt_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states at every link of the compacted chains, found by their hashes."""
    chain = r.compacted(_linear(spark, sf_dir), "V2", 10)
    return r.rebuilt(chain, chain)
