"""State, delta and source-merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as s
from ..sources import derived as d
from .graphs import PARTITION, STATES, Graph
from .registry import query


@query(STATES + " SELECT * FROM st")
def state_per_head_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).head_states().select("room_id", "head", "type", "state_key", "event_id")


@query(" SELECT room_id, type, state_key, arg_max(event_id, depth * 1000000000 + event_id) AS event_id FROM ev WHERE state_key IS NOT NULL GROUP BY ALL")
def state_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.last_per_key(d.events(spark, sf_dir))


@query(PARTITION + " SELECT * FROM part")
def conflict_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).partition()


def _two(x: Graph) -> tuple[DataFrame, DataFrame]:
    """The states of each room's first and second head."""
    states = x.head_states()
    return states.where("head % 50 = 48"), states.where("head % 50 = 49")


_DELTA = STATES + """, a AS (SELECT * FROM st WHERE head % 50 = 48), b AS (SELECT * FROM st WHERE head % 50 = 49),
dl AS (SELECT coalesce(a.room_id, b.room_id) AS room_id, coalesce(a.type, b.type) AS type, coalesce(a.state_key, b.state_key) AS state_key, b.event_id
  FROM a FULL JOIN b ON a.room_id = b.room_id AND a.type = b.type AND a.state_key = b.state_key WHERE a.event_id IS DISTINCT FROM b.event_id)"""


@query(_DELTA + " SELECT * FROM dl")
def state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.delta(*_two(Graph(spark, sf_dir)))


@query(STATES + " SELECT room_id, type, state_key, event_id FROM st WHERE head % 50 = 49")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first head's state with the difference applied: the second head's state."""
    a, b = _two(Graph(spark, sf_dir))
    return s.apply_delta(a, s.delta(a, b))


@query(STATES + """ SELECT room_id, type, state_key, event_id FROM st WHERE head % 50 = 49
UNION ALL SELECT room_id, type, state_key, event_id FROM st a WHERE head % 50 = 48 AND NOT EXISTS (SELECT 1 FROM st b WHERE b.head % 50 = 49 AND b.room_id = a.room_id AND b.type = a.type AND b.state_key = a.state_key)""")
def state_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(Graph(spark, sf_dir))
    cols = ["room_id", "type", "state_key", "event_id"]
    return s.overlay(a.select(*cols), b.select(*cols))


_CHAIN = """, ch AS (SELECT room_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, event_id, type, state_key, lag(event_id) OVER w AS parent_id FROM ev WINDOW w AS (PARTITION BY room_id ORDER BY depth, event_id))"""


@query(_CHAIN + " SELECT *, seq % 10 = 0 AS is_snapshot FROM ch")
def delta_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.linear_chain(d.events(spark, sf_dir), 10).withColumn("seq", F.col("seq").cast("long"))


@query(_CHAIN + """ SELECT ch.room_id, t.target, type, state_key, arg_max(event_id, seq) AS event_id
FROM ch JOIN (SELECT room_id, seq AS target FROM ch) t ON t.room_id = ch.room_id AND seq <= t.target WHERE state_key IS NOT NULL GROUP BY ALL""")
def reconstruct_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states at every place of each room, from snapshots and deltas."""
    chain = s.linear_chain(d.events(spark, sf_dir), 10)
    targets = chain.select("room_id", F.col("seq").alias("target"))
    return s.reconstruct(chain, s.snapshots(chain), targets).withColumn("target", F.col("target").cast("long"))


@query(_CHAIN + """, t AS (SELECT room_id, event_id, seq FROM ch WHERE type = 'm.room.power_levels')
SELECT t.room_id, t.event_id, ch.type, ch.state_key, arg_max(ch.event_id, ch.seq) AS entry FROM t JOIN ch ON ch.room_id = t.room_id AND ch.seq <= t.seq WHERE ch.state_key IS NOT NULL GROUP BY ALL""")
def reconstruct_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states at every change of the power levels."""
    e = d.events(spark, sf_dir)
    chain = s.linear_chain(e, 10)
    return s.reconstruct_events(chain, s.snapshots(chain), e.where("type = 'm.room.power_levels'"))


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = d.events(spark, sf_dir).select("event_id", "room_id", "type", "ts")
    kinds = ("m.room.message", "m.room.topic", "m.room.member")
    return [e.where(F.col("type") != kinds[0]), e.where(F.col("type") != kinds[1]), e.where(F.col("type").isin(kinds[1], kinds[2]))]


_SRC = """, src AS (SELECT 0 AS src, * FROM ev WHERE type <> 'm.room.message' UNION ALL SELECT 1, * FROM ev WHERE type <> 'm.room.topic' UNION ALL SELECT 2, * FROM ev WHERE type IN ('m.room.topic', 'm.room.member'))"""


@query(_SRC + " SELECT event_id, any_value(room_id) AS room_id, any_value(type) AS type, any_value(ts) AS ts, CAST(min(src) AS INTEGER) AS src FROM src GROUP BY event_id")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partial copies of the table as one; each event from the first copy that has it."""
    return s.merge_sources(_sources(spark, sf_dir))


@query(_SRC + " SELECT CAST(x.src AS INTEGER) AS a, CAST(y.src AS INTEGER) AS b, count(*) AS shared FROM src x JOIN src y ON x.event_id = y.event_id AND x.src < y.src GROUP BY ALL")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = [x.select(F.lit(k).alias("src"), "event_id") for k, x in enumerate(_sources(spark, sf_dir))]
    return s.overlaps(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))
