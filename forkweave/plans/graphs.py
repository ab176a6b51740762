"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import state as s
from ..sources import derived as d
from .registry import query

HEADS = ", heads AS (SELECT room_id, event_id FROM ev WHERE event_id NOT IN (SELECT parent FROM prev))"
#: Reflexive timeline ancestors of heads, and the last entry per key of each.
STATES = HEADS + """, r AS (SELECT room_id, event_id AS head, event_id FROM heads UNION SELECT r.room_id, r.head, p.parent FROM r JOIN prev p ON p.child = r.event_id),
st AS (SELECT ev.room_id, head, type, state_key, arg_max(ev.event_id, ev.depth * 1000000000 + ev.event_id) AS event_id
       FROM r JOIN ev USING (event_id) WHERE state_key IS NOT NULL GROUP BY ALL)"""
PARTITION = STATES + """, per AS (SELECT room_id, type, state_key, count(DISTINCT event_id) AS ids, count(*) AS votes FROM st GROUP BY ALL),
part AS (SELECT DISTINCT st.room_id, st.type, st.state_key, st.event_id, NOT (ids = 1 AND votes = 2) AS is_conflicted FROM st JOIN per USING (room_id, type, state_key))"""
CLOSURE = """, steps AS (SELECT room_id, child AS event_id, parent AS ancestor_id, 1 AS hops FROM auth
  UNION SELECT s.room_id, s.event_id, a.parent, s.hops + 1 FROM steps s JOIN auth a ON a.child = s.ancestor_id),
cl AS (SELECT room_id, event_id, ancestor_id, CAST(min(hops) AS INTEGER) AS hops FROM steps GROUP BY ALL)"""


class Graph:
    """The derived tables of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.events = d.events(spark, sf_dir)
        self.prev, self.auth = d.prev_edges(self.events), d.auth_edges(self.events)
        self.heads = g.heads(self.events, self.prev)

    def head_states(self) -> DataFrame:
        """room_id, head, type, state_key, event_id."""
        met = g.chains(self.prev, self.heads, reflexive=True).withColumnRenamed("start", "head")
        rows = met.join(self.events, ["room_id", "event_id"])
        return s.last_per_key(rows, "room_id", "head")

    def partition(self) -> DataFrame:
        return s.partition(self.head_states(), "head")

    def disputed(self) -> DataFrame:
        return self.partition().where("is_conflicted").select("room_id", "event_id").distinct()


@query(HEADS + " SELECT room_id, event_id FROM heads")
def dag_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).heads


@query(CLOSURE + " SELECT * FROM cl")
def auth_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.closure(Graph(spark, sf_dir).auth)


@query(CLOSURE + """, st AS (SELECT room_id, type, state_key, arg_max(event_id, depth * 1000000000 + event_id) AS event_id FROM ev WHERE state_key IS NOT NULL GROUP BY ALL)
SELECT DISTINCT cl.room_id, ancestor_id AS event_id FROM cl JOIN st ON st.event_id = cl.event_id""")
def auth_chain_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.reachable(x.auth, s.last_per_key(x.events), strict=True).select("room_id", "event_id")


@query(HEADS + CLOSURE + """, seen AS (SELECT cl.room_id, ancestor_id AS event_id, count(DISTINCT cl.event_id) AS n FROM cl JOIN heads ON heads.event_id = cl.event_id GROUP BY ALL)
SELECT room_id, event_id FROM seen WHERE n < 2""")
def auth_difference_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.difference(g.chains(x.auth, x.heads), x.heads)


def _seeded(flag: str, name: str) -> str:
    return f", {name} AS (SELECT DISTINCT room_id, event_id FROM part WHERE {flag} UNION SELECT cl.room_id, ancestor_id FROM cl JOIN part ON part.event_id = cl.event_id AND {flag})"


@query(PARTITION + CLOSURE + _seeded("is_conflicted", "c") + _seeded("NOT is_conflicted", "u") + " SELECT room_id, event_id FROM c WHERE event_id NOT IN (SELECT event_id FROM u)")
def auth_difference_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    part = x.partition()
    return g.bounded_difference(x.auth, part.where("is_conflicted"), part.where("NOT is_conflicted"))


_UP = """, up AS (SELECT DISTINCT event_id FROM part WHERE is_conflicted UNION SELECT cl.event_id FROM cl JOIN part ON part.event_id = cl.ancestor_id AND is_conflicted)"""


@query(PARTITION + CLOSURE + _seeded("is_conflicted", "c") + _UP + " SELECT room_id, event_id FROM c WHERE event_id IN (SELECT event_id FROM up)")
def conflicted_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.subgraph(x.auth, x.disputed())


@query(PARTITION + CLOSURE + """, c AS (SELECT DISTINCT room_id, event_id FROM part WHERE is_conflicted UNION SELECT cl.room_id, ancestor_id FROM cl JOIN part ON part.event_id = cl.event_id AND is_conflicted AND hops <= 2)""" + _UP + " SELECT room_id, event_id FROM c WHERE event_id IN (SELECT event_id FROM up)")
def subgraph_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.subgraph(x.auth, x.disputed(), most=2)


#: A partial copy of the table lacks the bans.
_BANS = ", bans AS (SELECT event_id FROM ev WHERE membership = 'ban')"


@query(_BANS + " SELECT DISTINCT room_id, parent AS event_id FROM auth WHERE child NOT IN (FROM bans) AND parent IN (FROM bans)")
def missing_auth_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the events that a partial copy of the table holds to those that it lacks."""
    x = Graph(spark, sf_dir)
    have = x.events.where(~F.col("membership").eqNullSafe(F.lit("ban")))
    return g.missing_parents(x.auth.join(have.select(F.col("event_id").alias("child")), "child", "left_semi"), have)


@query(_BANS + " SELECT room_id, child, parent FROM auth WHERE parent NOT IN (FROM bans)")
def known_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.known_edges(x.auth, x.events.where(~F.col("membership").eqNullSafe(F.lit("ban")))).select("room_id", "child", "parent")


@query(STATES + """, common AS (SELECT room_id, event_id FROM r GROUP BY ALL HAVING count(DISTINCT head) = 2)
SELECT room_id, arg_max(event_id, depth * 1000000000 + event_id) AS event_id FROM common JOIN ev USING (room_id, event_id) GROUP BY room_id""")
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.merge_base(x.prev, x.heads, x.events)


@query(HEADS + """, edges AS (SELECT child, parent FROM prev UNION SELECT child, parent FROM auth),
down AS (SELECT room_id, event_id, event_id AS ancestor_id FROM heads UNION SELECT d.room_id, d.event_id, e.parent FROM down d JOIN edges e ON e.child = d.ancestor_id)
SELECT * FROM down""")
def ancestor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that each head reaches by timeline or authority, itself included."""
    x = Graph(spark, sf_dir)
    both = x.prev.select("room_id", "child", "parent").union(x.auth.select("room_id", "child", "parent"))
    return g.chains(both, x.heads, reflexive=True).select("room_id", F.col("start").alias("event_id"), F.col("event_id").alias("ancestor_id"))


@query(CLOSURE + """ SELECT cl.room_id, cl.event_id, CAST(min(hops) AS INTEGER) AS distance FROM cl JOIN ev c ON c.event_id = cl.ancestor_id AND c.seq = 0 GROUP BY ALL
UNION ALL SELECT room_id, event_id, 0 FROM ev WHERE seq = 0""")
def auth_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return g.distances(x.auth, x.events)


@query(""", inner_ AS (SELECT * FROM ev WHERE type = 'm.room.message' OR type = 'm.room.topic'), e2 AS (SELECT a.child AS x, a.parent AS y FROM prev a JOIN inner_ i ON i.event_id = a.parent JOIN inner_ j ON j.event_id = a.child),
und AS (SELECT x, y FROM e2 UNION SELECT y, x FROM e2),
reach AS (SELECT event_id, event_id AS other FROM inner_ UNION SELECT r.event_id, u.y FROM reach r JOIN und u ON u.x = r.other)
SELECT i.room_id, r.event_id, arg_min(i.event_id, i.depth * 1000000000 + i.event_id) AS root FROM reach r JOIN inner_ i ON i.event_id = r.other GROUP BY ALL""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of talk: components by timeline among messages and topics, which administrative events part."""
    x = Graph(spark, sf_dir)
    return g.components(x.events.where("type IN ('m.room.message', 'm.room.topic')"), x.prev)


@query(""", edges AS (SELECT child, parent FROM prev UNION SELECT child, parent FROM auth), und AS (SELECT child AS x, parent AS y FROM edges UNION SELECT parent, child FROM edges),
reach AS (SELECT event_id, event_id AS other FROM ev UNION SELECT r.event_id, u.y FROM reach r JOIN und u ON u.x = r.other)
SELECT i.room_id, r.event_id, arg_min(i.event_id, i.depth * 1000000000 + i.event_id) AS root FROM reach r JOIN ev i ON i.event_id = r.other GROUP BY ALL""")
def components_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by timeline and authority over all events."""
    x = Graph(spark, sf_dir)
    return g.components(x.events, x.prev.select("room_id", "child", "parent").union(x.auth.select("room_id", "child", "parent")))


@query(""", walk AS (SELECT room_id, event_id, 1 AS n FROM ev WHERE event_id NOT IN (SELECT child FROM prev) UNION SELECT w.room_id, p.child, w.n + 1 FROM walk w JOIN prev p ON p.parent = w.event_id)
SELECT room_id, event_id, CAST(max(n) AS INTEGER) AS depth FROM walk GROUP BY ALL""")
def naive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's depth made anew from the timeline alone."""
    x = Graph(spark, sf_dir)
    return g.depths(x.events, x.prev)


@query(""" SELECT room_id, CAST(min(depth) AS BIGINT) AS min_depth, CAST(max(depth) AS BIGINT) AS max_depth, count(*) AS events, CAST(sum(parents) AS BIGINT) AS refs, CAST(max(parents) AS BIGINT) AS max_parents
FROM (SELECT ev.room_id, ev.event_id, depth, count(parent) AS parents FROM ev LEFT JOIN prev ON child = ev.event_id GROUP BY ALL) GROUP BY room_id""")
def branching_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    parents = x.prev.groupBy(F.col("child").alias("event_id")).agg(F.count("*").alias("parents"))
    per = x.events.join(parents, "event_id", "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    return per.groupBy("room_id").agg(F.min("depth").cast("long").alias("min_depth"), F.max("depth").cast("long").alias("max_depth"), F.count("*").alias("events"), F.sum("parents").alias("refs"), F.max("parents").alias("max_parents"))
