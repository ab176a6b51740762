"""Reading events: envelopes, edge lists of several forms, quarantine, exports; against the derived graph's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as c
from ..operators import graph as g
from ..operators import reports as r
from ..operators import state as s
from ..sources import derived as d
from ..sources import events as src
from .graphs import HEADS
from .registry import query


def _number(event_id: str = "event_id") -> Column:
    return F.substring(event_id, 2, 20).cast("long")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw: the records as JSON, in an envelope or bare, with edges as ids, pairs or objects, by their number."""
    rows = d.records(spark, sf_dir).withColumn("n", _number())
    pairs = lambda name: F.transform(name, lambda p: F.array(p, F.lit("hash")))
    objects = lambda name: F.transform(name, lambda p: F.struct(p.alias("event_id")))
    head = ["room_id", "event_id", "type", "state_key", "sender", "origin_server_ts", "depth", F.try_parse_json("content").alias("content")]
    head[0] = F.concat(F.lit("!"), F.col("room_id").cast("string")).alias("room_id")
    text = F.when(F.col("n") % 3 == 0, F.to_json(F.struct(*head, "prev_events", "auth_events")))
    text = text.when(F.col("n") % 3 == 1, F.to_json(F.struct(*head, pairs("prev_events").alias("prev_events"), pairs("auth_events").alias("auth_events"))))
    text = text.otherwise(F.to_json(F.struct(*head, objects("prev_events").alias("prev_events"), objects("auth_events").alias("auth_events"))))
    wrap = F.when(F.col("n") % 4 == 1, F.concat(F.lit('{"_source":'), text, F.lit("}"))).when(F.col("n") % 4 == 2, F.concat(F.lit('{"x":1,"event":'), text, F.lit("}"))).otherwise(text)
    return rows.select("n", wrap.alias("raw"))


@query(""" SELECT '!' || ev.room_id AS room_id, ev.event_id, ev.type, ev.state_key, ev.sender, ev.ts AS origin_server_ts, CAST(ev.depth AS BIGINT) AS depth, membership,
  coalesce((SELECT count(*) FROM prev WHERE child = ev.event_id), 0) AS n_prev, coalesce((SELECT sum(parent) FROM auth WHERE child = ev.event_id), 0)::BIGINT AS auth_sum FROM ev""")
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come wrapped or bare, with three forms of edge lists, as records."""
    good, _ = src.parse(src.unwrapped(_raw(spark, sf_dir).select("raw")))
    total = F.aggregate(F.transform("auth_events", lambda x: F.substring(x, F.lit(2), F.lit(20)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return c.typed(good).select("room_id", _number().alias("event_id"), "type", "state_key", "sender", "origin_server_ts", "depth", "membership", F.size("prev_events").cast("long").alias("n_prev"), total.alias("auth_sum"))


@query(""", f AS (SELECT CASE WHEN event_id % 11 = 1 THEN 'not a JSON object' WHEN event_id % 11 = 2 THEN 'no event_id' WHEN event_id % 11 = 3 THEN 'no type' WHEN event_id % 11 IN (4, 5) THEN 'power_level is no integer' ELSE 'record' END AS outcome FROM ev)
SELECT outcome, count(*) AS n FROM f GROUP BY 1""")
def quarantined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of events with faults of each kind: records, or quarantine with a reason."""
    n = F.col("n")
    text = F.when(n % 11 == 1, "[1, {").when(n % 11 == 2, '{"type":"m"}').when(n % 11 == 3, F.concat(F.lit('{"event_id":"$'), n.cast("string"), F.lit('","type":""}')))
    power = F.when(n % 11 == 4, "1.5").when(n % 11 == 5, "true").when(n % 11 == 6, '"7"').when(n % 11 == 7, '"x"').otherwise("18446744073709551615")
    text = text.otherwise(F.concat(F.lit('{"event_id":"$'), n.cast("string"), F.lit('","type":"m","power_level":'), power, F.lit("}")))
    good, bad = src.parse(d.events(spark, sf_dir).select(F.col("event_id").alias("n")).select(text.alias("raw")), room_id="!r")
    return good.select(F.lit("record").alias("outcome")).unionAll(bad.select("reason")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(HEADS + """, k AS (SELECT room_id, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM (SELECT room_id, type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1),
h AS (SELECT room_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS heads FROM heads GROUP BY 1)
SELECT ev.room_id, any_value(heads) AS heads, count(*) AS total, CAST(count(*) FILTER (event_id IN (SELECT child FROM auth)) AS BIGINT) AS with_auth, CAST(count(*) FILTER (event_id IN (SELECT child FROM prev)) AS BIGINT) AS with_prev,
  count(DISTINCT sender) AS senders, any_value(by_type) AS by_type FROM ev JOIN k USING (room_id) JOIN h USING (room_id) GROUP BY ev.room_id""")
def export_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of an export of each room, with its maps and lists as text."""
    rows = d.records(spark, sf_dir)
    prev = rows.select("room_id", F.col("event_id").alias("child"), F.explode("prev_events").alias("parent"))
    out = src.exported(rows, g.heads(rows, prev))
    kinds = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    heads = F.array_join(F.transform("heads", lambda x: F.substring(x, F.lit(2), F.lit(20)).cast("long").cast("string")), ",")
    return out.withColumns({"by_type": kinds, "heads": heads})


@query(""" SELECT event_id, CASE WHEN event_id % 7 = 1 THEN 'too many prev_events' WHEN event_id % 7 = 2 THEN 'too many auth_events' WHEN event_id % 7 = 3 THEN 'empty type' END AS fault FROM ev""")
def syntactic_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits on edge lists and types, over records some of which break them."""
    rows = d.records(spark, sf_dir).withColumn("n", _number())
    many = lambda count: F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.concat(F.lit("$"), i.cast("string")))
    rows = rows.withColumns({"prev_events": F.when(F.col("n") % 7 == 1, many(21)).otherwise(many(20)), "auth_events": F.when(F.col("n") % 7 == 2, many(11)).otherwise(many(10)), "type": F.when(F.col("n") % 7 == 3, "").otherwise(F.col("type"))})
    return rows.select(F.col("n").alias("event_id"), c.fault().alias("fault"))


@query(""", v AS (SELECT room_id, CASE WHEN room_id % 15 < 13 THEN CAST(room_id % 15 AS VARCHAR) WHEN room_id % 15 = 13 THEN '12.1' END AS room_version FROM ev WHERE seq = 0)
SELECT room_id, room_version, CASE WHEN room_version = '1' THEN 'V1' WHEN room_version IN ('2','3','4','5','6','7','8','9','10','11') THEN 'V2' WHEN room_version = '12' THEN 'V2_1' WHEN room_version = '12.1' THEN 'V2_1_1' END AS version FROM v WHERE room_version IS NOT NULL""")
def detected_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that create events name, some of them unknown or absent."""
    rows = d.records(spark, sf_dir)
    k = F.col("room_id") % 15
    named = F.when(k < 13, k.cast("string")).when(k == 13, "12.1")
    rows = rows.withColumn("content", F.when(F.col("type") == "m.room.create", F.to_json(F.struct(named.alias("room_version")))).otherwise(F.col("content")))
    return r.detect_versions(c.typed(rows), "depth")


@query(""" SELECT event_id, '$' || rtrim(translate(to_base64(unhex(sha256('{"content":{"a":' || event_id || ',"b":[1,{"y":2,"z":"ü"}]},"sender":"' || sender || '","type":"' || type || '"}'))), '+/', '-_'), '=') AS hash_id FROM ev""")
def canonical_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the canonical JSON of events whose keys come in another order, with unsigned parts and signatures."""
    e = d.events(spark, sf_dir)
    text = F.concat(F.lit('{"unsigned": {"age": 4}, "type":"'), "type", F.lit('", "sender":"'), "sender", F.lit('", "signatures":{"s":{}}, "content": {"b": [1, {"z": "ü", "y": 2}], "a": '), F.col("event_id").cast("string"), F.lit("}}"))
    return src.canonical_ids(e.select("event_id", text.alias("raw"))).select("event_id", "hash_id")


@query(""" SELECT '!' || room_id AS room, '$' || event_id AS event, type AS kind, sender AS who, CAST(depth AS BIGINT) AS at FROM ev""")
def mapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table under names of its own as records, and back."""
    e = d.events(spark, sf_dir)
    own = e.select(F.concat(F.lit("!"), F.col("room_id").cast("string")).alias("room"), F.concat(F.lit("$"), F.col("event_id").cast("string")).alias("event"), F.col("type").alias("kind"), F.col("sender").alias("who"), F.col("depth").alias("at"))
    rows = src.mapped(own, {"room_id": "room", "event_id": "event", "type": "kind", "sender": "who", "depth": "at"})
    return rows.where("content = '{}' AND size(prev_events) = 0 AND origin_server_ts = 0").select(F.col("room_id").alias("room"), F.col("event_id").alias("event"), F.col("type").alias("kind"), F.col("sender").alias("who"), F.col("depth").alias("at"))


@query(""", src AS (SELECT event_id, 0 AS s FROM ev WHERE type <> 'm.room.topic' UNION ALL SELECT event_id, 1 FROM ev WHERE type <> 'm.room.message')
SELECT count(*) FILTER (n = 2) > 0 AS connected FROM (SELECT event_id, count(*) AS n FROM src GROUP BY 1)""")
def sources_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two partial copies hang together through events that both have."""
    e = d.events(spark, sf_dir).select("event_id", "type")
    copies = [e.where("type <> 'm.room.topic'"), e.where("type <> 'm.room.message'")]
    shared = s.overlaps(copies[0].select(F.lit(0).alias("src"), "event_id").unionAll(copies[1].select(F.lit(1).alias("src"), "event_id")))
    s.check_connected(shared, 2)
    return shared.groupBy().agg((F.sum("shared") > 0).alias("connected"))
