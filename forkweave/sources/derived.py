"""A deterministic event graph over a plain events table (event_id, ts, user_id, event_type, props).

Fifty events make a room, five a block: a diamond whose two ends join in the next block. Every room ends in two heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOM, BLOCK = 50, 5


def _member(user: Column) -> Column:
    return F.concat(F.lit("@u"), user.cast("string"), F.lit(":x"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room_id, event_id, seq, blk, m, depth, ts, sender, type, state_key, membership, mod_level, join_rule."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    e = raw.withColumns({"room_id": F.expr("event_id div 50"), "seq": (F.col("event_id") % ROOM).cast("long")})
    e = e.withColumns({"blk": F.expr("seq div 5"), "m": F.col("seq") % BLOCK})
    first = F.when(F.col("seq") == 0, "m.room.create").when(F.col("seq") == 1, "m.room.member").when(F.col("seq") == 2, "m.room.power_levels").when(F.col("seq") == 3, "m.room.join_rules")
    kind = F.col("event_type")
    later = F.when(kind.isin("signup", "error"), "m.room.member").when(kind == "purchase", "m.room.power_levels").when(kind == "view", "m.room.topic").when(kind == "click", "m.room.message")
    sender = F.when(F.col("seq") < 4, F.lit("@u0:x")).otherwise(_member(F.col("user_id") % 6))
    later_key = F.when(kind == "signup", sender).when(kind == "error", _member((F.col("user_id") + 1) % 6)).when(kind.isin("purchase", "view"), F.lit(""))
    key = F.when(F.col("seq") == 1, F.lit("@u0:x")).when(F.col("seq") < 4, F.lit("")).otherwise(later_key)
    return e.select(
        "room_id", "event_id", "seq", "blk", "m",
        (1 + 4 * F.col("blk") + F.when(F.col("m") < 3, F.col("m")).otherwise(F.col("m") - 1)).alias("depth"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        sender.alias("sender"),
        F.coalesce(first, later).alias("type"),
        key.alias("state_key"),
        F.when((F.col("seq") == 1) | ((F.col("seq") >= 4) & (kind == "signup")), "join").when((F.col("seq") >= 4) & (kind == "error"), "ban").alias("membership"),
        F.when(F.coalesce(first, later) == "m.room.power_levels", 25 * (F.regexp_extract("props", "[0-9]+", 0).cast("long") % 3)).alias("mod_level"),
        F.when(F.coalesce(first, later) == "m.room.join_rules", "public").alias("join_rule"),
    )


def prev_edges(e: DataFrame) -> DataFrame:
    """room_id, child, parent, ord."""
    back = F.when(F.col("m").isin(1, 2), F.array(F.lit(1))).when(F.col("m").isin(3, 4), F.array(F.lit(2))).when(F.col("seq") > 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array().cast("array<int>"))
    out = e.select("room_id", F.col("event_id").alias("child"), F.posexplode(back).alias("ord", "back"))
    return out.select("room_id", "child", (F.col("child") - F.col("back")).alias("parent"), "ord")


def auth_edges(e: DataFrame) -> DataFrame:
    """room_id, child, parent, ord: the create event, the first ones, then the latest levels and the sender's latest member event of earlier blocks."""
    room = Window.partitionBy("room_id").orderBy("blk").rangeBetween(Window.unboundedPreceding, -1)
    levels = F.max(F.when(F.col("type") == "m.room.power_levels", F.col("event_id"))).over(room)
    # each event asks under its sender, each member event answers under its state key: one window instead of a range join
    asks = e.select("room_id", "blk", F.col("sender").alias("user"), F.col("event_id").alias("child"), F.lit(None).cast("long").alias("answer"))
    answers = e.where("type = 'm.room.member'").select("room_id", "blk", F.col("state_key").alias("user"), F.lit(None).cast("long").alias("child"), F.col("event_id").alias("answer"))
    user = Window.partitionBy("room_id", "user").orderBy("blk").rangeBetween(Window.unboundedPreceding, -1)
    own = asks.unionByName(answers).withColumn("own", F.max("answer").over(user)).where("child is not null").select(F.col("child").alias("event_id"), "own")
    base = F.col("event_id") - F.col("seq")
    parents = F.array(
        F.when(F.col("seq") > 0, base), F.when(F.col("seq").isin(2, 3, 4), base + 1), F.when(F.col("seq") == 4, base + 2), F.when(F.col("blk") > 0, F.col("levels")), F.when(F.col("blk") > 0, F.col("own"))
    )
    out = e.withColumn("levels", levels).join(own, "event_id")
    kept = F.array_distinct(F.filter(parents, lambda p: p.isNotNull()))
    return out.select("room_id", F.col("event_id").alias("child"), F.posexplode(kept).alias("ord", "parent")).select("room_id", "child", "parent", "ord")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph as whole event records: string ids, JSON content, arrays of parents."""
    e = events(spark, sf_dir)
    name = lambda c: F.concat(F.lit("$"), F.lpad(c.cast("string"), 8, "0"))
    gather = lambda edges, out: edges.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("ord", "parent"))).alias("p")).select(F.col("child").alias("event_id"), F.transform("p", lambda x: name(x["parent"])).alias(out))
    content = F.when(F.col("type") == "m.room.power_levels", F.to_json(F.struct(F.create_map(F.lit("@u0:x"), F.lit(100).cast("long"), F.lit("@u1:x"), F.col("mod_level")).alias("users"), F.lit(0).alias("users_default"))))
    content = content.when(F.col("type") == "m.room.member", F.to_json(F.struct("membership"))).when(F.col("type") == "m.room.join_rules", F.to_json(F.struct("join_rule")))
    content = content.when(F.col("type") == "m.room.create", F.lit('{"room_version":"11"}')).otherwise(F.lit("{}"))
    out = e.join(gather(prev_edges(e), "prev_events"), "event_id", "left").join(gather(auth_edges(e), "auth_events"), "event_id", "left")
    none = F.array().cast("array<string>")
    return out.select("room_id", name(F.col("event_id")).alias("event_id"), "type", "state_key", "sender", F.col("ts").alias("origin_server_ts"), "depth", F.lit(0).cast("long").alias("power_level"), F.coalesce("prev_events", none).alias("prev_events"), F.coalesce("auth_events", none).alias("auth_events"), content.alias("content"))


#: The same graph for DuckDB; queries append to it.
SQL = """
WITH RECURSIVE raw AS (
  SELECT event_id, event_id // 50 AS room_id, event_id % 50 AS seq, (event_id % 50) // 5 AS blk, event_id % 5 AS m,
         epoch_us(ts) // 1000 AS ts, user_id, event_type AS kind, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events),
typed AS (
  SELECT *, CASE WHEN seq < 4 THEN '@u0:x' ELSE '@u' || (user_id % 6) || ':x' END AS sender,
    CASE WHEN seq = 0 THEN 'm.room.create' WHEN seq = 1 THEN 'm.room.member' WHEN seq = 2 THEN 'm.room.power_levels'
         WHEN seq = 3 THEN 'm.room.join_rules' WHEN kind IN ('signup', 'error') THEN 'm.room.member'
         WHEN kind = 'purchase' THEN 'm.room.power_levels' WHEN kind = 'view' THEN 'm.room.topic' ELSE 'm.room.message' END AS type
  FROM raw),
ev AS (
  SELECT room_id, event_id, seq, blk, m, 1 + 4 * blk + CASE WHEN m < 3 THEN m ELSE m - 1 END AS depth, ts, sender, type,
    CASE WHEN seq = 1 THEN '@u0:x' WHEN seq < 4 THEN '' WHEN kind = 'signup' THEN sender
         WHEN kind = 'error' THEN '@u' || ((user_id + 1) % 6) || ':x' WHEN kind IN ('purchase', 'view') THEN '' END AS state_key,
    CASE WHEN seq = 1 OR (seq >= 4 AND kind = 'signup') THEN 'join' WHEN seq >= 4 AND kind = 'error' THEN 'ban' END AS membership,
    CASE WHEN type = 'm.room.power_levels' THEN 25 * (k % 3) END AS mod_level,
    CASE WHEN type = 'm.room.join_rules' THEN 'public' END AS join_rule
  FROM typed),
prev AS (
  SELECT room_id, event_id AS child, event_id - back AS parent, back FROM (
    SELECT room_id, event_id, unnest(CASE WHEN m IN (1, 2) THEN [1] WHEN m IN (3, 4) THEN [2] WHEN seq > 0 THEN [2, 1] ELSE [] END) AS back FROM ev)),
auth AS (
  SELECT room_id, event_id AS child, event_id - seq AS parent FROM ev WHERE seq > 0
  UNION SELECT room_id, event_id, event_id - seq + 1 FROM ev WHERE seq IN (2, 3, 4)
  UNION SELECT room_id, event_id, event_id - seq + 2 FROM ev WHERE seq = 4
  UNION SELECT e.room_id, e.event_id, max(p.event_id) FROM ev e JOIN ev p ON p.room_id = e.room_id AND p.blk < e.blk AND p.type = 'm.room.power_levels' GROUP BY ALL
  UNION SELECT e.room_id, e.event_id, max(p.event_id) FROM ev e JOIN ev p ON p.room_id = e.room_id AND p.blk < e.blk AND p.type = 'm.room.member' AND p.state_key = e.sender GROUP BY ALL)
"""
