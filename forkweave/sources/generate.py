"""Synthetic rooms: a linear room, and one that churns in phases. Both are closed-form, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("room_id", "event_id", "type", "state_key", "sender", "origin_server_ts", "depth", "power_level", "prev_events", "auth_events", "content")


def _id(n) -> F.Column:
    return F.concat(F.lit("$"), F.lpad(n.cast("string"), 10, "0"))


def linear(spark: SparkSession, events: int = 1000, forks: bool = True) -> DataFrame:
    """A create event, its creator's join, levels and rules, then messages and topics; the last two are rival heads if forks."""
    n = F.col("id")
    kind = F.when(n == 0, "m.room.create").when(n == 1, "m.room.member").when(n == 2, "m.room.power_levels").when(n == 3, "m.room.join_rules").when((n % 10 == 0) | (n >= events - 2), "m.room.topic").otherwise("m.room.message")
    before = F.when(F.lit(forks) & (n == events - 1), n - 2).otherwise(n - 1)
    content = F.when(n == 0, '{"room_version":"11"}').when(n == 1, '{"membership":"join"}').when(n == 2, '{"users":{"@admin:x":100}}').when(n == 3, '{"join_rule":"public"}').otherwise(F.concat(F.lit('{"topic":"t'), n.cast("string"), F.lit('"}')))
    auth = F.transform(F.when(n == 0, F.array().cast("array<long>")).when(n == 1, F.array(F.lit(0).cast("long"))).when(n == 2, F.array(F.lit(0), F.lit(1)).cast("array<long>")).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<long>")), _id)
    return spark.range(events).select(
        F.lit("!linear").alias("room_id"), _id(n).alias("event_id"), kind.alias("type"), F.when(n == 1, "@admin:x").when(kind != "m.room.message", "").alias("state_key"), F.lit("@admin:x").alias("sender"),
        (n * 1000).alias("origin_server_ts"), (F.least(n, F.lit(events - 2)) + 1).alias("depth"), F.lit(100).cast("long").alias("power_level"),
        F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(_id(before))).alias("prev_events"), auth.alias("auth_events"), content.alias("content"),
    )


def churning(spark: SparkSession, rooms: int = 10, events: int = 200, seed: int = 42) -> DataFrame:
    """Rooms in which users join, leave, are banned and change topics on two branches that meet every ten events."""
    n, room = F.col("id") % events, F.expr(f"id div {events}")
    base = room * events
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(100))
    user = lambda salt: F.concat(F.lit("@u"), F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(8)).cast("string"), F.lit(":x"))
    kind = F.when(n == 0, "m.room.create").when(n == 1, "m.room.member").when(n == 2, "m.room.power_levels").when(n == 3, "m.room.join_rules").when(draw("k") < 55, "m.room.member").when(draw("k") < 80, "m.room.topic").otherwise("m.room.message")
    sender = F.when(n < 4, "@u0:x").otherwise(user("s"))
    role = F.when((n == 1) | (draw("m") < 60), "join").when(draw("m") < 80, "leave").otherwise("ban")
    target = F.when(n == 1, "@u0:x").when(role == "join", sender).otherwise(user("t"))
    # two branches: odd and even events follow their own; every tenth joins both
    prev = F.when(n == 0, F.array().cast("array<long>")).when(n < 5, F.array(n - 1)).when(n % 10 == 0, F.array(n - 2, n - 1)).when(n % 10 == 1, F.array(n - 1)).otherwise(F.array(n - 2))
    auth = F.when(n == 0, F.array().cast("array<long>")).when(n < 3, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<long>"))
    content = F.when(kind == "m.room.create", '{"room_version":"11"}').when(kind == "m.room.power_levels", '{"users":{"@u0:x":100,"@u1:x":50}}').when(kind == "m.room.join_rules", '{"join_rule":"public"}').when(kind == "m.room.member", F.concat(F.lit('{"membership":"'), role, F.lit('"}'))).otherwise(F.concat(F.lit('{"topic":"'), n.cast("string"), F.lit('"}')))
    names = lambda a: F.transform(a, lambda x: _id(base + x))
    return spark.range(rooms * events).select(
        F.concat(F.lit("!r"), room.cast("string")).alias("room_id"), _id(F.col("id")).alias("event_id"), kind.alias("type"), F.when(kind == "m.room.member", target).when(kind != "m.room.message", "").alias("state_key"), sender.alias("sender"),
        (n * 1000).alias("origin_server_ts"), (n + 1).alias("depth"), F.lit(0).cast("long").alias("power_level"), names(prev).alias("prev_events"), names(auth).alias("auth_events"), content.alias("content"),
    )
