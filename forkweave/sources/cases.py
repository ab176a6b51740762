"""Authorization cases over a plain events table: each row a room of its own, with a small state and one event to judge.

The digits of a number made from event_id choose sender's and target's membership, join rules, levels, who created the
room, and what the event is, so that every rule meets rows that it refuses and rows that it lets pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each digit chooses from, in the order of the digits.
KINDS = ("join", "leave", "ban", "invite", "knock", "third", "topic", "message", "levels", "odd", "named")
SENDER = ("join", "join", "leave", "ban", "invite", None)
TARGET = ("join", "leave", "ban", "invite", "knock", None)
RULES = ("public", "invite", "knock", "restricted", "knock_restricted", None)
VIA = (None, "join", "leave", "join")
LEVELS = (
    None,
    '{"users":{"@s:x":0,"@v:x":0}}',
    '{"users":{"@s:x":50,"@v:x":50}}',
    '{"users":{"@s:x":60,"@t:x":60,"@v:x":60}}',
    '{"users":{"@s:x":"100","@v:x":20},"users_default":10,"events":{"m.room.topic":75},"ban":70,"kick":30,"invite":40,"state_default":55,"events_default":5}',
)


def _pick(x: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (x % len(values) + 1).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event records, and which of them are the state: (room_id, event_id, ...) and (room_id, type, state_key, event_id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("n"))
    e = e.withColumn("h0", (F.col("n") * 7919 + 104729) % 1000003)
    sizes = (3, len(KINDS), len(SENDER), len(TARGET), len(RULES), len(LEVELS), len(VIA))
    for k, size in enumerate(sizes):
        e = e.withColumn(f"h{k + 1}", F.floor(F.col(f"h{k}") / size).cast("long"))
    h = [F.col(f"h{k}") for k in range(len(sizes) + 1)]
    made = F.when(h[7] % 3 == 0, "@s:x").otherwise("@c:x")
    kind = _pick(h[1], KINDS)
    user = F.when(h[0] % 3 == 0, "@s:x").otherwise("@t:x")
    e = e.select("n", made.alias("creator"), kind.alias("kind"), user.alias("user"), _pick(h[2], SENDER).alias("sm"), _pick(h[3], TARGET).alias("tm"), _pick(h[4], RULES).alias("rule"), _pick(h[5], LEVELS).alias("levels"), _pick(h[6], VIA).alias("via"))
    e = e.withColumn("is_create", F.col("n") % 79 == 0).withColumn("is_member", F.col("kind").isin("join", "leave", "ban", "invite", "knock", "third", "odd"))
    types = F.when(F.col("is_create"), "m.room.create").when(F.col("n") % 83 == 0, "").when(F.col("is_member"), "m.room.member").when(F.col("kind") == "topic", "m.room.topic").when(F.col("kind") == "message", "m.room.message").when(F.col("kind") == "levels", "m.room.power_levels").otherwise("x.named")
    key = F.when(F.col("is_create"), "").when(F.col("is_member") | (F.col("kind") == "named"), F.col("user")).when(F.col("kind") != "message", "")
    mxid = F.when(F.col("n") % 5 > 0, F.col("user")).otherwise("@other:x")
    signatures = F.when(F.col("n") % 7 > 0, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map().cast("map<string,string>"))
    signed = F.struct(F.struct(F.lit("token").alias("token"), mxid.alias("mxid"), signatures.alias("signatures")).alias("signed"))
    content = F.struct(F.when(F.col("kind") == "third", "invite").otherwise(F.col("kind")).alias("membership"), F.when(F.col("via").isNotNull(), "@v:x").alias("join_authorised_via_users_server"), F.when(F.col("kind") == "third", signed).alias("third_party_invite"))
    prev = F.when(F.col("n") % 97 == 0, 21).when(F.col("is_create"), F.col("n") % 2).otherwise(1)
    edges = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("$p"), i.cast("string")))
    none = F.array().cast("array<string>")
    row = lambda df, name, kind, key, sender, content, prev=none, auth=none: df.select(F.col("n").alias("room_id"), F.lit(name).alias("event_id"), kind.alias("type"), key.cast("string").alias("state_key"), sender.alias("sender"), F.lit(1).cast("long").alias("origin_server_ts"), F.lit(1).cast("long").alias("depth"), F.lit(0).cast("long").alias("power_level"), prev.alias("prev_events"), auth.alias("auth_events"), content.cast("string").alias("content"))
    member = lambda v: F.concat(F.lit('{"membership":"'), v, F.lit('"}'))
    judged = row(e, "$case", types, key, F.lit("@s:x"), F.when(F.col("is_member") & ~F.col("is_create"), F.to_json(content)).otherwise("{}"), F.when(prev > 0, edges(F.greatest(prev, F.lit(1)))).otherwise(none), edges(F.when(F.col("n") % 89 == 0, 11).otherwise(2)))
    state = row(e, "$create", F.lit("m.room.create"), F.lit(""), F.col("creator"), F.lit('{"room_version":"11"}'))
    state = state.unionByName(row(e.where("levels is not null"), "$levels", F.lit("m.room.power_levels"), F.lit(""), F.lit("@c:x"), F.col("levels")))
    state = state.unionByName(row(e.where("rule is not null"), "$rules", F.lit("m.room.join_rules"), F.lit(""), F.lit("@c:x"), F.concat(F.lit('{"join_rule":"'), F.col("rule"), F.lit('"}'))))
    for name, who, col in (("$s", "@s:x", "sm"), ("$t", "@t:x", "tm"), ("$v", "@v:x", "via")):
        state = state.unionByName(row(e.where(f"{col} is not null"), name, F.lit("m.room.member"), F.lit(who), F.lit(who), member(F.col(col))))
    tokens = e.where("n % 4 <> 3")
    state = state.unionByName(row(tokens, "$token", F.lit("m.room.third_party_invite"), F.lit("token"), F.when(F.col("n") % 3 > 0, "@s:x").otherwise("@t:x"), F.lit("{}")))
    return judged.unionByName(state), state.select("room_id", "type", "state_key", "event_id")


def _choice(x: str, values: tuple) -> str:
    return f"CASE {x} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


def sql(version: str) -> str:
    """SQL for DuckDB: room_id, code, required, actual of each case, by rules written for these cases alone."""
    top = (1 << 63) - 1

    def level(user: str) -> str:
        plain = f"CASE p WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN {user} IN ('@s:x', '@v:x') THEN 50 ELSE 0 END WHEN 3 THEN CASE WHEN {user} IN ('@s:x', '@t:x', '@v:x') THEN 60 ELSE 0 END ELSE CASE {user} WHEN '@s:x' THEN 100 WHEN '@v:x' THEN 20 ELSE 10 END END"
        return plain if version in ("V1", "V2") else f"CASE WHEN {user} = creator THEN CAST({top} AS HUGEINT) ELSE {plain} END"

    return f"""WITH d AS (SELECT event_id AS n, (event_id * 7919 + 104729) % 1000003 AS h FROM events),
c AS (SELECT n, CASE WHEN h % 3 = 0 THEN '@s:x' ELSE '@t:x' END AS usr, {_choice('(h // 3)', KINDS)} AS kind, {_choice('(h // 33)', SENDER)} AS sm, {_choice('(h // 198)', TARGET)} AS tm,
  {_choice('(h // 1188)', RULES)} AS rule, (h // 7128) % 5 AS p, {_choice('(h // 35640)', VIA)} AS via, CASE WHEN (h // 142560) % 3 = 0 THEN '@s:x' ELSE '@c:x' END AS creator,
  n % 79 = 0 AS made, CASE WHEN n % 97 = 0 THEN 21 WHEN n % 79 = 0 THEN n % 2 ELSE 1 END AS n_prev FROM d),
m AS (SELECT *, usr = '@s:x' AS own, coalesce(sm, CASE WHEN creator = '@s:x' THEN 'join' ELSE 'leave' END) AS role, CASE WHEN usr = '@s:x' THEN coalesce(sm, '') ELSE coalesce(tm, '') END AS now,
  {level("'@s:x'")} AS mine, {level('usr')} AS theirs, {level("'@v:x'")} AS helper,
  CASE WHEN p = 4 THEN 70 ELSE 50 END AS ban, CASE WHEN p = 4 THEN 30 ELSE 50 END AS kick, CASE WHEN p = 4 THEN 40 ELSE 0 END AS inv,
  CASE kind WHEN 'message' THEN CASE WHEN p = 4 THEN 5 ELSE 0 END WHEN 'topic' THEN CASE WHEN p = 4 THEN 75 ELSE 50 END ELSE CASE WHEN p = 4 THEN 55 ELSE 50 END END AS need FROM c),
j AS (SELECT *, CASE WHEN n_prev > 20 OR n % 89 = 0 THEN 'InvalidSyntax' WHEN made THEN CASE WHEN n_prev > 0 THEN 'CreateWithPrevEvents' END WHEN n % 83 = 0 THEN 'InvalidSyntax'
  WHEN role = 'ban' THEN 'BannedUser'
  WHEN role <> 'join' AND NOT (kind IN ('join', 'leave', 'invite', 'knock', 'third', 'odd') AND own) THEN 'NotMember'
  WHEN kind = 'join' THEN CASE WHEN NOT own THEN 'InvalidStateKey' WHEN creator = '@s:x' OR rule = 'public' OR (now IN ('invite', 'join') AND coalesce(rule, 'invite') <> 'public')
       OR (rule IN ('restricted', 'knock_restricted') AND via = 'join' AND helper >= inv) THEN NULL ELSE 'NotMember' END
  WHEN kind = 'leave' THEN CASE WHEN own THEN CASE WHEN now NOT IN ('invite', 'join', 'knock') THEN 'NotMember' END WHEN mine < CASE WHEN now = 'ban' THEN ban ELSE kick END OR mine <= theirs THEN 'InsufficientPowerLevel' END
  WHEN kind = 'ban' THEN CASE WHEN own THEN 'InvalidStateKey' WHEN mine < ban OR mine <= theirs THEN 'InsufficientPowerLevel' END
  WHEN kind IN ('invite', 'third') AND own THEN 'InvalidStateKey'
  WHEN kind = 'third' THEN CASE WHEN now = 'ban' THEN 'BannedUser' WHEN n % 7 = 0 THEN 'InvalidSyntax' WHEN n % 5 = 0 OR n % 4 = 3 OR n % 3 = 0 THEN 'InvalidStateKey' WHEN mine < inv THEN 'InsufficientPowerLevel' END
  WHEN kind = 'invite' THEN CASE WHEN mine < inv THEN 'InsufficientPowerLevel' WHEN now = 'join' THEN 'NotMember' WHEN now = 'ban' THEN 'BannedUser' END
  WHEN kind = 'knock' THEN CASE WHEN NOT own THEN 'InvalidStateKey' WHEN now IN ('invite', 'join') OR coalesce(rule, '') NOT IN ('knock', 'knock_restricted') THEN 'NotMember' END
  WHEN kind = 'odd' THEN 'InvalidSyntax'
  WHEN NOT (kind = 'levels' AND p = 0) AND mine < need THEN 'InsufficientPowerLevel'
  WHEN kind = 'named' AND NOT own THEN 'InvalidStateKey' END AS code FROM m)
SELECT n AS room_id, code, CAST(CASE WHEN code = 'InsufficientPowerLevel' THEN CASE WHEN kind = 'leave' AND mine < CASE WHEN now = 'ban' THEN ban ELSE kick END THEN CASE WHEN now = 'ban' THEN ban ELSE kick END
    WHEN kind = 'ban' AND mine < ban THEN ban WHEN kind IN ('leave', 'ban') THEN least(theirs + 1, {top}) WHEN kind IN ('invite', 'third') THEN inv ELSE need END END AS BIGINT) AS required,
  CAST(CASE WHEN code = 'InsufficientPowerLevel' THEN mine END AS BIGINT) AS actual FROM j"""
