"""Authority, order and domination queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content as c
from ..operators import auth as a
from ..operators import order as o
from ..operators import state as s
from ..sources import derived as d
from .graphs import PARTITION, Graph
from .registry import query

_FLAGS = """coalesce(type = 'm.room.member' AND membership IN ('ban', 'leave') AND state_key <> sender, false)"""


@query(f""" SELECT room_id, event_id, {_FLAGS} AS is_removal, type = 'm.room.power_levels' AS is_levels,
coalesce(type = 'm.room.join_rules' AND join_rule = 'invite', false) AS is_lockdown, state_key IS NOT NULL AS is_state,
CAST(NULL AS VARCHAR) AS fault FROM ev""")
def predicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.typed(d.records(spark, sf_dir))
    number = F.substring("event_id", 2, 20).cast("long")
    return rows.select("room_id", number.alias("event_id"), c.is_removal().alias("is_removal"), c.is_levels().alias("is_levels"), c.is_lockdown().alias("is_lockdown"), F.col("state_key").isNotNull().alias("is_state"), c.fault().alias("fault"))


_POWER = " SELECT room_id, event_id, type IN ('m.room.create', 'm.room.power_levels', 'm.room.join_rules') OR {} AS is_power FROM ev"


@query(_POWER.format("type = 'm.room.member'"))
def power_routing_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.events(spark, sf_dir).select("room_id", "event_id", c.is_power("V2").alias("is_power"))


@query(_POWER.format(_FLAGS))
def power_routing_v21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.events(spark, sf_dir).select("room_id", "event_id", c.is_power("V2_1").alias("is_power"))


@query(""" , need AS (SELECT event_id, 'm.room.create' AS type, '' AS state_key FROM ev WHERE seq > 0
UNION ALL SELECT event_id, 'm.room.member', sender FROM ev WHERE seq > 0
UNION ALL SELECT event_id, 'm.room.power_levels', '' FROM ev WHERE seq > 0
UNION ALL SELECT event_id, 'm.room.member', state_key FROM ev WHERE type = 'm.room.member' AND state_key <> sender
UNION ALL SELECT event_id, 'm.room.join_rules', '' FROM ev WHERE type = 'm.room.member' AND membership IN ('join', 'invite', 'knock')) SELECT * FROM need""")
def required_auth_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir).withColumn("tpi_token", F.lit(None).cast("string"))
    return e.select("event_id", F.explode(c.required_keys("V2")).alias("k")).select("event_id", "k.type", "k.state_key")


@query(""", rv AS (SELECT room_id, CAST(room_id % 14 AS VARCHAR) || CASE WHEN room_id % 28 >= 14 THEN '.1' ELSE '' END AS room_version FROM ev WHERE seq = 0)
SELECT room_id, room_version, CASE WHEN room_version = '1' THEN 'V1' WHEN room_version IN ('2','3','4','5','6','7','8','9','10','11') THEN 'V2' WHEN room_version = '12' THEN 'V2_1' WHEN room_version = '12.1' THEN 'V2_1_1' END AS version FROM rv""")
def version_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir).where("seq = 0")
    name = F.concat((F.col("room_id") % 14).cast("string"), F.when(F.col("room_id") % 28 >= 14, ".1").otherwise(""))
    return e.select("room_id", name.alias("room_version")).withColumn("version", c.version_of(F.col("room_version")))


@query(""", pl AS (SELECT e.event_id, min(p.event_id) AS pl FROM ev e JOIN auth x ON x.child = e.event_id JOIN ev p ON p.event_id = x.parent AND p.type = 'm.room.power_levels' GROUP BY ALL)
SELECT e.room_id, e.event_id, CAST(CASE WHEN pl IS NULL THEN 0 WHEN e.sender = '@u0:x' THEN 100 WHEN e.sender = '@u1:x' THEN p.mod_level ELSE 0 END AS BIGINT) AS level
FROM ev e LEFT JOIN pl USING (event_id) LEFT JOIN ev p ON p.event_id = pl""")
def sender_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sender's level by the first power-levels event among its direct authority."""
    x = Graph(spark, sf_dir)
    levels = x.events.where("type = 'm.room.power_levels' AND state_key = ''").select(F.col("event_id").alias("parent"), F.create_map(F.lit("@u0:x"), F.lit(100).cast("long"), F.lit("@u1:x"), F.col("mod_level")).alias("users"))
    return o.auth_levels(x.events, x.auth, levels, F.lit(0).cast("long"))


_FIXED = """, st AS (SELECT room_id, type, state_key, arg_max(event_id, depth * 1000000000 + event_id) AS event_id FROM ev WHERE state_key IS NOT NULL GROUP BY ALL),
pl AS (SELECT st.room_id, ev.mod_level FROM st JOIN ev USING (event_id) WHERE st.type = 'm.room.power_levels'),
mem AS (SELECT st.room_id, st.state_key AS user, ev.membership FROM st JOIN ev USING (event_id) WHERE st.type = 'm.room.member'),
lv AS (SELECT u.room_id, u.user, CAST(CASE u.user WHEN '@u0:x' THEN 100 WHEN '@u1:x' THEN mod_level ELSE 0 END AS BIGINT) AS level FROM (SELECT room_id, sender AS user FROM ev UNION SELECT room_id, state_key FROM ev WHERE type = 'm.room.member') u JOIN pl USING (room_id))"""


def _fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Typed events of all rooms, and each room's last state as typed rows."""
    rows = c.typed(d.records(spark, sf_dir)).withColumn("n_prev", F.size("prev_events")).withColumn("n_auth", F.size("auth_events"))
    last = s.last_per_key(rows).select("room_id", "event_id")
    return rows, rows.join(last, ["room_id", "event_id"], "left_semi")


@query(_FIXED + " SELECT DISTINCT room_id, user, level, level >= 0 AS can_invite, level >= 50 AS can_ban, level >= 50 AS can_kick, level >= 50 AS can_redact FROM lv JOIN (SELECT DISTINCT room_id, sender AS user FROM ev) USING (room_id, user)")
def threshold_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sender's level suffices for in the room's last state."""
    rows, state = _fixed(spark, sf_dir)
    users = rows.select("room_id", "sender").distinct()
    blank = {n: F.lit(None).cast("string") for n in ("state_key", "tpi_token", "join_authorised_via_users_server")}
    joined = a.joined(users.withColumns(blank), state)
    level = a.level_of(F.col("sender"), "V2")
    can = [(level >= a.threshold(x)).alias(f"can_{x}") for x in ("invite", "ban", "kick", "redact")]
    return joined.select("room_id", F.col("sender").alias("user"), level.alias("level"), *can)


@query(_FIXED + """ SELECT e.room_id, e.event_id, CAST(CASE WHEN e.state_key IS NULL THEN 0 ELSE 50 END AS BIGINT) AS required FROM ev e""")
def required_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, state = _fixed(spark, sf_dir)
    return a.joined(rows, state).select("room_id", F.substring("event_id", 2, 20).cast("long").alias("event_id"), a.required().alias("required"))


@query(_FIXED + """, j AS (SELECT e.*, coalesce(me.membership, CASE WHEN e.sender = '@u0:x' THEN 'join' ELSE 'leave' END) AS role, coalesce(tt.membership, '') AS now, coalesce(l.level, 0) AS mine, coalesce(tl.level, 0) AS theirs,
    (SELECT count(*) FROM prev WHERE child = e.event_id) AS n_prev
  FROM ev e LEFT JOIN mem me ON me.room_id = e.room_id AND me.user = e.sender LEFT JOIN mem tt ON e.type = 'm.room.member' AND tt.room_id = e.room_id AND tt.user = e.state_key
  LEFT JOIN lv l ON l.room_id = e.room_id AND l.user = e.sender LEFT JOIN lv tl ON e.type = 'm.room.member' AND tl.room_id = e.room_id AND tl.user = e.state_key),
v AS (SELECT *, CASE WHEN type = 'm.room.create' THEN CASE WHEN n_prev > 0 THEN 'CreateWithPrevEvents' END
  WHEN role = 'ban' THEN 'BannedUser'
  WHEN role <> 'join' AND NOT (type = 'm.room.member' AND state_key = sender AND membership <> 'ban') THEN 'NotMember'
  WHEN type = 'm.room.member' AND membership = 'join' THEN CASE WHEN state_key <> sender THEN 'InvalidStateKey' WHEN now = 'ban' THEN 'BannedUser' END
  WHEN type = 'm.room.member' AND membership = 'ban' THEN CASE WHEN state_key = sender THEN 'InvalidStateKey' WHEN mine < 50 THEN 'InsufficientPowerLevel' WHEN mine <= theirs THEN 'InsufficientPowerLevel' END
  WHEN type <> 'm.room.member' AND mine < CASE WHEN state_key IS NULL THEN 0 ELSE 50 END THEN 'InsufficientPowerLevel' END AS code FROM j)
SELECT room_id, event_id, code, CAST(CASE WHEN code = 'InsufficientPowerLevel' THEN CASE WHEN type = 'm.room.member' AND mine >= 50 THEN theirs + 1 ELSE 50 END END AS BIGINT) AS required,
  CASE WHEN code = 'InsufficientPowerLevel' THEN mine END AS actual FROM v""")
def auth_check_fixed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, state = _fixed(spark, sf_dir)
    return a.verdicts(rows, state, "V2").withColumn("event_id", F.substring("event_id", 2, 20).cast("long"))


_LINE = """, line AS (SELECT room_id, arg_max(event_id, depth * 1000000000 + event_id) AS event_id, 0 AS pos FROM ev WHERE type = 'm.room.power_levels' GROUP BY room_id
UNION SELECT l.room_id, p.event_id, l.pos + 1 FROM line l JOIN auth x ON x.child = l.event_id JOIN ev p ON p.event_id = x.parent AND p.type = 'm.room.power_levels'),
len AS (SELECT room_id, count(*) AS n FROM line GROUP BY room_id),
up AS (SELECT room_id, event_id AS member, event_id, pos FROM line UNION SELECT u.room_id, u.member, x.child, u.pos FROM up u JOIN auth x ON x.parent = u.event_id WHERE x.child NOT IN (SELECT event_id FROM line)),
pos AS (SELECT ev.room_id, ev.event_id, coalesce(min(up.pos), any_value(n)) AS position FROM ev JOIN len USING (room_id) LEFT JOIN up USING (room_id, event_id) GROUP BY ALL)"""


@query(_LINE + " SELECT * FROM pos")
def mainline_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return o.mainline_positions(x.events, x.auth, s.last_per_key(x.events))


@query(_LINE + """ SELECT room_id, event_id, row_number() OVER (PARTITION BY room_id ORDER BY position DESC, ts, event_id) AS pos
FROM pos JOIN ev USING (room_id, event_id) WHERE type NOT IN ('m.room.create', 'm.room.power_levels', 'm.room.join_rules', 'm.room.member')""")
def mainline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    at = o.mainline_positions(x.events, x.auth, s.last_per_key(x.events))
    rest = x.events.where(~c.is_power("V2")).join(at, ["room_id", "event_id"])
    return rest.select("room_id", "event_id", F.row_number().over(Window.partitionBy("room_id").orderBy(F.desc("position"), "ts", "event_id")).cast("long").alias("pos"))


@query(_LINE + """ SELECT room_id, type, state_key, arg_max(event_id, (n - position) * 10000000000000000000000 + CAST(ts AS HUGEINT) * 100000000 + event_id) AS event_id
FROM pos JOIN ev USING (room_id, event_id) JOIN len USING (room_id) WHERE state_key IS NOT NULL AND type NOT IN ('m.room.create', 'm.room.power_levels', 'm.room.join_rules', 'm.room.member') GROUP BY ALL""")
def lattice_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best event for each key: least mainline position, then latest, then largest id."""
    x = Graph(spark, sf_dir)
    at = o.mainline_positions(x.events, x.auth, s.last_per_key(x.events))
    return o.lattice_winners(x.events.where(~c.is_power("V2")).join(at, ["room_id", "event_id"]))


_PRIORITY = "row_number() OVER (PARTITION BY room_id ORDER BY CASE type WHEN 'm.room.power_levels' THEN 0 WHEN 'm.room.join_rules' THEN 1 ELSE 2 END, ts, event_id)"


@query(f" SELECT room_id, event_id, {_PRIORITY} AS pos FROM ev")
def cdo_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir).withColumn("power_level", F.lit(0))
    return o.by_priority(e).select("room_id", "event_id", "pos")


@query(" SELECT room_id, event_id, row_number() OVER (PARTITION BY room_id ORDER BY depth, event_id) AS pos FROM ev")
def depth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir)
    return e.select("room_id", "event_id", F.row_number().over(Window.partitionBy("room_id").orderBy("depth", "event_id")).cast("long").alias("pos"))


@query(PARTITION + f""", ids AS (SELECT DISTINCT room_id, event_id FROM part WHERE is_conflicted),
con AS (SELECT room_id, ev.*  EXCLUDE (room_id), {_PRIORITY} AS pos, {_FLAGS} AS removes FROM ids JOIN ev USING (room_id, event_id)),
edges AS (SELECT child, parent FROM prev UNION SELECT child, parent FROM auth),
down AS (SELECT event_id AS x, event_id AS y FROM con UNION SELECT d.x, e.parent FROM down d JOIN edges e ON e.child = d.y)
SELECT t.room_id, p.event_id AS admin, t.event_id FROM con p JOIN con t ON t.room_id = p.room_id AND p.pos < t.pos
WHERE ((p.removes AND p.state_key = t.sender) OR (p.type = 'm.room.power_levels' AND p.mod_level = 0 AND t.sender = '@u1:x'))
  AND NOT EXISTS (SELECT 1 FROM down d WHERE (d.x = p.event_id AND d.y = t.event_id) OR (d.x = t.event_id AND d.y = p.event_id))""")
def domination_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputed events and the concurrent admin actions of higher priority that bear on them."""
    x = Graph(spark, sf_dir)
    disputed = x.events.join(x.disputed(), ["room_id", "event_id"], "left_semi").withColumn("power_level", F.lit(0))
    disputed = disputed.withColumn("demoted", F.when(F.col("mod_level") == 0, F.array(F.lit("@u1:x"))).otherwise(F.array().cast("array<string>")))
    both = x.prev.select("room_id", "child", "parent").union(x.auth.select("room_id", "child", "parent"))
    return o.domination_candidates(disputed, both)


