"""Reports, rankings, lints and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content as c
from ..operators import graph as g
from ..operators import reports as r
from ..operators import state as s
from ..sources import derived as d
from .graphs import CLOSURE, Graph
from .registry import query
from .states import _SRC, _sources

_LAST = ", st AS (SELECT room_id, type, state_key, arg_max(event_id, depth * 1000000000 + event_id) AS event_id FROM ev WHERE state_key IS NOT NULL GROUP BY ALL)"


@query(_LAST + " SELECT st.room_id, membership, count(*) AS members, string_agg(st.state_key, ',' ORDER BY st.state_key) AS users FROM st JOIN ev USING (event_id) WHERE st.type = 'm.room.member' GROUP BY ALL")
def summary_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir)
    return r.membership(s.last_per_key(e), e)


@query(_LAST + CLOSURE + """, size AS (SELECT room_id, count(*) AS state_size FROM st GROUP BY ALL),
ch AS (SELECT cl.room_id, count(DISTINCT ancestor_id) AS auth_chain_size FROM cl JOIN st ON st.event_id = cl.event_id GROUP BY ALL)
SELECT ev.room_id, count(*) AS total_events, any_value(state_size) AS state_size, any_value(auth_chain_size) AS auth_chain_size, CAST(min(depth) AS BIGINT) AS min_depth, CAST(max(depth) AS BIGINT) AS max_depth,
  arg_min(event_id, depth * 1000000000 + event_id) AS root_event_id, CAST(1 AS BIGINT) AS n_components FROM ev JOIN size USING (room_id) JOIN ch USING (room_id) GROUP BY ev.room_id""")
def summary_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    edges = x.prev.select("room_id", "child", "parent").union(x.auth.select("room_id", "child", "parent"))
    state = s.last_per_key(x.events)
    return r.scalars(x.events, state, g.reachable(x.auth, state, strict=True), g.components(x.events, edges))


@query(""", txt AS (SELECT room_id, event_id, depth, ts, sender, CASE type
  WHEN 'm.room.create' THEN ltrim(split_part(sender, ':', 1), '@') || ' sent m.room.create state event'
  WHEN 'm.room.member' THEN CASE membership WHEN 'join' THEN ltrim(split_part(state_key, ':', 1), '@') || ' joined the room' ELSE ltrim(split_part(sender, ':', 1), '@') || ' banned ' || ltrim(split_part(state_key, ':', 1), '@') END
  WHEN 'm.room.message' THEN ltrim(split_part(sender, ':', 1), '@') || ': '
  WHEN 'm.room.topic' THEN ltrim(split_part(sender, ':', 1), '@') || ' changed room topic to "?"'
  ELSE ltrim(split_part(sender, ':', 1), '@') || ' sent ' || type || ' state event' END AS line,
  strftime(make_timestamp(ts * 1000), '%-d %b %Y %I:%M %p') AS date FROM ev)
SELECT room_id, event_id, line, date, coalesce(lag(date) OVER (PARTITION BY room_id ORDER BY depth, event_id) <> date, true) AS starts FROM txt""")
def timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.typed(d.records(spark, sf_dir))
    return r.timeline(rows).withColumn("event_id", F.substring("event_id", 2, 20).cast("long"))


@query(" SELECT room_id, user, ltrim(split_part(user, ':', 1), '@') AS name FROM (SELECT room_id, sender AS user FROM ev UNION SELECT room_id, state_key FROM ev WHERE type = 'm.room.member')")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.display_names(c.typed(d.records(spark, sf_dir)))


@query(" SELECT room_id, type, count(*) AS n, CAST(count(*) FILTER (event_id IN (SELECT child FROM auth)) AS BIGINT) AS with_auth, CAST(count(*) FILTER (event_id IN (SELECT child FROM prev)) AS BIGINT) AS with_prev, count(DISTINCT sender) AS senders FROM ev GROUP BY ALL")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.histogram(d.records(spark, sf_dir))


_F1 = _SRC + """, names AS (SELECT DISTINCT CAST(src AS INTEGER) AS src, room_id || '/' || state_key AS user FROM src WHERE membership = 'join'), truth AS (SELECT DISTINCT room_id || '/' || state_key AS user FROM ev WHERE membership = 'join'),
got AS (SELECT 0 AS src UNION ALL SELECT 1 UNION ALL SELECT 2),
f AS (SELECT got.src, count(names.user) AS users, count(truth.user) AS hits, (SELECT count(*) FROM truth) AS truths FROM got LEFT JOIN names USING (src) LEFT JOIN truth ON truth.user = names.user GROUP BY got.src)"""


@query(_F1 + """ SELECT src, users, hits, CAST(round(CASE WHEN users = 0 THEN 0 ELSE hits * 1e6 / users END) AS BIGINT) AS precision_ppm, CAST(round(hits * 1e6 / truths) AS BIGINT) AS recall_ppm,
  CAST(round(CASE WHEN users = 0 THEN 0 ELSE 2e6 * hits / (users + truths) END) AS BIGINT) AS f1_ppm, row_number() OVER (ORDER BY CASE WHEN users = 0 THEN 0 ELSE 2e6 * hits / (users + truths) END DESC, src) AS place FROM f""")
def source_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each partial copy knows who has ever joined, against the whole table."""
    e = d.events(spark, sf_dir)
    user = F.concat(F.col("room_id").cast("string"), F.lit("/"), F.col("state_key")).alias("user")
    truth = e.where("membership = 'join'").select(user).distinct()
    copies = [e.join(x.select("event_id"), "event_id", "left_semi").where("membership = 'join'").select(F.lit(k).alias("src"), user) for k, x in enumerate(_sources(spark, sf_dir))]
    return r.scores(copies[0].unionByName(copies[1]).unionByName(copies[2]).distinct(), truth, 3)


@query(_SRC + """, tg AS (SELECT DISTINCT CAST(src AS INTEGER) AS src, event_id FROM src),
p0 AS (SELECT src, count(*) AS adds FROM tg GROUP BY 1 ORDER BY adds DESC, src LIMIT 1),
l1 AS (SELECT * FROM tg WHERE event_id NOT IN (SELECT event_id FROM tg JOIN p0 USING (src))), p1 AS (SELECT src, count(*) AS adds FROM l1 GROUP BY 1 ORDER BY adds DESC, src LIMIT 1),
l2 AS (SELECT * FROM l1 WHERE event_id NOT IN (SELECT event_id FROM l1 JOIN p1 USING (src))), p2 AS (SELECT src, count(*) AS adds FROM l2 GROUP BY 1 ORDER BY adds DESC, src LIMIT 1)
SELECT CAST(0 AS INTEGER) AS pick, src, adds FROM p0 UNION ALL SELECT 1, src, adds FROM p1 UNION ALL SELECT 2, src, adds FROM p2""")
def source_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial copies picked greedily until all events are covered, and what each adds."""
    tagged = [x.select(F.lit(k).alias("src"), "event_id") for k, x in enumerate(_sources(spark, sf_dir))]
    return r.greedy_cover(spark, tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))


@query(" SELECT event_id, '$' || rtrim(translate(to_base64(unhex(sha256(j))), '+/', '-_'), '=') AS content_id FROM (SELECT event_id, '{\"depth\":' || depth || ',\"sender\":\"' || sender || '\",\"type\":\"' || type || '\"}' AS j FROM ev)")
def event_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir)
    text = F.concat(F.lit('{"depth":'), F.col("depth").cast("string"), F.lit(',"sender":"'), "sender", F.lit('","type":"'), "type", F.lit('"}'))
    return e.select("event_id", c.content_id(text).alias("content_id"))


@query(" SELECT room_id, type, state_key, arg_min(event_id, event_id - depth * 1000000000) AS event_id FROM ev WHERE state_key IS NOT NULL GROUP BY ALL")
def oracle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key the event of the greatest depth, the first of equals."""
    state = d.events(spark, sf_dir).where(F.col("state_key").isNotNull())
    return state.groupBy("room_id", "type", "state_key").agg(F.max_by("event_id", F.struct(F.col("depth"), -F.col("event_id"))).alias("event_id"))


@query(_SRC + " SELECT depth, count(*) AS shared FROM (SELECT event_id, depth FROM src GROUP BY ALL HAVING count(*) > 1) GROUP BY depth ORDER BY depth DESC LIMIT 5")
def highest_shared_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-5 report: the greatest depths at which the copies share events."""
    e = d.events(spark, sf_dir).select("event_id", "depth")
    tagged = [x.select("event_id") for x in _sources(spark, sf_dir)]
    shared = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("event_id").count().where("count > 1")
    return shared.join(e, "event_id").groupBy("depth").agg(F.count("*").alias("shared")).orderBy(F.desc("depth")).limit(5)


@query(" SELECT parent AS event_id, count(*) AS refs FROM auth GROUP BY ALL ORDER BY refs DESC, event_id LIMIT 5")
def strongest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-5 report: the events that most others rely on."""
    return Graph(spark, sf_dir).auth.groupBy(F.col("parent").alias("event_id")).agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "event_id").limit(5)


_KINDS = "('m.room.create', 'm.room.member', 'm.room.power_levels', 'm.room.join_rules', 'm.room.third_party_invite')"


@query(f" SELECT x.room_id, x.child AS event_id, x.parent AS auth_id, CASE WHEN p.type = 'm.room.create' THEN 'error' ELSE 'warning' END AS severity FROM auth x JOIN ev p ON p.event_id = x.parent WHERE p.type = 'm.room.create' OR p.type NOT IN {_KINDS}")
def auth_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    return r.auth_lint(x.events, x.auth, "V2_1")


@query(", a AS (SELECT room_id, '11' AS room_version FROM ev WHERE type = 'm.room.create') SELECT room_id, room_version, 'V2' AS version FROM a")
def version_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.detect_versions(c.typed(d.records(spark, sf_dir)), "depth")


@query(_LAST + CLOSURE + """ SELECT room_id, 'state' AS part, event_id FROM st
UNION ALL SELECT DISTINCT cl.room_id, 'auth_chain', ancestor_id FROM cl JOIN st ON st.event_id = cl.event_id""")
def federation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Graph(spark, sf_dir)
    state = s.last_per_key(x.events)
    chain = g.reachable(x.auth, state, strict=True).select("room_id", "event_id")
    return state.select("room_id", F.lit("state").alias("part"), "event_id").unionAll(chain.select("room_id", F.lit("auth_chain").alias("part"), "event_id"))


@query(_LAST + " SELECT st.room_id, st.event_id, ev.sender, row_number() OVER (PARTITION BY st.room_id ORDER BY ev.depth, st.event_id) AS pos FROM st JOIN ev USING (event_id)")
def events_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.events(spark, sf_dir)
    rows = s.last_per_key(e).select("room_id", "event_id").join(e.select("room_id", "event_id", "sender", "depth"), ["room_id", "event_id"])
    return rows.select("room_id", "event_id", "sender", F.row_number().over(Window.partitionBy("room_id").orderBy("depth", "event_id")).cast("long").alias("pos"))
