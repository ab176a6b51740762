"""Report builders: summaries, timeline text, names, source scores, lints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content as c

#: The order of memberships in a summary, and the kinds of events that may authorize.
MEMBERSHIPS = ("join", "invite", "knock", "leave", "ban")
AUTH_KINDS = ("m.room.create", "m.room.member", "m.room.power_levels", "m.room.join_rules", "m.room.third_party_invite")


def membership(state: DataFrame, events: DataFrame) -> DataFrame:
    """room_id, membership, members, users (sorted, comma-joined) of a state's member entries."""
    members = state.where("type = 'm.room.member'").select("room_id", "event_id", F.col("state_key").alias("user"))
    rows = members.join(events.select("room_id", "event_id", F.coalesce("membership", F.lit("unknown")).alias("membership")), ["room_id", "event_id"])
    return rows.groupBy("room_id", "membership").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("user")), ",").alias("users"))


def scalars(events: DataFrame, state: DataFrame, chain: DataFrame, components: DataFrame) -> DataFrame:
    """One row a room: sizes, depths, root, number of components. chain: room_id, event_id of the state's authority."""
    base = events.groupBy("room_id").agg(F.count("*").alias("total_events"), F.min("depth").cast("long").alias("min_depth"), F.max("depth").cast("long").alias("max_depth"), F.min_by("event_id", F.struct("depth", "event_id")).alias("root_event_id"))
    size = state.groupBy("room_id").agg(F.count("*").alias("state_size"))
    chain = chain.groupBy("room_id").agg(F.countDistinct("event_id").alias("auth_chain_size"))
    groups = components.groupBy("room_id").agg(F.countDistinct("root").alias("n_components"))
    return base.join(size, "room_id", "left").join(chain, "room_id", "left").join(groups, "room_id", "left").fillna(0, ["state_size", "auth_chain_size", "n_components"])


def names(events: DataFrame) -> DataFrame:
    """room_id, user, displayname: the last non-empty name that a member event gives, by depth, then id."""
    given = events.where("type = 'm.room.member' AND displayname <> ''")
    return given.groupBy("room_id", F.coalesce("state_key", F.lit("")).alias("user")).agg(F.max_by("displayname", F.struct("depth", "event_id")).alias("displayname"))


def display_names(events: DataFrame) -> DataFrame:
    """room_id, user, name of everyone who sends or is a member: the given name, or the id's local part."""
    users = events.select("room_id", F.col("sender").alias("user")).union(events.where("type = 'm.room.member' AND state_key IS NOT NULL").select("room_id", "state_key")).distinct()
    out = users.join(names(events), ["room_id", "user"], "left")
    return out.select("room_id", "user", F.coalesce("displayname", c.display_fallback(F.col("user"))).alias("name"))


def _text(name: str, otherwise: str) -> Column:
    return F.coalesce(c.text(F.try_parse_json(F.col("content")), f"$.{name}"), F.lit(otherwise))


def line(sender: Column, target: Column) -> Column:
    """What an event says in a timeline; null for reactions."""
    kind, role = F.col("type"), F.coalesce("membership", F.lit("?"))
    why = _text("reason", "")
    reason = F.when(why == "", "").otherwise(F.concat(F.lit(" "), why))
    says = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    member = (
        F.when(role == "join", says(target, " joined the room"))
        .when((role == "leave") & (F.col("state_key") == F.col("sender")), says(target, " left the room"))
        .when(role == "leave", says(sender, " kicked ", target, reason))
        .when(role == "ban", says(sender, " banned ", target, reason))
        .when(role == "invite", says(sender, " invited ", target))
        .when(role == "knock", says(target, " knocked"))
        .otherwise(says(sender, " set ", target, "'s membership to ", role))
    )
    form = _text("msgtype", "m.text")
    message = F.when(form.isin("m.text", "m.notice"), says(sender, ": ", _text("body", ""))).when(form == "m.emote", says("* ", sender, " ", _text("body", "")))
    for key, what in (("m.image", "an image"), ("m.video", "a video"), ("m.audio", "an audio file"), ("m.file", "a file")):
        message = message.when(form == key, says(sender, f" sent {what}"))
    return (
        F.when(kind == "m.room.member", member)
        .when(kind == "m.room.message", message.otherwise(says(sender, " sent ", form)))
        .when(kind == "m.room.name", says(sender, ' changed room name to "', _text("name", "?"), '"'))
        .when(kind == "m.room.topic", says(sender, ' changed room topic to "', _text("topic", "?"), '"'))
        .when(kind == "m.room.avatar", says(sender, " changed room avatar"))
        .when(kind == "m.room.redaction", says(sender, " redacted an event"))
        .when(kind == "m.reaction", F.lit(None).cast("string"))
        .when(kind == "m.sticker", says(sender, " sent a sticker"))
        .otherwise(says(sender, " sent ", kind, " state event"))
    )


def timeline(events: DataFrame) -> DataFrame:
    """room_id, event_id, line, date, starts: each event's text, its minute, and whether that differs from the one before."""
    given = names(events)
    out = events.join(given.select("room_id", F.col("user").alias("sender"), F.col("displayname").alias("sender_name")), ["room_id", "sender"], "left")
    out = out.join(given.select("room_id", F.col("user").alias("state_key"), F.col("displayname").alias("target_name")), ["room_id", "state_key"], "left")
    sender = F.coalesce("sender_name", c.display_fallback(F.col("sender")))
    target = F.coalesce("target_name", c.display_fallback(F.coalesce("state_key", F.lit(""))))
    out = out.withColumn("line", line(sender, target)).where(F.col("line").isNotNull()).withColumn("date", c.clock(F.col("origin_server_ts")))
    before = F.lag("date").over(Window.partitionBy("room_id").orderBy("depth", "event_id"))
    return out.select("room_id", "event_id", "line", "date", F.coalesce(before != F.col("date"), F.lit(True)).alias("starts"))


def histogram(records: DataFrame) -> DataFrame:
    """room_id, type, n, with_auth, with_prev, senders."""
    has = lambda name: F.sum((F.size(name) > 0).cast("long"))
    return records.groupBy("room_id", "type").agg(F.count("*").alias("n"), has("auth_events").alias("with_auth"), has("prev_events").alias("with_prev"), F.countDistinct("sender").alias("senders"))


def scores(known: DataFrame, truth: DataFrame, sources: int) -> DataFrame:
    """src, users, hits, precision, recall and F1 in millionths, and the place by F1. known: src, user (distinct); truth: user."""
    spark = known.sparkSession
    every = spark.range(sources).select(F.col("id").cast("int").alias("src"))
    marked = known.join(truth.withColumn("hit", F.lit(1)), "user", "left")
    per = every.join(marked, "src", "left").groupBy("src").agg(F.count("user").alias("users"), F.count("hit").alias("hits"))
    per = per.crossJoin(F.broadcast(truth.agg(F.count("*").alias("truths"))))  # one row
    share = lambda top, below: F.when(below == 0, 0.0).otherwise(top * 1e6 / below)
    f1 = F.when(F.col("users") == 0, 0.0).otherwise(F.col("hits") * 2e6 / (F.col("users") + F.col("truths")))
    place = F.row_number().over(Window.orderBy(f1.desc(), "src"))  # a row for each source
    return per.select("src", "users", "hits", F.round(share(F.col("hits"), F.col("users"))).cast("long").alias("precision_ppm"), F.round(share(F.col("hits"), F.col("truths"))).cast("long").alias("recall_ppm"), F.round(f1).cast("long").alias("f1_ppm"), place.cast("long").alias("place"))


def greedy_cover(spark: SparkSession, tagged: DataFrame) -> DataFrame:
    """pick, src, adds: sources by what each adds to those before, until nothing is left. tagged: src, event_id.

    A round counts, per source, the ids not yet covered; only the counts, a row for each source, come to the driver.
    """
    ids, left, picks = tagged.distinct().cache(), None, []
    try:
        left = ids
        while (best := left.groupBy("src").agg(F.count("*").alias("adds")).orderBy(F.desc("adds"), "src").first()) is not None:
            picks.append((len(picks), best["src"], best["adds"]))
            done = ids.where(F.col("src").isin([p[1] for p in picks])).select("event_id")
            left = ids.join(done, "event_id", "left_anti")
    finally:
        ids.unpersist()
    return spark.createDataFrame(picks, "pick int, src int, adds long")


def compared(ours: DataFrame, oracle: DataFrame, events: DataFrame) -> DataFrame:
    """room_id, outcome, entries: how a resolved state stands to another one of the same keys.

    same; absent: the other's event is not among the events, so that ours could not be the same; differs; added: a key of
    ours alone; lost: a key of the other's alone, whose event is among the events.
    """
    key = ["room_id", "type", "state_key"]
    known = events.select("room_id", F.col("event_id").alias("theirs"), F.lit(True).alias("known"))
    both = ours.select(*key, F.col("event_id").alias("ours")).join(oracle.select(*key, F.col("event_id").alias("theirs")), key, "full_outer").join(known, ["room_id", "theirs"], "left")
    outcome = F.when(F.col("theirs").isNull(), "added").when(F.col("ours") == F.col("theirs"), "same").when(F.col("known").isNull(), "absent").when(F.col("ours").isNull(), "lost").otherwise("differs")
    return both.groupBy("room_id", outcome.alias("outcome")).agg(F.count("*").alias("entries"))


def unlike(ours: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two outputs has, with side (ours or other); none if they are the same."""
    a, b = ours.select(*columns), other.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("ours")).unionByName(b.exceptAll(a).withColumn("side", F.lit("other")))


def accuracy(states: DataFrame, canonical: DataFrame, by: str = "src") -> DataFrame:
    """by, hits, accuracy_ppm: the share of the canonical state's ids that each state has, in millionths."""
    total = canonical.select("event_id").distinct().agg(F.count("*").alias("total"))
    hits = states.select(by, "event_id").distinct().join(canonical.select("event_id").distinct(), "event_id", "left_semi").groupBy(by).agg(F.count("*").alias("hits"))
    out = states.select(by).distinct().join(hits, by, "left").crossJoin(F.broadcast(total))  # one row
    return out.select(by, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.round(F.coalesce("hits", F.lit(0)) * 1e6 / F.col("total")).cast("long").alias("accuracy_ppm"))


def auth_lint(events: DataFrame, auth: DataFrame, version: str) -> DataFrame:
    """room_id, event_id, auth_id, severity of auth events that a version does not expect."""
    kinds = events.select("room_id", F.col("event_id").alias("parent"), F.col("type").alias("kind"))
    late = F.lit(version in c.MODERN) & (F.col("kind") == "m.room.create")
    out = auth.join(kinds, ["room_id", "parent"]).where(late | ~F.col("kind").isin(*AUTH_KINDS))
    return out.select("room_id", F.col("child").alias("event_id"), F.col("parent").alias("auth_id"), F.when(late, "error").otherwise("warning").alias("severity"))


def detect_versions(events: DataFrame, order: str) -> DataFrame:
    """room_id, room_version, version by the first create event that names a room version."""
    made = events.where("type = 'm.room.create' AND room_version IS NOT NULL")
    return made.groupBy("room_id").agg(F.min_by("room_version", order).alias("room_version")).withColumn("version", c.version_of(F.col("room_version")))
