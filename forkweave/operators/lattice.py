"""The per-key fold as joins: authority looked up, checked and reduced for all disputed events of all rooms at once.

Only the ordered power phase runs in a kernel; what follows does not depend on an order: each event's authority is the
settled state's, else its own direct one, the verdicts are joins, and each key's best event is one aggregate.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content as c
from . import auth as a
from . import graph as g
from . import order as o
from . import resolve as r
from . import state as s


def edges(records: DataFrame, column: str) -> DataFrame:
    """room_id, child, parent, ord of an edge list column."""
    return records.select("room_id", F.col("event_id").alias("child"), F.posexplode(column).alias("ord", "parent")).select("room_id", "child", "parent", "ord")


def disputed(records: DataFrame) -> DataFrame:
    """room_id, event_id of the entries that a room's heads do not agree on."""
    prev = edges(records, "prev_events")
    met = g.chains(prev, g.heads(records, prev), reflexive=True).withColumnRenamed("start", "head")
    last = s.last_per_key(met.join(records.select("room_id", "event_id", "type", "state_key", "depth"), ["room_id", "event_id"]), "room_id", "head")
    return s.partition(last, "head").where("is_conflicted").select("room_id", "event_id").distinct()


#: What a check looks up, and the columns it reads there: names as in auth.joined().
_READS = {
    "cr": ["sender", "additional_creators"],
    "pl": ["users", "events", "users_default", "events_default", "state_default", "ban", "kick", "invite", "redact"],
    "jr": ["join_rule"],
    "me": ["membership"],
    "to": ["membership"],
    "by": ["membership"],
    "ti": ["sender"],
}


def authority(events: DataFrame, rows: DataFrame, settled: DataFrame) -> DataFrame:
    """events with what each one's authority says, as auth.joined() has it: each key as settled, else by direct authority.

    One row for each event and key is looked up, and one aggregate brings them back to the event. rows are records: content
    is read where it was looked up, not in all of them.
    """
    key = lambda role, kind, k: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("type"), k.cast("string").alias("state_key"))
    member = F.when(F.col("type") == "m.room.member", F.col("state_key"))
    wanted = [key("cr", "m.room.create", F.lit("")), key("pl", "m.room.power_levels", F.lit("")), key("jr", "m.room.join_rules", F.lit("")), key("me", "m.room.member", F.col("sender")), key("to", "m.room.member", member)]
    wanted += [key("by", "m.room.member", F.col("join_authorised_via_users_server")), key("ti", "m.room.third_party_invite", F.col("tpi_token"))]
    keys = events.select("room_id", "event_id", F.explode(F.filter(F.array(*wanted), lambda k: k["state_key"].isNotNull())).alias("k")).select("room_id", "event_id", "k.role", "k.type", "k.state_key")
    held = keys.join(settled.select("room_id", "type", "state_key", F.col("event_id").alias("settled")), ["room_id", "type", "state_key"], "left")
    kinds = rows.where("state_key IS NOT NULL").select("room_id", F.col("event_id").alias("parent"), "type", "state_key")
    own = edges(events, "auth_events").join(kinds, ["room_id", "parent"]).groupBy("room_id", F.col("child").alias("event_id"), "type", "state_key").agg(F.min_by("parent", "ord").alias("own"))
    held = held.join(own, ["room_id", "event_id", "type", "state_key"], "left")
    held = held.select("room_id", "event_id", "role", F.coalesce("settled", "own").alias("holder")).where("holder IS NOT NULL")
    read = sorted({c for cols in _READS.values() for c in cols})
    held = c.typed(held.join(rows.select("room_id", F.col("event_id").alias("holder"), "sender", "content"), ["room_id", "holder"]))
    held = held.select("room_id", "event_id", "role", F.struct(*read).alias("said"))
    said = held.groupBy("room_id", "event_id").agg(*[F.first(F.when(F.col("role") == role, F.col("said")), ignorenulls=True).alias(f"said_{role}") for role in _READS])
    out = events.join(said, ["room_id", "event_id"], "left")
    columns = {f"{role}_is": F.when(F.col(f"said_{role}").isNotNull(), F.lit(True)) for role in _READS}
    columns |= {f"{role}_{c}": F.col(f"said_{role}.{c}") for role, cols in _READS.items() for c in cols}
    return out.withColumns(columns).drop(*[f"said_{role}" for role in _READS])


def fold(records: DataFrame, version: str) -> DataFrame:
    """room_id, type, state_key, event_id: as resolve.lattice(), for V1 and V2, whose checks see the settled state first.

    Nine joins read the records: they are persisted, without the content of messages, so that what they come from is
    worked out once. So are the power phase's result and the disputed events, a few rows of each room.
    """
    if version not in ("V1", "V2"):
        raise ValueError(f"{version} hides parts of the settled state from its checks: use resolve.lattice()")
    records = r.lean(records).persist(StorageLevel.MEMORY_AND_DISK)
    settled = r.power_phase(records, version).persist()
    open_ = c.typed(records.join(disputed(records), ["room_id", "event_id"], "left_semi")).withColumn("n_prev", F.size("prev_events")).withColumn("n_auth", F.size("auth_events")).persist()
    power = open_.where(c.is_power(version)).select("room_id", "event_id")
    if version != "V1":  # with what it depends on
        inside = edges(open_, "auth_events").join(open_.select("room_id", F.col("event_id").alias("parent")), ["room_id", "parent"], "left_semi")
        power = g.reachable(inside, power).select("room_id", "event_id")
    rest = open_.join(power, ["room_id", "event_id"], "left_anti").persist()
    fits = a.judged(authority(rest, records, settled), version).where("code IS NULL").select("room_id", "event_id")
    places = o.mainline_positions(records.select("room_id", "event_id", "type"), edges(records, "auth_events"), settled)
    slim = rest.select("room_id", "event_id", "type", "state_key", F.col("origin_server_ts").alias("ts"))
    best = slim.join(fits, ["room_id", "event_id"], "left_semi").join(places, ["room_id", "event_id"])
    # the settled state under each key's best event, in one aggregate: an overlay would make the best events twice
    both = settled.withColumn("best", F.lit(0)).unionByName(o.lattice_winners(best).withColumn("best", F.lit(1)))
    return both.groupBy(*s.KEY).agg(F.max_by("event_id", "best").alias("event_id"))
