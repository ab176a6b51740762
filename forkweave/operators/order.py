"""Orders and rankings: levels by direct authority, mainline positions, per-key winners, domination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content as c
from .rooms import by_room


def auth_levels(events: DataFrame, auth: DataFrame, levels: DataFrame, otherwise: Column) -> DataFrame:
    """room_id, event_id, level of each sender by the first of levels (parent, users) among its direct authority.

    A sender that the levels do not list has 0; without levels, `otherwise`.
    """
    first = auth.join(levels, "parent").groupBy(F.col("child").alias("event_id")).agg(F.min_by("users", "ord").alias("users"))
    out = events.join(first, "event_id", "left")
    level = F.when(F.col("users").isNull(), otherwise).otherwise(F.coalesce(F.try_element_at("users", F.col("sender")), F.lit(0)))
    return out.select("room_id", "event_id", level.cast("long").alias("level"))


def _mainline(auth: dict, levels: set, start) -> list:
    """Power-levels events from the resolved one down: each time the nearest by authority, of equals the first met."""
    line: list = []
    seen: set = set()
    while start is not None and start not in seen:
        line.append(start)
        seen.add(start)
        level, met, start = auth.get(start, []), set(), None
        while level and start is None:
            after = []
            for x in level:
                if x in met:
                    continue
                met.add(x)
                if x in levels:
                    start = x
                    break
                after += auth.get(x, [])
            level = after
    return line


def _positions(room, rows: list):
    """(room, event, position, whether on the mainline) of all events. Rows: (room, kind, a, b), by kind and place: 0 event, 1 power-levels event, 2 resolved levels, 3 edge."""
    auth: dict = {}
    events, levels, start = [], set(), None
    for _, kind, _, x, y in rows:
        if kind == 0:
            events.append(x)
        elif kind == 1:
            levels.add(x)
        elif kind == 2:
            start = x
        else:
            auth.setdefault(x, []).append(y)
    line = _mainline(auth, levels, start)
    above: dict = {}
    for x, ps in auth.items():
        for p in ps:
            above.setdefault(p, []).append(x)
    at = {x: k for k, x in enumerate(line)}
    on = set(line)
    for k, member in enumerate(line):  # what is above a member and not above an earlier one
        queue = [member]
        while queue:
            for y in above.get(queue.pop(), ()):
                if y not in at:
                    at[y] = k
                    queue.append(y)
    return [(room, x, at.get(x, len(line)), x in on) for x in events]


def _placed(events: DataFrame, auth: DataFrame, resolved: DataFrame) -> DataFrame:
    kind = events.schema["event_id"].dataType.simpleString()
    none = F.lit(None).cast(kind).alias("b")
    part = lambda df, n: df.select("room_id", F.lit(n).alias("kind"), F.lit(0).alias("ord"), F.col("event_id").cast(kind).alias("a"), none)
    top = resolved.where("type = 'm.room.power_levels' AND state_key = ''")
    rows = part(events, 0).unionByName(part(events.where("type = 'm.room.power_levels'"), 1)).unionByName(part(top, 2))
    rows = rows.unionByName(auth.select("room_id", F.lit(3).alias("kind"), F.col("ord").cast("int").alias("ord"), F.col("child").alias("a"), F.col("parent").alias("b")))
    return by_room(rows, _positions, f"room_id {events.schema['room_id'].dataType.simpleString()}, event_id {kind}, position long, on_line boolean", order=("kind", "a", "ord"))


def mainline(events: DataFrame, auth: DataFrame, resolved: DataFrame) -> DataFrame:
    """room_id, event_id, pos: power-levels events from the resolved one down, each the nearest by authority."""
    return _placed(events, auth, resolved).where("on_line").select("room_id", "event_id", F.col("position").alias("pos"))


def mainline_positions(events: DataFrame, auth: DataFrame, resolved: DataFrame) -> DataFrame:
    """room_id, event_id, position: the least mainline place that each event reaches, or the mainline's length. One pass over a room's edges."""
    return _placed(events, auth, resolved).select("room_id", "event_id", "position")


def lattice_winners(events: DataFrame) -> DataFrame:
    """The least upper bound for each key: least position, then latest, then largest id; a partial and a final aggregate."""
    state = events.where(F.col("state_key").isNotNull())
    return state.groupBy("room_id", "type", "state_key").agg(F.max_by("event_id", F.struct(-F.col("position"), F.col("ts"), F.col("event_id"))).alias("event_id"))


def by_priority(events: DataFrame) -> DataFrame:
    """events with pos, their rank in the room by level, kind, time and id."""
    kind = F.when(F.col("type") == "m.room.power_levels", 0).when(F.col("type") == "m.room.join_rules", 1).otherwise(2)
    order = Window.partitionBy("room_id").orderBy(F.desc("power_level"), kind, "ts", "event_id")
    return events.withColumn("pos", F.row_number().over(order).cast("long"))


def _dominated(room, rows: list):
    """(room, admin, event) pairs. Rows: (room, kind, a, b, pos, sender, target, demoted, locks, joins), by kind: 0 a disputed event, 1 an edge.

    Each admin action is a bit; one sweep along the edges gives every event the admins below it and, backwards, above it.
    """
    disputed = sorted((r for r in rows if r[1] == 0), key=lambda r: r[4])
    admins = [r for r in disputed if r[6] is not None or r[7] or r[8]]
    if not admins:
        return
    parents: dict = {}
    for r in rows:
        if r[1] == 1:
            parents.setdefault(r[2], []).append(r[3])
            parents.setdefault(r[3], [])
    waits, after = {x: len(ps) for x, ps in parents.items()}, {}
    for x, ps in parents.items():
        for p in ps:
            after.setdefault(p, []).append(x)
    bit = {r[2]: 1 << k for k, r in enumerate(admins)}
    below, above, order = dict(bit), dict(bit), [x for x, n in waits.items() if not n]
    for x in order:  # grows; what is in or behind a cycle is left out
        for y in after.get(x, ()):
            below[y] = below.get(y, 0) | below.get(x, 0)
            waits[y] -= 1
            if not waits[y]:
                order.append(y)
    for x in reversed(order):
        for p in parents[x]:
            above[p] = above.get(p, 0) | above.get(x, 0)
    on_sender: dict = {}
    locks = 0
    for r in admins:
        for user in ([r[6]] if r[6] is not None else []) + list(r[7] or ()):
            on_sender[user] = on_sender.get(user, 0) | bit[r[2]]
        locks |= bit[r[2]] if r[8] else 0
    earlier = 0  # admins of higher priority
    for r in disputed:
        hits = (on_sender.get(r[5], 0) | (locks if r[9] else 0)) & earlier & ~(below.get(r[2], 0) | above.get(r[2], 0))
        while hits:
            low = hits & -hits
            yield room, admins[low.bit_length() - 1][2], r[2]
            hits ^= low
        earlier |= bit.get(r[2], 0)


def domination_candidates(disputed: DataFrame, edges: DataFrame) -> DataFrame:
    """room_id, admin, event_id: admin actions of higher priority that bear on a concurrent event of the set.

    edges: timeline and authority. Bits for the admin actions alone travel along the edges, so that a room costs its edges
    times its admin actions / 64 and no pair is made that is not a result.
    """
    rows = by_priority(disputed).withColumns({"is_removal": c.is_removal(), "is_levels": c.is_levels(), "is_lockdown": c.is_lockdown()})
    kind = disputed.schema["event_id"].dataType.simpleString()
    empty = F.array().cast("array<string>")
    events = rows.select(
        "room_id", F.lit(0).alias("kind"), F.col("event_id").alias("a"), F.lit(None).cast(kind).alias("b"), "pos", "sender",
        F.when(F.col("is_removal"), F.col("state_key")).alias("target"), F.when(F.col("is_levels"), F.coalesce("demoted", empty)).otherwise(empty).alias("demoted"),
        F.coalesce("is_lockdown", F.lit(False)).alias("locks"), F.coalesce((F.col("type") == "m.room.member") & (F.col("membership") == "join"), F.lit(False)).alias("joins"),
    )
    none = [F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("target"), empty.alias("demoted"), F.lit(False).alias("locks"), F.lit(False).alias("joins")]
    steps = edges.select("room_id", F.lit(1).alias("kind"), F.col("child").cast(kind).alias("a"), F.col("parent").cast(kind).alias("b")).distinct().select("*", *none)
    room = disputed.schema["room_id"].dataType.simpleString()
    return by_room(events.unionByName(steps), _dominated, f"room_id {room}, admin {kind}, event_id {kind}")
