"""Graph operators over edge tables (room_id, child, parent[, ord]) and event tables (room_id, event_id, ...).

Walks go from their seeds, in one pass over the edges of a room that a task holds, so that time and memory follow the
room's edges, not its pairs. closure() makes all pairs, for those who want them. reach() walks any edges from seeds by a
frontier loop of joins instead, for rooms too large for one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rooms import by_room


def heads(events: DataFrame, prev: DataFrame) -> DataFrame:
    """Events that no event refers to."""
    return events.select("room_id", "event_id").join(prev.select("room_id", F.col("parent").alias("event_id")), ["room_id", "event_id"], "left_anti")


def known_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges whose parent is an event of the table."""
    return edges.join(events.select("room_id", F.col("event_id").alias("parent")), ["room_id", "parent"], "left_semi")


def missing_parents(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Referenced events that are not in the table."""
    return edges.join(events.select("room_id", F.col("event_id").alias("parent")), ["room_id", "parent"], "left_anti").select("room_id", F.col("parent").alias("event_id")).distinct()


def _closed(_, rows: list) -> list[tuple]:
    """Strict ancestors of every node with their least hops; nodes in or behind a cycle are left out."""
    room = rows[0][0]
    parents: dict = {}
    for _, child, parent in rows:
        parents.setdefault(child, []).append(parent)
        parents.setdefault(parent, [])
    waits = {x: len(ps) for x, ps in parents.items()}
    after: dict = {}
    for x, ps in parents.items():
        for p in ps:
            after.setdefault(p, []).append(x)
    queue, below, out = deque(x for x, n in waits.items() if not n), {}, []
    uses = {x: len(after.get(x, ())) for x in parents}
    while queue:
        x = queue.popleft()
        hops: dict = {}
        for p in parents[x]:
            hops[p] = 1
        for p in parents[x]:
            for y, n in below[p].items():
                if n + 1 < hops.get(y, 1 << 62):
                    hops[y] = n + 1
            uses[p] -= 1
            if not uses[p]:
                del below[p]
        if uses[x]:
            below[x] = hops
        out += [(room, x, y, n) for y, n in hops.items()]
        for y in after.get(x, ()):
            waits[y] -= 1
            if not waits[y]:
                queue.append(y)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """room_id, event_id, ancestor_id, hops: all strict ancestors, at their least distance."""
    kind = edges.schema["child"].dataType.simpleString()
    room = edges.schema["room_id"].dataType.simpleString()
    return by_room(edges.select("room_id", "child", "parent").distinct(), _closed, f"room_id {room}, event_id {kind}, ancestor_id {kind}, hops int")


def _near(rows: list, down: bool = True) -> dict:
    """What each node leads to: parents, or children."""
    near: dict = {}
    for _, _, x, y in rows:
        if y is not None:
            near.setdefault(x if down else y, []).append(y if down else x)
    return near


def _hops(near: dict, starts: Iterable, most: int | None = None, strict: bool = False) -> dict:
    """Least hops from any start; strict: at least one hop."""
    met, level, n = {}, list(dict.fromkeys(starts)), 0
    if not strict:
        met = dict.fromkeys(level, 0)
    while level and (most is None or n < most):
        n += 1
        after = []
        for x in level:
            for y in near.get(x, ()):
                if y not in met:
                    met[y] = n
                    after.append(y)
        level = after
    return met


def _walked(edges: DataFrame, sets: list[DataFrame], run, columns: str) -> DataFrame:
    """run(room, rows) over each room that has a seed: rows (room, set, id, null) of its seeds and (room, -1, child, parent) of its edges, edges last."""
    room, kind = (edges.schema[c].dataType.simpleString() for c in ("room_id", "child"))
    none = F.lit(None).cast(kind)
    rows = edges.select("room_id", F.lit(-1).alias("set"), F.col("child").alias("id"), "parent").distinct()
    for n, seeds in enumerate(sets):
        rows = rows.unionByName(seeds.select("room_id", F.lit(n).alias("set"), F.col("event_id").cast(kind).alias("id"), none.alias("parent")))
    return by_room(rows, run, f"room_id {room}, {columns.format(id=kind)}")


def reachable(edges: DataFrame, seeds: DataFrame, most: int | None = None, down: bool = True, strict: bool = False) -> DataFrame:
    """room_id, event_id, hops: what a room's seeds reach, they included unless strict, at the least hops, up to `most`."""

    def run(room, rows):
        starts = [r[2] for r in rows if r[1] == 0]
        return [(room, x, n) for x, n in _hops(_near(rows, down), starts, most, strict).items()] if starts else []

    return _walked(edges, [seeds], run, "event_id {id}, hops int")


def chains(edges: DataFrame, starts: DataFrame, reflexive: bool = False) -> DataFrame:
    """room_id, start, event_id: the ancestors of each start, one walk each."""

    def run(room, rows):
        near = _near(rows)
        for start in dict.fromkeys(r[2] for r in rows if r[1] == 0):
            for x in _hops(near, [start], None, not reflexive):
                yield room, start, x

    return _walked(edges, [starts], run, "start {id}, event_id {id}")


def subgraph(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """Events both below and above seeds, seeds included; `most` bounds the way down."""

    def run(room, rows):
        starts = [r[2] for r in rows if r[1] == 0]
        if not starts:
            return []
        up = _hops(_near(rows, False), starts)
        return [(room, x) for x in _hops(_near(rows), starts, most) if x in up]

    return _walked(edges, [seeds], run, "event_id {id}")


def difference(chained: DataFrame, starts: DataFrame) -> DataFrame:
    """Events in some but not all of a room's chains."""
    n = starts.groupBy("room_id").agg(F.count("*").alias("n"))
    seen = chained.groupBy("room_id", "event_id").agg(F.countDistinct("start").alias("seen"))
    return seen.join(n, "room_id").where("seen < n").select("room_id", "event_id")


def bounded_difference(edges: DataFrame, disputed: DataFrame, agreed: DataFrame) -> DataFrame:
    """What the disputed events' chains hold beyond the agreed ones', both reflexive."""

    def run(room, rows):
        near = _near(rows)
        known = _hops(near, [r[2] for r in rows if r[1] == 1])
        return [(room, x) for x in _hops(near, [r[2] for r in rows if r[1] == 0]) if x not in known]

    return _walked(edges, [disputed, agreed], run, "event_id {id}")


def merge_base(prev: DataFrame, tips: DataFrame, events: DataFrame) -> DataFrame:
    """room_id, event_id: the deepest event that all of a room's tips reach."""
    common = chains(prev, tips, reflexive=True).groupBy("room_id", "event_id").agg(F.countDistinct("start").alias("seen"))
    n = tips.groupBy("room_id").agg(F.count("*").alias("n"))
    full = common.join(n, "room_id").where("seen = n").join(events.select("room_id", "event_id", "depth"), ["room_id", "event_id"])
    return full.groupBy("room_id").agg(F.max_by("event_id", F.struct("depth", "event_id")).alias("event_id"))


def distances(edges: DataFrame, events: DataFrame, kind: str = "m.room.create") -> DataFrame:
    """room_id, event_id, distance: least hops to the room's event of a kind; 0 for itself."""
    goal = events.where(F.col("type") == kind).select("room_id", "event_id")
    return reachable(edges, goal, down=False).withColumnRenamed("hops", "distance")


def depths(events: DataFrame, prev: DataFrame) -> DataFrame:
    """room_id, event_id, depth: the longest way down to an event without known parents, which has depth 1; none in or behind a cycle."""

    def run(room, rows):
        parents: dict = {r[2]: [] for r in rows if r[1] == 0}
        for _, n, x, y in rows:
            if n == -1 and x in parents and y in parents:
                parents[x].append(y)
        waits, after = {x: len(ps) for x, ps in parents.items()}, {}
        for x, ps in parents.items():
            for p in ps:
                after.setdefault(p, []).append(x)
        depth = {x: 1 for x in parents}
        queue = deque(x for x, n in waits.items() if not n)
        while queue:
            x = queue.popleft()
            yield room, x, depth[x]
            for y in after.get(x, ()):
                depth[y] = max(depth[y], depth[x] + 1)
                waits[y] -= 1
                if not waits[y]:
                    queue.append(y)

    return _walked(prev, [events], run, "event_id {id}, depth int")


def _grouped(_, rows: list) -> list[tuple]:
    near: dict = {}
    depth = {}
    room = rows[0][0]
    for _, x, y, d in rows:
        near.setdefault(x, [])
        if d is not None:
            depth[x] = d
        if y is not None:
            near[x].append(y)
            near.setdefault(y, []).append(x)
    seen, out = set(), []
    for x in near:
        if x in seen:
            continue
        group, queue = {x}, deque([x])
        while queue:
            for y in near[queue.popleft()]:
                if y not in group:
                    group.add(y)
                    queue.append(y)
        seen |= group
        root = min(group, key=lambda y: (depth[y], y))
        out += [(room, y, root) for y in group]
    return out


def components(events: DataFrame, edges: DataFrame) -> DataFrame:
    """room_id, event_id, root: connected components of a room, by their least event by depth, then id."""
    inner = known_edges(edges, events).select("room_id", F.col("child").alias("event_id"), F.col("parent").alias("other"), F.lit(None).cast("long").alias("depth"))
    nodes = events.select("room_id", "event_id", F.lit(None).cast(inner.schema["other"].dataType).alias("other"), F.col("depth").cast("long").alias("depth"))
    kind = events.schema["event_id"].dataType.simpleString()
    return by_room(nodes.unionByName(inner.join(events.select("room_id", "event_id"), ["room_id", "event_id"], "left_semi")), _grouped, f"room_id {events.schema['room_id'].dataType.simpleString()}, event_id {kind}, root {kind}")


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, most: int | None = None, down: bool = True) -> DataFrame:
    """room_id, event_id, hops: what the seeds reach, by a frontier loop; for rooms that no single task should hold.

    Each round joins the frontier with the edges and drops what was met before; the set met so far is checkpointed, so
    the lineage stays short and survives lost executors.
    """
    here, there = ("child", "parent") if down else ("parent", "child")
    step = edges.select("room_id", F.col(here).alias("event_id"), F.col(there).alias("next")).distinct()
    met = seeds.select("room_id", "event_id").distinct().withColumn("hops", F.lit(0)).checkpoint()
    frontier, n = met, 0
    while most is None or n < most:
        n += 1
        found = frontier.join(step, ["room_id", "event_id"]).select("room_id", F.col("next").alias("event_id")).distinct()
        frontier = found.join(met, ["room_id", "event_id"], "left_anti").withColumn("hops", F.lit(n)).checkpoint()
        if frontier.isEmpty():
            break
        met = met.unionAll(frontier).checkpoint()
    return met
