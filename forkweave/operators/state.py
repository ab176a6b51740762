"""State operators: last entry per key, conflict partition, deltas, compacted chains, reconstruction, source merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["room_id", "type", "state_key"]


def last_per_key(events: DataFrame, *by: str) -> DataFrame:
    """The last event for each key, by depth, then id; messages (no state key) have none."""
    state = events.where(F.col("state_key").isNotNull())
    return state.groupBy(*(by or ("room_id",)), "type", "state_key").agg(F.max_by("event_id", F.struct("depth", "event_id")).alias("event_id"))


def partition(states: DataFrame, set_col: str) -> DataFrame:
    """room_id, type, state_key, event_id, is_conflicted: agreed if all the room's sets hold one id."""
    n = states.groupBy("room_id").agg(F.countDistinct(set_col).alias("sets"))
    per = states.groupBy(*KEY).agg(F.collect_set("event_id").alias("ids"), F.count("*").alias("votes"))
    out = per.join(n, "room_id").withColumn("is_conflicted", ~((F.size("ids") == 1) & (F.col("votes") == F.col("sets"))))
    return out.select(*KEY, F.explode("ids").alias("event_id"), "is_conflicted")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """room_id, type, state_key, event_id (null for a removal) of each entry that differs."""
    both = before.select(*KEY, F.col("event_id").alias("old")).join(after.select(*KEY, F.col("event_id").alias("new")), KEY, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*KEY, F.col("new").alias("event_id"))


def apply_delta(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with changed entries replaced and removed ones gone."""
    kept = state.select(*KEY, "event_id").join(changes.select(*KEY), KEY, "left_anti")
    return kept.unionByName(changes.where(F.col("event_id").isNotNull()).select(*KEY, "event_id"))


def overlay(below: DataFrame, above: DataFrame) -> DataFrame:
    """Both states, the second's entries where both have one."""
    return below.join(above.select(*KEY), KEY, "left_anti").unionByName(above)


def linear_chain(events: DataFrame, most: int = 100) -> DataFrame:
    """A compacted chain along each room's (depth, id) order: room_id, seq, event_id, type, state_key, parent_id, is_snapshot.

    Each event changes one entry at most, so a delta is the event's own key; a snapshot stands first and every `most`.
    """
    order = Window.partitionBy("room_id").orderBy("depth", "event_id")
    out = events.withColumn("seq", F.row_number().over(order) - 1).withColumn("parent_id", F.lag("event_id").over(order))
    return out.select("room_id", "seq", "event_id", "type", "state_key", "parent_id", (F.col("seq") % max(most, 1) == 0).alias("is_snapshot"))


def _numbered(chain: DataFrame) -> DataFrame:
    """chain with mark (the place of the last snapshot up to each row) and marks (how many there are up to it)."""
    so_far = Window.partitionBy("room_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chain.withColumns({"mark": F.max(F.when(F.col("is_snapshot"), F.col("seq"))).over(so_far), "marks": F.sum(F.col("is_snapshot").cast("long")).over(so_far)})


def snapshots(chain: DataFrame) -> DataFrame:
    """room_id, seq, type, state_key, event_id: the whole state at each snapshot of a chain.

    An entry holds from its row to the next one of its key: it is copied to the snapshots in between, no more rows than
    the result has.
    """
    rows = _numbered(chain)
    all_marks = rows.groupBy("room_id").agg(F.max("marks").alias("all"))
    of_key = Window.partitionBy("room_id", "type", "state_key").orderBy("seq")
    own = F.col("is_snapshot").cast("long")
    held = rows.where(F.col("state_key").isNotNull()).withColumn("until", F.lead(F.col("marks") - own).over(of_key))
    held = held.join(all_marks, "room_id").withColumns({"lo": F.col("marks") - own + 1, "hi": F.coalesce("until", "all")}).where("lo <= hi")
    held = held.select("room_id", "type", "state_key", "event_id", F.explode(F.sequence("lo", "hi")).alias("marks"))
    marks = rows.where("is_snapshot").select("room_id", "marks", "seq")
    return held.join(marks, ["room_id", "marks"]).select("room_id", "seq", "type", "state_key", "event_id")


def reconstruct(chain: DataFrame, whole: DataFrame, targets: DataFrame) -> DataFrame:
    """room_id, target, type, state_key, event_id: the states at target places, each from its last snapshot and the deltas behind it.

    Targets, snapshots and deltas meet by room and snapshot, so that a target meets the deltas of one block alone. An entry
    of a block holds from its place to the next one of its key there, so that each target takes one entry of a key and
    the result, which is far larger than the chain, is neither shuffled nor aggregated.
    """
    places = chain.select("room_id", "seq", "is_snapshot", F.lit(None).cast("long").alias("target"))
    asked = targets.select("room_id", F.col("target").cast("long").alias("seq"), F.lit(False).alias("is_snapshot"), F.col("target").cast("long").alias("target"))
    so_far = Window.partitionBy("room_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    start = places.unionByName(asked).withColumn("mark", F.max(F.when(F.col("is_snapshot"), F.col("seq"))).over(so_far))
    start = start.where("target is not null and mark is not null").select("room_id", "target", "mark").distinct()
    base = whole.select("room_id", F.col("seq").alias("mark"), "seq", "type", "state_key", "event_id")
    deltas = _numbered(chain).where("state_key is not null and seq > mark").select("room_id", "mark", "seq", "type", "state_key", "event_id")
    of_key = Window.partitionBy("room_id", "mark", "type", "state_key").orderBy("seq")
    entries = base.unionByName(deltas).repartition("room_id", "mark").withColumn("until", F.lead("seq").over(of_key))
    held = start.join(entries, ["room_id", "mark"]).where("seq <= target and (until is null or target < until)")
    return held.select("room_id", "target", "type", "state_key", "event_id")


def reconstruct_events(chain: DataFrame, whole: DataFrame, events: DataFrame) -> DataFrame:
    """room_id, event_id, type, state_key, entry: the states at events (room_id, event_id), each at its first place in the chain."""
    at = chain.join(events.select("room_id", "event_id").distinct(), ["room_id", "event_id"]).groupBy("room_id", "event_id").agg(F.min("seq").cast("long").alias("target"))
    out = reconstruct(chain, whole, at).withColumnRenamed("event_id", "entry")
    return at.join(out, ["room_id", "target"]).select("room_id", "event_id", "type", "state_key", "entry")


def merge_sources(sources: list[DataFrame], order: str = "event_id") -> DataFrame:
    """All sources' events, each once, from the first source that has it; src tells which. Events without an id go."""
    tagged = [s.withColumn("src", F.lit(k)) for k, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, tagged).where(F.col("event_id").isNotNull())
    first = Window.partitionBy("event_id").orderBy("src", order)
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def overlaps(tagged: DataFrame) -> DataFrame:
    """a, b, shared: how many ids each pair of sources shares (src, event_id)."""
    ids = tagged.select("src", "event_id").distinct()
    left, right = ids.withColumnRenamed("src", "a"), ids.withColumnRenamed("src", "b")
    return left.join(right, "event_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def check_connected(shared: DataFrame, sources: int) -> None:
    """Raises if the sources do not hang together through shared ids (a, b, shared: a row for each pair of sources)."""
    group = list(range(sources))
    for r in shared.where("shared > 0").select("a", "b").collect():
        old, new = group[r["a"]], group[r["b"]]
        group = [new if g == old else g for g in group]
    if len(set(group)) > 1:
        raise ValueError("Disjoint DAGs: the sources share no events")
