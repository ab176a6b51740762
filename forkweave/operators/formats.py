"""Reports of resolved rooms by name of their format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content as c
from . import graph as g
from . import reports as rep
from . import resolve as r
from .lattice import edges

FORMATS = ("default", "events", "federation", "summary", "deltas", "timeline")


def auth_chain(records: DataFrame, state: DataFrame) -> DataFrame:
    """room_id, event_id of everything that the state's events rely on."""
    return g.reachable(edges(records, "auth_events"), state, strict=True).select("room_id", "event_id")


def default(records: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """room_id, status, version, resolved_state_size, auth_chain_size, state_event_ids (in key order)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("type", "state_key", "event_id"))), lambda x: x["event_id"])
    size = state.groupBy("room_id").agg(F.count("*").alias("resolved_state_size"), ids.alias("state_event_ids"))
    chain = auth_chain(records, state).groupBy("room_id").agg(F.count("*").alias("auth_chain_size"))
    out = size.join(chain, "room_id", "left")
    return out.select("room_id", F.lit("success").alias("status"), F.lit(version).alias("version"), "resolved_state_size", F.coalesce("auth_chain_size", F.lit(0)).cast("long").alias("auth_chain_size"), "state_event_ids")


def events(records: DataFrame, state: DataFrame) -> DataFrame:
    """The records of a state, with pos by depth, then id."""
    from pyspark.sql import Window

    rows = records.join(state.select("room_id", "event_id"), ["room_id", "event_id"], "left_semi")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("room_id").orderBy("depth", "event_id")))


def federation(records: DataFrame, state: DataFrame, origin: str | None = None) -> DataFrame:
    """origin, part (state or auth_chain) and the records of both."""
    both = state.select("room_id", "event_id", F.lit("state").alias("part")).unionByName(auth_chain(records, state).withColumn("part", F.lit("auth_chain")))
    return records.join(both, ["room_id", "event_id"]).withColumn("origin", F.lit(origin).cast("string"))


def report(records: DataFrame, version: str, kind: str = "default", origin: str | None = None) -> DataFrame:
    """A report of what each room's heads resolve to, in one of FORMATS."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind} (known: {', '.join(FORMATS)})")
    if kind == "deltas":
        return r.delta_report(records, version)
    if kind == "timeline":
        return rep.timeline(c.typed(records))
    state = r.resolved(records, version)
    if kind == "summary":
        return rep.membership(state, c.typed(records))
    if kind == "events":
        return events(records, state)
    if kind == "federation":
        return federation(records, state, origin)
    return default(records, state, version)
