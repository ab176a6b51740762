"""Continuous resolution: event records arrive as a stream, each room's state is resolved anew when its events change.

A room's events are a map in the operator's state, an entry for each event, so that a trigger writes only what is new;
nothing is evicted, since a late event may hang under any old one. Event times never influence the result. Each trigger
emits the whole resolved state of the rooms that changed. Map state needs the RocksDB state store: set
spark.sql.streaming.stateStore.providerClass to STORE.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernel as k
from ..operators.resolve import COLUMNS, events_of

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "room_id string, n_events bigint, type string, state_key string, event_id string"


class Rooms(StatefulProcessor):
    """Holds each room's events as JSON by id and resolves a room whenever it has new ones."""

    def __init__(self, version: str):
        self.version = version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "event_id string", "record string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = False
        for b in rows:
            for x, record in zip(b["event_id"], b["record"], strict=True):
                if not self.events.containsKey((x,)):
                    self.events.updateValue((x,), (record,))
                    new = True
        if new:
            held = [json.loads(v[0]) for _, v in self.events.iterator()]
            events = events_of(tuple(r.get(c) for c in COLUMNS) for r in held)
            got = sorted(k.resolve_heads(k.heads_of(events), events, self.version).items())
            yield pd.DataFrame([(key[0], len(held), *at, x) for at, x in got], columns=["room_id", "n_events", "type", "state_key", "event_id"])

    def close(self) -> None:
        pass


def resolved(records: DataFrame, version: str = "V2") -> DataFrame:
    """A streaming DataFrame of resolved states; use it with output mode update."""
    rows = records.select(F.col("room_id").cast("string").alias("room_id"), "event_id", F.to_json(F.struct(*COLUMNS)).alias("record"))
    return rows.groupBy("room_id").transformWithStateInPandas(Rooms(version), OUT, "Update", "None")
