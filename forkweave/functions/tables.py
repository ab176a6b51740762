"""Table functions for SQL users: resolve_room and state_at over event records."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import kernel as k
from ..operators.resolve import COLUMNS, events_of


class _Rooms:
    def __init__(self):
        self.rows: list[tuple] = []

    def take(self, row: Row) -> None:
        self.rows.append(tuple(row[c] for c in COLUMNS))


@udtf(returnType="room_id string, type string, state_key string, event_id string")
class ResolveRoom(_Rooms):
    """SELECT * FROM resolve_room(TABLE(records) PARTITION BY (room_id), 'V2')."""

    def eval(self, row: Row, version: str):
        self.version = version
        self.take(row)

    def terminate(self):
        if self.rows:
            events = events_of(self.rows)
            for key, x in sorted(k.resolve_heads(k.heads_of(events), events, self.version).items()):
                yield str(self.rows[0][0]), *key, x


@udtf(returnType="room_id string, target string, type string, state_key string, event_id string")
class StateAt(_Rooms):
    """SELECT * FROM state_at(TABLE(records) PARTITION BY (room_id), 'V2', '$target'): the state after one event, in the room that has it."""

    def eval(self, row: Row, version: str, target: str):
        self.version, self.target = version, target
        self.take(row)

    def terminate(self):
        events = events_of(self.rows)
        if getattr(self, "target", None) in events:
            for x, state in k.states_at([self.target], events, self.version):
                for key, y in sorted(state.items()):
                    yield str(self.rows[0][0]), x, *key, y


def register(spark: SparkSession) -> None:
    spark.udtf.register("resolve_room", ResolveRoom)
    spark.udtf.register("state_at", StateAt)
