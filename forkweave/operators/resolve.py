"""Resolution of whole tables of rooms: each room's kernel runs in the task that holds the room."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as k
from .rooms import by_room

COLUMNS = ["room_id", "event_id", "type", "state_key", "sender", "origin_server_ts", "depth", "power_level", "prev_events", "auth_events", "content"]
STATE = "room_id {room}, type string, state_key string, event_id string"


def _json(text: str | None):
    """Content, not to be changed: short texts, most of which repeat, are parsed once for many events."""
    return _parsed(text) if text is None or len(text) > 200 else _kept(text)


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else {}
    except ValueError:
        return {}


_kept = lru_cache(4096)(_parsed)


def events_of(rows: Iterable[tuple]) -> dict:
    """Kernel events by id from rows of COLUMNS (the room first)."""
    return {r[1]: k.Event(r[1], r[2], r[3], r[4] or "", r[5] or 0, r[6] or 0, r[7] or 0, tuple(r[8] if r[8] is not None else ()), tuple(r[9] if r[9] is not None else ()), _json(r[10])) for r in rows}


def lean(records: DataFrame) -> DataFrame:
    """COLUMNS without the content of messages: no resolution reads it, and a task holds a room."""
    return records.select(*COLUMNS[:-1], F.when(F.col("state_key").isNotNull() | (F.col("type") == k.CREATE), F.col("content")).alias("content"))


def _run(records: DataFrame, fn, columns: str) -> DataFrame:
    room = records.schema["room_id"].dataType.simpleString()
    return by_room(lean(records), fn, f"room_id {room}, {columns}")


def resolved(records: DataFrame, version: str, stamp: bool | None = None, verify: Callable | None = None) -> DataFrame:
    """room_id, type, state_key, event_id: what each room's heads resolve to.

    stamp: write senders' levels into events first. verify(step, event) may give a reason to refuse an event; it runs in
    the task that holds the room.
    """
    stamp = version in ("V1", "V2", "V2_2") if stamp is None else stamp

    def run(room, rows):
        events = events_of(rows)
        if stamp:
            k.stamp_levels(events, version)
        return [(room, *key, x) for key, x in sorted(k.resolve_heads(k.heads_of(events), events, version, verify).items())]

    return _run(records, run, "type string, state_key string, event_id string")


def _with_state(records: DataFrame, columns: list[str], placed: DataFrame, state: DataFrame) -> DataFrame:
    """columns of records, then kind and pos: 0 a record, 1 a place (of placed: room_id, event_id, pos), 2 an entry of a state.

    The kernel's shuffle by room is the only one: what belongs to one event meets in its task, not by a join before it.
    """
    kind = dict(records.select(*columns).dtypes)
    blank = {"int": F.lit(0), "bigint": F.lit(0).cast("bigint")}  # cheaper to read than nulls

    def part(rows: DataFrame, given: tuple, n: int, pos: Column) -> DataFrame:
        return rows.select(*[F.col(c).cast(kind[c]).alias(c) if c in given else blank.get(kind[c], F.lit(None).cast(kind[c])).alias(c) for c in columns], F.lit(n).alias("kind"), pos.cast("long").alias("pos"))

    rows = part(records, tuple(columns), 0, F.lit(0)).unionByName(part(placed, ("room_id", "event_id"), 1, F.col("pos")))
    return rows.unionByName(part(state, ("room_id", "event_id", "type", "state_key"), 2, F.lit(0)))


def _parted(rows: list) -> tuple[dict, list, list]:
    """Records by id, places (pos, id) of known ones in order, and entries (key, id), from one room's rows of _with_state()."""
    known, placed, entries = {}, [], []
    for r in rows:
        if r[-2] == 0:
            known[r[1]] = r
        elif r[-2] == 1:
            placed.append((r[-1], r[1]))
        else:
            entries.append(((r[2], r[3]), r[1]))
    return known, sorted(x for x in placed if x[1] in known), entries


def from_checkpoint(records: DataFrame, snapshot: DataFrame, conflicted: DataFrame, version: str, verify: Callable | None = None) -> DataFrame:
    """room_id, type, state_key, event_id: each room's trusted snapshot with its conflicted events resolved onto it.

    snapshot: room_id, type, state_key, event_id; conflicted: room_id, event_id. records hold the conflicted events and
    all their authority; where some lacks, the job fails and names it. Snapshot entries need not be among the records.
    """
    room = records.schema["room_id"].dataType.simpleString()
    rows = _with_state(records, COLUMNS, conflicted.select("room_id", "event_id").distinct().withColumn("pos", F.lit(0)), snapshot)

    def run(key, rows):
        known, placed, entries = _parted(rows)
        events = events_of(known.values())
        return [(key, *at, x) for at, x in sorted(k.resolve_checkpoint(dict(entries), {x: events[x] for _, x in placed}, events, version, verify).items())]

    return by_room(rows, run, f"room_id {room}, type string, state_key string, event_id string")


#: What the rules read of an event: of its parents only how many there are.
_JUDGED = ["room_id", "event_id", "type", "state_key", "sender", "content", "n_prev", "n_auth"]


def checked_chain(records: DataFrame, order: DataFrame, state: DataFrame, version: str, verify: Callable | None = None) -> DataFrame:
    """room_id, pos, event_id, accepted, code, required, actual, message: events applied one after the other onto a state.

    order: room_id, event_id, pos; state: room_id, type, state_key, event_id of records. Whole events travel only where
    verify is to see them.
    """
    room = records.schema["room_id"].dataType.simpleString()
    if verify:
        rows, made = _with_state(records, COLUMNS, order, state), events_of
    else:
        counted = records.withColumns({n: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for n, c in (("n_prev", "prev_events"), ("n_auth", "auth_events"))})
        rows, made = _with_state(counted, _JUDGED, order, state), _judged_of

    def run(key, rows):
        known, chain, entries = _parted(rows)
        wanted = {x for _, x in chain}.union(x for _, x in entries)
        events = made(known[x] for x in wanted if x in known)
        base = {at: events[x] for at, x in entries if x in events}
        _, refused = k.check_in_order((events[x] for _, x in chain), base, version, verify)
        why = dict(refused)
        for pos, x in chain:
            no = why.get(x)
            yield (key, pos, x, True, None, None, None, None) if no is None else (key, pos, x, False, no.code, no.required, no.actual, str(no))

    return by_room(rows, run, f"room_id {room}, pos long, event_id string, accepted boolean, code string, required long, actual long, message string")


def _judged_of(rows: Iterable[tuple]) -> dict:
    """Kernel events by id from rows of _JUDGED, with stand-ins for their parents."""
    return {r[1]: k.Event(r[1], r[2], r[3], r[4] or "", prev=range(r[6]), auth=range(r[7]), content=_json(r[5])) for r in rows}


def power_phase(records: DataFrame, version: str) -> DataFrame:
    """room_id, type, state_key, event_id: each room's agreed entries and what the power phase over its disputed ones resolves."""

    def run(room, rows):
        events = events_of(rows)
        agreed, disputed = k.partition([k.last_state(h, events) for h in k.heads_of(events)])
        r = k.Resolution(agreed, {x: events[x] for x in disputed}, events, version)
        r.power_phase()
        return [(room, *key, x) for key, x in sorted({**agreed, **r.resolved}.items())]

    return _run(records, run, "type string, state_key string, event_id string")


def lattice(records: DataFrame, version: str) -> DataFrame:
    """As resolved(), by the per-key fold instead of the ordered one."""

    def run(room, rows):
        events = events_of(rows)
        heads = k.heads_of(events)
        agreed, disputed = k.partition([k.last_state(h, events) for h in heads])
        return [(room, *key, x) for key, x in sorted(k.resolve_lattice(agreed, {x: events[x] for x in disputed}, events, version).items())]

    return _run(records, run, "type string, state_key string, event_id string")


def trace(records: DataFrame, version: str) -> DataFrame:
    """room_id, step, event_id, accepted, type, state_key, replaced, phase of every decision."""

    def run(room, rows):
        events = events_of(rows)
        agreed, disputed = k.partition([k.last_state(h, events) for h in k.heads_of(events)])
        _, steps = k.resolve_traced(agreed, {x: events[x] for x in disputed}, events, version)
        return [(room, n, s.id, s.accepted, *s.key, s.replaced, s.phase) for n, s in enumerate(steps)]

    return _run(records, run, "step int, event_id string, accepted boolean, type string, state_key string, replaced string, phase string")


def states_at(records: DataFrame, targets: DataFrame, version: str) -> DataFrame:
    """room_id, target, type, state_key, event_id: the state after each known target (room_id, event_id)."""
    asked = targets.select("room_id", "event_id").distinct().withColumn("asked", F.lit(True))
    rows_in = lean(records).join(asked, ["room_id", "event_id"], "left").select(*COLUMNS, "asked")
    room_type = records.schema["room_id"].dataType.simpleString()

    def run(room, rows):
        events = events_of(rows)
        wanted = [r[1] for r in rows if r[11]]
        for x, state in k.states_at(wanted, events, version):
            yield from ((room, x, *key, y) for key, y in sorted(state.items()))

    return by_room(rows_in, run, f"room_id {room_type}, target string, type string, state_key string, event_id string")


def priority_order(records: DataFrame, version: str) -> DataFrame:
    """room_id, pos, event_id, is_stuck: the power events of each room, ancestors first, by priority."""

    def run(room, rows):
        events = events_of(rows)
        power = {x: e for x, e in events.items() if k.is_power(e, version)}
        create = min((e for e in events.values() if e.type == k.CREATE), key=lambda e: e.id, default=None)
        out, stuck = k.priority_order(power, events, create, version)
        return [(room, n, x, n >= len(out)) for n, x in enumerate([*out, *stuck])]

    return _run(records, run, "pos int, event_id string, is_stuck boolean")


def hashes(states: DataFrame, bits: int = 128) -> DataFrame:
    """room_id, state_hash of whole states (room_id, type, state_key, event_id)."""
    room_type = states.schema["room_id"].dataType.simpleString()
    rows = states.select("room_id", "type", "state_key", F.col("event_id").cast("string").alias("event_id"))
    return by_room(rows, lambda room, rs: [(room, k.state_hash({(r[1], r[2]): r[3] for r in rs}, bits))], f"room_id {room_type}, state_hash string")


def delta_report(records: DataFrame, version: str) -> DataFrame:
    """room_id, seq, event_id, hash, parent, n_deltas, deltas (JSON) of every event in (depth, id) order, with 64-bit hashes."""

    def run(room, rows):
        events = events_of(rows)
        after, hashed, out = {}, {}, []
        for n, e in enumerate(sorted(events.values(), key=lambda e: (e.depth, e.id))):
            known = [p for p in e.prev if p in after]
            before = {} if not known else after[known[0]] if len(known) == 1 else k.merge_simple([after[p] for p in known], events, version)
            parent = None
            if known:
                parent = k.state_hash(before, 64) if len(known) > 1 else hashed.get(e.prev[0])
            state = before if e.key is None else {**before, e.key: e.id}
            after[e.id], hashed[e.id] = state, k.state_hash(state, 64)
            changes = k.delta(before, state)
            out.append((room, n, e.id, hashed[e.id], parent, len(changes), json.dumps([{"type": t, "state_key": s, "event_id": x} for t, s, x in changes], separators=(",", ":"))))
        return out

    return _run(records, run, "seq int, event_id string, hash string, parent string, n_deltas int, deltas string")


def rebuilt(chain: DataFrame, targets: DataFrame) -> DataFrame:
    """room_id, seq, type, state_key, event_id: the states at targets (room_id, seq) of any chain, also one with gaps or strange parents.

    chain: room_id, seq, parent_hash, state_hash, is_snapshot, entries (JSON: lists of type, state_key, event_id or null).
    A row's parent is the row before it if the hashes agree, else the last earlier one that does; a target whose chain is
    broken has no rows.
    """
    room = chain.schema["room_id"].dataType.simpleString()
    asked = targets.select("room_id", F.col("seq").cast("long").alias("seq")).distinct().withColumn("asked", F.lit(True))
    rows = chain.select("room_id", F.col("seq").cast("long").alias("seq"), "state_hash", "parent_hash", "is_snapshot", "entries").join(asked, ["room_id", "seq"], "left")

    def run(key, rows):
        links = []
        for _, seq, state, parent, whole, entries, _ in rows:
            items = [tuple(x) for x in json.loads(entries)]
            links.append(k.Checkpoint(state, parent, seq, [] if whole else items, {(t, s): x for t, s, x in items} if whole else None))
        for n, r in enumerate(rows):
            if r[6]:
                for at, x in sorted((k.rebuild(links, n) or {}).items()):
                    yield key, r[1], *at, x

    return by_room(rows.select("room_id", "seq", "state_hash", "parent_hash", "is_snapshot", "entries", "asked"), run, f"room_id {room}, seq long, type string, state_key string, event_id string", order=("seq",))


def for_each_state(states: DataFrame, write: Callable[[object, str, dict], None]) -> None:
    """Hands each target's state (of states_at) to write(room_id, target, {(type, state_key): event_id}), in the task that has its room."""
    room = states.schema["room_id"].dataType.simpleString()

    def run(key, rows):
        write(key[0], key[1], {(r[2], r[3]): r[4] for r in rows})
        return [(key[0], len(rows))]

    rows = states.select("room_id", "target", "type", "state_key", "event_id")
    by_room(rows, run, f"room_id {room}, entries int", keys=("room_id", "target")).write.format("noop").mode("overwrite").save()


def compacted(records: DataFrame, version: str, most: int = 100) -> DataFrame:
    """Checkpoints of each room's states in topological order: seq, state_hash, parent_hash, event_id, is_snapshot, n_entries, rebuilds, entries (JSON)."""

    def run(room, rows):
        events = events_of(rows)
        order = k.order_by_prev(events, events)
        states = dict(k.states_at(order, events, version))
        chain = k.compact(((x, states[x]) for x in order), most)
        for n, c in enumerate(chain):
            entries = c.deltas if c.snapshot is None else [(*at, x) for at, x in sorted(c.snapshot.items())]
            yield room, n, c.state_hash, c.parent_hash, c.event_id, c.snapshot is not None, len(entries), k.rebuild(chain, n) == states[c.event_id], json.dumps(entries, separators=(",", ":"))

    return _run(records, run, "seq int, state_hash string, parent_hash string, event_id string, is_snapshot boolean, n_entries int, rebuilds boolean, entries string")
