"""SQL for DuckDB of whole resolutions over the derived graph: priority orders and folds as recursive CTEs.

In the derived graph every sender's levels, members and create event are direct authority of its events, join rules are
never authority, and the room's creator is @u0:x; the SQL relies on that where it looks things up.
"""

from __future__ import annotations

from .graphs import CLOSURE, PARTITION

NAME = "'$' || lpad(CAST({} AS VARCHAR), 8, '0')"
REMOVES = "coalesce(type = 'm.room.member' AND membership IN ('ban', 'leave') AND state_key <> sender, false)"
#: Above all levels, as a creator is from V2_1 on.
TOP = 1 << 62


def _level(user: str, levels: str, modern: bool) -> str:
    """A user's level by a joined power-levels event."""
    creator = f"WHEN {user} = '@u0:x' THEN {TOP}" if modern else ""
    return f"(CASE {creator} WHEN {levels}.event_id IS NULL THEN 0 WHEN {user} = '@u0:x' THEN 100 WHEN {user} = '@u1:x' THEN {levels}.mod_level ELSE 0 END)"


def _base(version: str, bare: int) -> str:
    """Events with key, direct levels and own member event, and level by authority (bare: without levels)."""
    modern = version not in ("V1", "V2")
    return f""", ll AS (SELECT x.child AS event_id, max(p.event_id) AS loc_levels FROM auth x JOIN ev p ON p.event_id = x.parent AND p.type = 'm.room.power_levels' GROUP BY 1),
lm AS (SELECT x.child AS event_id, max(p.event_id) AS loc_member FROM auth x JOIN ev c ON c.event_id = x.child JOIN ev p ON p.event_id = x.parent AND p.type = 'm.room.member' AND p.state_key = c.sender GROUP BY 1),
base AS (SELECT e.*, e.type || '|' || e.state_key AS key, loc_levels, loc_member, CASE WHEN loc_levels IS NULL AND NOT ({str(modern).lower()} AND e.sender = '@u0:x') THEN {bare} ELSE {_level('e.sender', 'q', modern)} END AS alevel
  FROM ev e LEFT JOIN ll USING (event_id) LEFT JOIN lm USING (event_id) LEFT JOIN ev q ON q.event_id = loc_levels)"""


def _is_power(version: str) -> str:
    more = "type = 'm.room.member'" if version in ("V1", "V2") else REMOVES
    return f"(type IN ('m.room.create', 'm.room.power_levels', 'm.room.join_rules') OR {more})"


def _kahn(version: str, members: str) -> str:
    """ord1: room_id, event_id, pos of the power events (members: room_id, event_id), ancestors first, by priority."""
    rank = {"V1": "depth DESC, event_id DESC", "V2_2": "alevel DESC, CASE WHEN seq = 0 THEN 0 ELSE 1 END, ts, event_id"}.get(version, "alevel DESC, ts, event_id")
    return f""", pw AS ({members}),
pe AS (SELECT x.child AS event_id, list(x.parent) AS parents FROM auth x JOIN pw a ON a.event_id = x.child JOIN pw b ON b.event_id = x.parent GROUP BY 1),
pr AS (SELECT b.room_id, b.event_id, row_number() OVER (PARTITION BY b.room_id ORDER BY {rank}) AS rank, coalesce(parents, CAST([] AS BIGINT[])) AS parents FROM pw JOIN base b USING (room_id, event_id) LEFT JOIN pe USING (event_id)),
kahn AS (SELECT DISTINCT room_id, 0 AS n, CAST([] AS BIGINT[]) AS done FROM pr
  UNION ALL SELECT k.room_id, k.n + 1, list_append(k.done, arg_min(p.event_id, p.rank)) FROM kahn k JOIN pr p ON p.room_id = k.room_id WHERE NOT list_contains(k.done, p.event_id) AND list_has_all(k.done, p.parents) GROUP BY k.room_id, k.n, k.done),
ord1 AS (SELECT room_id, unnest(done) AS event_id, generate_subscripts(done, 1) AS pos FROM (SELECT room_id, arg_max(done, n) AS done FROM kahn GROUP BY room_id))"""


def _lookup(version: str, power: bool) -> tuple[str, str]:
    """Ids of the sender's member event and of the levels that a check sees."""
    member = "b.loc_member" if (version, power) == ("V2_1", True) else "coalesce(f.st['m.room.member|' || b.sender], b.loc_member)"
    settled = "f.st['m.room.power_levels|']"
    if version in ("V1", "V2") or not power:
        return member, f"coalesce({settled}, b.loc_levels)"
    return member, f"coalesce({settled}, CASE WHEN b.loc_levels NOT IN (SELECT event_id FROM con) THEN b.loc_levels END)"


def _checked(version: str, power: bool, source: str, on: str) -> str:
    """f's columns, b's event and whether the state f.st authorizes it."""
    modern = version not in ("V1", "V2")
    member, levels = _lookup(version, power)
    mine, theirs = _level("b.sender", "pl", modern), _level("b.state_key", "pl", modern)
    role = "coalesce(ms.membership, CASE WHEN b.sender = '@u0:x' THEN 'join' ELSE 'leave' END)"
    # without join rules in sight, who is not yet in may not join
    join = "true" if not modern else "(b.sender = '@u0:x' OR coalesce(ms.membership, '') = 'join')"
    return f"""SELECT f.*, b.event_id AS e_id, b.key AS e_key, b.ts AS e_ts, CASE WHEN {role} = 'ban' THEN false
    WHEN b.type = 'm.room.create' THEN true
    WHEN {role} <> 'join' AND NOT (b.type = 'm.room.member' AND b.state_key = b.sender AND b.membership <> 'ban') THEN false
    WHEN b.type = 'm.room.member' AND b.membership = 'join' THEN {join}
    WHEN b.type = 'm.room.member' THEN b.state_key <> b.sender AND {mine} >= 50 AND {mine} > {theirs}
    WHEN b.type = 'm.room.power_levels' THEN pl.event_id IS NULL OR {mine} >= 50
    ELSE {mine} >= 50 END AS fits
  FROM {source} f JOIN {on} JOIN base b ON b.event_id = o.event_id LEFT JOIN ev ms ON ms.event_id = {member} LEFT JOIN ev pl ON pl.event_id = {levels}"""


def _fold(version: str, name: str, start: str, order: str, power: bool) -> str:
    step = _checked(version, power, name, f"{order} o ON o.room_id = f.room_id AND o.pos = f.i + 1")
    return f""", {name} AS (SELECT room_id, 0 AS i, st, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS BIGINT) AS replaced FROM {start}
  UNION ALL SELECT room_id, i + 1, CASE WHEN fits THEN map_concat(st, map([e_key], [e_id])) ELSE st END, e_id, fits, st[e_key] FROM ({step}))"""


def _until_lines(version: str, wanted: str, bare: int) -> str:
    """con, power order, fold and the mainline's order ord2 of the rest. wanted: SQL of the conflicted ids (room_id, event_id)."""
    modern = version not in ("V1", "V2")
    entries = "map_from_entries(list(struct_pack(k := type || '|' || state_key, v := event_id)))"
    sql = PARTITION + CLOSURE + _base(version, bare) + f", con AS ({wanted}), p0 AS (SELECT room_id, event_id FROM con JOIN base USING (room_id, event_id) WHERE {_is_power(version)})"
    if version == "V1":
        sql += ", p1 AS (SELECT * FROM p0)"
    else:
        sql += ", p1 AS (SELECT * FROM p0 UNION SELECT p.room_id, x.parent FROM p1 p JOIN auth x ON x.child = p.event_id JOIN con c ON c.event_id = x.parent)"
    members = "SELECT room_id, event_id FROM p1"
    if modern:
        kinds = "('m.room.power_levels', 'm.room.create'" + (", 'm.room.join_rules')" if version == "V2_1" else ")")
        sql += ", ctx AS (SELECT DISTINCT p.room_id, a.event_id FROM p1 p JOIN cl ON cl.event_id = p.event_id JOIN ev a ON a.event_id = cl.ancestor_id WHERE a.type IN " + kinds + " AND a.event_id NOT IN (SELECT event_id FROM con))"
        members += " UNION SELECT room_id, event_id FROM ctx"
    sql += _kahn(version, members)
    sql += f", agreed AS (SELECT room_id, {entries} AS st FROM part WHERE NOT is_conflicted GROUP BY room_id)"
    sql += ", init AS (SELECT room_id, " + ("map_from_entries(CAST([] AS STRUCT(k VARCHAR, v BIGINT)[]))" if modern else "st") + " AS st FROM agreed)"
    sql += _fold(version, "fold1", "init", "ord1", True)
    sql += """, mid AS (SELECT room_id, arg_max(st, i) AS st, max(i) AS steps FROM fold1 GROUP BY room_id),
line AS (SELECT room_id, st['m.room.power_levels|'] AS event_id, 0 AS pos FROM mid WHERE st['m.room.power_levels|'] IS NOT NULL
  UNION SELECT l.room_id, p.event_id, l.pos + 1 FROM line l JOIN auth x ON x.child = l.event_id JOIN ev p ON p.event_id = x.parent AND p.type = 'm.room.power_levels'),
up AS (SELECT room_id, event_id, pos FROM line UNION SELECT u.room_id, x.child, u.pos FROM up u JOIN auth x ON x.parent = u.event_id WHERE x.child NOT IN (SELECT event_id FROM line)),
place AS (SELECT c.room_id, c.event_id, coalesce(min(up.pos), any_value(n), 0) AS position FROM con c LEFT JOIN (SELECT room_id, count(*) AS n FROM line GROUP BY 1) USING (room_id) LEFT JOIN up USING (room_id, event_id) GROUP BY ALL),
rest AS (SELECT c.room_id, c.event_id, position, b.ts FROM con c JOIN base b USING (room_id, event_id) JOIN place USING (room_id, event_id) WHERE c.event_id NOT IN (SELECT event_id FROM p1)),
ord2 AS (SELECT room_id, event_id, row_number() OVER (PARTITION BY room_id ORDER BY position DESC, ts, event_id) AS pos FROM rest)"""
    return sql


_ENTRY = "split_part(e.key, '|', 1) AS type, substr(e.key, strpos(e.key, '|') + 1) AS state_key, " + NAME.format("e.value") + " AS event_id"
_DISPUTED = "SELECT DISTINCT room_id, event_id FROM part WHERE is_conflicted"
#: What the heads' chains of authority differ in.
_DIFFER = " UNION SELECT room_id, event_id FROM (SELECT cl.room_id, ancestor_id AS event_id, count(DISTINCT cl.event_id) AS n FROM cl JOIN heads ON heads.event_id = cl.event_id GROUP BY ALL) WHERE n < 2"
_SUBGRAPH = """ UNION SELECT d.room_id, d.event_id FROM (SELECT cl.room_id, ancestor_id AS event_id FROM cl JOIN part p ON p.event_id = cl.event_id AND p.is_conflicted) d
  JOIN (SELECT cl.event_id FROM cl JOIN part p ON p.event_id = cl.ancestor_id AND p.is_conflicted) u ON u.event_id = d.event_id"""


def resolved_as(version: str) -> str:
    """CTE res: room_id, key, id of what each room's heads resolve to."""
    wanted = _DISPUTED + _DIFFER + (_SUBGRAPH if version == "V2_1" else "")
    # levels are stamped first in V1, V2 and V2_2: the creator's events without levels in sight have 100
    sql = _until_lines(version, wanted, 0 if version == "V2_1" else 100) + _fold(version, "fold2", "mid", "ord2", False)
    return sql + """, done AS (SELECT f.room_id, map_concat(a.st, arg_max(f.st, f.i)) AS st FROM fold2 f JOIN agreed a USING (room_id) GROUP BY f.room_id, a.st),
res AS (SELECT room_id, e.key, e.value AS id FROM (SELECT room_id, unnest(map_entries(st)) AS e FROM done))"""


def resolved(version: str) -> str:
    """What each room's heads resolve to."""
    return resolved_as(version) + f" SELECT e.room_id, {_ENTRY} FROM (SELECT room_id, key, id AS value FROM res) e"


def lattice(version: str) -> str:
    """As resolved(), of the disputed entries alone, with each key's best event instead of the second fold."""
    sql = _until_lines(version, _DISPUTED, 0)
    checked = _checked(version, False, "mid", "ord2 o ON o.room_id = f.room_id")
    return sql + f""", fits AS (SELECT room_id, e_id, e_key, e_ts FROM ({checked}) WHERE fits),
best AS (SELECT room_id, e_key AS key, e_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY fits.room_id, e_key ORDER BY position, e_ts DESC, e_id DESC) AS n FROM fits JOIN place ON place.event_id = e_id) WHERE n = 1),
known AS (SELECT room_id, e.key, e.value FROM (SELECT m.room_id, unnest(map_entries(map_concat(a.st, m.st))) AS e FROM mid m JOIN agreed a USING (room_id))),
every AS (SELECT * FROM best UNION ALL SELECT * FROM known k WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.room_id = k.room_id AND b.key = k.key))
SELECT e.room_id, {_ENTRY} FROM every e"""


def traced(version: str) -> str:
    """Every decision about the disputed entries, in order."""
    sql = _until_lines(version, _DISPUTED, 0) + _fold(version, "fold2", "mid", "ord2", False)
    cols = "b.type, b.state_key, " + NAME.format("replaced") + " AS replaced"
    return sql + f""" SELECT f.room_id, CAST(i - 1 AS INTEGER) AS step, {NAME.format('f.event_id')} AS event_id, ok AS accepted, {cols}, 'Power' AS phase FROM fold1 f JOIN base b ON b.event_id = f.event_id
UNION ALL SELECT f.room_id, CAST(steps + i - 1 AS INTEGER), {NAME.format('f.event_id')}, ok, {cols}, 'NonPower' FROM fold2 f JOIN mid USING (room_id) JOIN base b ON b.event_id = f.event_id"""


def kahn(version: str) -> str:
    """The power events of whole rooms in priority order."""
    return _base(version, 0) + _kahn(version, f"SELECT room_id, event_id FROM base WHERE {_is_power(version)}") + f" SELECT room_id, CAST(pos - 1 AS INTEGER) AS pos, {NAME.format('event_id')} AS event_id, false AS is_stuck FROM ord1"


#: FNV-1a over type, 0, key, 0, id, 255 of each entry in key order: two limbs of 64 bits, so that no product leaves 128.
_BYTES = "list_transform(range(0, length(hexed) // 2), lambda i: {'hi': CAST(0 AS HUGEINT), 'lo': CAST(0 AS HUGEINT), 'b': CAST('0x' || substr(hexed, 2 * i + 1, 2) AS HUGEINT)})"
_TEXT = "string_agg(hex(encode(type)) || '00' || hex(encode(state_key)) || '00' || hex(encode(CAST({id} AS VARCHAR))) || 'FF', '' ORDER BY type, state_key)"
_M64 = "18446744073709551616"


def hashed(states: str, by: str, bits: int, event_id: str = "event_id") -> str:
    """CTE hashes: by, h. states: a CTE with by, type, state_key, event_id."""
    hi, lo = {128: ("7809847782465536322", "7113472399480571277"), 64: ("0", "14695981039346656037")}[bits]
    x = "(xor(a.lo, x.b))"
    if bits == 128:
        step = f"{{'hi': (a.hi * 315 + ({x} * 315) // {_M64} + ({x} % 1099511627776) * 16777216) % {_M64}, 'lo': ({x} * 315) % {_M64}, 'b': CAST(0 AS HUGEINT)}}"
        out = "lower(lpad(to_hex(CAST(h.hi AS UBIGINT)), 16, '0') || lpad(to_hex(CAST(h.lo AS UBIGINT)), 16, '0'))"
    else:
        step = f"{{'hi': CAST(0 AS HUGEINT), 'lo': ({x} * 435 + ({x} % 16777216) * 1099511627776) % {_M64}, 'b': CAST(0 AS HUGEINT)}}"
        out = "lower(lpad(to_hex(CAST(h.lo AS UBIGINT)), 16, '0'))"
    return f""", texts AS (SELECT {by}, {_TEXT.format(id=event_id)} AS hexed FROM {states} GROUP BY ALL),
folded AS (SELECT {by}, list_reduce(list_prepend({{'hi': CAST({hi} AS HUGEINT), 'lo': CAST({lo} AS HUGEINT), 'b': CAST(0 AS HUGEINT)}}, {_BYTES}), lambda a, x: {step}) AS h FROM texts),
hashes AS (SELECT {by}, {out} AS h FROM folded)"""
