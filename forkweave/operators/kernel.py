"""The order-dependent part of conflict resolution, for one room: plain Python over dictionaries, without Spark.

A room's events are a dict id -> Event; a state is a dict (type, state_key) -> id. Ids may be of any ordered type.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

#: Event types, limits and default levels of the protocol.
CREATE, MEMBER, LEVELS, JOIN_RULES, THIRD_PARTY = "m.room.create", "m.room.member", "m.room.power_levels", "m.room.join_rules", "m.room.third_party_invite"
TOP_LEVEL, CREATOR_LEVEL = (1 << 53) - 1, (1 << 63) - 1
MAX_PREV, MAX_AUTH = 20, 10
DEFAULTS = {"ban": 50, "kick": 50, "invite": 0, "redact": 50}

VERSIONS = ("V1", "V2", "V2_1", "V2_1_1", "V2_2")
#: From an empty state, with ancestral levels and a creator above all levels.
MODERN = frozenset(VERSIONS[2:])
#: Local authority reaches through the whole chain.
TRANSITIVE = frozenset(("V2_1_1", "V2_2"))
ROOM_VERSIONS = {"1": "V1", **{str(n): "V2" for n in range(2, 12)}, "12": "V2_1", "12.1": "V2_1_1"}

Key = tuple[str, str]
State = dict[Key, Any]


@dataclass(slots=True)
class Event:
    id: Any
    type: str
    state_key: str | None = None
    sender: str = ""
    ts: int = 0
    depth: int = 0
    power: int = 0
    prev: tuple = ()
    auth: tuple = ()
    content: dict = field(default_factory=dict)

    @property
    def key(self) -> Key | None:
        return None if self.state_key is None else (self.type, self.state_key)

    def text(self, name: str) -> str | None:
        v = self.content.get(name) if isinstance(self.content, dict) else None
        return v if isinstance(v, str) else None

    def level(self, name: str) -> int | None:
        return level(self.content.get(name)) if isinstance(self.content, dict) else None

    def listed(self, table: str, name: str) -> int | None:
        """A level of one entry of users or events."""
        t = self.content.get(table) if isinstance(self.content, dict) else None
        return level(t.get(name)) if isinstance(t, dict) else None

    def made_by(self, user: str) -> bool:
        """Whether this create event makes the user a creator."""
        more = self.content.get("additional_creators") if isinstance(self.content, dict) else None
        return self.sender == user or (isinstance(more, list) and user in [x for x in more if isinstance(x, str)])

    def removes(self) -> bool:
        """A ban of, or a leave set by, someone else."""
        return self.type == MEMBER and self.text("membership") in ("ban", "leave") and self.state_key is not None and self.state_key != self.sender

    def locks(self) -> bool:
        return self.type == JOIN_RULES and self.text("join_rule") == "invite"

    def restricts(self, other: Event) -> bool:
        """Whether this administrative action bears on another event's sender or join."""
        if self.removes():
            return self.state_key == other.sender
        if self.type == LEVELS:
            return self.listed("users", other.sender) == 0
        return self.locks() and other.type == MEMBER and other.text("membership") == "join"


def level(v: Any) -> int | None:
    """A level from JSON: an integer or the text of one, clamped both ways; floats, booleans and all else are none."""
    if isinstance(v, bool):
        return None
    if isinstance(v, str):
        sign, digits = (v[:1], v[1:]) if v[:1] in ("+", "-") else ("", v)
        if not (digits.isascii() and digits.isdigit()):
            return None
        v = int(sign + digits)
        if not -(1 << 63) <= v < 1 << 63:
            return None
    if not isinstance(v, int):
        return None
    return max(-TOP_LEVEL, min(TOP_LEVEL, v))


# ---------------------------------------------------------------- authorization

Lookup = Callable[[str, str], Event | None]


@dataclass(frozen=True, slots=True)
class Refusal:
    code: str
    required: int | None = None
    actual: int | None = None
    detail: str | None = None

    def __str__(self) -> str:
        if self.code == "InsufficientPowerLevel":
            return f"insufficient power level for {self.detail}: required {self.required}, actual {self.actual}"
        return self.code if self.detail is None else f"{self.code}: {self.detail}"


def threshold(find: Lookup, action: str) -> int:
    pl = find(LEVELS, "")
    own = pl.level(action) if pl else None
    return DEFAULTS[action] if own is None else own


def sender_level(user: str, find: Lookup, version: str) -> int:
    if version in MODERN and (made := find(CREATE, "")) and made.made_by(user):
        return CREATOR_LEVEL
    pl = find(LEVELS, "")
    for v in (pl.listed("users", user), pl.level("users_default")) if pl else ():
        if v is not None:
            return v
    return 0


def required_level(e: Event, find: Lookup) -> int:
    pl = find(LEVELS, "")
    if e.type == THIRD_PARTY:
        v = pl.level("invite") if pl else 0
        return 0 if v is None else v
    if pl is None:
        return 0 if e.state_key is None else 50
    own = pl.listed("events", e.type)
    if own is not None:
        return own
    rest = pl.level("events_default" if e.state_key is None else "state_default")
    return rest if rest is not None else (0 if e.state_key is None else 50)


def can(action: str, user: str, find: Lookup, version: str) -> bool:
    """Whether a user's level reaches the threshold of invite, ban, kick or redact."""
    return sender_level(user, find, version) >= threshold(find, action)


def membership(user: str, find: Lookup) -> str:
    m = find(MEMBER, user)
    return (m.text("membership") if m else None) or ""


def _short(required: int, actual: int, what: str) -> Refusal | None:
    return Refusal("InsufficientPowerLevel", required, actual, what) if actual < required else None


def _join(e: Event, target: str, now: str, find: Lookup, version: str) -> Refusal | None:
    if target != e.sender:
        return Refusal("InvalidStateKey", detail=target)
    if now == "ban":
        return Refusal("BannedUser", detail=e.sender)
    made, rules = find(CREATE, ""), find(JOIN_RULES, "")
    if made and made.sender == e.sender:
        return None
    rule = rules.text("join_rule") if rules else None
    rule = "invite" if rule is None else rule
    inside = now in ("invite", "join")
    if rule == "public" or (inside and rule in ("invite", "knock", "restricted", "knock_restricted")):
        return None
    if rule in ("restricted", "knock_restricted") and (via := e.text("join_authorised_via_users_server")) is not None:
        if membership(via, find) == "join" and can("invite", via, find, version):
            return None
    return Refusal("NotMember", detail=e.sender)


def _leave(e: Event, target: str, now: str, find: Lookup, version: str) -> Refusal | None:
    if target == e.sender:
        return None if now in ("invite", "join", "knock") else Refusal("NotMember", detail=e.sender)
    action = "ban" if now == "ban" else "kick"
    return _short(threshold(find, action), sender_level(e.sender, find, version), "unban" if now == "ban" else "kick")


def _ban(e: Event, target: str, now: str, find: Lookup, version: str) -> Refusal | None:
    return _short(threshold(find, "ban"), sender_level(e.sender, find, version), "ban")


def _invite(e: Event, target: str, now: str, find: Lookup, version: str, verify=None) -> Refusal | None:
    if target == e.sender:
        return Refusal("InvalidStateKey", detail=target)
    need = threshold(find, "invite")
    if isinstance(e.content, dict) and "third_party_invite" in e.content:
        if now == "ban":
            return Refusal("BannedUser", detail=target)
        outer = e.content["third_party_invite"]
        signed = outer.get("signed") if isinstance(outer, dict) else None
        signed = signed if isinstance(signed, dict) else {}
        for name in ("token", "mxid"):
            if not isinstance(signed.get(name), str):
                return Refusal("InvalidSyntax", detail=f"third_party_invite without signed.{name}")
        if not (isinstance(signed.get("signatures"), dict) and signed["signatures"]):
            return Refusal("InvalidSyntax", detail="third_party_invite without signatures")
        if verify and (why := verify("third_party_invite", e)):
            return Refusal("InvalidSyntax", detail=why)
        if signed["mxid"] != target:
            return Refusal("InvalidStateKey", detail=signed["mxid"])
        issued = find(THIRD_PARTY, signed["token"])
        if issued is None or issued.sender != e.sender:
            return Refusal("InvalidStateKey", detail="missing" if issued is None else e.sender)
        return _short(need, sender_level(issued.sender, find, version), "invite")
    if low := _short(need, sender_level(e.sender, find, version), "invite"):
        return low
    if now in ("join", "ban"):
        return Refusal("NotMember" if now == "join" else "BannedUser", detail=target)
    return None


def _knock(e: Event, target: str, now: str, find: Lookup, version: str) -> Refusal | None:
    if target != e.sender:
        return Refusal("InvalidStateKey", detail=target)
    if now == "ban":
        return Refusal("BannedUser", detail=e.sender)
    rules = find(JOIN_RULES, "")
    if now in ("invite", "join") or not rules or rules.text("join_rule") not in ("knock", "knock_restricted"):
        return Refusal("NotMember", detail=e.sender)
    return None


_MEMBER_RULES = {"join": _join, "leave": _leave, "ban": _ban, "knock": _knock}


def _member(e: Event, find: Lookup, version: str, verify) -> Refusal | None:
    target, new = e.state_key or "", e.text("membership") or ""
    now = membership(target, find)
    if new == "ban" and target == e.sender:
        return Refusal("InvalidStateKey", detail=target)
    if new == "invite":
        no = _invite(e, target, now, find, version, verify)
    elif new in _MEMBER_RULES:
        no = _MEMBER_RULES[new](e, target, now, find, version)
    else:
        no = Refusal("InvalidSyntax", detail=f"unknown membership: {new}")
    if no is None and target != e.sender and new in ("leave", "ban"):
        mine, theirs = sender_level(e.sender, find, version), sender_level(target, find, version)
        if mine <= theirs:
            return Refusal("InsufficientPowerLevel", min(theirs + 1, CREATOR_LEVEL), mine, "member above target")
    return no


def malformed(e: Event) -> str | None:
    if len(e.prev) > MAX_PREV:
        return "too many prev_events"
    if len(e.auth) > MAX_AUTH:
        return "too many auth_events"
    return None if e.type else "empty type"


def check(e: Event, find: Lookup, version: str, verify: Callable[[str, Event], str | None] | None = None) -> Refusal | None:
    """The first rule that refuses the event against a state, or None. verify(step, event) may give a reason to refuse."""
    if why := malformed(e):
        return Refusal("InvalidSyntax", detail=why)
    for step in ("event_id_hash", "signatures", "content_hash") if verify else ():
        if why := verify(step, e):
            return Refusal("InvalidSyntax", detail=why)
    if e.type == CREATE:
        return Refusal("CreateWithPrevEvents") if e.prev else None
    own = find(MEMBER, e.sender)
    role = (own.text("membership") or "leave") if own else "leave"
    if own is None and (made := find(CREATE, "")) and made.sender == e.sender:
        role = "join"
    if role == "ban":
        return Refusal("BannedUser", detail=e.sender)
    if role != "join" and not (e.type == MEMBER and e.state_key == e.sender and e.text("membership") != "ban"):
        return Refusal("NotMember", detail=e.sender)
    if e.type == MEMBER:
        return _member(e, find, version, verify)
    if not (e.type == LEVELS and find(LEVELS, "") is None):
        if low := _short(required_level(e, find), sender_level(e.sender, find, version), e.type):
            return low
    if e.state_key is not None and e.state_key.startswith("@") and e.state_key != e.sender:
        return Refusal("InvalidStateKey", detail=e.state_key)
    return None


def check_in_order(events: Iterable[Event], state: dict[Key, Event], version: str, verify=None) -> tuple[list, list[tuple[Any, Refusal]]]:
    """Accepted and refused ids of events applied one after the other."""
    state, yes, no = dict(state), [], []
    for e in events:
        refusal = check(e, lambda t, k: state.get((t, k)), version, verify)
        if refusal:
            no.append((e.id, refusal))
            continue
        yes.append(e.id)
        if e.state_key is not None or e.type == CREATE:
            state[e.type, e.state_key or ""] = e
    return yes, no


# ---------------------------------------------------------------- graph order


def ranks(ids: Iterable) -> dict:
    return {x: k for k, x in enumerate(sorted(ids))}


def auth_level(e: Event, known: Lookup | dict, create: Event | None, version: str) -> int:
    """The sender's level by the first power-levels event among the direct auth events."""
    if version in MODERN and create is not None and create.made_by(e.sender):
        return CREATOR_LEVEL
    for a in e.auth:
        pl = known.get(a)
        if pl is not None and pl.type == LEVELS and pl.state_key == "":
            for v in (pl.listed("users", e.sender), pl.level("users_default")):
                if v is not None:
                    return v
            return 0
    return e.power


def auth_distances(known: dict, create: Any) -> dict:
    """Least number of auth hops down to the create event, for every event from which it can be reached."""
    above: dict = {}
    for e in known.values():
        for a in e.auth:
            above.setdefault(a, []).append(e.id)
    dist, queue = {create: 0}, deque([create])
    while queue:
        x = queue.popleft()
        for y in above.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    return dist


def priority_order(events: dict, known, create: Event | None, version: str) -> tuple[list, list]:
    """Events ancestors first, by the version's priority among those whose ancestors are out; and what is stuck in cycles."""
    place = ranks(events)
    far = auth_distances({**getattr(known, "all", lambda: known)()}, create.id) if version == "V2_2" and create is not None else {}
    unreached = 1 << 64

    def rank(e: Event) -> tuple:
        if version == "V1":
            return -e.depth, -place[e.id]
        return -auth_level(e, known, create, version), far.get(e.id, unreached) if version == "V2_2" else 0, e.ts, place[e.id]

    waits, after = {}, {}
    for e in events.values():
        inside = [a for a in e.auth if a in events]
        waits[e.id] = len(inside)
        for a in inside:
            after.setdefault(a, []).append(e.id)
    heap = [(rank(events[x]), x) for x, n in waits.items() if not n]
    heapq.heapify(heap)
    out = []
    while heap:
        _, x = heapq.heappop(heap)
        out.append(x)
        for y in after.get(x, ()):
            waits[y] -= 1
            if not waits[y]:
                heapq.heappush(heap, (rank(events[y]), y))
    done = set(out)
    stuck = sorted((x for x in events if x not in done), key=lambda x: (events[x].ts, place[x]))
    return out, stuck


class Chain:
    """Lookup in two event sets, the first before the second."""

    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def get(self, x, default=None):
        found = self.first.get(x)
        return self.second.get(x, default) if found is None else found

    def all(self) -> dict:
        return {**self.second, **self.first}


def mainline(start: Any, known) -> list:
    """Power-levels events from the resolved one down, each the nearest by auth hops."""
    line, seen = [], set()
    while start is not None and start not in seen:
        seen.add(start)
        line.append(start)
        e = known.get(start)
        queue, met = deque(e.auth if e else ()), set()
        start = None
        while queue:
            x = queue.popleft()
            if x in met:
                continue
            met.add(x)
            a = known.get(x)
            if a is None:
                continue
            if a.type == LEVELS:
                start = x
                break
            queue.extend(a.auth)
    return line


def mainline_positions(line: list, known: dict) -> dict:
    """The least mainline index that each event reaches by auth events; events that reach none are absent.

    From each member in turn, the events above it that no earlier member claimed; a member's own chain ends at it.
    """
    above: dict = {}
    for e in known.values():
        for a in e.auth:
            above.setdefault(a, []).append(e.id)
    at = {x: k for k, x in enumerate(line)}
    for k, member in enumerate(line):
        queue = deque([member])
        while queue:
            for y in above.get(queue.popleft(), ()):
                if y not in at:
                    at[y] = k
                    queue.append(y)
    return at


def mainline_order(events: Iterable[Event], line: list, known: dict) -> list[Event]:
    at, last = mainline_positions(line, known), len(line)
    return sorted(events, key=lambda e: (-at.get(e.id, last), e.ts, e.id))


def reach(starts: Iterable, edges: Callable[[Any], Iterable], most: int | None = None) -> dict:
    """Least hops of everything that the starts reach, themselves included."""
    hops, queue = {}, deque((x, 0) for x in starts)
    while queue:
        x, n = queue.popleft()
        if x in hops:
            continue
        hops[x] = n
        if most is None or n < most:
            queue.extend((y, n + 1) for y in edges(x))
    return hops


def subgraph(known: dict, seeds: Iterable, most: int | None = None) -> tuple[set, set]:
    """Known events both above and below seeds by auth events (seeds included), and references that are unknown."""
    seeds = list(seeds)
    below = reach(seeds, lambda x: known[x].auth if x in known else (), most)
    above: dict = {}
    for e in known.values():
        for a in e.auth:
            above.setdefault(a, []).append(e.id)
    up = reach(seeds, lambda x: above.get(x, ()))
    walked = [x for x, n in below.items() if x in known and (most is None or n < most)]
    missing = {a for x in walked for a in known[x].auth if a not in known}
    return {x for x in below if x in up and x in known}, missing


def merge_base(tips: list, known: dict) -> Any:
    """The deepest event (then largest id) that all tips reach by prev events, or None."""
    if not tips or any(t not in known for t in tips):
        return None
    common = None
    for t in tips:
        got = set(reach([t], lambda x: [p for p in known[x].prev if p in known]))
        common = got if common is None else common & got
    return max(common, key=lambda x: (known[x].depth, x), default=None)


# ---------------------------------------------------------------- domination


def surviving(conflicted: dict, context: dict) -> dict:
    """The conflicted events that no concurrent administrative action of higher priority dominates, directly or by auth."""
    near, queue, seen = dict(conflicted), deque(), set(conflicted)
    queue.extend(a for e in conflicted.values() for a in (*e.prev, *e.auth))
    while queue:
        x = queue.popleft()
        if x in seen:
            continue
        seen.add(x)
        if x in context:
            near[x] = context[x]
            queue.extend((*context[x].prev, *context[x].auth))
    kind = {LEVELS: 0, JOIN_RULES: 1}
    by_priority = sorted(conflicted.values(), key=lambda e: (-e.power, kind.get(e.type, 2), e.ts, e.id))
    admins = [e for e in by_priority if e.removes() or e.type == LEVELS or e.locks()]
    bit = {e.id: 1 << k for k, e in enumerate(admins)}
    order = sorted(near.values(), key=lambda e: (e.depth, e.id))
    below, above = {e.id: bit.get(e.id, 0) for e in order}, {e.id: bit.get(e.id, 0) for e in order}
    for e in order:
        for p in (*e.prev, *e.auth):
            below[e.id] |= below.get(p, 0)
    for e in reversed(order):
        for p in (*e.prev, *e.auth):
            if p in above:
                above[p] |= above[e.id]
    rank = {e.id: k for k, e in enumerate(by_priority)}
    gone: set = set()
    for e in by_priority:
        related = below[e.id] | above[e.id]
        for a in admins:
            if rank[a.id] >= rank[e.id]:
                break
            if a.id not in gone and not related & bit[a.id] and a.restricts(e):
                gone.add(e.id)
                break
    return {x: e for x, e in conflicted.items() if x not in dependents(conflicted, gone)}


def dependents(events: dict, gone: Iterable) -> set:
    """The given ids and all events that lead to them by auth events within the set."""
    above: dict = {}
    for e in events.values():
        for a in e.auth:
            above.setdefault(a, []).append(e.id)
    return set(reach(gone, lambda x: above.get(x, ())))


# ---------------------------------------------------------------- resolution

#: What the resolved state answers, by version and phase (power phase or not); the rest is left to local authority.
_ANSWERS = {
    ("V2_1", True): "levels",
    ("V2_1_1", True): "levels and removals",
    ("V2_1_1", False): "levels and members",
}


class View:
    """What a check sees while events are folded: the resolved state, then local authority, then the create event."""

    def __init__(self, resolved: State, conflicted: dict, context: dict, create: Event | None, version: str, power: bool):
        self.resolved, self.conflicted, self.context, self.create, self.version, self.power = resolved, conflicted, context, create, version, power
        self.answers = _ANSWERS.get((version, power), "all")
        self.local: dict[Key, Event] = {}

    def event(self, x: Any) -> Event | None:
        found = self.context.get(x)
        return self.conflicted.get(x) if found is None else found

    def settled(self, key: Key) -> Event | None:
        x = self.resolved.get(key)
        return None if x is None else self.event(x)

    def __call__(self, kind: str, state_key: str) -> Event | None:
        key = kind, state_key
        asks_levels = key == (LEVELS, "")
        if self.answers == "all" or asks_levels or (kind == MEMBER and self.answers != "levels"):
            e = self.settled(key)
            if e is not None and (kind != MEMBER or self.answers != "levels and removals" or e.text("membership") == "ban" or (e.text("membership") == "leave" and e.sender != state_key)):
                return e
        e = self.local.get(key)
        if e is None:
            return self.create if key == (CREATE, "") else None
        if self.power and self.version in MODERN and kind in (LEVELS, JOIN_RULES) and e.id in self.conflicted:
            return self.settled(key)  # a disputed event speaks only once it is resolved
        return e


def local_authority(e: Event, conflicted: dict, context: dict, version: str) -> dict[Key, Event]:
    """The nearest auth event for each key: direct ones, or through the chain in the versions that look through."""

    def event(x):
        found = context.get(x)
        return conflicted.get(x) if found is None else found

    out: dict[Key, Event] = {}
    level_, seen = list(e.auth), set()
    while level_:
        deeper = []
        for x in level_:
            if x in seen:
                continue
            seen.add(x)
            a = event(x)
            if a is None:
                continue
            if a.key is not None:
                out.setdefault(a.key, a)
            if version in TRANSITIVE:
                deeper.extend(a.auth)
        level_ = deeper
    return out


def is_power(e: Event, version: str) -> bool:
    return e.type in (CREATE, LEVELS, JOIN_RULES) or (e.removes() if version in MODERN else e.type == MEMBER)


@dataclass(slots=True)
class Step:
    id: Any
    accepted: bool
    key: Key
    replaced: Any
    phase: str


class Resolution:
    """One conflict, resolved step by step. unconflicted: agreed state; context: events to look up authority in."""

    def __init__(self, unconflicted: State, conflicted: dict, context: dict, version: str, verify=None):
        if version not in VERSIONS:
            raise ValueError(f"unknown version: {version}")
        self.agreed, self.context, self.version, self.verify = unconflicted, context, version, verify
        self.disputed = set(conflicted)
        self.conflicted = surviving(conflicted, context) if version == "V2_1_1" else dict(conflicted)
        self.known = Chain(self.conflicted, context)
        self.resolved: State = {} if version in MODERN else dict(unconflicted)
        self.steps: list[Step] = []
        agreed_create = unconflicted.get((CREATE, ""))
        self.create = None
        if agreed_create is not None:
            self.create = context.get(agreed_create) or self.conflicted.get(agreed_create)
        if self.create is None:
            self.create = min((e for e in self.conflicted.values() if e.type == CREATE), key=lambda e: e.id, default=None)

    def split(self) -> tuple[dict, dict]:
        """Power events, with what they depend on, and the others."""
        power = {x: e for x, e in self.conflicted.items() if is_power(e, self.version)}
        if self.version != "V1":
            inside = reach(power, lambda x: [a for a in self.conflicted[x].auth if a in self.conflicted])
            power = {x: self.conflicted[x] for x in inside}
        rest = {x: e for x, e in self.conflicted.items() if x not in power}
        if self.version in MODERN:
            kinds = {LEVELS, CREATE} | ({JOIN_RULES} if self.version == "V2_1" else set())
            starts = [a for e in power.values() for a in e.auth]
            for x in reach(starts, lambda x: self.context[x].auth if x in self.context else ()):
                if x not in self.disputed and x in self.context and self.context[x].type in kinds:
                    power[x] = self.context[x]
        return power, rest

    def fold(self, events: Iterable[Event], power: bool) -> None:
        """Applies each event that is authorized by what is resolved so far."""
        view = View(self.resolved, self.conflicted, self.context, self.create, self.version, power)
        for e in events:
            view.local = local_authority(e, self.conflicted, self.context, self.version)
            ok = check(e, view, self.version, self.verify) is None
            if e.key is None:
                continue
            if not power or e.id in self.disputed:
                self.steps.append(Step(e.id, ok, e.key, self.resolved.get(e.key), "Power" if power else "NonPower"))
            if ok:
                self.resolved[e.key] = e.id

    def power_phase(self) -> dict:
        power, rest = self.split()
        out, stuck = priority_order(power, self.known, self.create, self.version)
        self.fold((e for e in map(self.known.get, [*out, *stuck]) if e is not None), True)
        return rest

    def line(self) -> list:
        return mainline(self.resolved.get((LEVELS, "")), self.known)

    def run(self) -> State:
        rest = self.power_phase()
        self.fold(mainline_order(rest.values(), self.line(), self.known.all()), False)
        return {**self.agreed, **self.resolved}

    def run_lattice(self) -> State:
        """Each key's best authorized event against the state after the power phase, whatever the order."""
        rest = self.power_phase()
        line = self.line()
        at = mainline_positions(line, self.known.all())
        view = View(self.resolved, self.conflicted, self.context, self.create, self.version, False)
        best: dict[Key, Event] = {}
        rank = lambda e: (-at.get(e.id, len(line)), e.ts, e.id)
        for e in rest.values():
            view.local = local_authority(e, self.conflicted, self.context, self.version)
            if e.key is not None and check(e, view, self.version, self.verify) is None and (e.key not in best or rank(e) > rank(best[e.key])):
                best[e.key] = e
        return {**self.agreed, **self.resolved, **{k: e.id for k, e in best.items()}}


def resolve(unconflicted: State, conflicted: dict, context: dict, version: str, verify=None) -> State:
    return Resolution(unconflicted, conflicted, context, version, verify).run()


def resolve_checkpoint(snapshot: State, conflicted: dict, context: dict, version: str, verify=None) -> State:
    """resolve() over a trusted snapshot. The authority of the conflicted events must be known down to its end: what lacks raises."""
    known = Chain(conflicted, context)
    chain = reach(conflicted, lambda x: e.auth if (e := known.get(x)) else ())
    missing = sorted(str(x) for x in chain if known.get(x) is None)
    if missing:
        raise ValueError(f"the authority of the conflicted events is incomplete: {', '.join(missing[:5])}")
    return resolve(snapshot, conflicted, context, version, verify)


def resolve_traced(unconflicted: State, conflicted: dict, context: dict, version: str) -> tuple[State, list[Step]]:
    r = Resolution(unconflicted, conflicted, context, version)
    return r.run(), r.steps


def resolve_lattice(unconflicted: State, conflicted: dict, context: dict, version: str) -> State:
    return Resolution(unconflicted, conflicted, context, version).run_lattice()


# ---------------------------------------------------------------- states of heads


def partition(states: list[State]) -> tuple[State, set]:
    """What all states agree on, and the ids of every other entry."""
    votes: dict[Key, dict] = {}
    for s in states:
        for k, x in s.items():
            ids = votes.setdefault(k, {})
            ids[x] = ids.get(x, 0) + 1
    agreed = {k: next(iter(ids)) for k, ids in votes.items() if len(ids) == 1 and next(iter(ids.values())) == len(states)}
    return agreed, {x for k, ids in votes.items() if k not in agreed for x in ids}


def chain_of(starts: Iterable, events: dict) -> set:
    """The starts and everything below them by auth events."""
    return set(reach(starts, lambda x: events[x].auth if x in events else ()))


def last_state(head: Any, events: dict, with_ts: bool = False) -> State:
    """The last event for each key among a head and its ancestors, by depth (then time, if asked), then id."""
    got = [events[x] for x in reach([head], lambda x: [p for p in events[x].prev if p in events] if x in events else ()) if x in events]
    got.sort(key=lambda e: (e.depth, e.ts if with_ts else 0, e.id))
    return {e.key: e.id for e in got if e.key is not None}


def heads_of(events: dict) -> list:
    used = {p for e in events.values() for p in e.prev}
    return sorted(x for x in events if x not in used)


def stamp_levels(events: dict, version: str) -> None:
    """Writes each sender's level, by the power-levels event that a rough order puts last, into the events."""
    creator = next((e.sender for e in sorted(events.values(), key=lambda e: e.id) if e.type == CREATE), "")
    rough = {x: Event(e.id, e.type, e.state_key, e.sender, e.ts, e.depth, 100 if e.type == CREATE or (creator and e.sender == creator) else 0, e.prev, e.auth, e.content) for x, e in events.items() if e.type in (CREATE, LEVELS, JOIN_RULES, MEMBER)}
    create = min((e for e in events.values() if e.type == CREATE), key=lambda e: e.id, default=None)
    out, stuck = priority_order(rough, events, create, version)
    last = next((events[x] for x in reversed([*out, *stuck]) if rough[x].key == (LEVELS, "")), None)
    users, default = {}, 0
    if last is not None and isinstance(last.content, dict):
        plain = lambda v: isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63
        users = {u: v for u, v in (last.content.get("users") or {}).items() if plain(v)} if isinstance(last.content.get("users"), dict) else {}
        default = last.content.get("users_default", 0) if plain(last.content.get("users_default")) else 0
    for e in events.values():
        e.power = users.get(e.sender, default)


def resolve_heads(heads: list, events: dict, version: str, verify=None) -> State:
    """The state that a room's heads resolve to: disputed entries, what the heads' chains differ in and, in V2_1 and V2_1_1, the subgraph."""
    agreed, disputed = partition([last_state(h, events) for h in heads])
    chains = [chain_of([h], events) - {h} for h in heads if h in events]
    differ = set().union(*chains) - set.intersection(*chains) if chains else set()
    wanted = disputed | differ
    if version in ("V2_1", "V2_1_1"):
        wanted |= subgraph(events, disputed)[0]
    return resolve(agreed, {x: events[x] for x in wanted if x in events}, events, version, verify)


def merge_states(states: list[State], events: dict, version: str) -> State:
    """The state where branches meet: differing entries and what their chains reach beyond the agreed state's."""
    if all(s == states[0] for s in states[1:]):
        return states[0]
    agreed = {k: x for k, x in states[0].items() if all(s.get(k) == x for s in states[1:])}
    disputed = {x for s in states for k, x in s.items() if agreed.get(k) != x}
    wanted = disputed | (chain_of(disputed, events) - chain_of(agreed.values(), events))
    return resolve(agreed, {x: events[x] for x in wanted if x in events}, events, version)


def merge_simple(states: list[State], events: dict, version: str) -> State:
    """The delta report's merge: disputed entries alone, in the context of their subgraph."""
    if all(s == states[0] for s in states[1:]):
        return states[0]
    agreed, disputed = partition(states)
    inside, _ = subgraph(events, disputed)
    return resolve(agreed, {x: events[x] for x in disputed if x in events}, {x: events[x] for x in inside}, version)


class Cycle(ValueError):
    """Events that lead to themselves by prev events."""


def order_by_prev(wanted: Iterable, events: dict) -> list:
    """The wanted events and their ancestors, ancestors first; a cycle raises."""
    around = [x for x in reach(wanted, lambda x: [p for p in events[x].prev if p in events])]
    waits = {x: sum(p in events for p in events[x].prev) for x in around}
    after: dict = {}
    for x in around:
        for p in events[x].prev:
            if p in events:
                after.setdefault(p, []).append(x)
    queue, out = deque(x for x in around if not waits[x]), []
    while queue:
        x = queue.popleft()
        out.append(x)
        for y in after.get(x, ()):
            waits[y] -= 1
            if not waits[y]:
                queue.append(y)
    if len(out) != len(around):
        raise Cycle(f"{len(around) - len(out)} events are in or above a cycle")
    return out


def states_at(targets: Iterable, events: dict, version: str, merge=merge_states):
    """(id, state after it) of each known target; a state is dropped once all its children have it."""
    wanted = {t for t in targets if t in events}
    order = order_by_prev(wanted, events)
    inside = set(order)
    uses = dict.fromkeys(order, 0)
    for x in order:
        for p in set(events[x].prev):
            if p in inside:
                uses[p] += 1
    after: dict = {}
    for x in order:
        e = events[x]
        parents = [p for p in dict.fromkeys(e.prev) if p in inside]
        before = [after[p] for p in parents]
        state = {} if not before else before[0] if len(before) == 1 else merge(before, events, version)
        for p in parents:
            uses[p] -= 1
            if not uses[p]:
                del after[p]
        if e.key is not None:
            state = {**state, e.key: x}
        if x in wanted:
            yield x, state
        if uses[x]:
            after[x] = state


def components(events: dict, prev: bool = True, auth: bool = True) -> list:
    """The least event, by depth, then id, of each connected component; sorted."""
    near: dict = {x: [] for x in events}
    for e in events.values():
        for p in (*(e.prev if prev else ()), *(e.auth if auth else ())):
            if p in events:
                near[e.id].append(p)
                near[p].append(e.id)
    seen, out = set(), []
    for x in events:
        if x not in seen:
            group = reach([x], near.__getitem__)
            seen.update(group)
            out.append(min(group, key=lambda y: (events[y].depth, y)))
    return sorted(out)


# ---------------------------------------------------------------- hashes and deltas

#: FNV-1a offset and prime, by bits.
FNV = {64: (14695981039346656037, 1099511628211), 128: (0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B)}


def state_hash(state: State, bits: int = 128) -> str:
    """FNV-1a of type, 0, key, 0, id, 255 of every entry in key order, in hexadecimal."""
    h, prime = FNV[bits]
    mask = (1 << bits) - 1
    for (kind, key), x in sorted(state.items()):
        for b in b"".join((kind.encode(), b"\0", key.encode(), b"\0", str(x).encode(), b"\xff")):
            h = (h ^ b) * prime & mask
    return f"{h:0{bits // 4}x}"


def delta(before: State, after: State) -> list[tuple[str, str, Any]]:
    """(type, state_key, id or None for a removal) of each entry that differs, in key order."""
    return [(*k, after.get(k)) for k in sorted({*before, *after}) if before.get(k) != after.get(k)]


def apply_delta(state: State, changes: Iterable[tuple[str, str, Any]]) -> State:
    out = dict(state)
    for kind, key, x in changes:
        if x is None:
            out.pop((kind, key), None)
        else:
            out[kind, key] = x
    return out


@dataclass(slots=True)
class Checkpoint:
    state_hash: str
    parent_hash: str | None
    event_id: Any
    deltas: list
    snapshot: State | None


def compact(states: Iterable[tuple[Any, State]], most: int = 100) -> list[Checkpoint]:
    """A chain of deltas with a whole state at first and after every `most` entries."""
    out: list[Checkpoint] = []
    before: State = {}
    for n, (x, state) in enumerate(states):
        whole = n % max(most, 1) == 0
        out.append(Checkpoint(state_hash(state), out[-1].state_hash if out else None, x, [] if whole else delta(before, state), dict(state) if whole else None))
        before = state
    return out


def rebuild(chain: list[Checkpoint], index: int) -> State | None:
    """The state at an index; None if the index or a link of the chain is missing."""
    if not 0 <= index < len(chain):
        return None
    held = []
    while chain[index].snapshot is None:
        held.append(chain[index].deltas)
        wanted = chain[index].parent_hash
        if wanted is None:
            return None
        index = next((k for k in range(index - 1, -1, -1) if chain[k].state_hash == wanted), None)
        if index is None:
            return None
    state = chain[index].snapshot
    for changes in reversed(held):
        state = apply_delta(state, changes)
    return state
