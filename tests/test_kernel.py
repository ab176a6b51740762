"""The kernel: orders, folds and rules, on small rooms written here."""

import itertools
import random

import pytest

from forkweave.operators import kernel as k


def ev(id, type, key=None, sender="@a:x", ts=0, depth=0, prev=(), auth=(), power=0, **content):
    return k.Event(id, f"m.room.{type}", key, sender, ts, depth, power, tuple(prev), tuple(auth), content)


def room(*more, public=True):
    base = [
        ev("c", "create", "", depth=1, room_version="11"),
        ev("ja", "member", "@a:x", depth=2, prev=["c"], auth=["c"], membership="join"),
        ev("pl", "power_levels", "", depth=3, prev=["ja"], auth=["c", "ja"], users={"@a:x": 100, "@b:x": 50}),
        ev("jr", "join_rules", "", depth=4, prev=["pl"], auth=["c", "ja", "pl"], join_rule="public" if public else "invite"),
        ev("jb", "member", "@b:x", "@b:x", depth=5, prev=["jr"], auth=["c", "pl", "jr"], membership="join"),
        *more,
    ]
    return {e.id: e for e in base}


TOPICS = (
    ev("ta", "topic", "", "@a:x", 10, 6, ["jb"], ["c", "ja", "pl"], topic="a"),
    ev("tb", "topic", "", "@b:x", 20, 6, ["jb"], ["c", "jb", "pl"], topic="b"),
)


@pytest.mark.parametrize("version", k.VERSIONS)
def test_later_topic_wins(version):
    events = room(*TOPICS)
    assert k.resolve_heads(["ta", "tb"], events, version)["m.room.topic", ""] == "tb"


@pytest.mark.parametrize("version", k.VERSIONS)
def test_order_of_input_does_not_matter(version):
    events = room(*TOPICS, ev("bb", "member", "@b:x", "@a:x", 15, 7, ["ta"], ["c", "ja", "pl", "jb"], membership="ban"))
    want = k.resolve_heads(["bb", "tb"], events, version)
    rng = random.Random(1)
    for _ in range(5):
        ids = list(events)
        rng.shuffle(ids)
        assert k.resolve_heads(["tb", "bb"], {x: events[x] for x in ids}, version) == want


def test_ban_beats_concurrent_topic():
    events = room(TOPICS[1], ev("bb", "member", "@b:x", "@a:x", 15, 6, ["jb"], ["c", "ja", "pl", "jb"], membership="ban"))
    for version in ("V2", "V2_1", "V2_1_1"):
        state = k.resolve_heads(["tb", "bb"], events, version)
        assert state["m.room.member", "@b:x"] == "bb" and ("m.room.topic", "") not in state


def test_priority_order_is_no_level_order():
    # a low event leads to a high one: what is deep and high still goes before what is shallow and low
    known = {"p": ev("p", "power_levels", "", users={"@hi:x": 100, "@lo:x": 1})}
    events = {
        "a": ev("a", "join_rules", "", "@hi:x", 5, auth=["p"]),
        "b": ev("b", "join_rules", "", "@hi:x", 9, auth=["p", "a"]),
        "z": ev("z", "join_rules", "", "@lo:x", 1, auth=["p"]),
    }
    assert k.priority_order(events, {**known, **events}, None, "V2") == (["a", "b", "z"], [])
    assert k.priority_order({x: k.Event(x, "t", depth=d) for x, d in (("a", 1), ("b", 3), ("c", 3))}, {}, None, "V1")[0] == ["c", "b", "a"]


def test_each_tie_level():
    e = {x: ev(x, "topic", "", ts=ts, power=p) for x, ts, p in (("d", 1, 0), ("c", 1, 0), ("b", 0, 0), ("a", 9, 5))}
    assert k.priority_order(e, e, None, "V2")[0] == ["a", "b", "c", "d"]
    create = ev("cr", "create", "", "@z:x")
    far = {"cr": create, "m": ev("m", "topic", "", auth=["cr"]), "x": ev("x", "topic", "", ts=0, auth=["m"]), "y": ev("y", "topic", "", ts=9, auth=["cr"])}
    two = {i: far[i] for i in ("x", "y")}
    assert k.priority_order(two, far, create, "V2_1_1")[0] == ["x", "y"]
    assert k.priority_order(two, far, create, "V2_2")[0] == ["y", "x"]


def test_cycles_go_last_by_time():
    e = {"a": ev("a", "topic", "", ts=5, auth=["b"]), "b": ev("b", "topic", "", ts=3, auth=["a"]), "c": ev("c", "topic", "", ts=9)}
    assert k.priority_order(e, e, None, "V2") == (["c"], ["b", "a"])
    loop = {"a": ev("a", "topic", "", prev=["b"]), "b": ev("b", "topic", "", prev=["a"])}
    with pytest.raises(k.Cycle):
        list(k.states_at(["a"], loop, "V2"))


def test_integer_ids():
    events = {n: k.Event(n, e.type, e.state_key, e.sender, e.ts, e.depth, 0, tuple(list(room(*TOPICS)).index(p) for p in e.prev), tuple(list(room(*TOPICS)).index(p) for p in e.auth), e.content) for n, e in enumerate(room(*TOPICS).values())}
    assert k.resolve_heads([5, 6], events, "V2")["m.room.topic", ""] == 6


def test_levels_from_json():
    top = k.TOP_LEVEL
    cases = [("50", 50), ("+7", 7), ("-3", -3), (50, 50), (50.0, None), ("abc", None), (" 5", None), ("", None), (True, None), (None, None), (1 << 63, top), (-(1 << 60), -top), ("9" * 30, None)]
    for v, want in cases:
        assert k.level(v) == want, v


def state(*events):
    return lambda t, s: {(e.type, e.state_key): e for e in events}.get((t, s))


def refusal(e, *events, version="V2", **kw):
    r = k.check(e, state(*events), version, **kw)
    return r and r.code


A, B = room()["ja"], room()["jb"]
PL, JR, CREATE = room()["pl"], room()["jr"], room()["c"]


def member(user, role, sender=None, **more):
    return ev("m", "member", user, sender or user, membership=role, **more)


def test_rules():
    inside = (CREATE, A, B, PL, JR)
    assert refusal(ev("x", "create", "")) is None and refusal(ev("x", "create", "", prev=["y"])) == "CreateWithPrevEvents"
    assert refusal(ev("x", "topic", "", "@q:x"), *inside) == "NotMember"
    assert refusal(ev("x", "topic", "", "@b:x"), *inside) is None
    assert refusal(ev("x", "topic", "", "@b:x"), CREATE, B, PL, JR, member("@b:x", "ban", "@a:x")) == "BannedUser"
    assert refusal(ev("x", "topic", "@a:x", "@b:x"), *inside) == "InvalidStateKey"
    assert refusal(member("@q:x", "join"), *inside) is None
    invite = ev("r", "join_rules", "", join_rule="invite")
    assert refusal(member("@q:x", "join"), CREATE, A, PL, invite) == "NotMember"
    assert refusal(member("@q:x", "join"), CREATE, A, PL, invite, member("@q:x", "invite", "@a:x")) is None
    assert refusal(member("@a:x", "join"), CREATE, PL, invite) is None
    assert refusal(member("@q:x", "join", "@b:x"), *inside) == "InvalidStateKey"
    assert refusal(member("@b:x", "ban"), *inside) == "InvalidStateKey"
    assert refusal(member("@a:x", "ban", "@b:x"), *inside) == "InsufficientPowerLevel"
    assert refusal(member("@b:x", "ban", "@a:x"), *inside) is None
    assert refusal(member("@q:x", "leave", "@b:x"), *inside, member("@q:x", "ban", "@a:x")) is None
    assert refusal(member("@q:x", "leave"), *inside) == "NotMember"
    assert refusal(member("@b:x", "leave"), *inside) is None
    assert refusal(member("@q:x", "dance"), *inside) == "InvalidSyntax"
    assert refusal(member("@q:x", "knock"), *inside) == "NotMember"
    assert refusal(member("@q:x", "knock"), CREATE, A, PL, ev("r", "join_rules", "", join_rule="knock")) is None
    assert refusal(member("@b:x", "invite", "@a:x"), *inside) == "NotMember"
    assert refusal(member("@q:x", "invite", "@a:x"), *inside) is None
    limited = ev("r", "join_rules", "", join_rule="restricted")
    assert refusal(member("@q:x", "join"), CREATE, A, PL, limited) == "NotMember"
    assert refusal(member("@q:x", "join", join_authorised_via_users_server="@a:x"), CREATE, A, PL, limited) is None
    assert refusal(ev("x", "power_levels", ""), CREATE, A) is None
    assert refusal(ev("x", "topic", ""), CREATE, A) == "InsufficientPowerLevel"
    assert refusal(ev("x", "topic", ""), CREATE, A, version="V2_1") is None
    assert refusal(ev("x", "topic", "", prev=["p"] * 21), *inside) == "InvalidSyntax"
    assert refusal(ev("x", "topic", ""), *inside, verify=lambda step, e: "bad" if step == "signatures" else None) == "InvalidSyntax"


def test_third_party_invites():
    signed = {"token": "t", "mxid": "@q:x", "signatures": {"s": {}}}
    issued = ev("t", "third_party_invite", "t", "@a:x")
    ask = lambda **s: member("@q:x", "invite", "@a:x", third_party_invite={"signed": {**signed, **s}})
    inside = (CREATE, A, PL, JR)
    assert refusal(ask(), *inside, issued) is None and refusal(ask(), *inside) == "InvalidStateKey"
    assert refusal(ask(token=5), *inside, issued) == refusal(ask(signatures={}), *inside, issued) == "InvalidSyntax"
    assert refusal(ask(mxid="@o:x"), *inside, issued) == "InvalidStateKey"
    assert refusal(ask(), *inside, issued, member("@q:x", "ban", "@a:x")) == "BannedUser"


def test_chain_of_checks():
    yes, no = k.check_in_order([CREATE, A, PL, JR, B, ev("x", "topic", "", "@q:x")], {}, "V2")
    assert yes == ["c", "ja", "pl", "jr", "jb"] and [(x, r.code) for x, r in no] == [("x", "NotMember")]


def test_domination():
    ban = ev("ban", "member", "@b:x", "@a:x", 5, 6, ["jb"], ["pl"], power=100, membership="ban")
    name = ev("name", "name", "", "@b:x", 6, 6, ["jb"], ["pl", "jb"], power=50)
    on_top = ev("top", "topic", "", "@c:x", 7, 7, ["name"], ["name"])
    after = ev("after", "name", "", "@b:x", 8, 7, ["ban"], ["pl"], power=50)
    got = k.surviving({e.id: e for e in (ban, name, on_top, after)}, room())
    assert set(got) == {"ban", "after"}


def test_lattice_equals_fold_here():
    events = room(*TOPICS)
    agreed, disputed = k.partition([k.last_state(h, events) for h in ("ta", "tb")])
    conflict = {x: events[x] for x in disputed}
    for version in k.VERSIONS:
        assert k.resolve(agreed, conflict, events, version) == k.resolve_lattice(agreed, conflict, events, version)


def test_best_entry_is_associative():
    entries = [(0, 3, "b"), (1, 9, "z"), (0, 3, "a"), (0, 2, "c")]
    best = lambda xs: max(xs, key=lambda x: (-x[0], x[1], x[2]))
    for p in itertools.permutations(entries):
        assert best([best(p[:2]), best(p[2:])]) == best(entries) == (0, 3, "b")


def test_trace():
    events = room(*TOPICS)
    agreed, disputed = k.partition([k.last_state(h, events) for h in ("ta", "tb")])
    got, steps = k.resolve_traced(agreed, {x: events[x] for x in disputed}, events, "V2")
    assert [(s.id, s.accepted, s.replaced, s.phase) for s in steps] == [("ta", True, None, "NonPower"), ("tb", True, "ta", "NonPower")]
    assert got == k.resolve(agreed, {x: events[x] for x in disputed}, events, "V2")


def test_states_at():
    events = room(*TOPICS, ev("m", "message", None, "@a:x", 30, 7, ["ta", "tb"], ["pl"]))
    got = dict(k.states_at(["m", "ta", "no"], events, "V2"))
    assert set(got) == {"m", "ta"} and got["m"]["m.room.topic", ""] == "tb" and got["ta"]["m.room.topic", ""] == "ta"
    assert dict(k.states_at(["m"], events, "V2"))["m"] == got["m"]
    orphan = {"x": ev("x", "topic", "", prev=["gone"])}
    assert dict(k.states_at(["x"], orphan, "V2")) == {"x": {("m.room.topic", ""): "x"}}


def test_graph():
    e = {x: ev(x, "topic", "", depth=d, prev=p, auth=p) for x, d, p in (("a", 1, []), ("b", 2, ["a"]), ("c", 2, ["a"]), ("d", 3, ["b", "c"]), ("e", 9, ["?"]))}
    assert k.merge_base(["b", "c"], e) == "a" and k.merge_base(["d"], e) == "d" and k.merge_base(["d", "e"], e) is None and k.merge_base(["?"], e) is None
    assert k.subgraph(e, ["a", "d"]) == ({"a", "b", "c", "d"}, set()) and k.subgraph(e, ["e"]) == ({"e"}, {"?"}) and k.subgraph(e, []) == (set(), set())
    assert k.subgraph(e, ["d", "a"], 1)[0] == {"a", "b", "c", "d"}
    assert k.components(e) == ["a", "e"] and k.auth_distances(e, "a")["d"] == 2


def test_mainline():
    known = {"p1": ev("p1", "power_levels", ""), "p2": ev("p2", "power_levels", "", auth=["p1"]), "x": ev("x", "topic", "", auth=["p2"]), "y": ev("y", "topic", "", auth=["p1"]), "z": ev("z", "topic", ""), "w": ev("w", "topic", "", auth=["y", "x"])}
    line = k.mainline("p2", known)
    assert line == ["p2", "p1"] and k.mainline(None, known) == []
    assert k.mainline_positions(line, known) == {"p2": 0, "p1": 1, "x": 0, "y": 1, "w": 0}
    assert [e.id for e in k.mainline_order([known[i] for i in "wxyz"], line, known)] == ["z", "y", "w", "x"]


def test_hash_and_deltas():
    s = {("a", ""): "1", ("b", "k"): "2"}
    assert k.state_hash({}) == "6c62272e07bb014262b821756295c58d" and k.state_hash({}, 64) == "cbf29ce484222325"
    assert k.state_hash(s) == k.state_hash(dict(reversed(s.items()))) != k.state_hash({("a", ""): "1"})
    t = {("a", ""): "9", ("c", ""): "3"}
    assert k.delta(s, t) == [("a", "", "9"), ("b", "k", None), ("c", "", "3")] and k.apply_delta(s, k.delta(s, t)) == t
    rng = random.Random(3)
    states = [("e0", {})]
    for n in range(1, 40):
        new = dict(states[-1][1])
        new[rng.choice("abc"), rng.choice("xy")] = str(n % 7)
        if rng.random() < 0.2:
            new.pop(next(iter(new)))
        states.append((f"e{n}", new))
    chain = k.compact(states, 7)
    assert [c.snapshot is not None for c in chain[:9]] == [True, *[False] * 6, True, False]
    assert [k.rebuild(chain, n) for n in range(40)] == [x for _, x in states] and k.rebuild(chain, 40) is None
    chain[1].parent_hash = "gone"
    assert k.rebuild(chain, 1) is None
