"""Authorization as joins: every event against a fixed state, all rooms at once, one verdict code per event.

events: typed columns (functions.content.typed) with n_prev and n_auth. state: room_id, type, state_key and the typed
columns of the events that hold its keys, with their sender. The rules and their order are those of the kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREATOR = (1 << 63) - 1
DEFAULTS = {"ban": 50, "kick": 50, "invite": 0, "redact": 50}


def _part(state: DataFrame, kind: str, prefix: str, cols: list[str], key: str | None = None) -> DataFrame:
    rows = state.where(F.col("type") == kind)
    if key is None:
        rows = rows.where(F.col("state_key") == "")
    keep = [F.col("room_id").alias(f"{prefix}_room")] + ([] if key is None else [F.col("state_key").alias(f"{prefix}_key")])
    return rows.select(*keep, F.lit(True).alias(f"{prefix}_is"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def level_of(user: Column, version: str) -> Column:
    """A user's level, over the joined levels (pl_) and create event (cr_)."""
    plain = F.coalesce(F.try_element_at("pl_users", user), F.col("pl_users_default"), F.lit(0).cast("long"))
    if not version.startswith("V2_"):
        return plain
    return F.when(F.coalesce((F.col("cr_sender") == user) | F.array_contains("cr_additional_creators", user), F.lit(False)), F.lit(CREATOR)).otherwise(plain)


def threshold(action: str) -> Column:
    return F.coalesce(F.col(f"pl_{action}"), F.lit(DEFAULTS[action]).cast("long"))


def required() -> Column:
    """The level that an event needs by its type."""
    state = F.col("state_key").isNotNull()
    rest = F.when(state, F.coalesce("pl_state_default", F.lit(50))).otherwise(F.coalesce("pl_events_default", F.lit(0)))
    with_levels = F.coalesce(F.try_element_at("pl_events", F.col("type")), rest)
    return F.when(F.col("type") == "m.room.third_party_invite", F.coalesce("pl_invite", F.lit(0))).when(F.col("pl_is"), with_levels).otherwise(F.when(state, 50).otherwise(0)).cast("long")


def joined(events: DataFrame, state: DataFrame) -> DataFrame:
    """events with what the state says of sender, target, levels, join rules, create, invite token and authoriser."""
    levels = ["users", "events", "users_default", "events_default", "state_default", "ban", "kick", "invite", "redact"]
    single = {"pl": ("m.room.power_levels", levels), "cr": ("m.room.create", ["sender", "additional_creators"]), "jr": ("m.room.join_rules", ["join_rule"])}
    out = events
    for prefix, (kind, cols) in single.items():
        part = _part(state, kind, prefix, cols)
        out = out.join(part, out["room_id"] == part[f"{prefix}_room"], "left").drop(f"{prefix}_room")
    for prefix, kind, on, cols in (("me", "m.room.member", "sender", ["membership"]), ("to", "m.room.member", "state_key", ["membership"]), ("by", "m.room.member", "join_authorised_via_users_server", ["membership"]), ("ti", "m.room.third_party_invite", "tpi_token", ["sender"])):
        part = _part(state, kind, prefix, cols, "state_key")
        out = out.join(part, (out["room_id"] == part[f"{prefix}_room"]) & (out[on] == part[f"{prefix}_key"]), "left").drop(f"{prefix}_room", f"{prefix}_key")
    return out


def verdicts(events: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """room_id, event_id, code (null: allowed), required, actual."""
    return judged(joined(events, state), version)


def judged(d: DataFrame, version: str) -> DataFrame:
    """verdicts() of events that have what their state says (joined)."""
    mine, theirs = level_of(F.col("sender"), version), level_of(F.coalesce("state_key", F.lit("")), version)
    member = F.col("type") == "m.room.member"
    self_ = F.coalesce(F.col("state_key"), F.lit("")) == F.col("sender")
    new, now = F.coalesce("membership", F.lit("")), F.coalesce("to_membership", F.lit(""))
    creator = F.coalesce(F.col("cr_sender") == F.col("sender"), F.lit(False))
    role = F.when(F.col("me_is"), F.coalesce("me_membership", F.lit("leave"))).otherwise(F.when(creator, "join").otherwise("leave"))
    rule = F.coalesce("jr_join_rule", F.lit("invite"))
    via = (F.col("by_membership") == "join") & (level_of(F.col("join_authorised_via_users_server"), version) >= threshold("invite"))
    inside = now.isin("invite", "join")
    may_join = creator | (rule == "public") | (inside & rule.isin("invite", "knock", "restricted", "knock_restricted")) | (rule.isin("restricted", "knock_restricted") & F.coalesce(via, F.lit(False)))
    action = F.when(now == "ban", threshold("ban")).otherwise(threshold("kick"))
    low = F.lit("InsufficientPowerLevel")
    join = F.when(~self_, "InvalidStateKey").when(now == "ban", "BannedUser").when(~may_join, "NotMember")
    leave = F.when(self_, F.when(~now.isin("invite", "join", "knock"), "NotMember")).otherwise(F.when(mine < action, low))
    third = (
        F.when(now == "ban", "BannedUser")
        .when(F.col("tpi_token").isNull() | F.col("tpi_mxid").isNull() | ~F.col("tpi_signed"), "InvalidSyntax")
        .when((F.col("tpi_mxid") != F.coalesce("state_key", F.lit(""))) | F.col("ti_is").isNull() | (F.col("ti_sender") != F.col("sender")), "InvalidStateKey")
        .when(mine < threshold("invite"), low)
    )
    invite = F.when(self_, "InvalidStateKey").when(F.col("has_tpi"), third).when(mine < threshold("invite"), low).when(now == "join", "NotMember").when(now == "ban", "BannedUser")
    knock = F.when(~self_, "InvalidStateKey").when(now == "ban", "BannedUser").when(inside | ~rule.isin("knock", "knock_restricted"), "NotMember")
    by_kind = F.when(new == "join", join).when(new == "leave", leave).when(new == "ban", F.when(mine < threshold("ban"), low)).when(new == "invite", invite).when(new == "knock", knock).otherwise(F.lit("InvalidSyntax"))
    above = F.when(~self_ & new.isin("leave", "ban") & (mine <= theirs), low)
    as_member = F.when((new == "ban") & self_, "InvalidStateKey").otherwise(F.coalesce(by_kind, above))
    first_levels = F.col("pl_is").isNull() & (F.col("type") == "m.room.power_levels")
    as_other = F.when(~first_levels & (mine < required()), low).when(F.col("state_key").startswith("@") & (F.col("state_key") != F.col("sender")), "InvalidStateKey")
    code = (
        F.when((F.col("n_prev") > 20) | (F.col("n_auth") > 10) | (F.col("type") == ""), "InvalidSyntax")
        .when(F.col("type") == "m.room.create", F.when(F.col("n_prev") > 0, "CreateWithPrevEvents"))
        .when(role == "ban", "BannedUser")
        .when((role != "join") & ~(member & F.coalesce(F.col("state_key") == F.col("sender"), F.lit(False)) & (new != "ban")), "NotMember")
        .when(member, as_member)
        .otherwise(as_other)
    )
    d = d.withColumn("code", code)
    need = F.when(member, F.when((new == "ban") & (mine < threshold("ban")), threshold("ban")).when((new == "leave") & (mine < action), action).when(new == "invite", threshold("invite")).otherwise(F.when(theirs == CREATOR, theirs).otherwise(theirs + 1))).otherwise(required())
    short = F.col("code") == low
    return d.select("room_id", "event_id", "code", F.when(short, need).alias("required"), F.when(short, mine).alias("actual"))
