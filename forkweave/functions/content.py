"""Typed columns of event content (JSON text), predicates on events, required authority, and scalar helpers.

Content is read as VARIANT, so that a number, a text that looks like one and a float stay apart: levels are integers or
the text of one, clamped to +-(2^53 - 1); a float level is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = (1 << 53) - 1
LEVELS = ("ban", "kick", "invite", "redact", "users_default", "events_default", "state_default")
TEXTS = ("membership", "join_rule", "creator", "join_authorised_via_users_server", "displayname", "room_version")
MODERN = ("V2_1", "V2_1_1", "V2_2")


def text(content: Column, path: str) -> Column:
    """A string at a path; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(content, path, "variant")) == "STRING", F.try_variant_get(content, path, "string"))


def level(v: Column) -> Column:
    """A level from a VARIANT value."""
    kind = F.schema_of_variant(v)
    big = F.try_variant_get(v, "$", "decimal(20,0)")
    words = F.try_variant_get(v, "$", "string")
    number = (
        F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & (big > F.lit((1 << 63) - 1)) & (big < F.expr("18446744073709551616BD")), F.lit((1 << 63) - 1))
        .when((kind == "STRING") & words.rlike("^[+-]?[0-9]+$"), words.try_cast("bigint"))
    )
    return F.when(number.isNotNull(), F.greatest(F.lit(-TOP), F.least(F.lit(TOP), number)))


def levels(content: Column, path: str) -> Column:
    """map<string, bigint> of the levels in an object; entries that are no levels are left out."""
    return F.map_filter(F.transform_values(F.try_variant_get(content, path, "map<string,variant>"), lambda _, v: level(v)), lambda _, v: v.isNotNull())


def typed(records: DataFrame) -> DataFrame:
    """records with the typed columns of their content."""
    c = F.try_parse_json(F.col("content"))
    signed = "$.third_party_invite.signed"
    cols = {t: text(c, f"$.{t}") for t in TEXTS}
    cols |= {n: level(F.try_variant_get(c, f"$.{n}", "variant")) for n in LEVELS}
    cols |= {"users": levels(c, "$.users"), "events": levels(c, "$.events")}
    cols |= {"additional_creators": F.filter(F.transform(F.try_variant_get(c, "$.additional_creators", "array<variant>"), lambda v: text(v, "$")), lambda x: x.isNotNull())}
    cols |= {"has_tpi": F.try_variant_get(c, "$.third_party_invite", "variant").isNotNull(), "tpi_token": text(c, f"{signed}.token"), "tpi_mxid": text(c, f"{signed}.mxid")}
    cols |= {"tpi_signed": F.coalesce(F.size(F.map_keys(F.try_variant_get(c, f"{signed}.signatures", "map<string,variant>"))) > 0, F.lit(False))}
    return records.withColumns(cols)


# Predicates over the columns type, state_key, sender, membership, join_rule and, where named, users.


def is_removal() -> Column:
    """A ban of, or a leave set by, someone else."""
    return F.coalesce((F.col("type") == "m.room.member") & F.col("membership").isin("ban", "leave") & (F.col("state_key") != F.col("sender")), F.lit(False))


def is_levels() -> Column:
    return F.col("type") == "m.room.power_levels"


def is_lockdown() -> Column:
    return F.coalesce((F.col("type") == "m.room.join_rules") & (F.col("join_rule") == "invite"), F.lit(False))


def is_admin() -> Column:
    return is_removal() | is_levels() | is_lockdown()


def is_power(version: str) -> Column:
    """Whether an event is resolved in the power phase: all member events in V1 and V2, removals only later."""
    return F.col("type").isin("m.room.create", "m.room.power_levels", "m.room.join_rules") | (is_removal() if version in MODERN else F.col("type") == "m.room.member")


def restricts(a: str, b: str) -> Column:
    """Whether the admin action under alias a bears on the event under alias b; a has demoted (users at level 0)."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    removes = x("is_removal") & (x("state_key") == y("sender"))
    demotes = x("is_levels") & F.array_contains(x("demoted"), y("sender"))
    locks = x("is_lockdown") & (y("type") == "m.room.member") & (y("membership") == "join")
    return F.coalesce(removes, F.lit(False)) | F.coalesce(demotes, F.lit(False)) | F.coalesce(locks, F.lit(False))


def fault(prev: str = "prev_events", auth: str = "auth_events") -> Column:
    """The syntactic fault of a record, or null."""
    return F.when(F.size(prev) > 20, "too many prev_events").when(F.size(auth) > 10, "too many auth_events").when(F.length("type") == 0, "empty type")


def version_of(room_version: Column) -> Column:
    """The algorithm of a room version, or null."""
    number = room_version.try_cast("int")
    plain = room_version.rlike("^[1-9][0-9]?$")
    return F.when(room_version == "1", "V1").when(plain & number.between(2, 11), "V2").when(room_version == "12", "V2_1").when(room_version == "12.1", "V2_1_1")


def required_keys(version: str) -> Column:
    """array<struct<type, state_key>>: the state that authorizes an event. Needs tpi_token."""
    key = lambda t, k: F.struct(F.lit(t).alias("type"), k.alias("state_key"))
    none = F.lit("")
    member = F.col("type") == "m.room.member"
    wanted = [
        F.when(F.lit(version not in MODERN), key("m.room.create", none)),
        key("m.room.member", F.col("sender")),
        key("m.room.power_levels", none),
        F.when(member & (F.col("state_key") != F.col("sender")), key("m.room.member", F.col("state_key"))),
        F.when(member & F.col("membership").isin("join", "invite", "knock"), key("m.room.join_rules", none)),
        F.when(member & F.col("tpi_token").isNotNull(), key("m.room.third_party_invite", F.col("tpi_token"))),
    ]
    return F.when(F.col("type") == "m.room.create", F.array().cast("array<struct<type:string,state_key:string>>")).otherwise(F.filter(F.array(*wanted), lambda x: x.isNotNull()))


def display_fallback(user: Column) -> Column:
    """A user id up to its colon, without leading @."""
    return F.regexp_extract(user, "^@*([^:]*)", 1)


def clock(ts: Column) -> Column:
    """Epoch milliseconds as 5 Jan 2024 01:05 PM, in UTC."""
    return F.date_format(F.timestamp_millis(ts), "d MMM yyyy hh:mm a")


def content_id(json_text: Column) -> Column:
    """$ and the unpadded URL-safe base64 of the SHA-256 of canonical JSON."""
    return F.concat(F.lit("$"), F.rtrim(F.translate(F.base64(F.unhex(F.sha2(json_text, 256))), "+/", "-_"), F.lit("=")))
