"""Reading and writing event records: JSON lines, whole documents, envelopes, wrapped lines; parsing with quarantine.

A record has room_id, event_id, type, state_key, sender, origin_server_ts, depth, power_level, prev_events, auth_events,
content (JSON text) and raw (the event as it came). Lines that are no events get a reason instead of an abort; strict
readers raise on the first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as c

TOP = (1 << 53) - 1
RECORD = "room_id string, event_id string, type string, state_key string, sender string, origin_server_ts bigint, depth bigint, power_level bigint, prev_events array<string>, auth_events array<string>, content string, raw string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw, line order kept as ord: one event a line; blank lines and // comments are skipped."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return lines.where("trim(value) <> '' AND NOT startswith(trim(value), '//')").select(F.col("value").alias("raw"), "ord")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events (raw, ord) and heads (event_id) of whole JSON files: an array, an envelope {events, heads} or a single event."""
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    events = F.try_variant_get("v", "$.events", "array<variant>")
    single = F.try_variant_get("v", "$.event_id", "variant").isNotNull() | F.try_variant_get("v", "$.type", "variant").isNotNull()
    bad = F.raise_error(F.lit("unrecognized JSON: expected an array, {events: [...]} or a single event"))
    rows = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(events.isNotNull(), events).when(single, F.array("v")).otherwise(bad.cast("array<variant>"))
    out = files.select(F.posexplode(rows).alias("ord", "e")).select(F.to_json("e").alias("raw"), F.col("ord").cast("long").alias("ord"))
    heads = files.select(F.explode(F.try_variant_get("v", "$.heads", "array<string>")).alias("event_id"))
    return out, heads


def unwrapped(raw: DataFrame) -> DataFrame:
    """raw with the event inside {"_source": ...} or {"event": ...}, if there is one."""
    v = F.try_parse_json("raw")
    inner = F.coalesce(F.try_variant_get(v, "$._source", "variant"), F.try_variant_get(v, "$.event", "variant"))
    return raw.withColumn("raw", F.when(F.schema_of_variant(inner).startswith("OBJECT"), F.to_json(inner)).otherwise(F.col("raw")))


def _edges(v: Column, path: str) -> Column:
    """Ids of an edge list: plain ids, [id, hashes] pairs or {event_id} objects; all else is dropped."""
    one = lambda e: F.coalesce(c.text(e, "$"), c.text(e, "$[0]"), c.text(e, "$.event_id"))
    ids = F.filter(F.transform(F.try_variant_get(v, path, "array<variant>"), one), lambda x: x.isNotNull())
    return F.coalesce(ids, F.array().cast("array<string>"))


def _count(v: Column, path: str) -> Column:
    """A non-negative integer, or 0."""
    x = F.try_variant_get(v, path, "variant")
    n = F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))
    return F.when(n >= 0, n).otherwise(0).cast("long")


def canonical_ids(raw: DataFrame) -> DataFrame:
    """raw with hash_id: $ and the hash of the event's canonical JSON without unsigned and signatures."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(_canonical)

    spell = F.pandas_udf(run, "string")
    return raw.withColumn("hash_id", c.content_id(spell("raw")))


def _canonical(text: str | None) -> str | None:
    try:
        e = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(e, dict):
        return None
    return json.dumps({k: v for k, v in e.items() if k not in ("unsigned", "signatures")}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse(raw: DataFrame, room_id: str | None = None, hashing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records, and quarantined rows (raw, reason). room_id stands in for events that name no room; hashing makes ids for events without one."""
    v = F.try_parse_json("raw")
    if hashing:
        raw = canonical_ids(raw)
    own_id = c.text(v, "$.event_id")
    event_id = F.coalesce(own_id, F.col("hash_id")) if hashing else own_id
    power = F.try_variant_get(v, "$.power_level", "variant")
    kind = F.schema_of_variant(power)
    number = F.try_variant_get(power, "$", "decimal(38,0)")
    words = F.try_variant_get(power, "$", "string")
    is_int = (kind == "BIGINT") | kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)")
    level = F.when(is_int, F.least(number, F.lit(TOP).cast("decimal(38,0)"))).when((kind == "STRING") & words.rlike("^[+-]?[0-9]{1,18}$"), F.least(words.try_cast("decimal(38,0)"), F.lit(TOP).cast("decimal(38,0)"))).otherwise(F.lit(0).cast("decimal(38,0)"))
    reason = (
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not a JSON object")
        .when(event_id.isNull(), "no event_id")
        .when(F.coalesce(c.text(v, "$.type"), F.lit("")) == "", "no type")
        .when(power.isNotNull() & (kind.isin("DOUBLE", "FLOAT", "BOOLEAN") | (kind.startswith("DECIMAL") & ~is_int)), "power_level is no integer")
    )
    rows = raw.withColumn("reason", reason)
    good = rows.where("reason IS NULL").select(
        F.coalesce(c.text(v, "$.room_id"), F.lit(room_id)).alias("room_id"),
        event_id.alias("event_id"),
        c.text(v, "$.type").alias("type"),
        c.text(v, "$.state_key").alias("state_key"),
        F.coalesce(c.text(v, "$.sender"), F.lit("")).alias("sender"),
        _count(v, "$.origin_server_ts").alias("origin_server_ts"),
        _count(v, "$.depth").alias("depth"),
        level.cast("long").alias("power_level"),
        _edges(v, "$.prev_events").alias("prev_events"),
        _edges(v, "$.auth_events").alias("auth_events"),
        F.coalesce(F.to_json(F.try_variant_get(v, "$.content", "variant")), F.lit("null")).alias("content"),
        "raw",
        *(["ord"] if "ord" in raw.columns else []),
    )
    return good, rows.where("reason IS NOT NULL").select("raw", "reason")


def load(spark: SparkSession, path: str, room_id: str | None = None, strict: bool = True, hashing: bool = False) -> DataFrame:
    """Records of a file by its ending: .jsonl has an event a line, .parquet records, all else is a document. strict: bad events raise."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raw = unwrapped(read_lines(spark, path)) if path.lower().endswith(".jsonl") else read_documents(spark, path)[0]
    good, bad = parse(raw, room_id, hashing)
    if strict:
        if (first := bad.first()) is not None:
            raise ValueError(f"{first['reason']}: {first['raw'][:200]}")
        if good.isEmpty():
            raise ValueError("no events in the input")
    return good


def load_all(spark: SparkSession, paths: list[str], room_id: str | None = None) -> DataFrame:
    """Several files as one set: each event once, from the first file that has it; files that share nothing raise."""
    from ..operators import state as s

    parts = [load(spark, p, room_id) for p in paths]
    tagged = [p.select(F.lit(k).alias("src"), "event_id") for k, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    s.check_connected(s.overlaps(every), len(parts))
    return s.merge_sources(parts, "ord").drop("src")


def serialized(records: DataFrame) -> DataFrame:
    """value: each record as JSON, without a null state key."""
    fields = ["event_id", "type", "state_key", "power_level", "origin_server_ts", "sender", F.try_parse_json("content").alias("content"), "prev_events", "auth_events", "depth"]
    return records.select(F.to_json(F.struct(*fields)).alias("value"))


def write_lines(records: DataFrame, path: str) -> None:
    serialized(records).write.text(path)


def write_cache(records: DataFrame, path: str) -> None:
    """Parsed records as Parquet, partitioned so that a room is read alone."""
    records.withColumn("room_bucket", F.pmod(F.xxhash64("room_id"), F.lit(64)).cast("int")).write.partitionBy("room_bucket").parquet(path)


def exported(records: DataFrame, heads: DataFrame, most_heads: int = 20) -> DataFrame:
    """room_id, heads (the first `most_heads`, sorted), total, with_auth, with_prev, senders, by_type: an export's envelope."""
    has = lambda name: F.sum((F.size(name) > 0).cast("long"))
    base = records.groupBy("room_id").agg(F.count("*").alias("total"), has("auth_events").alias("with_auth"), has("prev_events").alias("with_prev"), F.countDistinct("sender").alias("senders"))
    kinds = records.groupBy("room_id", "type").count().groupBy("room_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("by_type"))
    tops = heads.groupBy("room_id").agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, most_heads).alias("heads"))
    return base.join(kinds, "room_id").join(tops, "room_id", "left")


def mapped(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Records from any table of events: names gives the table's column for a column of RECORD; the others get its own or a default."""
    out = []
    for field in RECORD.split(", "):
        name, kind = field.split(" ", 1)
        if (own := names.get(name, name)) in rows.columns:
            value = F.col(f"`{own}`").cast(kind)
        else:
            value = F.lit(None).cast(kind)
        otherwise = {"array<string>": F.array().cast(kind), "bigint": F.lit(0).cast(kind)}.get(kind, F.lit("{}") if name == "content" else None)
        out.append((value if otherwise is None else F.coalesce(value, otherwise)).alias(name))
    return rows.select(*out)


def write_report(report: DataFrame, path: str, pretty: bool = False) -> None:
    """A report as JSON lines; pretty: each row spread over lines, for reading."""
    if not pretty:
        report.write.json(path)
        return
    report.select(F.to_json(F.struct(*report.columns), {"pretty": "true"}).alias("value")).write.text(path)


def chase(records: DataFrame, fetch, rounds: int = 3) -> DataFrame:
    """records with referenced auth events that were missing, fetched in at most `rounds` rounds. fetch(ids DataFrame) -> records."""
    for _ in range(rounds):
        wanted = records.select("room_id", F.explode("auth_events").alias("event_id")).distinct().join(records.select("room_id", "event_id"), ["room_id", "event_id"], "left_anti")
        more = fetch(wanted)
        if more.isEmpty():
            break
        records = records.unionByName(more.select(*records.columns)).checkpoint()
    return records
