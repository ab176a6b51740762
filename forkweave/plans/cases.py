"""Authorization rules over cases that meet every one of them: as joins, and by the kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as c
from ..operators import auth as a
from ..operators import resolve as r
from ..sources import cases as s
from .registry import ORACLES, QUERIES


def _joins(version: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records, entries = s.cases(spark, sf_dir)
        rows = c.typed(records).withColumn("n_prev", F.size("prev_events")).withColumn("n_auth", F.size("auth_events"))
        state = rows.join(entries.select("room_id", "event_id"), ["room_id", "event_id"], "left_semi")
        return a.verdicts(rows.where("event_id = '$case'"), state, version).drop("event_id")

    return run


def _kernel(version: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records, entries = s.cases(spark, sf_dir)
        order = records.where("event_id = '$case'").select("room_id", "event_id", F.lit(1).cast("long").alias("pos"))
        return r.checked_chain(records, order, entries, version).select("room_id", "code", "required", "actual")

    return run


for _version in ("V2", "V2_1"):
    for _name, _make in (("auth_cases", _joins), ("checked_chain", _kernel)):
        QUERIES[f"{_name}_{_version.lower().replace('_', '')}"] = _make(_version)
        ORACLES[f"{_name}_{_version.lower().replace('_', '')}"] = s.sql(_version)
