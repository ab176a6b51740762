"""Settings of the engine, read from the session: forkweave.version, forkweave.format, forkweave.snapshotEvery, forkweave.origin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

VERSIONS = ("V1", "V2", "V2_1", "V2_1_1", "V2_2")


@dataclass(frozen=True)
class Settings:
    version: str = "V2"
    format: str = "default"
    snapshot_every: int = 100
    origin: str | None = None


def settings(spark: SparkSession) -> Settings:
    """The session's settings; an unknown version or a count below 1 raises."""
    get = lambda name, otherwise: spark.conf.get(f"forkweave.{name}", otherwise)
    version, every = get("version", "V2"), int(get("snapshotEvery", "100"))
    if version not in VERSIONS:
        raise ValueError(f"forkweave.version: {version} is none of {', '.join(VERSIONS)}")
    if every < 1:
        raise ValueError(f"forkweave.snapshotEvery: {every} is below 1")
    return Settings(version, get("format", "default"), every, get("origin", None))
