"""Shared helpers of the training-data operators: the shared work folder, cut lineage, range buckets."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one when a local session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. It goes with the application, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Paths that the innermost scratch() removes, then those of the one around it.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what saved() wrote inside; a lasting table goes with the scratch() around this one, if any."""
    paths: list[str] = []
    token = _written.set((paths, *_written.get()))
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            removed(spark, path)


def saved(spark: SparkSession, df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and it survives lost executors.

    Inside scratch() the table goes at the end, unless it is lasting: what a returned plan reads must last.
    """
    return saved_at(spark, df, name, lasting)[0]


def saved_at(spark: SparkSession, df: DataFrame, name: str, lasting: bool = False) -> tuple[DataFrame, str]:
    """saved(), and where the table's files lie."""
    path = fresh_dir(spark, name)
    for paths in _written.get()[int(lasting) :][:1]:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch between Spark and Python: a batch of long texts stays small.
BATCH_BYTES = 2 << 20
_MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """The one setting that operators make, alike for all: a lazy plan reads it when it runs, so it stays."""
    spark.conf.set(_MOST_BYTES, str(BATCH_BYTES))


def flagged(*names: str) -> list[Column]:
    """Nullable long columns as a number (null: 0) and a mark no_<name>, both never null.

    A nullable long column reaches pandas as floats, which hold no id beyond 2^53.
    """
    return [c for n in names for c in (F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias(n), F.col(n).cast("long").isNull().alias(f"no_{n}"))]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quantile_bounds(df: DataFrame, col: str, buckets: int) -> list[int]:
    """At most buckets - 1 ascending values that part col into ranges of about as many rows. One pass, bounded state."""
    buckets = max(1, buckets)
    if buckets == 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(col, shares, max(10_000, 4 * buckets)).alias("q")).first()
    return sorted({int(x) for x in (row["q"] or [])})


def range_bucket(col: Column, bounds: list[int]) -> Column:
    """How many bounds are <= col (null: 0), looked up in two levels of about sqrt(len(bounds))."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(longs([c[0] for c in chunks]), lambda b: b <= col))
    fine = F.size(F.filter(F.element_at(F.array(*[longs(c) for c in chunks]), F.greatest(coarse, F.lit(1))), lambda b: b <= col))
    return F.when(col.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine).cast("int")
