"""A bounded sample of labelled documents to learn from, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches
from .textnum import batches


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents that are not held out: those with the smallest hash.

    The sample's ids and labels are broadcast; `most` bounds them. Of conflicting labels of a document the largest counts.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.join(F.broadcast(ids), "doc_id")


def scored(spark: SparkSession, docs: DataFrame, score: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """docs with a double column score of each whole text; other columns pass as they are."""
    bounded_batches(spark)
    docs = docs.drop("score")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            got = [score(texts) for _, texts in batches(b.column("text").to_pylist())]
            values = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, values], [*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
