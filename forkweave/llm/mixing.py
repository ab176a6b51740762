"""Mixing sources to target weights, by Efraimidis-Spirakis sampling. DataFrame functions only.

Sources in code-point order (null last) weigh by a repeating list and share `share` times all words; a target stops at
`most` times its source's size and the excess is shared again by weight until none is above (water filling, solved by
cumulative sums over the sources). Within a source, whole epochs come first. The rest of the target is filled by
documents in the order of exponential keys, -ln(u)/quality with u a hash of the document's id, up to the budget by
prefix sums. The last document in is taken in part (words), or by copies as a whole if at least half of it fits.

A source's keys are cut into ascending buckets of about 256 documents (at most 65,536), so that prefix sums run in
many tasks: over the bucket totals, then within each bucket.

The weight of a document is `weight` (any positive column), or by default quality(): the share of its characters that
are neither digits nor signs. There is a row for each source in one task, twice: sources are few against documents.

Defined results: a null text has size 0; sources of size 0 get the target 0; a null source is a source of its own; a
null or repeated doc_id has u from the text too, as every row has; equal rows share u, are interchangeable and are
ordered by size; a weight that is null or not positive counts as the least of the default, 0.25; texts of any length
are one document; an empty table gives no rows; further columns are kept, but for those of the names in OWN, which the
operator makes anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Broadcast a table of sources up to this many rows; beyond it, it is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Columns that the operator makes, some of them for its own use alone.
OWN = tuple(f"mix_{x}" for x in "size quality key salt source_size target taken copies mean buckets x part epochs rest sum base before".split())


def quality(text: Column) -> Column:
    """From 0.25 to 1: less for texts with many digits and signs."""
    plain = F.length(F.regexp_replace(text, r"[0-9!-+/:-@\[-`{-~]", ""))
    return F.when(F.length(text) > 0, 0.25 + 0.75 * plain / F.length(text)).otherwise(0.25)


def measure(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with mix_size (words), mix_quality, mix_key (the source, null apart) and mix_salt (the text's hash)."""
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    weighed = quality(text) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(0.25)
    return docs.drop(*OWN).withColumns({"mix_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "mix_quality": weighed, "mix_key": key, "mix_salt": F.xxhash64(text)})


def targets(spark: SparkSession, measured: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """mix_key, mix_source_size, mix_target, mix_mean, mix_buckets of each source."""
    per = measured.groupBy("mix_key").agg(F.sum("mix_size").alias("size"), F.count("*").alias("docs"), F.avg("mix_quality").alias("mean"))
    per = saved(spark, per, "sources")
    everything = Window.partitionBy(F.lit(0))  # a row per source
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("mix_key") == "~", "mix_key")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "place")
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = ranked.withColumn("try", (F.sum("size").over(everything) * F.lit(float(share)) - below) / above).withColumn("at", F.row_number().over(order))
    level = F.min_by("try", F.when(F.col("try") <= F.col("level"), F.col("at"))).over(everything)
    return tried.select(
        "mix_key",
        F.col("size").alias("mix_source_size"),
        F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("mix_target"),
        F.col("mean").alias("mix_mean"),
        F.least(F.ceil(F.col("docs") / 256), F.lit(65_536)).cast("int").alias("mix_buckets"),
    )


def mix(spark: SparkSession, measured: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """measured with mix_source_size, mix_target, mix_taken (words, the last document in part) and mix_copies (whole documents)."""
    per = saved(spark, targets(spark, measured, weights, share, most), "targets")
    if per.count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mix_salt")), 11) + 0.5) / F.lit(float(1 << 53))
    rows = measured.join(per, "mix_key").withColumn("mix_x", -F.ln(u) / F.col("mix_quality"))
    part = F.floor(F.col("mix_buckets") * (1 - F.exp(-F.col("mix_x") * F.col("mix_mean"))))
    rows = rows.withColumn("mix_part", F.least(part, F.col("mix_buckets") - 1).cast("int"))
    epochs = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("mix_epochs", epochs).withColumn("mix_rest", F.round(F.col("mix_target") - F.col("mix_epochs") * F.col("mix_source_size")).cast("long"))
    sums = rows.groupBy("mix_key", "mix_part").agg(F.sum("mix_size").alias("mix_sum"))
    before = Window.partitionBy("mix_key").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("mix_key", "mix_part", F.coalesce(F.sum("mix_sum").over(before), F.lit(0)).alias("mix_base"))
    inside = Window.partitionBy("mix_key", "mix_part").orderBy("mix_x", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(inside), F.lit(0))).join(sums, ["mix_key", "mix_part"])
    room = F.col("mix_rest") - F.col("mix_base") - F.col("mix_before")
    whole = (F.col("mix_size") > 0) & (room * 2 >= F.col("mix_size"))
    out = rows.withColumn("mix_taken", F.col("mix_epochs") * F.col("mix_size") + F.greatest(F.lit(0), F.least(room, F.col("mix_size"))))
    out = out.withColumn("mix_copies", (F.col("mix_epochs") + whole.cast("long")).cast("int"))
    return out.drop("mix_x", "mix_part", "mix_epochs", "mix_rest", "mix_base", "mix_before", "mix_mean", "mix_buckets", "mix_quality", "mix_salt")
