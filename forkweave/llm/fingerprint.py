"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame functions only.

A sketch retains every hash of a run of five words (small letters; a text with fewer words has them all as one run)
below a fixed fraction, a quarter, of the hash range, whatever the text's size. So sketches of a collection merge by
union into that of the whole, and the share of one sketch in another estimates containment between very unequal texts.
A fingerprint is "text hash:retained hashes" in hexadecimal. Equal texts have equal fingerprints.

Estimates of sketches without hashes (a text of few runs may retain none): likeness and containment are 1 for equal
texts, else 0.

Defined results: a null text counts as empty (an empty sketch); a text of any length is sketched whole, in memory of the
order of its words; rows with one doc_id follow each other by text; a null doc_id is the smallest; repeated rows follow
each other; a single row is its own next; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quantile_bounds, range_bucket

RUN = 5
#: A quarter of the signed 64-bit range lies below this.
BELOW = -(1 << 62)


def with_next(spark: SparkSession, docs: DataFrame, rows_per_bucket: int = 256, most: int = 20_000) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: of the next row by descending doc_id, after the last of the first.

    Rows are dealt into ranges of doc_id, at most `most`. The first text of the range behind is added to each range as
    its last row, so that one shuffle of the texts suffices and each sketch is made once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = quantile_bounds(docs, "doc_id", min(most, -(-docs.count() // rows_per_bucket)))
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))
    rows = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds)).withColumn("down", down)
    # a row per range, at most `most`
    heads = rows.groupBy("bucket").agg(F.min("down").alias("down"))
    behind = Window.orderBy(F.desc("bucket"))
    around = behind.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.coalesce(F.lag("bucket").over(behind), F.last("bucket").over(around))
    heads = heads.withColumn("goes_to", ahead)
    texts = rows.join(F.broadcast(heads), ["bucket", "down"]).groupBy("goes_to").agg(F.min("text").alias("text"))
    last = texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("goes_to").alias("bucket"), F.lit(None).cast("long").alias("down"), F.lit(1).alias("added"))
    rows = rows.withColumn("added", F.lit(0)).unionByName(last)
    order = Window.partitionBy("bucket").orderBy("added", "down", "text")
    rows = add_sketch(rows.repartition("bucket"), "text", "sketch")  # behind the shuffle, which moves texts alone
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("text", "sketch")}
    return rows.withColumns(ahead).where("added = 0").select("doc_id", "text", "sketch", *ahead)


def _hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def add_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with name: struct<anchor, kept>, the hash of the text column and the retained hashes, ascending."""
    df = df.withColumn(f"{name}_h", _hashes(F.col(text)))
    h = F.col(f"{name}_h")
    n = F.size(h)
    many = F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))
    one = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
    runs = F.when(n >= RUN, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    kept = F.array_sort(F.array_distinct(F.filter(runs, lambda x: x < BELOW)))
    return df.withColumn(name, F.struct(F.xxhash64(text).alias("anchor"), kept.alias("kept"))).drop(f"{name}_h")


def fingerprint(sketch: Column) -> Column:
    hexed = F.array_join(F.transform(sketch["kept"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return F.concat(F.lpad(F.lower(F.hex(sketch["anchor"])), 16, "0"), F.lit(":"), hexed)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together (of the runs of both); it stands for no single text, so its anchor is null."""
    return F.struct(F.lit(None).cast("long").alias("anchor"), F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a["anchor"] == b["anchor"], F.lit(False))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard estimate of two sketches."""
    shared = F.size(F.array_intersect(a["kept"], b["kept"]))
    union = F.size(a["kept"]) + F.size(b["kept"]) - shared
    return F.when(_same(a, b), 1.0).when(union == 0, 0.0).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's runs that b has."""
    size = F.size(a["kept"])
    return F.when(_same(a, b), 1.0).when(size == 0, 0.0).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / size)


def compare_edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last third comes from the next document."""
    df = with_next(spark, docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    df = df.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = add_sketch(df, "edited", "new")
    own, new, ahead = F.col("sketch"), F.col("new"), F.col("next_sketch")
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(own).alias("fingerprint"),
        fingerprint(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, ahead).alias("near_next"),
        containment(own, new).alias("kept_in_edited"),
    )
