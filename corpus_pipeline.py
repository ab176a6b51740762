"""The corpus pipeline: documents of good quality, one of each near-duplicate group, without personal data, mixed to
source weights and packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in
their order. Columns that a stage does not work on travel in a struct, so that they may have any names, also those that
an operator gives its own columns. An empty table gives no rows in every stage; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkweave.llm import mixing, neardup, packing, pii, quality
from forkweave.llm.common import read, saved
from forkweave.llm.queries import tokenizer


def _carried(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in the struct rest."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def _restored(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs from those of _carried()."""
    return df.select(*[c if c in used else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    The classifier learns from the labels of sf_dir whose documents are in docs. A null or empty text scores as a text
    without words does; a null doc_id matters to no score; repeated rows go or stay together.
    """
    trees = quality.learn(spark, docs, read(spark, sf_dir, "labels"))
    used = ("doc_id", "text")
    return _restored(quality.score(spark, _carried(docs, *used), trees).where("score >= 0.5"), docs, *used)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word runs are linked by a similarity of 0.8 or more, that of the smallest doc_id.

    Documents with a null doc_id, or without words, are in no group and stay. Of rows that share doc_id and text one
    stays, that whose columns as JSON come first. A similarity of exactly 0.8 is a link.
    """
    return neardup.survivors(spark, docs, words=5, num=80, den=100)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; n_chars, if there is one, follows the text.

    A null text stays null, with its n_chars; rows with equal texts, repeated or not, get equal texts; all rows stay.
    """
    out = pii.sanitised(pii.spans(spark, _carried(docs, "text")))
    if "n_chars" in docs.columns:
        number = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("rest.n_chars"))
        out = out.withColumn("rest", F.col("rest").withField("n_chars", number))
    return _restored(out, docs, "text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it does not take go.

    A null source is a source of its own, a null or empty text has no words and goes; rows with equal keys go by size,
    equal rows are interchangeable.
    """
    used = ("doc_id", "text", "source")
    measured = saved(spark, mixing.measure(_carried(docs, *used)), "measured")
    out = mixing.mix(spark, measured).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies")))
    return _restored(out, docs, *used)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens.

    A null text counts as empty (the end id alone); repeated rows are packed each; null doc_ids are kept.
    """
    out = packing.pack(spark, docs, tokenizer("byte_bpe_50k.json"), end_id=0, window=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


STAGES = [("quality", good), ("near_dedup", distinct), ("pii", clean), ("mixing", mixed), ("packing", packed)]

#: The classifier's trees have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
