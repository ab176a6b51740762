"""The queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = saved(spark, mixing.measure(docs).drop("text"), "measured")
    return mixing.mix(spark, measured).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary import round_trip

    out = round_trip(spark, read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(spark, read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, window=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


def op4_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pqdedup import link

    return link(spark, read(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    out = round_trip(spark, read(spark, sf_dir, "pages"), least=100)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.learn(spark, docs, read(spark, sf_dir, "labels"))
    return quality.predicted(quality.score(spark, docs, trees), 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality, toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(spark, docs, read(spark, sf_dir, "labels"))
    return quality.predicted(toxicity.score(spark, docs, model), 0.7)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    out = pii.spans(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)], F.sha2(pii.listed("pii_base").cast("binary"), 256).alias("base_sha256"), pii.listed("pii_spans").alias("spans"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import link

    return link(spark, read(spark, sf_dir, "documents"), words=3, num=85, den=100).drop("h")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_edited

    return compare_edited(spark, read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_binary": op2_token_binary,
    "op3_lexical_packing": op3_lexical_packing,
    "op4_pq_dedup": op4_pq_dedup,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_fingerprint": op10_fingerprint,
}

#: Payloads as a response or a revisit of the smallest page with the same one.
OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f ON payload_digest = d
"""

#: All pairs within a label, by double cosine; components by reachability.
OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT low.vec_id, coalesce(n.n, 0) AS n_links, component_id, low.vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)
"""

#: Exact Jaccard of distinct three-word runs over all pairs that share one; components by reachability.
OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

ORACLES: dict[str, str] = {"op4_pq_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op9_near_dedup": OP9_SQL}
