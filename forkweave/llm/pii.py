"""PII: information-theoretic sanitisation. DataFrame functions only.

Base spans (email, ip, card, phone) are found by patterns and are the protected entities, one however it is written:
cards and phones count by their digits. Each entity's context is the words within 80 characters of it. A term of letters
in the context of an entity is weighed against the whole corpus: its pointwise mutual information with the entity, from
the number of different texts that hold it anywhere, over the entity's own information. That share is what the term
discloses. Where fewer than `support` different texts show both, the chance of the entity given the term is smoothed by
one more text that holds the term and the entity as often as any text does; so a term is weighed from one text on.
From `generalise` on, the term is a span too and becomes a placeholder wherever it occurs; from `remove` on, it goes.

Offsets come from the lengths of what lies between matches (split) and of the matches (extract), so no Python runs.
Patterns are possessive and cannot start inside a run they failed on, so they are linear in the text.

Defined results: a null text counts as empty (no spans); equal texts count once as evidence and get equal spans; repeated
rows are kept; a null or repeated doc_id changes nothing (texts alone count); term spans that overlap base spans are
dropped; of spans that overlap, the first by start, then kind, is replaced and the rest of the other goes with it; texts
of any length are searched whole; an empty table gives no rows; further columns are kept, but for those named pii_text,
pii_key, pii_base, pii_spans, pii_terms or pii_near, which the operator makes anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
CONTEXT = 80
#: Spans in a slice of a fold.
CHUNK = 64
#: Broadcast keys of texts up to this many (two numbers each), to tell which texts to move; beyond it, all texts are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: The same for disclosing terms.
BROADCAST_TERMS = 200_000
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _within(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _bound(value: Column, use) -> Column:
    """use(value), value made once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array in slices of CHUNK: folds over a slice copy little, so that the work is in proportion to the array."""

    def cut(it: Column) -> Column:
        last = F.size(it) - 1
        part = lambda c: F.transform(F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK - 1, last)), lambda i: F.get(it, i))
        none = F.filter(F.array(it), lambda _: F.lit(False))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.floor(last / CHUNK).cast("int")), part)).otherwise(none)

    return _bound(items, cut)


def _running(values: Column, add, start: int = 0) -> Column:
    """The fold of the values before each one, then of all: one more than there are values."""
    first = F.array(F.lit(start).cast("long"))
    return F.aggregate(values, first, lambda acc, v: F.concat(acc, F.array(add(F.element_at(acc, -1), v))))


def _matches(text: Column, pattern: Column, kind: int) -> Column:
    """Spans of all leftmost matches, with code-point offsets."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), hits, lambda s, h: F.struct(F.length(s).cast("long").alias("skip"), F.length(h).cast("long").alias("size"), h.alias("value")))
    none = F.array().cast(SPAN)

    def add(acc: Column, p: Column) -> Column:
        start = acc["pos"] + p["skip"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + p["size"]).alias("end"), p["value"].alias("value"))
        return F.struct((start + p["size"]).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, p: acc + p["skip"] + p["size"]))
        return F.zip_with(chunks, _running(sums, lambda a, v: a + v), lambda c, base: F.struct(c.alias("c"), base.alias("base")))

    both = F.filter(_bound(_chunks(F.filter(parts, lambda p: p["value"].isNotNull())), placed), lambda x: x["c"].isNotNull())
    return F.flatten(F.transform(both, lambda x: F.aggregate(x["c"], F.struct(x["base"].alias("pos"), none.alias("out")), add, lambda acc: acc["out"])))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start, then kind."""
    none = F.array().cast(SPAN)
    found = [_matches(text, F.lit(p), k) for k, p in enumerate(PATTERNS)]
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    count = lambda v: F.length(digits(v))
    ok = [
        found[0],
        F.filter(found[1], lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        F.filter(F.filter(found[2], lambda s: count(s["value"]).between(12, 19)), lambda s: _luhn(digits(s["value"]))),
        F.filter(found[3], lambda s: count(s["value"]).between(9, 15)),
    ]
    gates = [F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.contains(text, F.lit("+"))]
    return F.array_sort(F.concat(*[F.when(g, s).otherwise(none) for g, s in zip(gates, ok, strict=True)]))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with pii_text (never null) and pii_key (its hash)."""
    return docs.withColumn("pii_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("pii_key", F.xxhash64("pii_text"))


def found(docs: DataFrame) -> DataFrame:
    """docs with pii_text, pii_key and pii_base."""
    return keyed(docs).withColumn("pii_base", base_spans(F.col("pii_text")))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def normal(kind: Column, value: Column) -> Column:
    """An entity's value without what its writing adds: digits of cards and phones, bytes of ips without leading zeros, small letters."""
    return F.when(kind >= 2, F.regexp_replace(value, "[^0-9]", "")).when(kind == 1, F.regexp_replace(value, "(?<![0-9])0+(?=[0-9])", "")).otherwise(F.lower(value))


def disclosing(spark: SparkSession, marked: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """Terms that disclose entities: term, share, gone. marked: of found()."""
    own = marked.where(F.size("pii_base") > 0).select("pii_key", "pii_text", F.explode("pii_base").alias("s"))
    left = F.greatest(F.lit(0).cast("long"), F.col("s.start") - CONTEXT)
    before = F.substring(F.col("pii_text"), (left + 1).cast("int"), (F.col("s.start") - left).cast("int"))
    after = F.substring(F.col("pii_text"), (F.col("s.end") + 1).cast("int"), F.lit(CONTEXT))
    # a word cut by the edge of the context is no term
    before = F.when(left > 0, F.regexp_replace(before, r"^[\p{L}]+", "")).otherwise(before)
    after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"[\p{L}]+$", "")).otherwise(after)
    entity = F.concat_ws(":", F.col("s.kind"), normal(F.col("s.kind"), F.col("s.value")))
    seen = own.select("pii_key", entity.alias("entity"), F.explode(F.array_distinct(_terms(F.concat_ws("\n", before, after)))).alias("term")).distinct()
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("both"))
    entities = own.select("pii_key", entity.alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    # a term is counted once for each different text: in every row, less the repeats of texts that repeat, which alone move
    keys = marked.groupBy("pii_key").agg(F.count("*").alias("copies"))
    total = keys.count()
    copies = saved(spark, keys.where("copies > 1"), "copies")
    texts = marked.select("pii_key", "pii_text")
    repeated = texts.join(_within(copies, BROADCAST_KEYS), "pii_key").groupBy("pii_key").agg(F.first("pii_text").alias("pii_text"), F.first("copies").alias("copies"))
    distinct = F.explode(F.array_distinct(_terms(F.col("pii_text")))).alias("term")
    counts = texts.select(distinct, F.lit(1).cast("long").alias("part")).unionAll(repeated.select(distinct, (1 - F.col("copies")).alias("part")))
    spread = counts.groupBy("term").agg(F.sum("part").alias("with_term"))
    n = F.lit(float(max(total, 2)))
    own_bits = F.ln(n / F.col("with_entity"))
    given = F.when(F.col("both") >= support, F.col("both") / F.col("with_term")).otherwise((F.col("both") + F.col("with_entity") / n) / (F.col("with_term") + 1))
    bits = F.ln(given * n / F.col("with_entity"))
    share = pairs.join(entities, "entity").join(spread, "term").where(own_bits > 0).groupBy("term").agg(F.max(bits / own_bits).alias("share"))
    return saved(spark, share.where(F.col("share") >= generalise).withColumn("gone", F.col("share") >= remove), "risky")


def term_spans(marked: DataFrame, risky: DataFrame) -> DataFrame:
    """pii_key, pii_terms: the term spans of each different text that holds disclosing terms. marked: of keyed()."""
    words = marked.select("pii_key", "pii_text", F.explode(F.array_distinct(_terms(F.col("pii_text")))).alias("term"))
    if risky.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # every word of every text is looked up where the text lies, so that only hits are shuffled
        holding = words.join(F.broadcast(risky), "term")
    else:
        holding = words.select("pii_key", "term").join(risky, "term").distinct()
        holding = marked.select("pii_key", "pii_text").dropDuplicates(["pii_key"]).join(holding, "pii_key")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("term"), F.lit(r")(?!\p{L})"))
    value = lambda h: F.when(F.col("gone"), "").otherwise(h["value"]).alias("value")
    hits = F.transform(_matches(F.col("pii_text"), pattern, 4), lambda h: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), h["end"].alias("end"), value(h)))
    return holding.select("pii_key", hits.alias("hits")).groupBy("pii_key").agg(F.flatten(F.collect_set("hits")).alias("pii_terms"))


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with pii_text, pii_key, pii_base and pii_spans (base and term spans, by start, then kind)."""
    texts = keyed(docs.drop("pii_terms", "pii_near"))
    with scratch(spark):
        terms = saved(spark, term_spans(texts, disclosing(spark, found(docs))), "term-spans", lasting=True)
    if terms.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        # only the texts with term spans move; which those are, their keys tell
        keys = F.broadcast(terms.select("pii_key"))
        none = F.lit(None).cast(terms.schema["pii_terms"].dataType)
        out = texts.join(keys, "pii_key", "left_anti").withColumn("pii_terms", none)
        some = texts.join(keys, "pii_key", "left_semi").join(terms.hint("merge"), "pii_key")
        out = out.unionByName(some)
    else:
        out = texts.join(terms, "pii_key", "left")
    out = out.withColumn("pii_base", base_spans(F.col("pii_text")))
    meets = lambda h, b: (h["start"] < b["end"]) & (b["start"] < h["end"])
    ends = lambda c: F.array_max(F.transform(c, lambda b: b["end"]))
    near = F.transform(_chunks(F.col("pii_base")), lambda c: F.struct(F.element_at(c, 1)["start"].alias("start"), ends(c).alias("end"), c.alias("c")))
    out = out.withColumn("pii_near", F.when((F.size("pii_base") > 0) & F.col("pii_terms").isNotNull(), near))
    clear = F.filter("pii_terms", lambda h: ~F.coalesce(F.exists("pii_near", lambda n: meets(h, n) & F.exists(n["c"], lambda b: meets(h, b))), F.lit(False)))
    all_spans = F.when(F.col("pii_terms").isNull(), F.col("pii_base")).otherwise(F.array_sort(F.concat("pii_base", F.coalesce(clear, F.array().cast(SPAN)))))
    return out.withColumn("pii_spans", all_spans).drop("pii_terms", "pii_near")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitised(marked: DataFrame) -> DataFrame:
    """marked with its text freed of all spans: base kinds and general terms as [KIND], removed terms as nothing."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("pii_text")
    long = lambda v: F.lit(v).cast("long")
    cut = lambda s, at, n: F.substring(s, (at + 1).cast("int"), F.greatest(n, long(0)).cast("int"))

    def add(acc: Column, s: Column, piece: Column, base: Column) -> Column:
        before = cut(piece, acc["pos"] - base, s["start"] - acc["pos"])
        word = F.when((s["kind"] == 4) & (s["value"] == ""), "").otherwise(F.element_at(names, s["kind"] + 1))
        inside = s["start"] < acc["pos"]  # it overlaps the span before
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], F.when(inside, "").otherwise(F.concat(before, word))).alias("out"))

    # each slice of spans works on its own piece of the text, from where the slices before it end
    def freed(chunks: Column, bounds: Column) -> Column:
        placed = F.zip_with(chunks, F.slice(bounds, 1, F.size(chunks)), lambda c, lo: F.struct(c.alias("c"), lo.alias("lo")))
        placed = F.zip_with(placed, F.slice(bounds, 2, F.size(chunks)), lambda x, hi: F.struct(x["c"].alias("c"), x["lo"].alias("lo"), cut(text, x["lo"], hi - x["lo"]).alias("piece")))
        out = F.transform(placed, lambda x: F.aggregate(x["c"], F.struct(x["lo"].alias("pos"), F.lit("").alias("out")), lambda acc, s: add(acc, s, x["piece"], x["lo"]), lambda acc: acc["out"]))
        return F.concat(F.array_join(out, ""), cut(text, F.element_at(bounds, -1), F.length(text).cast("long")))

    tops = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, long(0), lambda acc, s: F.greatest(acc, s["end"])))
    whole = _bound(_chunks(F.col("pii_spans")), lambda c: _bound(_running(tops(c), lambda a, v: F.greatest(a, v)), lambda b: freed(c, b)))
    return marked.withColumn("text", F.when(F.col("text").isNull() | (F.size("pii_spans") == 0), F.col("text")).otherwise(whole))
