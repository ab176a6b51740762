"""WARC archives of captures, read back through an externally merged index.

Pages become WARC/1.1 records (gzip member each) in files of the shared folder. Every writing task also leaves an index
run: its captures sorted by URL key, timestamp and page. The runs are merged k ways by a loser tree into globally ordered
capture histories: a merge pass joins at most `fan_in` runs, and the last pass cuts the order into parts, each merged by
a task that seeks into every run by a sparse index. A part ends at any capture, also amid those of one URL, so that a
URL with very many captures is cut too. The sparse index (one capture of SPARSE, and the last of each run) is a table; of
it only the parts' bounds come to the driver, and a task gets one place for each run.

Payloads of at least `least` bytes that are equal (SHA-256) share one response record, that of the smallest page_id; the
others are revisit records that refer to it. Shorter payloads are always responses.

Defined results: a null html is an empty payload; a null url is written as an empty key; a null time (column `time`, if
one is named) counts as `stamp`; repeated rows are captures of their own: of rows with the smallest page_id and one
payload, one with the smallest url is the response and the others revisit it; a null page_id sorts last and can be a
response of its own payload only if no other id has it; ids of any 64 bits are kept as they are; a payload of any length
is one record, held whole by one task; an empty table gives no files and no rows; further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, flagged, fresh_dir, removed, saved, scratch

FAN_IN = 256
SPARSE = 64
FILE_BYTES = 256 << 20
STAMP = "2024-01-01T00:00:00Z"
#: Broadcast the rows that revisit another up to this many (about 200 bytes each); beyond it, they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Repeats of one row that a task writes in a go.
REPEATS = 65_536


def url_key(url: str) -> str:
    """The sort key of a URL: host labels reversed and joined by commas, then path and query, lower-cased."""
    try:
        parts = urlsplit(url if "://" in url else "http://" + url)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + port + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


class LoserTree:
    """Merges sorted iterators: each next item costs one comparison per level."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.head]
        self.tree = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; ended runs are last, ties go by run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return self.keys[a] < self.keys[b] or (self.keys[a] == self.keys[b] and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self):
        while self.k and self.keys[self.winner] is not None:
            w = self.winner
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self.keys[w] = None if self.head[w] is None else self.key(self.head[w])
            node = (w + self.k) // 2
            while node:
                if self._less(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _record(kind: str, page: int | None, url: str, digest: str, refers: int | None, refers_url: str, payload: bytes, size: int, stamp: str) -> bytes:
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers)}", f"WARC-Refers-To-Target-URI: {refers_url}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Bytes: {size}"]
        payload = b""
    text = "WARC/1.1\r\n" + "\r\n".join(x.replace("\r", " ").replace("\n", " ") for x in head) + f"\r\nContent-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n", 3, mtime=0)


def _key(line: dict) -> tuple:
    return line["k"], line["t"], line["p"] is None, line["p"] or 0, line["f"], line["o"]


def _write_run(system, path: str, lines: Iterator[dict]) -> pd.DataFrame:
    """Writes a sorted run; a row for every SPARSE-th line and the last: path, k, t, none, p, f, o, at (place), n (all lines; in the first row)."""
    n, at, marks, tmp, last = 0, 0, [], f"{path}.{uuid.uuid4().hex}", None
    with system.open_output_stream(tmp) as f:
        for x in lines:
            raw = json.dumps(x, separators=(",", ":")).encode() + b"\n"
            last = (path, *_key(x), at, 0)
            if n % SPARSE == 0:
                marks.append(last)
            f.write(raw)
            n, at = n + 1, at + len(raw)
    system.move(tmp, path)
    if last is not None and marks[-1] != last:
        marks.append(last)
    out = pd.DataFrame(marks, columns=["path", "k", "t", "none", "p", "f", "o", "at", "n"])
    out.loc[:0, "n"] = n
    return out


MARKS = "path string, k string, t string, none boolean, p long, f string, o long, at long, n long"
ORDER = ["k", "t", "none", "p", "f", "o"]


def _read_run(system, path: str, at: int = 0, low: tuple | None = None, high: tuple | None = None) -> Iterator[dict]:
    """Lines of a run from a place on whose key is at least low and below high."""
    with system.open_input_file(path) as f:
        f.seek(at)
        rest = b""
        while block := f.read(1 << 16):
            *lines, rest = (rest + block).split(b"\n")
            for raw in lines:
                x = json.loads(raw)
                key = _key(x)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield x


def decided(spark: SparkSession, pages: DataFrame, least: int = 100, time: str | None = None, stamp: str = STAMP) -> DataFrame:
    """page_id, url, stamp, payload (null in revisits), size, digest, revisit, refers_to, refers_url: what each page's record is.

    Equal payloads are found by digest alone. Payloads move only if the revisits are too many to broadcast; rows that
    repeat both page_id and payload are counted first, so that a row with very many repeats moves once.
    """
    when = F.lit(stamp) if time is None else F.coalesce(F.date_format(F.to_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(stamp))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), when.alias("stamp"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    pairs = rows.where(F.col("size") >= least).groupBy("page_id", "digest").agg(F.min("url").alias("url"), F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    firsts = pairs.groupBy("digest").agg(first, F.sum("rows").alias("all")).where("all > 1")
    own = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    again = pairs.join(firsts, "digest").where(~own | (F.col("rows") > 1))
    again = again.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "rows", own.alias("own"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    again = saved(spark, again, "again", lasting=True)
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    joined = rows.join(few, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("d").isNotNull()
    out = ["page_id", "url", "stamp", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "digest", "revisit", "refers_to", "refers_url"]
    single = joined.where(F.coalesce(F.col("rows"), F.lit(1)) == 1).withColumn("revisit", revisit).select(*out)
    if again.where("rows > 1").isEmpty():
        return single
    # one row for each different one, then its copies, REPEATS together
    copies = joined.where("rows > 1").groupBy("page_id", "url", "stamp", "digest", "size", "own", "refers_to", "refers_url").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    lowest = copies.groupBy("page_id", "digest").agg(F.min(F.struct("url", "stamp")).alias("lowest")).select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "lowest")
    copies = copies.join(lowest, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS))))
    heads = F.col("own") & (F.struct("url", "stamp") == F.col("lowest"))
    copies = copies.withColumns({"head": heads & (F.col("part") == 0), "many": F.least(F.lit(REPEATS), F.col("copies") - F.col("part") * REPEATS)})
    copies = copies.withColumn("payload", F.when(F.col("head"), F.col("payload"))).repartition("page_id", "digest", "url", "part")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).withColumn("revisit", ~(F.col("head") & (F.col("copy") == 1)))
    return single.unionByName(copies.select(*out))


def write_archives(spark: SparkSession, pages: DataFrame, out_dir: str, least: int = 100, stamp: str = STAMP, time: str | None = None) -> DataFrame:
    """Writes archives and their sorted index runs; the runs' sparse index (MARKS)."""
    bounded_batches(spark)
    with scratch(spark):
        return _write(spark, decided(spark, pages, least, time, stamp), out_dir)


def _write(spark: SparkSession, rows: DataFrame, out_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _fs(out_dir)
        system.create_dir(base, recursive=True)
        name, sink, at, lines = "", None, 0, []

        def close() -> pd.DataFrame:
            sink.close()
            system.move(f"{base}/{name}.tmp", f"{base}/{name}.warc.gz")
            lines.sort(key=_key)
            return _write_run(system, f"{base}/{name}.cdxj", iter(lines))

        def number(b: pd.DataFrame, c: str) -> list:
            return [None if none else x for x, none in zip(b[c].tolist(), b[f"no_{c}"].tolist(), strict=True)]

        for b in batches:
            for page, url, when, payload, size, digest, again, ref, ref_url in zip(number(b, "page_id"), b["url"], b["stamp"], b["payload"], b["size"], b["digest"], b["revisit"], number(b, "refers_to"), b["refers_url"], strict=True):
                if sink is None or at > FILE_BYTES:
                    if sink is not None:
                        yield close()
                    name, at, lines = uuid.uuid4().hex, 0, []
                    sink = system.open_output_stream(f"{base}/{name}.tmp")
                raw = _record("revisit" if again else "response", page, url, digest, ref if again else None, (ref_url or "") if again else "", b"" if again else bytes(payload), size, when)
                sink.write(raw)
                lines.append({"k": url_key(url), "t": when, "p": page, "f": f"{name}.warc.gz", "o": at, "l": len(raw)})
                at += len(raw)
        if sink is not None:
            yield close()

    rows = rows.select(*flagged("page_id", "refers_to"), "url", "stamp", "payload", "size", "digest", "revisit", "refers_url")
    return saved(spark, rows.mapInPandas(run, MARKS), "runs", lasting=True)


def merged(spark: SparkSession, marks: DataFrame, out_dir: str, fan_in: int = FAN_IN, parts: int | None = None) -> DataFrame:
    """Globally ordered capture lines: part, at (place in part), k, t, p, f, o, l. Parts ascend."""
    runs = marks.where("n > 0")  # the first mark of each run
    count = runs.count()
    while count > fan_in:  # merge passes until one pass can open all runs
        numbered = runs.select("path", (F.row_number().over(Window.orderBy("path")) % -(-count // fan_in)).alias("g"))  # a row for each run

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            system, base = _fs(out_dir)
            return _write_run(system, f"{base}/{uuid.uuid4().hex}.cdxj", iter(LoserTree([_read_run(system, p) for p in sorted(pdf["path"])], _key)))

        marks = saved(spark, numbered.groupBy("g").applyInPandas(join, MARKS), "merged-runs")
        runs = marks.where("n > 0")
        count = runs.count()
    total = runs.agg(F.sum("n")).first()[0] or 0
    parts = parts or max(1, min(10_000, -(-total // 2000)))
    # the least mark of each range of marks: at most `parts` bounds come to the driver
    ranged = marks.repartitionByRange(parts, *ORDER).groupBy(F.spark_partition_id().alias("i")).agg(F.min(F.struct(*ORDER)).alias("low"))
    bounds = sorted(tuple(r["low"]) for r in ranged.collect())[1:]
    shared = spark.sparkContext.broadcast(bounds)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        for b in batches:
            keys = zip(*(b[c].tolist() for c in ORDER), strict=True)
            yield pd.DataFrame({"path": b["path"], "at": b["at"], "part": [bisect_right(shared.value, k) for k in keys]})

    # a run is read from its last mark before a part on, in every part from its first mark's to its last one's
    steps = marks.mapInPandas(placed, "path string, at long, part long").groupBy("path", "part").agg(F.min("at").alias("low"), F.max("at").alias("at"))
    run_of = Window.partitionBy("path").orderBy("part")
    steps = steps.withColumns({"next": F.lead("part").over(run_of), "first": F.row_number().over(run_of) == 1})
    after = steps.where("next is not null").select("path", "at", F.explode(F.sequence(F.col("part") + 1, F.col("next"))).alias("part"))
    starts = after.unionByName(steps.where("first").select("path", F.col("low").alias("at"), "part"))
    plan = starts.groupBy("part").agg(F.collect_list(F.struct("path", "at")).alias("runs"))  # at most fan_in places each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _fs(out_dir)
        lows = [None, *shared.value]
        for b in batches:
            for part, places in zip(b["part"].tolist(), b["runs"], strict=True):
                low, high = lows[part], lows[part + 1] if part + 1 < len(lows) else None
                open_ = [_read_run(system, x["path"], x["at"], low, high) for x in sorted(places, key=lambda x: x["path"])]
                held, at = [], 0
                for x in LoserTree(open_, _key):
                    held.append((part, at, x["k"], x["t"], x["p"], x["f"], x["o"], x["l"]))
                    at += 1
                    if len(held) == 4096:
                        yield _frame(held)
                        held = []
                if held:
                    yield _frame(held)

    return plan.repartition(max(1, parts), "part").mapInPandas(run, "part long, at long, k string, t string, p long, f string, o long, l long")


def _nullable(ids: Iterable[int | None]) -> pd.arrays.IntegerArray:
    """Ids with nulls, exact beyond 2^53."""
    ids = list(ids)
    return pd.arrays.IntegerArray(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], bool))


def _frame(held: list[tuple]) -> pd.DataFrame:
    names = ["part", "at", "k", "t", "p", "f", "o", "l"]
    columns = dict(zip(names, map(list, zip(*held, strict=True)), strict=True))
    return pd.DataFrame(columns | {"p": _nullable(columns["p"])})


def read_records(spark: SparkSession, histories: DataFrame, out_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits): what the archives say."""
    bounded_batches(spark)

    def number(x: str) -> int | None:
        x = x.rpartition(":")[2].rstrip(">")
        return None if x == "none" else int(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _fs(out_dir)
        for b in batches:
            rows = []
            for f, part in b.sort_values(["f", "o"]).groupby("f", sort=False):
                with system.open_input_file(f"{base}/{f}") as file:
                    for o, n in zip(part["o"].tolist(), part["l"].tolist(), strict=True):
                        file.seek(o)
                        raw = zlib.decompress(file.read(n), 31)
                        head, _, body = raw.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
                        payload = body[: int(h["Content-Length"])]
                        if h["WARC-Type"] == "response":
                            digest = hashlib.sha256(payload).hexdigest()
                            if h["WARC-Payload-Digest"] != "sha256:" + digest:
                                raise ValueError(f"{f} at {o}: the payload does not match its digest")
                            rows.append((number(h["WARC-Record-ID"]), len(payload), digest, "response", None, payload))
                        else:
                            rows.append((number(h["WARC-Record-ID"]), int(h["X-Payload-Bytes"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", number(h["WARC-Refers-To"]), None))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            yield out.assign(page_id=_nullable(r[0] for r in rows), refers_to=_nullable(r[4] for r in rows))

    return histories.select("f", "o", "l").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 100, time: str | None = None) -> DataFrame:
    """Writes the archives, merges their index and returns what the records say."""
    out = fresh_dir(spark, "archives")
    with scratch(spark):
        marks = write_archives(spark, pages, out, least, time=time)
        histories = saved(spark, merged(spark, marks, out), "histories", lasting=True)
    return read_records(spark, histories, out)


def discard(spark: SparkSession, out_dir: str) -> None:
    """Removes archives and their index."""
    removed(spark, out_dir)
