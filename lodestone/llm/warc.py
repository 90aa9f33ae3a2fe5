"""WARC archives of pages, and an index of captures by external merge.

Writing.  One record a page, made by column expressions and written by Spark's text
writer with the record separator of WARC as line separator, so archives land on any
store and no task holds more than a record.  Of records with equal payloads of at least
``REVISIT_BYTES`` bytes, that with the smallest page_id is a response and the others
revisit it.  Payload digests are grouped (with partial sums) before anything is joined,
and only the revisits are joined back, by page.

Reading.  Archives are streamed: pieces between separators are put together by
Content-Length, so payloads may hold any bytes, the separator included.

Index.  Captures are sorted where they are read (a run a task), dealt by ranges of
(URL key, timestamp, page_id), and a loser tree merges the runs of a range; ranges are
cut on the whole key, so one URL may span many.  A capture's number in its URL's
history follows from the counts at range ends.

Cases: null html is an empty payload; a null url is written as an empty target and has
a null key.  Pages without an id are always responses and refer to nothing.  Rows that
repeat a page_id are records of their own; those with the response's own page_id are
responses too.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import new_path, staged, table

REVISIT_BYTES = 100
#: Until there is a capture time in the table, all captures bear this one.
CAPTURED = "2024-01-01T00:00:00Z"
#: Up to this many revisits (16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Captures merged in one task.
RANGE_ROWS = 1 << 14

SEP = "\r\n\r\n"
_NAME = "<urn:lodestone:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def records(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """A string column ``record``: a WARC record of each page without its last separator."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        F.col("url").isNull().alias("no_url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        (F.lit(CAPTURED) if captured is None else captured).alias("captured"),
    ).withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    long_ = rows.where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    first = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").select("digest", "first")
    again = staged(long_.where("page_id is not null").join(first, "digest").where("page_id > first").select("page_id", "digest", "first").distinct(), "revisits")
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = rows.join(again, (rows.page_id == again["_page"]) & (rows.digest == again["_digest"]), "left")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(SEP))
    revisit = F.col("first").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: {_NAME}"), name, F.lit(">\r\nWARC-Date: "), F.coalesce("captured", F.lit(CAPTURED)),
        F.when(F.col("no_url"), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url"))),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_REVISIT}\r\nWARC-Refers-To: {_NAME}"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit(SEP),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("record"))


def write(pages: DataFrame, path: str, captured: Column | None = None) -> None:
    records(pages, captured).write.option("lineSep", SEP).option("compression", "gzip").text(path)


def _header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


def _number(name: str | None) -> int | None:
    x = (name or "").removeprefix(_NAME).removesuffix(">")
    return None if x in ("", "null") else int(x)


class _Stream:
    """Records of one archive from its pieces between separators."""

    def __init__(self, archive: str):
        self.archive, self.held, self.head, self.lack = archive, bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[dict[str, Any]]:
        self.held += piece + b"\r\n\r\n"
        while True:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end <= 0:
                    return
                self.head, self.held = _header(bytes(self.held[:end])), self.held[end + 4 :]
                self.lack = int(self.head["Content-Length"])
            if len(self.held) < self.lack + 4:
                return
            block, self.held = bytes(self.held[: self.lack]), self.held[self.lack + 4 :]
            head, self.head = self.head, None
            yield self._record(head, block)

    def close(self) -> None:
        if self.head is not None or self.held not in (b"", b"\r\n\r\n"):
            raise ValueError(f"{self.archive} ends within a record")

    def _record(self, head: dict[str, str], block: bytes) -> dict[str, Any]:
        http, payload = block.split(b"\r\n\r\n", 1)
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
        if kind == "response":
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
        return {
            "page_id": _number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "captured": head["WARC-Date"], "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": _number(head.get("WARC-Refers-To")), "archive": self.archive,
        }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream: _Stream | None = None
    for batch in batches:
        out = []
        names = batch.column(1).to_pylist()
        for piece, name in zip(batch.column(0), names, strict=True):
            if stream is None or stream.archive != name:
                if stream is not None:
                    stream.close()
                stream = _Stream(name)
            out += stream.feed(piece.as_buffer().to_pybytes())
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
    if stream is not None:
        stream.close()


_SCHEMA = pa.schema([(a, {"long": pa.int64(), "string": pa.string()}[b]) for a, b in (x.split() for x in _RECORDS.split(", "))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row a record; fails where an archive is cut short or a payload is damaged."""
    pieces = spark.read.option("lineSep", SEP).text(path).select("value", F.col("_metadata.file_name").alias("archive"))
    return pieces.mapInArrow(_parse, _RECORDS)


def url_key(url: Column) -> Column:
    """Sort key: host labels in reverse, then path and query; URLs without a scheme are all path."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, scheme + r"([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


class LoserTree:
    """Merge of k sorted lists: each inner node holds the loser of its match, so the
    next least item costs one walk from its leaf to the root."""

    def __init__(self, runs: list[list[Any]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Does run a's next item come before run b's? -1 is before all, a run that ended after all."""
        if a == -1 or b == -1:
            return a == -1
        if self.at[b] == len(self.runs[b]):
            return self.at[a] < len(self.runs[a]) or a < b
        if self.at[a] == len(self.runs[a]):
            return False
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            if i == -1:
                return
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[Any]:
        while self.k and self.at[w := self.tree[0]] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


_LEAST = -(1 << 63)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, with the range's number and each row's number in its URL's part of the range."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    keys = list(zip(
        (x is not None for x in t.column("url_key").to_pylist()), (x or "" for x in t.column("url_key").to_pylist()), t.column("captured").to_pylist(),
        (_LEAST if x is None else x for x in t.column("page_id").to_pylist()), range(t.num_rows), strict=True,
    ))
    runs: dict[int, list[Any]] = {}
    for run, key in zip(t.column("run").to_pylist(), keys, strict=True):
        runs.setdefault(run, []).append(key)
    order, number, last = [], [], None
    for key in LoserTree([sorted(x) for x in runs.values()]):  # sorted() only checks a run that came in order
        number.append(1 if key[:2] != last else number[-1] + 1)
        last = key[:2]
        order.append(key[4])
    out = t.take(pa.array(order, pa.int64())).append_column("part", pa.array([part] * len(order), pa.int32())).append_column("number", pa.array(number, pa.int64()))
    yield from out.combine_chunks().to_batches()


def histories(found: DataFrame) -> DataFrame:
    """Captures with url_key and capture_no, their number in the URL's history by (captured, page_id)."""
    spark = found.sparkSession
    rows = staged(found.withColumn("url_key", url_key(F.col("url"))), "captures")
    parts = max(4, -(-rows.count() // RANGE_ROWS))
    runs = rows.sortWithinPartitions("url_key", "captured", "page_id").withColumn("run", F.spark_partition_id())
    ranged = runs.repartitionByRange(parts, "url_key", "captured", "page_id")
    schema = f"{', '.join(f'{a} {b}' for a, b in ranged.dtypes)}, part int, number long"
    merged = staged(ranged.mapInArrow(_merge, schema), "merged")
    ends = merged.groupBy("part").agg(
        F.min(F.struct(F.col("url_key").isNotNull(), "url_key")).alias("lo"), F.max(F.struct(F.col("url_key").isNotNull(), "url_key", "number")).alias("hi"))
    base, carried, last = [], 0, object()
    for r in ends.orderBy("part").collect():  # a row a range
        first, end = r["lo"]["url_key"], r["hi"]["url_key"]
        before = carried if first == last else 0
        base.append((r["part"], first, before))
        carried = r["hi"]["number"] + (before if end == first else 0)
        last = end
    shift = spark.createDataFrame(base, "_part int, _key string, _before long")
    on = (merged.part == shift["_part"]) & merged.url_key.eqNullSafe(shift["_key"])
    return merged.join(shift, on, "left").withColumn("capture_no", F.col("number") + F.coalesce("_before", F.lit(0))).drop("_part", "_key", "_before", "part", "number", "run")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return histories(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


SQL = rf"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)', 1) AS rest
  FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, k.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture_no
FROM k LEFT JOIN f ON f.d = k.d AND n >= {REVISIT_BYTES}
"""
