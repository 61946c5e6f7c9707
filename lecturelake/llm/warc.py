"""WARC files and records, and the resolution of revisits that say "not modified".

Files are written by Spark's text writer, whose line separator is what closes a record, and read
by the length that each record states; they may be plain or gzipped, whole or a member a record.

A revisit holds headers only.  It is resolved by an as-of join: the latest full response of the
same canonical URL with an earlier date.  The join counts if a validator agrees (the entity tag
by weak comparison where both have one, else the modification date), and then the revisit's
headers are laid over the response's, except those that a 304 answer may not change.

The as-of join first leaves one row per (URL, date), so that any number of captures of one URL at
one time is one row; then a running maximum is taken in two levels, so that one URL with very many
captures is spread over time: inside (URL, time slice), and over the slices of a URL for what came
before them; revisits look their date up.  Only record ids and headers move, never bodies.

Defined results: a null or blank URL resolves to nothing, and so does a revisit without a date; a
response without a date is earlier than nothing; records of equal date don't count as
earlier, and of several responses at the latest date the one with the largest id counts; repeated
records are kept; an empty table gives an empty result; further columns are ignored.  Of a file
that is cut off, the whole records before the cut are read; a record without a readable length ends
where the next one opens.
"""

from __future__ import annotations

import gzip
import io
import math
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

CRLF = "\r\n"
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

#: Headers that a 304 answer does not change: those of one connection, and those of the body.
KEPT = [
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]

#: Query parameters that don't name a page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www``, default port, fragment, tracking parameters and closing slash; host
    in lower case; parameters in order.  Null where there is no host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    asked = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")))


def serialize(records: DataFrame) -> DataFrame:
    """``record_id`` and ``warc``: the text of a record, from ``record_id, kind, url, date_ms, http,
    body`` (``http``: header lines joined by CRLF)."""
    content = F.concat(F.when(F.col("kind") == "revisit", "HTTP/1.1 304 Not Modified").otherwise("HTTP/1.1 200 OK"), F.lit(CRLF), "http", F.lit(CRLF * 2), F.coalesce("body", F.lit("")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), F.col("record_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_millis("date_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        F.when(F.col("kind") == "revisit", f"WARC-Profile: {NOT_MODIFIED}"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
    ]
    return records.select("record_id", F.concat(F.array_join(F.array_compact(F.array(*lines)), CRLF), F.lit(CRLF * 2), content).alias("warc"))


def _pairs(block: Column) -> Column:
    """Header lines as names in lower case and values."""
    return F.transform(
        F.filter(F.split(block, CRLF), lambda x: x.contains(":")),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")),
    )


def _fields(pairs: str) -> Column:
    """A column of pairs as a map; of repeated names the last counts."""
    names = F.transform(pairs, lambda p: p["k"])
    back = F.reverse(F.col(pairs))
    distinct = F.size(F.array_distinct(names)) == F.size(names)
    first = lambda p, i: F.array_position(F.transform(back, lambda q: q["k"]), p["k"]) == i + 1
    return F.map_from_entries(F.when(distinct, F.col(pairs)).otherwise(F.filter(back, first)))


#: What is cut out of a file for each record: its header, the header of the answer it holds, and the body.
PARTS = "head string, http string, body binary"


def cut_records(stream: io.BufferedIOBase) -> Iterator[tuple[str, str, bytes]]:
    """``PARTS`` of every record of an open file, by the lengths that records state."""
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        head, length = [line], None
        while (line := stream.readline()).strip():
            head.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
        if not line:
            return
        if length is None:
            content = []
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                content.append(line)
            block = b"".join(content)
        else:
            block = stream.read(length)
            if len(block) < length:
                return
            line = stream.readline()
        http, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        yield b"".join(head).decode("utf-8", "replace"), http.decode("utf-8", "replace"), body


def opened(data: bytes) -> io.BufferedIOBase:
    """A file's bytes as a stream of records, unpacked as it is read where it is gzipped."""
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw


def cut_files(files: DataFrame, bodies: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """``PARTS`` of all records of whole files (``content``); without ``bodies`` these are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        kinds = zip((pa.string(), pa.string(), pa.binary()), ("head", "http", "body"), strict=True)
        types, names = zip(*kinds, strict=True)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for b in batches:
            for data in b.column("content"):
                try:
                    for head, http, body in cut_records(opened(data.as_py())):
                        held.append((head, http, body if bodies else None))
                        size += len(head) + len(http) + (len(body) if bodies else 0)
                        if size >= batch_bytes:
                            yield batch()
                            held, size = [], 0
                except (EOFError, zlib.error, gzip.BadGzipFile):  # cut off
                    pass
        if held:
            yield batch()

    return files.select("content").mapInArrow(run, PARTS)


def parse(parts: DataFrame) -> DataFrame:
    """Records from ``PARTS``: ``record_id, kind, url, date_ms, http`` (a map), ``body``."""
    lines = parts.select(_pairs(F.col("head")).alias("p"), _pairs(F.col("http")).alias("q"), "body")
    fields = lines.select(_fields("p").alias("h"), _fields("q").alias("http"), "body")
    return fields.select(
        F.regexp_extract(F.col("h")["warc-record-id"], r"<urn:record:(-?\d+)>", 1).try_cast("long").alias("record_id"),
        F.col("h")["warc-type"].alias("kind"),
        F.col("h")["warc-target-uri"].alias("url"),
        F.unix_millis(F.try_to_timestamp(F.col("h")["warc-date"])).alias("date_ms"),
        "http",
        "body",
    )


#: Bytes of records in a file at most, and the classes of record sizes by which that is kept.
FILE_BYTES, SIZE_CLASSES = 1 << 29, (1 << 16, 1 << 22)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", records_per_file: int = 8192, file_bytes: int = FILE_BYTES, classes: Sequence[int] = SIZE_CLASSES) -> None:
    """Write ``records`` (as ``serialize`` takes them) as files of at most ``file_bytes`` before compression, and
    of at most so many records.

    Records are written by classes of size, each with as many to a file as fit if all have the largest
    size of the class; those above the last class have a file each.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("http", "body", "url")), F.lit(1024))
    sized = records.withColumn("_class", sum(((size > c).cast("int") for c in classes), F.lit(0)))
    for k in sorted(r["_class"] for r in sized.select("_class").distinct().collect()) or [0]:
        fit = max(1, file_bytes // classes[k]) if k < len(classes) else 1
        lines = serialize(sized.where(F.col("_class") == k).drop("_class")).select(F.col("warc").alias("value"))
        writer = lines.write.mode("append").option("lineSep", CRLF * 2).option("compression", compression)
        writer.option("maxRecordsPerFile", min(records_per_file, fit)).text(path)


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of files, plain or gzipped; a file is read by one task and must be smaller than 2 GB (those of
    ``write_warc`` are, unless one record is larger)."""
    return parse(cut_files(spark.read.format("binaryFile").load(path), bodies))


def sliced(rows: DataFrame, rows_per_slice: int, intervals: int = 1000) -> DataFrame:
    """``rows`` with ``_slice``, which never falls as ``date_ms`` grows.

    Borders are approximate quantiles, so that a few odd dates don't draw all others into one slice;
    where more slices are needed than ``intervals``, each interval is divided evenly.
    """
    n, low, high = rows.agg(F.count("date_ms"), F.min("date_ms"), F.max("date_ms")).first()
    wanted = max(1, n // rows_per_slice)
    k = min(wanted, intervals)
    cuts = rows.approxQuantile("date_ms", [i / k for i in range(1, k)], 1 / (4 * intervals)) if k > 1 else []
    cuts = sorted({int(x) for x in cuts} - {low})
    if not cuts:
        return rows.withColumn("_slice", F.lit(0).cast("long"))
    widths = [max(1, -(-(b - a) * k // wanted)) for a, b in zip([low, *cuts], [*cuts, high + 1], strict=True)]
    at = Bucketizer(splits=[-math.inf, *map(float, cuts), math.inf], inputCol="date_ms", outputCol="_at", handleInvalid="keep")
    i = F.col("_at").cast("int")
    inside = F.floor((F.col("date_ms") - F.get(F.lit([low, *cuts]), i)) / F.get(F.lit(widths), i))
    return at.transform(rows).withColumn("_slice", F.when(F.col("date_ms").isNotNull(), i.cast("long") * (-(-wanted // k) + 1) + inside)).drop("_at")


def resolve(records: DataFrame, rows_per_slice: int = 2048) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, status, response_id, headers``.

    ``records``: ``record_id, kind, url, date_ms, http``.  ``status`` is ``resolved``, ``no-response``,
    ``etag-mismatch``, ``date-mismatch`` or ``no-validator``; ``response_id`` and ``headers`` (a map)
    are null unless resolved.
    """
    rows = records.select("record_id", "kind", "date_ms", "http", canonical_url(F.col("url")).alias("canonical_url"))
    # Written once without bodies: parsing is not repeated by the steps below.
    rows = materialize(rows).where(F.col("kind").isin("response", "revisit"))
    entries = F.array_sort(F.map_entries("http"))
    full = F.when(F.col("kind") == "response", F.struct("date_ms", "record_id", entries.alias("http")))
    rows = sliced(rows, rows_per_slice).withColumn("_full", full)
    inside = W.partitionBy("canonical_url", "_slice").orderBy("date_ms").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("canonical_url").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    placed = "canonical_url is not null and date_ms is not null"
    times = rows.where(placed).groupBy("canonical_url", "_slice", "date_ms").agg(F.max("_full").alias("_full"))
    carried = (
        times.groupBy("canonical_url", "_slice").agg(F.max("_full").alias("_last"))
        .select("canonical_url", "_slice", F.max("_last").over(earlier).alias("_carried"))
    )
    near = times.select("canonical_url", "_slice", "date_ms", F.max("_full").over(inside).alias("_near"))
    as_of = near.join(carried, ["canonical_url", "_slice"]).select("canonical_url", "date_ms", F.coalesce("_near", "_carried").alias("_r"))
    own = rows.where("kind = 'revisit'").select("record_id", "canonical_url", "date_ms", "http")
    found = own.where(placed).join(as_of, ["canonical_url", "date_ms"])
    lost = own.where(f"not ({placed})").withColumn("_r", F.lit(None).cast(as_of.schema["_r"].dataType))
    both = found.select("record_id", "canonical_url", "http", "_r").unionByName(lost.select("record_id", "canonical_url", "http", "_r"))
    theirs = F.map_from_entries("_r.http")
    tag = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    both = both.withColumn("_m", theirs)
    own, stored = F.col("http"), F.col("_m")
    status = (
        F.when(F.col("_r").isNull(), "no-response")
        .when(tag(own).isNotNull() & tag(stored).isNotNull(), F.when(tag(own) == tag(stored), "resolved").otherwise("etag-mismatch"))
        .when(own["last-modified"].isNotNull() & stored["last-modified"].isNotNull(), F.when(own["last-modified"] == stored["last-modified"], "resolved").otherwise("date-mismatch"))
        .otherwise("no-validator")
    )
    fresh = F.map_filter(own, lambda k, v: ~k.isin(KEPT))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "canonical_url", "status", F.when(ok, F.col("_r.record_id")).alias("response_id"), F.when(ok, merged).alias("headers")
    )


def archive_of(pages: DataFrame) -> DataFrame:
    """Records as a crawler would leave them for ``pages`` (``page_id, url, html``): a response for
    each page and two revisits, some before it, some without or with other validators."""
    p, k = F.col("page_id"), F.col("k")
    date = F.lit(1_700_000_000_000) + p * 7919 % 1_000_003 * 1000
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("day "), (date / 86_400_000).cast("long").cast("string"))
    own = (
        F.when(k == 0, tag).when(p % 11 == 0, None).when(p % 5 == 0, F.lit('"changed"')).when(p % 5 == 1, None)
        .when(p % 5 == 2, F.concat(F.lit("W/"), tag)).otherwise(tag)
    )
    seen = F.when((k > 0) & (p % 11 == 0), None).when((k > 0) & (p % 10 == 1), F.lit("day 0")).otherwise(changed)
    lines = [
        F.when(own.isNotNull(), F.concat(F.lit("ETag: "), own)),
        F.when(seen.isNotNull(), F.concat(F.lit("Last-Modified: "), seen)),
        F.concat(F.lit("Date: "), (date + k * 1000).cast("string")),
        F.when(k == 0, "Content-Type: text/html").otherwise("Content-Type: text/plain"),
        F.when(k == 0, F.concat(F.lit("Content-Length: "), F.octet_length("html").cast("string"))).otherwise("Content-Length: 0"),
        F.when(k == 1, "Cache-Control: max-age=60"),
    ]
    return pages.select("page_id", "url", "html", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k")).select(
        (p * 8 + k).alias("record_id"),
        F.when(k == 0, "response").otherwise("revisit").alias("kind"),
        "url",
        (date + F.when(k == 0, 0).when(p % 7 == 0, -3_600_000).otherwise(k * 86_400_000)).alias("date_ms"),
        F.array_join(F.array_compact(F.array(*lines)), CRLF).alias("http"),
        F.when(k == 0, F.col("html")).alias("body"),
    )
