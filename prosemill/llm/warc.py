"""WARC archives of web pages, and archives without repeated payloads.

Archives are gzip files of WARC records, written and read by Spark: the text writer ends each record with the two line ends that the
format asks for, and the reader takes files as they are and follows the records' lengths, so payloads may hold anything.

Revisits are resolved on headers alone: these are shuffled by payload digest, each group of equal payloads gets one original, and the
others are joined to it. The new archives hold the originals with their payloads and fresh headers, and a revisit record that names its
original for each of the others. Payloads are read once more and never shuffled, unless more records are revisits than may be broadcast.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, stored_path

#: Keys that are broadcast at most; bytes of records that leave a task together; records of a file at most.
BROADCAST, BATCH, FILE = 1 << 18, 1 << 24, 100_000
#: Payloads below this are kept as they are.
LEAST = 1000
#: Parts of the format.
END, VERSION = "\r\n", "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = "file string, place long, kind string, record_id string, page_id long, url string, date string, digest string, refers_to string, bytes long"


def uri(url: Column) -> Column:
    """A URL as a header's value: control characters, which would end it, are percent-encoded."""
    out = url
    for i in (*range(32), 127):
        out = F.replace(out, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return F.when(url.rlike("[\\x00-\\x1f\\x7f]"), out).otherwise(url)


def field(name: str, value: Column) -> Column:
    """A header's line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def http_head(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END + END))


def record(kind: str, payload: Column | None) -> Column:
    """A record's bytes as a string, of columns as in HEADER; a revisit has no payload, and its original's number of bytes is not said."""
    head = http_head(F.col("bytes")) if payload is not None else F.lit(f"HTTP/1.1 200 OK{END}{END}")
    block = F.concat(head, payload) if payload is not None else head
    revisit = [field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.col("refers_to"))] if kind == "revisit" else []
    return F.concat(
        F.lit(f"{VERSION}{END}WARC-Type: {kind}{END}"), field("WARC-Record-ID", F.col("record_id")), field("WARC-Date", F.col("date")), field("WARC-Target-URI", F.col("url")),
        field("Page-ID", F.col("page_id")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), *revisit,
        F.lit(f"Content-Type: application/http; msgtype=response{END}"), field("Content-Length", F.octet_length(block)), F.lit(END), block,
    )


def write(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records (one string column) as archives in a folder, packed at the fastest level."""
    packed = records.write.mode(mode).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    packed.option("lineSep", END + END).option("maxRecordsPerFile", FILE).text(path)


def crawled(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """A response record for each row of pages (page_id, url, html, and any others), with a record id of its own. A null html is empty."""
    day = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri(F.col("url").cast("string")).alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("bytes"), day.alias("date"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"))
    return rows.select(record("response", F.col("html")).alias("value"))


def parsed(content: bytes, file: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of each record of an archive, packed or not; the place counts unpacked bytes. A broken archive raises."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    place = 0
    while line := stream.readline():
        start = place
        place += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {start} of {file}")
        fields = {}
        while (line := stream.readline()).strip():
            place += len(line)
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        place += len(line)
        block = stream.read(size := int(fields.get("content-length", "0")))
        if len(block) < size:
            raise ValueError(f"the record at byte {start} of {file} is cut off")
        place += size
        yield start, fields, block


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """HEADER and, if asked for, payload (binary) of the response and revisit records of archives, other kinds left out.

    bytes and digest of a response are those of its payload as stored; a digest in its header that differs raises. A revisit has the
    digest of its header, no payload, and null bytes.
    """
    schema = HEADER + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        frame = lambda: pd.DataFrame(rows, columns=names).astype({c: object for c in names if c != "place"} | {"page_id": "Int64", "bytes": "Int64"})
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                for place, fields, block in parsed(content, file):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    data = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    digest, page = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("page-id")
                    if kind == "response":
                        if digest not in (None, own := hashlib.sha1(data).hexdigest()):
                            raise ValueError(f"the digest of the record at byte {place} of {file} is wrong")
                        digest, size = own, len(data)
                    else:
                        data = size = None
                    row = (file, place, kind, fields.get("warc-record-id"), int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-date"), digest, fields.get("warc-refers-to"), size)
                    rows.append((*row, data) if payload else row)
                    held += len(data or b"") if payload else 256
                    if held >= BATCH:
                        yield frame()
                        rows, held = [], 0
        if rows:
            yield frame()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def attached(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of groups (a row for each key; n: rows that have it), null where it has none.

    Of the total rows, a key that has more than one in BROADCAST is hot, so at most BROADCAST are, and these are broadcast; groups of
    others are small, and shuffled.
    """
    hot = F.col("n") > max(1000, total // BROADCAST)
    columns = [c for c in groups.columns if c not in (key, "n")]
    marked = rows.join(F.broadcast(groups.filter(hot).withColumn("hot", F.lit(True)).drop("n")), key, "left")
    cold = marked.filter("hot is null").drop("hot", *columns).join(groups.filter(~hot).drop("n"), key, "left")
    return marked.filter("hot").drop("hot").unionByName(cold)


def resolved(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """headers (as HEADER) of the records that become revisits: refers_to names their group's original.

    Of responses with one digest and at least so many bytes, that with the largest page_id is the original; a null page_id is below all
    others, and of several the last by file and place is taken. Revisits that the headers hold already are joined to the original of
    their digest; one without any keeps what it referred to.
    """
    known = headers.filter("kind = 'revisit'")
    whole = headers.filter(F.col("kind") == "response")
    large = whole.filter(F.col("bytes") >= least)
    groups = checkpointed(large.unionByName(known).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "response", F.struct("page_id", "file", "place", "record_id")))["record_id"].alias("original")).filter("n > 1 and original is not null"))
    both = attached(large.unionByName(known), groups, "digest", headers.count())
    repeated = both.filter("original is not null and record_id <> original").drop("refers_to").withColumnRenamed("original", "refers_to")
    lost = both.filter("original is null and kind = 'revisit'").drop("original")
    return repeated.unionByName(lost).select(*headers.columns)


def resolve_archives(spark: SparkSession, source: str, target: str, least: int = LEAST) -> None:
    """Writes the archives of source to target with each repeated payload stored once. Empty archives give empty ones."""
    headers = checkpointed(read(spark, source, payload=False))
    revisits = checkpointed(resolved(headers, least))
    ids = revisits.select("record_id")
    few = ids.count() <= BROADCAST
    whole = read(spark, source).filter("kind = 'response'").join(F.broadcast(ids) if few else ids, "record_id", "left_anti")
    write(whole.select(record("response", F.col("payload").cast("string")).alias("value")), target)
    write(revisits.select(record("revisit", None).alias("value")), target, mode="append")


def described(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each record, a revisit with the bytes and the page of the response it
    refers to, null if the archives don't hold it."""
    rows = checkpointed(read(spark, path, payload=False))
    revisits = rows.filter("kind = 'revisit'").select("page_id", "digest", "refers_to")
    whole = rows.filter("kind = 'response'")
    asked = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    originals = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), "bytes").join(asked, "refers_to")
    found = attached(revisits, checkpointed(originals), "refers_to", rows.count())
    again = found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("original").alias("refers_to"))
    return whole.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """described() of archives of pages, written to the shared folder, resolved into new ones and read back.

    Null and empty html is an empty payload. Repeated rows are records of their own: of a repeated page that is an original, one row is
    the response, and the others are revisits to their own page_id. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    crawl, target = stored_path(spark), stored_path(spark)
    write(crawled(pages), crawl)
    resolve_archives(spark, crawl, target, least)
    return described(spark, target)


SQL = """
WITH p AS (
  SELECT row_number() OVER () AS row, page_id, encode(coalesce(html, '')) AS data FROM pages
), d AS (
  SELECT row, page_id, CAST(octet_length(data) AS BIGINT) AS payload_bytes, sha1(data) AS payload_digest FROM p
), o AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS original FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth > 1 AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN nth > 1 AND payload_bytes >= 1000 THEN original END AS refers_to
FROM o
"""
