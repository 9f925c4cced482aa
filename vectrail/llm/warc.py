"""WARC archives: writing captures, reading them back, assembling transactions.

Writing: every page gives three records, request, response (or revisit) and
metadata. Request and metadata name the response in WARC-Concurrent-To. The
archives are plain concatenated records; Spark's text writer separates rows
with the two CRLFs that end a WARC record, so a lost executor's file is
written again by the commit protocol. Of pages with equal payloads of at
least ``min_bytes`` bytes the one with the largest id is the response and
the others are revisits without payload that refer to it.

Reading: each archive file is decompressed in steps and cut into records by
Content-Length, never by searching for separators, since payloads may hold
anything; a task holds one compressed file and one record. Files are bounded
by ``captures_per_file`` and, from the mean size of a page, by ``file_bytes``.

Assembly: the records of a capture meet on the identifier of the response
and give one nested row.

Null html is an empty payload; null ids and urls are written as empty
fields and read back as null. Pages repeated in id, url and html are a capture
each, told apart by a number in their identifiers; the first of them counts as
the one with the largest id. An empty table gives empty archives and no rows.
Other columns are ignored. A payload may have up to 2 GB, as any Spark string.
Archives are gzip files without a warcinfo record, of one member each.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import fresh_path, stored

CRLF = "\r\n"
READ_BYTES = 1 << 20


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the UTF-8 bytes: 4 times 40 bits."""
    digest = F.sha1(F.encode(text, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(kind: Column | str, rid: Column, uri: Column, date: str, block: Column, content_type: str, more: list[tuple[str, Column]]) -> Column:
    """One WARC record up to, but without, its closing CRLF CRLF. Null fields are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{n}: "), F.regexp_replace(v, "[\r\n]", " "), F.lit(CRLF)), F.lit("")) for n, v in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF), block)


KEY = ["id", "url", "digest"]


def null_safe(*names: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def numbered(source: DataFrame, plan: DataFrame, chunk: int = 1000) -> DataFrame:
    """``source`` with ``holder`` from ``plan``, and with ``copy``, which counts
    rows that are equal in id, url and digest from 0. Only such rows are
    shuffled for it: one of them is kept and made as often as they were, in
    chunks, so that no task makes them all."""
    once = source.join(plan, "k", "left").where("coalesce(n, 1) = 1").drop("n").withColumn("copy", F.lit(0).cast("bigint"))
    first = source.join(plan.where("n > 1"), "k").dropDuplicates(["k"])
    starts = first.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(chunk).cast("bigint")))).repartition("k", "start")
    made = starts.withColumn("copy", F.explode(F.sequence("start", F.least(F.col("start") + chunk, F.col("n")) - 1))).drop("n", "start")
    return once.unionByName(made)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, captures_per_file: int = 2048, file_bytes: int = 256 << 20) -> None:
    """Write ``pages`` as gzip-compressed archives into the folder ``path``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), base32_sha1(html).alias("digest")).withColumn("k", null_safe(*KEY))
    brief = stored(source.select(*KEY, "k", F.octet_length("html").alias("size")).groupBy(*KEY, "k", "size").agg(F.count("*").alias("n")), "digests")
    mean = brief.agg(F.try_divide(F.sum(F.col("size").cast("double") * F.col("n")), F.sum("n"))).first()[0] or 0.0
    captures_per_file = max(1, min(captures_per_file, int(file_bytes / (mean + 1024))))
    # which capture holds the payload: one row per digest, joined back to the brief rows only
    holders = stored(brief.where(f"size >= {int(min_bytes)}").groupBy("digest").agg(F.max(F.struct("id", "url")).alias("holder"), F.sum("n").alias("all")).where("all > 1").select("digest", "holder"), "holders")
    plan = stored(brief.join(holders, "digest", "left").where("holder is not null or n > 1").select("k", "n", "holder"), "plan")
    x = numbered(source, plan)

    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    key = [F.col(n) for n in (*KEY, "copy")]
    rid = record_id("response", *key)
    revisit = F.col("holder").isNotNull() & ~(F.struct("id", "url").eqNullSafe(F.col("holder")) & (F.col("copy") == 0))
    refers = F.when(revisit, record_id("response", F.col("holder.id"), F.col("holder.url"), F.col("digest"), F.lit(0)))
    size = F.octet_length("html").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), size, F.lit(CRLF + CRLF))
    response = record(F.when(revisit, "revisit").otherwise("response"), rid, F.col("url"), date, F.when(revisit, head).otherwise(F.concat(head, F.col("html"))), "application/http; msgtype=response", [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", refers), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))])
    request = record("request", record_id("request", *key), F.col("url"), date, F.lit("GET / HTTP/1.1" + CRLF + CRLF), "application/http; msgtype=request", [("WARC-Concurrent-To", rid)])
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF + "payload-length: "), size, F.lit(CRLF))
    metadata = record("metadata", record_id("metadata", *key), F.col("url"), date, notes, "application/warc-fields", [("WARC-Concurrent-To", rid)])
    x.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", 3 * captures_per_file).option("compression", "gzip").text(path)


class Archive:
    """Bytes of a gzip archive of any number of members, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.gzip = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.gzip.eof:  # the next member
            self.at -= len(self.gzip.unused_data)
            self.gzip = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + READ_BYTES]
        self.at += len(part)
        self.held += self.gzip.decompress(part)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What lies before ``mark``, which is passed; None at the end."""
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a record's head")
                return None
        found = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return found

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.more():
                raise ValueError("the archive ends within a record")
        found = bytes(self.held[:size])
        del self.held[:size]
        return found


def parse_records(data: bytes):
    """(fields, block) of every record of a compressed archive."""
    archive = Archive(data)
    while (head := archive.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {n.lower(): v for n, _, v in (x.partition(": ") for x in lines[1:])}
        block = archive.take(int(fields["content-length"]))
        archive.take(4)
        yield fields, block


RECORDS = "record_id string, type string, capture string, uri string, refers_to string, digest string, payload_bytes bigint, page_id bigint, payload string"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives; ``capture`` is the response's identifier."""

    def rows(data: bytes):
        for fields, block in parse_records(data):
            kind, page_id, size, payload = fields["warc-type"], None, None, None
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind in ("response", "revisit"):
                body = block.partition(b"\r\n\r\n")[2]
                if kind == "response":
                    size, payload = len(body), body.decode() if with_payload else None
                    if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"payload digest differs in {fields['warc-record-id']}")
            elif kind == "metadata":
                notes = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
                page_id, size = int(notes["page-id"]) if notes.get("page-id") else None, int(notes["payload-length"])
            rid = fields["warc-record-id"]
            yield (rid, kind, fields.get("warc-concurrent-to", rid), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, page_id, payload), len(block)

    types = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    batch = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                found, held = [], 0
                for row, size in rows(content.as_buffer()):
                    found.append(row)
                    held += size if with_payload else 0
                    if len(found) == 1000 or held > 16 * READ_BYTES:
                        yield batch(found)
                        found, held = [], 0
                if found:
                    yield batch(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response and metadata, joined on
    the concurrent-to identifier. Repeated records count once."""
    parts = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    whole = F.struct("record_id", "type", "uri", "refers_to", "digest", "payload_bytes", "page_id", "payload")
    return records.groupBy("capture").agg(*[F.max(F.when(F.col("type").isin(kinds), whole)).alias(n) for n, kinds in parts.items()])


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Digest columns of each capture; a revisit takes its page_id reference
    and payload size from the response it refers to."""
    t = transactions(read_records(spark, path, with_payload=False))
    flat = stored(t.select("capture", F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "response.refers_to"), "captures")
    held = flat.where("record_type = 'response'").select(F.col("capture").alias("refers_to"), F.col("page_id").alias("held_by"), F.col("payload_bytes").alias("held_bytes"))
    out = flat.join(held, "refers_to", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("held_by").alias("refers_to"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, **options)
    return captures(spark, path)
