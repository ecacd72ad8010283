"""WARC archives of page captures: writing, reading back, and assembly of transactions.

Writing. Each page becomes a capture of three records: a request, a response (or a revisit, if another capture holds an
equal payload), and a metadata record with the page's id. Request and metadata name the response's record id in
``WARC-Concurrent-To``. A record ends with two line ends, which is the record separator of Spark's text writer, so
records are built as column expressions and Spark writes the archives wherever its file systems reach.

Reading. Archives are read as streams, all members of a gzip file, parsed by content length, and give one row per record.
Transactions are assembled by joining requests and metadata to responses through the concurrent-to id: one nested row per
capture.

Defined results: a null html is an empty payload; a null URL leaves out the target URI; a null page_id leaves out the id,
and the capture comes back with a null page_id, after all others where the largest id counts. Rows that repeat a page_id
are captures of their own; of equal large payloads with equal ids one is the response. An empty table gives no captures.
Extra columns, whatever their names, are ignored. A very long page is one record, which one task holds whole. A malformed or
truncated archive fails the read with its name, unless ``strict=False`` asks for the records before the fault.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import looked_up, staged, table, with_row_keys, without

#: Payloads from this many bytes on are stored once.
MIN_SHARED = 1000
#: Records' fixed date: archives of the same pages are equal byte for byte.
DATE = "2024-01-01T00:00:00Z"
PAGES_PER_FILE = 2_000
END, GAP = "\r\n", b"\r\n\r\n"
#: Bytes of a record's headers at most.
MAX_HEADER = 1 << 20
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def urn(key: Column) -> Column:
    """A record id of a 32-digit hex key."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its closing line ends; headers with a null value are left out."""
    lines: list[tuple[str, Column | str]] = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    text = [F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END)), F.lit("")) for name, value in lines]
    return F.concat(F.lit(f"WARC/1.1{END}"), *text, F.lit(END), block)


def captures(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, html (null for a revisit), bytes, digest, key (of the response record), refers_key and refers_id (null unless a revisit).

    Equal payloads are found on narrow rows. Whole pages are never shuffled: responses are written where they are read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = with_row_keys(pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), html.alias("html")), "tag")
    narrow = staged(keyed.select("page_id", "url", "tag", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest")), "payloads")
    large = narrow.where(F.col("bytes") >= min_shared)
    # combined before the shuffle; digests of one capture have nothing to refer to
    order = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "tag")
    firsts = staged(large.groupBy(F.col("digest").alias("of")).agg(F.max(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-payloads")
    again = looked_up(large, "digest", firsts, "of").where("first.tag <> tag")
    key = lambda tag, page: F.md5(F.concat_ws("|", tag, page, "digest"))
    again = staged(again.select("page_id", "url", "tag", "bytes", "digest", key(F.col("first.tag"), F.col("first.page_id")).alias("refers_key"), F.col("first.page_id").alias("refers_id")), "revisits")
    own = without(keyed, again.select("tag"), "tag").withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    nothing = {"refers_key": F.lit(None).cast("string"), "refers_id": F.lit(None).cast("long")}
    rows = own.withColumns(nothing).unionByName(again.withColumns({"html": F.lit(None).cast("string"), "refers_id": F.col("refers_id").cast("long")}))
    return rows.withColumn("key", key(F.col("tag"), F.col("page_id"))).drop("tag")


def write_archives(pages: DataFrame, path: str, min_shared: int = MIN_SHARED, pages_per_file: int = PAGES_PER_FILE) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzipped archives into the folder ``path``."""
    rows = captures(pages, min_shared)
    key, uri = urn(F.col("key")), ("WARC-Target-URI", F.col("url"))
    digest = F.concat(F.lit("sha1:"), F.upper("digest"))
    target = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    request = record("request", urn(F.md5(F.concat("key", F.lit("q")))), [uri, ("WARC-Concurrent-To", key), ("Content-Type", "application/http; msgtype=request")],
                     F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END)))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    again = F.col("refers_key").isNotNull()
    response = record(F.when(again, "revisit").otherwise("response"), key,
                      [uri, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", urn(F.col("refers_key"))), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", "application/http; msgtype=response")],
                      F.when(again, head).otherwise(F.concat(head, "html")))
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")),
                     F.coalesce(F.concat(F.lit("refers-to-page-id: "), F.col("refers_id").cast("string"), F.lit(END)), F.lit("")))
    metadata = record("metadata", urn(F.md5(F.concat("key", F.lit("m")))), [uri, ("WARC-Concurrent-To", key), ("Content-Type", "application/warc-fields")], facts)
    gap = F.lit(GAP.decode())
    rows.select(F.concat(request, gap, response, gap, metadata).alias("value")).write.option("lineSep", GAP.decode()).option("compression", "gzip").option("maxRecordsPerFile", pages_per_file).text(path)


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, whose bytes come in chunks of any length.

    One record is held at a time. Raises ValueError where an archive is malformed or ends within a record.
    """
    it, held = iter(chunks), b""

    def filled(n: int) -> bool:
        """Hold n bytes at least, unless the archive ends."""
        nonlocal held
        parts, size = [held], len(held)
        while size < n and (chunk := next(it, None)) is not None:
            parts.append(chunk)
            size += len(chunk)
        held = b"".join(parts)
        return size >= n

    while True:
        while not (held := held.lstrip(b"\r\n")):
            if not filled(1):
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > MAX_HEADER or not filled(len(held) + 1):
                raise ValueError("a WARC record's headers do not end")
        version, *lines = held[:end].decode("utf-8", "replace").split(END)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not version.startswith("WARC/") or not headers.get("content-length", "").isdigit() or "warc-type" not in headers or "warc-record-id" not in headers:
            raise ValueError(f"no WARC record: {version[:60]!r}")
        upto = end + 4 + int(headers["content-length"])
        if not filled(upto):
            raise ValueError(f"{headers['warc-record-id']} is cut off")
        yield headers, held[end + 4 : upto]
        held = held[upto:]


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(END)[1:])}, body


def record_row(h: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of RECORD; raises ValueError if a payload is not what the headers say."""
    kind, fields, size, digest, body = h["warc-type"], {}, None, None, None
    told = h.get("warc-payload-digest", "")
    if kind == "response":
        _, body = http_parts(block)
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if told.startswith("sha1:") and len(told) == 45 and told[5:].lower() != digest:  # base-32 digests of other writers are not compared
            raise ValueError(f"payload of {h['warc-record-id']} is not what its headers say")
    elif kind == "revisit":
        http, _ = http_parts(block)
        length = http.get("content-length", "")
        size, digest = int(length) if length.isdigit() else None, told[5:].lower() if told.startswith("sha1:") else None
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(END) if x)}
    return h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), list(fields.items()), size, digest, body if payloads else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row per record. A response's payload is its HTTP body; a revisit has the size and digest of the full one.

    Archives are streams: Spark unpacks all members of a gzip file and deals its bytes out in pieces, so a task holds one
    record at a time, however long the archive is. A malformed or truncated archive fails the read, or with
    ``strict=False`` gives the records before the fault.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]

        def pieces() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for file, value in zip(batch.column("file"), batch.column("value")):
                    yield file.as_py(), value.as_py() + GAP

        def found() -> Iterator[tuple]:
            for file, own in groupby(pieces(), lambda x: x[0]):
                try:
                    for headers, block in parse(x[1] for x in own):
                        yield record_row(headers, block, payloads)
                except ValueError as fault:
                    if strict:
                        raise ValueError(f"{file}: {fault}") from fault

        for some in by_size(found()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)

    files = spark.read.option("lineSep", GAP.decode()).option("ignoreCorruptFiles", not strict).option("pathGlobFilter", "*.gz").text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(rows, RECORD)


def by_size(rows: Iterable[tuple], most: int = 500, most_bytes: int = 16 << 20) -> Iterator[list[tuple]]:
    """Rows of RECORD in lists of a bounded number of rows and of payload bytes (or of one longer row)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= most or size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs; null where there is none).

    Requests and metadata meet their response by the id that they name as concurrent, in one shuffle for all three. A
    capture without a response or revisit gives no row. Of records that repeat an id, one is taken.
    """
    answer = F.col("type").isin("response", "revisit")
    own = F.when(answer, F.col("record_id")).otherwise(F.col("concurrent_to"))
    whole = F.struct(*records.columns)
    pick = lambda what, name: F.first(F.when(what, whole), ignorenulls=True).alias(name)
    rows = records.where(answer | F.col("type").isin("request", "metadata")).withColumn("capture_id", own).where("capture_id is not null")
    made = rows.groupBy("capture_id").agg(pick(answer, "response"), pick(F.col("type") == "request", "request"), pick(F.col("type") == "metadata", "metadata"))
    return made.where("response is not null")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = assemble(read_archives(spark, path, payloads=False))
    return found.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("metadata.fields")["refers-to-page-id"].cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
