"""WARC archives: a Python data source that reads them, and a writer of deduplicated records.

The writer is Spark's own text writer: a record is one value, the blank lines after it are the
line separator, so files appear whole and at once, in whatever store Spark writes to. The
reader plans partitions of whole files, parses the headers of a record first, and passes over
the block of a record that the pushed predicates or the asked columns do not want.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from demandgrid.session import scratch_path

HEADERS = {  # columns that record headers fill
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
BODY = ("payload_length", "payload")  # columns that need the block of a record
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SKIP_BYTES = 1 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]
    value: int = 0


class WarcSource(DataSource):
    """Format ``warc``; option ``path``: a folder or file of .warc or .warc.gz archives.

    Columns: the record headers, content_length (of the block), payload_length (as the HTTP
    headers say, else of the payload), payload. A narrower schema skips what it leaves out.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        texts = ", ".join(f"{c} string" for c in HEADERS)
        return f"{texts}, content_length long, payload_length long, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema.fieldNames(), self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, columns: list[str], path: str):
        self.columns = columns
        self.path = path
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((HEADERS[column], "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((HEADERS[column], "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append((HEADERS[column], "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        at = store.get_file_info(root)
        found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(
            (f.path, f.size) for f in found
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.size
        )
        parts: list[Files] = []
        room = 0
        for path, size in files:
            if not parts or size > room:
                parts.append(Files([], 0))
                room = PARTITION_BYTES
            parts[-1].paths.append(path)
            room -= size
        return parts or [Files([], 0)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([
            (c, pa.binary() if c == "payload" else pa.int64() if c.endswith("_length") else pa.string())
            for c in self.columns
        ])
        rows, held = [], 0
        for path in partition.paths:
            for row in self._records(store, path):
                rows.append(row)
                held += 500 + len(row.get("payload") or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _records(self, store: fs.FileSystem, path: str) -> Iterator[dict]:
        with store.open_input_file(path) as source:
            packed = source.read(2) == b"\x1f\x8b"
            source.seek(0)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 18) if packed else io.BufferedReader(source, 1 << 18)
            while (head := _headers(stream)) is not None:
                size = int(head.get("content-length", 0))
                if not self._matches(head):
                    _skip(stream, size, packed)
                    continue
                row = {c: head.get(HEADERS[c]) for c in self.columns if c in HEADERS}
                if "content_length" in self.columns:
                    row["content_length"] = size
                if any(c in BODY for c in self.columns):
                    self._body(stream, head, size, packed, row)
                else:
                    _skip(stream, size, packed)
                yield row

    def _body(self, stream, head: dict, size: int, packed: bool, row: dict) -> None:
        http = head.get("content-type", "").startswith("application/http")
        start = stream.tell()
        inner = (_headers(stream, status=True) or {}) if http and size else {}
        rest = size - (stream.tell() - start)
        if "payload_length" in self.columns:
            row["payload_length"] = int(inner.get("content-length", rest))
        if "payload" in self.columns:
            row["payload"] = stream.read(rest)
        else:
            _skip(stream, rest, packed)

    def _matches(self, head: dict) -> bool:
        for name, how, values in self.wanted:
            found = head.get(name)
            if found is None or not (found in values if how == "in" else found.startswith(values)):
                return False
        return True


def _headers(stream, status: bool = False) -> dict[str, str] | None:
    """Header fields up to the blank line, names in lower case; None at the end of the file."""
    line = stream.readline()
    while not status and line in (b"\r\n", b"\n"):  # the blank lines after the record before
        line = stream.readline()
    if not line:
        return None
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded line goes on with the field before
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def _skip(stream, size: int, packed: bool) -> None:
    if not packed:
        stream.seek(size, io.SEEK_CUR)
        return
    while size > 0 and (got := len(stream.read(min(size, SKIP_BYTES)))):
        size -= got


def read_warc(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Records of the archives; ``columns`` (DDL) names those to decode, else all."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("path", path)
    return (reader.schema(columns) if columns else reader).load()


def base32(hex_digits: Column) -> Column:
    """RFC 4648 base32 of 40 hexadecimal digits."""
    groups = [
        F.lpad(F.conv(F.substring(hex_digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)
    ]
    # fixed values: the two base32 alphabets in order
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """One record per row: a response with its payload, or a revisit of an equal payload.

    Payloads are UTF-8; a null one is empty. Of equal payloads of at least ``revisit_bytes``
    the row with the largest id is the response and the others revisit it; smaller payloads are
    responses. Rows that repeat the largest id are responses each. A null id ranks below all
    others and is written as ``null``; a group of null ids only has no revisits. Line breaks in
    an address become spaces, a null address has no header. Records are gzip files.

    Equal payloads are grouped by digest and length with counts combined before the shuffle;
    only their ids travel, the payloads are joined by no one.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"),
        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = (
        rows.where(F.col("size") >= revisit_bytes).groupBy("sha", "size")
        .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        .withColumnsRenamed({"sha": "gsha", "size": "gsize"})
    )
    marked = rows.join(groups, (F.col("sha") == F.col("gsha")) & (F.col("size") == F.col("gsize")), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = F.lit("\r\n")

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, line), F.lit(""))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        field("Content-Length", F.col("size").cast("string")), line,
    )
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", kind), field("WARC-Record-ID", urn("id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        field("WARC-Refers-To", F.when(again, urn("first"))), field("WARC-Profile", profile),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.octet_length("http") + F.octet_length("body")).cast("string")), line,
    )
    record = F.concat(F.encode("head", "UTF-8"), F.encode("http", "UTF-8"), F.col("body"))
    (
        marked.withColumns({"http": http, "body": body}).withColumn("head", head)
        .select(record.cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    )


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back, one row per record.

    Responses are decoded and their payloads measured and hashed anew; revisits are read by
    their headers alone. Columns: record_id, record_type, refers_to, payload_bytes,
    payload_digest (hexadecimal).
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    responses = (
        read_warc(spark, path, "record_type string, record_id string, refers_to string, payload binary")
        .where(F.col("record_type") == "response")
        .select(
            "record_id", "record_type", "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        )
    )
    revisits = (
        read_warc(
            spark, path,
            "record_type string, record_id string, refers_to string, payload_digest string, payload_length long",
        )
        .where(F.col("record_type") == "revisit")
        .select(
            "record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"),
            from_base32(F.regexp_extract("payload_digest", "^sha1:([A-Z2-7]{32})$", 1)).alias("payload_digest"),
        )
    )
    return responses.union(revisits)


def from_base32(letters: Column) -> Column:
    """40 lower case hexadecimal digits of 32 base32 letters."""
    plain = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    groups = [F.lpad(F.conv(F.substring(plain, 8 * k + 1, 8), 32, 16), 10, "0") for k in range(4)]
    return F.lower(F.concat(*groups))
