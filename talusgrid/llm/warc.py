"""Web archives (WARC 1.1): a writer that is a text sink, and a reader that is a Python data source.

Writing. A record is a line of Spark's text sink whose line separator is the record separator, so archives get the
sink's commit protocol, file systems and compression. Payloads that occur more than once are written once, by the
page with the smallest id; the others become revisit records. For that only ids and digests are grouped, never
payloads, so a payload that a third of all pages share is no hot group.

Reading. `format("warc")` plans a partition per file or, for plain files, per `splitBytes` of a file; a record belongs to
the split in which it starts. Record type, target and refers-to predicates are pushed down. A reader parses a record's
header first and then skips the rest unless the record passes and payloads are wanted (`payload=false` turns them
off); plain files are skipped by seeking. Both plain and gzip files (one or many members) are read.

Cases. A null payload is an empty one. Equal ids with equal payloads are one page: all are responses or all revisits.
A null page_id comes after all others, and is null again when read. Line breaks in addresses are percent-encoded; a null
address has no header. An empty table gives an archive without records. Other columns are not written.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from talusgrid.sources.workspace import new_table_path

BREAK = "\r\n"
SEPARATOR = BREAK * 2
RECORDS_PER_FILE = 50_000
SPLIT_BYTES = 128 << 20
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PUSHED = ("record_type", "record_id", "target_uri", "refers_to")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: each five hex digits are four base32 digits."""
    whole = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(whole, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first): pages whose payload a page with a smaller id has."""
    keys = pages.select("page_id", base32_sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    ids = keys.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("ids")).where("ids > 1 and first is not null").drop("ids")
    return ids.join(first, "digest").where("page_id is null or page_id > first").select("page_id", "digest", "first")


def records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> one record per row, as text without the separator that follows it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    both = rows.alias("p").join(revisits(pages).alias("r"), same, "left").select("p.*", "first")
    again = F.col("first").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.octet_length("html").cast("string"), F.lit(SEPARATOR)
    )
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.when(again, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), _page_uri(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _page_uri(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return both.select(F.concat(F.concat_ws(BREAK, *lines), F.lit(SEPARATOR), block).alias("value"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    records(pages).write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class Stream:
    """A file of records: header lines, then a body that is read or skipped."""

    def __init__(self, raw, packed: bool):
        self.file = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 16)
        self.packed = packed

    def header(self) -> dict[str, str] | None:
        line = self.file.readline()
        while line in (b"\r\n", b"\n"):
            line = self.file.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        return self.fields()

    def fields(self) -> dict[str, str]:
        out = {}
        while (line := self.file.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        return out

    def skip(self, size: int) -> None:
        if not self.packed:
            self.file.seek(size, 1)
            return
        while size > 0:
            got = len(self.file.read(min(size, 1 << 16)))
            if got == 0:
                raise ValueError("archive ends inside a record")
            size -= got

    def body(self, size: int) -> bytes:
        value = self.file.read(size)
        if len(value) < size:
            raise ValueError("archive ends inside a record")
        return value


def _split_body(body: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and payload of a block."""
    head, _, payload = body.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields, payload


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PUSHED and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in PUSHED and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in PUSHED and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(folder)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(folder, recursive=True))
        out = []
        for f in files:
            if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")):
                continue
            if f.base_name.endswith(".gz"):
                out.append(Split(f.path, 0, None))
            else:
                out += [Split(f.path, at, at + self.split) for at in range(0, f.size, self.split)]
        return out or [Split("", 0, 0)]

    def passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or (own not in value if kind == "in" else not own.startswith(value)):
                return False
        return True

    def read(self, partition: Split) -> Iterator[tuple]:
        if not partition.path:
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        packed = partition.path.endswith(".gz")
        with system.open_input_file(partition.path) as raw:
            stream = Stream(raw, packed)
            while True:
                at = 0 if packed else stream.file.tell()
                if partition.end is not None and at >= partition.end:
                    return
                fields = stream.header()
                if fields is None:
                    return
                size = int(fields.get("content-length", 0))
                row = {
                    "record_type": fields.get("warc-type"),
                    "record_id": fields.get("warc-record-id"),
                    "target_uri": fields.get("warc-target-uri"),
                    "refers_to": fields.get("warc-refers-to"),
                }
                if at < partition.start or not self.passes(row):
                    stream.skip(size)
                    continue
                digest = fields.get("warc-payload-digest", "")
                # A revisit's block is a short HTTP header; only that of other records may be large.
                http, payload = {}, None
                if self.payload or row["record_type"] == "revisit":
                    http, payload = _split_body(stream.body(size))
                else:
                    stream.skip(size)
                length = http.get("content-length")
                if row["record_type"] == "revisit":
                    payload = None
                elif payload is not None:
                    length = len(payload)
                yield (*row.values(), digest.partition(":")[2] or None, None if length is None else int(length), payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under path. Turns on the session's predicate push-down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(uri: Column) -> Column:
    """Page id inside a record id; null for the page without one."""
    return F.regexp_extract(uri, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to a new archive in the shared folder and returns its records with their pages."""
    path = new_table_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    found = read_warc(pages.sparkSession, path)
    # Responses are measured by what was read back; revisits carry the figures of the payload they stand for.
    digest = F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest"))
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"), "target_uri")


