"""Web archives (WARC 1.1) as a Spark data source, read and written."""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from textloom.operators.skew import lookup
from textloom.session import fresh_path, pin

SCHEMA = (
    "record_id string, warc_type string, warc_date string, target_uri string, payload_digest string, "
    "refers_to string, content_type string, http_length long, payload binary"
)
# Columns that come from the record's header lines (fixed names of the format).
HEADERS = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "warc_date": "warc-date", "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class WarcFiles(ds.InputPartition):
    paths: list[str]


class WarcSource(ds.DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``.

    Read options: ``partition_bytes``. Write options: ``file_bytes``, ``level`` (gzip), ``date``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, dict(self.options))


def header_test(test: ds.Filter) -> Callable[[dict], bool] | None:
    """A pushed filter as a test of a record's header columns; None if it is of another kind."""
    if isinstance(test, ds.Not):
        inner = header_test(test.child)
        # Null stays unselected either way, as in SQL.
        return inner and (lambda h: h.get(test.child.attribute[0]) is not None and not inner(h))
    name = getattr(test, "attribute", ("",))
    if len(name) != 1 or name[0] not in HEADERS:
        return None
    value = lambda h: h.get(name[0])
    if isinstance(test, ds.EqualTo):
        return lambda h: value(h) is not None and value(h) == test.value
    if isinstance(test, ds.In):
        return lambda h: value(h) in test.value
    if isinstance(test, ds.IsNotNull):
        return lambda h: value(h) is not None
    if isinstance(test, ds.IsNull):
        return lambda h: value(h) is None
    if isinstance(test, ds.StringStartsWith):
        return lambda h: (value(h) or "").startswith(test.value)
    if isinstance(test, ds.StringEndsWith):
        return lambda h: (value(h) or "").endswith(test.value)
    if isinstance(test, ds.StringContains):
        return lambda h: test.value in (value(h) or "")
    return None


class WarcReader(ds.DataSourceReader):
    """Headers are parsed first; blocks of records that the filters or the schema do not want are passed over."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.kinds = {"http_length": pa.int64(), "payload": pa.binary()}
        self.path, self.most = options["path"], int(options.get("partition_bytes", FILE_BYTES))
        self.tests: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for test in filters:
            if header_test(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[WarcFiles]:
        """Files in groups of up to ``partition_bytes``; where a commit list exists, only files that it names."""
        store, path = opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        commits = [f for f in found if f.base_name.startswith("_committed-")]
        wanted = {n for f in commits for n in json.loads(store.open_input_stream(f.path).read())}
        files = sorted(
            (f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and (not commits or f.base_name in wanted)
        )
        groups, size = [WarcFiles([])], 0
        for name, n in files:
            if groups[-1].paths and size + n > self.most:
                groups.append(WarcFiles([]))
                size = 0
            groups[-1].paths.append(name)
            size += n
        return groups

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        tests = [header_test(t) for t in self.tests]
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for row in records(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw), tests, self.columns):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(c) for r in rows], self.kinds.get(c, pa.string())) for c in self.columns], self.columns
        )


def header_lines(stream) -> dict[str, str]:
    out, last = {}, None
    while (line := stream.readline()).strip():
        if line[:1] in b" \t" and last:
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def records(stream, tests: list[Callable[[dict], bool]], columns: list[str]) -> Iterator[dict]:
    """Rows of the records that pass the tests. The stream stands at the start of a record."""
    wants_block = "payload" in columns or "http_length" in columns
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        lines = header_lines(stream)
        length = int(lines.get("content-length", 0))
        row = {c: lines.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        if not all(test(row) for test in tests):
            stream.seek(length, 1)
            continue
        if not wants_block or not length:
            stream.seek(length, 1)
        elif (row["content_type"] or "").startswith("application/http"):
            end = stream.tell() + length
            stream.readline()
            http = header_lines(stream)
            row["http_length"] = int(http["content-length"]) if "content-length" in http else None
            if "payload" in columns:
                row["payload"] = stream.read(max(0, end - stream.tell()))
            else:
                stream.seek(end)
        else:
            row["payload"] = stream.read(length)
        yield row


@dataclass
class WarcDone(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    """Each task writes its own files; only the driver's commit list makes them part of the archive.

    So a task that ran twice, or half, leaves nothing that a reader sees.
    """

    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.most, self.level = int(options.get("file_bytes", FILE_BYTES)), int(options.get("level", 4))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcDone:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        done, out = [], None
        for batch in iterator:
            for start in range(0, batch.num_rows, 100):
                for row in batch.slice(start, 100).to_pylist():
                    if out is None or out.tell() > self.most:
                        if out is not None:
                            out.close()
                        done.append(f"{self.run}-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{folder}/{done[-1]}", compression=None)
                    out.write(gzip.compress(self.record(row), self.level, mtime=0))
        if out is not None:
            out.close()
        return WarcDone(done)

    def record(self, row: dict) -> bytes:
        payload = row.get("payload") or b""
        revisit = row.get("warc_type") == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['http_length']}\r\n\r\n".encode()
        block = http if revisit else http + payload
        lines = [
            "WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row.get('warc_date') or self.date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {row['payload_digest']}",
        ]
        if row.get("target_uri"):
            lines.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", row["target_uri"]))
        if revisit:
            lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{row['refers_to']}>"]
        lines.append(f"Content-Length: {len(block)}")
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def commit(self, messages: list[WarcDone | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        names = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{folder}/_committed-{self.run}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[WarcDone | None]) -> None:
        store, folder = opened(self.path)
        for name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{name}")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records below ``path``; with ``columns``, nothing else is decoded. Filters on header columns are pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns:
        kinds = dict(part.split() for part in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write_warc(rows: DataFrame, path: str, **options: str) -> None:
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").options(**options).mode("append").save(path)


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A record per row of ``pages(page_id, url, html)``; equal payloads of ``least`` bytes or more become revisits.

    Of records with equal payloads the smallest page_id is the response. Rows that repeat a page_id
    and payload are responses each; rows with a null page_id are responses and are never referred to.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("http_length", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter((F.col("http_length") >= least) & F.col("page_id").isNotNull())
    owners = large.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Pinned, its size is known: where few payloads repeat, the join sends them to the pages instead of moving pages.
    owners = pin(owners, "payload-owners")
    rows = lookup(rows, owners.select("digest", "owner"), "digest", counts=owners, how="left")
    again = F.coalesce(F.col("page_id") > F.col("owner"), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        name("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(again, name("owner")).alias("refers_to"),
        "http_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as an archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of responses the payload itself is measured; a revisit is known from its header lines alone.
    A null html is an empty payload; an empty table is an empty archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(page_records(pages), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS long)")
    full = read_warc(spark, path).filter("warc_type = 'response'")
    full = full.select("record_id", "warc_type", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), F.lit(None).cast("string").alias("refers_to"))
    again = read_warc(spark, path, ["record_id", "warc_type", "payload_digest", "refers_to", "http_length"]).filter("warc_type = 'revisit'")
    again = again.select("record_id", "warc_type", F.col("http_length").alias("n"), F.substring("payload_digest", 8, 64).alias("digest"), "refers_to")
    return full.unionByName(again).select(
        number("record_id").alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
