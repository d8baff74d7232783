"""WARC archives: a writer and a Spark data source.

The source plans one partition per archive file.  Of every record it parses
the headers first; predicates on the record type and on headers that Spark
pushes down are tested there, and a record that fails them is skipped without
inflating or decoding its payload (records written here carry their compressed
length in the gzip header, as the format's ``sl`` extra field).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull

from basalt.llm._text import shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_ROWS = 100_000  # groups of equal payloads, of some 100 bytes each
EPOCH = "1970-01-01T00:00:00Z"  # the tables have no capture times
SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, refers_to string, "
    "page_id string, payload_bytes bigint, headers map<string,string>, payload binary"
)
#: Columns that a header gives alone; predicates on these are pushed down.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_id": "X-Page-Id",
}


def file_system(uri: str):
    """File system and path of a URI; a bare path is local."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing ----


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose header says how long it is (compressed and not)."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    clean = lambda v: v.replace("\r", " ").replace("\n", " ")
    lines = [f"WARC-Type: {kind}", *(f"{k}: {clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record_name(page_id) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit if ``refers_to`` names another page.

    A revisit has the response's HTTP headers, with the length of the full
    payload, and its digest, but not the payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": record_name(page_id), "WARC-Date": EPOCH, "WARC-Target-URI": url, "X-Page-Id": None if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is None:
        return record("response", headers, http + payload)
    headers |= {"WARC-Refers-To": record_name(refers_to), "WARC-Profile": PROFILE, "WARC-Truncated": "length"}
    return record("revisit", headers, http)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, refers_to``: of rows with equal payloads (null
    counts as empty) that with the largest id has no ``refers_to``, the others
    have its id.  Equality is that of SHA-256 and length.

    Hashes are counted without their payloads; the groups of several rows are
    joined back, broadcast where they are few, so that unique payloads cross no
    shuffle then.  Beyond that both sides meet in a shuffle.
    """
    base = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("_key", F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload")))
    spark = pages.sparkSession
    place = shared_dir(spark, "payloads")
    largest = base.groupBy("_key").agg(F.max("page_id").alias("_of"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    largest.write.parquet(f"{place}/groups")
    largest = spark.read.parquet(f"{place}/groups")
    if largest.count() <= BROADCAST_ROWS:
        largest = F.broadcast(largest)
    joined = base.join(largest, "_key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("_of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_of")), F.col("_of")).alias("refers_to"))


def write(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes ``with_revisits`` rows as gzipped WARC files, one for each task
    with rows, and returns their manifest (``path, records, bytes``).

    A task's file has a name of its own and counts only through its row in the
    manifest, which Spark commits once: retried or lost tasks leave no record
    twice.
    """

    def run(batches):
        fs, root = file_system(folder)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name, compression=None)
                out.write(gzip_member(record("warcinfo", {"WARC-Record-ID": record_name(None), "WARC-Date": EPOCH, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), level))
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                out.write(gzip_member(page_record(*row), level))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["path", "records", "bytes"])

    spark = pages.sparkSession
    pages.mapInArrow(run, "path string, records bigint, bytes bigint").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


# ---- reading ----


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


class _Member:
    """One record's bytes, inflated only as far as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.ended, self.size = file, at, bytearray(), False, None
        file.seek(at)
        start = file.read(18)
        self.empty = not start
        self.inflate = None
        if start[:2] == b"\x1f\x8b":
            if start[3] & 4:
                (extra,) = struct.unpack("<H", start[10:12])
                file.seek(at + 12)
                field = file.read(extra)
                if field[:2] == b"sl" and len(field) >= 12:
                    (self.size,) = struct.unpack("<I", field[4:8])
            self.inflate = zlib.decompressobj(31)
        file.seek(at)

    def more(self, step: int = 4096) -> bool:
        chunk = self.file.read(step)
        if not chunk:
            self.ended = True
        elif self.inflate:
            self.data += self.inflate.decompress(chunk)
            self.ended = self.inflate.eof
        else:
            self.data += chunk
        return not self.ended

    def until(self, mark: bytes, start: int = 0) -> int:
        """Where a mark begins (-1: nowhere); nothing is searched twice."""
        while (i := self.data.find(mark, start)) < 0:
            start = max(start, len(self.data) - len(mark) + 1)
            if self.ended:
                return -1
            self.more()
        return i

    def upto(self, n: int) -> None:
        while len(self.data) < n and not self.ended:
            self.more(1 << 16)

    def next_at(self, length: int) -> int:
        """Where the next record starts; ``length``: bytes of this one, inflated."""
        if self.size is not None:
            return self.at + self.size
        if self.inflate is None:
            return self.at + length
        while not self.ended:
            self.data.clear()
            self.more(1 << 16)
        return self.file.tell() - len(self.inflate.unused_data)


def records(file, wanted=lambda headers: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the wanted records of an open archive file; without
    ``payload`` the block of an HTTP record ends with its HTTP headers, and
    nothing behind them is inflated where the record's length is known."""
    at = 0
    while True:
        member = _Member(file, at)
        if member.empty:
            return
        end = member.until(b"\r\n\r\n")
        if end < 0:
            if member.data.strip():
                raise ValueError(f"no WARC record at byte {at}")
            return
        headers = parse_headers(bytes(member.data[:end]))
        size = int(headers.get("Content-Length", 0))
        start = end + 4
        if wanted(headers):
            to = start + size
            if not payload:
                head = member.until(b"\r\n\r\n", start) if is_http(headers) else start - 4
                to = min(to, head + 4) if head >= 0 else to
            member.upto(to)
            block = bytes(memoryview(member.data)[start:to])
            if len(block) < to - start:
                raise ValueError(f"record at byte {at} is cut off")
            yield headers, block
        at = member.next_at(start + size + 4)


def is_http(headers: dict[str, str]) -> bool:
    return headers.get("Content-Type", "").startswith("application/http")


def http_payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload of a block and the length its HTTP headers give (its own, if none)."""
    if not is_http(headers):
        return block, int(headers.get("Content-Length", len(block)))
    end = block.find(b"\r\n\r\n")
    head, payload = (block[:end], block[end + 4 :]) if end >= 0 else (block, b"")
    said = {k.lower(): v for k, v in parse_headers(head).items()}.get("content-length", "")
    return payload, int(said) if said.isdigit() else len(payload)


class WarcPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.paths = json.loads(options["files"]) if "files" in options else None
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Takes equality and membership tests on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, ()))
            elif column in HEADERS:
                self.tests.append((column, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.folder)
        paths = self.paths
        if paths is None:
            from pyarrow.fs import FileSelector

            found = [i.path for i in fs.get_file_info(FileSelector(root, recursive=True)) if i.is_file]
            paths = sorted(p for p in found if p.endswith((".warc", ".warc.gz")))
            if manifest := [p for p in found if p.startswith(f"{root}/manifest/") and p.endswith(".parquet")]:
                # A folder that ``write`` made: files of lost or repeated tasks are not in its manifest.
                import pyarrow.parquet as pq

                listed = {name.rpartition("/")[2] for p in manifest for name in pq.read_table(fs.open_input_file(p), columns=["path"])["path"].to_pylist()}
                paths = [p for p in paths if p.rpartition("/")[2] in listed]
        return [WarcPartition([p]) for p in paths] or [WarcPartition([])]

    def _column(self, name: str, headers: dict[str, str]) -> str | None:
        value = headers.get(HEADERS[name])
        return value.rpartition(":")[2] if value and name == "payload_digest" else value

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, values in self.tests:
            value = self._column(column, headers)
            if value is None and None not in values or values and value not in values:
                return False
        return True

    def read(self, partition):
        fs, _ = file_system(self.folder)
        names = [*HEADERS, "payload_bytes", "headers", "payload"]
        order = [c.strip().split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as file:
                for headers, block in records(file, self._wanted, self.payload):
                    payload, size = http_payload(headers, block)
                    if headers.get("WARC-Type") == "revisit" or not self.payload:
                        payload = None
                    digest = payload_digest(payload) if payload is not None and headers.get("WARC-Payload-Digest") else None
                    if digest and digest != self._column("payload_digest", headers):
                        raise ValueError(f"{headers.get('WARC-Record-ID')}: the payload's digest differs")
                    rows.append((*(self._column(c, headers) for c in HEADERS), size if payload is None else len(payload), list(headers.items()), payload))
                    held += len(block)
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield self._batch(rows, names, order)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, names, order)

    @staticmethod
    def _batch(rows, names, order):
        kinds = {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        made = {n: pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)}
        return pa.RecordBatch.from_arrays([made[n] for n in order], order)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` after ``register(spark)``.

    Options: ``payload`` ("false": payloads stay null and are not inflated; a
    response's ``payload_bytes`` is what its HTTP headers say), ``files`` (JSON
    list of files instead of all in the folder).  Payloads that are read are
    held against their digests.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, folder: str, paths: list[str] | None = None, payload: bool = True, push_down: bool = True) -> DataFrame:
    """Records of the archives in a folder.  Spark hands predicates to Python
    sources only while ``spark.sql.python.filterPushdown.enabled`` is on when a
    query is planned: with ``push_down`` it is turned on for the session."""
    register(spark)
    if push_down:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    if paths is not None:
        reader = reader.option("files", json.dumps(paths))
    return reader.load(folder)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the
    records read back from archives written of ``pages``.

    Null payloads are empty; empty payloads are equal payloads like any other.
    Rows with the largest id of their group are responses, also if that id is
    repeated; a null id never is the largest unless all are null.  Payloads are
    read whole and held against their digests, very long ones one at a time, in
    time that grows with their length.  An empty table writes no file.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    kind = dict(pages.dtypes)[id_col]
    manifest = write(with_revisits(pages, id_col, url_col, payload_col), folder)
    paths = [r["path"] for r in manifest.select("path").collect()]  # a file list, as any file source plans on the driver
    back = read(spark, folder, paths).filter(F.col("record_type").isin("response", "revisit"))
    refers = F.regexp_extract("refers_to", "^<urn:x-page:(.*)>$", 1)
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", refers.cast(kind)).alias("refers_to"),
    )
