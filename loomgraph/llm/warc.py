"""WARC archives as a Spark data source, and an archive writer that stores repeated payloads once.

``spark.read.format("warc")`` lists the archives on the driver and packs whole files into partitions. A task reads
each record's header block first and inflates a payload only if the record passes the pushed-down predicates. Archives
are gzip members, one a record, as the format advises; the writer adds each member's compressed length as a gzip extra
field ("sl"), so that a reader seeks past unwanted records instead of inflating them. Members without that field, files
compressed as a whole and plain files are read as streams whose unwanted blocks are passed over piece by piece. An archive that
ends within a record, or holds anything but records, raises an error that names the place; nothing is dropped silently.

Predicates pushed down: equality and IN on record_type and record_id; equality and prefixes on target_uri and
refers_to. Spark evaluates all others afterwards.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_length", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
LENGTH_HEADER = "X-Payload-Length"


def filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# --- writing -----------------------------------------------------------------------------------------------------


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member whose extra field tells its own length and that of the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"sl" + struct.pack("<HII", 8, 0, len(data) & 0xFFFFFFFF)
    total = 10 + 2 + len(extra) + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def clean(value: str) -> str:
    """A header value on one line: controls are percent-encoded."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(row: dict) -> bytes:
    """The bytes of a record; a revisit holds HTTP headers but no payload."""
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"] or "1970-01-01T00:00:00Z")]
    block, n = b"", row["payload_length"]
    if row["record_type"] in ("response", "revisit"):
        block = HTTP_HEAD % (n or 0) + (b"" if row["record_type"] == "revisit" else row["payload"] or b"")
        head.append(("Content-Type", "application/http; msgtype=response"))
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] * (row["record_type"] == "revisit")
    elif row["payload"]:
        block = row["payload"]
    head += [("WARC-Target-URI", row["target_uri"])] * (row["target_uri"] is not None)
    head += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")] * (row["payload_digest"] is not None)
    head += [("WARC-Refers-To", f"<{row['refers_to']}>")] * (row["refers_to"] is not None)
    head += [(LENGTH_HEADER, str(n))] * (n is not None)
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own to the job's staging folder; the commit on the driver moves them to the path.

    The folder goes with the commit or the abort, and with it what failed, lost and repeated tasks left. Tasks that outlive
    an abort remove their own files; a killed one can leave its folder, which readers don't look into, and which the next commit to
    the path removes once it is a day old.
    """

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.roll = int(options.get("roll_bytes", 128 << 20))
        self.level = int(options.get("level", 1))
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = filesystem(self.path)
        fs.create_dir(f"{base}/{self.staging}", recursive=True)
        files: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        files.append((f"{base}/{self.staging}/{name}", f"{base}/{name}"))
                        out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                        info = {"record_type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}", "date": None, "target_uri": None, "payload": b"software: loomgraph\r\n", "payload_digest": None, "payload_length": None, "refers_to": None}
                        out.write(gzip_member(record(info), self.level))
                    size += out.write(data := gzip_member(record(row), self.level)) or len(data)
                    if size >= self.roll:
                        out.close()
                        out = None
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            for staged, _ in files:
                fs.delete_file(staged)
            if not fs.get_file_info(pafs.FileSelector(f"{base}/{self.staging}", allow_not_found=True)):
                self.abort([])
            raise
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        for m in messages:
            for staged, name in m.files if m else ():
                fs.move(staged, name)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        if fs.get_file_info(f"{base}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.staging}")
        for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.startswith("_staging-") and x.mtime_ns and time.time() - x.mtime_ns / 1e9 > 86_400:
                fs.delete_dir(x.path)


# --- reading -----------------------------------------------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def member_length(head: bytes) -> int | None:
    """The length that the writer left in a member's extra field."""
    if head[:4] == b"\x1f\x8b\x08\x04" and len(head) >= 24 and head[12:14] == b"sl":
        return struct.unpack_from("<I", head, 16)[0] or None
    return None


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def fields(head: dict[str, str]) -> dict:
    bare = lambda x: x and x.strip("<>")
    digest, n = head.get("warc-payload-digest"), head.get(LENGTH_HEADER.lower())
    return {"record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": bare(head.get("warc-target-uri")), "date": head.get("warc-date"), "refers_to": bare(head.get("warc-refers-to")), "payload_digest": digest and digest.rpartition(":")[2].lower(), "payload_length": int(n) if n and n.isdigit() else None}


def payload_of(row: dict, head: dict[str, str], block: bytes) -> bytes | None:
    if row["record_type"] == "revisit":
        return None
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Bytes:
    """The bytes of an archive, inflated where they are gzip members; members may begin and end anywhere."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self.stream, self.chunk = stream, chunk
        self.raw = b""  # read from the file, not yet inflated
        self.data = bytearray()  # inflated, not yet taken
        self.member = None  # the inflater of the open member
        self.used = 0  # bytes of the file that the open member has taken
        self.length: int | None = None  # of the open member, if it tells
        self.at_start = False  # the data begin with the open member's first byte
        self.gz: bool | None = None

    def _read(self) -> bool:
        got = self.stream.read(self.chunk) or b""
        self.raw += got
        return bool(got)

    def more(self, most: int = 1 << 16) -> bool:
        """Adds at most about so many bytes to data; false at the end of the archive."""
        if self.gz is None:
            while len(self.raw) < 2 and self._read():
                pass
            self.gz = self.raw[:2] == b"\x1f\x8b"
        if not self.gz:
            if not self.raw and not self._read():
                return False
            self.data += self.raw
            self.raw = b""
            return True
        if self.member is None:
            while len(self.raw) < 24 and self._read():
                pass
            if not self.raw.strip(b"\0"):  # padding
                self.raw = b""
                return self._read() and self.more(most)
            if self.raw[:2] != b"\x1f\x8b":
                raise ValueError("an archive holds bytes between its gzip members")
            self.member, self.used, self.length = zlib.decompressobj(31), 0, member_length(self.raw[:24])
            self.at_start = not self.data
        ended = not self.raw and not self._read()
        out = self.member.decompress(self.raw, most)  # may hold back output of earlier bytes
        if ended and not out and not self.member.eof:
            raise EOFError("an archive ends within a gzip member")
        rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        self.used += len(self.raw) - len(rest)
        self.raw = rest
        self.data += out
        if self.member.eof:
            self.member = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Takes the bytes up to and with a mark; None if nothing but line ends is left."""
        seen = 0
        while (end := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if not self.more(4096):
                if not self.data.strip():
                    return None
                raise EOFError("an archive ends within a header")
        out = bytes(self.data[: end + len(mark)])
        del self.data[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self.more():
                raise EOFError("an archive ends within a block")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.data):
            n -= len(self.data)
            self.data.clear()
            if not self.gz and not self.raw:
                if not (got := self.stream.read(min(n, 1 << 20))):
                    raise EOFError("an archive ends within a block")
                n -= len(got)
            elif not self.more():
                raise EOFError("an archive ends within a block")
        del self.data[:n]

    def skip_member(self) -> None:
        """Past the open member, whose length is known, without inflating it."""
        rest = self.length - self.used
        self.data.clear()
        self.member, self.raw, rest = None, self.raw[rest:], rest - len(self.raw)
        while rest > 0:
            if not (got := self.stream.read(min(rest, 1 << 20))):
                raise EOFError("an archive ends within a gzip member")
            rest -= len(got)


def records(stream, wanted: Callable[[dict], bool], payloads: bool = True, chunk: int = 1 << 16) -> Iterator[dict]:
    """Records of one archive (gzip members, one gzip stream, or plain), in order; payloads only of wanted ones."""
    source = Bytes(stream, chunk)
    while True:
        source.at_start = False
        while True:  # line ends between records, up to the end of their member
            source.data = source.data.lstrip(b"\r\n")
            if source.data or (source.member is None and source.gz is not False) or not source.more(64):
                break
        fresh_member = not source.data and source.member is None
        text = source.until(b"\r\n\r\n")
        if text is None:
            return
        if not text.lstrip().startswith(b"WARC/"):
            raise ValueError("an archive holds bytes that are no record")
        head = parse_head(text.lstrip())
        row = fields(head)
        if not head.get("content-length", "").isdigit():
            raise ValueError("a record without a length")
        n, take = int(head["content-length"]), wanted(row)
        if take and payloads:
            yield row | {"payload": payload_of(row, head, source.take(n))}
        else:
            # a member that tells its length holds one record: so the writer makes them
            if fresh_member and source.at_start and source.member is not None and source.length is not None:
                source.skip_member()
            else:
                source.skip(n)
            if take:
                yield row | {"payload": None}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_partition = int(options.get("max_partition_bytes", 128 << 20))
        self.payloads = str(options.get("payloads", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in ("record_type", "record_id", "target_uri", "refers_to"):
                self.tests.append((name, "in", frozenset([f.value])))
            elif isinstance(f, In) and name in ("record_type", "record_id"):
                self.tests.append((name, "in", frozenset(f.value)))
            elif isinstance(f, StringStartsWith) and name in ("target_uri", "refers_to"):
                self.tests.append((name, "prefix", f.value))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(row[name] is not None and (row[name] in x if how == "in" else row[name].startswith(x)) for name, how, x in self.tests)

    def partitions(self) -> list[Files]:
        fs, base = filesystem(self.path)
        info = fs.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        hidden = lambda x: any(p.startswith(("_", ".")) for p in x.path[len(base) :].split("/"))
        found = sorted((x for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and not hidden(x)), key=lambda x: (-x.size, x.path))
        groups: list[Files] = []
        room = 0
        for x in found:
            if not groups or room < x.size:
                groups.append(Files([]))
                room = self.per_partition
            groups[-1].files.append(x.path)
            room -= x.size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        for name in partition.files:
            with fs.open_input_stream(name, compression=None) as stream:
                yield from batches(records(stream, self.wanted, self.payloads))


def batches(rows: Iterator[dict], most_rows: int = 2000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, pa.binary() if f.name == "payload" else pa.int64() if f.name == "payload_length" else pa.string()) for f in SCHEMA])
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"") + 200
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class WarcDataSource(DataSource):
    """Options: path; for reading max_partition_bytes and payloads (false: headers only); for writing roll_bytes and level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def read_warc_through_spark(spark: SparkSession, path: str) -> DataFrame:
    """Archives in a store that only Spark's own readers open; each file, below 2 GB, is read whole."""

    def parse(parts):
        import io

        for part in parts:
            for content in part.column(0):
                yield from batches(records(io.BytesIO(content.as_py()), lambda row: True))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, SCHEMA)


def archive_rows(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows for the archive writer: of equal payloads of at least ``least`` bytes only one is stored.

    The payload is the body in UTF-8 (null: empty). Within such a group the row with the smallest id is the response
    and the others revisit it; rows with a null id come last, and rows that repeat the smallest id are responses too. A
    group of null ids has responses only. Only digests and ids are aggregated, with partial sums before the exchange;
    the payloads are exchanged once, in a join whose skewed partitions Spark splits. Record ids are made of the row's id and
    its place in the input, so that repeated ids have records of their own; revisits refer to the first such record. (The
    input is read twice: it must give its rows in the same places both times, as files do.)
    """
    name = lambda c: F.concat(F.lit("urn:row:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.lpad(c.cast("string"), 19, "0"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("record_id", name(F.monotonically_increasing_id()))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first"), F.count("*").alias("n"))
    rows = rows.join(first.where("n > 1").select("payload_digest", "first_id", F.col("first.record_id").alias("first_record")), "payload_digest", "left")
    again = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return rows.select(
        "record_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, F.col("first_record")).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(rows: DataFrame, path: str, **options: str) -> None:
    rows.sparkSession.dataSource.register(WarcDataSource)
    rows.write.format("warc").mode("append").options(**options).save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page from the archives: a response's length and digest are taken from the payload as read."""
    row_id = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS bigint)")
    is_response = F.col("record_type") == "response"
    return read_warc(spark, path).where(F.col("record_type").isin("response", "revisit")).select(
        row_id("record_id").alias("page_id"),
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(is_response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        row_id("refers_to").alias("refers_to"),
    )
