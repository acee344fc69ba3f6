"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Every record is a gzip member of its own, so a file can be read from any member on. Members that this
source writes carry their length in the gzip header, and records that a filter turns away are skipped
after their headers without inflating the payload; members of other writers are inflated to find the
next one. Files larger than ``splitBytes`` are read in ranges, small ones are put together.
Uncompressed ``.warc`` files are read too, one task each, with payloads skipped by seeking.

Equality, ``IN`` and null filters on ``record_type``, ``record_id``, ``target_uri``, ``refers_to_record``,
``page_id`` and ``payload_digest`` are decided on the headers if
``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from lotline.llm.common import ship, slices
from lotline.operators.skew import join_lookup
from lotline.storage import new_folder

FORMAT = "warc"
#: A new file begins when one has so many bytes.
ROLL_BYTES = 64 << 20
#: Input files are split and put together to about this size.
SPLIT_BYTES = 64 << 20
#: Payload bytes in an output batch.
_BATCH_BYTES = 8 << 20
_HEAD_BYTES = 4096
_MANIFEST = "_files.json"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("page_id", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to_record", pa.string()),
        ("payload", pa.binary()),
    ]
)
_DDL = (
    "record_id string, record_type string, target_uri string, page_id bigint, payload_digest string, "
    "refers_to_record string, payload binary"
)


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, in whichever task it is made."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{digest}')}"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record(row: dict, date: str) -> bytes:
    """The bytes of one record: WARC headers, HTTP headers and, unless it is a revisit, the payload."""
    payload, revisit = row["payload"] or b"", row["refers_to_page"] is not None
    digest = base32_sha1(bytes.fromhex(row["sha1"]))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(row['page_id'], digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        head.insert(4, "WARC-Target-URI: " + urllib.parse.quote(row["url"], safe="%:/?#[]@!$&'()*+,;=-._~"))
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(row['refers_to_page'], digest)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member whose header has its own length and that of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(raw) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str) -> None:
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        task, names, out, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for batch in slices(iterator):
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{task:06d}-{len(names):04d}-{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    raw = member(record(row, self.date))
                    out.write(raw)
                    size += len(raw)
                    if size >= ROLL_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{_MANIFEST}") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest the files of tasks that ended would count."""
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else []:
                files.delete_file(f"{root}/{name}")


@dataclass
class Ranges(InputPartition):
    """File name, first byte and the byte before which a record has to begin."""

    parts: list[tuple[str, int, int]]


_HEADER_FIELDS = {"record_type", "record_id", "target_uri", "refers_to_record", "page_id", "payload_digest"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.payloads = options.get("payload", "true").lower() == "true"
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull) and f.attribute[0] in _HEADER_FIELDS:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        listed = files.get_file_info(fs.FileSelector(root, recursive=False))
        sizes = {i.base_name: i.size for i in listed if i.type == fs.FileType.File}
        if _MANIFEST in sizes:
            with files.open_input_file(f"{root}/{_MANIFEST}") as f:
                sizes = {n: sizes[n] for n in json.loads(f.read())}
        found: list[Ranges] = []
        room = 0
        for name in sorted(n for n in sizes if n.endswith((".warc", ".warc.gz"))):
            step = self.split if name.endswith(".gz") else sizes[name]
            for start in range(0, sizes[name], max(step, 1)):
                end = min(start + step, sizes[name])
                if not found or room < end - start:
                    found.append(Ranges([]))
                    room = self.split
                found[-1].parts.append((name, start, end))
                room -= end - start
        return found or [Ranges([])]

    def keeps(self, row: dict) -> bool:
        for f in self.wanted:
            value = row[f.attribute[0]]
            if isinstance(f, EqualTo):
                ok = value is not None and value == f.value
            elif isinstance(f, EqualNullSafe):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value is not None and value in f.value
            else:
                ok = (value is None) == isinstance(f, IsNull)
            if not ok:
                return False
        return True

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        size = 0
        for name, start, end in partition.parts:
            with files.open_input_file(f"{root}/{name}") as raw:
                stream = io.BufferedReader(raw, 1 << 20)
                records = gzip_records(stream, start, end) if name.endswith(".gz") else plain_records(stream, end)
                for row, payload in records:
                    if not self.keeps(row):
                        continue
                    row["payload"] = payload() if self.payloads else None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def parsed(head: bytes) -> tuple[dict, int]:
    """The columns that the headers of a record give, and the length of its block."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"Not a WARC record: {lines[0][:60]!r}")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if colon:
            fields[key.strip().lower()] = value.strip()
    page, digest = fields.get("x-page-id"), fields.get("warc-payload-digest")
    row = {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "page_id": int(page) if page and page.lstrip("-").isdigit() else None,
        "payload_digest": digest.rpartition(":")[2] if digest else None,
        "refers_to_record": fields.get("warc-refers-to", "").strip("<>") or None,
    }
    return row, int(fields["content-length"])


def payload_of(row: dict, block: bytes) -> bytes | None:
    """What follows the HTTP headers of a block; checked against the digest. Revisits have none."""
    if row["record_type"] != "response":
        return None if row["record_type"] == "revisit" else block
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    known = row["payload_digest"]
    if known and len(known) == 32 and base32_sha1(hashlib.sha1(payload).digest()) != known:
        raise ValueError(f"The payload of {row['record_id']} does not have its digest")
    return payload


def plain_records(stream: io.BufferedReader, end: int) -> Iterator[tuple[dict, object]]:
    at = 0
    while at < end:
        stream.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = stream.read(_HEAD_BYTES)
            if not more:
                if head.strip():
                    raise ValueError("A record is cut off")
                return
            head += more
        top = head.lstrip(b"\r\n")
        begin = at + len(head) - len(top)
        top = top.partition(b"\r\n\r\n")[0]
        row, length = parsed(top)
        block_at = begin + len(top) + 4

        def payload(row: dict = row, block_at: int = block_at, length: int = length) -> bytes | None:
            stream.seek(block_at)
            return payload_of(row, stream.read(length))

        yield row, payload
        at = block_at + length + 4


def _member_start(stream: io.BufferedReader, start: int, end: int) -> int:
    """Where the first member at or after a byte begins."""
    at, tail = start, b""
    while at < end:
        stream.seek(at)
        tail = stream.read(1 << 20)
        if not tail:
            return end
        k = tail.find(b"\x1f\x8b\x08")
        while k >= 0 and at + k < end:
            stream.seek(at + k)
            try:
                if zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(stream.read(_HEAD_BYTES), 5) == b"WARC/":
                    return at + k
            except zlib.error:
                pass
            k = tail.find(b"\x1f\x8b\x08", k + 1)
        at += max(len(tail) - 2, 1)
    return end


def gzip_records(stream: io.BufferedReader, start: int, end: int) -> Iterator[tuple[dict, object]]:
    """Records of the members that begin in ``start..end``: headers, and a function that inflates the payload."""
    at = _member_start(stream, start, end) if start else 0
    while at < end:
        stream.seek(at)
        first = stream.read(_HEAD_BYTES)
        if not first:
            return
        state = {"inflate": zlib.decompressobj(zlib.MAX_WBITS | 16), "data": bytearray(), "input": first, "at": at + len(first)}

        def more(most: int, state: dict = state) -> bool:
            """Inflate a bit further; false at the end of the member."""
            inflate = state["inflate"]
            if inflate.eof:
                return False
            raw = state["input"] or inflate.unconsumed_tail
            if not raw:
                stream.seek(state["at"])
                raw = stream.read(1 << 16)
                state["at"] += len(raw)
                if not raw:
                    raise ValueError("A gzip member is cut off")
            state["input"] = b""
            state["data"] += inflate.decompress(raw, most)
            return True

        while b"\r\n\r\n" not in state["data"] and more(_HEAD_BYTES):
            pass
        top, _, _ = bytes(state["data"]).partition(b"\r\n\r\n")
        row, length = parsed(top)

        def payload(row: dict = row, top: bytes = top, length: int = length, more=more, state: dict = state) -> bytes | None:  # noqa: ANN001
            need = len(top) + 4 + length
            while len(state["data"]) < need and more(need - len(state["data"])):
                pass
            return payload_of(row, bytes(state["data"][len(top) + 4 : need]))

        yield row, payload
        size = _member_length(first)
        if size is None:
            while more(1 << 20):
                state["data"].clear()
            size = state["at"] - len(state["inflate"].unused_data) - at
        at += size


def _member_length(head: bytes) -> int | None:
    """The length of a member by its header's extra field, if it has it."""
    if head[3] & 4:
        (n,) = struct.unpack_from("<H", head, 10)
        at = 12
        while at + 4 <= 12 + n <= len(head):
            name, (size,) = head[at : at + 2], struct.unpack_from("<H", head, at + 2)
            if name == b"sl" and size == 8:
                return struct.unpack_from("<I", head, at + 4)[0]
            at += 4 + size
    return None


class WarcSource(DataSource):
    """Options: ``path``; reading: ``splitBytes``, ``payload`` (``false``: leave payloads out); writing: ``date``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> SparkSession:
    ship(spark).dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row. Of equal payloads, the row with the smallest id is a response and the
    others revisit it; they are found by SHA-1.

    A null html is an empty payload, a null id never is the smallest. Rows that repeat the smallest id
    are responses each; if all ids of equal payloads are null, all are responses.
    """
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    joined = join_lookup(rows, first.select("sha1", "first"), ["sha1"], "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    joined.select(
        "page_id",
        "url",
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        "sha1",
        refers.alias("refers_to_page"),
    ).write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return register(spark).read.format(FORMAT).options(**options).load(path)


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the responses and revisits of a folder.

    The bytes of a revisit's payload are those of the response that it refers to.
    """
    responses = read(spark, path).where(F.col("record_type") == "response")
    sized = responses.select("record_id", "page_id", F.length("payload").cast("bigint").alias("payload_bytes"), "payload_digest")
    revisits = read(spark, path, payload="false").where(F.col("record_type") == "revisit")
    lookup = sized.groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    named = revisits.select("page_id", "payload_digest", F.col("refers_to_record").alias("record_id"))
    again = join_lookup(named, lookup, ["record_id"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = sized.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("bigint")})
    return own.select(columns).union(again.withColumn("record_type", F.lit("revisit")).select(columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to a new folder below the shared one and read back from there; see ``pages_of``.

    An empty table gives no rows; columns other than ``page_id``, ``url`` and ``html`` are not read.
    """
    path = new_folder(pages.sparkSession, FORMAT)
    write_pages(pages, path)
    return pages_of(pages.sparkSession, path)
