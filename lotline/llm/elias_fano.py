"""A file format for token ids: one concatenated array, with document boundaries in Elias-Fano code.

A non-decreasing sequence of ``n`` numbers up to ``u`` takes about ``2 + log2(u / n)`` bits a number: the
low bits as they are, the high bits in unary as a bit map. ``select`` finds a number by a sampled bit
position and a count of bits from there, and a range of numbers from the bits that it covers, so no
table of 64-bit offsets is kept, neither on disk nor by readers.

The Spark data source ``tokens_ef`` writes one file per task and reads them back. Files go to the
folder by way of a name of their own; the manifest, written when all tasks are done, names those that
count, so that repeated and lost tasks leave no trace in what is read.
"""

from __future__ import annotations

import json
import struct
import uuid
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from lotline.llm.common import ship, slices
from lotline.llm.tokens import encoder
from lotline.storage import new_folder

FORMAT = "tokens_ef"
MAGIC = b"TOKENSEF"
#: Every so many numbers, the position of the high bit is stored.
SAMPLE = 512
#: Bytes of ids that are read at a time.
READ_BYTES = 8 << 20
#: Documents whose boundaries are read at a time.
READ_DOCUMENTS = 16_384
_CHUNK = 1 << 16


class EliasFano:
    """A non-decreasing sequence of integers of up to 63 bits."""

    def __init__(self, n: int, first: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.first, self.low_bits, self.low, self.high, self.samples = n, first, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, 0, b"", b"", np.zeros(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("The numbers must not decrease")
        first = int(values[0])
        if int(values[-1]) - first >> 63:
            raise ValueError("The numbers span more than 63 bits")
        rest = (values - first).astype(np.uint64)
        low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, first, low_bits, _pack(rest, low_bits), np.packbits(bits).tobytes(), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Number ``i``, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position, seen = int(self.samples[i // SAMPLE]), i // SAMPLE * SAMPLE
        byte = position // 8
        current = self.high[byte] & (0xFF >> position % 8)
        while seen + current.bit_count() <= i:
            seen += current.bit_count()
            byte += 1
            current = self.high[byte]
        for bit in range(8):
            if current >> (7 - bit) & 1:
                if seen == i:
                    break
                seen += 1
        high = byte * 8 + bit - i
        return self.first + (high << self.low_bits | self._low(i))

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Numbers ``i`` to ``j - 1``: bits are read from the sampled one before ``i`` to the one after ``j``, no others."""
        i, j = max(i, 0), min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        first, after = i // SAMPLE, (j - 1) // SAMPLE + 1
        position = int(self.samples[first])
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, end - position // 8, position // 8))
        bits[: position % 8] = 0
        ones = np.flatnonzero(bits)[i - first * SAMPLE : j - first * SAMPLE] + position // 8 * 8
        high = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        start, stop = i * self.low_bits, j * self.low_bits
        low = np.unpackbits(np.frombuffer(self.low[start // 8 : (stop + 7) // 8], np.uint8))[start % 8 : start % 8 + stop - start]
        full = np.zeros((j - i, 64), np.uint8)
        full[:, 64 - self.low_bits :] = low.reshape(j - i, self.low_bits)
        return (high | np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)).astype(np.int64) + self.first

    def _low(self, i: int) -> int:
        start, end = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[start // 8 : (end + 7) // 8], "big")
        return word >> (-end % 8) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | _unpack(self.low, self.n, self.low_bits)).astype(np.int64) + self.first

    def to_bytes(self) -> bytes:
        head = struct.pack("<QqBQQ", self.n, self.first, self.low_bits, len(self.low), len(self.high))
        return head + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, first, low_bits, low, high = struct.unpack_from("<QqBQQ", raw)
        at = struct.calcsize("<QqBQQ")
        return cls(
            n, first, low_bits, raw[at : at + low], raw[at + low : at + low + high], np.frombuffer(raw, "<u4", offset=at + low + high)
        )


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each number, one after the other."""
    out, rest = [], np.zeros(0, np.uint8)
    for start in range(0, len(values) if width else 0, _CHUNK):
        raw = values[start : start + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.concatenate([rest, np.unpackbits(raw, axis=1)[:, 64 - width :].ravel()])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    return b"".join([*out, np.packbits(rest).tobytes()])


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if width:
        packed = np.frombuffer(raw, np.uint8)
        for start in range(0, n, _CHUNK):  # _CHUNK numbers end on a byte
            count = min(_CHUNK, n - start)
            bits = np.unpackbits(packed[start * width // 8 :][: (count * width + 7) // 8])[: count * width].reshape(-1, width)
            full = np.zeros((count, 64), np.uint8)
            full[:, 64 - width :] = bits
            out[start : start + count] = np.packbits(full, axis=1).view(">u8").ravel()
    return out


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str
    documents: int
    tokens: int


class TokensWriter(DataSourceArrowWriter):
    """Takes ``doc_id, ids`` in the order to keep; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, id_bytes: int, overwrite: bool) -> None:
        self.path, self.id_bytes, self.overwrite = path, id_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}-{uuid.uuid4().hex}.tok"
        # Eight bytes a document, until the file is whole.
        ids, ends, nulls, total = array("q"), array("q"), 0, 0
        kind = np.dtype(f"<u{self.id_bytes}")
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    values = np.frombuffer(raw or b"", "<u4")
                    if len(values) and int(values.max()) >> 8 * self.id_bytes:
                        raise ValueError(f"An id does not fit {self.id_bytes} bytes")
                    out.write(values.astype(kind).tobytes())
                    total += len(values)
                    ends.append(total)
                    if doc_id is None:
                        nulls += 1
                    else:
                        ids.append(doc_id)
            parts = [EliasFano.of(np.array(x, np.int64)).to_bytes() for x in (ids, ends)]
            for part in parts:
                out.write(part)
            head = {"id_bytes": self.id_bytes, "null_ids": nulls, "tokens": total, "parts": [len(p) for p in parts]}
            foot = json.dumps(head).encode()
            out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        return Written(task, name, len(ends), total)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        done = sorted((m for m in messages if m and m.documents), key=lambda m: m.task)
        rows = [{"file": m.name, "documents": m.documents, "tokens": m.tokens} for m in done]
        with files.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(rows).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest nothing is read; files of tasks that ended are removed."""
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{root}/{m.name}")


@dataclass
class Shard(InputPartition):
    name: str
    start: int


class TokensReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(f"{root}/manifest.json") as f:
            rows = json.loads(f.read())
        starts = np.cumsum([0, *(r["tokens"] for r in rows)])
        return [Shard(r["file"], int(s)) for r, s in zip(rows, starts, strict=False)] or [Shard("", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition.name:
            files, root = fs.FileSystem.from_uri(self.path)
            with files.open_input_file(f"{root}/{partition.name}") as f:
                yield from read_file(f, partition.start)


def boundaries(f: pa.NativeFile) -> tuple[dict, EliasFano, EliasFano]:
    """The head of an open file, its document ids (those that are not null) and the ends of its documents."""
    size = f.size()
    f.seek(size - 12)
    length, magic = struct.unpack("<I8s", f.read(12))
    if magic != MAGIC:
        raise ValueError("Not a file of token ids")
    f.seek(size - 12 - length)
    head = json.loads(f.read(length))
    f.seek(head["tokens"] * head["id_bytes"])
    ids, ends = (EliasFano.from_bytes(f.read(n)) for n in head["parts"])
    return head, ids, ends


def read_file(f: pa.NativeFile, start: int = 0) -> Iterator[pa.RecordBatch]:
    """``doc_id, start, n_tokens, ids`` of one file's documents; ``start`` is what comes before the file."""
    head, ids, ends = boundaries(f)
    width, nulls = head["id_bytes"], head["null_ids"]
    k = at = 0
    while k < ends.n:
        # The boundaries of a bounded number of documents, and of those as many as READ_BYTES hold.
        stops = ends.select_range(k, k + READ_DOCUMENTS)
        stops = stops[: max(1, int(np.searchsorted(stops, at + READ_BYTES // width, "right")))]
        until = k + len(stops)
        f.seek(at * width)
        values = np.frombuffer(f.read((int(stops[-1]) - at) * width), f"<u{width}").astype("<u4")
        cuts = np.concatenate([[at], stops])
        offsets = pa.py_buffer(((cuts - at) * 4).astype("<i8").tobytes())
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, offsets, pa.py_buffer(values.tobytes())])
        without = min(max(nulls - k, 0), len(stops))
        doc_ids = pa.concat_arrays([pa.nulls(without, pa.int64()), pa.array(ids.select_range(k - nulls, until - nulls))])
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + cuts[:-1]), pa.array(np.diff(cuts)), binary.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
        k, at = until, int(stops[-1])


def document(f: pa.NativeFile, i: int) -> np.ndarray:
    """The ids of document ``i`` of an open file, found by ``select`` alone."""
    head, _, ends = boundaries(f)
    begin, end = ends.select(i - 1) if i else 0, ends.select(i)
    f.seek(begin * head["id_bytes"])
    return np.frombuffer(f.read((end - begin) * head["id_bytes"]), f"<u{head['id_bytes']}")


class TokensSource(DataSource):
    """Options: ``path`` and, for writing, ``id_bytes`` (2 or 4, 4 if not given)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def writer(self, schema, overwrite: bool) -> TokensWriter:  # noqa: ANN001
        return TokensWriter(self.options["path"], int(self.options.get("id_bytes", 4)), overwrite)

    def reader(self, schema) -> TokensReader:  # noqa: ANN001
        return TokensReader(self.options["path"])


def encoded(
    docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` in ascending order of the id, nulls first, in partitions of that order.

    The order of rows with equal ids is by a hash of the text. A null text counts as empty, and every
    document gets ``end_id`` at its end.
    """
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in slices(batches):
            ids = [raw + end for raw in encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    chosen = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    ordered = chosen.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def write(tokens: DataFrame, path: str, id_bytes: int = 4) -> None:
    """Write ``doc_id, ids``, in the order of its partitions and rows, to a folder that is not there yet."""
    spark = ship(tokens.sparkSession)
    spark.dataSource.register(TokensSource)
    tokens.select("doc_id", "ids").write.format(FORMAT).option("id_bytes", id_bytes).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a folder; ``start`` counts the ids of all documents before."""
    ship(spark).dataSource.register(TokensSource)
    return spark.read.format(FORMAT).load(path)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, id_bytes: int = 2) -> DataFrame:
    """``docs`` encoded, written to a new folder below the shared one, and read back from there.

    An empty table gives an empty manifest and no rows. Rows that repeat are documents each; columns
    other than ``doc_id`` and ``text`` are not read.
    """
    path = new_folder(docs.sparkSession, FORMAT)
    write(encoded(docs, vocabulary, end_id), path, id_bytes)
    return read(docs.sparkSession, path)
