"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

The ends of a text's A tokens and of its B tokens are two rising sequences; where they meet, the text is
cut into groups. Walking both at once is a merge, and a merge can be cut into pieces of equal work: a
binary search along each diagonal ``i + j = k * work`` finds how many A and B ends come before it. The
pieces of long texts are dealt out over tasks; each finds the meeting ends of its own and hands over the
groups between them, and what lies at its borders is stitched to the neighbours' borders into groups.

Groups link each of their A tokens with each of their B tokens. How many documents hold a pair of ids
linked is counted over all documents: distinct pairs of a document are counted up in the task and summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices
from lotline.llm.tokens import encoder, entry_bytes
from lotline.operators.skew import join_lookup
from lotline.storage import keep

#: Ends of both sides in a piece.
PIECE_WORK = 32_768
#: Pairs in two documents or more that are sent to all tasks (8 + 8 bytes each); more are joined.
SHARED_PAIRS = 3_000_000
#: Distinct pairs that a task counts up before it hands them over.
COUNTED_PAIRS = 1_000_000
#: A group of more links is counted by its distinct ids.
_PLAIN_LINKS = 4_096

_PIECES = "key bigint, doc_id bigint, piece int, pieces int, base_a bigint, base_b bigint, a binary, b binary"
_PARTS = "key bigint, doc_id bigint, place bigint, a binary, b binary"
_SCORES = "key bigint, doc_id bigint, place bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
_SHIFT = 32


def _stored(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


@dataclass(frozen=True)
class Vocabularies:
    """The bytes of all ids of both sides, and their lengths."""

    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def __post_init__(self) -> None:
        for name, table in (("a", self.a_bytes), ("b", self.b_bytes)):
            object.__setattr__(self, f"{name}_lengths", np.array([len(x) for x in table], np.int64))
            object.__setattr__(self, f"{name}_kind", _stored(len(table)))

    def ids(self, side: str, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, getattr(self, f"{side}_kind")).astype(np.int64)

    def ends(self, side: str, ids: np.ndarray, base: int = 0) -> np.ndarray:
        return base + np.cumsum(getattr(self, f"{side}_lengths")[ids])

    def pack(self, side: str, ids: np.ndarray) -> bytes:
        return ids.astype(getattr(self, f"{side}_kind")).tobytes()


@cache
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    model = _model(path_b)
    b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Vocabularies(entry_bytes(path_a), b)


def encoded(texts: list[str | None], path_a: str, path_b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The A and B ids of each text; none for a text whose bytes are not those of both sides."""
    tables, none = vocabularies(path_a, path_b), np.zeros(0, np.int64)
    plain = [t or "" for t in texts]
    raw_a = encoder(path_a, special=False).encode([f" {t}" if t else "" for t in plain])
    all_b = _model(path_b).encode(plain, num_threads=1)
    out = []
    for text, raw, b in zip(plain, raw_a, all_b, strict=True):
        a, whole = np.frombuffer(raw, "<u4").astype(np.int64), f" {text}".encode("utf-8", "surrogatepass")
        same = text and b"".join(map(tables.b_bytes.__getitem__, b)) == whole and b"".join(map(tables.a_bytes.__getitem__, a.tolist())) == whole
        out.append((a, np.array(b, np.int64)) if same else (none, none))
    return out


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """How many ends of ``a`` and ``b`` (rising) come before each border of pieces of ``work`` ends, first and last included.

    A binary search along the diagonal: of equal ends the one of ``a`` comes first, and a border never
    parts two equal ends.
    """
    cuts = [(0, 0)]
    for diagonal in range(work, len(a) + len(b), work):
        low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
        while low < high:
            middle = (low + high) // 2
            if a[middle] <= b[diagonal - middle - 1]:
                low = middle + 1
            else:
                high = middle
        i, j = low, diagonal - low
        if i and j < len(b) and a[i - 1] == b[j]:
            j += 1
        if (i, j) != cuts[-1]:
            cuts.append((i, j))
    if (len(a), len(b)) != cuts[-1]:
        cuts.append((len(a), len(b)))
    return cuts


def _pieces(docs: DataFrame, path_a: str, path_b: str, work: int) -> DataFrame:
    """Every row's ids in pieces of equal work; a row without tokens is one empty piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabularies(path_a, path_b)
        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows = []
            for doc_id, (a, b) in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), path_a, path_b), strict=True):
                ends_a, ends_b = tables.ends("a", a), tables.ends("b", b)
                cuts = diagonals(ends_a, ends_b, work)
                cuts = cuts if len(cuts) > 1 else [(0, 0), (0, 0)]
                for piece, ((i, j), (to_i, to_j)) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    base_a, base_b = int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0
                    rows.append((key, doc_id, piece, len(cuts) - 1, base_a, base_b, tables.pack("a", a[i:to_i]), tables.pack("b", b[j:to_j])))
                key += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["key", "doc_id", "piece", "pieces", "base_a", "base_b", "a", "b"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, _PIECES)


def _merged(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``_PARTS`` with ``kind``: the groups between a piece's meeting ends (``closed``) and its borders.

    ``head`` ends at the first meeting end, ``tail`` begins after the last one, ``whole`` has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabularies(path_a, path_b)
        for batch in slices(batches, 16):
            rows = []
            for r in batch.to_pylist():
                a, b = tables.ids("a", r["a"]), tables.ids("b", r["b"])
                ends_a, ends_b = tables.ends("a", a, r["base_a"]), tables.ends("b", b, r["base_b"])
                met = np.intersect1d(ends_a, ends_b, assume_unique=True)
                bounds = [("whole", None, None)] if not len(met) else [("head", None, met[0]), ("closed", met[0], met[-1]), ("tail", met[-1], None)]
                for kind, low, high in bounds:
                    sides = []
                    for ids, ends in ((a, ends_a), (b, ends_b)):
                        start = 0 if low is None else int(np.searchsorted(ends, low, "right"))
                        stop = len(ids) if high is None else int(np.searchsorted(ends, high, "right"))
                        sides.append(ids[start:stop])
                    if len(sides[0]) or len(sides[1]) or kind != "closed":
                        rows.append((r["key"], r["doc_id"], 2 * r["piece"] + 1, tables.pack("a", sides[0]), tables.pack("b", sides[1]), kind))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc_id", "place", "a", "b", "kind"])

    return pieces.mapInArrow(run, _PARTS + ", kind string")


def _stitched(borders: pa.Table) -> pa.Table:
    """The groups that cross borders of one text's pieces: a tail, whole pieces and the head that ends them."""
    rows = sorted(borders.to_pylist(), key=lambda r: (r["place"], r["kind"] == "tail"))
    out, place, a, b = [], 0, b"", b""
    for r in rows:
        if r["kind"] == "tail":
            place, a, b = r["place"] + 1, b"", b""
        a, b = a + r["a"], b + r["b"]
        if r["kind"] == "head":
            out.append({"key": r["key"], "doc_id": r["doc_id"], "place": place, "a": a, "b": b})
    return pa.Table.from_pylist(out, pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))


def parts(docs: DataFrame, path_a: str, path_b: str, work: int = PIECE_WORK) -> tuple[DataFrame, DataFrame]:
    """``key, doc_id, place, a, b``: texts in runs of whole groups; those of one run, and those of more."""
    pieces = keep(_pieces(docs, path_a, path_b, work))
    single = pieces.where("pieces = 1").select("key", "doc_id", F.col("piece").cast("bigint").alias("place"), "a", "b")
    cut = keep(_merged(pieces.where("pieces > 1").repartition("key", "piece"), path_a, path_b))
    borders = cut.where("kind <> 'closed'")
    stitched = borders.groupBy("key").applyInArrow(_stitched, _PARTS)
    return single, keep(cut.where("kind = 'closed'").drop("kind").union(stitched))


@dataclass
class Run:
    """The groups of a run of tokens that begins and ends with meeting ends."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int

    @classmethod
    def of(cls, tables: Vocabularies, a: np.ndarray, b: np.ndarray) -> Run:
        ends_a, ends_b = tables.ends("a", a), tables.ends("b", b)
        met = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return cls(a, b, np.searchsorted(met, ends_a), np.searchsorted(met, ends_b), len(met))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The distinct linked pairs as ``a << 32 | b``, how many links each has, and all links."""
        in_a, in_b = np.bincount(self.group_a, minlength=self.n_groups), np.bincount(self.group_b, minlength=self.n_groups)
        links = in_a * in_b
        small = links <= _PLAIN_LINKS
        keys, counts = [], []
        take = np.flatnonzero(small[self.group_a])
        each = in_b[self.group_a[take]]
        first = (np.cumsum(in_b) - in_b)[self.group_a[take]]
        # The B tokens of a group lie next to each other.
        partner = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        keys.append(np.repeat(self.a[take], each) << _SHIFT | self.b[partner])
        counts.append(np.ones(len(keys[0]), np.int64))
        for group in np.flatnonzero(~small):
            ids_a, times_a = np.unique(self.a[self.group_a == group], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.group_b == group], return_counts=True)
            keys.append((ids_a[:, None] << _SHIFT | ids_b).ravel())
            counts.append((times_a[:, None] * times_b).ravel())
        if len(keys) == 1:
            found, times = np.unique(keys[0], return_counts=True)
        else:
            found, where = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.zeros(len(found), np.int64)
            np.add.at(times, where, np.concatenate(counts))
        return found, times, int(links.sum())

    def text(self, names: list[str], ids: int) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``; ``names`` has each number followed by ``,``, by ``|`` and by ``;``."""
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        place = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])[order]
        after = np.append(place[1:], -1)
        sign = np.where(after == place, 0, np.where(place % 2 == 0, 1, 2))
        codes = np.concatenate([self.a, self.b])[order] + ids * sign
        return "".join(map(names.__getitem__, codes.tolist()))[:-1]


def _runs(batch: pa.RecordBatch, tables: Vocabularies) -> Iterator[Run]:
    for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
        yield Run.of(tables, tables.ids("a", a), tables.ids("b", b))


def _task_counts(single: DataFrame, path_a: str, path_b: str, most: int) -> DataFrame:
    """``pair, n`` in how many of the task's texts, counted up in memory of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabularies(path_a, path_b)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            found, where = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
            old = np.bincount(where[: len(pairs)], counts, len(found)).astype(np.int64)
            return found, old + np.bincount(where[len(pairs) :], minlength=len(found))

        for batch in slices(batches):
            for found in _runs(batch, tables):
                waiting.append(found.pairs()[0])
                size += len(waiting[-1])
            if size > most:
                pairs, counts = add_up()
                waiting, size = [], 0
                if len(pairs) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = add_up()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return single.select("a", "b").mapInArrow(run, "pair bigint, n bigint")


def _pairs_of(runs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``key, pair, times``: the distinct linked pairs of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabularies(path_a, path_b)
        for batch in slices(batches):
            for key, found in zip(batch.column("key").to_pylist(), _runs(batch, tables), strict=True):
                pairs, times, _ = found.pairs()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key)), pa.array(pairs), pa.array(times)], ["key", "pair", "times"])

    return runs.select("key", "a", "b").mapInArrow(run, "key bigint, pair bigint, times bigint")


def pair_counts(single: DataFrame, several: DataFrame, path_a: str, path_b: str, counted: int = COUNTED_PAIRS) -> DataFrame:
    """``pair, n``: in how many documents each pair of ids (``a << 32 | b``) is linked."""
    long_ones = _pairs_of(several, path_a, path_b).select("key", "pair").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    each = _task_counts(single, path_a, path_b, counted).union(long_ones)
    return each.groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(runs: DataFrame, path_a: str, path_b: str, shared, hashed: bool) -> DataFrame:  # noqa: ANN001
    """``_SCORES`` of each run; ``shared`` has pairs, counts and the highest count by A id, or is None.

    ``hashed``: a run is a whole text, and ``groups`` the digest of its groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabularies(path_a, path_b)
        ids = max(len(tables.a_bytes), len(tables.b_bytes))
        names = [f"{i}{sign}" for sign in ",|;" for i in range(ids)]
        known, counts, best = shared.value if shared else (None, None, None)
        for batch in slices(batches):
            rows = []
            for found in _runs(batch, tables):
                pairs, times, links = found.pairs()
                n_best = count_sum = 0
                if shared and len(pairs):
                    at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                    n = np.where(known[at] == pairs, counts[at], 1) if len(known) else np.ones(len(pairs), np.int64)
                    n_best, count_sum = int(times[n == best[pairs >> _SHIFT]].sum()), int((n * times).sum())
                text = found.text(names, ids)
                if hashed:
                    text = hashlib.sha256(text.encode()).hexdigest() if text else ""
                rows.append((len(found.a), len(found.b), found.n_groups, links, n_best, count_sum, text))
            numbers = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:6]]
            columns = [batch.column(c) for c in ("key", "doc_id", "place")] + numbers + [pa.array([r[6] for r in rows])]
            names_of = ["key", "doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
            yield pa.RecordBatch.from_arrays(columns, names_of)

    return runs.mapInArrow(run, _SCORES)


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    work: int = PIECE_WORK,
    shared_pairs: int = SHARED_PAIRS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, applied to the text after a space, and
    ``path_b`` a sentencepiece model, which adds the space; strings of special tokens are text. A text that
    is null or empty, or that a side does not give back byte by byte, has no tokens: zeros and ''. Rows that
    repeat are documents each, a null id stays null, other columns are not read, and no rows give no rows.

    Counts of pairs in two documents or more go to all tasks if there are at most ``shared_pairs`` of them;
    beyond that the documents' pairs are joined with them. A pair that is in no list counts once.
    """
    spark = ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    single, several = parts(chosen, path_a, path_b, work)
    counted = keep(pair_counts(single, several, path_a, path_b).where("n > 1"))
    highest = counted.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("n").alias("best"))
    if counted.count() <= shared_pairs:
        table = counted.toArrow().sort_by("pair").combine_chunks()
        best = np.ones(len(vocabularies(path_a, path_b).a_bytes), np.int64)
        # One number for each id of the vocabulary.
        for r in highest.collect():
            best[r.a] = r.best
        shared = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), best))
        whole, cut = _scored(single, path_a, path_b, shared, True), _scored(several, path_a, path_b, shared, False)
    else:
        whole, cut = (_joined(_scored(runs, path_a, path_b, None, hashed), _pairs_of(runs, path_a, path_b), counted, highest) for runs, hashed in ((single, True), (several, False)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "groups"))), lambda x: x["groups"])
    summed = [F.sum(c).alias(c) for c in _SUMS]
    stitched = cut.groupBy("key").agg(F.first("doc_id").alias("doc_id"), *summed, F.sha2(F.array_join(ordered, ";"), 256).alias("groups"))
    columns = ["doc_id", *_SUMS, F.col("groups").alias("groups_sha256")]
    return whole.select(*columns).union(stitched.select(*columns))


def _joined(runs: DataFrame, pairs: DataFrame, counted: DataFrame, highest: DataFrame) -> DataFrame:
    """``runs`` with ``n_best`` and ``count_sum`` from a join of their pairs with the counts."""
    own = pairs.withColumn("a", F.shiftright("pair", _SHIFT))
    known = join_lookup(own, counted, ["pair"], "left")
    rated = join_lookup(known, highest, ["a"], "left").select(
        "key", "times", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("best", F.lit(1)).alias("best")
    )
    sums = rated.groupBy("key").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    # A text of several runs gets its sums once, at its first run.
    first = runs.groupBy("key").agg(F.min("place").alias("place")).join(sums, "key").select("key", "place", "n_best", "count_sum")
    both = runs.drop("n_best", "count_sum").join(first, ["key", "place"], "left")
    return both.select(*[c for c in runs.columns if c not in ("n_best", "count_sum", "groups")], F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")
