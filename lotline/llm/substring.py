"""Removal of passages that occur earlier, by seed and extend on winnowed anchors.

Of every ``length`` words in a row one run of ``ANCHOR`` words is the anchor: that with the smallest
hash, the last of ties. Equal passages have equal anchors at equal places, so joining documents on
anchors finds every passage of ``length`` words that occurs twice. An anchor extends both ways to a
segment: all passages that it is the anchor of. Segments that are equal as a whole need no look at
their words; only where an anchor has different segments, at the ends of a repeat, are the passages
themselves compared. Passages that are removed overlap to maximal repeats.

Words and runs of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices, words
from lotline.operators.skew import join_lookup
from lotline.storage import keep

#: Words of an anchor. Longer ones are rarer by chance, shorter ones are fewer.
ANCHOR = 7
#: Passages whose smallest anchor is looked for at a time.
_CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any run of words of a text."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.n = len(tokens)
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * _powers(_BASE, self.n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


def segments(h: Hashes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage, number of passages and anchor hash of each segment of a text, in order."""
    n = h.n - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    places = np.arange(h.n - ANCHOR + 1)
    grams = h.of(places, places + ANCHOR)
    span = length - ANCHOR + 1
    chosen = np.empty(n, np.int64)
    for start in range(0, n, _CHUNK):
        part = grams[start : min(start + _CHUNK, n) + span - 1]
        view = np.lib.stride_tricks.sliding_window_view(part[::-1], span)
        chosen[start : start + _CHUNK] = start + len(part) - 1 - (view.argmin(axis=1) + np.arange(len(view)))[::-1]
    firsts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    counts = np.diff(np.concatenate([firsts, [n]]))
    return firsts, counts, grams[chosen[firsts]]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tie"),
        F.col(text_col).cast("string").alias("text"),
    )


def _all_segments(docs: DataFrame, length: int) -> DataFrame:
    names = ["anchor", "segment", "doc_id", "tie", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for doc_id, tie, text in rows:
                if doc_id is None:
                    continue
                h = Hashes(words(text))
                firsts, counts, anchors = segments(h, length)
                whole = h.of(firsts, firsts + counts + length - 1) if len(firsts) else anchors
                columns = [anchors.view(np.int64), whole.view(np.int64), np.full(len(firsts), doc_id), np.full(len(firsts), tie)]
                for part, column in zip(parts, [*columns, firsts.astype(np.int32), counts.astype(np.int32)], strict=True):
                    part.append(column)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names)

    return docs.mapInArrow(run, "anchor bigint, segment bigint, doc_id bigint, tie bigint, start int, n int")


def _passages(joined: DataFrame, length: int) -> DataFrame:
    """``passage, doc_id, tie, start`` of the segments that are listed with each document."""
    names = ["passage", "doc_id", "tie", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for i in range(batch.num_rows):
                listed = batch.column(3)[i].as_py()
                if not listed:
                    continue
                h = Hashes(words(batch.column(2)[i].as_py()))
                starts = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in listed])
                ids = [np.full(len(starts), batch.column(k)[i].as_py()) for k in (0, 1)]
                columns = [h.of(starts, starts + length).view(np.int64), *ids, starts.astype(np.int32)]
                for part, column in zip(parts, columns, strict=True):
                    part.append(column)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names)

    return joined.mapInArrow(run, "passage bigint, doc_id bigint, tie bigint, start int")


def _by_document(rows: DataFrame) -> DataFrame:
    """The ``start, n`` of each document in a list, which is never longer than the document."""
    return rows.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "n")).alias("listed"))


def _kept(joined: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, totals, removed = [], [], []
            for text, listed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tokens = words(text)
                marks = np.zeros(len(tokens) + 1, np.int64)
                if listed:
                    np.add.at(marks, [s["start"] for s in listed], 1)
                    np.add.at(marks, [s["start"] + s["n"] + length - 1 for s in listed], -1)
                stay = np.cumsum(marks[:-1]) == 0
                kept = [w for w, s in zip(tokens, stay.tolist(), strict=True) if s] if listed else tokens
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                totals.append(len(tokens))
                removed.append(len(tokens) - len(kept))
            columns = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``, one row per row of ``docs``.

    A word is removed if a passage of ``length`` words around it also starts earlier, in a document
    with a smaller id or in the same one; passages are judged in the texts as given. ``kept_text`` has
    the other words, one space between two. Null and empty texts have no word. Rows with the same id
    and text are one document; different texts under one id are ordered by a hash of the text. A null
    id has no place in the order: its row is kept whole and nothing is removed because of it. Empty
    tables give no rows; other columns are not read.
    """
    if length <= ANCHOR:
        raise ValueError(f"Passages need more than {ANCHOR} words")
    ship(docs.sparkSession)
    texts = _documents(docs, id_col, text_col)
    every = _all_segments(texts, length)
    often = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    seeds = keep(join_lookup(every, often, ["anchor"]))
    place = F.struct("doc_id", "tie", "start")
    first = keep(seeds.groupBy("segment", "anchor", "n").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")))
    again = join_lookup(seeds, first.where("c > 1").select("segment", "anchor", "n", "first"), ["segment", "anchor", "n"])
    repeated = again.where(place != F.col("first")).select("doc_id", "tie", "start", "n")
    varied = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("anchor")
    ends = join_lookup(first.select("anchor", "first.*", "n"), varied, ["anchor"])
    passages = keep(_passages(texts.join(_by_document(ends), ["doc_id", "tie"], "left"), length))
    earliest = passages.groupBy("passage").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = join_lookup(passages, earliest.select("passage", "first"), ["passage"]).where(place != F.col("first"))
    removed = repeated.union(later.select("doc_id", "tie", "start", F.lit(1).alias("n")))
    return _kept(texts.join(_by_document(removed), ["doc_id", "tie"], "left"), length)
