"""Near copies by Jaccard similarity of shingle sets: MinHash bands propose, the sets decide.

Texts with equal sets are one node. Two nodes meet if all ``ROWS`` minima of one of the ``BANDS`` bands
agree; with similarity ``s`` that fails with a chance of ``(1 - s ** ROWS) ** BANDS``, 0.002 at 0.8.

A bucket of nodes that meet is not paired out. First each node is compared with the bucket's smallest
one, which makes one component of most buckets of copies. The nodes of the other buckets are split by
further keys: with the shingles of a set in order of rarity, two sets of a similarity of ``t`` share one
within the first ``(1 - t)`` of each, and its place bounds what they can share at all. Shingles that no
other such node has are counted but need no key, so nodes that share a passage and little else have no
key in common. That loses no pair; only pairs from different components that pass these bounds are
compared, on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import components, ship, slices, words
from lotline.operators.skew import join_lookup
from lotline.storage import keep

SHINGLE = 5
LEAST_SIMILARITY = 0.8
BANDS = 16
ROWS = 5
#: Hashes that the minima are taken of at a time.
_CHUNK = 1_024

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_random = np.random.Generator(np.random.PCG64(42))
_XOR = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of ``shingle`` words, ASCII letters in lower case; a
    shorter text is one run, a text without a word has none."""
    tokens = words(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")) if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(min(shingle, len(tokens)))), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for the minima of each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[None, start : start + _CHUNK] ^ _XOR) * _TIMES).min(axis=1))
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in raw], np.uint64).view(np.int64)


def _signed_texts(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, content, node, bands`` of every row; ``node`` is the same for equal shingle sets, ``content`` for equal texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes), keys], ["doc_id", "content", "node", "bands"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, content bigint, node bigint, bands array<bigint>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, grams`` of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams = [shingles(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, grams array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a similarity of at least ``least``."""
    distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = join_lookup(distinct, sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), ["a"])
    both = join_lookup(first, sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), ["b"])
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("of"))
    return shared.where(F.col("n") >= F.lit(least) * (F.col("of") - F.col("n"))).select("a", "b")


def _bounds(x: str, y: str, least: float) -> Column:
    """Whether sets that share their shingles at ``pos`` and after it can be similar enough; ``x`` is the smaller one."""
    size_x, size_y = F.col(f"{x}.size"), F.col(f"{y}.size")
    shared = F.least(size_x - F.col(f"{x}.pos"), size_y - F.col(f"{y}.pos"))
    # A little less than the bound, so that rounding loses nothing.
    return (size_x >= F.lit(least) * size_y - 1e-6) & (shared >= F.lit(least / (1 + least)) * (size_x + size_y) - 1e-6)


def prefix_keys(sets: DataFrame, least: float) -> DataFrame:
    """``gram, node, pos, size``: the shingles that a similar set must share one of, by rarity among ``sets``.

    ``pos`` is the place of the shingle in its set. Shingles of one set only come first and are left out.
    """
    grams = sets.select("node", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = join_lookup(grams, common, ["gram"]).groupBy("node").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("shared")
    )
    alone = F.col("size") - F.size("shared")
    first = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-6) + 1 - alone
    chosen = shared.where(first > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("shared", 1, first.cast("int"))).alias("k", "s"))
    return chosen.select("s.gram", "node", (F.col("alone") + F.col("k")).alias("pos"), "size")


def _split(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """The keys with their nodes' components, of those shingles that nodes of several components have."""
    named = join_lookup(keys, parts, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("pos", "node", "size", "component")).alias("centre"))
    return keep(join_lookup(named, several.where("low < high").select("gram", "centre"), ["gram"]))


def _to_centres(split: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes with the one that holds the shingle at the lowest place."""
    smaller, larger = F.struct("node", "pos", "size"), F.struct("centre.node", "centre.pos", "centre.size")
    first = F.col("size") <= F.col("centre.size")
    pairs = split.where(F.col("component") != F.col("centre.component")).select(F.when(first, smaller).otherwise(larger).alias("x"), F.when(first, larger).otherwise(smaller).alias("y"))
    return pairs.where(_bounds("x", "y", least)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _across(split: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes of different components that share a key and are within the bounds."""
    x, y = split.drop("centre").alias("x"), split.drop("centre").alias("y")
    before = F.struct("x.size", "x.node") < F.struct("y.size", "y.node")
    apart = (F.col("x.component") != F.col("y.component")) & before & _bounds("x", "y", least)
    return x.join(y, (F.col("x.gram") == F.col("y.gram")) & apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def links(nodes: DataFrame, sets_of, least: float = LEAST_SIMILARITY) -> DataFrame:
    """``node, component`` of the nodes that have a near copy. ``nodes`` has each node once with its
    ``bands``; ``sets_of`` gives the sets of a table of nodes."""
    probes = nodes.select("node", F.posexplode("bands").alias("k", "v"))
    buckets = probes.groupBy("k", "v").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
    met = keep(join_lookup(probes, buckets.select("k", "v", "pivot"), ["k", "v"]))
    sets = keep(sets_of(met.select("node").distinct()))
    parts = keep(components(_verified(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets, least)))

    named = join_lookup(met.select("node", "k", "v"), parts, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    ends = named.groupBy("k", "v").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    # A bucket of several components: its nodes may have similar ones besides the pivot.
    open_nodes = join_lookup(named, ends.where("low < high"), ["k", "v"]).select("node").distinct()
    keys = keep(prefix_keys(join_lookup(sets, open_nodes, ["node"]), least))
    for pairs in (_to_centres, _across):
        found = _verified(pairs(_split(keys, parts), least), sets, least)
        parts = keep(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)))
    return parts


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST_SIMILARITY
) -> DataFrame:
    """``doc_id, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest id among the documents that are reachable over pairs with a
    similarity of at least ``least``. Null and empty texts have the same, empty set. Rows that repeat
    stay rows; a null id stays null and never names a component, unless all ids of it are null. An
    empty table gives no rows; other columns are not read. ``docs`` is read twice, so give a table.
    """
    each = keep(_signed_texts(docs, id_col, text_col, shingle))
    nodes = keep(each.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.min("content").alias("content")))
    text = F.col(text_col).cast("string")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # One text of each node, found again by its hash: texts are not written a second time.
        one = join_lookup(nodes.select("node", "content"), wanted, ["node"])
        texts = join_lookup(docs.select(text.alias("text"), F.xxhash64(text).alias("content")), one, ["content"])
        return _sets(texts.groupBy("node").agg(F.first("text").alias("text")), shingle)

    parts = links(nodes, sets_of, least)
    named = join_lookup(nodes.select("node", "first_id"), parts, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = join_lookup(named, lowest, ["component"]).select("node", "component_id")
    return join_lookup(each.select("doc_id", "node"), of_node, ["node"]).select("doc_id", "component_id")
