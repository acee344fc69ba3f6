"""What several operators of this subpackage need."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators.skew import join_lookup
from lotline.storage import keep

#: Rows of text that a Python worker turns into Python objects at a time.
SLICE = 256


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers that Spark starts on this machine find this package.

    Executors elsewhere need it installed or sent with ``--py-files``, as any package.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: runs of ``[^\\x20\\x09-\\x0D]``, which is what ``bytes.split`` takes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's ``bigint`` of the same bits."""
    return value - (1 << 64) if value >> 63 else value


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of a graph given as edges ``a, b`` (bigint): the smallest node that is reachable.

    Nodes without an edge to another node are left out. Alternating large and small stars: every
    round links the neighbours of a node to the smallest of them, so that the number of rounds grows
    with the logarithm of the longest chain and edges never outnumber those given. A node with very
    many neighbours is combined before the shuffle and split in the join. Each round is written to
    the shared folder; only a count and a checksum reach the driver.
    """
    edges = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_lookup(both, smallest, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Every edge points down now; the smallest neighbour of each node takes the others.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_lookup(large, lowest, ["a"])
        small = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        ).select("e.a", "e.b")
        edges = keep(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
