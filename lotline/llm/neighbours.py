"""Nearest neighbours by inner product through learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours; the graph is cut into equal parts
that few edges leave; a small classifier learns the part of a vector. The classifier then files every
vector, and sends a query to the few parts that are most probable for it, where all vectors are
compared exactly. How many parts a query needs is measured: for a bounded number of queries all rows
are searched, and the number is the least that finds ``TARGET_RECALL`` of their neighbours.

Equal vectors are one entry of the index with their smallest ids, so copies cost nothing. Parts are
dealt out in blocks of a bounded size on both sides, so that no part and no crowd of queries has to fit
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.llm.common import ship
from lotline.llm.vectors import common_length, matrix, of_length, usable
from lotline.operators.skew import join_lookup
from lotline.storage import keep

#: Rows that the graph and the classifier are fitted on, and what they may take as doubles.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
#: There is a part for so many vectors, up to so many parts; beyond that parts grow and are dealt in blocks.
PART_ROWS, MOST_PARTS = 1_024, 512
#: Neighbours of a vector in the graph.
DEGREE = 10
#: Queries that the number of parts to search is measured with, and what they have to find.
MEASURED_QUERIES, TARGET_RECALL = 256, 0.97
#: Vectors and queries that meet in one group, and what the vectors may take as doubles.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 8 << 20
#: Ids of copies are first cut to those that can count within so many shares.
_SHARES = 64
_EPOCHS, _BATCH, _RATE = 30, 512, 0.02


@dataclass(frozen=True)
class Router:
    """A linear classifier: ``order`` gives the parts of vectors, most probable first."""

    weights: np.ndarray
    bias: np.ndarray

    def order(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(vectors @ self.weights + self.bias), axis=1, kind="stable").astype(np.int32)

    def first(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.weights + self.bias).argmax(axis=1).astype(np.int32)


@dataclass(frozen=True)
class Index:
    """``entries``: ``rep, vector, ids, part`` of every different vector, ``sizes`` how many each part has.

    ``sample`` are entries that bound scores from below.
    """

    entries: DataFrame
    sizes: np.ndarray
    router: Router
    sample: np.ndarray
    width: int
    keep_ids: int


def nearest_in(sample: np.ndarray, rows: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` rows of ``sample`` with the largest inner product with each of ``rows`` (indices), not itself."""
    scores = sample[rows] @ sample.T
    scores[np.arange(len(rows)), rows] = -np.inf
    return np.argpartition(-scores, degree - 1, axis=1)[:, :degree].astype(np.int32)


def graph(spark: SparkSession, sample: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest neighbours of each row of the sample, one block of rows per task."""
    degree, block = min(degree, len(sample) - 1), 512
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = np.arange(k * block, min((k + 1) * block, len(shared.value)))
                found = nearest_in(shared.value, rows, degree)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(found), pa.list_(pa.int32()))], ["i", "near"])

    blocks = -(-len(sample) // block)
    out = np.zeros((len(sample), degree), np.int32)
    for r in spark.range(0, blocks, 1, blocks).mapInArrow(run, "i bigint, near array<int>").collect():
        out[r.i] = r.near
    shared.unpersist()
    return out


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node of a neighbour graph: sizes differ by one per halving at most, few edges between parts.

    The graph is halved again and again: by the slowest mode of a random walk on it, cut in the middle,
    then by swaps of nodes that both have more edges to the other side.
    """
    n = len(near)
    out = np.zeros(n, np.int32)
    source = np.repeat(np.arange(n), near.shape[1])
    target = near.ravel().astype(np.int64)
    random = np.random.Generator(np.random.PCG64(7))
    todo = [(np.arange(n), np.concatenate([source, target]), np.concatenate([target, source]), 0, parts)]
    while todo:
        nodes, a, b, first, count = todo.pop()
        if count == 1:
            out[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        left = count // 2
        upper = _halved(len(nodes), place[a], place[b], len(nodes) * left // count, random)
        side = np.zeros(n, bool)
        side[nodes] = upper
        for here, start, of in ((~upper, first, left), (upper, first + left, count - left)):
            wanted = bool(upper[here][0]) if here.any() else False
            stay = (side[a] == wanted) & (side[b] == wanted)
            todo.append((nodes[here], a[stay], b[stay], start, of))
    return out


def _halved(n: int, a: np.ndarray, b: np.ndarray, lower: int, random: np.random.Generator) -> np.ndarray:
    """For each of ``n`` nodes whether it is in the upper side; the lower one has ``lower`` nodes. Edges in both directions."""
    degree = np.bincount(a, minlength=n) + 1.0
    mode = random.standard_normal(n)
    for _ in range(40):
        mode -= (mode @ degree) / degree.sum()
        mode = 0.5 * mode + 0.5 * (mode + np.bincount(a, mode[b], n)) / degree
        mode /= np.abs(mode).max() or 1.0
    upper = np.ones(n, bool)
    upper[np.argsort(mode, kind="stable")[:lower]] = False
    cut = int((upper[a] != upper[b]).sum())
    for _ in range(12):
        across = np.bincount(a, upper[a] != upper[b], n)
        gain = 2 * across - (degree - 1)
        ups, downs = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (upper, ~upper))
        pairs = min(len(ups), len(downs), max(1, n // 10))
        good = int((gain[ups[:pairs]] + gain[downs[:pairs]] > 0).sum())
        if not good:
            break
        tried = upper.copy()
        tried[ups[:good]], tried[downs[:good]] = False, True
        now = int((tried[a] != tried[b]).sum())
        if now >= cut:
            break
        upper, cut = tried, now
    return upper


def train(sample: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int) -> Router:
    """A softmax regression on the parts of each row and its neighbours."""
    scale = 1.0 / (np.sqrt(np.mean(np.square(sample).sum(axis=1))) or 1.0)
    rows = sample * scale
    target = np.zeros((len(rows), parts))
    np.add.at(target, (np.arange(len(rows)), part), 1.0)
    for column in near.T:
        np.add.at(target, (np.arange(len(rows)), part[column]), 1.0)
    target /= near.shape[1] + 1
    random = np.random.Generator(np.random.PCG64(11))
    values = np.zeros((rows.shape[1] + 1, parts))
    first, second, step = np.zeros_like(values), np.zeros_like(values), 0
    for epoch in range(_EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), _BATCH):
            take = order[start : start + _BATCH]
            x = np.column_stack([rows[take], np.ones(len(take))])
            scores = x @ values
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            slope = x.T @ (scores / scores.sum(axis=1, keepdims=True) - target[take]) / len(take)
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            rate = _RATE * (1 - epoch / _EPOCHS) + 1e-3
            values -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Router(values[:-1] * scale, values[-1])


def entries(rows: DataFrame, keep_ids: int) -> DataFrame:
    """``rep, vector, ids`` of the different vectors of ``vec_id, vector``: ``rep`` is the smallest id, ``ids`` the ``keep_ids`` smallest."""
    firsts = rows.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"))
    # An id may have several vectors, so vectors get a number of their own, in a written table.
    firsts = keep(firsts.withColumn("key", F.monotonically_increasing_id()))
    ids = join_lookup(rows, firsts.where("last > rep").select("vector", "key"), ["vector"]).select("key", "vec_id").distinct()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(_SHARES))
    # The smallest within a share, then the smallest of all shares: no task gets all copies of a vector.
    for keys in (["key", "share"], ["key"]):
        ids = ids.withColumn("share", share).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id")))
        ids = ids.where(F.col("k") <= keep_ids).select("key", "vec_id")
    lists = ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return firsts.join(lists, "key", "left").select("rep", "vector", F.coalesce("ids", F.array("rep")).alias("ids"))


def build(rows: DataFrame, width: int, keep_ids: int) -> Index | None:
    """The index of ``vec_id, vector``; None if there is no row. Every vector is filed by the classifier."""
    spark = ship(rows.sparkSession)
    every = keep(entries(rows, keep_ids))
    n = every.count()
    if not n:
        return None
    most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    drawn = every.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(n)) < most).orderBy("rep").select("vector").collect()
    sample = np.array([r.vector for r in drawn]).reshape(-1, width)
    parts = max(1, min(-(-n // PART_ROWS), MOST_PARTS, len(sample) // (2 * DEGREE)))
    if parts == 1:
        router = Router(np.zeros((width, 1)), np.zeros(1))
    else:
        near = graph(spark, sample)
        router = train(sample, near, balanced_parts(near, parts), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.first(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["rep", "vector", "ids", "part"])

    filed = keep(every.mapInArrow(run, "rep bigint, vector array<double>, ids array<bigint>, part int"))
    sizes = np.zeros(parts, np.int64)
    for r in filed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    return Index(filed, sizes, router, sample, width, keep_ids)


def exact_nearest(index: Index, queries: np.ndarray, k: int) -> DataFrame:
    """``q, rep, part, score``: the ``k`` nearest entries of each row of ``queries``, of all entries but the query itself."""
    width = index.width
    squares = np.square(queries).sum(axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            vectors = matrix(batch.column(1), width)
            scores = queries @ vectors.T
            apart = squares + np.square(vectors).sum(axis=1) - 2 * scores
            scores[apart <= 1e-12 * squares] = -np.inf
            reps, parts = (np.broadcast_to(batch.column(i).to_numpy(zero_copy_only=False), scores.shape) for i in (0, 2))
            found = (scores, reps, parts)
            if best is not None:
                found = tuple(np.concatenate(x, axis=1) for x in zip(best, found, strict=True))
            top = np.argsort(-found[0], axis=1, kind="stable")[:, :k]
            best = tuple(np.take_along_axis(x, top, axis=1) for x in found)
        if best is not None:
            q = np.repeat(np.arange(len(queries)), best[0].shape[1])
            columns = [pa.array(q), *(pa.array(np.ascontiguousarray(best[i]).ravel()) for i in (1, 2, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "rep", "part", "score"])

    each = index.entries.select("rep", "vector", "part").mapInArrow(run, "q bigint, rep bigint, part int, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return each.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")


def parts_to_search(index: Index, queries: np.ndarray, k: int, target: float = TARGET_RECALL) -> int:
    """The least number of parts, most probable first, that hold ``target`` of the queries' ``k`` nearest entries."""
    parts = len(index.router.bias)
    if parts == 1 or not len(queries):
        return 1
    order = index.router.order(queries)
    place = np.argsort(order, axis=1)
    found = exact_nearest(index, queries, k).where(F.col("score") > float("-inf")).select("q", "part").collect()
    held = np.bincount([place[r.q, r.part] for r in found], minlength=parts)
    return int(np.searchsorted(np.cumsum(held), target * held.sum() - 1e-9)) + 1


def _compared(keep_ids: int, width: int):  # noqa: ANN202
    """Of a block of entries and a block of queries, each query's best entries with their exact scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            entry, query = (matrix(t.column("vector").combine_chunks(), width) for t in (left, right))
            bound, q = right.column("bound").to_numpy(), right.column("q").to_numpy()
            for start in range(0, len(query), 256):
                some = query[start : start + 256]
                scores = some @ entry.T
                least = bound[start : start + 256]
                if entry.shape[0] > keep_ids:
                    least = np.maximum(least, -np.partition(-scores, keep_ids - 1, axis=1)[:, keep_ids - 1])
                # A product of matrices may round by place; what is close to the bound is decided by exact scores.
                room = np.where(np.isfinite(least), 1e-9 * (1.0 + np.abs(least)), 0.0)
                i, j = np.nonzero(scores >= (least - room)[:, None])
                out[0].append(q[start + i])
                out[1].append(j)
                for s in range(0, len(i), 8192):
                    x, y = some[i[s : s + 8192]], entry[j[s : s + 8192]]
                    out[2].append((x * y).sum(axis=1))
                    out[3].append((x == y).all(axis=1))
        q_of, rows, scores, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        ids = left.column("ids").take(pa.array(rows.astype(np.int64)))
        return pa.table({"q": pa.array(q_of, pa.int64()), "score": pa.array(scores, pa.float64()), "own": pa.array(own.astype(bool)), "ids": ids})

    return run


def search(index: Index, queries: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``query_id, vector``; the query's own row does not count.

    ``parts`` is how many parts each query is compared with; measured if it is not given.
    """
    spark, width, router = queries.sparkSession, index.width, index.router
    distinct = keep(queries.select("vector").distinct().withColumn("q", F.monotonically_increasing_id()))
    if parts is None:
        some = distinct.orderBy(F.xxhash64("vector")).limit(MEASURED_QUERIES).collect()
        parts = parts_to_search(index, np.array([r.vector for r in some]).reshape(-1, width), k)
    block_rows = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    wanted, sample = k + 1, spark.sparkContext.broadcast(index.sample)

    sizes, sample_part = index.sizes, router.first(index.sample)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                vectors = matrix(some.column(0), width)
                order = router.order(vectors)
                # More parts for a query whose parts are too small to hold enough entries.
                enough = np.maximum((np.cumsum(sizes[order], axis=1) < wanted).sum(axis=1) + 1, parts)
                chosen = [row[:n] for row, n in zip(order, enough, strict=True)]
                searched = np.zeros(order.shape, bool)
                np.put_along_axis(searched, order, np.arange(order.shape[1]) < enough[:, None], axis=1)
                # Sampled entries of these parts bound the scores that count from below.
                known = np.where(searched[:, sample_part], vectors @ sample.value.T, -np.inf)
                bound = -np.partition(-known, wanted, axis=1)[:, wanted] if known.shape[1] > wanted else np.full(len(vectors), -np.inf)
                lists = pa.array(chosen, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(bound), lists], ["vector", "q", "bound", "parts"])

    routed = distinct.mapInArrow(route, "vector array<double>, q bigint, bound double, parts array<int>")
    routed = keep(routed.withColumn("part", F.explode("parts")).drop("parts"))
    # As many rows as parts: at most MOST_PARTS.
    entry_blocks = index.entries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    query_blocks = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("crowds"))
    zero = F.lit(0).cast("bigint")
    blocks = F.broadcast(keep(entry_blocks.join(query_blocks, "part")))
    left = index.entries.join(blocks, "part").select(
        "part", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.explode(F.sequence(zero, F.col("crowds") - 1)).alias("crowd"), "vector", "ids"
    )
    right = routed.join(blocks, "part").select(
        "part", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("q"), F.col("crowds")).alias("crowd"), "vector", "q", "bound"
    )
    keys = ["part", "block", "crowd"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compared(wanted, width), "q bigint, score double, own boolean, ids array<bigint>")
    each = met.select("q", "score", "own", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("k", F.row_number().over(best)).where(F.col("k") <= wanted)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score", "own"))).alias("found"))
    ids = join_lookup(queries.select("query_id", "vector").distinct(), distinct, ["vector"]).select("query_id", "q")
    others = F.slice(F.filter("found", lambda x: ~x["own"] | (x["vec_id"] != F.col("query_id"))), 1, k)
    ranked = join_lookup(ids, lists, ["q"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of the largest inner product for each row whose id is divisible by ``every``.

    All rows but the query's own are candidates, nearest first, ties to the smaller id; scores are sums of
    products in double precision. Vectors that are null, empty or zero or hold null or non-finite entries
    take no part, nor do rows with a null id. If vectors differ in length, those of the most frequent
    length take part (the greater of ties). A row that repeats counts once; different vectors with one id
    are candidates each, and each has its neighbours, the others of its id among them. Other columns are
    not read. An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col).where(F.col("vec_id").isNotNull() & F.exists("vector", lambda c: c != 0))
    width = common_length(rows, "vector")
    rows = rows.where(of_length("vector", width))
    index = build(rows, width, k + 1) if width else None
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return search(index, queries, k)
