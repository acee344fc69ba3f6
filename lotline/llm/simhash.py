"""Near duplicates by SimHash fingerprints, found by generalised pigeonhole search.

Bits that vary together are put into the same of ``m`` groups. If each group ``i`` gets a threshold
``t_i`` >= -1 and the thresholds add up to ``distance - m + 1``, two fingerprints within the distance
agree up to ``t_i`` bits in at least one group ``i`` (-1: the group is not looked at). A dynamic
programme over the groups picks the thresholds for which the estimated candidates and the probes to
write are fewest, for several ``m``; the cheapest plan is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import components, ship, signed, slices, words
from lotline.operators.skew import join_lookup
from lotline.storage import keep

BITS = 64
#: Numbers of bit groups that the plan chooses from.
GROUP_COUNTS = (2, 3, 4)
#: A bucket up to this size is compared pair by pair; larger ones take the way that never pairs.
SMALL_BUCKET = 32
#: Hashes that are unpacked into bits at a time.
_CHUNK = 65_536

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; 0 if it has no word."""
    tokens = words(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")) if text else []
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams = [b" ".join(tokens)]
    else:
        grams = list(map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, [seed] * len(grams)), ">u8", len(grams))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = np.unpackbits(hashes[start : start + _CHUNK].view(np.uint8)).reshape(-1, BITS)
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (bigint) of every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, fp bigint")


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both: 64 x 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in slices(batches, _CHUNK):
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8)
            bits = np.unpackbits(raw).reshape(-1, BITS)[:, ::-1].astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        cells = pa.array(np.arange(BITS * BITS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for row in rows:
        both[row.cell] = row.n
    return fps.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        first = max(sorted(left), key=lambda b: sum(tie[b, x] for x in left if x != b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: sum(tie[b, x] for x in group))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def variants(bits: list[int], t: int) -> list[int]:
    """What to xor a value with to get all values within ``t`` bits of it in this group."""
    return [mask_of(list(c)) for k in range(t + 1) for c in combinations(bits, k)]


def _within(p: np.ndarray, bits: list[int], t: int) -> float:
    """The chance that two fingerprints differ in at most ``t`` of the bits, if bits were independent."""
    chances = np.zeros(t + 1)
    chances[0] = 1.0
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        shifted = np.concatenate([[0.0], chances[:-1]])
        chances = chances * (1 - differ) + shifted * differ
    return float(chances.sum())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds of least cost: ``costs[i][t + 1]`` is that of threshold ``t`` in group ``i``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, own in enumerate(group):
                key, now = used + k - 1, (cost + own, [*chosen, k - 1])
                if key not in step or now < step[key]:
                    step[key] = now
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int = 2) -> list[tuple[list[int], int]]:
    """The bit groups to probe and their thresholds, from counts over all fingerprints."""
    n, both = _bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    layouts = {m: group_bits(n, both, m) for m in GROUP_COUNTS if m <= distance + 2}
    flat = [(m, i, bits) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    keys = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask_of(b))).alias("v")) for k, (_, _, b) in enumerate(flat)])
    )
    counted = fps.select(keys.alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = {r.k: r.pairs for r in counted.groupBy("k").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    exact = {(m, i): pairs.get(k, 0.0) for k, (m, i, _) in enumerate(flat)}
    found = []
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            same = max(_within(p, bits, 0), 1e-300)
            own = [0.0]
            for t in range(distance + 1):
                candidates = min(exact[m, i] * _within(p, bits, t) / same, n * n / 2)
                own.append(candidates + n * sum(comb(len(bits), k) for k in range(t + 1)))
            costs.append(own)
        cost, thresholds = allocate(costs, distance - m + 1)
        found.append((cost, m, [(b, t) for b, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found)[2]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints, whose components are those of all pairs within
    the distance. ``fps`` has each fingerprint once, as ``fp``.

    A bucket of at most ``SMALL_BUCKET`` rows is verified pair by pair. The members of larger ones
    are near copies of each other or a very common value; for a distance of 2 they meet at the
    values one bit away from each: two of them share such a value exactly if at most two bits
    differ, and at most 65 fingerprints can share one. So no bucket is ever paired out, and no
    candidate is left out.
    """
    if distance != 2:
        raise ValueError("Large buckets are split for a distance of 2 only")
    parts = []
    for k, (bits, t) in enumerate(plan(fps, distance)):
        value = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        changes = F.explode(F.array(*[F.lit(v) for v in variants(bits, t)]))
        probe = fps.select("fp", value.alias("v"), changes.alias("x"))
        parts.append(
            probe.select(F.lit(k).alias("k"), F.col("v").bitwiseXOR(F.col("x")).alias("v"), "fp", F.expr("x = 0").alias("own"))
        )
    probes = parts[0]
    for part in parts[1:]:
        probes = probes.union(part)
    sizes = probes.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own"))
    met = keep(join_lookup(probes, sizes.where("n > 1 AND any_own").select("k", "v", "n"), ["k", "v"]))
    small = (
        met.where(F.col("n") <= SMALL_BUCKET)
        .groupBy("k", "v")
        .agg(F.collect_list(F.struct("own", "fp")).alias("all"))
        .select(F.explode(F.filter("all", lambda x: x["own"])).alias("one"), "all")
        .select(
            F.col("one.fp").alias("a"),
            F.explode(F.filter("all", lambda x: F.bit_count(x["fp"].bitwiseXOR(F.col("one.fp"))).between(1, distance))).alias("other"),
        )
        .select("a", F.col("other.fp").alias("b"))
    )
    flips = F.explode(F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << b)) for b in range(BITS)]))
    large = (
        met.where(F.col("n") > SMALL_BUCKET)
        .select("fp")
        .distinct()
        .select("fp", flips.alias("x"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("x")).alias("middle"))
        .agg(F.collect_list("fp").alias("all"))
        .where("size(all) > 1")
        .select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
        .where("a <> b")
    )
    return small.union(large).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits. ``component_id`` is the smallest id among the documents that
    are reachable over fingerprints at most ``distance`` bits apart. Null and empty texts have no
    word and fingerprint zero, linked like any other. Rows that repeat stay rows; a null id stays
    null and never names a component, unless all ids of it are null. An empty table gives no rows;
    other columns are not read.
    """
    each = keep(fingerprints(docs, id_col, text_col, shingle))
    fps = keep(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = components(links(fps.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
    named = fps.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = join_lookup(named, lowest, ["component"]).select("fp", "component_id")
    return join_lookup(each, of_fp, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
