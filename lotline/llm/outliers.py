"""Quality rules: robust multivariate outliers by minimum covariance determinant per language and source.

Each document has a vector of transformed statistics. In each group there are several starts: medians
with absolute deviations, mean and covariance of all rows, and those of the half that is nearest to the
medians. Concentration steps follow from each: the ``H_SHARE`` of the rows that are nearest by the
estimate give the next mean and covariance. Of the starts the one whose covariance has the smallest
determinant stays. A last step takes all rows within the 97.5 % quantile. A document is rejected if its
squared Mahalanobis distance is above the ``CUTOFF`` quantile of chi-square.

Everything is counted over all rows: a step counts rows and moments by group, start and bin of
distance, so no group has to fit anywhere, and takes the nearest bins. Statistics are whole numbers, so
moments are exact and do not depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices, words
from lotline.operators.skew import join_lookup
from lotline.storage import keep

#: Base rules: fewer words, or a larger share of words in repeated windows, fail.
LEAST_WORDS = 20
MOST_REPEATED = 0.3
REPEAT_WINDOW = 8
#: Share of a group's rows that an estimate is made from.
H_SHARE = 0.75
STEPS = 4
REWEIGHT = 0.975
CUTOFF = 0.9999
#: Groups with fewer rows are judged by all rows of their language, and if those are fewer too, by all rows;
#: a table with fewer has no estimate and keeps its rows.
LEAST_ROWS = 50
#: The statistics and a standard deviation that is added to each, so that a statistic which is the same in
#: nearly all rows does not reject the rest for a single event (a sign, a line, a repeated window), and yet
#: one of them alone can reject: symbols from 7 in 100 words on, lines from 7, repeated words from 13.
FLOORS = {"length": 0.1, "word_length": 0.08, "symbols": 0.4, "dup_lines": 0.4, "repeats": 0.5}
#: Statistics are kept in steps of 1 / _UNIT; distances in bins, so many to a factor of e.
_UNIT = 1024
_BINS = 64

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_P = len(FLOORS)
_X = [f"x{i}" for i in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def repeat_words(tokens: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[k : n + k]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(twice)
    marks[at] += 1
    marks[at + window] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines that repeat an earlier one, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens = words(text)
    # Bytes that continue a code point do not count.
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(tokens), chars, len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(tokens)


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([statistics(t) for t in batch.column(3).to_pylist()], np.int64).reshape(-1, len(names))
            columns = [pa.array(values[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *names])

    chosen = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{n} bigint" for n in names)
    return chosen.mapInArrow(run, schema)


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.log1p(100.0 * F.col(c) / n)
    values = [F.log1p(F.col("n_words")), F.log1p(F.col("word_chars") / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return {x: F.round(v * _UNIT).cast("bigint") for x, v in zip(_X, values, strict=True)}


def _chi2_cdf(x: float, p: int) -> float:
    """By the series of the incomplete gamma function."""
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= half / (a + k)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, p) < share else (low, middle)
    return (low + high) / 2


def _consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is to be multiplied by."""
    return share / _chi2_cdf(chi2_quantile(share, _P), _P + 2)


def _distance() -> Column:
    """The squared distance by the columns ``m`` (means) and ``w`` (upper triangle of the inverse covariance)."""
    d = [(F.col(x) / _UNIT - F.col("m")[i]) for i, x in enumerate(_X)]
    terms = [F.col("w")[k] * d[i] * d[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _start(rows: DataFrame) -> DataFrame:
    """``g, n, m, w`` from medians and median absolute deviations, exact: whole numbers have few values."""
    half = F.lit(0.5)
    centre = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, half).alias(f"c{i}") for i, x in enumerate(_X)])
    off = join_lookup(rows, centre, ["g"])
    spread = off.groupBy("g").agg(
        F.first("n").alias("n"),
        F.array(*[F.first(f"c{i}") / _UNIT for i in range(_P)]).alias("m"),
        *[(F.percentile(F.abs(F.col(x) - F.col(f"c{i}")), half) * 1.4826 / _UNIT).alias(f"s{i}") for i, x in enumerate(_X)],
    )
    floors = list(FLOORS.values())
    inverse = [1.0 / (F.col(f"s{i}") * F.col(f"s{i}") + floors[i] ** 2) if i == j else F.lit(0.0) for i, j in _PAIRS]
    return spread.select("g", "n", "m", F.array(*inverse).alias("w"))


def _estimated(moments: DataFrame, factor: float) -> DataFrame:
    """``g, start, n, m, w, size`` from sums of the chosen rows; ``size`` is the logarithm of the determinant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            sums = np.array(batch.column(4).to_pylist(), float).reshape(-1, _P)
            products = np.array(batch.column(5).to_pylist(), float).reshape(-1, len(_PAIRS))
            mean = sums / k[:, None]
            cov = np.zeros((len(k), _P, _P))
            for at, (i, j) in enumerate(_PAIRS):
                cov[:, i, j] = cov[:, j, i] = (products[:, at] / k - mean[:, i] * mean[:, j]) * factor / _UNIT**2
            cov += np.diag(np.square(list(FLOORS.values())))
            inverse = np.linalg.inv(cov)
            size = np.linalg.slogdet(cov)[1]
            upper = np.array([[m[i, j] for i, j in _PAIRS] for m in inverse]).reshape(-1, len(_PAIRS))
            columns = [pa.array((mean / _UNIT).tolist(), pa.list_(pa.float64())), pa.array(upper.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(size)], ["g", "start", "n", "m", "w", "size"])

    sums = F.array(*[f"s{i}" for i in range(_P)])
    products = F.array(*[f"p{k}" for k in range(len(_PAIRS))])
    chosen = moments.select("g", "start", "n", "k", sums.alias("sums"), products.alias("products"))
    return chosen.mapInArrow(run, "g string, start int, n bigint, m array<double>, w array<double>, size double")


def _totals() -> list[Column]:
    totals = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)]
    return totals + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)]


def _step(rows: DataFrame, now: DataFrame, share: float = H_SHARE) -> DataFrame:
    """One concentration step of each start: an estimate from the nearest rows by the one before."""
    near = join_lookup(rows, now, ["g"]).withColumn("bin", F.floor(F.log1p(_distance()) * _BINS).cast("int"))
    binned = near.groupBy("g", "start", "bin").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), *_totals())
    before = F.sum("k").over(Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    nearest = binned.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.ceil(F.col("n") * share))
    summed = [F.sum(c).alias(c) for c in ("k", *[f"s{i}" for i in range(_P)], *[f"p{k}" for k in range(len(_PAIRS))])]
    return _estimated(nearest.groupBy("g", "start").agg(F.first("n").alias("n"), *summed), _consistency(share))


def _starts(rows: DataFrame) -> DataFrame:
    """Several first estimates of each group of at least ``LEAST_ROWS`` rows, told apart by ``start``."""
    columns = ["g", "start", "n", "m", "w"]
    medians = keep(_start(rows).where(F.col("n") >= LEAST_ROWS).withColumn("start", F.lit(0)).select(columns))
    large = join_lookup(rows, medians.select("g", "n"), ["g"])
    plain = _estimated(large.groupBy("g").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), *_totals()).withColumn("start", F.lit(1)), 1.0)
    half = _step(rows, medians, 0.5).withColumn("start", F.lit(2))
    return keep(medians.union(plain.select(columns)).union(half.select(columns)))


def estimates(rows: DataFrame) -> DataFrame:
    """``g, n, m, w, size``: of each group of ``g, x0, x1, ...`` the concentrated start with the smallest determinant."""
    now = _starts(rows)
    for _ in range(STEPS):
        now = _step(rows, now).drop("size") if _ < STEPS - 1 else _step(rows, now)
    best = now.groupBy("g").agg(F.min_by(F.struct("n", "m", "w", "size"), F.struct("size", "start")).alias("b"))
    return best.select("g", "b.*")


def _reweighted(rows: DataFrame, now: DataFrame) -> DataFrame:
    near = join_lookup(rows, now.drop("size"), ["g"]).where(_distance() <= chi2_quantile(REWEIGHT, _P))
    moments = near.groupBy("g").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), *_totals())
    return _estimated(moments.withColumn("start", F.lit(0)), _consistency(REWEIGHT))


def _pooled(good: DataFrame) -> DataFrame:
    """``g, key, keys``: by which estimate a group is judged, and to which its rows contribute."""
    sizes = good.groupBy("g", "pool").agg(F.count(F.lit(1)).alias("size"))
    pools = keep(sizes.groupBy("pool").agg(F.sum("size").alias("pool_size"), F.min("size").alias("least")))
    all_needed = not pools.where((F.col("least") < LEAST_ROWS) & (F.col("pool_size") < LEAST_ROWS)).isEmpty()
    large, pool_large = F.col("size") >= LEAST_ROWS, F.col("pool_size") >= LEAST_ROWS
    keys = F.array(F.when(large, F.col("g")), F.when(pool_large & (F.col("least") < LEAST_ROWS), F.col("pool")), F.lit("" if all_needed else None))
    key = F.when(large, F.col("g")).when(pool_large, F.col("pool")).otherwise("")
    return join_lookup(sizes, pools, ["pool"]).select("g", key.alias("key"), F.array_compact(keys).alias("keys"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept``.

    One row per row of ``docs``. Rows that fail the base rules are not kept and take no part in the
    estimates; their ``distance`` is null, as is that of all rows of a table with too few for an estimate,
    which are kept. A null text has no word. Null languages and sources are groups like any other, a null id
    stays null, rows that repeat count each. Empty tables give no rows; other columns are not read.
    """
    raw = measured(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    base = keep(raw.withColumn("base_failed", failed))
    key = F.to_json(F.struct("lang", "source"))
    good = base.where("NOT base_failed").select("doc_id", key.alias("g"), F.to_json(F.struct("lang")).alias("pool"), *_counts())
    groups = keep(_pooled(good))
    rows = join_lookup(good, groups.select("g", "keys"), ["g"]).select(F.explode("keys").alias("g"), *[v.alias(x) for x, v in _vector().items()])
    rows = keep(rows)
    final = keep(_reweighted(rows, estimates(rows)))
    used = join_lookup(base.withColumn("g", key), groups.select("g", "key"), ["g"], "left").drop("g").withColumnRenamed("key", "g")
    measured_rows = join_lookup(used.withColumns(_vector()), final.select("g", "m", "w"), ["g"], "left")
    distance = F.when(~F.col("base_failed"), _distance())
    near = F.coalesce(F.col("distance") <= chi2_quantile(CUTOFF, _P), F.lit(True))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    return measured_rows.withColumn("distance", distance).select(*columns, (~F.col("base_failed") & near).alias("kept"))


def _counts() -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
