"""Severity of toxic text by cumulative-link ordinal regression over sparse text features.

One weight per term is shared by all thresholds: ``P(grade <= k) = sigmoid(threshold_k - w x)``. A
term is a run of letters and digits, ASCII letters in lower case; a feature is that it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm.common import SLICE, ship, slices

#: Labelled rows that a fit uses at most, for each label value; those with the smallest hash of the id.
FIT_ROWS = 4_000
#: Longer labelled texts are not used for fitting.
FIT_CHARS = 40_000
#: A term becomes a feature if it occurs in so many rows of the sample ...
LEAST_ROWS = 3
#: ... and its share among the rows above a grade differs from the others' by so many standard errors.
LEAST_Z = 5.0
#: Every ``HOLD_OUT``-th row of the sample, in hash order, chooses the cut and is not fitted.
HOLD_OUT = 4
L2 = 0.5
STEPS = 600
RATE = 0.1
#: Labels of more different values are put into so many grades.
MOST_GRADES = 16

_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_SPLIT).split()) if text else set()


@dataclass(frozen=True)
class Severity:
    """A fitted model: terms with weights, ordered thresholds, and the expected grade from which to reject."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]
    cut: float

    def grades(self, score: np.ndarray) -> np.ndarray:
        """The probability of each grade, one row per score."""
        below = 1.0 / (1.0 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - score[:, None], -50, 50)))
        below = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(below, axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        known = set(self.weights)
        # Sorted, so that equal texts give equal sums whatever the order of a set.
        return np.array([sum(self.weights[t] for t in sorted(known & terms(text))) for text in texts], float)


def fit(rows: list[tuple[Iterable[bytes], int]], counts_for: np.ndarray | None = None) -> tuple[dict[bytes, float], np.ndarray]:
    """Weights and thresholds from rows of terms and grade 0, 1, ...; full-batch Adam on the mean loss with L2.

    Thresholds are a first one and the logarithms of the gaps between them, so that they stay in order.


    ``counts_for`` is how many labelled rows each row stands for, one if it is not given.
    """
    y = np.array([g for _, g in rows], int)
    part = np.ones(len(rows)) if counts_for is None else np.asarray(counts_for, float)
    total = max(part.sum(), 1.0)
    part = part / total
    levels = max(int(y.max()) if len(y) else 0, 1)
    # Labels that are grades are told apart at each threshold; 0, 1 and the grades made of them at 0 only.
    splits = np.arange(levels if levels > 2 else 1)
    above = np.array([max(int((y > k).sum()), 1) for k in splits])
    below = np.array([max(int((y <= k).sum()), 1) for k in splits])
    counts: dict[bytes, np.ndarray] = {}
    for found, grade in rows:
        for t in found:
            counts.setdefault(t, np.zeros(levels + 1, np.int64))[grade] += 1
    chosen = {}
    for t in sorted(counts):
        n = counts[t].sum()
        if n < LEAST_ROWS:
            continue
        share = n / len(rows)
        low = np.cumsum(counts[t])[splits]
        error = np.sqrt(max(share * (1 - share), 1e-9) * (1 / above + 1 / below))
        if (np.abs((n - low) / above - low / below) >= LEAST_Z * error).any():
            chosen[t] = len(chosen)
    index = [np.array(sorted(chosen[t] for t in found if t in chosen), int) for found, _ in rows]
    owner = np.repeat(np.arange(len(rows)), [len(i) for i in index])
    column = np.concatenate(index) if index else np.zeros(0, int)
    w = np.zeros(len(chosen))
    shares = np.array([np.clip(part[y <= k].sum() if len(y) else 0.5, 0.01, 0.99) for k in range(levels)])
    start = np.log(shares / (1 - shares))
    # The first threshold, the logarithms of the gaps, the weights.
    values = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05)), w])
    first, second = np.zeros_like(values), np.zeros_like(values)
    i = np.arange(len(rows))
    for step in range(STEPS if len(rows) else 0):
        theta, w = _thresholds(values, levels), values[levels:]
        score = np.bincount(owner, weights=w[column], minlength=len(rows))
        edges = np.hstack([np.full((len(rows), 1), -np.inf), theta[None, :] - score[:, None], np.full((len(rows), 1), np.inf)])
        cdf = 1 / (1 + np.exp(-np.clip(edges, -50, 50)))
        cdf[:, 0], cdf[:, -1] = 0.0, 1.0
        slope = cdf * (1 - cdf)
        mass = np.maximum(cdf[i, y + 1] - cdf[i, y], 1e-12)
        up, down = slope[i, y + 1] / mass, slope[i, y] / mass
        g_score = (up - down) * part
        g_w = np.bincount(column, weights=g_score[owner], minlength=len(w)) + L2 / total * w
        g_t = np.array([((np.where(y == k, -up, 0) + np.where(y == k + 1, down, 0)) * part).sum() for k in range(levels)])
        # A gap moves all thresholds after it.
        g_gaps = np.cumsum(g_t[::-1])[::-1][1:] * np.exp(values[1:levels])
        slope_of = np.concatenate([[g_t.sum()], g_gaps, g_w])
        first, second = 0.9 * first + 0.1 * slope_of, 0.99 * second + 0.01 * slope_of**2
        ahead = (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-10)
        values = values - RATE * (1 - step / STEPS) * ahead
    w = values[levels:]
    return {t: float(w[k]) for t, k in chosen.items()}, _thresholds(values, levels)


def _thresholds(values: np.ndarray, levels: int) -> np.ndarray:
    return values[0] + np.concatenate([[0.0], np.cumsum(np.exp(values[1:levels]))])


def graded(rows: list[tuple[Iterable[bytes], int]]) -> list[tuple[Iterable[bytes], int]]:
    """Rows labelled 0 or 1 with grades 0, 1, 2: a toxic row is severe (2) if it has more marked terms
    than the median toxic row. A term is marked if it is ten times as frequent among toxic rows."""
    toxic, other = [f for f, g in rows if g], [f for f, g in rows if not g]
    counts: dict[bytes, int] = {}
    for found in toxic:
        for t in found:
            counts[t] = counts.get(t, 0) + 1
    clean: dict[bytes, int] = {}
    for found in other:
        for t in found:
            clean[t] = clean.get(t, 0) + 1
    marked = {
        t for t, c in counts.items() if c >= LEAST_ROWS and c * max(len(other), 1) > 10 * clean.get(t, 0) * len(toxic)
    }
    middle = float(np.median([sum(t in marked for t in f) for f in toxic])) if toxic else 0.0
    return [(f, 0 if not g else 2 if sum(t in marked for t in f) > middle else 1) for f, g in rows]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Severity:
    """A model from at most ``fit_rows`` labelled rows of each label value, weighted by how many rows have that value.

    Labels of 0 and 1 are graded by ``graded``; labels that already are grades 0, 1, 2, ... are used
    as they are. Labels of more than ``MOST_GRADES`` values are graded by the quantiles of all labels
    above 0; 0 stays a grade of its own. A label that repeats counts once; of documents that share an id the
    smallest text counts. Null labels, labels below 0 and texts longer than ``FIT_CHARS`` are not used.
    Without labels the model rejects nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("grade")).where("id IS NOT NULL AND grade >= 0").distinct()
    known = known.withColumn("grade", _binned(known))
    # One row for each grade.
    sizes = {r.grade: r["count"] for r in known.groupBy("grade").count().collect()}
    order = [F.xxhash64("id"), F.col("id"), F.col("grade")]
    sample = None
    for value in sorted(sizes):
        part = known.where(F.col("grade") == value).orderBy(*order).limit(fit_rows)
        sample = part if sample is None else sample.union(part)
    if sample is None:
        return Severity({}, (0.0,), np.inf)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= FIT_CHARS)
    picked = texts.join(F.broadcast(sample), "id").groupBy("id", "grade").agg(F.min("text").alias("text"))
    rows = picked.orderBy(*order).collect()
    # One object for each term of the sample, and no texts: the driver holds little.
    one: dict[bytes, bytes] = {}
    parsed: list[tuple[Iterable[bytes], int]] = []
    while rows:
        row = rows.pop()
        parsed.append((tuple(one.setdefault(t, t) for t in sorted(terms(row.text))), row.grade))
    parsed.reverse()
    labelled = [g for _, g in parsed]
    stands_for = np.array([sizes[g] / labelled.count(g) for g in sorted(set(labelled))])
    part = stands_for[np.searchsorted(sorted(set(labelled)), labelled)] if labelled else np.zeros(0)
    if set(labelled) <= {0, 1}:
        parsed = graded(parsed)
    held = np.arange(len(parsed)) % HOLD_OUT == 0
    fitted = [r for r, out in zip(parsed, held, strict=True) if not out]
    if len({g > 0 for _, g in fitted}) < 2:
        return Severity({}, (0.0,), np.inf)
    weights, theta = fit(fitted, part[~held])
    model = Severity(weights, tuple(float(x) for x in theta), np.inf)
    known_terms = set(weights)
    tested = [r for r, out in zip(parsed, held, strict=True) if out]
    scores = np.array([sum(weights[t] for t in sorted(known_terms.intersection(f))) for f, _ in tested], float)
    expected = model.grades(scores) @ np.arange(len(theta) + 1)
    return Severity(model.weights, model.thresholds, best_cut(expected, np.array([g > 0 for _, g in tested]), part[held]))


def _binned(known: DataFrame) -> Column:
    """The grade of each label: itself, or a quantile's number if labels have more values than ``MOST_GRADES``."""
    if known.select("grade").distinct().limit(MOST_GRADES + 1).count() <= MOST_GRADES:
        return F.col("grade")
    bins = MOST_GRADES - 1
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    ends = known.where("grade > 0").agg(F.percentile("grade", shares)).first()[0]
    above = [(F.col("grade") > e).cast("int") for e in sorted(set(ends))]
    return F.when(F.col("grade") > 0, sum(above, F.lit(1))).otherwise(0)


def best_cut(expected: np.ndarray, toxic: np.ndarray, counts_for: np.ndarray | None = None) -> float:
    """The expected severity from which rejecting has the best F1; the middle of the gap below it."""
    if not toxic.any():
        return np.inf
    part = np.ones(len(expected)) if counts_for is None else counts_for
    values = np.unique(expected)
    best = (-1.0, np.inf)
    for k, v in enumerate(values):
        hit = expected >= v
        f1 = 2 * part[hit & toxic].sum() / (part[hit].sum() + part[toxic].sum())
        if f1 >= best[0]:
            best = (f1, (v + values[k - 1]) / 2 if k else v)
    return float(best[1])


def rejects(model: Severity) -> Callable[[str], Column]:
    """A column function of a text: whether the model rejects it, as ``toxic`` of ``score``."""
    ship(SparkSession.active())

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        found: list[bool] = []
        for start in range(0, len(texts), SLICE):
            some = [t if isinstance(t, str) else None for t in texts.iloc[start : start + SLICE]]
            expected = model.grades(model.score(some)) @ np.arange(len(model.thresholds) + 1)
            found += [bool(t) and bool(e >= model.cut) for t, e in zip(some, expected, strict=True)]
        return pd.Series(found, dtype=bool)

    return rejected


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_severity, grade, toxic`` of every row of ``docs``, from its whole text.

    ``grade`` is the most probable one, the lowest of ties; ``toxic`` is true from the model's cut on.
    Null and empty texts have no term and are scored by the thresholds alone, and are not toxic.
    Rows that repeat stay rows, a null id stays null, other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            points = model.score(texts)
            chances = model.grades(points)
            expected = chances @ np.arange(chances.shape[1])
            some = np.array([bool(t) for t in texts])
            columns = [expected, chances.argmax(axis=1).astype(np.int32), (expected >= model.cut) & some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)], ["doc_id", "expected_severity", "grade", "toxic"]
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, expected_severity double, grade int, toxic boolean")
