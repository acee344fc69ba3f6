"""Small tables with what operators have to stand: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ty") for b in ("ra", "so", "vu", "x,", "Za", "é.")]


def texts(seed: int, n: int, longest: int = 120) -> list[str | None]:
    """Random texts, near copies of earlier ones, shared passages, exact copies, null, empty and white space."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(VOCABULARY, k=40))
    out: list[str | None] = [None, "", " \n\t ", "ka", "a b", "x" * 3000, " ".join(rng.choices(VOCABULARY, k=4000))]
    while len(out) < n:
        kind = rng.random()
        words = rng.choices(VOCABULARY, k=rng.randint(1, longest))
        if kind < 0.2 and len(out) > 7:
            words = (rng.choice(out[7:] if len(out) > 7 else ["ka"]) or "ka").split()
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        elif kind < 0.3:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        elif kind < 0.4 and len(out) > 7:
            out.append(rng.choice(out[7:]))
            continue
        out.append(rng.choice([" ", " ", " ", "\n"]).join(words))
    return out


def documents(spark: SparkSession, values: list[str | None], first: int = 0) -> DataFrame:
    rows = [(first + i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def with_odd_columns(docs: DataFrame) -> DataFrame:
    """Columns named as those that operators make."""
    names = ["h", "fp", "g", "key", "tie", "start", "ids", "path", "mask", "seed", "anchor", "segment", "toxic", "spans", "size", "component_id"]
    return docs.selectExpr("*", *[f"'odd' AS {n}" for n in names])
