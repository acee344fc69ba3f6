"""A training corpus from raw documents.

Each stage takes all documents that the one before kept, and all but the last return the columns of
``documents``. ``STAGES`` has them in order; ``run`` applies them with a written table between two.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from lotline.llm import decontaminate, near_copies, pii, queries, simhash, toxicity  # noqa: E402
from lotline.storage import keep  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: An id without nulls, so that it can be joined and grouped by: 0 and true for a null.
KEY = ["_id", "_no_id"]


def _key(column: str) -> list[Column]:
    return [F.coalesce(column, F.lit(0).cast("bigint")).alias(KEY[0]), F.isnull(column).alias(KEY[1])]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cut of a model fitted on labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~toxicity.rejects(model)("text")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one whose id names the group.

    Groups are those of SimHash fingerprints, as ``op3_simhash_near_dedup`` links them, and those of a
    Jaccard similarity of at least 0.8 by five words, directly or over others; a document stays if it
    names its group in both. Rows that repeat an id and a text count as one document.
    """
    ids = None
    for found in (simhash.near_duplicates(docs), near_copies.near_copies(docs)):
        chosen = found.where(found.doc_id.eqNullSafe(found.component_id)).select(*_key("doc_id")).distinct()
        ids = chosen if ids is None else ids.join(chosen, KEY, "left_semi")
    # Whole texts are shuffled once, by columns that the groups of repeated rows have too.
    kept = docs.select("*", *_key("doc_id")).join(keep(ids), KEY, "left_semi")
    return kept.dropDuplicates([*KEY, "text"]).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    # Kept, so that its size is known: texts are not shuffled to be told apart by a short list of ids.
    found = keep(decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return docs.join(found, docs.doc_id.eqNullSafe(found.doc_id), "left_anti").select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``<KIND>`` in place of each span and ``n_chars`` of the new text."""
    masked = docs.withColumn("text", pii.mask("text"))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as ``op7_packing`` gives them."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("pii", mask_personal_data),
    ("packing", packed),
]

#: Fingerprints, regular expressions with checksums and token ids have no SQL form; the tests
#: compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
