"""The operators of this subpackage, each applied to its whole table, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import (
    alignment,
    decontaminate,
    elias_fano,
    licenses,
    neighbours,
    outliers,
    packing,
    pii,
    simhash,
    substring,
    toxicity,
    warc,
    whitening,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = elias_fano.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source, language and id: ids that end in 00 lie one level below
    the language, those that end in 0 two levels, the others three."""
    hundred, ten = F.expr("doc_id div 100"), F.expr("doc_id div 10")
    folder = F.when(F.expr("doc_id % 100 = 0"), F.array()).when(F.expr("doc_id % 10 = 0"), F.array(hundred)).otherwise(F.array(hundred, ten))
    name = F.concat_ws("/", "source", "lang", F.concat_ws("/", folder.cast("array<string>")), F.col("doc_id").cast("string"))
    path = F.regexp_replace(name, "/+", "/")
    files = _documents(spark, sf_dir).select(path.alias("path"), "text")
    found = licenses.scan(files)
    return found.withColumn("doc_id", F.regexp_extract("path", "[^/]*$", 0).cast("bigint"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_documents(spark, sf_dir), *paths)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_outliers": op2_outliers,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_elias_fano_tokens": op4_elias_fano_tokens,
    "op5_licenses": op5_licenses,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_learned_partitions": op13_learned_partitions,
}

ORACLE: dict[str, str] = {
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
        p AS (
            SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS passage
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
        ),
        f AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS k FROM p),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE k > 1),
        x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN x USING (doc_id)
    """,
}
