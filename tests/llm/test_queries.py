import pytest

import __spark_entry__
from check import compare, connect
from lotline.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL_TABLES


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", ORACLE)
def test_same_rows_as_sql(spark, name):
    assert compare(spark, SMALL_TABLES, name, connect(SMALL_TABLES)) is None


@pytest.mark.parametrize("name", ["op1_warc", "op4_elias_fano_tokens", "op5_licenses", "op7_packing", "op8_toxicity", "op10_decontamination"])
def test_queries_read_whole_tables(spark, name):
    table = "pages" if name == "op1_warc" else "documents"
    rows = QUERIES[name](spark, SMALL_TABLES)
    known = spark.read.parquet(f"{SMALL_TABLES}/{table}.parquet")
    key = "page_id" if table == "pages" else "doc_id"
    found = rows.select(key).distinct().count()
    assert found == known.count() if name != "op10_decontamination" else 0 < found < known.count()
