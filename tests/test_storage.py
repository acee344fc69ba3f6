import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from lotline.storage import keep, shared_folder


def session_like(spark, master, setting=None, folder=None, warehouse=None):
    values = {"spark.checkpoint.dir": setting, "spark.sql.warehouse.dir": warehouse}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: values[key]),
        sparkContext=SimpleNamespace(master=master, applicationId="app-7", getCheckpointDir=lambda: folder),
        _jvm=spark._jvm,
        _jsc=spark._jsc,
    )


def test_the_named_folder_is_used(spark, tmp_path):
    for setting, folder in ((f"file://{tmp_path}/a", None), (None, f"file:{tmp_path}/a")):
        assert shared_folder(session_like(spark, "spark://host:7077", setting, folder)) == f"file://{tmp_path}/a/kept-app-7"
    assert (tmp_path / "a" / "kept-app-7").is_dir()


def test_one_machines_disk_is_refused_on_a_cluster(spark, tmp_path):
    for warehouse in (f"{tmp_path}/w", f"file:{tmp_path}/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session_like(spark, "spark://host:7077", warehouse=warehouse))
        assert shared_folder(session_like(spark, "local[2]", warehouse=warehouse)) == f"file://{tmp_path}/w/kept-app-7"


def test_nothing_is_left_in_the_named_folder(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from lotline.storage import keep, new_folder\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()\n"
        "assert keep(s.range(3)).count() == 3\n"
        "s.range(2).write.parquet(new_folder(s, 'other'))\n"
        "s.stop()\n"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert [p for p in (tmp_path / "shared").rglob("*") if p.is_file()] == []


def test_without_a_setting_the_folder_is_below_the_warehouse_and_spark_removes_it(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from lotline.storage import keep, shared_folder\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.sql.warehouse.dir', '{tmp_path}').getOrCreate()\n"
        "assert keep(s.range(3)).count() == 3\n"
        "print('FOLDER', shared_folder(s))\n"
        "s.stop()\n"
    )
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "conf").mkdir()
    code = code.replace(str(tmp_path), str(tmp_path / "warehouse"))
    environment = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=root, env=environment, capture_output=True, text=True, check=True
    )
    assert f"FOLDER file:{tmp_path}/warehouse/kept-" in done.stdout.replace("file://", "file:")
    assert list((tmp_path / "warehouse").iterdir()) == []


def test_kept_rows_do_not_depend_on_their_source(spark):
    df = keep(spark.range(10).selectExpr("id * 2 as x"))
    assert df.agg({"x": "sum"}).first()[0] == 90
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
