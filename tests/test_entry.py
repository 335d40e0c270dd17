"""The entry module stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'G10_refine_geo' in q and set(o) <= set(q) and 'pipeline' not in q; print(len(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
def test_workers_need_no_path(tmp_path):
    """The package on the driver's path only, without the subpackage: functions travel to the workers by value."""
    shutil.copytree(f"{ROOT}/weft", tmp_path / "there" / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path / "there")
    (tmp_path / "here").mkdir()
    code = f"""
import sys
sys.path.insert(0, {str(tmp_path / 'there')!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("T5_top_similar_pairs", "J6_cross_graph_pairs", "X1_online_fixed", "X7_hot_cache", "G2_equivalence_classes"):
    assert e.queries()[name](spark, {SF!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "here", capture_output=True, text=True, env=env)
    assert said.returncode == 0, said.stderr[-3000:]


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/weft"):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as file:
                        assert "weft.llm" not in file.read(), name
