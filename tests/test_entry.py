import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "delay_grid" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")], names
assert set(e.oracle_sql()) <= names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(copy / "fleetspark" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    for pipeline in (True, False):  # the pipeline's file may be left or gone
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2000:]


def test_what_a_query_wrote_goes_with_its_result(spark, sf_dir):
    import __spark_entry__ as entry
    from fleetspark.sources import files

    files.clear_landings(spark)
    found = entry.queries()
    there = lambda: {x for x in os.listdir(files.shared(spark)) if x.startswith(("landing-", "fleetspark-"))}
    before = there()
    kept = found["parquet_by_day"](spark, sf_dir)
    found["json_docs"](spark, sf_dir).count()
    assert len(there() - before) == 2
    found["ping_csv_read"](spark, sf_dir).count()
    assert len(there() - before) == 2 and kept.count() > 0  # what is held can still be read
    del kept
    found["feed_profile"](spark, sf_dir).count()
    assert there() == before
