import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, small):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["idx", "label", "score"]
    assert df.count() == spark.read.parquet(f"{small}/embeddings.parquet").count()


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/emberstream", tmp_path / "emberstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_top5' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
