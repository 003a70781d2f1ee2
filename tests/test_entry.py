"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_registry(spark, data):
    runs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(runs) and "three_way_presence" in runs
    df = entry.entry(spark)
    assert df.columns == ["path", "outcome"] and df.count() > 0


def test_it_imports_without_the_subpackage(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"], cwd=copy, capture_output=True, text=True, check=True)
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 40
