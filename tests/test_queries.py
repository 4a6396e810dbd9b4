"""Every query with SQL agrees with DuckDB; every other one gives rows."""

import math
import os

import duckdb
import pytest

from panelflow.plans import registry

SF = "/root/testdata/sf0.001"
#: On the smallest tables these panels are too sparse or short for a row.
MAY_BE_EMPTY = {"stress_islands", "monitor_spikes", "regime_changes", "isolated_nodes", "te_by_regime", "tradable_board", "coverage_filter"}


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = db.sql(registry.SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted([plain(row[i]) for i in at] for row in relation.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == want
    assert want or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_a_broken_operator_is_not_taken_for_a_missing_one(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    shutil.copytree(f"{root}/panelflow", tmp_path / "panelflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "a_library_that_is_not_there" in done.stderr


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/panelflow", tmp_path / "panelflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'te_matrix' in q and 'te_matrix' in o and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
