"""A spread of registered queries against their SQL; tools/check.py runs all of them."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from taxalign.catalog import registry
from tests.conftest import SF
from tools.check import canonical

TABLES = "region nation customer supplier part orders lineitem documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("left_out", [("taxalign/llm", "tests/llm", "corpus_pipeline.py"), ("taxalign/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, left_out):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(root)) in left_out])
    says = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", says], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.SQL)), "False"], done.stderr


@pytest.mark.parametrize("name", "clean_checklist parse_names compare_in_tree candidate_matches_homonym estimates merged_tree alignment describe_changes dump_to_checklist".split())
def test_query_equals_sql(spark, con, name):
    got = canonical(entry.queries()[name](spark, SF).toPandas())
    want = canonical(con.sql(entry.oracle_sql()[name]).df())
    assert len(got) > 0 and got.equals(want)


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 8
