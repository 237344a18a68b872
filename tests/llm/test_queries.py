"""The registered queries on whole tables against SQL or brute force."""

import importlib.util

import pytest

import __spark_entry__ as E
from checks.compare import compare, duck
from perkframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = duck(SF).execute(Q.ORACLE_SQL[name]).df()
    assert compare(got, want) is None


def test_entry_lists_every_operator_and_the_pipeline():
    names = set(E.queries())
    assert set(Q.QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_entry_without_the_subpackage(tmp_path):
    """The other queries are there when this subpackage and the pipeline aren't."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(importlib.util.find_spec("__spark_entry__").origin)
    for part in ("perkframe", "checks"):
        shutil.copytree(f"{root}/{part}", tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    n, has, m = done.stdout.split()
    assert has == "False" and n == str(len(E._QUERIES)) and m == str(len(E._oracles()))
