"""The driver's entry points, with and without the corpus operators."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from panemill.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["window_id", "window_start", "window_end", "function_id", "key", "value"] and rows.count() > 0


def test_every_query_has_a_name_and_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


#: Queries of whose kind another one is run: they only take time.
OTHERS = {f"tumbling_{f}" for f in ("min", "max", "m_sum", "m_avg", "m_median")} | {f"stream_{x}" for x in ("count_window", "count_avg_median", "count_by_time_per_key", "own_holistic", "multi_window")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHERS))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = sorted(map(tuple, QUERIES[name](spark, DATA).select(*columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str) and got


def test_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("__spark_entry__.py", "panemill"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(root, "__spark_entry__.py")).read())
    (tmp_path / "panemill").mkdir()
    for name in os.listdir(os.path.join(root, "panemill")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "panemill", name), tmp_path / "panemill" / name)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()); assert not any(q.startswith('op') and q[2].isdigit() for q in e.queries()); print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_with_an_import_of_theirs_that_fails(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 40 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
