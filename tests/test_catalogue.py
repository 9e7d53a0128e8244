"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.plans import catalogue
from spanloom.sources import tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = oracle.sql(sql)
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[k]) for k in places)) for r in want.fetchall())


def test_entry_imports_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/spanloom", f"{tmp_path}/spanloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", ["entity_report", "gateway_echo", "mode_blackout", "mode_mapping", "vault_rows", "name_runs", "sanitize_email_roundtrip"])
def test_passes_run_once_after_the_rows_are_dealt(spark, monkeypatch, name):
    """Filters on what an Arrow pass makes neither repeat it nor move it below the repartition of a small table."""
    monkeypatch.setattr(tables, "SPREAD_FROM", 0)
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(plan) if "Repartition 4, true" in line]
    assert dealt
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k in dealt:
        for line in plan[k + 1 :]:
            if depth(line) <= depth(plan[k]):
                break
            assert "EvalPython" not in line
    if name in ("entity_report", "vault_rows", "mode_mapping"):
        assert sum("EvalPython" in line for line in plan) == 1


@pytest.mark.parametrize("name", [n for n in sorted(catalogue.queries()) if n.startswith("mode_")])
def test_modes_search_and_replace_in_one_pass(spark, name):
    """A task has one Python worker, and what leaves it is the text alone."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and "members" not in plan


def test_document_spans_in_runs_too_long_for_a_card(spark, tmp_path):
    texts = ["+1 (836) 555-9331 4913187196670932 53.121.55.90", "4000 0000 0000 0010 12345", "x 4000 0000 0000 0010 y", None, "1 22-4913187196670932 4111111111111111"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, detector, value, n from ({catalogue.oracle_sql()['document_spans']})").fetchall()
    got = catalogue.queries()["document_spans"](spark, str(tmp_path)).select("doc_id", "detector", "value", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5


def test_detector_counts_take_one_worker_and_equal_the_two_steps(spark):
    from pyspark.sql import functions as F

    from spanloom.operators.detect import detect
    from spanloom.operators.kernel import resolved

    made = catalogue.queries()["document_detector_counts"](spark, SF)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
    two = resolved(detect(tables.table(spark, SF, "documents").select("doc_id", "text")), use_names=False).selectExpr("inline(resolved)")
    want = two.groupBy("entity_type", "detector").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
