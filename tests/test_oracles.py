"""Every core query beside its SQL on the smallest tables, and the driver's contract."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="no test tables here")


def test_queries_equal_their_sql():
    from lanternq.plans import queries

    names = sorted(queries.queries())
    run = subprocess.run([sys.executable, "tools/oracle.py", FOLDER, *names], cwd=os.path.dirname(entry.__file__), env=os.environ | {"BENCH_CPUS": "4"}, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-3000:]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_logged_lists_are_ranked_for_their_questions_only(spark):
    from lanternq.plans import queries

    q = spark.createDataFrame([(100,), (200,)], "query_id long")
    some = queries.logged(spark, FOLDER, q)
    assert "left_semi" in some._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in queries.logged(spark, FOLDER).where("query_id in (100, 200)").collect())


WHOLE = ["rerank_features", "reranked", "reranked_none", "extractive_answers", "guarded", "prompts", "hybrid_retrieval", "ask_many"]


@pytest.mark.parametrize("name", WHOLE)
def test_every_question_is_asked(spark, name):
    asked = {r["answer_id"] for r in spark.read.parquet(f"{FOLDER}/answers.parquet").where("question is not null").select("answer_id").collect()}
    found = entry.queries()[name](spark, FOLDER).select("query_id").distinct().collect()
    assert {r["query_id"] for r in found} <= asked and len(found) > 0.95 * len(asked)
