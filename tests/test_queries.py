"""Every registered query: equal to its SQL, and a plan that stays distributed and in the JVM."""

from __future__ import annotations

import contextlib
import io

import pytest

from __spark_entry__ import entry
from cohortflow.plans.oracles import ORACLES
from cohortflow.plans.queries import QUERIES
from tests.oracle_check import compare, connect

# Plan nodes that multiply inputs or leave the JVM.
ALONE = "SinglePartition"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"]


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert not [node for node in FORBIDDEN if node in plan]
    if "alarm" in name:
        assert ALONE not in plan
    sql = ORACLES.get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, connection, sql) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["location", "high_value_user", "n_users", "avg_engagement"]


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("review_profile_bulk", ["l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]),
        ("metric_windows", ["ts", "event_type", "value"]),
        ("user_base", ["o_custkey", "o_totalprice"]),
    ],
)
def test_scan_reads_only_needed_columns(spark, sf_dir, name, columns):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    schemas = [line.split("struct<")[1].rstrip(">") for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert any(sorted(part.split(":")[0] for part in schema.split(",")) == sorted(columns) for schema in schemas)
