from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortflow import session


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def stub(master, conf=None, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf or default), sparkContext=Context(master, folder))


def test_scratch_folder_comes_from_the_session():
    assert session._scratch_root(stub("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session._scratch_root(stub("spark://host:7077", None, "hdfs:///other")) == "hdfs:///other"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._scratch_root(stub("spark://host:7077"))
    local = stub("local[2]")
    assert session._scratch_root(local) == local.sparkContext.folder


def test_lookup_side_checks_the_size(spark):
    df = spark.range(50).select("id", F.struct("id").alias("s"))
    big = spark.range(1000).select(F.col("id") % 50)
    assert session.bounded_rows(df, 49) is None and len(session.bounded_rows(df, 50)) == 50
    assert session.lookup_side(df, 49) is df
    small = session.lookup_side(df, 50)
    assert small.schema == df.schema and sorted(small.collect()) == sorted(df.collect())
    assert big.withColumnRenamed("(id % 50)", "id").join(small, "id").count() == 1000


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("s"))
    stored = session.materialize(df, "t")
    assert stored.schema.names == df.schema.names and stored.exceptAll(df).count() == 0


def test_a_scope_leaves_nothing_behind(spark, tmp_path):
    with session.scratch_scope(spark) as path:
        kept = session.materialize(spark.range(10), "numbers")
        kept.write.parquet(str(tmp_path / "result"))
        assert os.listdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
    assert spark.read.parquet(str(tmp_path / "result")).count() == 10
