from types import SimpleNamespace as Some

import pytest
from pyspark.sql import functions as F

from tracewright.sources import tables


def session(master, conf=None, context_conf=None, set_before=None):
    there = Some(isDefined=lambda: set_before is not None, get=lambda: set_before)
    context = Some(master=master, getConf=lambda: Some(get=lambda k, d: context_conf), _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: there)))
    return Some(sparkContext=context, conf=Some(get=lambda k, d: conf))


def test_the_shared_folder():
    assert tables.shared_folder(session("spark://x", conf="s3://c")) == "s3://c" and tables.shared_folder(session("yarn", context_conf="d")) == "d"
    assert tables.shared_folder(session("yarn", set_before="e")) == "e" and "tracewright" in tables.shared_folder(session("local[4]"))
    for master in ("yarn", "spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            tables.shared_folder(session(master))


def test_settled_tables(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}, [("x", 2.0)]), (None, "t", None, None)], "i long, s string, m map<string,int>, a array<struct<n:string,v:double>>")
    kept = tables.settled(df)
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect())) and kept.columns == df.columns
    assert "Parquet" in kept._jdf.queryExecution().toString() or "parquet" in kept._jdf.queryExecution().toString()
    empty = tables.settled(df.where("i > 5"))
    assert empty.count() == 0 and empty.schema == kept.schema


def test_keys(spark):
    got = [r[0] for r in spark.createDataFrame([(" A ",), ("",), ("  ",), (None,)], "k string").select(tables.clean_key("k")).collect()]
    assert got == ["a", None, None, None] and tables.spread(spark.range(10).coalesce(1)).select(F.spark_partition_id()).distinct().count() >= 1
