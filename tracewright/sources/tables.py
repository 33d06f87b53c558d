"""Reading tables and the few session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``base``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages: the one the session names in ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder; on a cluster that would lose data, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    set_before = context._jsc.sc().getCheckpointDir()
    if not named and set_before.isDefined():
        named = set_before.get()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tracewright-checkpoints")
    return named


def prepare(spark: SparkSession) -> SparkSession:
    """A session in UTC that knows this package and the shared folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    if not getattr(context, "_tracewright_sent", False):
        # Python workers need this package; it travels with the job like any other dependency.
        package = Path(__file__).resolve().parents[1]
        to = tempfile.mkdtemp(prefix="tracewright-")
        context.addPyFile(shutil.make_archive(os.path.join(to, "tracewright"), "zip", package.parent, package.name))
        context._tracewright_sent = True
    return spark


def new_folder(spark: SparkSession) -> str:
    """A fresh name in the shared folder; all of an application's are deleted when its driver ends."""
    context = spark.sparkContext
    own = f"{shared_folder(spark)}/tracewright-{context.applicationId}"
    if not getattr(context, "_tracewright_folder", False):
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._tracewright_folder = True
    return f"{own}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder, so that its lineage isn't run twice and a lost executor costs nothing.

    Parquet, so that later reads take only their columns and joins know its size.
    """
    spark = prepare(df.sparkSession)
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, before costly work in Python.

    Only tables in a few files that can't be split are shuffled for it; at any real size the scan has more partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean_key(column: str):
    """An identifier without regard to case and outer blanks; blank ones become null."""
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))
