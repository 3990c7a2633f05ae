"""Session helpers shared by all operators: table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once a session, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_lexloom_shipped", False):
        return
    package = pathlib.Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lexloom-"), "lexloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, pathlib.Path(package.name) / path.relative_to(package))
    context.addPyFile(archive)
    context._lexloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir; only a local session without one gets its own."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "lexloom-shared")
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage ends there and survives lost executors.

    A table is computed once, where checkpoint() runs its plan twice, and stays column-prunable. The session removes
    its tables when the Python process ends; ``release`` does so earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores before a step that costs much per row: adaptive execution joins partitions by their bytes, and
    would leave few small but costly rows to one task. At least as many partitions as a shuffle has."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(f"`{k}`") for k in keys])


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete all tables written by ``cut``; results that still read them must have been consumed."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is already gone
            return


atexit.register(release)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last delivery by ``order``. Partial aggregation first, so a hot key never sits in one task."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(F.col(f"`{order}`").alias("_o"), *[F.col(f"`{c}`") for c in rest if c != order]))
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(packed.alias("_m"))
    picked: list[Column] = [F.col(f"`{k}`") for k in keys]
    picked += [F.col("_m._o").alias(c) if c == order else F.col("_m").getField(c).alias(c) for c in rest]
    return out.select(*picked).select(*[F.col(f"`{c}`") for c in df.columns])
