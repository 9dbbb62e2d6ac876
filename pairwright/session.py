"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*", memory: str = "8g", partitions: int = 8, shared: str = "file:/tmp/pairwright-scratch"
) -> SparkSession:
    """Session for tests and local runs; a cluster brings its own.

    All tasks run on this machine, so a folder of it is shared by them.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairwright")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor sees.

    It lies under ``spark.checkpoint.dir``, or under the warehouse where that is unset, in
    one folder per application, which :func:`clear_scratch` removes.
    """
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has written, once no frame that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Has Spark remove the shuffle files of a query as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(spark: SparkSession, df, label: str):
    """Cut the lineage of ``df`` with a table in the shared folder and read it back.

    The shuffle files of the write are removed when it ends: nothing reads them behind the cut,
    and else they lie beside those of the next steps until the driver collects its garbage.
    """
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
