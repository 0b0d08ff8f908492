"""Shared-folder handling: where intermediate tables are written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, because there driver and executors share
    one machine.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(table: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores enough tasks for heavy work.

    A small file is often one row group, hence one task however many splits are
    planned.  A large table has more splits than cores and is left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if table.rdd.getNumPartitions() < cores else table


def materialize(df: DataFrame, label: str = "stage", heavy: bool = False, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a cache it survives lost executors, and unlike an RDD checkpoint it
    keeps column pruning and gives the optimizer real sizes.  ``heavy`` says
    that costly per-row work follows; ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return spread(table) if heavy else table


def discard(table: DataFrame, label: str) -> None:
    """Delete a table that ``materialize`` wrote under this label, once nothing reads it any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        if folder.getName().startswith(f"{label}-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
