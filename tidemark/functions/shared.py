"""Where a job keeps data that every executor must be able to read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a local session (tests) has a fresh temporary
    one; on a cluster, whose executors would not see it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Delete a table of ``keep`` that nothing reads any more. What was made from it must have been kept, too."""
    spark = kept.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {file.rsplit("/", 1)[0] for file in kept.inputFiles()}:
        at(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(folder), True)


def parted(df: DataFrame, *keys: str, size: int = 4 << 20) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its input asks for: the more there is to read (by the plan's
    figure, ``size`` bytes for each), the more tasks, so that what one holds doesn't grow. For joins the plan's figure is a
    product, so the tables that are read bound it."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = min(int(str(plan.stats().sizeInBytes())), sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read // size)), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder (never a local one)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
