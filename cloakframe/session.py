"""Session helpers of the library."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Spark's own switch for deleting a query's shuffle files as soon as the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this session import the package when it isn't installed on their side."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. Where that is unset, a session in one process
    takes the warehouse's folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files: what they wrote is read from then on."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return _at(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """As written(), in as many buckets of column `by` as the session has shuffle partitions: joins and aggregations on
    `by` read them without a shuffle. df is expected to be partitioned by `by` already."""
    spark = df.sparkSession
    path, table = shared_dir(spark, name), f"cf_{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # the name only: the files are external, and `out` knows their buckets
    return _at(out, path)


def _at(df: DataFrame, path: str) -> DataFrame:
    df._cf_folder = path
    return df


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cf_folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Tables of at most so many bytes, by Spark's estimate, are dealt to all cores before costly work on each row.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: a file of one row group is one task otherwise. Larger tables come in many splits and are left
    as they are, so that never more than SMALL_BYTES are shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df
