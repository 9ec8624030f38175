"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ASCII white space [\x20\x09-\x0D].
BLANK = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id: it sorts behind every other id.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a temporary
    folder that ends with the process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/frameloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, tag: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def save_bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> tuple[DataFrame, str, str]:
    """Write a table in buckets of ``key`` to the shared folder, so that later joins on it don't move it. Returns it with its name and path."""
    spark = df.sparkSession
    name, path = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}", new_path(spark, tag)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name, path


def drop_bucketed(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, path)


def tidy(spark: SparkSession) -> None:
    """Have the driver forget what nothing refers to any more: Spark then deletes the shuffle files of jobs that are done."""
    gc.collect()
    spark._jvm.System.gc()


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def text_key(c: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(c).alias("_t1"), F.xxhash64(F.lit(1), c).alias("_t2")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
