"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set a local session gets a temporary one, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so a lost executor costs
    a reread and never a recomputation that might number rows otherwise."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[made] = [path]
    release(spark)
    return made


def release(spark: SparkSession) -> None:
    """Let the driver collect what nothing refers to: Spark then deletes the shuffle files of finished steps, which
    would stay on the executors' disks until the driver's memory happened to fill."""
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written(), or all that a result of depends() reads, which nothing reads any more."""
    for df in tables:
        for path in _paths.pop(df, ()):
            drop_path(df.sparkSession, path)


def depends(made: DataFrame, *tables: DataFrame) -> DataFrame:
    """made, of which drop() deletes these written tables; they are not dropped by themselves any more."""
    _paths[made] = [path for df in tables for path in _paths.pop(df, ())]
    return made


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shuffle_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
