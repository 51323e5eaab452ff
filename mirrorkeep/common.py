"""Small helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Optional leading columns of every inventory table. When a table carries
# them, every grouping and join is done within one cluster and one snapshot.
SCOPE = ("cluster", "snapshot_ts")

# The collection every cluster creates by itself, and the text
# that stands for "this shard has no leader".
DEFAULT_COLLECTION = "collection1"
NO_LEADER = "NO_LEADER"


def scoped(df: DataFrame, *keys: str) -> list[str]:
    """The keys, led by the scope columns this table has."""
    return [c for c in SCOPE if c in df.columns] + list(keys)


def shared_scope(left: DataFrame, right: DataFrame, *keys: str) -> list[str]:
    """The keys, led by the scope columns both tables have."""
    return [c for c in SCOPE if c in left.columns and c in right.columns] + list(keys)


def blank(col: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(col, F.lit("")).rlike(r"\S")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares between its executors.

    The folder comes from ``spark.checkpoint.dir``. Only a local session, where driver and executors are one
    process, may do without: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="mirrorkeep-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, wherever the cluster keeps it."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which ends its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
