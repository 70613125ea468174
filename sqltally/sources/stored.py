"""Stores that grow: tables kept under one folder, a finished write at a time.

Each addition is a folder of its own and counts from the moment its write is
finished, so that a reader never sees half of it and a lost job leaves nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.session import scratch_path


def read_store(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All finished additions; none yet: no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    parts = sorted(x.getPath().getParent().toString() for x in found or [])
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def add_to_store(rows: DataFrame, root: str) -> None:
    rows.write.parquet(f"{root}/{uuid.uuid4().hex}")


def table_files(df: DataFrame) -> DataFrame:
    """(file, size, changed) of the files a table is read from; of the data only row counts are read."""
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("file"), m["file_size"].alias("size"),
                     m["file_modification_time"].alias("changed")).distinct()


def files_version(frames: list[DataFrame]) -> str:
    """A digest of the files, sizes and times of several tables: another one as soon as a file changes."""
    one = None
    for i, df in enumerate(frames):
        each = table_files(df).agg(F.count("*").alias("n"), F.sum(F.xxhash64("file", "size", "changed").cast("decimal(38,0)")).alias("a"),
                                   F.sum(F.xxhash64("changed", "size", "file").cast("decimal(38,0)")).alias("b")).select(F.lit(i).alias("i"), "*")
        one = each if one is None else one.unionByName(each)
    return hashlib.sha256(repr(sorted(map(tuple, one.collect()))).encode()).hexdigest()[:16]


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back: made once, however often it is used."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
