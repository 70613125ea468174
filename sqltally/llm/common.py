"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from sqltally.session import checkpoint_dir, scratch_path, table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared scratch folder, in a folder for each value of ``by``, and read back.

    Cuts the lineage with files that every executor can read, so that a lost
    executor never costs more than the tasks that were running on it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of queries that have ended, which it does once the driver's JVM collects them."""
    spark._jvm.System.gc()


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


STEP_ROWS = 1024  # rows handled at once in Python: bounds what a worker holds next to its Arrow batch


def add_column(df: DataFrame, name: str, kind: DataType, f: Callable[[pa.Array], pa.Array], source: str) -> DataFrame:
    """``df`` with a column that ``f`` makes, batch by batch, from column ``source``.

    The other columns pass as Arrow data, with their exact values and nulls; a
    column of the same name is replaced.
    """
    fields = [x for x in df.schema.fields if x.name.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for part in (b.slice(k, STEP_ROWS) for k in range(0, b.num_rows, STEP_ROWS)):
                made = f(part.column(names.index(source)))
                yield pa.RecordBatch.from_arrays([part.column(names.index(x.name)) for x in fields] + [made],
                                                 names=[x.name for x in fields] + [name])

    return df.mapInArrow(run, StructType(fields + [StructField(name, kind)]))
