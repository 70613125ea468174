"""Table profiling.

* :func:`profile_columns` - one row per column: type, nullability, comment.
* :func:`column_examples` - up to ``k`` distinct example values per column.
* :func:`clean_examples` - the example-cleaning rules of the schema text.
* :func:`check_primary_keys`, :func:`check_foreign_keys` - declared keys,
  validated against the data (Parquet carries no constraints).
* :func:`schema_check` - bulk existence test of table/column references.

Examples are the ``k`` smallest distinct non-NULL, non-empty values of each
column in its natural order (deterministic, unlike "any k").  A full shuffle
of distinct values would move about the whole table, so each input partition
first keeps only its own ``k`` smallest distinct values per column (Arrow
compute inside ``mapInArrow``, one pass, no Python per row); only those
``k * columns * partitions`` rows are shuffled and merged with a window.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions.text import has_url, is_email
from sqltally.sources.stored import add_to_store, read_store, table_files, written_once

ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType,
          T.TimestampNTZType, T.BinaryType)


def simple_type(dtype: T.DataType) -> str:
    """Type name without precision, upper case (``decimal(10,2)`` -> ``DECIMAL``)."""
    return dtype.simpleString().split("(")[0].upper()


def profile_columns(spark: SparkSession, db_id: str, tables: dict,
                    comments: dict | None = None) -> DataFrame:
    """``db_id, table_name, position, column_name, type, full_type,
    nullable, default, comment`` from the schemas (no data is read)."""
    comments = comments or {}
    rows = []
    for tname in sorted(tables):
        for pos, f in enumerate(tables[tname].schema.fields):
            c = comments.get((tname, f.name), f.metadata.get("comment", "")) or ""
            rows.append((db_id, tname, pos, f.name, simple_type(f.dataType),
                         f.dataType.simpleString().upper(), f.nullable, f.metadata.get("CURRENT_DEFAULT"), c.strip()))
    schema = ("db_id string, table_name string, position int, column_name string, type string, "
              "full_type string, nullable boolean, default string, comment string")
    return spark.createDataFrame(rows, schema)


def table_comments(spark: SparkSession, db_id: str, tables: dict,
                   comments: dict | None = None) -> DataFrame:
    """A blank comment where none is known."""
    comments = comments or {}
    rows = [(db_id, t, (comments.get(t) or "").strip()) for t in sorted(tables)]
    return spark.createDataFrame(rows, "db_id string, table_name string, comment string")


STEP_BYTES = 4 << 20  # of a column, looked at in one step


def _local_smallest(k: int, string_cols: set, by_file: bool = False):
    """Keeps the k smallest distinct values of each column of a partition, or of
    each file in it (``by_file``: the last column names the file; a partition's
    rows come file by file)."""
    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        best: dict = {}
        schema = file = rb = None

        def smallest(i, column, text):
            """Takes a column into ``best``, some megabytes at a time: each step copies what it looks at."""
            step = max(1, len(column) * STEP_BYTES // max(column.nbytes, 1))
            for at in range(0, len(column), step):
                arr = column.slice(at, step).drop_null()
                if text:
                    arr = arr.filter(pc.not_equal(arr, ""))
                found = best.get(i)
                if found is not None:
                    if len(found) == k > 0 and not (pa.types.is_floating(found.type) and pc.is_nan(found[k - 1]).as_py()):
                        arr = arr.filter(pc.less(arr, found[k - 1]))
                    if not len(arr):
                        continue
                    arr = pa.concat_arrays([found, arr])
                u = pc.unique(arr)
                best[i] = u.take(pc.array_sort_indices(u)[:k])

        def held():
            names = schema.names + ["__pos"]
            for i, vals in best.items():
                n = len(vals)
                if n:
                    cols = [vals if j == i else pa.nulls(n, type=f.type) for j, f in enumerate(schema)]
                    if by_file:
                        cols[-1] = pa.array([file] * n, schema.types[-1])
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([i] * n, type=pa.int32())], names=names)
            if by_file and file is not None:  # a file is known, whether it has examples or not
                cols = [pa.nulls(1, type=t) for t in schema.types[:-1]]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([file], schema.types[-1]), pa.array([-1], pa.int32())], names=names)

        for whole in batches:
            schema = whole.schema
            cuts = [0, whole.num_rows]
            if by_file:
                runs = pc.run_end_encode(whole.column(whole.num_columns - 1)) if whole.num_rows else None
                cuts = [0, *(runs.run_ends.to_pylist() if runs is not None else [])]
            for p, q in zip(cuts[:-1], cuts[1:]):
                rb = whole.slice(p, q - p)
                if by_file and rb.column(rb.num_columns - 1)[0].as_py() != file:
                    yield from held()
                    best, file = {}, rb.column(rb.num_columns - 1)[0].as_py()
                for i, name in enumerate(schema.names[:-1] if by_file else schema.names):
                    smallest(i, rb.column(i), name in string_cols)
            whole = rb = None  # or the next batch is read while this one is still held
            pa.default_memory_pool().release_unused()
        if schema is not None:
            yield from held()
    return fn


def _sort_keys(c, dtype):
    """Order keys: exact integers / day / microsecond numbers, doubles, text."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("decimal(38,0)"), None, None
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("decimal(38,0)"), None, None
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("decimal(38,0)"), None, None
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("decimal(38,0)"), None, None
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return None, c.cast("double"), None
    if isinstance(dtype, T.DecimalType):  # values that share a double stay apart by their digits
        return None, c.cast("double"), c.cast("string")
    if isinstance(dtype, T.BinaryType):
        return None, None, F.hex(c)
    return None, None, c.cast("string")


def example_text(c, dtype):
    """The text an example value is shown as (decimal via float, as the kit)."""
    if isinstance(dtype, T.DecimalType):
        return c.cast("double").cast("string")
    return c.cast("string")


_STATE = ("j int, k_int decimal(38,0), k_dbl double, k_str string, value string")


def _example_fields(df: DataFrame) -> list:
    return [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, ATOMIC)]


def _example_state(df: DataFrame, k: int, by_file: bool = False) -> DataFrame:
    """(j, k_int, k_dbl, k_str, value[, file]): the k smallest values of each partition or file; j counts the atomic columns."""
    fields = _example_fields(df)
    pruned = df.select(*[F.col(f"`{f.name}`") for _, f in fields],
                       *([F.col("_metadata.file_path").alias("__file")] if by_file else []))
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pruned.schema.fields]
                              + [T.StructField("__pos", T.IntegerType(), False)])
    strings = {f.name for _, f in fields if isinstance(f.dataType, T.StringType)}
    local = pruned.mapInArrow(_local_smallest(k, strings, by_file), out_schema)

    def pick(make):
        expr = None
        for j, (_, f) in enumerate(fields):
            v = make(F.col(f"`{f.name}`"), f.dataType)
            if v is None:
                continue
            expr = F.when(F.col("__pos") == j, v) if expr is None else expr.when(F.col("__pos") == j, v)
        return expr if expr is not None else F.lit(None)

    return local.select(
        F.col("__pos").alias("j"),
        pick(lambda c, t: _sort_keys(c, t)[0]).cast("decimal(38,0)").alias("k_int"),
        pick(lambda c, t: _sort_keys(c, t)[1]).cast("double").alias("k_dbl"),
        pick(lambda c, t: _sort_keys(c, t)[2]).cast("string").alias("k_str"),
        pick(example_text).cast("string").alias("value"), *([F.col("__file").alias("file")] if by_file else []))


def _ranked_examples(tables: list, state: DataFrame, k: int) -> DataFrame:
    """The k smallest values of each column; ``tables`` are (db_id, name, DataFrame), ``state`` has the number ``t`` of each."""
    spark, rows = state.sparkSession, []
    for t, (db_id, name, df) in enumerate(tables):
        rows += [(t, j, db_id, name, i, f.name, simple_type(f.dataType)) for j, (i, f) in enumerate(_example_fields(df))]
    columns = spark.createDataFrame(rows, "t int, j int, db_id string, table_name string, position int, column_name string, type string")
    w = Window.partitionBy("t", "j").orderBy("k_int", "k_dbl", "k_str")
    ranked = (state.dropDuplicates(["t", "j", "k_int", "k_dbl", "k_str"])
              .withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k))
    return ranked.join(columns, ["t", "j"]).select("db_id", "table_name", "position", "column_name", "type", "rank", "value")


def column_examples(db_id: str, table_name: str, df: DataFrame, k: int = 5) -> DataFrame:
    """``db_id, table_name, position, column_name, type, rank, value``.

    Complex-typed columns (arrays, maps, structs) get no examples.
    """
    if not _example_fields(df):
        return df.sparkSession.createDataFrame(
            [], "db_id string, table_name string, position int, column_name string, type string, "
                "rank int, value string")
    return _ranked_examples([(db_id, table_name, df)], _example_state(df, k).withColumn("t", F.lit(0)), k)


def stored_examples(databases: dict, store: str, k: int = 5) -> DataFrame:
    """P3 + P12 + S8: the examples of all tables of ``{db_id: {table: DataFrame}}``, kept file by file under ``store``.

    A file's smallest values are kept with its size and time of change, so only
    files that are new or have changed are read; files that are gone no longer
    count.  The tables must be read from Parquet files.
    """
    tables = [(d, t, databases[d][t]) for d in sorted(databases) for t in sorted(databases[d])]
    spark = tables[0][2].sparkSession
    kinds = [hashlib.sha256(f"{d}|{t}|{df.schema.json()}|{k}".encode()).hexdigest()[:16] for d, t, df in tables]
    schema = T._parse_datatype_string(_STATE + ", kind string, file string, size bigint, changed timestamp")
    key = ["kind", "file", "size", "changed"]
    files = None
    for t, (_, _, df) in enumerate(tables):
        if _example_fields(df):
            f = table_files(df).select(F.lit(t).alias("t"), F.lit(kinds[t]).alias("kind"), "file", "size", "changed")
            files = f if files is None else files.unionByName(f)
    files = written_once(files, "table-files")
    new: dict = {}
    for r in files.join(read_store(spark, store, schema).select(key), key, "left_anti").collect():
        new.setdefault(r.t, []).append(r.file)
    states = None
    for t, names in new.items():
        s = _example_state(spark.read.schema(tables[t][2].schema).parquet(*names), k, by_file=True).withColumn("kind", F.lit(kinds[t]))
        states = s if states is None else states.unionByName(s)
    if states is not None:
        add_to_store(states.join(files.drop("t"), ["kind", "file"]).select([f.name for f in schema]), store)
    kept = read_store(spark, store, schema).join(files, key).where("j >= 0")
    return _ranked_examples(tables, kept, k)


def database_examples(db_id: str, tables: dict, k: int = 5) -> DataFrame:
    """P3 + P12 for every table of one database."""
    out = None
    for t in sorted(tables):
        e = column_examples(db_id, t, tables[t], k)
        out = e if out is None else out.unionByName(e)
    return out


DATE_TYPES = ("DATE", "TIME", "DATETIME", "TIMESTAMP", "TIMESTAMP_NTZ")


def clean_examples(examples: DataFrame) -> DataFrame:
    """The kit's example rules, per column over its ranked examples.

    Date/time columns keep only their first example; a column with any
    e-mail address or ``http://``/``https://`` link shows none; empty texts
    are dropped; decimals were already rendered through a float.
    Output keeps ``rank`` order; dropped columns have no rows.
    """
    key = ["db_id", "table_name", "column_name"]
    w = Window.partitionBy(*key)
    bad = (is_email(F.col("value")) | has_url(F.col("value"))).cast("int")
    e = examples.filter(F.length("value") > 0) \
                .withColumn("_bad", F.max(bad).over(w)) \
                .withColumn("_first", F.min("rank").over(w))
    is_date = F.col("type").isin(*DATE_TYPES)
    keep = (F.col("_bad") == 0) & (~is_date | (F.col("rank") == F.col("_first")))
    return e.filter(keep).drop("_bad", "_first")


def check_primary_keys(tables: dict, declared: list[tuple[str, list[str]]]) -> DataFrame:
    """For each declared key ``(table, [columns])``: key values occurring
    more than once, rows with a NULL key part, and whether the key holds.

    One partial-aggregating shuffle on the key per table; NULL keys form one
    group and are counted, not compared.
    """
    out = None
    for tname, cols in declared:
        any_null = F.lit(False)
        for c in cols:
            any_null = any_null | F.col(c).isNull()
        per_key = tables[tname].groupBy(*cols).agg(F.count(F.lit(1)).alias("m"))
        summary = per_key.agg(
            F.count_if(~any_null & (F.col("m") > 1)).alias("n_duplicate_keys"),
            F.coalesce(F.sum(F.when(any_null, F.col("m"))), F.lit(0)).alias("n_null_rows"))
        summary = summary.select(
            F.lit(tname).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
            F.col("n_duplicate_keys").cast("bigint").alias("n_duplicate_keys"),
            F.col("n_null_rows").cast("bigint").alias("n_null_rows"),
            ((F.col("n_duplicate_keys") == 0) & (F.col("n_null_rows") == 0)).alias("holds"))
        out = summary if out is None else out.unionByName(summary)
    return out


def check_foreign_keys(tables: dict, declared: list[tuple[str, str, str, str]]) -> DataFrame:
    """For each ``(table, column, ref_table, ref_column)``: child rows whose
    non-NULL value has no parent.

    Child values are first counted per value (a partial aggregation, so a
    value held by a large share of the rows collapses map-side), then the
    distinct values are anti-joined with the parent keys and their counts
    summed.  AQE turns the join into a broadcast only when a side is measured
    small.
    """
    out = None
    for t, c, rt, rc in declared:
        child = (tables[t].select(F.col(c).alias("k")).filter(F.col("k").isNotNull())
                 .groupBy("k").agg(F.count(F.lit(1)).alias("m")))
        parent = tables[rt].select(F.col(rc).alias("k"))
        orphans = child.join(parent, "k", "left_anti").agg(
            F.coalesce(F.sum("m"), F.lit(0)).alias("n_orphans"))
        row = orphans.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
                             F.lit(rt).alias("ref_table"), F.lit(rc).alias("ref_column"),
                             F.col("n_orphans").cast("bigint").alias("n_orphans"),
                             (F.col("n_orphans") == 0).alias("holds"))
        out = row if out is None else out.unionByName(row)
    return out


def schema_check(columns: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs(table_name, column_name)`` -> ``has_table, has_column``
    (case-sensitive as the kit's dictionary lookups)."""
    tabs = columns.select("table_name").distinct().withColumn("_t", F.lit(True))
    cols = columns.select("table_name", "column_name").withColumn("_c", F.lit(True))
    return (refs.join(tabs, "table_name", "left")
            .join(cols, ["table_name", "column_name"], "left")
            .select("table_name", "column_name",
                    F.coalesce("_t", F.lit(False)).alias("has_table"),
                    F.coalesce("_c", F.lit(False)).alias("has_column")))
