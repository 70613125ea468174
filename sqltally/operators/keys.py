"""Keys, references, defaults and counters found in the data.

Parquet carries no constraints, so what a database would declare is looked for
in the rows:

* :func:`candidate_keys` - minimal unique column sets, level by level;
* :func:`inclusion_dependencies` - columns whose values all occur in a key
  column, which is what a foreign key needs;
* :func:`column_defaults` - a declared default, else a value that most rows
  hold; and whether a column counts up in equal steps.

Column statistics (one row a column) are decided on the driver; rows never are.
Text values are compared by their MD5, so that long ones don't travel.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.operators.profile import ATOMIC

ERROR = 0.02  # relative standard error of distinct counts
SLACK = 0.2  # a set is ruled out where its estimate is so far below the rows: ten standard errors
MANY_ROWS = 500_000  # from so many on, a set is looked at in one of PARTS parts of its values before all are counted
PARTS = 64
TRACKED = 32  # values a heavy-hitter sketch holds; more than half of the rows can't escape it

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FAMILIES = [(_INTEGERS, "n"), ((T.StringType,), "s"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "t"), ((T.DecimalType,), "d")]


def _atomic(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, ATOMIC)]


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _short(f: T.StructField) -> Column:
    """The value, or the digest of a text."""
    return F.unhex(F.md5(_col(f.name))) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else _col(f.name)


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(21,0)")


def _by_column(df: DataFrame, table: str, measures: dict, kind: str) -> DataFrame:
    """One pass: for each column name its struct of measures, as rows of (table_name, column_name, ``kind``)."""
    one = df.agg(*[F.struct(*m).alias(f"c{i}") for i, m in enumerate(measures.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("m")) for i, c in enumerate(measures)])
    return one.select(F.lit(table).alias("table_name"), F.explode(rows).alias("r")).select(
        "table_name", "r.column_name", F.from_json(F.to_json("r.m"), kind).alias("m")).select("table_name", "column_name", "m.*")


def union_all(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def column_statistics(tables: dict, counts_only: bool = False) -> list:
    """Rows (table_name, column_name, n, filled, distinct, low, high, top): one pass over each table.

    ``counts_only``: up to distinct, which is all that keys need.
    """
    frames = []
    for t, df in tables.items():
        measures = {}
        for f in _atomic(df):
            whole = isinstance(f.dataType, _INTEGERS)
            measures[f.name] = [
                F.count(F.lit(1)).alias("n"), F.count(_col(f.name)).alias("filled"),
                F.approx_count_distinct(_short(f), ERROR).alias("distinct")]
            if counts_only:
                continue
            top = F.expr(f"approx_top_k(`{f.name.replace('`', '``')}`, 1, {TRACKED})")
            measures[f.name] += [
                (F.min(_col(f.name)) if whole else F.lit(None)).cast("bigint").alias("low"),
                (F.max(_col(f.name)) if whole else F.lit(None)).cast("bigint").alias("high"),
                F.get(F.transform(top, lambda x: x["item"].cast("string")), F.lit(0)).alias("top")]
        if measures:
            rest = "" if counts_only else ", low bigint, high bigint, top string"
            frames.append(_by_column(df, t, measures, "n bigint, filled bigint, distinct bigint" + rest))
    found = union_all(frames)
    return found.collect() if found is not None else []


def _unique(tables: dict, candidates: list[tuple[str, tuple[str, ...]]]) -> set:
    """Of column sets without nulls, those of which no value occurs twice, by exact counts."""
    frames = []
    for t, names in candidates:
        fields = {f.name: f for f in _atomic(tables[t])}
        twice = tables[t].groupBy(*[_short(fields[c]).alias(f"k{i}") for i, c in enumerate(names)]).count().where("count > 1")
        frames.append(twice.agg(F.count("*").alias("twice")).select(
            F.lit(t).alias("table_name"), F.array(*map(F.lit, names)).alias("names"), "twice"))
    found = union_all(frames)
    return {(r.table_name, tuple(r.names)) for r in found.collect() if not r.twice} if found is not None else set()


def _text(f: T.StructField) -> Column:
    """The value as a text that no other value has."""
    return F.md5(_col(f.name)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else _col(f.name).cast("string")


def _seen_twice(tables: dict, candidates: list[tuple[str, tuple[str, ...]]]) -> set:
    """Of column sets without nulls, some of which a value occurs twice, for certain.

    Looks at all rows, but only at values whose hash is one in ``PARTS``: equal
    values have equal hashes, so both of a pair are there or none.  One pass and
    one shuffle of a ``PARTS``-th of the values serve all sets of a table.  Sets
    that are not found may have a value twice all the same.
    """
    frames, tried = [], []
    for t, group in itertools.groupby(candidates, key=lambda x: x[0]):
        fields = {f.name: f for f in _atomic(tables[t])}
        sets = [names for _, names in group]
        used = sorted({c for names in sets for c in names})
        place = {c: i for i, c in enumerate(used)}
        hashed = tables[t].select(*[_text(fields[c]).alias(f"v{i}") for c, i in place.items()],
                                  *[F.xxhash64(_col(c)).alias(f"h{i}") for c, i in place.items()])
        cells = [F.when(F.pmod(F.xxhash64(*[F.col(f"h{place[c]}") for c in names]), F.lit(PARTS)) == 0,
                        F.struct(F.lit(len(tried) + j).alias("s"), F.concat_ws("\x1f", *[F.col(f"v{place[c]}") for c in names]).alias("v")))
                 for j, names in enumerate(sets)]
        tried += [(t, names) for names in sets]
        frames.append(hashed.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.s", "x.v"))
    cells = union_all(frames)
    if cells is None:
        return set()
    return {tried[r.s] for r in cells.groupBy("s", "v").count().where("count > 1").select("s").distinct().collect()}


def candidate_keys(tables: dict, most: int = 2, statistics: list | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """(table, columns) of all minimal keys of up to ``most`` columns: no nulls, no value twice.

    Level by level: sets of one more column are looked at only if they hold no
    key yet and their estimated distinct counts could reach the rows; the sets
    left are estimated in one pass a table, and only those that come near are
    counted exactly.  In a table of many rows, sets of which one value in some is
    seen twice are left out before that, as a count moves all rows.  A table
    without rows has no keys.
    """
    rows: dict = {}
    for r in statistics if statistics is not None else column_statistics(tables, counts_only=True):
        if r.n and r.filled == r.n:
            rows.setdefault(r.table_name, {})[r.column_name] = r
    found: list = []
    for size in range(1, most + 1):
        level = []
        for t, columns in rows.items():
            keys = [set(k) for x, k in found if x == t]
            for names in itertools.combinations(columns, size):
                values = 1
                for c in names:
                    values *= columns[c].distinct * (1 + SLACK)
                if values >= columns[names[0]].n and not any(k <= set(names) for k in keys):
                    level.append((t, names))
        if size > 1:
            level = _estimated(tables, level, rows)
        twice = _seen_twice(tables, [x for x in level if rows[x[0]][x[1][0]].n >= MANY_ROWS])
        level = [x for x in level if x not in twice]
        unique = _unique(tables, level)
        found += [x for x in level if x in unique]
    return found


def _estimated(tables: dict, level: list, rows: dict) -> list:
    """The column sets whose estimated distinct count comes near the rows."""
    frames = []
    for t, group in itertools.groupby(level, key=lambda x: x[0]):
        fields = {f.name: f for f in _atomic(tables[t])}
        measures = {",".join(map(str, map(list(fields).index, names))):
                    [F.approx_count_distinct(F.xxhash64(*[_col(f"h{c}") for c in names]), ERROR).alias("distinct")] for _, names in group}
        hashed = tables[t].select(*[F.xxhash64(_col(c)).alias(f"h{c}") for c in fields])  # each column once, not once a set
        frames.append(_by_column(hashed, t, measures, "distinct bigint"))
    near = union_all(frames)
    near = {(r.table_name, r.column_name): r.distinct for r in near.collect()} if near is not None else {}
    place = {t: [f.name for f in _atomic(df)] for t, df in tables.items()}
    number = lambda t, names: ",".join(str(place[t].index(c)) for c in names)
    return [(t, names) for t, names in level if near[t, number(t, names)] >= (1 - SLACK) * rows[t][names[0]].n]


def _family(f: T.StructField) -> str | None:
    return next((name for kinds, name in _FAMILIES if isinstance(f.dataType, kinds)), None)


def inclusion_dependencies(tables: dict, keys: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column, n_values): columns all of whose values occur in a one-column key.

    One grouped pass: each value is first counted once a column (copies collapse
    before they travel), then gets the set of its columns; equal sets are
    counted, and column a lies in column b if as many values have both as have a.
    Integers compare with integers, texts with texts, dates with dates.
    """
    spark = next(iter(tables.values())).sparkSession
    names = [(t, f.name) for t, df in tables.items() for f in df.schema.fields if _family(f)]
    number = {x: i for i, x in enumerate(names)}
    frames = []
    for t, df in tables.items():
        cells = [F.struct(F.lit(number[t, f.name]).alias("c"), F.concat(F.lit(_family(f) + ":"), F.when(
            F.length(_col(f.name).cast("string")) > 32, F.concat(F.lit("#"), F.md5(_col(f.name).cast("string").cast("binary"))))
            .otherwise(_col(f.name).cast("string"))).alias("v")) for f in df.schema.fields if _family(f)]
        if cells:
            frames.append(df.select(F.explode(F.array(*cells)).alias("x")).select("x.c", "x.v"))
    out = "table_name string, column_name string, ref_table string, ref_column string, n_values bigint"
    refs = [number[t, c[0]] for t, c in keys if len(c) == 1 and (t, c[0]) in number]
    if not frames or not refs:
        return spark.createDataFrame([], out)
    values = union_all(frames).where(F.col("v").isNotNull()).distinct()
    sets = values.groupBy("v").agg(F.sort_array(F.collect_list("c")).alias("s")).groupBy("s").count()
    pairs = sets.select("count", "s", F.explode("s").alias("a")).select("count", "a", F.explode("s").alias("b"))
    n = pairs.groupBy("a", "b").agg(F.sum("count").alias("n"))
    own = n.where("a = b").select("a", F.col("n").alias("n_values"))
    inside = n.where((F.col("a") != F.col("b")) & F.col("b").isin(refs)).join(own, "a").where("n = n_values")
    of = lambda k, i: F.element_at(F.array(*[F.lit(x[i]) for x in names]), F.col(k) + 1)
    return inside.select(of("a", 0).alias("table_name"), of("a", 1).alias("column_name"),
                         of("b", 0).alias("ref_table"), of("b", 1).alias("ref_column"), "n_values")


def holding(declared: DataFrame, found: DataFrame) -> DataFrame:
    """The declared references (db_id, table_name, column_name, ref_table, ref_column) that the data bears out."""
    return declared.join(found.select("table_name", "column_name", "ref_table", "ref_column"),
                         ["table_name", "column_name", "ref_table", "ref_column"], "left_semi").select(declared.columns)


def column_defaults(tables: dict, keys: list[tuple[str, tuple[str, ...]]], statistics: list | None = None) -> DataFrame:
    """(table_name, column_name, default, autoincrement) of every atomic column.

    ``default``: the declared one (metadata ``CURRENT_DEFAULT``), else the value
    that more than half of the rows hold, else null.  ``autoincrement``: an
    integer key of two rows or more whose values lie in equal steps without gaps.
    """
    rows = {(r.table_name, r.column_name): r for r in (statistics if statistics is not None else column_statistics(tables))}
    single = {(t, c[0]) for t, c in keys if len(c) == 1}
    frames = []
    for t, df in tables.items():
        measures = {}
        for f in _atomic(df):
            r, c = rows[t, f.name], _col(f.name)
            step = (r.high - r.low) // (r.n - 1) if (t, f.name) in single and r.low is not None and r.n > 1 else 0
            even = step and step * (r.n - 1) == r.high - r.low
            declared = f.metadata.get("CURRENT_DEFAULT")
            often = F.lit(None).cast("string") if r.top is None else F.when(
                2 * F.count_if(c.cast("string") == F.lit(r.top)) > F.count(F.lit(1)), F.lit(r.top))
            measures[f.name] = [(F.lit(declared) if declared is not None else often).cast("string").alias("default"),
                                (F.count_if((c.cast("decimal(21,0)") - _big(r.low)) % _big(step) != 0) == 0 if even else F.lit(False)).alias("autoincrement")]
        if measures:
            frames.append(_by_column(df, t, measures, "`default` string, autoincrement boolean"))
    return union_all(frames)


def database_facts(spark: SparkSession, tables: dict, most: int = 2) -> dict:
    """Keys, references and defaults of a database's tables, its statistics taken once."""
    statistics = column_statistics(tables)
    keys = candidate_keys(tables, most, statistics)
    frame = spark.createDataFrame([(t, ",".join(c), len(c)) for t, c in keys], "table_name string, key_columns string, n_columns int")
    return {"keys": keys, "key_frame": frame, "references": inclusion_dependencies(tables, keys),
            "defaults": column_defaults(tables, keys, statistics)}
