"""Canonical, type-tagged encoding of result cells and rows.

Result comparison follows Python tuple/set rules on database values:

* NULL equals NULL;
* a number equals the same number whatever its type (``1 == 1.0 == True``);
* text never equals a number (``'1' != 1``);
* column order and arity matter, column names do not.

Spark's ``=`` casts implicitly (``'1' = 1`` is true), so results are compared on
an encoding instead: every cell becomes a tagged string.

``z``                 NULL (and NaN, which a SQL store keeps as NULL)
``n:<normal form>``   boolean and every number: integral values without a
                      fraction (exact for all integer and decimal widths),
                      ``-0.0`` as ``0``, other values as double text
``s:<text>``          strings; dates and timestamps as ISO text
``b:<base64>``        binary
``j:<json>``          arrays, maps and structs
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TAG = "z"


def _number_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        integral = (c % 1) == 0
        return F.when(integral, c.cast("decimal(38,0)").cast("string")).otherwise(
            c.cast("double").cast("string"))
    # float / double
    d = c.cast("double")
    integral = (d % F.lit(1.0)) == F.lit(0.0)
    in_range = F.abs(d) < F.lit(1e38)
    return F.when(integral & in_range, d.cast("decimal(38,0)").cast("string")).otherwise(
        d.cast("string"))


def canonical_cell(c: Column, dtype: T.DataType) -> Column:
    """Tagged string for one cell; never NULL (hashing skips NULL elements)."""
    if isinstance(dtype, T.NullType):
        return F.lit(NULL_TAG)
    if isinstance(dtype, T.BooleanType):
        body = F.when(c, F.lit("n:1")).otherwise(F.lit("n:0"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        body = F.when(F.isnan(d), F.lit(NULL_TAG)).otherwise(
            F.concat(F.lit("n:"), _number_text(d, T.DoubleType())))
    elif isinstance(dtype, T.NumericType):
        body = F.concat(F.lit("n:"), _number_text(c, dtype))
    elif isinstance(dtype, T.StringType):
        body = F.concat(F.lit("s:"), c)
    elif isinstance(dtype, T.BinaryType):
        body = F.concat(F.lit("b:"), F.base64(c))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        body = F.concat(F.lit("j:"), F.to_json(c))
    else:  # dates, timestamps, intervals, variants: their text form
        body = F.concat(F.lit("s:"), c.cast("string"))
    return F.when(c.isNull(), F.lit(NULL_TAG)).otherwise(body)


def positional(df: DataFrame) -> DataFrame:
    """Rename columns to ``c0..cN`` so duplicate names can be addressed."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def canonical_row(df: DataFrame) -> Column:
    """``ARRAY<STRING>`` of canonical cells by position (use on ``positional(df)``)."""
    fields = df.schema.fields
    return F.array(*[canonical_cell(F.col(f"`{f.name}`"), f.dataType) for f in fields])
