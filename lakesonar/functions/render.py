"""Type classification, NaN cleaning (J5) and text rendering (T4).

The expression builders return Spark SQL text: a table with hundreds of
columns is then one ``selectExpr`` call instead of thousands of py4j calls
while the plan is built. ``col_*`` wrappers give ``Column`` objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(dt: T.DataType) -> str:
    """Coarse kind used to pick the profiling rule for a column."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC):
        return "number"
    if isinstance(dt, TEMPORAL):
        return "temporal"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def has_fractional(dt: T.DataType) -> bool:
    if isinstance(dt, FRACTIONAL):
        return True
    if isinstance(dt, T.ArrayType):
        return has_fractional(dt.elementType)
    if isinstance(dt, T.MapType):
        return has_fractional(dt.valueType)
    if isinstance(dt, T.StructType):
        return any(has_fractional(f.dataType) for f in dt.fields)
    return False


def sql_nan_to_null(e: str, dt: T.DataType) -> str:
    """NaN → NULL and -0.0 → 0.0 for float/double (pandas treats NaN as missing)."""
    if isinstance(dt, FRACTIONAL):
        zero = "CAST(0 AS FLOAT)" if isinstance(dt, T.FloatType) else "0.0D"
        return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} + {zero} END)"
    return e


_depth = [0]


def sql_clean_nan(e: str, dt: T.DataType) -> str:
    """Replace NaN by NULL recursively through arrays, maps and structs.

    Infinity is kept. Generated from the schema; runs inside codegen.
    """
    if isinstance(dt, FRACTIONAL):
        return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"
    if not has_fractional(dt):
        return e
    _depth[0] += 1
    x = f"x{_depth[0]}"
    try:
        if isinstance(dt, T.ArrayType):
            return f"transform({e}, {x} -> {sql_clean_nan(x, dt.elementType)})"
        if isinstance(dt, T.MapType):
            return f"transform_values({e}, (k{_depth[0]}, {x}) -> {sql_clean_nan(x, dt.valueType)})"
        if isinstance(dt, T.StructType):
            parts = ", ".join(f"'{f.name}', {sql_clean_nan(f'{e}.{quote(f.name)}', f.dataType)}"
                              for f in dt.fields)
            return f"(CASE WHEN {e} IS NULL THEN NULL ELSE named_struct({parts}) END)"
    finally:
        _depth[0] -= 1
    return e


def sql_iso_text(e: str, dt: T.DataType | None = None) -> str:
    """ISO-8601 text like Python's ``isoformat``: fraction only when non-zero."""
    if isinstance(dt, T.DateType):
        return f"date_format({e}, 'yyyy-MM-dd')"
    base = f"date_format({e}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    frac = f"date_format({e}, 'SSSSSS')"
    return f"(CASE WHEN {frac} = '000000' THEN {base} ELSE concat({base}, '.', {frac}) END)"


def sql_local_text(e: str) -> str:
    """ISO-8601 text of a timestamp without a zone; ``date_format`` would move it through the session's."""
    text = f"CAST({e} AS STRING)"
    return (f"concat(replace(substr({text}, 1, 19), ' ', 'T'), CASE WHEN length({text}) > 19 "
            f"THEN concat('.', rpad(substr({text}, 21), 6, '0')) ELSE '' END)")


def sql_double_text(e: str) -> str:
    """A double without an exponent from 1e-4 up to 1e16, as Python prints it."""
    text = f"CAST({e} AS STRING)"
    plain = f"rtrim('0', CAST(CAST({text} AS DECIMAL(38, 21)) AS STRING))"
    # other doubles come without an exponent: the comparisons spare them a second rendering
    return (f"(CASE WHEN abs({e}) >= 1e-4D AND abs({e}) < 1e16D AND (abs({e}) < 1e-3D OR abs({e}) >= 1e7D) AND {text} LIKE '%E%' "
            f"THEN concat({plain}, CASE WHEN {plain} LIKE '%.' THEN '0' ELSE '' END) ELSE {text} END)")


def sql_value_text(e: str, dt: T.DataType) -> str:
    """One text rendering per value: key of exact distinct counts and sample
    text. NaN is NULL, -0.0 equals 0.0, temporals are ISO, nested values are
    JSON, binary is hex."""
    k = kind_of(dt)
    if k == "temporal":
        return sql_iso_text(e, dt)
    if k == "string":
        return e
    if isinstance(dt, T.BinaryType):
        return f"hex({e})"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({sql_clean_nan(e, dt)})"
    if isinstance(dt, T.VariantType):
        return f"to_json({e})"
    return f"CAST({sql_nan_to_null(e, dt)} AS STRING)"


def iso_text(c: Column | str, dt: T.DataType | None = None) -> Column:
    """Column form of ``sql_iso_text`` for a column name."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise TypeError("iso_text takes a column name")
    return F.expr(sql_iso_text(quote(name), dt))


def clean_nan_frame(df):
    """Apply ``sql_clean_nan`` to every column of a DataFrame."""
    return df.selectExpr(*[f"{sql_clean_nan(quote(f.name), f.dataType)} AS {quote(f.name)}"
                           for f in df.schema.fields])
