"""Canonical JSON text of any column, and fingerprints of it, in the JVM.

The schema is walked once when the plan is built; what runs is an ordinary column
expression. Names of structs and keys of maps are sorted at every depth, so the
text does not depend on the order in which fields were declared or entries put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def canonical_json(column: Column, kind: T.DataType) -> Column:
    """JSON with ``", "`` and ``": "`` between parts and sorted names; null is ``null``.

    Whole numbers, booleans, strings, dates and timestamps (ISO), binary (hex),
    decimals, doubles (shortest form; without an exponent from 1e-3 up to 1e7),
    arrays, structs and maps with string or whole keys.
    """
    return F.coalesce(_text(column, kind), F.lit("null"))


def _text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        names = sorted(kind.names)
        parts = [F.concat(_quoted(F.lit(n)), F.lit(": "), canonical_json(column.getField(n), kind[n].dataType)) for n in names]
        body = F.concat_ws(", ", *parts) if parts else F.lit("")
        return F.when(column.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical_json(e["value"], kind.valueType).alias("v")))
        parts = F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["k"]), F.lit(": "), e["v"]))
        return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _quoted(F.replace(column.cast("string"), F.lit(" "), F.lit("T")))
    if isinstance(kind, T.BinaryType):
        return _quoted(F.lower(F.hex(column)))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.when(column.isNotNull(), _quoted(column))
    if isinstance(kind, (*_WHOLE, T.BooleanType, T.DecimalType)):
        return column.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(column), F.lit("NaN")).otherwise(F.replace(F.replace(column.cast("string"), F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e")))
    raise TypeError(f"no canonical JSON for {kind.simpleString()}")


def fingerprint(df: DataFrame, columns: list[str] | None = None, *, suffix: Column | None = None, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the canonical JSON of some of a table's columns, and an optional suffix."""
    names = sorted(columns or df.columns)
    kind = T.StructType([df.schema[n] for n in names])
    text = canonical_json(F.struct(*[F.col(f"`{n}`") for n in names]), kind)
    return F.substring(F.sha2(F.concat(text, suffix) if suffix is not None else text, 256), 1, digits)
