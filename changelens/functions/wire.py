"""Indented JSON with camel-case names and ASCII text, as a Column: the form that certificates are hashed and stored in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, StringType, StructType

#: What stands for itself inside a string; the short escapes of the rest. Fixed values.
PLAIN = r"[^ !#-%(-*,-;=?-\[\]-_a-~]"
SHORT = {"\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def quoted(text: Column) -> Column:
    """A JSON string; all but plain ASCII is escaped by UTF-16 units."""
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    units = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1")
    one = lambda c: F.when(c.rlike(PLAIN), F.coalesce(F.try_element_at(short, c), units(c))).otherwise(c)
    safe = F.when(text.rlike(PLAIN), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)
    return F.concat(F.lit('"'), safe, F.lit('"'))


def number(x: Column) -> Column:
    """A double in its shortest form: decimals from 1e-4 up to 1e15, else with an exponent of two digits or more and its sign."""
    size = F.abs(x)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,22)").cast("string"), "0+$", ""), "[.]$", "")
    power = F.regexp_replace(F.regexp_replace(x.cast("string"), "[.]0E", "E"), "E([0-9])", r"E+$1")
    return F.when(size == 0, "0").when((size >= 1e-4) & (size < 1e15), plain).otherwise(F.regexp_replace(power, "E([+-])([0-9])$", "E$10$2"))


def wire_json(value: Column, kind: DataType, pad: str = "") -> Column:
    """``value`` of type ``kind`` as JSON, two spaces a level, nulls written; maps, dates and the like have no form here."""
    deep = pad + "  "
    if isinstance(kind, StructType):
        parts = [F.concat(F.lit(f'{deep}"{camel(f.name)}": '), wire_json(value[f.name], f.dataType, deep)) for f in kind.fields]
        out = F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit(f"\n{pad}}}")) if parts else F.lit("{}")
    elif isinstance(kind, ArrayType):
        each = F.transform(value, lambda x: F.concat(F.lit(deep), wire_json(x, kind.elementType, deep)))
        out = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(each, ",\n"), F.lit(f"\n{pad}]")))
    elif isinstance(kind, StringType):
        out = quoted(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        out = number(value)
    elif isinstance(kind, (IntegralType, BooleanType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no JSON form for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)
