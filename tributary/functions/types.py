"""Warehouse types as text: families of aliases, arguments that count only where both sides have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of one type everywhere.
FAMILIES = (
    ("varchar", "character varying", "text", "string"),
    ("int", "integer", "int4"),
    ("bigint", "int8"),
    ("smallint", "int2"),
    ("bool", "boolean"),
    ("float8", "double precision", "double"),
    ("float4", "real"),
    ("numeric", "decimal", "dec"),
    ("timestamp", "timestamp without time zone"),
    ("timestamptz", "timestamp with time zone"),
)
# Names of one type in a dialect, besides.
DIALECTS = {
    "bigquery": (
        ("int64", "int", "integer", "int4", "bigint", "int8", "smallint", "int2"),
        ("float64", "float8", "double precision", "double"),
        ("bignumeric", "bigdecimal"),
    ),
    "snowflake": (
        ("number", "int", "integer", "int4", "bigint", "int8", "smallint", "int2", "tinyint", "byteint"),
        ("float", "float4", "float8", "double", "double precision", "real"),
    ),
}


def type_name(data_type: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(data_type), r"\(.*?\)", ""), r"\s+", " "))


def type_arguments(data_type: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(data_type, r"\((.*?)\)", 1), r"\s", "")


def families(name: Column, dialect: str | None = None) -> Column:
    """Numbers of the families that a base name is in."""
    rows = FAMILIES + DIALECTS.get(dialect or "", ())
    known = sorted({n for row in rows for n in row})
    table = F.create_map(*[x for n in known for x in (F.lit(n), F.array(*[F.lit(k) for k, row in enumerate(rows) if n in row]))])
    return F.coalesce(F.element_at(table, name), F.array().cast("array<int>"))


def _base(data_type: Column, dialect: str | None) -> Column:
    """The name; in Snowflake a NUMBER by any name is an integer where its scale is 0 (the default), else a decimal."""
    name = type_name(data_type)
    if dialect != "snowflake":
        return name
    whole = type_arguments(data_type).rlike(r"^(\d+(,0+)?)?$")
    return F.when(name.isin("number", "numeric", "decimal", "dec"), F.when(whole, "number").otherwise("numeric")).otherwise(name)


def types_equivalent(a: Column, b: Column, dialect: str | None = None) -> Column:
    """Equal names or names of one family; arguments decide where both sides have them."""
    x, y = type_arguments(a), type_arguments(b)
    m, n = _base(a, dialect), _base(b, dialect)
    return ((x == "") | (y == "") | (x == y)) & ((m == n) | F.arrays_overlap(families(m, dialect), families(n, dialect)))
