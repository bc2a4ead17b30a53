"""A1-A3: canonical types and defaults as Column expressions; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of each canonical type.
SPELLINGS = {
    "smallint": ("int2", "smallint", "smallserial"),
    "integer": ("int4", "int", "integer", "serial"),
    "bigint": ("int8", "bigint", "bigserial"),
    "numeric": ("numeric", "decimal"),
    "real": ("float4", "real"),
    "double precision": ("float8", "double precision"),
    "varchar": ("varchar", "character varying"),
    "char": ("bpchar", "character", "char"),
    "text": ("text",),
    "boolean": ("bool", "boolean"),
    "timestamptz": ("timestamptz", "timestamp with time zone"),
    "timestamp": ("timestamp", "timestamp without time zone"),
    "timetz": ("timetz", "time with time zone"),
    "time": ("time", "time without time zone"),
    "date": ("date",),
    "interval": ("interval",),
    "uuid": ("uuid",),
    "json": ("json",),
    "jsonb": ("jsonb",),
    "bytea": ("bytea",),
    "inet": ("inet",),
    "cidr": ("cidr",),
    "macaddr": ("macaddr",),
}
# Spellings of the same default expression.
DEFAULT_SPELLINGS = {
    "current_timestamp": "now()",
    "current_timestamp()": "now()",
    '"current_timestamp"()': "now()",
    "current_date": "CURRENT_DATE",
    "current_user": "CURRENT_USER",
}
#: Spark's names of types in canonical spelling.
SPARK_TYPES = {
    "tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision",
    "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea", "variant": "jsonb",
}
TYPE = "struct<base:string,length:int,precision:int,scale:int>"


def lookup(values: dict[str, str], key: Column) -> Column:
    """The key's value in a small literal map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def base_type(name: Column) -> Column:
    key = F.regexp_replace(F.trim(name), r"\s+", " ")
    return F.coalesce(lookup({s: canonical for canonical, all_ in SPELLINGS.items() for s in all_}, key), key)


def parse_type(text: Column) -> Column:
    """A1: struct(base, length, precision, scale). Arrays and unknown types stay as they are; null or blank gives null.

    A type is a name, perhaps with one or two numbers in parentheses and words that follow them, which belong to the name.
    """
    s = F.lower(F.trim(text))
    opened, closed = F.locate("(", s), F.locate(")", s)
    has = (opened > 1) & (closed > opened)
    before, after = F.substr(s, F.lit(1), opened - 1), F.substr(s, closed + 1)
    inside = F.substr(s, opened + 1, closed - opened - 1)
    numbers = F.transform(F.split(inside, ","), lambda x: F.trim(x).try_cast("int"))
    digits = (F.trim(inside) == inside) & (F.translate(inside, "0123456789, ", "") == "") & (F.size(numbers) <= 2) & ~F.exists(numbers, lambda n: n.isNull())
    zoned = F.trim(before).isin("time", "timestamp") & F.trim(after).isin("with time zone", "without time zone") & (F.size(numbers) == 1)
    plain = has & digits & ((after == "") | zoned)
    base = base_type(F.when(plain, F.concat_ws(" ", F.trim(before), F.nullif(F.trim(after), F.lit("")))).otherwise(s))
    sized = base.isin("varchar", "char")
    number = lambda n, when: F.when(plain & when, F.get(numbers, F.lit(n)))
    made = lambda base, *sizes: F.struct(base.alias("base"), *[v.cast("int").alias(n) for n, v in zip(("length", "precision", "scale"), sizes, strict=True)])
    none = F.lit(None)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", none.cast(TYPE))
        .when(s.endswith("[]"), made(s, none, none, none))
        .otherwise(made(base, number(0, sized), number(0, ~sized), number(1, ~sized)))
    )


def type_sql(t: Column) -> Column:
    """A2: the canonical spelling of a type."""
    return (
        F.when(t["length"].isNotNull(), F.concat(t["base"], F.lit("("), t["length"].cast("string"), F.lit(")")))
        .when(t["scale"].isNotNull(), F.concat(t["base"], F.lit("("), t["precision"].cast("string"), F.lit(","), t["scale"].cast("string"), F.lit(")")))
        .when(t["precision"].isNotNull(), F.concat(t["base"], F.lit("("), t["precision"].cast("string"), F.lit(")")))
        .otherwise(t["base"])
    )


def canonical_default(text: Column, column_type: Column) -> Column:
    """A3: null for blank and nextval defaults, one spelling for equal ones, without a trailing cast to the column's own base type.

    A trailing cast is what follows the last "::", where that reads as a type: letters, digits, spaces and sizes in parentheses.
    """
    s = F.trim(text)
    cast = F.substring_index(s, "::", -1)
    value = F.substr(s, F.lit(1), F.length(s) - F.length(cast) - 2)
    is_type = F.contains(s, F.lit("::")) & (F.translate(F.lower(cast), "abcdefghijklmnopqrstuvwxyz0123456789_ (,)", "") == "") & (F.trim(cast) != "")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.lower(s).startswith("nextval("), F.lit(None).cast("string"))
        .when(lookup(DEFAULT_SPELLINGS, F.lower(s)).isNotNull(), lookup(DEFAULT_SPELLINGS, F.lower(s)))
        .when(is_type & (parse_type(cast)["base"] == column_type["base"]), F.trim(value))
        .otherwise(s)
    )
