"""What a change costs the data: catalog only (INSTANT), a read of every row (SCAN), or a REWRITE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Functions whose value differs from row to row.
VOLATILE = ("random", "clock_timestamp", "gen_random_uuid", "uuid_generate_v4", "nextval", "timeofday")
# Types whose precision can grow in place.
_TIMES = ("timestamptz", "timestamp", "time", "timetz", "interval")


def classified(verdict: str, lock: str, blocks: str, why: str = "") -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(lock).alias("lock"), F.lit(blocks).alias("blocks"), F.lit(why).alias("rationale"))


def instant(why: str = "catalog only") -> Column:
    """F7"""
    return classified("INSTANT", "ACCESS_EXCLUSIVE", "READS_AND_WRITES", why)


def rewrite(why: str = "every row is written anew") -> Column:
    return classified("REWRITE", "ACCESS_EXCLUSIVE", "READS_AND_WRITES", why)


def quiet_scan(why: str = "reads rows in the background") -> Column:
    return classified("SCAN", "SHARE_UPDATE_EXCLUSIVE", "NOTHING", why)


def is_volatile(default: Column, strict: bool = False) -> Column:
    """strict matches a function's name anywhere; else only as a word of its own."""
    names = "|".join(VOLATILE)
    return F.coalesce(F.lower(default).rlike(f"({names})\\(" if strict else f"(?<![A-Za-z0-9_])({names})\\("), F.lit(False))


def add_column(default: Column, strict: bool = False) -> Column:
    """F2"""
    return F.when(is_volatile(default, strict), rewrite("the default differs by row")).otherwise(instant("the default is kept in the catalog"))


def binary_coercible(a: Column, b: Column) -> Column:
    """values of type a are values of type b as they are stored."""
    same = a["base"] == b["base"]
    wider = lambda n: b[n].isNull() | F.coalesce(a[n].isNotNull() & (b[n] >= a[n]), F.lit(False))
    scale = F.coalesce(a["scale"], F.lit(0)) == F.coalesce(b["scale"], F.lit(0))
    equal = same & a["length"].eqNullSafe(b["length"]) & a["precision"].eqNullSafe(b["precision"]) & a["scale"].eqNullSafe(b["scale"])
    return (
        F.when(a["base"].isin("varchar", "char") & (b["base"] == "text"), True)
        .when(same & (a["base"] == "varchar"), wider("length"))
        .when(same & (a["base"] == "numeric"), b["precision"].isNull() | (wider("precision") & scale))
        .when(same & a["base"].isin(*_TIMES), wider("precision"))
        .otherwise(equal)
    )


def change_type(a: Column, b: Column, using: Column | None = None) -> Column:
    """F3"""
    by_hand = F.lit(False) if using is None else using.isNotNull()
    return F.when(~by_hand & binary_coercible(a, b), instant("stored values stay as they are")).otherwise(rewrite())


def set_not_null() -> Column:
    """F5"""
    return classified("SCAN", "ACCESS_EXCLUSIVE", "READS_AND_WRITES", "no row may be NULL")


def create_index() -> Column:
    """F6"""
    return classified("SCAN", "SHARE", "WRITES", "reads the table")


def change(kind: Column, to_value: Column) -> Column:
    """a diff row's class, type changes and additions of columns aside."""
    return (
        F.when((kind == "COLUMN_NULLABILITY_CHANGED") & (to_value == "NOT NULL"), set_not_null())
        .when(kind == "INDEX_ADDED", create_index())
        .otherwise(instant())
    )
