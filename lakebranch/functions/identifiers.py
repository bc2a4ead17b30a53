"""Stable ids, identifier rules, quoting, and the names of migration machinery."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column, functions as F

# The longest name in bytes, the prefix kept for machinery, and what a name looks like.
MAX_BYTES = 63
PREFIX = "__sv_"
PATTERN = r"^[A-Za-z_][A-Za-z0-9_$]*$"
# Words that can't name anything.
RESERVED = (
    "select from where table column index constraint primary foreign key unique check default null not and or create drop alter "
    "insert update delete order group user grant revoke all any as on in is into values"
).split()
#: Base 32 without I, L, O and U (Crockford).
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
KINDS = {"table": "tbl", "column": "col", "index": "idx", "constraint": "con"}


class InvalidIdentifier(ValueError):
    """A name that a user may not give."""


def mint(kind: str, now_ms: int | None = None) -> str:
    """Prefix, ten digits of the time in milliseconds, six random ones. Ids are minted once an operation, on the driver."""
    value, digits = int(time.time() * 1000) if now_ms is None else now_ms, []
    for _ in range(10):
        value, low = divmod(value, 32)
        digits.append(DIGITS[low])
    return f"{KINDS[kind]}_{''.join(reversed(digits))}{''.join(secrets.choice(DIGITS) for _ in range(6))}"


def stable_id(kind: str, *parts: Column) -> Column:
    """A deterministic id from what names the object, for first imports and tests."""
    return F.concat(F.lit(KINDS[kind] + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def problem(name: Column) -> Column:
    """Why a user may not give this name, or null."""
    low = F.lower(name)
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "empty")
        .when(F.octet_length(name) > MAX_BYTES, "too long")
        .when(~name.rlike(PATTERN), "bad character")
        .when(low.startswith(PREFIX), "reserved prefix")
        .when(low.isin(*RESERVED), "reserved word")
    )


def check_name(kind: str, name: str | None) -> str:
    """C12 for a single name on the driver."""
    import re

    found = (
        "empty" if name is None or not name.strip()
        else "too long" if len(name.encode()) > MAX_BYTES
        else "bad character" if not re.fullmatch(PATTERN, name)
        else "reserved prefix" if name.lower().startswith(PREFIX)
        else "reserved word" if name.lower() in RESERVED
        else None
    )
    if found:
        raise InvalidIdentifier(f"{kind} name {name!r}: {found}")
    return name


def quote(name: Column) -> Column:
    """C13; null for a name that can't be quoted."""
    return F.when((name != "") & (F.instr(name, "\0") == 0), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def quoted(name: str) -> str:
    if not name or "\0" in name:
        raise InvalidIdentifier("an identifier must not be empty or hold a null byte")
    return '"' + name.replace('"', '""') + '"'


def qualified(schema: str, name: str) -> str:
    return f"{quoted(schema)}.{quoted(name)}"


def machinery(column: Column, table: Column | None = None) -> dict[str, Column]:
    """C14: names of a retype's shadow column, trigger and function, and of a not-null check."""
    wrap = lambda x, suffix: F.concat(F.lit(PREFIX), x, F.lit(suffix))
    out = {"shadow": wrap(column, "__new"), "trigger": wrap(column, "__sync"), "not_null": wrap(column, "__nn")}
    return out if table is None else out | {"function": wrap(F.concat_ws("_", table, column), "__sync")}
