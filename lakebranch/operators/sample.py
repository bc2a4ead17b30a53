"""H1-H3: a sample of a schema in which every foreign key still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of each table in a sample.
LIMIT = 1_000


def sample(tables: dict[str, DataFrame], order: list[str], keys: dict[str, list[str]], references: list[tuple[str, list[str], str, list[str]]], limit: int = LIMIT) -> dict[str, DataFrame]:
    """The first limit rows of each table by key, of those alone whose foreign keys (table, columns, parent, parent columns) are in the
    sample; order has parents first. Rows with NULL in a key are left out, references to oneself don't count; limit <= 0 copies none.

    A parent's sample has at most limit rows, so its keys are broadcast; each table is read once, and sorted for its first rows only.
    """
    out: dict[str, DataFrame] = {}
    for name in order:
        df = tables[name]
        for table, columns, parent, parent_columns in references:
            if table == name and parent != name and parent in out and limit > 0:
                held = out[parent].select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns, strict=True)])
                df = df.join(F.broadcast(held), columns, "left_semi")
        out[name] = df.orderBy(*keys.get(name, df.columns)).limit(limit) if limit > 0 else df.limit(0)
    return out


def next_identity(df: DataFrame, column: str) -> DataFrame:
    """H3: (next_value), one more than the greatest."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_value"))
