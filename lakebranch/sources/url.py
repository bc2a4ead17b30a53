"""Parts of a database URL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_database_url(url: Column) -> Column:
    """struct(jdbc_url, username, password). User information is parted at its first colon before it is decoded, and a plus stays a
    plus; of the query only sslmode is kept; the port is 5432 by default; another scheme than postgres or postgresql gives null."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    user = part("USERINFO")
    mode = F.try_parse_url(url, F.lit("QUERY"), F.lit("sslmode"))
    # the authority may hold anything in its user information, so host and port are what follows the last @
    authority = F.substring_index(part("AUTHORITY"), "@", -1)
    port = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit(""))
    host = F.regexp_replace(authority, r":\d+$", "")
    jdbc = F.concat(F.lit("jdbc:postgresql://"), host, F.lit(":"), F.coalesce(port, F.lit("5432")), F.coalesce(part("PATH"), F.lit("/")), F.when(mode.isNull(), "").otherwise(F.concat(F.lit("?sslmode="), mode)))
    made = F.struct(
        jdbc.alias("jdbc_url"), decoded(F.substring_index(user, ":", 1)).alias("username"),
        F.when(F.instr(user, ":") > 0, decoded(F.substr(user, F.instr(user, ":") + 1))).alias("password"),
    )
    return F.when(part("PROTOCOL").isin("postgres", "postgresql"), made)
