"""K1-K3: a generated shop of customers, products and orders, as large as asked, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Statuses, texts and ranges of the demo rows.
STATUSES = ("pending", "paid", "shipped", "delivered", "cancelled")


def n_customers(orders: int) -> int:
    """K3: a twentieth of the orders, from 1 000 to 50 000."""
    return max(1_000, min(50_000, orders // 20))


def uniform(key: Column, salt: str) -> Column:
    """In [0, 1), by the first 52 bits of an MD5 of the key: no task order or retry changes it."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 13), 16, 10).cast("long") / float(1 << 52)


def upto(key: Column, salt: str, most: int) -> Column:
    """An integer from 0 to most, a random fraction of it rounded."""
    return F.rint(uniform(key, salt) * most)


def customers(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("customer"), i, F.lit("@example.com")).alias("email"), F.concat(F.lit("Customer "), i).alias("full_name"),
        F.timestamp_seconds(F.lit(1_700_000_000) - i * 60).alias("created_at"),
    )


def products(spark: SparkSession, n: int = 200) -> DataFrame:
    i = F.col("id")
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("SKU-"), F.lpad(i.cast("string"), 8, "0")).alias("sku"), F.concat(F.lit("Product "), i).alias("name"),
        upto(i, "price", 50_000).cast("int").alias("price_cents"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at"),
    )


def orders(spark: SparkSession, n: int) -> DataFrame:
    i, m = F.col("id"), n_customers(n)
    return spark.range(1, n + 1).select(
        "id", (upto(i, "customer", m - 1) + 1).cast("long").alias("customer_id"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (upto(i, "status", len(STATUSES) - 1) + 1).cast("int")).alias("status"), upto(i, "amount", 500_000).cast("int").alias("amount"),
        F.when(uniform(i, "notes") < 0.7, F.concat(F.lit("order note "), i)).alias("notes"),
        F.timestamp_seconds(F.lit(1_700_000_000) - (uniform(i, "day") * 86_400 * 730).cast("long")).alias("placed_at"),
    )
