"""The retail pipeline as one lazy chain: extract -> clean -> join x2 -> resolve -> derive.

``derived_table`` is what the cross-filter queries read. ``save_derived`` writes it once to
the shared checkpoint folder (parquet, partitioned by nothing so scans prune columns and
push filters) so that later queries do not replay the clean and join lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.functions.derive import derive
from tallyframe.operators.cleaning import RETAIL, CleanStrategy, clean
from tallyframe.operators.joins import join, resolve_conflict
from tallyframe.plans.fixtures import messy_customers, messy_orders, messy_products
from tallyframe.session import scratch_path


def cleaned_orders(spark: SparkSession, sf_dir: str, strategy: CleanStrategy = RETAIL) -> DataFrame:
    return clean(messy_orders(spark, sf_dir), strategy)


def with_dimensions(orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the columns of their product, then of their customer (``region_right``). Customers are
    joined first: they add two short columns, so that the exchange for the other join stays narrow."""
    joined = join(join(orders, customers, "customer_id"), products, "sku")
    keys, added = ["customer_id", "sku"], [c for c in products.columns if c != "sku"]
    own = [c for c in orders.columns if c not in keys]
    return joined.select(*keys, *own, *added, *[c for c in joined.columns if c not in {*keys, *own, *added}])


def joined_orders(spark: SparkSession, sf_dir: str, strategy: CleanStrategy = RETAIL) -> DataFrame:
    """Orders with product and customer attributes; ``region_right`` is the customer's."""
    orders = cleaned_orders(spark, sf_dir, strategy)
    return with_dimensions(orders, messy_products(spark, sf_dir), messy_customers(spark, sf_dir))


def derived_table(spark: SparkSession, sf_dir: str, strategy: CleanStrategy = RETAIL) -> DataFrame:
    resolved = resolve_conflict(joined_orders(spark, sf_dir, strategy), "region", losing="region_right")
    return derive(resolved)


def save_derived(df: DataFrame, path: str | None = None) -> DataFrame:
    """Retain the derived table (A8): write it and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "derived")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
