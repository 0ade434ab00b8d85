"""Mutation checks on the real extract (sf0.001): inject exactly one defect and assert that
exactly the count it should move moves, by exactly one (or by the known fan-out)."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cleaning as C
from tallyframe.operators import joins as J
from tallyframe.plans.fixtures import messy_orders, messy_products

SF = "/root/testdata/sf0.001"
STATS = ("rows_in", "rows_after_dedupe", "duplicates_removed", "failures", "rows_out", "rows_dropped")


@pytest.fixture(scope="module")
def base(spark):
    raw = messy_orders(spark, SF).persist()
    stats = C.clean_stats(raw).first().asDict()
    one = raw.filter(F.col("order_ts").startswith("19")).orderBy("order_id").limit(1)
    return raw, stats, one


def _moved(before, after):
    return {k: after[k] - before[k] for k in STATS if after[k] != before[k]}


def test_later_copy_is_one_duplicate(spark, base):
    raw, before, one = base
    later = one.withColumn("order_ts", F.lit("2099-01-01T00:00:00"))
    after = C.clean_stats(raw.unionByName(later)).first().asDict()
    assert _moved(before, after) == {"rows_in": 1, "duplicates_removed": 1, "rows_dropped": 1}
    kept = C.clean(raw.unionByName(later)).filter(F.col("order_id") == one.first().order_id).collect()
    assert len(kept) == 1 and kept[0].order_ts.year == 2099


def test_tied_copy_is_one_duplicate(spark, base):
    raw, before, one = base
    tied = one.withColumn("status", F.lit("zzz"))  # same key and timestamp, greater tie-break
    after = C.clean_stats(raw.unionByName(tied)).first().asDict()
    assert _moved(before, after) == {"rows_in": 1, "duplicates_removed": 1, "rows_dropped": 1}
    kept = C.clean(raw.unionByName(tied)).filter(F.col("order_id") == one.first().order_id).collect()
    assert [r.status for r in kept] == ["zzz"]


def test_unreadable_timestamp_is_one_failure(spark, base):
    raw, before, one = base
    bad = one.withColumn("order_id", F.lit("ORD-MUTANT")).withColumn("order_ts", F.lit("2025-13-45 99:99"))
    after = C.clean_stats(raw.unionByName(bad)).first().asDict()
    assert _moved(before, after) == {"rows_in": 1, "rows_after_dedupe": 1, "failures": 1, "rows_dropped": 1}


def test_null_join_key_is_one_unmatched(spark, base):
    raw, _, one = base
    products = messy_products(spark, SF)
    cleaned = C.clean(raw)
    s0 = J.join_stats(cleaned, products, "sku").first()
    orphan = C.clean(one.withColumn("order_id", F.lit("ORD-ORPHAN")).withColumn("sku", F.lit(None).cast("string")))
    s1 = J.join_stats(cleaned.unionByName(orphan), products, "sku").first()
    assert (s1.left_rows - s0.left_rows, s1.matched - s0.matched, s1.unmatched - s0.unmatched, s1.rows - s0.rows) == (1, 0, 1, 0)


def test_right_duplicate_multiplies_rows_not_matches(spark, base):
    raw, _, one = base
    products = messy_products(spark, SF)
    cleaned = C.clean(raw)
    sku = one.first().sku
    fan = cleaned.filter(F.col("sku") == sku).count()
    s0 = J.join_stats(cleaned, products, "sku").first()
    s1 = J.join_stats(cleaned, products.unionByName(products.filter(F.col("sku") == sku)), "sku").first()
    assert fan >= 1
    assert (s1.rows - s0.rows, s1.matched - s0.matched, s1.unmatched - s0.unmatched) == (fan, 0, 0)
    assert J.join(cleaned, products.unionByName(products.filter(F.col("sku") == sku)), "sku").count() == s1.rows
