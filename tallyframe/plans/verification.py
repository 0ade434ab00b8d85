"""The fact ledger and stage metrics for the retail pipeline (V8, V9).

Facts come from a handful of aggregates over two written stages; the one-row results are
gathered into one wide row with cross joins of one-row frames (no driver round trip)."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import cleaning as C
from tallyframe.operators import joins as J
from tallyframe.operators import metrics as M
from tallyframe.functions import patterns as P
from tallyframe.functions.exprs import count_if
from tallyframe.operators.verify import drop_budget, facts_from_wide
from tallyframe.plans.fixtures import messy_customers, messy_orders, messy_products
from tallyframe.plans.retail import with_dimensions
from tallyframe.functions.derive import derive
from tallyframe.session import materialize, scratch_path
from tallyframe.sources.tables import observed_write


def _one_row(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), frames)


def facts_wide(spark: SparkSession, sf: str) -> DataFrame:
    return facts_wide_from(messy_orders(spark, sf), messy_products(spark, sf), messy_customers(spark, sf))


def facts_wide_from(raw: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Every fact from three passes over the deduplicated stage, which is written once to the
    shared checkpoint folder:

    1. one aggregate over the stage: input rows, rows after dedupe, timestamp failures, qty
       repairs, discount nulls (C7, C4, C5);
    2. the cleaned keys left-joined to both sides' key multiplicities, one aggregate:
       product matches, product and customer misses (J3 twice);
    3. the joined, derived rows in one grouping-sets aggregate - the empty set for rows,
       headline KPIs and region conflicts (A1, J4), one set per surface dimension for the
       surface totals (A2-A5) - reduced by a tiny global aggregate over its groups."""
    strategy = C.RETAIL
    stage = materialize(C.deduped(raw, strategy, with_counts=True), "facts-stage")

    qty_target = dict(strategy.coerce)["qty"]
    (fill_col, _fill_value), = strategy.fill_nulls
    st = stage.agg(
        F.coalesce(F.sum(C.ROWS_PER_KEY), F.lit(0)).cast("bigint").alias("_in"),
        F.count(F.lit(1)).alias("_after"),
        count_if(F.col(strategy.ts_column).isNull()).alias("_fail"),
        count_if(C.needed_repair("qty", qty_target)).alias("_qty"),
        count_if(F.col(fill_col).isNull()).alias("_nulls"),
    )
    sources = (raw, products, customers)
    n_columns = sum(len(df.columns) for df in sources)  # schema facts: no scan
    cs = st.select(
        F.lit(n_columns).alias("contract_columns"),
        F.lit(len(sources)).alias("source_count"),
        F.col("_in").alias("rows_in"),
        (F.col("_after") - F.col("_fail")).alias("rows_clean"),
        (F.col("_in") - F.col("_after") + F.col("_fail")).alias("rows_dropped"),
        drop_budget(F.col("_in")).alias("drop_budget_rows"),
        (F.col("_in") - F.col("_after")).alias("duplicates_removed"),
        F.col("_fail").alias("timestamp_failures"),
        F.col("_qty").alias("qty_coerced"),
        F.when(F.col("_after") > 0, F.col("_nulls").cast("double") / F.col("_after").cast("double"))
        .otherwise(0.0).alias("discount_null_rate"),
    )

    cleaned = C.finish(stage, strategy)
    mult_p = products.groupBy("sku").agg(F.count(F.lit(1)).alias("_mp"))
    mult_c = customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_mc"))
    jm = (
        cleaned.select("sku", "customer_id")
        .join(mult_p, "sku", "left")
        .join(mult_c, "customer_id", "left")
        .agg(
            count_if(F.col("_mp").isNotNull()).alias("products_matched"),
            count_if(F.col("_mp").isNull()).alias("products_unmatched"),
            count_if(F.col("_mc").isNull()).alias("customers_unmatched"),
        )
    )

    # One grouping-sets aggregate over the joined, derived rows (never written): the empty
    # set carries the global figures (rows, KPIs, region conflicts), the four dimension sets
    # the surfaces' per-group revenue sums. A group counts as a surface point only when it
    # has revenue rows, as in the cuts themselves.
    d = derive(with_dimensions(cleaned, products, customers))  # keeps region_right
    done = F.col("status") == F.lit(P.REVENUE_STATUS)
    dims = ["category", "region", "order_week", "sku"]
    full = (1 << len(dims)) - 1
    gid_of = {d_: full - (1 << (len(dims) - 1 - i)) for i, d_ in enumerate(dims)}
    g = d.groupingSets([[], *[[d_] for d_ in dims]], *dims).agg(
        F.grouping_id(*dims).alias("_gid"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(done, F.col("net_revenue"))).alias("_net"),
        F.sum(F.when(done, F.col("margin"))).alias("_margin"),
        count_if(done).alias("_done"),
        count_if(F.col("status") == F.lit(P.RETURNED_STATUS)).alias("_returned"),
        count_if(F.col("region") != F.col("region_right")).alias("_conflicts"),
    )
    gid = F.col("_gid")
    total = lambda c: F.max(F.when(gid == F.lit(full), F.col(c)))
    point = lambda name: (gid == F.lit(gid_of[name])) & (F.col("_done") > 0)
    # Empty input gives no grouping-sets row at all (T6); this global aggregate still gives
    # one, with the empty selection's figures.
    red = g.agg(
        F.coalesce(total("_rows"), F.lit(0)).cast("bigint").alias("derived_rows"),
        total("_net").alias("_net"),
        total("_margin").alias("_margin"),
        F.coalesce(total("_done"), F.lit(0)).cast("bigint").alias("_done"),
        F.coalesce(total("_returned"), F.lit(0)).cast("bigint").alias("_returned"),
        F.coalesce(total("_conflicts"), F.lit(0)).cast("bigint").alias("region_conflicts"),
        M.money(F.sum(F.when(point("category"), F.col("_net")))).alias("category_total"),
        count_if(point("category")).alias("category_groups"),
        M.money(F.sum(F.when(point("region"), F.col("_net")))).alias("region_total"),
        count_if(point("order_week")).alias("week_points"),
        F.least(count_if(point("sku")), F.lit(P.TOP_PRODUCT_LIMIT).cast("bigint")).alias("top_products"),
    )
    k = red.select(
        *M.kpi_columns(F.col("_net"), F.col("_margin"), F.col("_done"), F.col("_returned")),
        "derived_rows", "region_conflicts", "category_total", "category_groups", "region_total", "week_points",
        "top_products", F.lit(len(M.Bundle.SURFACES)).alias("dashboard_surfaces"),
    ).drop("average_order_value", "returned_count")
    return _one_row(cs, jm, k)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts_from_wide(facts_wide(spark, sf))


def _rates(nulls: dict[str, int], rows: int) -> str:
    """The null rates of the columns that have nulls, as text: a=0.250000,b=0.010000."""
    return ",".join(f"{c}={Decimal(n / rows).quantize(Decimal('0.000001'))}" for c, n in sorted(nulls.items()) if n)


def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """V9: one row per stage: (stage, rows_in, rows_out, rows_dropped, columns_added, added,
    null_rates, bytes): the names of the new columns, the null rates of the columns that have nulls
    (of the load: not measured), the size of what was written.

    Two writes, the deduplicated stage and the derived table, and nothing else: every figure is
    taken by the tasks that write. What finishing makes null is known per row of the stage, and
    deriving keeps the rows of the join."""
    raw = messy_orders(spark, sf)
    parsed = F.col(C.RETAIL.ts_column).isNotNull()
    kept = C.finished_columns()
    stage_path, path = scratch_path(spark, "metrics-stage"), scratch_path(spark, "metrics-derived")
    missing = lambda columns, of=lambda c: F.col(c): {f"null_{c}": count_if(parsed & of(c).isNull()) for c in columns}
    st = observed_write(C.deduped(raw, with_counts=True), stage_path, {
        "rows_in": F.coalesce(F.sum(C.ROWS_PER_KEY), F.lit(0)), "failures": count_if(~parsed), **missing(raw.columns, lambda c: kept.get(c, F.col(c))),
    })
    finished = C.finish(spark.read.parquet(stage_path))
    joined = J.resolve_conflict(with_dimensions(finished, messy_products(spark, sf), messy_customers(spark, sf)), "region", losing="region_right")
    derived = derive(joined)
    out = observed_write(derived, path, missing(derived.columns))
    clean_out = st["rows"] - st["failures"]
    nulls = lambda seen, columns: {c: seen[f"null_{c}"] for c in columns}
    new = lambda now, was: [c for c in now.columns if c not in was.columns]
    rows = [("load", st["rows_in"], st["rows_in"], [], None, None)]
    rows.append(("clean", st["rows_in"], clean_out, new(finished, raw), _rates(nulls(st, raw.columns), clean_out), st["bytes"]))
    rows.append(("join", clean_out, out["rows"], new(joined, finished), _rates(nulls(out, joined.columns), out["rows"]), None))
    rows.append(("derive", out["rows"], out["rows"], new(derived, joined), _rates(nulls(out, derived.columns), out["rows"]), out["bytes"]))
    return spark.createDataFrame(
        [(s, n, m, n - m, len(added), ",".join(added), rates, size) for s, n, m, added, rates, size in rows],
        "stage string, rows_in bigint, rows_out bigint, rows_dropped bigint, columns_added bigint, added string, null_rates string, bytes bigint",
    )
