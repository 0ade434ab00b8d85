"""Registry of named queries (Spark) and their DuckDB oracles.

Keys follow SURVEY section 7.4. Each Spark query takes (spark, sf_dir) and reads the whole
tables under sf_dir. Each oracle is DuckDB SQL over the driver's views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.derive import DERIVED_COLUMNS, derive_counts, money_as_double
from tallyframe.operators import metrics as M
from tallyframe.plans import oracle as O
from tallyframe.plans.retail import derived_table, with_dimensions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# Cross-filter matrix used by the metric queries (values exist in every scale factor).
DATES = dict(date_from="1996-01-01", date_to="1996-12-31")
CATEGORY = dict(category="MEDIUM")
REGION = dict(region="R2")
EMPTY = dict(category="NO SUCH CATEGORY")
BAD_DATE = dict(date_from="2025-13-01")
WEEKS = ("1996-01-01", "1996-03-25")  # Mondays; last week kept whole -> through 1996-03-31


def _f(**kw) -> M.Filters:
    return M.Filters(**kw)


# ------------------------------------------------------------------ D8 / A1-A5


@register("derive", f"""{O.PIPELINE}
SELECT order_id, order_ts, customer_id, region, sku, qty, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(discount_pct AS DOUBLE) AS discount_pct, status, product_name, category, cost_price, segment,
       {O.money('gross_revenue')} AS gross_revenue, {O.money('net_revenue')} AS net_revenue,
       {O.money('cogs')} AS cogs, {O.money('margin')} AS margin, margin_pct, order_date, order_week
FROM derived""")
def q_derive(spark, sf):
    return money_as_double(derived_table(spark, sf))


@register("kpis", O.kpis_sql())
def q_kpis(spark, sf):
    return M.kpis(derived_table(spark, sf))


@register("revenue_over_time", O.weekly_sql())
def q_weekly(spark, sf):
    return M.revenue_over_time(derived_table(spark, sf))


@register("revenue_by_category", O.category_sql())
def q_category(spark, sf):
    return M.revenue_by_category(derived_table(spark, sf))


@register("revenue_by_region", O.region_sql())
def q_region(spark, sf):
    return M.revenue_by_region(derived_table(spark, sf))


@register("top_products", O.top_products_sql())
def q_top(spark, sf):
    """A5 over the derived table written once (ranking scan + name lookup scan read it)."""
    return M.top_products(materialize(derived_table(spark, sf), "derived"))


# ------------------------------------------------------------------ F1-F7 matrix

_MATRIX = {
    "none": {},
    "dates": DATES,
    "category": CATEGORY,
    "region": REGION,
    "category_region": {**CATEGORY, **REGION},
    "empty": EMPTY,
    "bad_date": BAD_DATE,
}


@register("bundle_rows", f"""{O.PIPELINE}
""" + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS filter_set, CAST(count(*) AS BIGINT) AS rows, "
    f"CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS revenue_rows FROM derived WHERE {O.predicate(**{kk: vv for kk, vv in v.items() if kk != 'date_from' or k != 'bad_date'})}"
    for k, v in _MATRIX.items()
))
def q_bundle_rows(spark, sf):
    """A6 ``rows``: rows admitted by each filter set, before the status filter, from one
    scan (conditional counts)."""
    d = derived_table(spark, sf)
    aggs = []
    for k, v in _MATRIX.items():
        p = M.predicate(_f(**v))
        aggs += [F.count_if(p).alias(f"r_{k}"), F.count_if(p & (F.col("status") == "completed")).alias(f"v_{k}")]
    wide = d.agg(*aggs)
    stack = ", ".join(f"'{k}', r_{k}, v_{k}" for k in _MATRIX)
    return wide.selectExpr(f"stack({len(_MATRIX)}, {stack}) as (filter_set, rows, revenue_rows)")


@register("kpis_dates", O.kpis_sql(**DATES))
def q_kpis_dates(spark, sf):
    return M.kpis(derived_table(spark, sf), _f(**DATES))


@register("kpis_bad_date", O.kpis_sql())
def q_kpis_bad_date(spark, sf):
    """an unreadable date bound is dropped, so this equals the unfiltered KPIs."""
    return M.kpis(derived_table(spark, sf), _f(**BAD_DATE))


@register("category_cut_released", O.category_sql(**DATES, **CATEGORY, **REGION))
def q_cat_released(spark, sf):
    return M.revenue_by_category(derived_table(spark, sf), _f(**DATES, **CATEGORY, **REGION))


@register("region_cut_released", O.region_sql(**DATES, **CATEGORY, **REGION))
def q_region_released(spark, sf):
    return M.revenue_by_region(derived_table(spark, sf), _f(**DATES, **CATEGORY, **REGION))


@register("two_filters", O.top_products_sql(**CATEGORY, **REGION))
def q_two_filters(spark, sf):
    return M.top_products(materialize(derived_table(spark, sf), "derived"), _f(**CATEGORY, **REGION))


@register("kpis_empty", O.kpis_sql(**EMPTY))
def q_kpis_empty(spark, sf):
    return M.kpis(derived_table(spark, sf), _f(**EMPTY))


@register("weeks_range", O.weekly_sql(date_from=WEEKS[0], date_to="1996-03-31"))
def q_weeks_range(spark, sf):
    return M.revenue_over_time(derived_table(spark, sf), M.week_filters(*WEEKS))


def _cuts_sql(**f) -> str:
    both = O.predicate(**f)
    cat = O.predicate(**{k: v for k, v in f.items() if k != "category"})
    reg = O.predicate(**{k: v for k, v in f.items() if k != "region"})
    parts = []
    for grain, key, pred, units in (
        ("week", "CAST(order_week AS VARCHAR)", both, "CAST(sum(qty) AS BIGINT)"),
        ("category", "category", cat, "CAST(0 AS BIGINT)"),
        ("region", "region", reg, "CAST(0 AS BIGINT)"),
        ("sku", "sku", both, "CAST(sum(qty) AS BIGINT)"),
    ):
        parts.append(
            f"SELECT '{grain}' AS grain, {key} AS key, {O.money('sum(net_revenue)')} AS net_revenue, "
            f"{O.ratio(O.money('sum(margin)'), O.money('sum(net_revenue)'))} AS margin_pct, "
            f"CAST(count(*) AS BIGINT) AS order_count, {units} AS units "
            f"FROM derived WHERE {pred} AND status = 'completed' GROUP BY {key}"
        )
    return O.PIPELINE + "\n" + "\nUNION ALL\n".join(parts)


@register("grouping_sets_cut", _cuts_sql(**DATES, **CATEGORY, **REGION))
def q_grouping_sets(spark, sf):
    return M.grouping_sets_cut(derived_table(spark, sf), _f(**DATES, **CATEGORY, **REGION))


# ------------------------------------------------------------------ C1-C9 cleaning

from tallyframe.functions import patterns as P  # noqa: E402
from tallyframe.operators import cleaning as C  # noqa: E402
from tallyframe.operators import joins as J  # noqa: E402
from tallyframe.plans.fixtures import messy_customers, messy_orders, messy_products  # noqa: E402

from tallyframe.session import materialize  # noqa: E402

CLEAN_PREFIX = O.with_chain(*O.FIXTURES, O.CLEAN_CHAIN)


@register("parse_multi_format", f"""{O.with_chain(O.MESSY_ORDERS)}
SELECT order_id, order_ts AS order_ts_raw, CAST({O.parse_multi('order_ts')} AS TIMESTAMP) AS order_ts
FROM messy_orders""")
def q_parse_multi(spark, sf):
    m = messy_orders(spark, sf)
    return C.parse_multi(m.select("order_id", F.col("order_ts").alias("order_ts_raw"), "order_ts"), "order_ts")


@register("dedupe_latest", f"""{CLEAN_PREFIX}
SELECT * FROM deduped""")
def q_dedupe(spark, sf):
    return C.dedupe_latest(C.parse_multi(messy_orders(spark, sf), "order_ts"), "order_id", "order_ts")


@register("coerce_numeric", f"""{CLEAN_PREFIX}
SELECT order_id, qty AS qty_raw, {O.guarded(O.tidy('qty'), 'BIGINT')} AS qty,
       unit_price AS unit_price_raw, CAST({O.guarded(O.tidy('unit_price'), O.PRICE)} AS DOUBLE) AS unit_price
FROM deduped""")
def q_coerce(spark, sf):
    d = C.dedupe_latest(C.parse_multi(messy_orders(spark, sf), "order_ts"), "order_id", "order_ts")
    return d.select(
        "order_id",
        F.col("qty").alias("qty_raw"),
        C.coerce_expr("qty", "int").alias("qty"),
        F.col("unit_price").alias("unit_price_raw"),
        C.coerce_expr("unit_price", P.WIDE_PRICE_DECIMAL).cast("double").alias("unit_price"),
    )


def _needed_sql(col: str, target: str) -> str:
    return f"({O.guarded(col, target)}) IS NULL AND ({O.guarded(O.tidy(col), target)}) IS NOT NULL"


def _not_held_sql(col: str, target: str) -> str:
    text = O.tidy(col)
    kept, exact = O.guarded(text, target), O.guarded(text, "DECIMAL(38,16)")
    plain = P.PLAIN_INT if target == "BIGINT" else P.PLAIN_FLOAT
    return f"regexp_full_match({text}, '{plain}') AND (({kept}) IS NULL OR CAST(({kept}) AS DECIMAL(38,16)) <> ({exact}))"


@register("coerce_counts", f"""{CLEAN_PREFIX}
SELECT 'qty' AS column_name, 'bigint' AS target, CAST(count(*) FILTER (WHERE {_needed_sql('qty', 'BIGINT')}) AS BIGINT) AS needed,
       CAST(count(*) FILTER (WHERE {_not_held_sql('qty', 'BIGINT')}) AS BIGINT) AS not_held FROM deduped
UNION ALL
SELECT 'unit_price', '{P.WIDE_PRICE_DECIMAL}', CAST(count(*) FILTER (WHERE {_needed_sql('unit_price', O.WIDE_PRICE)}) AS BIGINT),
       CAST(count(*) FILTER (WHERE {_not_held_sql('unit_price', O.WIDE_PRICE)}) AS BIGINT) FROM deduped""")
def q_coerce_counts(spark, sf):
    return C.coerce_counts(messy_orders(spark, sf))


@register("held_counts", f"""{O.with_chain(O.MESSY_ORDERS, O.MESSY_PRODUCTS, O.CLEAN_CHAIN)}
SELECT 'qty' AS column_name, 'bigint' AS target, CAST(count(*) FILTER (WHERE {_not_held_sql('qty', 'BIGINT')}) AS BIGINT) AS not_held FROM deduped
UNION ALL
SELECT 'unit_price', '{P.WIDE_PRICE_DECIMAL}', CAST(count(*) FILTER (WHERE {_not_held_sql('unit_price', O.WIDE_PRICE)}) AS BIGINT) FROM deduped
UNION ALL
SELECT 'discount_pct', '{P.WIDE_RATE_DECIMAL}', CAST(count(*) FILTER (WHERE {_not_held_sql('discount_pct', P.WIDE_RATE_DECIMAL.upper())}) AS BIGINT) FROM deduped
UNION ALL
SELECT 'cost_price', '{P.WIDE_PRICE_DECIMAL}', CAST(count(*) FILTER (WHERE {_not_held_sql('cost_price', O.WIDE_PRICE)}) AS BIGINT) FROM messy_products""")
def q_held_counts(spark, sf):
    return C.held_counts(messy_orders(spark, sf), messy_products(spark, sf))


@register("derive_counts", f"""{O.PIPELINE}
SELECT 'gross_revenue' AS column_name, CAST(0 AS BIGINT) AS rounded,
       CAST(count(*) FILTER (WHERE gross_revenue IS NULL AND qty IS NOT NULL AND unit_price IS NOT NULL) AS BIGINT) AS not_held FROM derived
UNION ALL
SELECT 'net_revenue' AS column_name, CAST(0 AS BIGINT) AS rounded,
       CAST(count(*) FILTER (WHERE net_revenue IS NULL AND gross_revenue IS NOT NULL AND discount_pct IS NOT NULL) AS BIGINT) AS not_held FROM derived
UNION ALL
SELECT 'margin', CAST(0 AS BIGINT), CAST(count(*) FILTER (WHERE margin IS NULL AND net_revenue IS NOT NULL AND cogs IS NOT NULL) AS BIGINT) FROM derived""")
def q_derive_counts(spark, sf):
    return derive_counts(derived_table(spark, sf))


@register("fill_nulls", f"""{CLEAN_PREFIX}
SELECT order_id, discount_pct AS discount_raw,
       CAST(coalesce({O.guarded('discount_pct', O.RATE)}, CAST(0.0 AS {O.RATE})) AS DOUBLE) AS discount_pct
FROM deduped""")
def q_fill(spark, sf):
    d = C.dedupe_latest(C.parse_multi(messy_orders(spark, sf), "order_ts"), "order_id", "order_ts")
    return d.select(
        "order_id",
        F.col("discount_pct").alias("discount_raw"),
        C.fill_expr("discount_pct", 0.0, P.WIDE_RATE_DECIMAL).cast("double").alias("discount_pct"),
    )


@register("null_rates", f"""{CLEAN_PREFIX}
SELECT 'discount_pct' AS column_name, CAST(count(*) FILTER (WHERE discount_pct IS NULL) AS BIGINT) AS nulls,
       CAST(count(*) AS BIGINT) AS rows,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE discount_pct IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS null_rate,
       CAST(count(*) FILTER (WHERE discount_pct IS NOT NULL AND ({O.guarded('discount_pct', O.RATE)}) IS NULL) AS BIGINT) AS unparseable_filled,
       CAST(0.0 AS DOUBLE) AS fill_value
FROM deduped""")
def q_null_rates(spark, sf):
    return C.null_rates(messy_orders(spark, sf))


@register("clean", f"""{CLEAN_PREFIX}
SELECT order_id, order_ts, customer_id, region, sku, qty, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(discount_pct AS DOUBLE) AS discount_pct, status
FROM cleaned""")
def q_clean(spark, sf):
    return money_as_double(C.clean(messy_orders(spark, sf)))


@register("clean_adaptive", ORACLE["clean"])
def q_clean_adaptive(spark, sf):
    """C8 as a pipeline: the strict parse fails on this extract, so the fallback's rows come."""
    return money_as_double(C.clean_adaptive(messy_orders(spark, sf)))


_CLEAN_STATS_SQL = f"""{CLEAN_PREFIX},
s AS (
  SELECT (SELECT count(*) FROM messy_orders) AS rows_in, count(*) AS rows_after_dedupe,
         count(*) FILTER (WHERE order_ts IS NULL) AS failures
  FROM deduped
)"""


@register("clean_stats", f"""{_CLEAN_STATS_SQL}
SELECT CAST(rows_in AS BIGINT) AS rows_in, CAST(rows_after_dedupe AS BIGINT) AS rows_after_dedupe,
       CAST(rows_in - rows_after_dedupe AS BIGINT) AS duplicates_removed, CAST(failures AS BIGINT) AS failures,
       CAST(rows_after_dedupe - failures AS BIGINT) AS rows_out,
       CAST(rows_in - rows_after_dedupe + failures AS BIGINT) AS rows_dropped,
       CAST(rows_in - failures AS BIGINT) AS resolved,
       CASE WHEN rows_in > 0 THEN CAST(rows_in - rows_after_dedupe + failures AS DOUBLE) / CAST(rows_in AS DOUBLE) * 100.0 ELSE 0.0 END AS drop_pct
FROM s""")
def q_clean_stats(spark, sf):
    return C.clean_stats(messy_orders(spark, sf))


@register("chosen_strategy", f"""{O.with_chain(O.MESSY_ORDERS)},
s AS (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(count(*) FILTER (WHERE order_ts IS NOT NULL AND {O.parse_ts('order_ts', P.STRICT_SPEC)} IS NULL) AS BIGINT) AS unparseable
      FROM messy_orders)
SELECT CASE WHEN unparseable = 0 THEN 'iso-strict' ELSE 'multi-format-day-first' END AS strategy, unparseable, total FROM s""")
def q_chosen(spark, sf):
    return C.choose_strategy(messy_orders(spark, sf))


@register("drop_rate", f"""{_CLEAN_STATS_SQL}
SELECT CAST(rows_in AS BIGINT) AS rows_in, CAST(rows_in - failures AS BIGINT) AS resolved,
       CAST(rows_in - rows_after_dedupe + failures AS BIGINT) AS rows_dropped,
       CASE WHEN rows_in > 0 THEN CAST(rows_in - rows_after_dedupe + failures AS DOUBLE) / CAST(rows_in AS DOUBLE) * 100.0 ELSE 0.0 END AS drop_pct
FROM s""")
def q_drop_rate(spark, sf):
    return C.clean_stats(messy_orders(spark, sf)).select("rows_in", "resolved", "rows_dropped", "drop_pct")


# ------------------------------------------------------------------ J1-J7 joins

JOIN_PREFIX = O.with_chain(*O.FIXTURES, O.MESSY_PRODUCTS_DEFECTS, O.CLEAN_CHAIN)


@register("join_products", f"""{JOIN_PREFIX}
SELECT o.order_id, o.order_ts, o.customer_id, o.region, o.sku, o.qty, CAST(o.unit_price AS DOUBLE) AS unit_price,
       CAST(o.discount_pct AS DOUBLE) AS discount_pct, o.status, p.product_name, p.category, p.cost_price,
       c.segment, c.region AS region_right
FROM cleaned o JOIN messy_products_defects p ON o.sku = p.sku JOIN messy_customers c ON o.customer_id = c.customer_id""")
def q_join_products(spark, sf):
    orders = C.clean(messy_orders(spark, sf))
    return money_as_double(with_dimensions(orders, messy_products(spark, sf, "defects"), messy_customers(spark, sf)))


def _join_stats_sql(rel: str, right: str, key: str) -> str:
    return f"""SELECT '{rel}' AS relation, CAST(count(*) AS BIGINT) AS left_rows,
       CAST(coalesce(sum(m.n), 0) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE m.n IS NOT NULL) AS BIGINT) AS matched,
       CAST(count(*) FILTER (WHERE m.n IS NULL) AS BIGINT) AS unmatched,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE m.n IS NOT NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS match_rate
FROM cleaned o LEFT JOIN (SELECT {key}, count(*) AS n FROM {right} GROUP BY {key}) m ON o.{key} = m.{key}"""


@register("join_stats", f"""{JOIN_PREFIX}
{_join_stats_sql('products', 'messy_products_defects', 'sku')}
UNION ALL
{_join_stats_sql('customers', 'messy_customers', 'customer_id')}""")
def q_join_stats(spark, sf):
    orders = C.clean(messy_orders(spark, sf))
    return J.join_stats_many(orders, [("products", messy_products(spark, sf, "defects"), "sku"),
                                      ("customers", messy_customers(spark, sf), "customer_id")])


@register("join_unmatched", f"""{JOIN_PREFIX}
SELECT order_id, sku, status FROM cleaned o
WHERE NOT EXISTS (SELECT 1 FROM messy_products_defects p WHERE p.sku = o.sku)""")
def q_join_unmatched(spark, sf):
    orders = C.clean(messy_orders(spark, sf)).select("order_id", "sku", "status")
    return J.unmatched_rows(orders, messy_products(spark, sf, "defects"), "sku")


_CONFLICT_SQL = f"""{O.with_chain(*O.FIXTURES, O.CLEAN_CHAIN, O.JOIN_CHAIN)},
s AS (SELECT CAST(count(*) FILTER (WHERE region <> region_right) AS BIGINT) AS conflicts, CAST(count(*) AS BIGINT) AS rows FROM joined)"""


@register("resolve_conflict", f"""{_CONFLICT_SQL}
SELECT 'region' AS column_name, 'region' AS resolved_to, conflicts, rows,
       CASE WHEN rows > 0 THEN CAST(conflicts AS DOUBLE) / CAST(rows AS DOUBLE) ELSE 0.0 END AS conflict_rate
FROM s""")
def q_resolve(spark, sf):
    from tallyframe.plans.retail import joined_orders

    return J.conflict_stats(joined_orders(spark, sf), "region", "region_right")


@register("conflict_rate", f"""{O.with_chain(*O.FIXTURES, O.MESSY_PRODUCTS_DEFECTS, O.CLEAN_CHAIN, O.JOIN_CHAIN)},
s AS (SELECT CAST(count(*) FILTER (WHERE region <> region_right) AS BIGINT) AS conflicts, CAST(count(*) AS BIGINT) AS rows FROM joined),
pm AS (SELECT count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM messy_products_defects p WHERE p.sku = o.sku)) AS matched FROM cleaned o)
SELECT CASE WHEN rows > 0 THEN CAST(conflicts AS DOUBLE) / CAST(rows AS DOUBLE) ELSE 0.0 END AS conflict_rate,
       CASE WHEN total > 0 THEN CAST(matched AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS product_match_rate
FROM s, pm""")
def q_conflict_rate(spark, sf):
    """Conflict rate on the resolved join and the product match rate (defects variant)."""
    from tallyframe.plans.retail import joined_orders

    orders = materialize(C.clean(messy_orders(spark, sf)))
    joined = J.join(J.join(orders, messy_products(spark, sf), "sku"), messy_customers(spark, sf), "customer_id")
    c = J.conflict_stats(joined, "region", "region_right").select("conflict_rate")
    m = J.join_stats(orders, messy_products(spark, sf, "defects"), "sku").select(F.col("match_rate").alias("product_match_rate"))
    return c.crossJoin(m)


@register("region_mismatch", f"""{CLEAN_PREFIX}
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE c.region IS NULL) AS BIGINT) AS missing_parent,
       CAST(count(*) FILTER (WHERE o.region <> c.region) AS BIGINT) AS mismatches
FROM cleaned o LEFT JOIN messy_customers c ON o.customer_id = c.customer_id""")
def q_region_mismatch(spark, sf):
    """Child attribute vs parent attribute through a left join."""
    return J.attribute_mismatches(C.clean(messy_orders(spark, sf)), messy_customers(spark, sf), "customer_id", "region")


# ------------------------------------------------------------------ P1-P15, S3, S4, S7 profiling

from tallyframe.operators import profiling as PR  # noqa: E402
from tallyframe.sources import tables as S  # noqa: E402

ORDER_COLUMNS = ["order_id", "order_ts", "customer_id", "region", "sku", "qty", "unit_price", "discount_pct", "status"]


def _freq(spark, sf):
    return PR.value_frequencies(messy_orders(spark, sf, with_key=True), ORDER_COLUMNS, "_line")


def _shape_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({v}, {O._q(s.regex)}) THEN {O._q(s.spec)}" for s in P.TIMESTAMP_SHAPES) + " END"


FREQ_SQL = O.with_chain(*O.FIXTURES) + """,
long AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {c} AS value, _line FROM messy_orders_keyed" for c in ORDER_COLUMNS
) + """),
freq AS (SELECT column_name, value, count(*) AS n, min(_line) AS first_key FROM long GROUP BY column_name, value)"""


@register("profile_nulls_distinct", f"""{FREQ_SQL}
SELECT column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls,
       CAST(count(*) AS BIGINT) AS distinct
FROM freq GROUP BY column_name""")
def q_prof_nd(spark, sf):
    return PR.nulls_distinct(_freq(spark, sf))


@register("profile_formats", f"""{FREQ_SQL},
shaped AS (SELECT column_name, {_shape_sql('value')} AS spec, n FROM freq WHERE value IS NOT NULL)
SELECT column_name, spec, CAST(sum(n) AS BIGINT) AS n FROM shaped WHERE spec IS NOT NULL GROUP BY column_name, spec""")
def q_prof_formats(spark, sf):
    return PR.formats(PR.column_figures(messy_orders(spark, sf)))


_INT = f"regexp_full_match(value, {O._q(P.INT_LIKE)})"
_NUM = f"(regexp_full_match(value, {O._q(P.INT_LIKE)}) OR regexp_full_match(value, {O._q(P.DECIMAL_LIKE)}))"


@register("profile_types", f"""{FREQ_SQL},
per AS (SELECT column_name, count(*) AS v, count(*) FILTER (WHERE {_shape_sql('value')} IS NOT NULL) AS shaped,
               count(*) FILTER (WHERE {_INT}) AS ints, count(*) FILTER (WHERE {_NUM}) AS nums
        FROM freq WHERE value IS NOT NULL GROUP BY column_name),
cols AS (SELECT DISTINCT column_name FROM freq)
SELECT c.column_name, CASE WHEN p.v IS NULL THEN 'empty' WHEN p.shaped > 0 THEN 'datetime'
       WHEN p.ints = p.v THEN 'int' WHEN p.nums = p.v THEN 'float' ELSE 'str' END AS inferred_type
FROM cols c LEFT JOIN per p ON c.column_name = p.column_name""")
def q_prof_types(spark, sf):
    return PR.inferred_types(PR.column_figures(messy_orders(spark, sf)))


@register("profile_samples", f"""{FREQ_SQL},
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY first_key ASC NULLS LAST, value) AS sample_rank
      FROM freq WHERE value IS NOT NULL)
SELECT column_name, CAST(sample_rank AS INTEGER) AS sample_rank, value FROM r WHERE sample_rank <= {P.SAMPLE_SIZE}""")
def q_prof_samples(spark, sf):
    return PR.samples(_freq(spark, sf))


_FAILING = f"order_ts IS NOT NULL AND {O.parse_ts('order_ts', P.STRICT_SPEC)} IS NULL"


def _shape_rank(v: str) -> str:
    return "CASE " + v + " " + " ".join(f"WHEN {O._q(s.spec)} THEN {i}" for i, s in enumerate(P.TIMESTAMP_SHAPES)) + " END"


@register("profile", f"""{FREQ_SQL},
nd AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls, CAST(count(*) AS BIGINT) AS distinct FROM freq GROUP BY column_name),
per AS (SELECT column_name, count(*) AS v, count(*) FILTER (WHERE {_shape_sql('value')} IS NOT NULL) AS shaped,
               count(*) FILTER (WHERE {_INT}) AS ints, count(*) FILTER (WHERE {_NUM}) AS nums
        FROM freq WHERE value IS NOT NULL GROUP BY column_name),
sh AS (SELECT column_name, {_shape_sql('value')} AS spec, CAST(sum(n) AS BIGINT) AS n FROM freq WHERE value IS NOT NULL GROUP BY ALL),
fm AS (SELECT column_name, string_agg(spec || '=' || n, ', ' ORDER BY {_shape_rank('spec')}) AS formats FROM sh WHERE spec IS NOT NULL GROUP BY column_name),
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY first_key ASC NULLS LAST, value) AS k FROM freq WHERE value IS NOT NULL),
sm AS (SELECT column_name, string_agg(value, ' | ' ORDER BY k) AS samples FROM r WHERE k <= {P.SAMPLE_SIZE} GROUP BY column_name)
SELECT nd.*, CASE WHEN p.v IS NULL THEN 'empty' WHEN p.shaped > 0 THEN 'datetime' WHEN p.ints = p.v THEN 'int' WHEN p.nums = p.v THEN 'float' ELSE 'str' END AS inferred_type,
       coalesce(fm.formats, '') AS formats, coalesce(sm.samples, '') AS samples
FROM nd LEFT JOIN per p USING (column_name) LEFT JOIN fm USING (column_name) LEFT JOIN sm USING (column_name)""")
def q_profile(spark, sf):
    """One record a column, its formats and samples as text."""
    found = PR.profile(messy_orders(spark, sf, with_key=True), "_line")
    return found.withColumns({
        "formats": F.array_join(F.transform("formats", lambda x: F.concat(x["spec"], F.lit("="), x["n"])), ", "),
        "samples": F.array_join("samples", " | "),
    })


@register("null_counts", f"""{FREQ_SQL}
SELECT column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls FROM freq GROUP BY column_name""")
def q_null_counts(spark, sf):
    """P1 alone: no value is shuffled."""
    return PR.null_counts(PR.column_figures(messy_orders(spark, sf)))


@register("distinct_sketches", f"""{FREQ_SQL}
SELECT column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls,
       CAST(count(*) AS BIGINT) AS distinct, CAST({PR.sketch_error()!r} AS DOUBLE) AS error_bound, true AS within_bound FROM freq GROUP BY column_name""")
def q_distinct_sketches(spark, sf):
    """P2 by sketches, written per status of the lines and merged, beside the exact count."""
    orders = messy_orders(spark, sf)
    merged = PR.merged_distinct(materialize(PR.distinct_sketches(orders, F.col("status")), "sketches"))
    exact = PR.nulls_distinct(PR.value_frequencies(orders)).select("column_name", "distinct")
    bound = F.lit(PR.sketch_error())
    return merged.join(exact, "column_name").select(
        "column_name", "rows", "nulls", "distinct", bound.alias("error_bound"),
        (F.abs(F.col("distinct_estimate") - F.col("distinct")) <= bound * F.col("distinct")).alias("within_bound"),
    )


@register("probe_format", f"""{O.with_chain(*O.FIXTURES)},
c AS (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(count(*) FILTER (WHERE {O.parse_ts('order_ts', P.STRICT_SPEC)} IS NOT NULL) AS BIGINT) AS parsed,
             CAST(count(*) FILTER (WHERE {_FAILING}) AS BIGINT) AS unparseable,
             CAST(count(*) FILTER (WHERE {_FAILING} AND TRY_CAST(regexp_extract(order_ts, '^([0-9]{{1,2}})[/-]', 1) AS INTEGER) > 12) AS BIGINT) AS day_first_evidence
      FROM messy_orders),
f AS (SELECT order_ts AS v, min(_line) AS k FROM messy_orders_keyed WHERE {_FAILING} GROUP BY order_ts),
t AS (SELECT v, row_number() OVER (ORDER BY k ASC NULLS LAST, v) AS r FROM f),
w AS (SELECT max(v) FILTER (WHERE r = 1) AS sample_1, max(v) FILTER (WHERE r = 2) AS sample_2, max(v) FILTER (WHERE r = 3) AS sample_3 FROM t)
SELECT 'order_ts' AS column_name, '{P.STRICT_SPEC}' AS spec, total, parsed, unparseable,
       CASE WHEN total > 0 THEN CAST(unparseable AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS failure_rate,
       day_first_evidence, sample_1, sample_2, sample_3
FROM c, w""")
def q_probe(spark, sf):
    """The counts and the first failing samples are two passes; they read the two probed
    columns written once instead of building the extract twice."""
    probed = materialize(messy_orders(spark, sf, with_key=True).select("_line", "order_ts"), "probe")
    return PR.probe_format(probed, "order_ts", order_key="_line")


def _alternates_sql() -> str:
    parts = [
        f"SELECT '{s.spec}' AS spec, {i} AS ordinal, CAST(count(*) FILTER (WHERE {O.parse_ts('order_ts', s.spec)} IS NOT NULL) AS BIGINT) AS reads FROM messy_orders WHERE {_FAILING}"
        for i, s in enumerate(P.TIMESTAMP_SHAPES) if s.spec != P.STRICT_SPEC
    ]
    return "alts AS (SELECT spec, CAST(ordinal AS INTEGER) AS ordinal, reads FROM (" + " UNION ALL ".join(parts) + ") WHERE reads > 0)"


@register("probe_alternates", f"""{O.with_chain(*O.FIXTURES)}, {_alternates_sql()}
SELECT * FROM alts""")
def q_probe_alts(spark, sf):
    return PR.probe_alternates(messy_orders(spark, sf), "order_ts")


@register("format_verdict", f"""{O.with_chain(*O.FIXTURES)}, {_alternates_sql()},
ev AS (SELECT CAST(count(*) FILTER (WHERE {_FAILING} AND TRY_CAST(regexp_extract(order_ts, '^([0-9]{{1,2}})[/-]', 1) AS INTEGER) > 12) AS BIGINT) AS day_first_evidence FROM messy_orders),
fa AS (SELECT arg_min(spec, ordinal) AS alternate, arg_min(reads, ordinal) AS reads, count(*) AS n FROM alts)
SELECT CASE WHEN fa.n = 0 THEN 'no_alternate' WHEN ev.day_first_evidence = 0 THEN 'ambiguous' ELSE 'day_first' END AS verdict,
       fa.alternate, fa.reads, ev.day_first_evidence
FROM ev, fa""")
def q_verdict(spark, sf):
    return PR.format_verdict(messy_orders(spark, sf), "order_ts")


@register("grain_check", f"""{O.with_chain(*O.FIXTURES)}
SELECT 'order_id' AS key_column, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT order_id) + max(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_keys,
       CAST(count(*) - count(DISTINCT order_id) - max(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS repeats,
       count(*) - count(DISTINCT order_id) - max(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) = 0 AS grain_confirmed
FROM messy_orders""")
def q_grain(spark, sf):
    return PR.grain_check(messy_orders(spark, sf), "order_id")


@register("worst_null_column", f"""{O.with_chain(*O.FIXTURES)},
n AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM messy_orders"
    for i, c in enumerate(ORDER_COLUMNS)
) + """)
SELECT column_name, CAST(nulls AS BIGINT) AS nulls, CAST(nulls AS DOUBLE) / CAST(rows AS DOUBLE) AS null_rate
FROM n WHERE nulls > 0 ORDER BY nulls DESC, ordinal LIMIT 1""")
def q_worst_null(spark, sf):
    return PR.worst_null_column(messy_orders(spark, sf))


@register("mixed_formats", f"""{FREQ_SQL},
shaped AS (SELECT column_name, {_shape_sql('value')} AS spec FROM freq WHERE value IS NOT NULL),
f AS (SELECT DISTINCT column_name, spec FROM shaped WHERE spec IS NOT NULL)
SELECT column_name, CAST(count(*) AS BIGINT) AS n_formats, array_to_string(list_sort(list(spec)), ' | ') AS formats
FROM f GROUP BY column_name""")
def q_mixed(spark, sf):
    return PR.mixed_formats(PR.column_figures(messy_orders(spark, sf)))


FK_RELATIONS = [
    ("lineitem.l_orderkey -> orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.l_partkey -> part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.l_suppkey -> supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.o_custkey -> customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer.c_nationkey -> nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier.s_nationkey -> nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation.n_regionkey -> region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("labels.doc_id -> documents", "labels", "doc_id", "documents", "doc_id"),
]


@register("fk_audit", "\nUNION ALL\n".join(
    f"SELECT '{rel}' AS relation, CAST(count(*) AS BIGINT) AS orphans FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pk} = {c}.{ck})"
    for rel, c, ck, p, pk in FK_RELATIONS
))
def q_fk(spark, sf):
    out = None
    for rel, c, ck, p, pk in FK_RELATIONS:
        r = PR.fk_orphans(S.read_table(spark, sf, c), ck, S.read_table(spark, sf, p), pk, rel)
        out = r if out is None else out.unionByName(r)
    return out


@register("load_stats", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS name, CAST((SELECT count(*) FROM {t}) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS n_columns, "
    f"string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name = '{t}'"
    for t in S.TPCH_TABLES
))
def q_load_stats(spark, sf):
    return S.load_stats({t: S.read_table(spark, sf, t) for t in S.TPCH_TABLES})


@register("preview", f"""{O.with_chain(*O.FIXTURES)},
t AS (SELECT * FROM messy_orders_keyed ORDER BY _line, order_ts LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY _line, order_ts) AS INTEGER) AS preview_row, """ + ", ".join(
    [f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ["_line"] + ORDER_COLUMNS]) + " FROM t")
def q_preview(spark, sf):
    return S.preview(messy_orders(spark, sf, with_key=True), ["_line", "order_ts"], 20)


def _contract_sql() -> str:
    return f"""{FREQ_SQL},
src AS (
  SELECT 'messy_orders' AS source, CAST(count(*) AS BIGINT) AS rows, CAST({len(ORDER_COLUMNS)} AS BIGINT) AS n_columns FROM messy_orders
  UNION ALL SELECT 'messy_products', CAST(count(*) AS BIGINT), CAST(4 AS BIGINT) FROM messy_products
  UNION ALL SELECT 'messy_customers', CAST(count(*) AS BIGINT), CAST(3 AS BIGINT) FROM messy_customers
),
nd AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls, CAST(count(*) AS BIGINT) AS distinct FROM freq GROUP BY column_name),
per AS (SELECT column_name, count(*) AS v, count(*) FILTER (WHERE {_shape_sql('value')} IS NOT NULL) AS shaped,
               count(*) FILTER (WHERE {_INT}) AS ints, count(*) FILTER (WHERE {_NUM}) AS nums
        FROM freq WHERE value IS NOT NULL GROUP BY column_name),
nf AS (SELECT column_name, count(DISTINCT {_shape_sql('value')}) AS n_formats FROM freq WHERE value IS NOT NULL GROUP BY column_name)
SELECT source, CAST(NULL AS VARCHAR) AS column_name, rows, n_columns, CAST(NULL AS BIGINT) AS nulls, CAST(NULL AS BIGINT) AS distinct,
       CAST(NULL AS VARCHAR) AS reads_as, CAST(NULL AS BIGINT) AS n_formats FROM src
UNION ALL
SELECT 'messy_orders', nd.column_name, nd.rows, CAST(NULL AS BIGINT), nd.nulls, nd.distinct,
       CASE WHEN p.v IS NULL THEN 'empty' WHEN p.shaped > 0 THEN 'datetime' WHEN p.ints = p.v THEN 'int' WHEN p.nums = p.v THEN 'float' ELSE 'str' END,
       CAST(coalesce(nf.n_formats, 0) AS BIGINT)
FROM nd LEFT JOIN per p ON nd.column_name = p.column_name LEFT JOIN nf ON nd.column_name = nf.column_name"""


@register("schema_contract", _contract_sql())
def q_contract(spark, sf):
    return PR.schema_contract(
        {
            "messy_orders": messy_orders(spark, sf),
            "messy_products": messy_products(spark, sf),
            "messy_customers": messy_customers(spark, sf),
        },
        "messy_orders",
    )


# ------------------------------------------------------------------ V1-V9 verification

from tallyframe.operators import verify as V  # noqa: E402
from tallyframe.plans import verification as VP  # noqa: E402

_FACTS_WIDE_SQL = f"""{O.PIPELINE},
cs AS (SELECT (SELECT count(*) FROM messy_orders) AS rows_in, count(*) AS after, count(*) FILTER (WHERE order_ts IS NULL) AS failures FROM deduped),
qc AS (SELECT count(*) FILTER (WHERE {_needed_sql('qty', 'BIGINT')}) AS qty_coerced,
              CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE discount_pct IS NULL) AS DOUBLE) / count(*) ELSE 0.0 END AS discount_null_rate
       FROM deduped),
pj AS (SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM messy_products p WHERE p.sku = o.sku)) AS products_matched,
              count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM messy_products p WHERE p.sku = o.sku)) AS products_unmatched,
              count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM messy_customers c WHERE c.customer_id = o.customer_id)) AS customers_unmatched
       FROM cleaned o),
cf AS (SELECT count(*) FILTER (WHERE region <> region_right) AS region_conflicts FROM joined),
dk AS (SELECT count(*) AS derived_rows,
              {O.money("coalesce(sum(net_revenue) FILTER (WHERE status = 'completed'), 0)")} AS net_revenue,
              {O.money("coalesce(sum(margin) FILTER (WHERE status = 'completed'), 0)")} AS margin,
              count(*) FILTER (WHERE status = 'completed') AS order_count,
              count(*) FILTER (WHERE status = 'returned') AS returned_count
       FROM derived),
cat AS (SELECT {O.money('sum(n)')} AS category_total, count(*) AS category_groups FROM (SELECT sum(net_revenue) AS n FROM derived WHERE status = 'completed' GROUP BY category)),
reg AS (SELECT {O.money('sum(n)')} AS region_total FROM (SELECT sum(net_revenue) AS n FROM derived WHERE status = 'completed' GROUP BY region)),
wk AS (SELECT count(DISTINCT order_week) AS week_points FROM derived WHERE status = 'completed'),
tp AS (SELECT least(count(DISTINCT sku), {P.TOP_PRODUCT_LIMIT}) AS top_products FROM derived WHERE status = 'completed'),
fw AS (
  SELECT CAST({len(ORDER_COLUMNS)} + 4 + 3 AS DOUBLE) AS contract_columns, CAST(3 AS DOUBLE) AS source_count,
         CAST(cs.rows_in AS DOUBLE) AS rows_in, CAST(cs.after - cs.failures AS DOUBLE) AS rows_clean,
         CAST(cs.rows_in - cs.after + cs.failures AS DOUBLE) AS rows_dropped,
         CAST(round_even(cs.rows_in * {P.DROP_BUDGET_FRACTION}, 0) AS DOUBLE) AS drop_budget_rows,
         CAST(cs.rows_in - cs.after AS DOUBLE) AS duplicates_removed,
         CAST(qc.qty_coerced AS DOUBLE) AS qty_coerced, CAST(qc.discount_null_rate AS DOUBLE) AS discount_null_rate,
         CAST(cs.failures AS DOUBLE) AS timestamp_failures,
         CAST(pj.products_matched AS DOUBLE) AS products_matched, CAST(pj.products_unmatched AS DOUBLE) AS products_unmatched,
         CAST(pj.customers_unmatched AS DOUBLE) AS customers_unmatched, CAST(cf.region_conflicts AS DOUBLE) AS region_conflicts,
         CAST(dk.derived_rows AS DOUBLE) AS derived_rows, dk.net_revenue, CAST(dk.order_count AS DOUBLE) AS order_count,
         {O.ratio('dk.margin', 'dk.net_revenue')} AS margin_pct,
         {O.ratio('dk.returned_count', 'dk.order_count + dk.returned_count')} AS return_rate,
         CAST(cat.category_total AS DOUBLE) AS category_total, CAST(cat.category_groups AS DOUBLE) AS category_groups,
         CAST(reg.region_total AS DOUBLE) AS region_total, CAST(wk.week_points AS DOUBLE) AS week_points,
         CAST(tp.top_products AS DOUBLE) AS top_products, CAST(5 AS DOUBLE) AS dashboard_surfaces
  FROM cs, qc, pj, cf, dk, cat, reg, wk, tp
),
facts AS (UNPIVOT fw ON COLUMNS(*) INTO NAME key VALUE num)"""


@register("facts", f"""{_FACTS_WIDE_SQL}
SELECT key, num FROM facts""")
def q_facts(spark, sf):
    return VP.facts(spark, sf)


def _named(no: int) -> str:
    area, label = V.CHECKS[no]
    return f"{no} AS check_no, '{area}' AS area, '{label}' AS label"


_CHECKS_SQL = f"""{_FACTS_WIDE_SQL},
c0 AS (
  SELECT {_named(1)}, contract_columns AS measured, source_count AS threshold, CAST(NULL AS BOOLEAN) AS passed FROM fw
  UNION ALL SELECT {_named(2)}, rows_dropped, drop_budget_rows, rows_dropped <= drop_budget_rows FROM fw WHERE rows_in <> 0
  UNION ALL SELECT {_named(3)}, timestamp_failures, 0.0, timestamp_failures = 0 FROM fw WHERE rows_in <> 0
  UNION ALL SELECT {_named(4)}, duplicates_removed, qty_coerced, NULL FROM fw WHERE rows_in <> 0
  UNION ALL SELECT {_named(5)}, products_unmatched, products_matched, products_unmatched = 0 FROM fw
  UNION ALL SELECT {_named(6)}, region_conflicts, NULL, NULL FROM fw
  UNION ALL SELECT {_named(7)}, category_total, net_revenue, abs(category_total - net_revenue) < {P.MONEY_TOLERANCE} FROM fw
  UNION ALL SELECT {_named(8)}, region_total, net_revenue, abs(region_total - net_revenue) < {P.MONEY_TOLERANCE} FROM fw
  UNION ALL SELECT {_named(9)}, net_revenue, order_count, NULL FROM fw
  UNION ALL SELECT {_named(11)}, dashboard_surfaces, week_points, NULL FROM fw
),
c1 AS (
  SELECT * FROM c0
  UNION ALL
  SELECT {_named(10)},
         CAST(count(*) FILTER (WHERE passed = FALSE) AS DOUBLE), CAST(count(*) FILTER (WHERE passed IS NOT NULL) AS DOUBLE), NULL FROM c0
),
checks AS (
  SELECT CAST(check_no AS INTEGER) AS check_no, area, label, CAST(measured AS DOUBLE) AS measured, CAST(threshold AS DOUBLE) AS threshold,
         CASE WHEN passed IS NULL THEN 'recorded' WHEN passed THEN 'met' ELSE 'MISSED' END AS verdict
  FROM c1
)"""


@register("verify_checks", f"""{_CHECKS_SQL}
SELECT * FROM checks""")
def q_verify_checks(spark, sf):
    return V.run_checks(VP.facts(spark, sf))


@register("verify_totals", f"""{_CHECKS_SQL}
SELECT CAST(count(*) FILTER (WHERE verdict <> 'recorded') AS BIGINT) AS asserted, CAST(count(*) FILTER (WHERE verdict = 'met') AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE verdict = 'MISSED') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE verdict = 'recorded') AS BIGINT) AS recorded
FROM checks""")
def q_verify_totals(spark, sf):
    return V.totals(V.run_checks(VP.facts(spark, sf)))


JOINED_COLUMNS = ORDER_COLUMNS + ["product_name", "category", "cost_price", "segment"]


def _rates_sql(table: str, columns: list[str]) -> str:
    """The null rates of a table's columns that have nulls, as text."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER (WHERE {c} IS NULL) AS z, count(*) AS n FROM {table}" for c in columns)
    return f"(SELECT coalesce(string_agg(c || '=' || CAST(CAST(CAST(z AS DOUBLE) / n AS DECIMAL(9,6)) AS VARCHAR), ',' ORDER BY c), '') FROM ({each}) WHERE z > 0)"


@register("stage_metrics", f"""{O.PIPELINE},
w AS (SELECT (SELECT count(*) FROM messy_orders) AS rows_in, (SELECT count(*) FROM cleaned) AS clean_out,
             (SELECT count(*) FROM joined) AS join_out, (SELECT count(*) FROM derived) AS derive_out)
SELECT 'load' AS stage, CAST(rows_in AS BIGINT) AS rows_in, CAST(rows_in AS BIGINT) AS rows_out, CAST(0 AS BIGINT) AS rows_dropped, CAST(0 AS BIGINT) AS columns_added, '' AS added,
       CAST(NULL AS VARCHAR) AS null_rates, false AS written FROM w
UNION ALL SELECT 'clean', rows_in, clean_out, rows_in - clean_out, 0, '', """ + _rates_sql("cleaned", ORDER_COLUMNS) + """, true FROM w
UNION ALL SELECT 'join', clean_out, join_out, clean_out - join_out, 4, 'product_name,category,cost_price,segment', """ + _rates_sql("derived", JOINED_COLUMNS) + """, false FROM w
UNION ALL SELECT 'derive', join_out, derive_out, join_out - derive_out, 7, 'gross_revenue,net_revenue,cogs,margin,margin_pct,order_date,order_week', """ + _rates_sql("derived", JOINED_COLUMNS + list(DERIVED_COLUMNS)) + """, true FROM w""")
def q_stage_metrics(spark, sf):
    """V9; of the bytes written, which differ from engine to engine, only that there are some."""
    return VP.stage_metrics(spark, sf).withColumn("written", F.coalesce(F.col("bytes") > 0, F.lit(False))).drop("bytes")


# ------------------------------------------------------------------ E2-E17 event log (batch)

from tallyframe.operators import eventlog as EV  # noqa: E402
from tallyframe.plans.fixtures import event_log as _event_log  # noqa: E402
from tallyframe.session import materialize  # noqa: E402


def event_log(spark, sf):
    """The derived run log, written once per query (every sub-aggregate then scans it)."""
    return materialize(_event_log(spark, sf))

AS_OF_SEQ = 30
STREAM_BLOCK = 16
EV_COLS = 'run_id, seq, "at", type, task_id, agent_id'


@register("event_dedupe", f"""{O.EVENTS}
SELECT DISTINCT {EV_COLS} FROM (SELECT {EV_COLS} FROM event_log UNION ALL SELECT {EV_COLS} FROM event_log WHERE seq % 10 = 0)""")
def q_event_dedupe(spark, sf):
    """The log delivered with every tenth position twice; exactly-once by (run, seq)."""
    ev = event_log(spark, sf).select("run_id", "seq", "at", "type", "task_id", "agent_id")
    doubled = ev.unionByName(ev.filter(F.col("seq") % 10 == 0))
    return EV.dedupe_events(doubled)


@register("run_clock", f"""{O.EVENTS},
r AS (SELECT run_id, seq, "at" - (k % 7) * 1000 AS reported_at FROM event_log)
SELECT run_id, seq, reported_at, max(reported_at) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS clock FROM r""")
def q_run_clock(spark, sf):
    """Reported times lag by (k % 7) seconds; the clock is their running max."""
    ev = event_log(spark, sf).select("run_id", "seq", (F.col("at") - (F.col("k") % 7) * 1000).alias("reported_at"))
    return EV.run_clock(ev, "reported_at", "clock")


@register("task_status", f"""{O.EVENTS_TASKS}
SELECT run_id, task_id, status FROM task_fields WHERE status IS NOT NULL""")
def q_task_status(spark, sf):
    return EV.task_status(event_log(spark, sf))


@register("task_fields", f"""{O.EVENTS_TASKS}
SELECT run_id, task_id, status, owner, attempts, progress, {O.TASK_METRICS} FROM task_fields""")
def q_task_fields(spark, sf):
    """E5 with the metrics of each task's last completion."""
    return EV.task_fields(event_log(spark, sf)).select("run_id", "task_id", "status", "owner", "attempts", "progress", *EV.metric_columns())


@register("status_as_of", O.with_chain(O.EVENT_LOG, f"prefix AS (SELECT * FROM event_log WHERE seq <= {AS_OF_SEQ})",
                                       O.task_fields_cte("prefix")) + """
SELECT run_id, task_id, status FROM task_fields WHERE status IS NOT NULL""")
def q_status_as_of(spark, sf):
    return EV.status_as_of(event_log(spark, sf), AS_OF_SEQ)


@register("retry_count", f"""{O.EVENTS}
SELECT run_id, CAST(count(*) FILTER (WHERE type = 'task.retried') AS BIGINT) AS retry_count FROM event_log GROUP BY run_id""")
def q_retry_count(spark, sf):
    return EV.retry_count(event_log(spark, sf))


@register("run_header", f"""{O.with_chain(O.EVENT_LOG, O.RUN_HEADER)}
SELECT * FROM run_header""")
def q_run_header(spark, sf):
    return EV.run_header(event_log(spark, sf))


@register("stream_text", f"""{O.with_chain(O.EVENT_LOG, O.STREAM_TEXT)}
SELECT * FROM stream_text""")
def q_stream_text(spark, sf):
    return EV.stream_text(event_log(spark, sf))


@register("stream_blocks", f"""{O.with_chain(O.EVENT_LOG, O.STREAM_TEXT)},
c AS (SELECT k.run_id, k.artifact_id, k.seq, k.text, sum(length(k.text)) OVER (PARTITION BY k.run_id, k.artifact_id ORDER BY k.seq) - length(k.text) AS start
      FROM keyed k JOIN op USING (run_id, artifact_id) WHERE k.seq > op.o AND k.type = 'artifact.chunk')
SELECT run_id, artifact_id, CAST(start // {STREAM_BLOCK} AS BIGINT) AS block, CAST(min(start) AS BIGINT) AS "offset", string_agg(text, '' ORDER BY seq) AS text,
       CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY run_id, artifact_id, start // {STREAM_BLOCK}""")
def q_stream_blocks(spark, sf):
    """E8 in rows of blocks; short blocks, so that the fixture's texts have several."""
    return EV.stream_blocks(event_log(spark, sf), STREAM_BLOCK)


@register("artifact_rows", f"""{O.EVENTS}
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS position, artifact_id, seq FROM event_log WHERE type = 'artifact.created'""")
def q_artifact_rows(spark, sf):
    return EV.artifact_rows(event_log(spark, sf))


@register("artifact_list", f"""{O.with_chain(O.EVENT_LOG, O.ARTIFACT_LIST)}
SELECT * FROM artifact_list""")
def q_artifact_list(spark, sf):
    return EV.artifact_list(event_log(spark, sf))


@register("agent_activity", f"""{O.with_chain(O.EVENT_LOG, O.task_fields_cte(), O.AGENT_ACTIVITY)}
SELECT * FROM agent_activity""")
def q_agent_activity(spark, sf):
    return EV.agent_activity(event_log(spark, sf))


def _pairs_sql(v: str) -> str:
    return f"coalesce(string_agg(task_id || '=' || CAST({v} AS VARCHAR), ',' ORDER BY task_id) FILTER (WHERE {v} IS NOT NULL), '')"


@register("run_summary", O.with_chain(O.EVENT_LOG, O.task_fields_cte(), O.RUN_HEADER, O.STREAM_TEXT, O.ARTIFACT_LIST, O.AGENT_ACTIVITY) + f""",
tasks AS (SELECT run_id, {_pairs_sql('status')} AS task_status, {_pairs_sql('owner')} AS task_agent, {_pairs_sql('attempts')} AS task_attempts
          FROM task_fields GROUP BY run_id),
counts AS (SELECT run_id, CAST(count(*) FILTER (WHERE type = 'task.retried') AS BIGINT) AS retry_count,
                  CAST(count(*) FILTER (WHERE type = 'log.emitted') AS BIGINT) AS log_count FROM event_log GROUP BY run_id),
streams AS (SELECT run_id, string_agg(artifact_id, ',' ORDER BY artifact_id) AS streaming_ids, CAST(sum(chars) AS BIGINT) AS streamed_chars,
                   coalesce(string_agg(artifact_id, ',' ORDER BY artifact_id) FILTER (WHERE complete), '') AS streams_complete
            FROM stream_text GROUP BY run_id),
agents AS (SELECT run_id, string_agg(agent_id, ',' ORDER BY agent_id) AS agents_spawned,
                  coalesce(string_agg(agent_id, ',' ORDER BY agent_id) FILTER (WHERE idle), '') AS agents_idle
           FROM agent_activity GROUP BY run_id),
plans AS (SELECT run_id, CAST(arg_max(plan_n, seq) AS BIGINT) AS plan_task_count FROM event_log WHERE type = 'plan.built' GROUP BY run_id)
SELECT h.run_id, h.last_seq, h.seed, h.speed, h.requirement_title, h.started, h.completed, h.error, h.duration_ms,
  coalesce(t.task_status, '') AS task_status, coalesce(t.task_agent, '') AS task_agent, coalesce(t.task_attempts, '') AS task_attempts,
  c.retry_count, a.artifact_count, a.artifact_ids, c.log_count,
  coalesce(s.streaming_ids, '') AS streaming_ids, coalesce(s.streamed_chars, 0) AS streamed_chars, coalesce(s.streams_complete, '') AS streams_complete,
  coalesce(g.agents_spawned, '') AS agents_spawned, coalesce(g.agents_idle, '') AS agents_idle, coalesce(p.plan_task_count, 0) AS plan_task_count
FROM run_header h LEFT JOIN tasks t USING (run_id) LEFT JOIN counts c USING (run_id) LEFT JOIN artifact_list a USING (run_id)
LEFT JOIN streams s USING (run_id) LEFT JOIN agents g USING (run_id) LEFT JOIN plans p USING (run_id)""")
def q_run_summary(spark, sf):
    return EV.run_summary(event_log(spark, sf))


def _list_sql(name: str, source: str, key: str, value: str = "CAST(NULL AS VARCHAR)", where: str = "true", order: str | None = None) -> str:
    return (f"SELECT run_id, '{name}' AS list, row_number() OVER (PARTITION BY run_id ORDER BY {order or key}) AS position, {key} AS key, "
            f"CAST({value} AS VARCHAR) AS value FROM {source} WHERE {where}")


@register("run_lists", O.with_chain(O.EVENT_LOG, O.task_fields_cte(), O.STREAM_TEXT, O.AGENT_ACTIVITY) + "\n" + "\nUNION ALL\n".join([
    *[_list_sql(name, "task_fields", "task_id", col, f"{col} IS NOT NULL") for name, col in (("task_status", "status"), ("task_agent", "owner"), ("task_attempts", "attempts"))],
    _list_sql("artifact_ids", "event_log", "artifact_id", where="type = 'artifact.created'", order="seq"),
    _list_sql("streaming_ids", "stream_text", "artifact_id"),
    _list_sql("streams_complete", "stream_text", "artifact_id", where="complete"),
    _list_sql("agents_spawned", "agent_activity", "agent_id"),
    _list_sql("agents_idle", "agent_activity", "agent_id", where="idle"),
]))
def q_run_lists(spark, sf):
    return EV.run_lists(event_log(spark, sf))


@register("run_figures", O.with_chain(O.EVENT_LOG, O.RUN_HEADER, O.STREAM_TEXT) + """,
counts AS (SELECT run_id, count(*) FILTER (WHERE type = 'task.retried') AS retry_count, count(*) FILTER (WHERE type = 'artifact.created') AS artifact_count,
                  count(*) FILTER (WHERE type = 'log.emitted') AS log_count,
                  CAST(coalesce(arg_max(plan_n, seq) FILTER (WHERE type = 'plan.built'), 0) AS BIGINT) AS plan_task_count FROM event_log GROUP BY run_id),
chars AS (SELECT run_id, CAST(sum(chars) AS BIGINT) AS c FROM stream_text GROUP BY run_id)
SELECT h.*, retry_count, artifact_count, log_count, plan_task_count, coalesce(c, 0) AS streamed_chars
FROM run_header h JOIN counts USING (run_id) LEFT JOIN chars USING (run_id)""")
def q_run_figures(spark, sf):
    return EV.run_figures(event_log(spark, sf))


LOG_LEVELS = ("warn", "error")


@register("log_tail", f"""{O.EVENTS}
SELECT run_id, seq, level, agent_id, task_id, message, CAST(tail_rank AS INTEGER) AS tail_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS tail_rank
  FROM event_log WHERE type = 'log.emitted' AND level IN ('warn', 'error')) WHERE tail_rank <= 500""")
def q_log_tail(spark, sf):
    """Last 500 warn/error lines per run."""
    return EV.log_tail(event_log(spark, sf), 500, LOG_LEVELS)


@register("task_log_tail", f"""{O.EVENTS}
SELECT run_id, seq, level, agent_id, task_id, message, CAST(tail_rank AS INTEGER) AS tail_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY seq DESC) AS tail_rank
  FROM event_log WHERE type = 'log.emitted') WHERE tail_rank <= 60""")
def q_task_log_tail(spark, sf):
    """E12 per task: the last 60 lines of each (run, task)."""
    return EV.log_tail(event_log(spark, sf), 60, per=("run_id", "task_id"))


@register("latest_artifact", f"""{O.EVENTS},
starts AS (SELECT run_id, min(ts) AS st FROM event_log GROUP BY run_id),
c AS (SELECT e.artifact_id, e.run_id, e.seq, s.st,
             row_number() OVER (PARTITION BY e.artifact_id ORDER BY s.st DESC, e.run_id DESC, e.seq DESC) AS rn
      FROM event_log e JOIN starts s USING (run_id) WHERE e.type = 'artifact.created')
SELECT artifact_id, run_id, seq, st AS run_started FROM c WHERE rn = 1""")
def q_latest_artifact(spark, sf):
    return EV.latest_artifact(event_log(spark, sf))


@register("contract_violations", f"""{O.EVENTS},
per_run AS (SELECT run_id, max(seq) + 1 - count(DISTINCT seq) + count(*) - count(DISTINCT seq) AS v1,
                   min(seq) FILTER (WHERE type = 'run.completed') AS done FROM event_log GROUP BY run_id),
r2 AS (SELECT run_id, count(*) FILTER (WHERE "at" < clock) AS v2 FROM (
         SELECT run_id, "at", max("at") OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS clock FROM event_log) GROUP BY run_id),
per_task AS (
  SELECT run_id, task_id, count(*) FILTER (WHERE type = 'task.started') AS starts,
    count(*) FILTER (WHERE type = 'task.completed' OR (type = 'task.failed' AND NOT coalesce(recoverable, false))) AS terms,
    max(seq) FILTER (WHERE type = 'task.completed' OR (type = 'task.failed' AND NOT coalesce(recoverable, false))) AS last_term,
    max(seq) FILTER (WHERE type = 'task.completed') AS last_done
  FROM event_log WHERE type LIKE 'task.%' GROUP BY run_id, task_id),
r3 AS (SELECT run_id, count(*) FILTER (WHERE starts <> terms) AS v3 FROM per_task GROUP BY run_id),
fr AS (SELECT e.*, p.last_term FROM event_log e LEFT JOIN per_task p USING (run_id, task_id)
       WHERE e.type = 'task.retried' OR (e.type = 'task.failed' AND coalesce(e.recoverable, false))),
lr AS (SELECT run_id, task_id, max(seq) FILTER (WHERE type = 'task.retried' AND seq < last_term) AS lr FROM fr GROUP BY run_id, task_id),
r4 AS (SELECT f.run_id, count(*) FILTER (WHERE l.lr IS NULL OR f.seq >= l.lr) AS v4
       FROM fr f LEFT JOIN lr l USING (run_id, task_id) WHERE f.type = 'task.failed' GROUP BY f.run_id),
r5 AS (SELECT e.run_id, count(*) FILTER (WHERE p.last_done IS NULL OR e.seq > p.last_done) AS v5
       FROM event_log e LEFT JOIN per_task p USING (run_id, task_id) WHERE e.type = 'artifact.created' GROUP BY e.run_id),
fo AS (SELECT run_id, artifact_id, min(seq) AS fo FROM event_log WHERE type = 'artifact.streaming' GROUP BY ALL),
r6 AS (SELECT e.run_id, count(*) FILTER (WHERE fo.fo IS NULL OR e.seq < fo.fo) AS v6
       FROM event_log e LEFT JOIN fo USING (run_id, artifact_id) WHERE e.type = 'artifact.chunk' GROUP BY e.run_id),
r7 AS (SELECT e.run_id, count(*) FILTER (WHERE p.done IS NOT NULL AND e.seq > p.done) AS v7 FROM event_log e JOIN per_run p USING (run_id) GROUP BY e.run_id),
w AS (SELECT p.run_id, p.v1, r2.v2, r3.v3, r4.v4, r5.v5, r6.v6, r7.v7 FROM per_run p
      LEFT JOIN r2 USING (run_id) LEFT JOIN r3 USING (run_id) LEFT JOIN r4 USING (run_id) LEFT JOIN r5 USING (run_id)
      LEFT JOIN r6 USING (run_id) LEFT JOIN r7 USING (run_id))
""" + "\nUNION ALL\n".join(
    f"SELECT run_id, CAST({i} AS INTEGER) AS rule, CAST(coalesce(v{i}, 0) AS BIGINT) AS violations FROM w" for i in range(1, 8)
))
def q_contract(spark, sf):
    return EV.contract_violations(event_log(spark, sf))


@register("artifact_order_violations", f"""{O.EVENTS},
c AS (SELECT run_id, artifact_id, seq, type FROM event_log WHERE type IN ('artifact.streaming', 'artifact.chunk', 'artifact.created')),
m AS (
  SELECT run_id, type,
    max(seq) FILTER (WHERE type = 'artifact.streaming') OVER before AS last_open,
    max(seq) FILTER (WHERE type = 'artifact.created') OVER before AS last_created,
    min(seq) FILTER (WHERE type = 'artifact.chunk') OVER after AS next_chunk,
    min(seq) FILTER (WHERE type = 'artifact.created') OVER after AS next_created
  FROM c
  WINDOW before AS (PARTITION BY run_id, artifact_id ORDER BY seq ROWS UNBOUNDED PRECEDING),
         after AS (PARTITION BY run_id, artifact_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (
  SELECT run_id,
    count(*) FILTER (WHERE type = 'artifact.chunk' AND last_open IS NULL) AS p0,
    count(*) FILTER (WHERE type = 'artifact.chunk' AND last_created > last_open) AS p1,
    count(*) FILTER (WHERE type = 'artifact.streaming' AND next_created IS NOT NULL AND (next_chunk IS NULL OR next_chunk > next_created)) AS p2
  FROM m GROUP BY run_id),
r AS (SELECT DISTINCT run_id FROM event_log)
""" + "\nUNION ALL\n".join(
    f"SELECT run_id, '{part}' AS part, CAST(coalesce(p{i}, 0) AS BIGINT) AS violations FROM r LEFT JOIN p USING (run_id)"
    for i, part in enumerate(EV.ORDER_PARTS)
))
def q_artifact_order(spark, sf):
    return EV.artifact_order_violations(event_log(spark, sf))


@register("step_progress", O.with_chain(O.EVENT_LOG, O.task_fields_cte()) + """,
lastplan AS (SELECT pt.run_id, pt.task_id FROM plan_tasks pt JOIN lp ON pt.run_id = lp.run_id AND pt.seq = lp.lp),
declared AS (SELECT run_id, task_id, unnest(['s0', 's1', 's2', 's3']) AS step_id FROM lastplan),
seen AS (SELECT DISTINCT run_id, task_id, step_id FROM event_log WHERE type = 'task.progress'),
n AS (SELECT run_id, task_id, count(*) AS steps_declared FROM declared GROUP BY ALL),
d AS (SELECT run_id, task_id, count(*) AS steps_done FROM declared dd
      WHERE EXISTS (SELECT 1 FROM seen s WHERE s.run_id = dd.run_id AND s.task_id = dd.task_id AND s.step_id = dd.step_id) GROUP BY ALL)
SELECT n.run_id, n.task_id, CAST(coalesce(d.steps_done, 0) AS BIGINT) AS steps_done, CAST(n.steps_declared AS BIGINT) AS steps_declared,
       CASE WHEN n.steps_declared > 0 THEN CAST(coalesce(d.steps_done, 0) AS DOUBLE) / n.steps_declared ELSE 0.0 END AS step_progress
FROM n LEFT JOIN d USING (run_id, task_id)""")
def q_step_progress(spark, sf):
    return EV.step_progress(event_log(spark, sf))


# ------------------------------------------------------------------ streaming

from tallyframe.streaming import eventstream as ES  # noqa: E402


@register("stream_task_status", ORACLE["task_status"])
def q_stream_task_status(spark, sf):
    """E4 via Structured Streaming over a log folder, state per run."""
    return ES.stream_task_status(spark, event_log(spark, sf)).filter(F.col("status").isNotNull()).select(
        "run_id", "task_id", "status"
    )


@register("stream_task_fields", ORACLE["task_fields"])
def q_stream_task_fields(spark, sf):
    return ES.stream_task_status(spark, event_log(spark, sf)).select(
        "run_id", "task_id", "status", "owner", "attempts", "progress", *EV.metric_columns()
    )


@register("stream_run_header", ORACLE["run_header"])
def q_stream_run_header(spark, sf):
    return ES.stream_run_header(spark, event_log(spark, sf))


# ------------------------------------------------------------------ G1-G4 dependency edges

from tallyframe.operators import edges as G  # noqa: E402
from tallyframe.operators.cycles import strong_components  # noqa: E402
from tallyframe.plans.fixtures import edges as edge_table  # noqa: E402
from tallyframe.plans.fixtures import part_nodes  # noqa: E402

_EDGE_CTES = """
nodes AS (SELECT 'parts' AS group_id, p_partkey AS node FROM part),
edges_defects AS (
  SELECT 'parts' AS group_id, p_partkey AS child,
         CASE WHEN p_partkey % 97 = 0 THEN CAST(-1 AS BIGINT) WHEN p_partkey % 101 = 0 THEN p_partkey
              ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS parent
  FROM part WHERE p_partkey > 0
),
edges_cyclic AS (
  SELECT 'parts' AS group_id, p_partkey AS child, CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM part WHERE p_partkey > 0
  UNION ALL
  SELECT 'parts', CAST(floor(p_partkey / 4) AS BIGINT), p_partkey FROM part WHERE p_partkey > 0 AND p_partkey % 97 = 50
),
good_defects AS (SELECT DISTINCT e.group_id, e.child, e.parent FROM edges_defects e
                 WHERE e.child <> e.parent AND EXISTS (SELECT 1 FROM nodes n WHERE n.group_id = e.group_id AND n.node = e.parent)),
good_cyclic AS (SELECT DISTINCT e.group_id, e.child, e.parent FROM edges_cyclic e
                WHERE e.child <> e.parent AND EXISTS (SELECT 1 FROM nodes n WHERE n.group_id = e.group_id AND n.node = e.parent))"""

_CYCLE_CTES = """
cl(group_id, node, ancestor) AS (
  SELECT group_id, child, parent FROM good_cyclic
  UNION
  SELECT cl.group_id, cl.node, g.parent FROM cl JOIN good_cyclic g ON cl.group_id = g.group_id AND cl.ancestor = g.child
),
members AS (SELECT DISTINCT group_id, node FROM cl WHERE node = ancestor),
blocked AS (SELECT group_id, node FROM members
            UNION SELECT cl.group_id, cl.node FROM cl JOIN members m ON cl.group_id = m.group_id AND cl.ancestor = m.node),
roots AS (SELECT n.group_id, n.node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM good_cyclic g WHERE g.group_id = n.group_id AND g.child = n.node)),
lv(group_id, node, level) AS (
  SELECT group_id, node, 0 FROM roots
  UNION ALL
  SELECT g.group_id, g.child, lv.level + 1 FROM lv JOIN good_cyclic g ON g.group_id = lv.group_id AND g.parent = lv.node
  WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.group_id = g.group_id AND b.node = g.child)
),
levels AS (SELECT group_id, node, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY group_id, node)"""


@register("edge_audit", f"""WITH {_EDGE_CTES}
SELECT group_id, child, parent, 'self_reference' AS problem FROM edges_defects WHERE child = parent
UNION ALL
SELECT e.group_id, e.child, e.parent, 'unknown_parent' FROM edges_defects e
WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.group_id = e.group_id AND n.node = e.parent)""")
def q_edge_audit(spark, sf):
    return G.audit(edge_table(spark, sf, "defects"), part_nodes(spark, sf))


@register("edge_closure", f"""WITH RECURSIVE {_EDGE_CTES},
cl(group_id, node, ancestor, depth) AS (
  SELECT group_id, child, parent, 1 FROM good_defects
  UNION ALL
  SELECT cl.group_id, cl.node, g.parent, cl.depth + 1 FROM cl JOIN good_defects g ON cl.group_id = g.group_id AND cl.ancestor = g.child
)
SELECT group_id, node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM cl GROUP BY group_id, node, ancestor""")
def q_edge_closure(spark, sf):
    """G3 over the audited graph (bad edges left out): every ancestor with its distance."""
    nodes = part_nodes(spark, sf)
    return G.closure(G.good_edges(edge_table(spark, sf, "defects"), nodes))


@register("cycle_members", f"""WITH RECURSIVE {_EDGE_CTES}, {_CYCLE_CTES}
SELECT group_id, node FROM members""")
def q_cycle_members(spark, sf):
    return G.cycle_members(G.good_edges(edge_table(spark, sf, "cyclic"), part_nodes(spark, sf)))


@register("cycle_components", f"""WITH RECURSIVE {_EDGE_CTES}, {_CYCLE_CTES}
SELECT a.group_id, a.node, least(a.node, min(a.ancestor)) AS component
FROM cl a JOIN cl b ON a.group_id = b.group_id AND a.node = b.ancestor AND a.ancestor = b.node GROUP BY a.group_id, a.node""")
def q_cycle_components(spark, sf):
    """Which cycles belong together, named by their least node."""
    return strong_components(G.good_edges(edge_table(spark, sf, "cyclic"), part_nodes(spark, sf)))


@register("edge_level", f"""WITH RECURSIVE {_EDGE_CTES}, {_CYCLE_CTES}
SELECT group_id, node, level FROM levels""")
def q_edge_level(spark, sf):
    return G.levels(edge_table(spark, sf, "cyclic"), part_nodes(spark, sf))


@register("cycle_summary", f"""WITH RECURSIVE {_EDGE_CTES}, {_CYCLE_CTES}
SELECT n.group_id, CAST(count(*) AS BIGINT) AS nodes,
       CAST((SELECT count(*) FROM members) AS BIGINT) AS members,
       CAST(count(*) - (SELECT count(*) FROM levels) - (SELECT count(*) FROM members) AS BIGINT) AS stuck
FROM nodes n GROUP BY n.group_id""")
def q_cycle_summary(spark, sf):
    nodes = part_nodes(spark, sf)
    e = edge_table(spark, sf, "cyclic")
    return G.cycle_summary(nodes, G.cycle_members(G.good_edges(e, nodes)), G.levels(e, nodes))


# ------------------------------------------------------------------ S1, S5, S6, A8 sources and sinks

from tallyframe.operators import cube as CB  # noqa: E402
from tallyframe.plans.retail import save_derived  # noqa: E402
from tallyframe.session import scratch_path  # noqa: E402

@register("csv_text_scan", f"""{O.with_chain(O.MESSY_ORDERS)}
SELECT * FROM messy_orders""")
def q_csv_text_scan(spark, sf):
    """The orders extract written as header CSV and read back with every column typed as
    text (no inference); padding and empty-as-null survive the round trip."""
    path = scratch_path(spark, "orders-csv")
    (
        messy_orders(spark, sf).write.mode("overwrite")
        .option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return S.read_text_csv(spark, path, ORDER_COLUMNS)


@register("csv_dialect", """
SELECT CAST(p_partkey AS VARCHAR) AS id, '"' || p_name || '", size' || chr(10) || 'of ' || p_type AS name,
       nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_type END, '') AS kind FROM part""")
def q_csv_dialect(spark, sf):
    """Quotes and line feeds inside fields, and columns found by their header names (the
    file has them in another order than they are asked for)."""
    path = scratch_path(spark, "dialect-csv")
    p = S.read_table(spark, sf, "part")
    name = F.concat(F.lit('"'), "p_name", F.lit('", size\nof '), "p_type")
    kind = F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), "p_type"))
    p.select(kind.alias("kind"), name.alias("name"), F.col("p_partkey").cast("string").alias("id")).write.option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_text_csv(spark, path, ["id", "name", "kind"])


@register("saved_table_query", O.kpis_sql(**DATES, **REGION))
def q_saved_table_query(spark, sf):
    """The derived table is retained once (written to the shared checkpoint folder) and
    a cross-filter query runs over the saved table."""
    path = scratch_path(spark, "derived")
    save_derived(derived_table(spark, sf), path)
    return M.query_saved(spark, path, _f(**DATES, **REGION)).kpis


_ASKED = {**DATES, **CATEGORY, **REGION}


def _document_sql(**f) -> str:
    """The rows of a bundle document, as ``cube.document_rows`` gives them."""
    empty = "CAST(NULL AS VARCHAR) AS name"
    kpis, none = O.kpis_sql(**f), "CAST(NULL AS BIGINT)"
    parts = [
        f"SELECT 'kpis' AS surface, 1 AS position, CAST(NULL AS VARCHAR) AS key, {empty}, net_revenue, order_count AS n, margin_pct AS rate FROM ({kpis})",
        f"SELECT 'kpis', 2, NULL, NULL, average_order_value, returned_count, return_rate FROM ({kpis})",
        f"SELECT 'rows', 1, NULL, NULL, NULL, rows, NULL FROM ({kpis})",
        f"SELECT 'revenue_over_time', CAST(row_number() OVER (ORDER BY order_week) AS INTEGER), CAST(order_week AS VARCHAR), NULL, net_revenue, order_count, NULL FROM ({O.weekly_sql(**f)})",
        f"SELECT 'revenue_by_category', CAST(row_number() OVER (ORDER BY net_revenue DESC, category) AS INTEGER), category, NULL, net_revenue, {none}, margin_pct FROM ({O.category_sql(**f)})",
        f"SELECT 'revenue_by_region', CAST(row_number() OVER (ORDER BY net_revenue DESC, region) AS INTEGER), region, NULL, net_revenue, {none}, share FROM ({O.region_sql(**f)})",
        f"SELECT 'top_products', CAST(row_number() OVER (ORDER BY net_revenue DESC, sku) AS INTEGER), sku, product_name, net_revenue, units, margin_pct FROM ({O.top_products_sql(**f)})",
    ]
    for i, name in enumerate(("date_from", "date_to", "category", "region"), 1):
        value = "NULL" if f.get(name) is None else f"'{f[name]}'"
        parts.append(f"SELECT 'filters', {i}, '{name}', {value}, NULL, NULL, NULL")
    return "\nUNION ALL\n".join(parts)


@register("metrics_json", _document_sql(**_ASKED))
def q_metrics_json(spark, sf):
    """The whole bundle as one JSON document with the filters it answers to, and read back. The
    five surfaces read the derived table written once."""
    b = M.aggregate(materialize(derived_table(spark, sf), "derived"), _f(**_ASKED))
    return CB.document_rows(S.metrics_json(b.surfaces(), M.SURFACE_ORDER, M.echo(b.filters)))


def _cube(spark, sf):
    """The cube in two appended parts; the second is first written wrong and then refreshed."""
    path = scratch_path(spark, "cube")
    derived = materialize(derived_table(spark, sf).select(*CB.COLUMNS), "derived", compression="zstd")
    late = F.col("order_date") >= F.lit("1996-07-01")
    CB.refresh(derived.filter(~late), path, "1")
    CB.refresh(derived, path, "2")
    CB.refresh(derived.filter(late), path, "2")
    return CB.read_cube(spark, path)


@register("cube_document", ORACLE["metrics_json"])
def q_cube_document(spark, sf):
    """A6/A8 from the summary cube: the document from one read of the cube."""
    return CB.document_rows(CB.document(_cube(spark, sf), _f(**_ASKED)))


@register("cube_document_all", _document_sql())
def q_cube_document_all(spark, sf):
    return CB.document_rows(CB.document(_cube(spark, sf)))


@register("cube_top_products", ORACLE["two_filters"])
def q_cube_top_products(spark, sf):
    return CB.bundle(_cube(spark, sf), _f(**CATEGORY, **REGION)).top_products


@register("dataset_artifact", f"""{O.PIPELINE},
t AS (SELECT * FROM derived ORDER BY order_id, order_ts LIMIT 20),
r AS (SELECT row_number() OVER (ORDER BY order_id, order_ts) AS k, [""" + ", ".join(
    f"coalesce(CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR), '')" if c in ("unit_price", "discount_pct", "gross_revenue", "net_revenue", "cogs", "margin", "margin_pct")
    else f"coalesce(CAST({c} AS VARCHAR), '')" for c in JOINED_COLUMNS + list(DERIVED_COLUMNS)) + f"""] AS row FROM t)
SELECT CAST((SELECT count(*) FROM derived) AS BIGINT) AS rows, '{','.join(JOINED_COLUMNS + list(DERIVED_COLUMNS))}' AS columns, true AS written,
       (SELECT to_json(list(row ORDER BY k)) FROM r) AS preview""")
def q_dataset_artifact(spark, sf):
    """The derived table published as parquet with its manifest row; of path and bytes, which
    differ from run to run, only that something was written."""
    path = scratch_path(spark, "artifact-derived")
    table = derived_table(spark, sf).select(*JOINED_COLUMNS, *DERIVED_COLUMNS)
    manifest = S.dataset_artifact(table, path, ["order_id", "order_ts"])
    return manifest.select("rows", "columns", (F.col("bytes") > 0).alias("written"), "preview")


@register("preview_record", f"""{O.with_chain(*O.FIXTURES)},
t AS (SELECT * FROM messy_orders_keyed ORDER BY _line, order_ts LIMIT 20),
r AS (SELECT row_number() OVER (ORDER BY _line, order_ts) AS k, [""" + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ["_line"] + ORDER_COLUMNS) + f"""] AS row FROM t)
SELECT CAST((SELECT count(*) FROM messy_orders) AS BIGINT) AS rows, '{','.join(["_line"] + ORDER_COLUMNS)}' AS columns, true AS written,
       (SELECT to_json(list(row ORDER BY k)) FROM r) AS sample""")
def q_preview_record(spark, sf):
    """S4 as one record of a written table."""
    path = scratch_path(spark, "previewed")
    seen = S.observed_write(messy_orders(spark, sf, with_key=True), path)
    record = S.preview_record(spark.read.parquet(path), seen["bytes"], ["_line", "order_ts"], rows=seen["rows"])
    return record.select("rows", "columns", (F.col("bytes") > 0).alias("written"), "sample")


@register("stream_event_dedupe", ORACLE["event_dedupe"])
def q_stream_event_dedupe(spark, sf):
    """E2 via Structured Streaming: a log in which events come twice, each kept once."""
    log = event_log(spark, sf)
    return ES.stream_event_dedupe(spark, log.unionByName(log.filter(F.col("seq") % 3 == 0))).select("run_id", "seq", "at", "type", "task_id", "agent_id")


@register("stream_artifact_text", ORACLE["stream_text"])
def q_stream_artifact_text(spark, sf):
    """E8 via Structured Streaming: per (run, artifact) state, order-insensitive."""
    return ES.stream_artifact_text(spark, event_log(spark, sf))


# ------------------------------------------------------------------ S8, E1, E16 sources that break off and resume

BROKEN = "seq % 50 = 7"  # half a line; of seq % 50 = 8 the number is text, of 9 the position is missing


def _json_lines(spark, sf):
    """The log as JSON lines; some are delivered twice, and broken copies of others lie between."""
    log = event_log(spark, sf)
    line = ES.json_line(log)
    plain = log.select(line.alias("value"))
    half = log.filter(BROKEN).select(F.substr(line, F.lit(1), F.floor(F.length(line) / 2).cast("int")).alias("value"))
    text = log.filter("seq % 50 = 8").select(F.to_json(F.struct("run_id", "type", F.concat(F.lit("no "), "seq").alias("seq"))).alias("value"))
    missing = log.filter("seq % 50 = 9").select(F.to_json(F.struct("run_id", "type", "at")).alias("value"))
    again = log.filter("seq % 11 = 0").select(line.alias("value"))
    lines = plain.unionByName(half).unionByName(text).unionByName(missing).unionByName(again)
    return ES.stream_json_log(spark, lines, log.schema)


@register("json_event_log", f"""{O.EVENTS}
SELECT {EV_COLS}, ts, text, attempt, pct FROM event_log""")
def q_json_event_log(spark, sf):
    """A JSON stream with broken and repeated lines; every event once."""
    return ES.json_events(spark, _json_lines(spark, sf)).select("run_id", "seq", "at", "type", "task_id", "agent_id", "ts", "text", "attempt", "pct")


@register("json_broken_lines", f"""{O.EVENTS}
SELECT problem, CAST(count(*) AS BIGINT) AS lines FROM (
  SELECT CASE WHEN seq % 50 = 9 THEN 'incomplete' ELSE 'unreadable' END AS problem FROM event_log WHERE seq % 50 IN (7, 8, 9)) GROUP BY problem""")
def q_json_broken_lines(spark, sf):
    return ES.json_broken_lines(spark, _json_lines(spark, sf)).groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))


@register("stream_restart", f"""{O.EVENTS_TASKS}
SELECT CAST(t.n AS INTEGER) AS files_per_trigger, run_id, task_id, status FROM task_fields CROSS JOIN (SELECT unnest([0, 1, 3]) AS n) t WHERE status IS NOT NULL""")
def q_stream_restart(spark, sf):
    """The log arrives in three deliveries out of order, some events again; the stream is
    stopped and resumed after each, with 1, 3 or all files a trigger."""
    log = event_log(spark, sf)
    parts = [log.filter((F.pmod(F.xxhash64("run_id", "seq"), F.lit(3)) == i) | ((F.col("seq") % 20 == 0) & F.lit(i == 2))) for i in range(3)]
    out = None
    for n in (0, 1, 3):
        state = ES.replay_then_follow(spark, parts, n or None).filter("status IS NOT NULL")
        state = state.select(F.lit(n).alias("files_per_trigger"), "run_id", "task_id", "status")
        out = state if out is None else out.unionByName(state)
    return out
