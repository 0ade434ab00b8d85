"""Cross-filtered metrics.

Every surface is a grouped aggregate over the derived table; Spark shuffles only partial
aggregates (one row per group per map task), so a hot category or sku costs nothing extra.
A dimension's own filter is released for its own cut (F6). Sums are exact decimals, cast to
double once at the output; every ratio is guarded (0.0 on an empty denominator).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import patterns as P
from tallyframe.functions.exprs import count_if, ratio


def as_date(value: str | None) -> date | None:
    """an ISO date, or None when absent or unreadable (the filter is then dropped)."""
    if not value:
        return None
    try:
        return date.fromisoformat(value)
    except ValueError:
        return None


@dataclass(frozen=True)
class Filters:
    date_from: str | None = None
    date_to: str | None = None
    category: str | None = None
    region: str | None = None

    def released(self, field: str) -> "Filters":
        """the same filters with one dimension let go."""
        return replace(self, **{field: None})


def echo(f: Filters) -> Column:
    """The filters as they were asked for, so that an answer can be matched to its question."""
    return F.struct(*[F.lit(value).cast("string").alias(name) for name, value in asdict(f).items()])


def predicate(f: Filters, date_col: str = "order_date", category_col: str = "category",
              region_col: str = "region") -> Column:
    """F1-F3 as one Column predicate (pushed into the scan by Catalyst)."""
    cond = F.lit(True)
    lo, hi = as_date(f.date_from), as_date(f.date_to)
    if lo is not None:
        cond = cond & (F.col(date_col) >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col(date_col) <= F.lit(hi))
    if f.category:
        cond = cond & (F.col(category_col) == F.lit(f.category))
    if f.region:
        cond = cond & (F.col(region_col) == F.lit(f.region))
    return cond


def week_filters(week_from: str | None, week_to: str | None, first_week: str | None = None,
                 last_week: str | None = None) -> Filters:
    """a brushed week range. The full range clears both dates. Otherwise dates run from
    the first chosen Monday through the Sunday ending the last chosen week (the stated
    intent: the last week is kept whole)."""
    if week_from == first_week and week_to == last_week:
        return Filters()
    wf, wt = as_date(week_from), as_date(week_to)
    end = None if wt is None else date.fromordinal(wt.toordinal() + 6).isoformat()
    return Filters(date_from=None if wf is None else wf.isoformat(), date_to=end)


def _status(s: str) -> Column:
    return F.col("status") == F.lit(s)


def revenue_rows(df: DataFrame, f: Filters) -> DataFrame:
    """rows that count as revenue under the filters."""
    return df.filter(predicate(f) & _status(P.REVENUE_STATUS))


def money(c: Column) -> Column:
    """Exact decimal money -> double, once, at the output."""
    return c.cast("double")


def _money(c: Column) -> Column:
    return money(F.coalesce(F.sum(c), F.lit(0)))


def kpis(df: DataFrame, f: Filters = Filters(), extra: tuple[Column, ...] = ()) -> DataFrame:
    """A1 (+ A6 ``rows``): one row, always (a global aggregate, even over no rows).
    ``extra`` aggregate columns ride along in the same pass and are passed through."""
    sel = df.filter(predicate(f))
    done = _status(P.REVENUE_STATUS)
    agg = sel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(done, F.col("net_revenue"))).alias("_net"),
        F.sum(F.when(done, F.col("margin"))).alias("_margin"),
        count_if(done).alias("order_count"),
        count_if(_status(P.RETURNED_STATUS)).alias("returned_count"),
        *extra,
    )
    passed = [c for c in agg.columns if c not in ("rows", "_net", "_margin", "order_count", "returned_count")]
    return agg.select(*kpi_columns(F.col("_net"), F.col("_margin"), F.col("order_count"), F.col("returned_count")),
                      F.col("rows"), *passed)


def kpi_columns(net_sum: Column, margin_sum: Column, order_count: Column, returned_count: Column) -> list[Column]:
    """A1 figures from the sums and counts of one selection (null sums count as 0)."""
    net = money(F.coalesce(net_sum, F.lit(0)))
    margin = money(F.coalesce(margin_sum, F.lit(0)))
    return [
        net.alias("net_revenue"),
        order_count.alias("order_count"),
        ratio(net, order_count).alias("average_order_value"),
        ratio(margin, net).alias("margin_pct"),
        ratio(returned_count, order_count + returned_count).alias("return_rate"),
        returned_count.alias("returned_count"),
    ]


def revenue_over_time(df: DataFrame, f: Filters = Filters()) -> DataFrame:
    """A2: by order_week ascending; weeks without rows are absent."""
    return (
        revenue_rows(df, f)
        .groupBy("order_week")
        .agg(_money(F.col("net_revenue")).alias("net_revenue"), F.count(F.lit(1)).alias("order_count"))
        .orderBy("order_week")
    )


def revenue_by_category(df: DataFrame, f: Filters = Filters()) -> DataFrame:
    """A3 with F6: the category filter is released for this cut."""
    g = revenue_rows(df, f.released("category")).groupBy("category").agg(
        F.sum("net_revenue").alias("_net"), F.sum("margin").alias("_margin")
    )
    return g.select(
        "category",
        money(F.col("_net")).alias("net_revenue"),
        ratio(money(F.col("_margin")), money(F.col("_net"))).alias("margin_pct"),
    ).orderBy(F.col("net_revenue").desc(), F.col("category").asc())


def revenue_by_region(df: DataFrame, f: Filters = Filters()) -> DataFrame:
    """A4 with F6: region filter released; share of the cut's own total (equal to the
    headline when no region is selected)."""
    g = revenue_rows(df, f.released("region")).groupBy("region").agg(F.sum("net_revenue").alias("_net"))
    whole = g.agg(F.sum("_net").alias("_total"))
    total = F.col("_total")
    return g.crossJoin(whole).select(
        "region",
        money(F.col("_net")).alias("net_revenue"),
        ratio(money(F.col("_net")), money(total)).alias("share"),
    ).orderBy(F.col("net_revenue").desc(), F.col("region").asc())


def top_products(df: DataFrame, f: Filters = Filters(), k: int = P.TOP_PRODUCT_LIMIT) -> DataFrame:
    """A5: top-k skus by net revenue (sku breaks ties). The limit is the feature.

    The ranking aggregate holds only numeric buffers, so it is a hash aggregate with a
    map-side partial, and the top k is a per-partition top-k plus one small merge
    (TakeOrderedAndProject). Names are looked up afterwards for the k chosen skus only: the
    k ranked rows are broadcast (size bounded by k) onto the (sku, product_name) scan and a
    min per sku is taken (T12). A string min in the ranking aggregate itself would turn it
    into a sort-based aggregate over every revenue row."""
    rev = revenue_rows(df, f)
    g = rev.groupBy("sku").agg(
        F.sum("net_revenue").alias("_net"),
        F.sum("margin").alias("_margin"),
        F.try_sum("qty").alias("units"),
    )
    top = g.orderBy(F.col("_net").desc(), F.col("sku").asc()).limit(k)
    named = (
        rev.select(F.col("sku").alias("_sku"), "product_name")
        .join(F.broadcast(top), F.col("_sku").eqNullSafe(F.col("sku")))
        .groupBy("sku", "_net", "_margin", "units")
        .agg(F.min("product_name").alias("product_name"))
    )
    return named.select(
        "sku",
        "product_name",
        money(F.col("_net")).alias("net_revenue"),
        F.col("units").cast("bigint").alias("units"),
        ratio(money(F.col("_margin")), money(F.col("_net"))).alias("margin_pct"),
        F.col("_net"),
    ).orderBy(F.col("_net").desc(), F.col("sku").asc()).drop("_net")


@dataclass(frozen=True)
class Bundle:
    """The five surfaces (each a DataFrame) for one set of filters."""

    kpis: DataFrame
    revenue_over_time: DataFrame
    revenue_by_category: DataFrame
    revenue_by_region: DataFrame
    top_products: DataFrame
    filters: Filters

    SURFACES = ("kpis", "revenue_over_time", "revenue_by_category", "revenue_by_region", "top_products")

    def surfaces(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.SURFACES}


# The order of each surface's rows, for sinks that write them as a list.
SURFACE_ORDER = {
    "revenue_over_time": ["order_week"],
    "revenue_by_category": ["-net_revenue", "category"],
    "revenue_by_region": ["-net_revenue", "region"],
    "top_products": ["-net_revenue", "sku"],
}


def aggregate(df: DataFrame, f: Filters | None = None) -> Bundle:
    f = f or Filters()
    return Bundle(kpis(df, f), revenue_over_time(df, f), revenue_by_category(df, f),
                  revenue_by_region(df, f), top_products(df, f), f)


class NoTable(Exception):
    """The derived table does not exist yet (distinct from an empty bundle)."""


def query_saved(spark, path: str, f: Filters | None = None) -> Bundle:
    """Cross-filter query over the retained derived table."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        raise NoTable(path) from exc
    return aggregate(df, f)


def grouping_sets_cut(df: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Weekly, category, region and sku cuts from ONE scan and ONE shuffle.

    Rows are filtered by dates (shared by every cut) and status; the category and region
    filters become conditional sums so each cut can release its own filter (F6). Output is
    long: (grain, key, net_revenue, margin_pct, order_count, units). A1 stays a separate
    global aggregate because grouping sets return no row over empty input."""
    dates_only = Filters(date_from=f.date_from, date_to=f.date_to)
    base = df.filter(predicate(dates_only) & _status(P.REVENUE_STATUS))
    cat_ok = predicate(Filters(category=f.category))
    reg_ok = predicate(Filters(region=f.region))
    both = cat_ok & reg_ok
    keyed = base.select(
        F.col("order_week").cast("string").alias("order_week"),
        "category", "region", "sku", "net_revenue", "margin", "qty",
        both.alias("in_all"), reg_ok.alias("in_cat"), cat_ok.alias("in_reg"),
    )
    dims = ["order_week", "category", "region", "sku"]
    g = keyed.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id(*dims).alias("gid"),
        F.sum(F.when(F.col("in_all"), F.col("net_revenue"))).alias("net_all"),
        F.sum(F.when(F.col("in_all"), F.col("margin"))).alias("margin_all"),
        count_if(F.col("in_all")).alias("n_all"),
        F.try_sum(F.when(F.col("in_all"), F.col("qty"))).alias("units"),
        F.sum(F.when(F.col("in_cat"), F.col("net_revenue"))).alias("net_cat"),
        F.sum(F.when(F.col("in_cat"), F.col("margin"))).alias("margin_cat"),
        count_if(F.col("in_cat")).alias("n_cat"),
        F.sum(F.when(F.col("in_reg"), F.col("net_revenue"))).alias("net_reg"),
        F.sum(F.when(F.col("in_reg"), F.col("margin"))).alias("margin_reg"),
        count_if(F.col("in_reg")).alias("n_reg"),
    )
    gid = F.col("gid")
    pick = lambda a, c, r: F.when(gid == 11, F.col(c)).when(gid == 13, F.col(r)).otherwise(F.col(a))
    out = g.select(
        F.when(gid == 7, "week").when(gid == 11, "category").when(gid == 13, "region").otherwise("sku").alias("grain"),
        F.coalesce(*[F.col(d) for d in dims]).alias("key"),
        pick("net_all", "net_cat", "net_reg").alias("_net"),
        pick("margin_all", "margin_cat", "margin_reg").alias("_margin"),
        pick("n_all", "n_cat", "n_reg").alias("order_count"),
        F.when(gid.isin(11, 13), F.lit(None)).otherwise(F.col("units")).alias("units"),
    )
    return out.filter(F.col("order_count") > 0).select(
        "grain",
        "key",
        money(F.coalesce(F.col("_net"), F.lit(0))).alias("net_revenue"),
        ratio(money(F.col("_margin")), money(F.col("_net"))).alias("margin_pct"),
        "order_count",
        F.coalesce(F.col("units"), F.lit(0)).cast("bigint").alias("units"),
    )
