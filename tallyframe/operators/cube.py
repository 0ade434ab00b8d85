"""The cross-filter bundle from a summary cube.

A cell is one combination of day, week, category, region, sku, product name and status, with its rows,
exact sums and units. The cube is a folder with a sub-folder for each part of the derived table (a
month, a load): an appended part adds its own cells and no other part is read again; refreshing a
part writes over its own folder. Cells of several parts simply add up.

A bundle reads the cube once: each cell gives an entry for every surface whose filters let it through
(its own dimension's filter is released for a cut), so a selective filter leaves few entries, and one
aggregate over (surface, key) gives all of them. The document comes from that in the same job; for the
five surfaces as frames the answer, a row a surface key, is written once.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import patterns as P
from tallyframe.functions.exprs import ratio
from tallyframe.operators import metrics as M
from tallyframe.session import materialize

DIMENSIONS = ("order_date", "order_week", "category", "region", "sku", "product_name", "status")
#: All that the cube reads of a derived table.
COLUMNS = (*DIMENSIONS, "qty", "net_revenue", "margin")


def cells(derived: DataFrame) -> DataFrame:
    """The cells of a part of the derived table."""
    return derived.groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("net_revenue").alias("net"),
        F.sum("margin").alias("margin"),
        F.sum(F.col("qty").cast("decimal(20,0)")).cast("decimal(38,0)").alias("units"),
    )


def refresh(derived: DataFrame, path: str, part: str) -> None:
    """Adds a part's cells to the cube, or replaces them."""
    cells(derived).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/part={part}")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def answer(cube: DataFrame, f: M.Filters = M.Filters()) -> DataFrame:
    """(surface, key, name, rows, done, returned, net, margin, units) of every surface in one pass."""
    dates = M.Filters(date_from=f.date_from, date_to=f.date_to)
    done = F.col("status") == F.lit(P.REVENUE_STATUS)
    by_category, by_region = M.predicate(M.Filters(category=f.category)), M.predicate(M.Filters(region=f.region))

    def entry(surface: str, when: Column, key: Column, name: Column = F.lit(None).cast("string")) -> Column:
        return F.when(when, F.struct(F.lit(surface).alias("surface"), key.cast("string").alias("key"), name.alias("name")))

    both = by_category & by_region
    entries = F.array(
        entry("kpis", both, F.lit(None)),
        entry("revenue_over_time", both & done, F.col("order_week")),
        entry("revenue_by_category", by_region & done, F.col("category")),
        entry("revenue_by_region", by_category & done, F.col("region")),
        entry("top_products", both & done, F.col("sku"), F.col("product_name")),
    )
    read = cube.filter(M.predicate(dates)).select(
        F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e"), "rows",
        F.when(done, F.col("rows")).alias("done"), F.when(F.col("status") == F.lit(P.RETURNED_STATUS), F.col("rows")).alias("returned"),
        *[F.when(done, F.col(c)).alias(c) for c in ("net", "margin", "units")],
    )
    sums = lambda df, *keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("rows", "done", "returned", "net", "margin", "units")])
    per_name = sums(read.select("_e.*", "rows", "done", "returned", "net", "margin", "units"), "surface", "key", "name")
    names = per_name.groupBy("surface", "key").agg(F.min("name").alias("name"), *[F.sum(c).alias(c) for c in ("rows", "done", "returned", "net", "margin", "units")])
    return names


def bundle(cube: DataFrame, f: M.Filters | None = None, k: int = P.TOP_PRODUCT_LIMIT) -> M.Bundle:
    """A6 over the cube: the same surfaces as ``metrics.aggregate`` over the rows."""
    f = f or M.Filters()
    a = materialize(answer(cube, f), "bundle")
    of = lambda surface: a.filter(F.col("surface") == surface)
    net, margin = M.money(F.col("net")), M.money(F.col("margin"))
    desc = [F.desc("net_revenue"), F.asc("_key")]
    head = of("kpis").agg(F.sum("net").alias("_net"), F.sum("margin").alias("_margin"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"_{c}") for c in ("done", "returned", "rows")])
    kpis = head.select(*M.kpi_columns(F.col("_net"), F.col("_margin"), F.col("_done"), F.col("_returned")), F.col("_rows").alias("rows"))
    weekly = of("revenue_over_time").select(F.col("key").cast("date").alias("order_week"), M.money(F.coalesce("net", F.lit(0))).alias("net_revenue"), F.col("done").alias("order_count")).orderBy("order_week")
    by_category = of("revenue_by_category").select(F.col("key").alias("category"), net.alias("net_revenue"), ratio(margin, net).alias("margin_pct")).orderBy(F.desc("net_revenue"), "category")
    regions = of("revenue_by_region")
    whole = regions.agg(F.sum("net").alias("_total"))
    by_region = regions.crossJoin(whole).select(F.col("key").alias("region"), net.alias("net_revenue"), ratio(net, M.money(F.col("_total"))).alias("share")).orderBy(F.desc("net_revenue"), "region")
    top = of("top_products").orderBy(F.desc("net"), F.asc("key")).limit(k)
    products = top.select(
        F.col("key").alias("sku"), F.col("name").alias("product_name"), net.alias("net_revenue"), F.col("units").try_cast("bigint").alias("units"),
        ratio(margin, net).alias("margin_pct"), F.col("net").alias("_net"),
    ).orderBy(F.desc("_net"), F.asc("sku")).drop("_net")
    return M.Bundle(kpis, weekly, by_category, by_region, products, f)


def document(cube: DataFrame, f: M.Filters | None = None, k: int = P.TOP_PRODUCT_LIMIT) -> DataFrame:
    """S5 over the cube: the bundle as one JSON document, with the filters it answers to, from one read
    of the cube in one job. Products are ranked, and everything else passes the same limit as a
    group of its own, so that a task hands on no more than ``k`` products."""
    f = f or M.Filters()
    group = F.when(F.col("surface") == "top_products", F.lit("")).otherwise(F.concat_ws("|", "surface", "key", F.col("key").isNull()))
    ranked = answer(cube, f).withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("net"), F.asc("key"))))
    shown = ranked.filter(F.col("_at") <= k)
    net, margin = M.money(F.col("net")), M.money(F.col("margin"))
    fields = {
        "revenue_over_time": (F.col("key"), {"order_week": F.col("key"), "net_revenue": M.money(F.coalesce("net", F.lit(0))), "order_count": F.col("done")}),
        "revenue_by_category": (F.struct(-net, "key"), {"category": F.col("key"), "net_revenue": net, "margin_pct": ratio(margin, net)}),
        "revenue_by_region": (F.struct(-net, "key"), {"region": F.col("key"), "net_revenue": net}),
        "top_products": (F.struct(-F.col("net"), F.col("key")), {"sku": F.col("key"), "product_name": F.col("name"), "net_revenue": net, "units": F.col("units").try_cast("bigint"), "margin_pct": ratio(margin, net)}),
    }
    listed = {
        name: F.transform(F.array_sort(F.collect_list(F.when(F.col("surface") == name, F.struct(order.alias("order"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row"))))), lambda x: x["row"]).alias(name)
        for name, (order, columns) in fields.items()
    }
    is_head = F.col("surface") == "kpis"
    whole = shown.agg(
        *[F.sum(F.when(is_head, F.col(c))).alias(f"_{c}") for c in ("net", "margin")],
        *[F.coalesce(F.sum(F.when(is_head, F.col(c))), F.lit(0)).cast("bigint").alias(f"_{c}") for c in ("done", "returned", "rows")],
        M.money(F.sum(F.when(F.col("surface") == "revenue_by_region", F.col("net")))).alias("_total"),
        *listed.values(),
    )
    shares = F.transform("revenue_by_region", lambda x: x.withField("share", ratio(x["net_revenue"], F.col("_total"))))
    head = F.struct(*M.kpi_columns(F.col("_net"), F.col("_margin"), F.col("_done"), F.col("_returned"))).alias("kpis")
    parts = [shares.alias(name) if name == "revenue_by_region" else F.col(name) for name in fields]
    return whole.select(F.to_json(F.struct(head, *parts, F.col("_rows").alias("rows"), M.echo(f).alias("filters")), {"ignoreNullFields": "false"}).alias("metrics_json"))


#: What a reader of the document parses it with.
DOCUMENT = """kpis struct<net_revenue:double,order_count:bigint,average_order_value:double,margin_pct:double,return_rate:double,returned_count:bigint>,
revenue_over_time array<struct<order_week:string,net_revenue:double,order_count:bigint>>,
revenue_by_category array<struct<category:string,net_revenue:double,margin_pct:double>>,
revenue_by_region array<struct<region:string,net_revenue:double,share:double>>,
top_products array<struct<sku:string,product_name:string,net_revenue:double,units:bigint,margin_pct:double>>,
rows bigint, filters struct<date_from:string,date_to:string,category:string,region:string>"""


def document_rows(doc: DataFrame) -> DataFrame:
    """A document read back: (surface, position, key, name, net_revenue, n, rate), the filters as rows
    of key and name."""
    d = doc.select(F.from_json("metrics_json", DOCUMENT).alias("d")).select("d.*")
    none, k = F.lit(None), F.col("kpis")

    def rows(surface: str, key: Column, name: Column, net: Column, n: Column, rate: Column, of: DataFrame, position: Column) -> DataFrame:
        return of.select(F.lit(surface).alias("surface"), position.cast("int").alias("position"), key.cast("string").alias("key"), name.cast("string").alias("name"),
                         net.cast("double").alias("net_revenue"), n.cast("bigint").alias("n"), rate.cast("double").alias("rate"))

    def listed(surface: str, key: str, name: str | None, n: str | None, rate: str | None) -> DataFrame:
        of = d.select(F.posexplode(surface).alias("at", "x"))
        pick = lambda c: none if c is None else F.col(f"x.{c}")
        return rows(surface, F.col(f"x.{key}"), pick(name), F.col("x.net_revenue"), pick(n), pick(rate), of, F.col("at") + 1)

    out = rows("kpis", none, none, k["net_revenue"], k["order_count"], k["margin_pct"], d, F.lit(1))
    out = out.unionByName(rows("kpis", none, none, k["average_order_value"], k["returned_count"], k["return_rate"], d, F.lit(2)))
    out = out.unionByName(rows("rows", none, none, none, F.col("rows"), none, d, F.lit(1)))
    out = out.unionByName(listed("revenue_over_time", "order_week", None, "order_count", None)).unionByName(listed("revenue_by_category", "category", None, None, "margin_pct"))
    out = out.unionByName(listed("revenue_by_region", "region", None, None, "share")).unionByName(listed("top_products", "sku", "product_name", "units", "margin_pct"))
    for i, name in enumerate(asdict(M.Filters()), 1):
        out = out.unionByName(rows("filters", F.lit(name), F.col(f"filters.{name}"), none, none, none, d, F.lit(i)))
    return out
