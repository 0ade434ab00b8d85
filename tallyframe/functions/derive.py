"""Derived money and date columns (D1-D8). Exact decimals inside; ratios in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import patterns as P
from tallyframe.functions.exprs import count_if, guarded_cast, null_when_zero_ratio

DERIVED_COLUMNS = ("gross_revenue", "net_revenue", "cogs", "margin", "margin_pct", "order_date", "order_week")


def amount(qty: Column, price: Column) -> Column:
    """Quantity times price, exact; null past 32 digits before the point."""
    return F.try_multiply(qty, price).try_cast(P.AMOUNT_DECIMAL)


def _exact_net(gross: Column, disc: Column) -> Column:
    """Net without rounding before the tenth decimal; null where gross or rate has too many digits."""
    rate = disc.try_cast(P.EXACT_RATE_DECIMAL)
    net = gross.try_cast(P.EXACT_GROSS_DECIMAL) * (F.lit(1) - F.when(rate == disc, rate))
    return net.try_cast(P.NET_DECIMAL)


def derive(
    df: DataFrame,
    qty: str = "qty",
    unit_price: str = "unit_price",
    discount: str = "discount_pct",
    cost_price: str = "cost_price",
    ts: str = "order_ts",
) -> DataFrame:
    """Adds the seven derived columns; row count unchanged.

    Prices keep six decimals and quantities every BIGINT, so gross and cogs are exact (null past 32
    digits before the point); net is exact as far as 38 digits go, then rounded to six decimals,
    and null past 27 digits before the point (all counted by ``derive_counts``; no value fails the job). ``cost_price`` arrives as
    text from the products extract and is cast at the point of use (bad text -> null)."""
    q = F.col(qty).try_cast(P.WIDE_QTY_DECIMAL)
    price = F.col(unit_price).try_cast(P.WIDE_PRICE_DECIMAL)
    disc = F.col(discount).try_cast(P.WIDE_RATE_DECIMAL)
    cost = guarded_cast(F.col(cost_price), P.WIDE_PRICE_DECIMAL)
    gross, net, cogs, margin = (F.col(c) for c in ("gross_revenue", "net_revenue", "cogs", "margin"))
    day = F.to_date(F.col(ts))             # D6
    # A projection a step: an amount that later ones are made of is computed once a row.
    first = df.withColumns({"gross_revenue": amount(q, price)})    # D1
    second = first.withColumns({
        "net_revenue": F.coalesce(_exact_net(gross, disc), F.try_multiply(gross, F.lit(1) - disc).try_cast(P.NET_DECIMAL)),  # D2
        "cogs": amount(q, cost),           # D3
    })
    return second.withColumns({"margin": net - cogs.try_cast(P.NET_DECIMAL)}).withColumns(  # D4
        {
            "margin_pct": null_when_zero_ratio(margin, net),        # D5
            "order_date": day,
            "order_week": F.to_date(F.date_trunc("week", F.col(ts))),  # D7: Monday
        }
    )


def derive_counts(df: DataFrame, qty: str = "qty", unit_price: str = "unit_price", discount: str = "discount_pct") -> DataFrame:
    """(column_name, rounded, not_held) of a derived table: nets rounded to six decimals, and
    gross amounts, nets and margins that are null although all they are made of is there."""
    gross, net, cogs = F.col("gross_revenue"), F.col("net_revenue"), F.col("cogs")
    q, price = F.col(qty).try_cast(P.WIDE_QTY_DECIMAL), F.col(unit_price).try_cast(P.WIDE_PRICE_DECIMAL)
    rounded = net.isNotNull() & _exact_net(gross, F.col(discount).try_cast(P.WIDE_RATE_DECIMAL)).isNull()
    wide = df.agg(
        count_if(gross.isNull() & q.isNotNull() & price.isNotNull()).alias("g"),
        count_if(rounded).alias("r"),
        count_if(net.isNull() & gross.isNotNull() & F.col(discount).isNotNull()).alias("n"),
        count_if(F.col("margin").isNull() & net.isNotNull() & cogs.isNotNull()).alias("m"),
    )
    return wide.selectExpr("stack(3, 'gross_revenue', 0L, g, 'net_revenue', r, n, 'margin', r, m) as (column_name, rounded, not_held)")


MONEY_COLUMNS = ("unit_price", "discount_pct", "gross_revenue", "net_revenue", "cogs", "margin")


def money_as_double(df: DataFrame) -> DataFrame:
    """Output edge: exact decimals become doubles once."""
    return df.withColumns({c: F.col(c).cast("double") for c in MONEY_COLUMNS if c in df.columns})
