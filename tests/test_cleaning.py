"""Hand-made cases for parse, dedupe, coerce, fill, drop (FIXTURES small cases)."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import patterns as P
from tallyframe.operators import cleaning as C

COLS = ["order_id", "order_ts", "customer_id", "region", "sku", "qty", "unit_price", "discount_pct", "status"]


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLS))


def row(oid="o1", ts="2025-03-25T14:30:00", qty="3", price="10.00", disc="0.10", status="completed", region="R1"):
    return (oid, ts, "c1", region, "s1", qty, price, disc, status)


def test_strict_parse_raises_with_count(spark):
    df = frame(spark, [row(), row("o2", "25/03/2025 14:30"), row("o3", "not a date")])
    with pytest.raises(C.StrictParseError) as e:
        C.parse_strict(df, "order_ts")
    assert e.value.unparseable == 2 and e.value.total == 3


def test_adaptive_falls_back_and_drops_only_unreadable(spark):
    df = frame(spark, [row(), row("o2", "25/03/2025 14:30"), row("o3", "not a date")])
    out = C.clean_adaptive(df)
    assert sorted(r.order_id for r in out.collect()) == ["o1", "o2"]
    st = C.clean_stats(df).first()
    assert (st.rows_in, st.failures, st.rows_dropped, st.duplicates_removed) == (3, 1, 1, 0)


def test_dedupe_keeps_latest_and_dated(spark):
    df = frame(spark, [row("o1", "2025-01-01T00:00:00", qty="1"), row("o1", "2025-02-01T00:00:00", qty="2"),
                       row("o1", None, qty="9"), row(None, qty="4"), row(None, qty="5")])
    out = C.dedupe_latest(C.parse_multi(df, "order_ts"), "order_id", "order_ts").collect()
    by = {r.order_id: r.qty for r in out}
    assert by["o1"] == "2" and len(out) == 2  # null key is one group


def test_dedupe_tie_is_deterministic(spark):
    df = frame(spark, [row("o1", qty="1"), row("o1", qty="2")])
    out = C.dedupe_latest(C.parse_multi(df, "order_ts"), "order_id", "order_ts").collect()
    assert [r.qty for r in out] == ["2"]


@pytest.mark.parametrize("raw,value,needed", [
    ("3", 3, False), (" 3", 3, True), ("3 ", 3, True), ("3.0", 3, True), ("+3", 3, False),
    ("3L", None, False), ("", None, False), (None, None, False), ("-7", -7, False), ("\t4\t", 4, True),
])
def test_qty_coercion(spark, raw, value, needed):
    df = spark.createDataFrame([(raw,)], "qty string")
    r = df.select(C.coerce_expr("qty", "int").alias("v"), C.needed_repair("qty", "int").alias("n")).first()
    assert r.v == value and bool(r.n) == needed


def test_fill_counts_nulls_and_unparseable_separately(spark):
    df = frame(spark, [row("o1", disc=None), row("o2", disc="abc"), row("o3", disc="0.25")])
    nr = C.null_rates(df).first()
    assert (nr.nulls, nr.rows, nr.unparseable_filled) == (1, 3, 1)
    assert abs(nr.null_rate - 1 / 3) < 1e-12
    out = {r.order_id: float(r.discount_pct) for r in C.clean(df).collect()}
    assert out == {"o1": 0.0, "o2": 0.0, "o3": 0.25}


def test_empty_input(spark):
    df = frame(spark, [])
    st = C.clean_stats(df).first()
    assert (st.rows_in, st.rows_out, st.drop_pct) == (0, 0, 0.0)
    assert C.null_rates(df).first().null_rate == 0.0
    assert C.choose_strategy(df).first().strategy == C.ISO_STRICT


def test_timestamp_shapes_anchor_without_trailing_newline(spark):
    from tallyframe.operators.profiling import shape_of

    df = spark.createDataFrame([("2025-01-01\n",), ("2025-01-01",), ("01/02/2025 10:00",)], "v string")
    got = [r.s for r in df.select(shape_of(F.col("v")).alias("s")).collect()]
    assert got == [None, "%Y-%m-%d", "%d/%m/%Y %H:%M"]


def test_week_is_monday(spark):
    from tallyframe.functions.derive import derive

    df = spark.createDataFrame([("2025-01-05 10:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("order_ts"), F.lit(1).alias("qty"), F.lit("1.00").alias("unit_price"),
        F.lit("0.00").alias("discount_pct"), F.lit("0.50").alias("cost_price"))
    r = derive(df).first()
    assert str(r.order_week) == "2024-12-30"
    assert float(r.margin) == 0.5 and r.margin_pct == 0.5


def test_margin_pct_null_when_net_zero(spark):
    from tallyframe.functions.derive import derive

    df = spark.createDataFrame([(0, "1.00", "0.00", "0.50")], "qty long, unit_price string, discount_pct string, cost_price string")
    df = df.withColumn("order_ts", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    assert derive(df).first().margin_pct is None


def test_plain_patterns_are_fixed():
    assert P.STRICT_SPEC == "%Y-%m-%dT%H:%M:%S"
    assert [s.spec for s in P.TIMESTAMP_SHAPES][2] == "%d/%m/%Y %H:%M"


def test_format_verdict_three_outcomes(spark):
    from tallyframe.operators import profiling as PR

    def verdict(values):
        df = spark.createDataFrame([(v,) for v in values], "order_ts string")
        return tuple(PR.format_verdict(df, "order_ts").first())

    assert verdict(["2025-03-25T14:30:00", None]) == ("no_alternate", None, None, 0)
    assert verdict(["2025-03-25T14:30:00", "05/03/2025 14:30"])[0] == "ambiguous"
    v = verdict(["2025-03-25T14:30:00", "25/03/2025 14:30", "05/03/2025 14:30", "junk"])
    assert v[0] == "day_first" and v[2] == 2 and v[3] == 1


def test_outliers_are_kept_and_counted(spark):
    from tallyframe.functions.derive import derive, derive_counts

    df = frame(spark, [row("o1", qty="12345678901", disc="0.25"), row("o2", disc="150"), row("o3", disc="0.1234567"),
                       row("o4", disc="1e30"), row("o5", qty="99999999999999999999"), row("o6", disc="0.1234567890123")])
    cost = spark.createDataFrame([("0.50",), ("0.123456",), ("0.1234567",)], "cost_price string")  # the last has a decimal more than held
    held = {r.column_name: r.not_held for r in C.held_counts(df, cost).collect()}
    assert held == {"qty": 1, "unit_price": 0, "discount_pct": 2, "cost_price": 1}
    assert C.null_rates(df).first().unparseable_filled == 0
    out = derive(C.clean(df).withColumn("cost_price", F.lit("0.50"))).cache()
    net = {r.order_id: r.net_revenue and format(r.net_revenue.normalize(), "f") for r in out.collect()}
    assert net == {"o1": "92592591757.5", "o2": "-4470", "o3": "26.296299", "o4": None, "o5": None, "o6": "26.296296"}
    assert {tuple(r) for r in derive_counts(out).collect()} == {("gross_revenue", 0, 0), ("net_revenue", 1, 0), ("margin", 1, 0)}


def test_largest_quantity_and_price_do_not_fail(spark):
    from tallyframe.functions.derive import derive, derive_counts

    df = frame(spark, [row("o1", qty="9223372036854775807", price="9999999999999.9999", disc="0"),
                       row("o2", qty="9223372036854775807", price="10", disc="0.5")])
    out = derive(C.clean(df).withColumn("cost_price", F.lit("0.50")))
    got = {r.order_id: r for r in out.collect()}
    assert got["o1"].gross_revenue is not None and got["o1"].net_revenue is None
    assert format(got["o2"].net_revenue.normalize(), "f") == "46116860184273879035"
    assert {tuple(r) for r in derive_counts(out).collect()} == {("gross_revenue", 0, 0), ("net_revenue", 1, 1), ("margin", 1, 0)}


def test_prices_of_six_decimals_and_of_many_digits_are_kept(spark):
    from tallyframe.functions.derive import derive

    df = frame(spark, [row("o1", qty="3", price="10.123456", disc="0.5"), row("o2", qty="2", price="100000000000000000.25", disc="0"), row("o3", qty="1", price="0.00001", disc="0")])
    out = derive(C.clean(df).withColumn("cost_price", F.lit("0.333333")))
    text = lambda v: format(v.normalize(), "f")
    got = {r.order_id: (text(r.gross_revenue), text(r.net_revenue), text(r.margin)) for r in out.collect()}
    assert got == {"o1": ("30.370368", "15.185184", "14.185185"), "o2": ("200000000000000000.5", "200000000000000000.5", "199999999999999999.833334"), "o3": ("0.00001", "0.00001", "-0.333323")}
    assert C.held_counts(df, spark.createDataFrame([("1",)], "cost_price string")).agg(F.sum("not_held")).first()[0] == 0


def test_a_spec_is_tried_only_on_text_with_its_separator(spark):
    """The same values as trying every spec, but text that cannot be read is not parsed for it to fail."""
    from tallyframe.functions import exprs as X
    from tallyframe.functions import patterns as P

    texts = ["1996-02-03T04:05:06", "03/02/1996 04:05", "no date", "", None, "1996/02/03", "1996-02-30T00:00:00", "1-1/1996", "03-02-1996 04:05"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    specs = (P.STRICT_SPEC, *P.FALLBACK_SPECS)
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(P.SHAPES_BY_SPEC[s].spark_format)).cast("timestamp_ntz") for s in specs])
    rows = df.select(plain.alias("want"), X.parse_multi_format(F.col("t"), specs).alias("got")).collect()
    assert all(r.want == r.got for r in rows) and sum(r.got is not None for r in rows) == 2
    plan = df.select(X.parse_multi_format(F.col("t"), specs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan


def test_derive_computes_each_amount_once(spark):
    """Amounts that later columns are made of are columns of an earlier projection."""
    from tallyframe.functions.derive import derive

    df = spark.range(3).selectExpr("id as qty", "cast(id * 1.5 as decimal(24,6)) as unit_price", "cast(0.1 as decimal(33,12)) as discount_pct",
                                   "cast(id as string) as cost_price", "timestamp_ntz'1996-02-03 04:05:06' as order_ts")
    plan = derive(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("decimal(14,10)") <= 4 and plan.count("Project") >= 4
