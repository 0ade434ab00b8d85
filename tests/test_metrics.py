"""Aggregation invariants on the derived table (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import metrics as M
from tallyframe.plans.retail import derived_table, save_derived


@pytest.fixture(scope="module")
def derived(spark, sf_small):
    return save_derived(derived_table(spark, sf_small))


def cents(df, col="net_revenue"):
    return round(sum(r[col] for r in df.collect()), 2)


def test_cuts_sum_to_headline(derived):
    k = M.kpis(derived).first()
    assert abs(cents(M.revenue_by_category(derived)) - k.net_revenue) < 0.01
    assert abs(cents(M.revenue_by_region(derived)) - k.net_revenue) < 0.01
    weekly = M.revenue_over_time(derived)
    assert sum(r.net_revenue for r in weekly.collect()) == pytest.approx(k.net_revenue, rel=1e-12)
    assert abs(sum(r.share for r in M.revenue_by_region(derived).collect()) - 1.0) < 1e-9


def test_cancelled_and_returned_excluded(derived):
    k = M.kpis(derived).first()
    completed = derived.filter(F.col("status") == "completed").count()
    assert k.order_count == completed
    assert k.return_rate == pytest.approx(k.returned_count / (k.order_count + k.returned_count))


def test_self_release(derived):
    cat = M.Filters(category="MEDIUM")
    by_cat = M.revenue_by_category(derived, cat).collect()
    assert len(by_cat) == len(M.revenue_by_category(derived).collect())  # the chart keeps its peers
    k = M.kpis(derived, cat).first()
    medium = [r for r in by_cat if r.category == "MEDIUM"][0]
    assert medium.net_revenue == k.net_revenue
    reg = M.Filters(region="R2")
    shares = M.revenue_by_region(derived, reg).collect()
    assert abs(sum(r.share for r in shares) - 1.0) < 1e-9


def test_two_filters_narrow_each_other(derived):
    a = M.kpis(derived, M.Filters(category="MEDIUM")).first().order_count
    b = M.kpis(derived, M.Filters(region="R2")).first().order_count
    both = M.kpis(derived, M.Filters(category="MEDIUM", region="R2")).first().order_count
    assert both <= min(a, b)


def test_empty_selection_and_bad_date(derived):
    e = M.kpis(derived, M.Filters(category="none")).first()
    assert (e.net_revenue, e.order_count, e.average_order_value, e.margin_pct, e.return_rate, e.rows) == (0.0, 0, 0.0, 0.0, 0.0, 0)
    assert M.revenue_by_category(derived, M.Filters(region="none")).count() == 0
    assert M.kpis(derived, M.Filters(date_from="2025-13-01")).first() == M.kpis(derived).first()


def test_date_filter_equals_manual_filter(derived):
    f = M.Filters(date_from="1996-01-01", date_to="1996-06-30")
    manual = derived.filter((F.col("order_date") >= "1996-01-01") & (F.col("order_date") <= "1996-06-30"))
    assert M.kpis(derived, f).first() == M.kpis(manual).first()


def test_top_products_ordered_and_reproducible(derived):
    a = M.top_products(derived).collect()
    assert len(a) == 10
    nets = [r.net_revenue for r in a]
    assert nets == sorted(nets, reverse=True)
    assert a == M.top_products(derived).collect()


def test_grouping_sets_equal_separate_cuts(derived):
    f = M.Filters(date_from="1996-01-01", category="MEDIUM", region="R2")
    g = M.grouping_sets_cut(derived, f)
    cat = {r.key: r.net_revenue for r in g.filter("grain = 'category'").collect()}
    assert cat == {r.category: r.net_revenue for r in M.revenue_by_category(derived, f).collect()}
    reg = {r.key: r.net_revenue for r in g.filter("grain = 'region'").collect()}
    assert reg == {r.region: r.net_revenue for r in M.revenue_by_region(derived, f).collect()}


def test_week_filters_keep_last_week_whole():
    f = M.week_filters("1996-01-01", "1996-03-25")
    assert (f.date_from, f.date_to) == ("1996-01-01", "1996-03-31")
    assert M.week_filters("a", "b", "a", "b") == M.Filters()


def test_query_saved_missing_table(spark):
    with pytest.raises(M.NoTable):
        M.query_saved(spark, "/nonexistent/derived")


def test_fact_ledger_on_empty_extract_has_every_fact(spark):
    """The grouping-sets pass returns no row over empty input; the ledger still has one
    row with the empty selection's figures."""
    from tallyframe.plans import verification as VP
    from tallyframe.plans.fixtures import messy_customers, messy_orders, messy_products

    sf = "/root/testdata/sf0.001"
    raw = messy_orders(spark, sf).filter("order_id IS NULL")
    w = VP.facts_wide_from(raw, messy_products(spark, sf), messy_customers(spark, sf)).collect()
    assert len(w) == 1
    r = w[0]
    assert (r.rows_in, r.derived_rows, r.order_count, r.category_groups, r.week_points, r.top_products) == (0, 0, 0, 0, 0, 0)
    assert (r.net_revenue, r.margin_pct, r.return_rate, r.discount_null_rate) == (0.0, 0.0, 0.0, 0.0)
    assert r.category_total is None and r.region_total is None


def test_checks_report_misses_and_skips_absent_sections(spark):
    """V7: a missed check is named and counted in check 10; sections without facts are left out."""
    from tallyframe.operators import verify as V

    facts = spark.createDataFrame(
        [("rows_in", 1000.0), ("rows_dropped", 9.0), ("drop_budget_rows", 5.0), ("timestamp_failures", 0.0),
         ("duplicates_removed", 4.0), ("qty_coerced", 2.0)],
        "key string, num double",
    )
    got = {r.check_no: r for r in V.run_checks(facts).collect()}
    assert sorted(got) == [2, 3, 4, 10]
    assert got[2].verdict == "MISSED" and got[3].verdict == "met" and got[4].verdict == "recorded"
    assert (got[10].measured, got[10].threshold, got[10].verdict) == (1.0, 2.0, "recorded")
    t = V.totals(V.run_checks(facts)).first()
    assert (t.asserted, t.passed, t.failed, t.recorded) == (2, 1, 1, 2)
