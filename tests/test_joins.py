"""Join accounting: the one-pass multi-relation stats equal the per-relation ones."""

from tallyframe.operators import joins as J


def test_join_stats_many_equals_each_relation(spark):
    left = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "x"), (5, "c", "z")],
        "id int, sku string, cust string",
    )
    products = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "sku string")  # duplicate key
    customers = spark.createDataFrame([("x",), ("y",)], "cust string")
    many = {r.relation: r for r in J.join_stats_many(left, [("p", products, "sku"), ("c", customers, "cust")]).collect()}
    for name, right, key in (("p", products, "sku"), ("c", customers, "cust")):
        one = J.join_stats(left, right, key).first()
        got = many[name]
        assert (got.left_rows, got.rows, got.matched, got.unmatched, got.match_rate) == (
            one.left_rows, one.rows, one.matched, one.unmatched, one.match_rate)
    assert (many["p"].rows, many["p"].matched, many["p"].unmatched) == (5, 3, 2)
    assert (many["c"].rows, many["c"].matched, many["c"].unmatched) == (3, 3, 2)


def test_dimensions_keep_rows_and_columns(spark):
    """The joins' order changes neither the rows nor the columns; repeated keys multiply, null ones never match."""
    from tallyframe.plans.retail import with_dimensions

    orders = spark.createDataFrame([("o1", "x", "R1", "a", 1), ("o2", "y", "R2", "b", 2), ("o3", None, "R1", "a", 3), ("o4", "x", "R1", "z", 4)],
                                   "order_id string, customer_id string, region string, sku string, qty int")
    products = spark.createDataFrame([("a", "A", "C", "1"), ("a", "A2", "C", "2"), ("b", "B", "D", "3")], "sku string, product_name string, category string, cost_price string")
    customers = spark.createDataFrame([("x", "s", "R9"), ("y", "t", "R2")], "customer_id string, segment string, region string")
    want = J.join(J.join(orders, products, "sku"), customers, "customer_id")
    got = with_dimensions(orders, products, customers)
    assert got.columns == want.columns and got.count() == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _exchanges(frame):
    """Shuffles that lines pass in a plan with no broadcasts, each with its column names."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_lines_are_exchanged_once_for_the_extract(spark, sf_small):
    """However large the customers are, lines pass one exchange, with their order's key."""
    from tallyframe.plans.fixtures import messy_orders

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges, plan = _exchanges(messy_orders(spark, sf_small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in exchanges]
    assert sorted(keys) == ["c_custkey", "l_orderkey", "o_custkey", "o_orderkey"], keys
    first = plan.index("hashpartitioning(o_custkey")
    assert plan.index("hashpartitioning(l_orderkey") < first, "lines are joined after orders have their customers"
