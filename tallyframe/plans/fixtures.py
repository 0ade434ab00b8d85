"""Messy extracts derived from the driver's tables, with integer arithmetic only, so the
DuckDB oracle (``plans/oracle.py``) can derive the very same rows.

messy_orders      lineitem x orders x customer x nation x region, one row per line
messy_products    part
messy_customers   customer x nation x region
event_log         events, re-typed as an ordered run log
edges             part, as a child -> parent tree

Every fixture is a lazy DataFrame over the whole input tables; nothing is sampled. The
dimension joins (nation, region) are tiny and fixed-size; customer and part joins are left
to the planner (AQE picks broadcast only when the runtime size is under the threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.eventlog import METRICS
from tallyframe.operators.ordering import running
from tallyframe.sources.tables import read_table


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def messy_orders(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """The orders extract, all text. ``with_key`` adds ``_line`` (l_orderkey*1000 +
    l_linenumber), the extract's natural line order, used for "first seen" samples."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate",
    )
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rg = read_table(spark, sf_dir, "region").select("r_regionkey")
    # Orders get their customer's region first, so that lines are exchanged once however many customers there
    # are. Lines and orders are of one magnitude at every scale, so neither is sent to all tasks; the exchange
    # also spreads lines that come as a few large row groups before their texts are built.
    placed = (
        od.join(cu, od.o_custkey == cu.c_custkey)
        .join(F.broadcast(na), F.col("c_nationkey") == na.n_nationkey)
        .join(F.broadcast(rg), F.col("n_regionkey") == rg.r_regionkey)
        .select("o_orderkey", "o_custkey", "r_regionkey")
    )
    j = li.join(placed.hint("merge"), li.l_orderkey == placed.o_orderkey)
    day_first = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_orderkey")) % 17 == 0
    q = _s(
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint")
    )
    tail = (F.col("l_orderkey") + F.col("l_partkey") * 5) % 41  # 3 decimals, a blank, more decimals than held
    pad = (F.col("l_orderkey") + F.col("l_linenumber")) % 33
    key = [(F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("_line")] if with_key else []
    return j.select(
        *key,
        F.concat(F.lit("ORD-"), _s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("order_id"),
        F.when(day_first, F.date_format("l_shipdate", "dd/MM/yyyy HH:mm"))
        .when((F.col("l_orderkey") * 11 + F.col("l_linenumber")) % 211 == 0, "no date")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("order_ts"),
        F.concat(F.lit("CUST-"), _s("o_custkey")).alias("customer_id"),
        F.concat(
            F.lit("R"),
            _s(
                F.when((F.col("l_orderkey") + F.col("l_partkey")) % 31 == 0, (F.col("r_regionkey") + 1) % 5)
                .otherwise(F.col("r_regionkey"))
            ),
        ).alias("region"),
        F.concat(F.lit("SKU-"), _s("l_partkey")).alias("sku"),
        F.when(pad == 0, F.concat(F.lit(" "), q))
        .when(pad == 1, F.concat(q, F.lit(" ")))
        .when(pad == 2, F.concat(q, F.lit(".0")))
        .when(pad == 3, F.concat(q, F.lit("\u00a0")))
        .otherwise(q)
        .alias("qty"),
        F.concat(
            _s(F.col("l_extendedprice").cast("decimal(18,2)")),
            F.when(tail == 0, "5").when(tail == 1, " ").when(tail == 2, "1237").otherwise(""),
        ).alias("unit_price"),
        F.when((F.col("l_partkey") + F.col("l_orderkey") * 3) % 25 == 0, F.lit(None).cast("string"))
        .when((F.col("l_partkey") * 3 + F.col("l_orderkey")) % 127 == 0, "n/a")
        .otherwise(_s(F.col("l_discount").cast("decimal(6,2)")))
        .alias("discount_pct"),
        F.when(F.col("l_returnflag") == "R", "returned")
        .when(F.col("l_returnflag") == "A", "cancelled")
        .otherwise("completed")
        .alias("status"),
    )


def messy_products(spark: SparkSession, sf_dir: str, variant: str = "clean") -> DataFrame:
    """``clean``: one row per part but those with key % 97 = 3, whose lines have no product. ``defects``: parts with key % 50 = 0 removed (unmatched
    lines) and parts with key % 100 = 0 repeated (duplicate right keys); used only to
    exercise the join accounting, still over the whole table."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    if variant == "clean":
        p = p.filter(F.col("p_partkey") % 97 != 3)
    if variant == "defects":
        p = p.filter(F.col("p_partkey") % 50 != 0).unionByName(p.filter(F.col("p_partkey") % 100 == 0))
    return p.select(
        F.concat(F.lit("SKU-"), _s("p_partkey")).alias("sku"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        _s(F.col("p_retailprice").cast("decimal(12,2)")).alias("cost_price"),
    )


def messy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    some = cu.filter(F.col("c_custkey") % 53 != 7)  # the others' lines have no customer
    return some.join(F.broadcast(na), F.col("c_nationkey") == na.n_nationkey).select(
        F.concat(F.lit("CUST-"), _s("c_custkey")).alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("R"), _s("n_regionkey")).alias("region"),
    )


# Event-log fixture: fixed mapping from (event_type, k) to a run-log event.
# FIXED VALUES (mapping rules, in order of evaluation per source type):
#   signup:   k % 11 = 0 -> plan.built;   k % 11 = 1 -> run.started;  k % 11 = 2 -> agent.spawned;  else task.ready
#   view:     k % 4 = 0  -> task.progress;                            else task.started
#   click:    k % 10 = 0 -> artifact.streaming; k % 10 in 1..5 -> artifact.chunk;
#             k % 10 = 9 -> agent.idle;                                else log.emitted
#   purchase: k % 10 = 0 -> artifact.created;  k % 10 = 5 -> run.completed; else task.completed
#   error:    k % 7 = 0  -> run.failed;  k % 2 = 0 -> task.failed;     else task.retried
# Fields: task_id 't'+(k%5); agent_id 'a'+(k%4); recoverable k%3=0 (task.failed);
#   attempt 1+k%3 (task.retried); level info/warn/error by k%3 and message 'm'+k (log.emitted);
#   step_id 's'+(k%6), pct (k%6)*0.2 (task.progress); artifact_id 'art'+(k%3) (artifact.*);
#   text 'c'+k+';' (artifact.chunk); title 'run '+user_id, seed k, speed 1+k%2 (run.started);
#   duration_ms = at (run.completed); error 'e'+k (run.failed);
#   role 'role'+(k%3), assigned tasks t(k%5) and t((k+1)%5) (agent.spawned); metrics (task.completed):
#   rows_in 10k (k%3 > 0), rows_out 9k, rows_dropped k (k%4 > 0), columns added c(k%3) and d (k even),
#   null rate of c (k%4)/4 (k odd), duration k;
#   plan tasks t0..t(2+k%3), task ti owned by 'a'+(i%4), each declaring steps s0..s3.
PLAN_STEPS = ("s0", "s1", "s2", "s3")


def _event_type(src: Column, k: Column) -> Column:
    return (
        F.when(src == "signup", F.when(k % 11 == 0, "plan.built").when(k % 11 == 1, "run.started").when(k % 11 == 2, "agent.spawned").otherwise("task.ready"))
        .when(src == "view", F.when(k % 4 == 0, "task.progress").otherwise("task.started"))
        .when(src == "click",
              F.when(k % 10 == 0, "artifact.streaming").when((k % 10).between(1, 5), "artifact.chunk")
              .when(k % 10 == 9, "agent.idle").otherwise("log.emitted"))
        .when(src == "purchase", F.when(k % 10 == 0, "artifact.created").when(k % 10 == 5, "run.completed").otherwise("task.completed"))
        .when(src == "error", F.when(k % 7 == 0, "run.failed").when(k % 2 == 0, "task.failed").otherwise("task.retried"))
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log derived from ``events`` (one run per user), superset schema:
    run_id, seq, at, ts, type, task_id, agent_id, recoverable, attempt, level, message,
    step_id, pct, artifact_id, text, title, seed, speed, duration_ms, error, role,
    assigned_task_ids, metrics, plan_tasks, k.

    ``seq`` is the dense position per run in (ts, event_id) order, numbered by ranges of that
    order so one huge run is split across many tasks (see ``ordering.running``); ``at`` is
    milliseconds since the run's first event, whose time is the running minimum."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    numbered = running(ev, ["user_id"], ["ts", "event_id"], row_number="_rn", values={"_t0": ("min", F.col("ts"))})
    k = F.col("k")
    typ = F.col("type")
    at = F.floor(F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts")) / 1000).cast("bigint")
    plan_tasks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint") + k % 3),
        lambda i: F.struct(
            F.concat(F.lit("t"), i.cast("string")).alias("task_id"),
            F.concat(F.lit("a"), (i % 4).cast("string")).alias("agent_id"),
            F.array(*[F.lit(s) for s in PLAN_STEPS]).alias("steps"),
        ),
    )
    metrics = F.struct(
        F.when(k % 3 > 0, k * 10).alias("rows_in"),
        (k * 9).alias("rows_out"),
        F.when(k % 4 > 0, k).alias("rows_dropped"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("c"), _s(k % 3)), F.lit("d"))).alias("columns_added"),
        F.when(k % 2 == 1, F.create_map(F.lit("c"), (k % 4).cast("double") / 4)).alias("null_rates"),
        k.alias("duration_ms"),
    )
    base = numbered.select(
        "user_id", "ts", "k", "_t0", (F.col("_rn") - 1).alias("seq"),
        _event_type(F.col("event_type"), k).alias("type"),
    )
    return base.select(
        F.concat(F.lit("run_"), _s("user_id")).alias("run_id"),
        "seq",
        at.alias("at"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "type",
        F.concat(F.lit("t"), _s(k % 5)).alias("task_id"),
        F.concat(F.lit("a"), _s(k % 4)).alias("agent_id"),
        F.when(typ == "task.failed", k % 3 == 0).alias("recoverable"),
        F.when(typ == "task.retried", (k % 3 + 1).cast("int")).alias("attempt"),
        F.when(typ == "log.emitted", F.when(k % 3 == 0, "info").when(k % 3 == 1, "warn").otherwise("error")).alias("level"),
        F.when(typ == "log.emitted", F.concat(F.lit("m"), _s(k))).alias("message"),
        F.when(typ == "task.progress", F.concat(F.lit("s"), _s(k % 6))).alias("step_id"),
        F.when(typ == "task.progress", (k % 6).cast("double") * F.lit(0.2)).alias("pct"),
        F.when(typ.startswith("artifact."), F.concat(F.lit("art"), _s(k % 3))).alias("artifact_id"),
        F.when(typ == "artifact.chunk", F.concat(F.lit("c"), _s(k), F.lit(";"))).alias("text"),
        F.when(typ == "run.started", F.concat(F.lit("run "), _s("user_id"))).alias("title"),
        F.when(typ == "run.started", k).alias("seed"),
        F.when(typ == "run.started", (k % 2 + 1).cast("int")).alias("speed"),
        F.when(typ == "run.completed", at).alias("duration_ms"),
        F.when(typ == "run.failed", F.concat(F.lit("e"), _s(k))).alias("error"),
        F.when(typ == "agent.spawned", F.concat(F.lit("role"), _s(k % 3))).alias("role"),
        F.when(typ == "agent.spawned", F.array(F.concat(F.lit("t"), _s(k % 5)), F.concat(F.lit("t"), _s((k + 1) % 5)))).alias("assigned_task_ids"),
        F.when(typ == "task.completed", metrics).cast(METRICS).alias("metrics"),
        F.when(typ == "plan.built", plan_tasks).alias("plan_tasks"),
        "k",
    )


def edges(spark: SparkSession, sf_dir: str, variant: str = "tree") -> DataFrame:
    """Edge table from ``part``: child = p_partkey, parent = floor(p_partkey / 2) for keys > 0
    (a tree rooted at 0).

    ``defects``: parent = -1 (unknown) when key % 97 = 0, parent = child when key % 101 = 0.
    ``cyclic``: the tree plus, for every key with key % 97 = 50, one extra edge
    (child = floor(key / 4), parent = key), closing the 3-cycle key -> key/2 -> key/4 -> key;
    the nodes below such a cycle are stuck behind it."""
    p = read_table(spark, sf_dir, "part").select("p_partkey").filter(F.col("p_partkey") > 0)
    key = F.col("p_partkey")
    parent = F.floor(key / 2).cast("bigint")
    if variant == "defects":
        parent = F.when(key % 97 == 0, F.lit(-1).cast("bigint")).when(key % 101 == 0, key).otherwise(parent)
    out = p.select(F.lit("parts").alias("group_id"), key.alias("child"), parent.alias("parent"))
    if variant == "cyclic":
        back = p.filter(key % 97 == 50).select(
            F.lit("parts").alias("group_id"), F.floor(key / 4).cast("bigint").alias("child"), key.alias("parent")
        )
        out = out.unionByName(back)
    return out


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known nodes of the edge table: every part key."""
    return read_table(spark, sf_dir, "part").select(F.lit("parts").alias("group_id"), F.col("p_partkey").alias("node"))
