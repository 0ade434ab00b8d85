"""DuckDB SQL for the same fixtures and pipeline: the correctness oracle.

Each query in ``__spark_entry__.oracle_sql`` is ``WITH <chain> SELECT ...`` over the driver's
pre-registered views. The chain mirrors ``plans/fixtures.py`` and ``plans/retail.py`` step
by step; the regex guards are the same text (``functions/patterns.py``).
"""

from __future__ import annotations

from tallyframe.functions import patterns as P


PRICE, RATE, QTY = P.PRICE_DECIMAL.upper(), P.RATE_DECIMAL.upper(), P.QTY_DECIMAL.upper()
WIDE_PRICE = P.WIDE_PRICE_DECIMAL.upper()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def money(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DOUBLE)"  # by its digits, so that the nearest double is taken


def guarded(x: str, target: str) -> str:
    regex = P.PLAIN_INT if target in ("BIGINT",) else P.PLAIN_FLOAT
    return f"CASE WHEN regexp_full_match({x}, {_q(regex)}) THEN TRY_CAST({x} AS {target}) END"


def tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{P.WHITE_SPACE}+|{P.WHITE_SPACE}+$', '', 'g'), {_q(P.REDUNDANT_DECIMAL_TAIL)}, '')"


def parse_ts(x: str, spec: str) -> str:
    return f"try_strptime({x}, {_q(P.SHAPES_BY_SPEC[spec].duck_format)})"


def parse_multi(x: str) -> str:
    return "coalesce(" + ", ".join(parse_ts(x, s) for s in (P.STRICT_SPEC, *P.FALLBACK_SPECS)) + ")"


MESSY_ORDERS = f"""
messy_base AS (
  SELECT l.*, o.o_custkey, r.r_regionkey,
         CAST(CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS BIGINT) AS VARCHAR) AS q
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
messy_orders_keyed AS (
  SELECT
    l_orderkey * 1000 + l_linenumber AS _line,
    'ORD-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_id,
    CASE WHEN (l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 17 = 0
         THEN strftime(l_shipdate, '%d/%m/%Y %H:%M')
         WHEN (l_orderkey * 11 + l_linenumber) % 211 = 0 THEN 'no date'
         ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') END AS order_ts,
    'CUST-' || CAST(o_custkey AS VARCHAR) AS customer_id,
    'R' || CAST(CASE WHEN (l_orderkey + l_partkey) % 31 = 0 THEN (r_regionkey + 1) % 5 ELSE r_regionkey END AS VARCHAR) AS region,
    'SKU-' || CAST(l_partkey AS VARCHAR) AS sku,
    CASE (l_orderkey + l_linenumber) % 33 WHEN 0 THEN ' ' || q WHEN 1 THEN q || ' ' WHEN 2 THEN q || '.0' WHEN 3 THEN q || chr(160) ELSE q END AS qty,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
      || CASE (l_orderkey + l_partkey * 5) % 41 WHEN 0 THEN '5' WHEN 1 THEN ' ' WHEN 2 THEN '1237' ELSE '' END AS unit_price,
    CASE WHEN (l_partkey + l_orderkey * 3) % 25 = 0 THEN NULL
         WHEN (l_partkey * 3 + l_orderkey) % 127 = 0 THEN 'n/a'
         ELSE CAST(CAST(l_discount AS DECIMAL(6,2)) AS VARCHAR) END AS discount_pct,
    CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'cancelled' ELSE 'completed' END AS status
  FROM messy_base
),
messy_orders AS (
  SELECT * EXCLUDE (_line) FROM messy_orders_keyed
)"""

MESSY_PRODUCTS = """
messy_products AS (
  SELECT 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_type AS category,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS cost_price
  FROM part WHERE p_partkey % 97 <> 3
)"""

MESSY_PRODUCTS_DEFECTS = """
part_defects AS (
  SELECT * FROM part WHERE p_partkey % 50 <> 0
  UNION ALL
  SELECT * FROM part WHERE p_partkey % 100 = 0
),
messy_products_defects AS (
  SELECT 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_type AS category,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS cost_price
  FROM part_defects
)"""

MESSY_CUSTOMERS = """
messy_customers AS (
  SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS segment,
         'R' || CAST(n_regionkey AS VARCHAR) AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 53 <> 7
)"""

_TIE = ", ".join(f"{c} DESC NULLS LAST" for c in ("customer_id", "region", "sku", "qty", "unit_price", "discount_pct", "status"))

CLEAN_CHAIN = f"""
parsed AS (
  SELECT * REPLACE (CAST({parse_multi('order_ts')} AS TIMESTAMP) AS order_ts) FROM messy_orders
),
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_ts DESC NULLS LAST, {_TIE}) AS rn
    FROM parsed) WHERE rn = 1
),
cleaned AS (
  SELECT * REPLACE (
    {guarded(tidy('qty'), 'BIGINT')} AS qty,
    {guarded(tidy('unit_price'), PRICE)} AS unit_price,
    coalesce({guarded('discount_pct', RATE)}, CAST(0.0 AS {RATE})) AS discount_pct)
  FROM deduped WHERE order_ts IS NOT NULL
)"""

JOIN_CHAIN = """
joined AS (
  SELECT o.*, p.product_name, p.category, p.cost_price, c.segment, c.region AS region_right
  FROM cleaned o
  JOIN messy_products p ON o.sku = p.sku
  JOIN messy_customers c ON o.customer_id = c.customer_id
)"""

DERIVE_CHAIN = f"""
derived0 AS (
  SELECT * EXCLUDE (region_right),
    CAST(qty AS {QTY}) * unit_price AS gross_revenue,
    CAST(qty AS {QTY}) * unit_price * (1 - discount_pct) AS net_revenue,
    CAST(qty AS {QTY}) * {guarded('cost_price', PRICE)} AS cogs
  FROM joined
),
derived AS (
  SELECT *, net_revenue - cogs AS margin,
    CASE WHEN net_revenue <> 0 THEN {money('net_revenue - cogs')} / {money('net_revenue')} END AS margin_pct,
    CAST(order_ts AS DATE) AS order_date,
    CAST(date_trunc('week', order_ts) AS DATE) AS order_week
  FROM derived0
)"""


def with_chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)


FIXTURES = (MESSY_ORDERS, MESSY_PRODUCTS, MESSY_CUSTOMERS)
PIPELINE = with_chain(*FIXTURES, CLEAN_CHAIN, JOIN_CHAIN, DERIVE_CHAIN)


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN CAST({d} AS DOUBLE) <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0.0 END"


def predicate(date_from=None, date_to=None, category=None, region=None) -> str:
    c = ["TRUE"]
    if date_from:
        c.append(f"order_date >= DATE {_q(date_from)}")
    if date_to:
        c.append(f"order_date <= DATE {_q(date_to)}")
    if category:
        c.append(f"category = {_q(category)}")
    if region:
        c.append(f"region = {_q(region)}")
    return " AND ".join(c)


def kpis_sql(**f) -> str:
    net = money("coalesce(sum(net_revenue) FILTER (WHERE status = 'completed'), 0)")
    mar = money("coalesce(sum(margin) FILTER (WHERE status = 'completed'), 0)")
    return f"""{PIPELINE},
k AS (
  SELECT {net} AS net_revenue, {mar} AS margin,
         CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS order_count,
         CAST(count(*) FILTER (WHERE status = 'returned') AS BIGINT) AS returned_count,
         CAST(count(*) AS BIGINT) AS rows
  FROM derived WHERE {predicate(**f)}
)
SELECT net_revenue, order_count, {ratio('net_revenue', 'order_count')} AS average_order_value,
       {ratio('margin', 'net_revenue')} AS margin_pct,
       {ratio('returned_count', 'order_count + returned_count')} AS return_rate,
       returned_count, rows
FROM k"""


def _released(f: dict, field: str) -> dict:
    g = dict(f)
    g.pop(field, None)
    return g


def weekly_sql(**f) -> str:
    return f"""{PIPELINE}
SELECT order_week, {money('coalesce(sum(net_revenue), 0)')} AS net_revenue, CAST(count(*) AS BIGINT) AS order_count
FROM derived WHERE {predicate(**f)} AND status = 'completed'
GROUP BY order_week ORDER BY order_week"""


def category_sql(**f) -> str:
    return f"""{PIPELINE}
SELECT category, {money('sum(net_revenue)')} AS net_revenue,
       {ratio(money('sum(margin)'), money('sum(net_revenue)'))} AS margin_pct
FROM derived WHERE {predicate(**_released(f, 'category'))} AND status = 'completed'
GROUP BY category ORDER BY net_revenue DESC, category"""


def region_sql(**f) -> str:
    return f"""{PIPELINE},
g AS (
  SELECT region, sum(net_revenue) AS net
  FROM derived WHERE {predicate(**_released(f, 'region'))} AND status = 'completed'
  GROUP BY region
)
SELECT region, {money('net')} AS net_revenue, {ratio(money('net'), money('sum(net) OVER ()'))} AS share
FROM g ORDER BY net_revenue DESC, region"""


def top_products_sql(k: int = P.TOP_PRODUCT_LIMIT, **f) -> str:
    return f"""{PIPELINE},
g AS (
  SELECT sku, min(product_name) AS product_name, sum(net_revenue) AS net, sum(margin) AS margin,
         CAST(sum(qty) AS BIGINT) AS units
  FROM derived WHERE {predicate(**f)} AND status = 'completed'
  GROUP BY sku
)
SELECT sku, product_name, {money('net')} AS net_revenue, units, {ratio(money('margin'), money('net'))} AS margin_pct
FROM g ORDER BY net DESC, sku LIMIT {k}"""


EVENT_LOG = """
ev0 AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
               min(ts) OVER (PARTITION BY user_id) AS t0 FROM ev0),
ev2 AS (
  SELECT *,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k % 11 = 0 THEN 'plan.built' WHEN k % 11 = 1 THEN 'run.started' WHEN k % 11 = 2 THEN 'agent.spawned' ELSE 'task.ready' END
      WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 'task.progress' ELSE 'task.started' END
      WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'artifact.streaming' WHEN k % 10 BETWEEN 1 AND 5 THEN 'artifact.chunk'
                             WHEN k % 10 = 9 THEN 'agent.idle' ELSE 'log.emitted' END
      WHEN 'purchase' THEN CASE WHEN k % 10 = 0 THEN 'artifact.created' WHEN k % 10 = 5 THEN 'run.completed' ELSE 'task.completed' END
      WHEN 'error' THEN CASE WHEN k % 7 = 0 THEN 'run.failed' WHEN k % 2 = 0 THEN 'task.failed' ELSE 'task.retried' END
    END AS type,
    CAST(floor((epoch_us(ts) - epoch_us(t0)) / 1000) AS BIGINT) AS "at"
  FROM ev1
),
event_log AS (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, seq, "at", ts, type,
    't' || CAST(k % 5 AS VARCHAR) AS task_id, 'a' || CAST(k % 4 AS VARCHAR) AS agent_id,
    CASE WHEN type = 'task.failed' THEN k % 3 = 0 END AS recoverable,
    CASE WHEN type = 'task.retried' THEN CAST(k % 3 + 1 AS INTEGER) END AS attempt,
    CASE WHEN type = 'log.emitted' THEN CASE k % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' ELSE 'error' END END AS level,
    CASE WHEN type = 'log.emitted' THEN 'm' || CAST(k AS VARCHAR) END AS message,
    CASE WHEN type = 'task.progress' THEN 's' || CAST(k % 6 AS VARCHAR) END AS step_id,
    CASE WHEN type = 'task.progress' THEN CAST(k % 6 AS DOUBLE) * CAST(0.2 AS DOUBLE) END AS pct,
    CASE WHEN type LIKE 'artifact.%' THEN 'art' || CAST(k % 3 AS VARCHAR) END AS artifact_id,
    CASE WHEN type = 'artifact.chunk' THEN 'c' || CAST(k AS VARCHAR) || ';' END AS text,
    CASE WHEN type = 'run.started' THEN 'run ' || CAST(user_id AS VARCHAR) END AS title,
    CASE WHEN type = 'run.started' THEN k END AS seed,
    CASE WHEN type = 'run.started' THEN CAST(k % 2 + 1 AS INTEGER) END AS speed,
    CASE WHEN type = 'run.completed' THEN "at" END AS duration_ms,
    CASE WHEN type = 'run.failed' THEN 'e' || CAST(k AS VARCHAR) END AS error,
    CASE WHEN type = 'plan.built' THEN 3 + k % 3 END AS plan_n,
    CASE WHEN type = 'agent.spawned' THEN 'role' || CAST(k % 3 AS VARCHAR) END AS role,
    CASE WHEN type = 'agent.spawned' THEN 't' || CAST(k % 5 AS VARCHAR) || ',t' || CAST((k + 1) % 5 AS VARCHAR) END AS assigned,
    k
  FROM ev2
)"""


def task_fields_cte(src: str = "event_log") -> str:
    """plan_tasks, lp, trows, task_fields over the event CTE ``src``."""
    return f"""
plan_tasks AS (
  SELECT run_id, seq, 't' || CAST(i AS VARCHAR) AS task_id, 'a' || CAST(i % 4 AS VARCHAR) AS agent_id
  FROM (SELECT run_id, seq, unnest(range(0, plan_n)) AS i FROM {src} WHERE type = 'plan.built')
),
lp AS (SELECT run_id, max(seq) AS lp FROM {src} WHERE type = 'plan.built' GROUP BY run_id),
trows AS (
  SELECT run_id, task_id, seq, 'pending' AS status, agent_id AS owner, CAST(NULL AS INTEGER) AS attempt, CAST(NULL AS DOUBLE) AS progress, CAST(NULL AS BIGINT) AS mk
  FROM plan_tasks
  UNION ALL
  SELECT run_id, task_id, seq,
    CASE type WHEN 'task.ready' THEN 'ready' WHEN 'task.started' THEN 'running' WHEN 'task.retried' THEN 'running'
              WHEN 'task.failed' THEN CASE WHEN recoverable THEN 'retrying' ELSE 'failed' END
              WHEN 'task.completed' THEN 'completed' END,
    CASE WHEN type IN ('task.started', 'task.failed', 'task.completed') THEN agent_id END,
    CASE WHEN type = 'task.retried' THEN attempt END,
    CASE WHEN type = 'task.progress' THEN pct WHEN type = 'task.completed' THEN CAST(1.0 AS DOUBLE) END,
    CASE WHEN type = 'task.completed' THEN k END
  FROM {src} WHERE type IN ('task.ready', 'task.started', 'task.retried', 'task.failed', 'task.completed', 'task.progress')
),
tj AS (SELECT t.*, (lp.lp IS NULL OR t.seq >= lp.lp) AS after FROM trows t LEFT JOIN lp USING (run_id)),
task_fields AS (
  SELECT * FROM (
    SELECT run_id, task_id,
      arg_max(status, seq) FILTER (WHERE after AND status IS NOT NULL) AS status,
      arg_max(owner, seq) FILTER (WHERE after AND owner IS NOT NULL) AS owner,
      arg_max(attempt, seq) FILTER (WHERE attempt IS NOT NULL) AS attempts,
      arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress,
      arg_max(mk, seq) FILTER (WHERE mk IS NOT NULL) AS mk
    FROM tj GROUP BY run_id, task_id)
  WHERE status IS NOT NULL OR owner IS NOT NULL OR attempts IS NOT NULL OR progress IS NOT NULL
)"""


# A task's metrics, from the k of its last completion (see the fixture's fixed values).
TASK_METRICS = """CASE WHEN mk % 3 > 0 THEN mk * 10 END AS rows_in, mk * 9 AS rows_out, CASE WHEN mk % 4 > 0 THEN mk END AS rows_dropped,
       CASE WHEN mk % 2 = 0 THEN 'c' || CAST(mk % 3 AS VARCHAR) || ',d' END AS columns_added,
       CASE WHEN mk % 2 = 1 THEN 'c=' || CAST(CAST(mk % 4 AS DOUBLE) / 4 AS VARCHAR) END AS null_rates, mk AS task_ms"""


RUN_HEADER = """
run_header AS (
  SELECT run_id, max(seq) AS last_seq, bool_or(type = 'run.started') AS started, bool_or(type = 'run.completed') AS completed,
    arg_max(error, seq) FILTER (WHERE type = 'run.failed' AND error IS NOT NULL) AS error,
    arg_max(duration_ms, seq) FILTER (WHERE type = 'run.completed' AND duration_ms IS NOT NULL) AS duration_ms,
    arg_max(title, seq) FILTER (WHERE type = 'run.started' AND title IS NOT NULL) AS requirement_title,
    arg_max(seed, seq) FILTER (WHERE type = 'run.started' AND seed IS NOT NULL) AS seed,
    coalesce(arg_max(speed, seq) FILTER (WHERE type = 'run.started' AND speed IS NOT NULL), 1) AS speed
  FROM event_log GROUP BY run_id
)"""

STREAM_TEXT = """
keyed AS (SELECT * FROM event_log WHERE type IN ('artifact.streaming', 'artifact.chunk', 'artifact.created')),
op AS (SELECT * FROM (SELECT run_id, artifact_id, max(seq) FILTER (WHERE type = 'artifact.streaming') AS o FROM keyed GROUP BY ALL) WHERE o IS NOT NULL),
st0 AS (
  SELECT k.run_id, k.artifact_id,
    coalesce(string_agg(k.text, '' ORDER BY k.seq) FILTER (WHERE k.seq > op.o AND k.type = 'artifact.chunk'), '') AS text,
    bool_or(k.seq > op.o AND k.type = 'artifact.created') AS complete
  FROM keyed k JOIN op USING (run_id, artifact_id) GROUP BY ALL
),
stream_text AS (SELECT run_id, artifact_id, text, CAST(length(text) AS BIGINT) AS chars, complete FROM st0)"""

ARTIFACT_LIST = """
artifact_list AS (
  SELECT run_id, CAST(count(*) FILTER (WHERE type = 'artifact.created') AS BIGINT) AS artifact_count,
    coalesce(string_agg(artifact_id, ',' ORDER BY seq) FILTER (WHERE type = 'artifact.created'), '') AS artifact_ids
  FROM event_log GROUP BY run_id
)"""

AGENT_ACTIVITY = """
ag AS (
  SELECT run_id, agent_id,
    arg_max(CASE WHEN type IN ('agent.spawned', 'task.started') THEN false ELSE true END, seq)
      FILTER (WHERE type IN ('agent.spawned', 'task.started', 'agent.idle')) AS idle,
    coalesce(arg_max(role, seq) FILTER (WHERE type = 'agent.spawned'), '') AS role,
    coalesce(arg_max(assigned, seq) FILTER (WHERE type = 'agent.spawned'), '') AS assigned_tasks,
    arg_max(message, seq) FILTER (WHERE type = 'log.emitted' AND message IS NOT NULL) AS last_message
  FROM event_log GROUP BY ALL
),
cur AS (SELECT run_id, owner AS agent_id, min(task_id) AS current_task FROM task_fields WHERE status IN ('running', 'retrying') GROUP BY ALL),
agent_activity AS (
  SELECT ag.run_id, ag.agent_id, ag.role, ag.assigned_tasks, ag.idle, cur.current_task, ag.last_message
  FROM ag LEFT JOIN cur USING (run_id, agent_id) WHERE ag.idle IS NOT NULL
)"""

EVENTS = with_chain(EVENT_LOG)
EVENTS_TASKS = with_chain(EVENT_LOG, task_fields_cte())
