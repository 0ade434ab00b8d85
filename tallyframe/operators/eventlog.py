"""Event log to state (E2-E15, E17), batch.

The input is an ordered log of typed events keyed by (run_id, seq) with the superset schema
of ``plans/fixtures.event_log``. A per-run fold is re-expressed as grouped aggregates: "last
event wins" is ``max_by(value, seq)`` (partial aggregation, so a hot run or task is reduced
in every map task before the shuffle); resets are a per-run boundary joined back; positions and
text offsets are running figures by ranges (``ordering.running``), so lists are rows with a
position and texts are rows of blocks with an offset, whatever a run or a text holds.
``stream_text``, ``artifact_list`` and ``run_summary`` put these rows together into one value a
text or run, which only fits where that value does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ordering import running

STATUS_TYPES = ("task.ready", "task.started", "task.retried", "task.failed", "task.completed")
OWNER_TYPES = ("task.started", "task.failed", "task.completed")
TERMINAL = "task.completed"
#: The record that a completed task carries.
METRICS = "struct<rows_in:bigint,rows_out:bigint,rows_dropped:bigint,columns_added:array<string>,null_rates:map<string,double>,duration_ms:bigint>"
#: Characters that a block of a text is cut at.
BLOCK_CHARS = 1 << 16


def _t(name: str) -> Column:
    return F.col("type") == F.lit(name)


def status_of() -> Column:
    """Status an event sets on its task (null when it sets none)."""
    return (
        F.when(_t("task.ready"), "ready")
        .when(_t("task.started") | _t("task.retried"), "running")
        .when(_t("task.failed"), F.when(F.col("recoverable"), "retrying").otherwise("failed"))
        .when(_t("task.completed"), "completed")
    )


def last_by(value: Column, seq: str = "seq") -> Column:
    """Value at the greatest seq among rows where the value is not null."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(seq)))


# ------------------------------------------------------------------ E2, E3


def dedupe_events(ev: DataFrame) -> DataFrame:
    """Exactly once by position. Copies share (run_id, seq) and are the same event; one is kept."""
    return ev.dropDuplicates(["run_id", "seq"])


def run_clock(ev: DataFrame, reported: str = "at", out: str = "clock") -> DataFrame:
    """The run clock = running max of reported times in seq order, per run (by ranges of
    the order, so one long run is spread over many tasks)."""
    return running(ev, ["run_id"], ["seq"], values={out: ("max", F.col(reported))})


# ------------------------------------------------------------------ E4, E5, E15


def _last_plan(ev: DataFrame) -> DataFrame:
    return ev.filter(_t("plan.built")).groupBy("run_id").agg(F.max("seq").alias("_lp"))


def _task_rows(ev: DataFrame) -> DataFrame:
    """One row per task-affecting fact: plan.built explodes to one 'pending' row per
    planned task (with the plan's owner); resettable facts are status and owner."""
    plan = ev.filter(_t("plan.built")).select(
        "run_id", "seq", F.explode("plan_tasks").alias("_p")
    ).select(
        "run_id",
        F.col("_p.task_id").alias("task_id"),
        "seq",
        F.lit("pending").alias("status"),
        F.col("_p.agent_id").alias("owner"),
        F.lit(None).cast("int").alias("attempt"),
        F.lit(None).cast("double").alias("progress"),
        F.lit(None).cast(METRICS).alias("metrics"),
    )
    facts = ev.filter(F.col("type").isin(*STATUS_TYPES, "task.progress")).select(
        "run_id",
        "task_id",
        "seq",
        status_of().alias("status"),
        F.when(F.col("type").isin(*OWNER_TYPES), F.col("agent_id")).alias("owner"),
        F.when(_t("task.retried"), F.col("attempt")).alias("attempt"),
        F.when(_t("task.progress"), F.col("pct")).when(_t(TERMINAL), F.lit(1.0)).alias("progress"),
        F.when(_t(TERMINAL), F.col("metrics")).alias("metrics"),
    )
    return plan.unionByName(facts)


def metric_columns(metrics: str = "metrics") -> list[Column]:
    """A task's metrics record as columns; lists and maps as text ("a,b", "a=0.5,b=0.0")."""
    m = F.col(metrics)
    rates = F.array_sort(F.transform(F.map_entries(m["null_rates"]), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return [m["rows_in"].alias("rows_in"), m["rows_out"].alias("rows_out"), m["rows_dropped"].alias("rows_dropped"),
            F.array_join(m["columns_added"], ",").alias("columns_added"), F.array_join(rates, ",").alias("null_rates"),
            m["duration_ms"].alias("task_ms")]


def task_fields(ev: DataFrame) -> DataFrame:
    """E4 + E5: (run_id, task_id, status, owner, attempts, progress, metrics) per task; the metrics
    are those of the last completion that has some.

    A plan.built replaces the status and owner maps: every planned task becomes 'pending'
    with the plan's owner and tasks outside the plan leave both maps. So status and owner
    only consider facts at or after the run's last plan.built. Attempts and progress are
    never reset (a completion forces progress to 1.0)."""
    rows = _task_rows(ev).join(_last_plan(ev), "run_id", "left")
    after = F.col("_lp").isNull() | (F.col("seq") >= F.col("_lp"))
    g = rows.groupBy("run_id", "task_id").agg(
        last_by(F.when(after, F.col("status"))).alias("status"),
        last_by(F.when(after, F.col("owner"))).alias("owner"),
        last_by(F.col("attempt")).alias("attempts"),
        last_by(F.col("progress")).alias("progress"),
        last_by(F.col("metrics")).alias("metrics"),
    )
    return g.filter(
        F.col("status").isNotNull() | F.col("owner").isNotNull() | F.col("attempts").isNotNull() | F.col("progress").isNotNull()
    )


def task_status(ev: DataFrame) -> DataFrame:
    """(run_id, task_id, status) for tasks in the status map."""
    return task_fields(ev).filter(F.col("status").isNotNull()).select("run_id", "task_id", "status")


def status_as_of(ev: DataFrame, n: int) -> DataFrame:
    """Task status as of seq <= n (a prefix replay)."""
    return task_status(ev.filter(F.col("seq") <= n))


# ------------------------------------------------------------------ E6, E7


def retry_count(ev: DataFrame) -> DataFrame:
    """(run_id, retry_count) for every run."""
    return ev.groupBy("run_id").agg(F.count_if(_t("task.retried")).alias("retry_count"))


def _header_aggs() -> list[Column]:
    started, done, failed = _t("run.started"), _t("run.completed"), _t("run.failed")
    return [
        F.max("seq").alias("last_seq"),
        F.bool_or(started).alias("started"),
        F.bool_or(done).alias("completed"),
        last_by(F.when(failed, F.col("error"))).alias("error"),
        last_by(F.when(done, F.col("duration_ms"))).alias("duration_ms"),
        last_by(F.when(started, F.col("title"))).alias("requirement_title"),
        last_by(F.when(started, F.col("seed"))).alias("seed"),
        F.coalesce(last_by(F.when(started, F.col("speed"))), F.lit(1)).alias("speed"),
    ]


def run_header(ev: DataFrame) -> DataFrame:
    """Started, completed, error, duration, title, seed, speed, last seq per run."""
    return ev.groupBy("run_id").agg(*_header_aggs())


# ------------------------------------------------------------------ E8, E9


def _opened(ev: DataFrame) -> DataFrame:
    """Artifact events of streams that were opened, with their latest opener (``_open``)."""
    keyed = ev.filter(F.col("type").isin("artifact.streaming", "artifact.chunk", "artifact.created"))
    opener = keyed.groupBy("run_id", "artifact_id").agg(
        F.max(F.when(_t("artifact.streaming"), F.col("seq"))).alias("_open")
    ).filter(F.col("_open").isNotNull())
    return keyed.join(opener, ["run_id", "artifact_id"])


def stream_blocks(ev: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """E8 in rows: (run_id, artifact_id, block, offset, text, chars) of opened streams, in order the
    whole text.

    An opener (re)starts the text; chunks after the latest opener follow in seq order; chunks with
    no opener before them are dropped. A chunk's offset is the running sum of the lengths before
    it, and it goes to the block in which it begins, so a block holds ``block_chars`` characters
    and the rest of its last chunk, however long the text."""
    chunks = _opened(ev).filter(_t("artifact.chunk") & (F.col("seq") > F.col("_open")) & (F.length("text") > 0))
    placed = running(chunks.select("run_id", "artifact_id", "seq", "text"), ["run_id", "artifact_id"], ["seq"],
                     values={"_end": ("sum", F.length("text").cast("bigint"))})
    start = F.col("_end") - F.length("text")
    keyed = placed.withColumns({"_start": start, "block": F.floor(start / F.lit(block_chars)).cast("bigint")})
    g = keyed.groupBy("run_id", "artifact_id", "block").agg(
        F.min("_start").alias("offset"),
        F.array_sort(F.collect_list(F.struct("_start", "text"))).alias("_chunks"),  # at most block_chars
    )
    text = F.array_join(F.transform("_chunks", lambda c: c["text"]), "")
    return g.select("run_id", "artifact_id", "block", "offset", text.alias("text"), F.length(text).cast("bigint").alias("chars"))


def stream_text(ev: DataFrame) -> DataFrame:
    """(run_id, artifact_id, text, chars, complete) per opened stream, its blocks put together.
    The stream is complete when an artifact.created follows the latest opener."""
    whole = stream_blocks(ev).groupBy("run_id", "artifact_id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("_blocks"))
    text = F.coalesce(F.array_join(F.transform("_blocks", lambda b: b["text"]), ""), F.lit(""))
    return stream_sizes(ev).join(whole, ["run_id", "artifact_id"], "left").select("run_id", "artifact_id", text.alias("text"), "chars", "complete")


def stream_sizes(ev: DataFrame) -> DataFrame:
    """E8's (run_id, artifact_id, chars, complete) without putting any text together."""
    live = F.col("seq") > F.col("_open")
    return _opened(ev).groupBy("run_id", "artifact_id").agg(
        F.coalesce(F.sum(F.when(live & _t("artifact.chunk"), F.length("text"))), F.lit(0)).cast("bigint").alias("chars"),
        F.bool_or(live & _t("artifact.created")).alias("complete"),
    )


def artifact_rows(ev: DataFrame) -> DataFrame:
    """E9 in rows: (run_id, position, artifact_id, seq), positions from 1 in arrival order."""
    created = ev.filter(_t("artifact.created")).select("run_id", "artifact_id", "seq")
    return running(created, ["run_id"], ["seq"], row_number="position").select("run_id", "position", "artifact_id", "seq")


def joined_list(rows: DataFrame, name: str, key: str = "position", value: str = "artifact_id") -> DataFrame:
    """Rows with a position as one text a run."""
    listed = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(key, value))).alias("_l"))
    return listed.select("run_id", F.array_join(F.transform("_l", lambda x: x[value]), ",").alias(name))


def artifact_list(ev: DataFrame) -> DataFrame:
    """(run_id, artifact_count, artifact_ids) in arrival order, for every run."""
    counts = ev.groupBy("run_id").agg(F.count_if(_t("artifact.created")).alias("artifact_count"))
    ids = joined_list(ev.filter(_t("artifact.created")), "artifact_ids", "seq")
    return counts.join(ids, "run_id", "left").select("run_id", "artifact_count", F.coalesce("artifact_ids", F.lit("")).alias("artifact_ids"))


# ------------------------------------------------------------------ E10


def agent_activity(ev: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(run_id, agent_id, role, assigned_tasks, idle, current_task, last_message).

    Agents enter on agent.spawned, task.started or agent.idle; role and assigned tasks are those of
    the last agent.spawned (none: empty); idle is the last of (spawned/started -> false, idle ->
    true). current_task is the smallest task id the agent owns that is running or retrying;
    last_message is its latest log line."""
    spawned = _t("agent.spawned")
    marks = F.when(spawned | _t("task.started"), F.lit(False)).when(_t("agent.idle"), F.lit(True))
    a = ev.groupBy("run_id", "agent_id").agg(
        last_by(F.when(spawned, F.struct("role", "assigned_task_ids"))).alias("_spawned"),
        last_by(marks).alias("idle"),
        last_by(F.when(_t("log.emitted"), F.col("message"))).alias("last_message"),
    ).filter(F.col("idle").isNotNull())
    fields = fields if fields is not None else task_fields(ev)
    cur = fields.filter(F.col("status").isin("running", "retrying")).groupBy("run_id", F.col("owner").alias("agent_id")).agg(
        F.min("task_id").alias("current_task")
    )
    return a.join(cur, ["run_id", "agent_id"], "left").select(
        "run_id", "agent_id", F.coalesce("_spawned.role", F.lit("")).alias("role"),
        F.coalesce(F.array_join("_spawned.assigned_task_ids", ","), F.lit("")).alias("assigned_tasks"),
        "idle", "current_task", "last_message",
    )


# ------------------------------------------------------------------ E11


def run_figures(ev: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """E11's figures without its lists, one row a run, every aggregate combining map-side: header
    (E7), counts, the latest plan's size and the streamed characters."""
    plan = _t("plan.built")
    per_run = ev.groupBy("run_id").agg(
        *_header_aggs(),
        F.count_if(_t("task.retried")).alias("retry_count"),
        F.count_if(_t("artifact.created")).alias("artifact_count"),
        F.count_if(_t("log.emitted")).alias("log_count"),
        F.max_by(F.when(plan, F.size("plan_tasks")), F.when(plan, F.col("seq"))).cast("bigint").alias("_plan"),
    )
    streamed = (sizes if sizes is not None else stream_sizes(ev)).groupBy("run_id").agg(F.sum("chars").alias("_chars"))
    return per_run.join(streamed, "run_id", "left").withColumns({
        "plan_task_count": F.coalesce("_plan", F.lit(0)).cast("bigint"), "streamed_chars": F.coalesce("_chars", F.lit(0)).cast("bigint"),
    }).drop("_plan", "_chars")


LISTS = ("task_status", "task_agent", "task_attempts", "artifact_ids", "streaming_ids", "streams_complete", "agents_spawned", "agents_idle")


def _list_entries(ev: DataFrame, fields: DataFrame, sizes: DataFrame) -> DataFrame:
    """(run_id, list, key, at, value): an entry of a list of E11; lists are in the order of at, then key."""
    none = F.lit(None).cast("string")

    def entries(of: DataFrame, key: str, *lists: Column, at: Column = F.lit(None).cast("bigint")) -> DataFrame:
        held = F.filter(F.array(*lists), lambda x: x.isNotNull())
        return of.select("run_id", F.explode(held).alias("_x"), F.col(key).alias("key"), at.alias("at")).select("run_id", F.col("_x.list").alias("list"), "key", "at", F.col("_x.value").alias("value"))

    entry = lambda name, when, value=none: F.when(when, F.struct(F.lit(name).alias("list"), value.alias("value")))
    c = F.col
    tasks = entries(fields, "task_id", *[entry(name, c(col).isNotNull(), c(col).cast("string")) for name, col in (("task_status", "status"), ("task_agent", "owner"), ("task_attempts", "attempts"))])
    made = entries(ev.filter(_t("artifact.created")), "artifact_id", entry("artifact_ids", F.lit(True)), at=c("seq"))
    streams = entries(sizes, "artifact_id", entry("streaming_ids", F.lit(True)), entry("streams_complete", c("complete")))
    agents = entries(agent_activity(ev, fields), "agent_id", entry("agents_spawned", F.lit(True)), entry("agents_idle", c("idle")))
    return tasks.unionByName(made).unionByName(streams).unionByName(agents)


def run_lists(ev: DataFrame) -> DataFrame:
    """E11's lists and maps in rows: (run_id, list, position, key, value), positions from 1."""
    rows = running(_list_entries(ev, task_fields(ev), stream_sizes(ev)), ["run_id", "list"], ["at", "key"], row_number="position")
    return rows.select("run_id", "list", "position", "key", "value")


def run_summary(ev: DataFrame) -> DataFrame:
    """One comparable record a run (maps as sorted 'key=value' lists): ``run_figures`` and, put
    together, the rows of ``run_lists``."""
    sizes = stream_sizes(ev)
    text = F.when(F.col("value").isNull(), F.col("key")).otherwise(F.concat("key", F.lit("="), "value"))
    listed = _list_entries(ev, task_fields(ev), sizes).groupBy("run_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("at", F.col("key"), text.alias("text"))))).alias(name) for name in LISTS]
    )
    lists = listed.select("run_id", *[F.array_join(F.transform(name, lambda x: x["text"]), ",").alias(name) for name in LISTS])
    out = run_figures(ev, sizes).join(lists, "run_id", "left").fillna("", list(LISTS))
    return out.select(
        "run_id", "last_seq", "seed", "speed", "requirement_title", "started", "completed", "error", "duration_ms",
        "task_status", "task_agent", "task_attempts", "retry_count", "artifact_count", "artifact_ids", "log_count",
        "streaming_ids", "streamed_chars", "streams_complete", "agents_spawned", "agents_idle", "plan_task_count",
    )


# ------------------------------------------------------------------ E12, E13


def log_tail(ev: DataFrame, n: int = 500, levels: tuple[str, ...] | None = None, agent: str | None = None,
             per: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The last ``n`` log lines per run (or per run and task), newest rank 1.

    ``row_number() <= n`` lets Spark insert a partial group limit before the shuffle, so a
    run with a billion log lines ships at most n rows per map task."""
    logs = ev.filter(_t("log.emitted"))
    if levels:
        logs = logs.filter(F.col("level").isin(*levels))
    if agent:
        logs = logs.filter(F.col("agent_id") == agent)
    w = Window.partitionBy(*per).orderBy(F.col("seq").desc())
    return logs.withColumn("tail_rank", F.row_number().over(w)).filter(F.col("tail_rank") <= n).select(
        "run_id", "seq", "level", "agent_id", "task_id", "message", "tail_rank"
    )


def latest_artifact(ev: DataFrame) -> DataFrame:
    """Per artifact id, the artifact.created of the newest run (latest run start;
    run_id, then seq break ties). An aggregate of structs, so it combines map-side."""
    starts = ev.groupBy("run_id").agg(F.min("ts").alias("_started"))
    created = ev.filter(_t("artifact.created")).select("run_id", "artifact_id", "seq").join(starts, "run_id")
    best = created.groupBy("artifact_id").agg(F.max(F.struct("_started", "run_id", "seq")).alias("_b"))
    return best.select("artifact_id", F.col("_b.run_id").alias("run_id"), F.col("_b.seq").alias("seq"),
                       F.col("_b._started").alias("run_started"))


# ------------------------------------------------------------------ E14


def _scoped(ev: DataFrame) -> DataFrame:
    """The log once, an entry for each scope that an event counts in: its run, its task (task events and
    artifact.created), its artifact (openers and chunks)."""
    task = F.coalesce(F.col("type").startswith("task."), F.lit(False))
    scope = lambda name, c, on: F.when(on, F.struct(F.lit(name).alias("scope"), c.alias("id")))
    scopes = F.filter(F.array(
        scope("run", F.lit(None).cast("string"), F.lit(True)),
        scope("task", F.col("task_id"), task | _t("artifact.created")),
        scope("artifact", F.col("artifact_id"), _t("artifact.streaming") | _t("artifact.chunk")),
    ), lambda x: x.isNotNull())
    return ev.select("run_id", "seq", "at", "type", F.col("recoverable").alias("_rec"), F.explode(scopes).alias("_s")).select(
        "run_id", "seq", "at", "type", "_rec", F.col("_s.scope").alias("scope"), F.col("_s.id").alias("id"))


def contract_violations(ev: DataFrame) -> DataFrame:
    """(run_id, rule, violations) for rules 1-7, every run and rule.

    1 seq contiguous from 0 (gaps + repeats); 2 ``at`` never falls (rows behind the running
    max); 3 every task.started has exactly one terminal (tasks where starts differ from
    completions + unrecoverable failures); 4 a recoverable failure is followed by a retry
    and then a terminal (failures with no retry before the task's last terminal);
    5 artifact.created precedes its task's completion (created after the last completion
    or with none); 6 chunks follow an opener (chunks with no opener before them; the rest of
    rule 6 is in ``artifact_order_violations``); 7 run.completed is last (events after the first run.completed).

    The log is read once: every event has an entry for its run and for its task or artifact, running
    marks are set over all of them together, and the rest are aggregates. A retry counts for rule
    4 if a terminal follows, so a task's rows are summed up between its terminals first."""
    recoverable = _t("task.failed") & F.coalesce(F.col("_rec"), F.lit(False))
    terminal = _t(TERMINAL) | (_t("task.failed") & ~F.coalesce(F.col("_rec"), F.lit(False)))
    one = lambda cond: F.when(cond, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    d = running(_scoped(ev), ["run_id", "scope", "id"], ["seq", "type", "at"], values={
        "_prev": ("max", F.col("seq"), True),
        "_clock": ("max", F.col("at"), True),
        "_over": ("max", one(_t("run.completed")), True),
        "_opened": ("max", one(_t("artifact.streaming")), True),
        "_terms": ("sum", one(terminal)),
        "_fails": ("sum", one(recoverable)),
        "_made": ("sum", one(_t("artifact.created"))),
    })
    scope = lambda name: F.col("scope") == name
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    gap = F.when(F.col("_prev").isNull(), F.col("seq")).when(F.col("_prev") == F.col("seq"), 1).otherwise(F.col("seq") - F.col("_prev") - 1)
    between = d.groupBy("run_id", "scope", "id", F.when(scope("task"), F.col("_terms")).otherwise(0).alias("_k")).agg(
        F.sum(F.when(scope("run"), gap)).alias("v1"),
        count(scope("run") & (F.col("at") < F.col("_clock"))).alias("v2"),
        count(scope("artifact") & _t("artifact.chunk") & (F.coalesce("_opened", F.lit(0)) == 0)).alias("v6"),
        count(scope("run") & (F.col("_over") == 1)).alias("v7"),
        count(scope("task") & _t("task.started")).alias("_starts"),
        count(scope("task") & terminal).alias("_ends"),
        F.max(F.when(scope("task"), F.col("_fails"))).alias("_failed"),
        F.max(F.when(scope("task"), F.col("_made"))).alias("_created"),
        F.max(F.when(scope("task") & _t("task.retried"), F.col("_fails"))).alias("_retried"),
        F.max(F.when(scope("task") & _t(TERMINAL), F.col("_made"))).alias("_in_time"),
    )
    # rows after a task's last terminal are those of its greatest _k; the retries there count for nothing
    top = between.filter(scope("task")).groupBy("run_id", "id").agg(F.max("_k").alias("_top"))
    top = top.select(F.col("run_id").alias("_r"), F.col("id").alias("_i"), "_top")
    told = between.join(top, scope("task") & (F.col("run_id") == F.col("_r")) & F.col("id").eqNullSafe(F.col("_i")), "left")
    per = told.groupBy("run_id", "scope", "id").agg(
        *[F.sum(v).alias(v) for v in ("v1", "v2", "v6", "v7")],
        F.sum("_starts").alias("_starts"), F.sum("_ends").alias("_ends"),
        (F.max("_failed") - F.coalesce(F.max(F.when(F.col("_k") < F.col("_top"), F.col("_retried"))), F.lit(0))).alias("v4"),
        (F.max("_created") - F.coalesce(F.max("_in_time"), F.lit(0))).alias("v5"),
    )
    wide = per.groupBy("run_id").agg(
        *[F.sum(f"v{i}").alias(f"v{i}") for i in (1, 2, 4, 5, 6, 7)], count(scope("task") & (F.col("_starts") != F.col("_ends"))).alias("v3"),
    )
    stack = ", ".join(f"{i}, coalesce(v{i}, 0L)" for i in range(1, 8))
    return wide.selectExpr("run_id", f"stack(7, {stack}) as (rule, violations)").select(
        "run_id", F.col("rule").cast("int").alias("rule"), F.col("violations").cast("bigint").alias("violations")
    )


ORDER_PARTS = ("chunk_before_opener", "chunk_after_created", "opener_without_chunk")


def artifact_order_violations(ev: DataFrame) -> DataFrame:
    """E14, the whole of rule 6: (run_id, part, violations), every run and part.

    The order is opener, one or more chunks, artifact.created (which may also come alone).
    chunk_before_opener: chunks with no opener before them (rule 6 of ``contract_violations``);
    chunk_after_created: opened chunks with an artifact.created after their last opener;
    opener_without_chunk: openers with no chunk before the next artifact.created. An opener
    with no artifact.created after it is not finished and counts nothing."""
    key = ["run_id", "artifact_id"]
    created = _t("artifact.created")
    keyed = ev.filter(F.col("type").isin("artifact.streaming", "artifact.chunk", "artifact.created")).select(*key, "seq", "type")
    mark = lambda at: at * 2 + created.cast("bigint")  # noqa: E731  position, and odd where it is a created
    d = keyed.withColumn("_back", -F.col("seq")).withColumns({
        "_open": F.when(_t("artifact.streaming"), F.col("seq")),
        "_fore": F.when(~_t("artifact.chunk"), mark(F.col("seq"))),
        "_next": F.when(~_t("artifact.streaming"), mark(F.col("_back"))),
    })
    d = running(d, key, ["seq"], values={"_last_open": ("max", F.col("_open")), "_last_mark": ("max", F.col("_fore"))})
    d = running(d, key, ["_back"], values={"_next_mark": ("max", F.col("_next"))})
    odd = lambda c: F.coalesce(F.pmod(F.col(c), F.lit(2)) == 1, F.lit(False))
    chunk, opened = _t("artifact.chunk"), F.col("_last_open").isNotNull()
    counts = d.groupBy("run_id").agg(
        F.count_if(chunk & ~opened).alias("p0"),
        F.count_if(chunk & opened & odd("_last_mark")).alias("p1"),
        F.count_if(_t("artifact.streaming") & odd("_next_mark")).alias("p2"),
    )
    stack = ", ".join(f"'{p}', coalesce(p{i}, 0L)" for i, p in enumerate(ORDER_PARTS))
    return ev.select("run_id").distinct().join(counts, "run_id", "left").selectExpr(
        "run_id", f"stack({len(ORDER_PARTS)}, {stack}) as (part, violations)")


# ------------------------------------------------------------------ E17


def step_progress(ev: DataFrame) -> DataFrame:
    """(run_id, task_id, steps_done, steps_declared, step_progress) for tasks of the
    run's last plan: distinct declared steps seen in task.progress / declared steps;
    undeclared step ids are ignored."""
    lp = _last_plan(ev)
    declared = (
        ev.filter(_t("plan.built")).join(lp, "run_id").filter(F.col("seq") == F.col("_lp"))
        .select("run_id", F.explode("plan_tasks").alias("_p"))
        .select("run_id", F.col("_p.task_id").alias("task_id"), F.explode(F.col("_p.steps")).alias("step_id"))
    )
    n_declared = declared.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("steps_declared"))
    seen = ev.filter(_t("task.progress")).select("run_id", "task_id", "step_id").distinct()
    done = declared.join(seen, ["run_id", "task_id", "step_id"], "left_semi").groupBy("run_id", "task_id").agg(
        F.count(F.lit(1)).alias("steps_done")
    )
    out = n_declared.join(done, ["run_id", "task_id"], "left").select(
        "run_id", "task_id", F.coalesce("steps_done", F.lit(0).cast("bigint")).alias("steps_done"), "steps_declared"
    )
    return out.withColumn(
        "step_progress",
        F.when(F.col("steps_declared") > 0, F.col("steps_done").cast("double") / F.col("steps_declared").cast("double")).otherwise(0.0),
    )
