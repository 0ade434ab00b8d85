"""Event log: hand-written runs with hand-worked expectations, streaming vs batch."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import eventlog as EV
from tallyframe.plans.fixtures import event_log
from tallyframe.streaming import eventstream as ES


@pytest.fixture(scope="module")
def schema(spark, sf_small):
    return event_log(spark, sf_small).schema


def run(spark, schema, events, run_id="r1"):
    rows = []
    for seq, e in enumerate(events):
        d = {f.name: None for f in schema.fields}
        d.update(run_id=run_id, seq=seq, at=seq * 10, task_id="t0", agent_id="a0", k=0)
        d.update(e)
        rows.append(d)
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def plan(*tasks):
    return [{"task_id": t, "agent_id": a, "steps": ["s0", "s1", "s2", "s3"]} for t, a in tasks]


PHASE0 = [
    {"type": "run.started", "title": "demo", "seed": 7, "speed": 2},
    {"type": "plan.built", "plan_tasks": plan(("t0", "a0"), ("t1", "a1"))},
    {"type": "agent.spawned", "agent_id": "a0"},
    {"type": "task.ready"},
    {"type": "task.started"},
    {"type": "task.progress", "step_id": "s0", "pct": 0.25},
    {"type": "task.failed", "recoverable": True},
    {"type": "task.retried", "attempt": 2},
    {"type": "artifact.streaming", "artifact_id": "art0"},
    {"type": "artifact.chunk", "artifact_id": "art0", "text": "hello "},
    {"type": "artifact.chunk", "artifact_id": "art0", "text": "world"},
    {"type": "artifact.created", "artifact_id": "art0"},
    {"type": "log.emitted", "level": "warn", "message": "careful"},
    {"type": "task.completed"},
    {"type": "agent.idle"},
    {"type": "run.completed", "duration_ms": 500},
]


def test_phase0_summary(spark, schema):
    ev = run(spark, schema, PHASE0)
    s = EV.run_summary(ev).first().asDict()
    assert s["task_status"] == "t0=completed,t1=pending"
    assert s["task_agent"] == "t0=a0,t1=a1"
    assert s["task_attempts"] == "t0=2"
    assert (s["retry_count"], s["artifact_count"], s["artifact_ids"], s["log_count"]) == (1, 1, "art0", 1)
    assert (s["streaming_ids"], s["streamed_chars"], s["streams_complete"]) == ("art0", 11, "art0")
    assert (s["agents_spawned"], s["agents_idle"], s["plan_task_count"]) == ("a0", "a0", 2)
    assert (s["last_seq"], s["started"], s["completed"], s["duration_ms"], s["seed"], s["speed"]) == (15, True, True, 500, 7, 2)
    v = {r.rule: r.violations for r in EV.contract_violations(ev).collect()}
    assert v == {i: 0 for i in range(1, 8)}
    f = EV.task_fields(ev).filter("task_id = 't0'").first()
    assert (f.progress, f.attempts) == (1.0, 2)


def test_failed_unrecoverable(spark, schema):
    ev = run(spark, schema, [{"type": "task.started"}, {"type": "task.failed", "recoverable": False}, {"type": "run.failed", "error": "boom"}])
    assert EV.task_status(ev).first().status == "failed"
    assert EV.run_header(ev).first().error == "boom"


def test_plan_reset_drops_unplanned_tasks(spark, schema):
    ev = run(spark, schema, [
        {"type": "task.started", "task_id": "t9"},
        {"type": "task.completed", "task_id": "t0"},
        {"type": "plan.built", "plan_tasks": plan(("t0", "a3"))},
        {"type": "task.retried", "task_id": "t9", "attempt": 3},
    ])
    got = {r.task_id: (r.status, r.owner, r.attempts) for r in EV.task_fields(ev).collect()}
    assert got == {"t0": ("pending", "a3", None), "t9": ("running", None, 3)}
    assert {r.task_id: r.status for r in EV.status_as_of(ev, 1).collect()} == {"t9": "running", "t0": "completed"}


def test_orphan_chunks_and_reopen(spark, schema):
    ev = run(spark, schema, [
        {"type": "artifact.chunk", "artifact_id": "x", "text": "lost"},
        {"type": "artifact.streaming", "artifact_id": "x"},
        {"type": "artifact.chunk", "artifact_id": "x", "text": "ab"},
        {"type": "artifact.created", "artifact_id": "x"},
        {"type": "artifact.streaming", "artifact_id": "x"},
        {"type": "artifact.chunk", "artifact_id": "x", "text": "cd"},
    ])
    r = EV.stream_text(ev).first()
    assert (r.text, r.chars, r.complete) == ("cd", 2, False)
    v = {r.rule: r.violations for r in EV.contract_violations(ev).collect()}
    assert v[6] == 1


def test_contract_rules_detect(spark, schema):
    ev = run(spark, schema, [
        {"type": "task.started"},
        {"type": "task.failed", "recoverable": True},
        {"type": "run.completed"},
        {"type": "log.emitted", "at": 0},
    ])
    v = {r.rule: r.violations for r in EV.contract_violations(ev).collect()}
    assert v[2] == 1 and v[3] == 1 and v[4] == 1 and v[7] == 1


def test_run_clock_is_running_max(spark, schema):
    ev = run(spark, schema, [{"type": "log.emitted", "at": a} for a in (5, 3, 9, 1)])
    assert [r.clock for r in EV.run_clock(ev).orderBy("seq").collect()] == [5, 5, 9, 9]


def test_running_matches_windows(spark):
    """Numbers, sums, maxima and minima over ranges equal plain windows: a hot key over every range, null
    keys, ties, rows before and up to."""
    from pyspark.sql import Window

    from tallyframe.operators.ordering import running

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(400).select(
            F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 6 == 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("g"),
            ((F.col("id") * 37) % 101).alias("o"), "id", F.when(F.col("id") % 4 > 0, (F.col("id") * 53) % 89).alias("v"),
        )
        w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
        got = running(df, ["g"], ["o", "id"], "rn", {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))})
        want = df.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"),
                         F.row_number().over(Window.partitionBy("g").orderBy("o", "id")).cast("long").alias("rn"))
        assert Counter(got.collect()) == Counter(want.select(got.columns).collect())
        w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
        got = running(df, ["g"], ["o", "id"], values={"s": ("sum", F.col("v")), "hi": ("max", F.col("v"))}, before=True)
        want = df.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("hi"))
        assert Counter(got.collect()) == Counter(want.collect())
        w = Window.partitionBy("g").orderBy(F.desc("o"))
        got = running(df, ["g"], [F.desc("o")], values={"hi": ("max", F.col("v"))})  # ties share
        assert Counter(got.collect()) == Counter(df.select("*", F.max("v").over(w).alias("hi")).collect())
        assert running(df.where("false"), [], ["o"], "rn").collect() == []
        assert sorted(r.rn for r in running(df, [], ["o", "id"], "rn").collect()) == list(range(1, 401))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_stay_bounded(spark):
    """One key with all rows lies in several ranges, each a part of the rows."""
    from tallyframe.operators import ordering

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        real, ordering.materialize = ordering.materialize, lambda df, name: seen.append(real(df, name)) or seen[-1]
        ordering.running(spark.range(5000).withColumn("g", F.lit(1)), ["g"], ["id"], "rn").collect()
        sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2000
    finally:
        ordering.materialize = real
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blocks_of_a_hot_artifact(spark, schema):
    """One artifact with a third of the log: its text comes in blocks of bounded size, each task sees
    a part of them, and put together they are the text."""
    n = 6000
    ids = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.lit("artifact.chunk").alias("type"),
                                F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 400)).alias("artifact_id"),
                                F.concat(F.col("id"), F.lit(";")).alias("text"))
    openers = ids.groupBy("artifact_id").agg(F.min("seq").alias("seq")).select(F.lit("r").alias("run_id"), (F.col("seq") - 1).alias("seq"), F.lit("artifact.streaming").alias("type"), "artifact_id", F.lit(None).cast("string").alias("text"))
    blocks = EV.stream_blocks(ids.unionByName(openers), 100).filter("artifact_id = 'hot'").orderBy("block").collect()
    want = "".join(f"{i};" for i in range(0, n, 3))
    assert "".join(b.text for b in blocks) == want and len(blocks) == -(-len(want) // 100)
    assert all(b.offset == sum(x.chars for x in blocks[:i]) and b.chars < 110 for i, b in enumerate(blocks))
    assert EV.stream_text(ids.unionByName(openers)).filter("artifact_id = 'hot'").first().text == want


def test_block_edges(spark, schema):
    """Empty chunks, a text of none, a restart, chunks after it only, a chunk longer than a block."""
    ev = run(spark, schema, [
        {"type": "artifact.chunk", "artifact_id": "x", "text": "orphan"},
        {"type": "artifact.streaming", "artifact_id": "x"}, {"type": "artifact.chunk", "artifact_id": "x", "text": "old"},
        {"type": "artifact.streaming", "artifact_id": "x"}, {"type": "artifact.chunk", "artifact_id": "x", "text": ""},
        {"type": "artifact.chunk", "artifact_id": "x", "text": "abcdefgh"}, {"type": "artifact.chunk", "artifact_id": "x", "text": "ij"},
        {"type": "artifact.streaming", "artifact_id": "none"}, {"type": "artifact.created", "artifact_id": "none"},
    ])
    assert [(b.block, b.offset, b.text) for b in EV.stream_blocks(ev, 3).orderBy("block").collect()] == [(0, 0, "abcdefgh"), (2, 8, "ij")]
    assert {r.artifact_id: (r.text, r.chars, r.complete) for r in EV.stream_text(ev).collect()} == {"x": ("abcdefghij", 10, False), "none": ("", 0, True)}


def test_lists_in_rows_match_the_summary(spark, sf_small):
    ev = event_log(spark, sf_small)
    rows = EV.run_lists(ev).collect()
    summary = {r.run_id: r for r in EV.run_summary(ev).collect()}
    for run_id, record in summary.items():
        for name in EV.LISTS:
            mine = sorted((r.position, r.key if r.value is None else f"{r.key}={r.value}") for r in rows if r.run_id == run_id and r.list == name)
            assert ",".join(t for _, t in mine) == record[name] and [p for p, _ in mine] == list(range(1, len(mine) + 1))


def test_spawned_agent_and_metrics(spark, schema):
    record = {"rows_in": 10, "rows_out": 8, "rows_dropped": 2, "columns_added": ["a", "b"], "null_rates": {"z": 0.5, "c": 0.0}, "duration_ms": 7}
    ev = run(spark, schema, [
        {"type": "agent.idle"}, {"type": "agent.spawned", "role": "etl", "assigned_task_ids": ["t1", "t0"]},
        {"type": "task.completed", "metrics": {**record, "rows_in": 1}}, {"type": "task.completed", "metrics": record},
        {"type": "task.completed", "task_id": "t9", "metrics": None}, {"type": "agent.idle", "agent_id": "a7"},
    ])
    agents = {r.agent_id: (r.role, r.assigned_tasks, r.idle) for r in EV.agent_activity(ev).collect()}
    assert agents == {"a0": ("etl", "t1,t0", False), "a7": ("", "", True)}
    tasks = {r.task_id: tuple(r)[1:] for r in EV.task_fields(ev).select("task_id", *EV.metric_columns()).collect()}
    assert tasks == {"t0": (10, 8, 2, "a,b", "c=0.0,z=0.5", 7), "t9": (None,) * 6}


def test_contract_reads_the_log_once(spark, sf_small, tmp_path):
    """The plan that writes the marks scans the log once; the rest reads the marks."""
    from tallyframe.operators import ordering

    event_log(spark, sf_small).write.parquet(str(tmp_path / "log"))
    ev = spark.read.parquet(str(tmp_path / "log"))
    plans = []
    real, ordering.materialize = ordering.materialize, lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name)
    try:
        out = EV.contract_violations(ev)
    finally:
        ordering.materialize = real
    assert len(plans) == 1 and plans[0].count("Relation [") == 1
    assert str(tmp_path / "log") not in out._jdf.queryExecution().optimizedPlan().toString()
    assert set(out.inputFiles()).isdisjoint(ev.inputFiles())


def test_log_tail_limits(spark, schema):
    ev = run(spark, schema, [{"type": "log.emitted", "level": "info", "message": str(i)} for i in range(7)])
    t = EV.log_tail(ev, 3).orderBy("tail_rank").collect()
    assert [r.message for r in t] == ["6", "5", "4"]


def task_rows(fields):
    rows = fields.select("run_id", "task_id", "status", "owner", "attempts", "progress", *EV.metric_columns()).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_stream_equals_batch_any_batch_size(spark, sf_small):
    ev = event_log(spark, sf_small)
    for max_files in (1, None):
        assert task_rows(ES.stream_task_status(spark, ev, max_files=max_files, files=6)) == task_rows(EV.task_fields(ev))


def test_replay_then_follow(spark, sf_small):
    from tallyframe.session import scratch_path

    ev = event_log(spark, sf_small)
    base = scratch_path(spark, "follow")
    ev.filter("seq < 20").write.parquet(f"{base}/log")
    ES.run_to_table(ES.task_state_stream(ES.read_log_stream(spark, f"{base}/log", ev.schema)),
                    f"{base}/out", f"{base}/ckpt")
    ev.filter("seq >= 20").write.mode("append").parquet(f"{base}/log")
    ES.run_to_table(ES.task_state_stream(ES.read_log_stream(spark, f"{base}/log", ev.schema)),
                    f"{base}/out", f"{base}/ckpt")
    assert task_rows(ES.task_state_table(spark, f"{base}/out")) == task_rows(EV.task_fields(ev))
    batches = spark.read.parquet(f"{base}/out").select("batch_id").distinct().count()
    assert batches == 2


def test_stream_state_ignores_redelivered_events(spark, sf_small):
    """The folds keep no per-event dedupe state: a redelivered event cannot change them."""
    ev = event_log(spark, sf_small)
    doubled = ev.unionByName(ev.filter("seq % 10 = 0"))
    streamed = ES.stream_task_status(spark, doubled, max_files=2, files=4)
    assert task_rows(streamed) == task_rows(EV.task_fields(ev))
    header = ES.stream_run_header(spark, doubled, max_files=2, files=4)
    assert sorted(tuple(r) for r in header.collect()) == sorted(tuple(r) for r in EV.run_header(ev).collect())


def test_stream_text_equals_batch_any_split_and_redelivery(spark, sf_small):
    ev = event_log(spark, sf_small)
    want = sorted(tuple(r) for r in EV.stream_text(ev).collect())
    doubled = ev.unionByName(ev.filter("seq % 7 = 0"))
    for log, max_files in ((ev, 1), (doubled, None), (doubled, 2)):
        got = sorted(tuple(r) for r in ES.stream_artifact_text(spark, log, max_files=max_files, files=5).collect())
        assert got == want


def test_latest_rows_keeps_keys_not_updated_in_the_last_batch(spark):
    """An update-mode sink holds only the keys each batch changed: a task last updated in an
    earlier batch than its run's latest must still be read from that earlier batch."""
    from tallyframe.session import scratch_path

    out = scratch_path(spark, "sink")
    b0 = spark.createDataFrame([("r1", "t1", "running", 0), ("r1", "t2", "ready", 0)],
                               "run_id string, task_id string, status string, batch_id long")
    b1 = spark.createDataFrame([("r1", "t2", "completed", 1)], "run_id string, task_id string, status string, batch_id long")
    b0.write.parquet(f"{out}/batch=0")
    b1.write.parquet(f"{out}/batch=1")
    got = sorted(tuple(r) for r in ES.latest_rows(spark, out, ["run_id", "task_id"]).collect())
    assert got == [("r1", "t1", "running"), ("r1", "t2", "completed")]


def test_artifact_order_whole_rule(spark, schema):
    def parts(*names):
        ev = run(spark, schema, [{"type": f"artifact.{n}", "artifact_id": "x"} for n in names])
        return tuple({r.part: r.violations for r in EV.artifact_order_violations(ev).collect()}[p] for p in EV.ORDER_PARTS)

    assert parts("streaming", "chunk", "chunk", "created") == (0, 0, 0)
    assert parts("created") == parts("streaming") == (0, 0, 0)
    assert parts("streaming", "chunk", "created", "chunk") == (0, 1, 0)
    assert parts("streaming", "created") == (0, 0, 1)
    assert parts("chunk", "created", "chunk", "streaming", "created", "chunk") == (2, 1, 1)
    assert parts("streaming", "chunk", "created", "streaming", "chunk", "created") == (0, 0, 0)


def test_restart_after_a_lost_sink(spark, sf_small):
    """The stream dies after a batch is written but before it is committed, and once before it is
    written; resumed from its checkpoint, with more files there, it replays that batch over its own folder."""
    from tallyframe.session import scratch_path

    ev = event_log(spark, sf_small)
    base = scratch_path(spark, "dies")
    read = lambda: ES.read_log_stream(spark, f"{base}/log", ev.schema, 1)
    ev.filter("seq % 2 = 0").repartition(3).write.parquet(f"{base}/log")
    for when in ("after", "before"):
        with pytest.raises(Exception, match="lost"):
            ES.run_to_table(ES.task_state_stream(read()), f"{base}/out", f"{base}/ckpt", on_batch=lambda at, n, when=when: (_ for _ in ()).throw(RuntimeError("lost")) if (at, n) == (when, 1) else None)
    ev.filter("seq % 2 = 1 OR seq % 10 = 0").repartition(2).write.mode("append").parquet(f"{base}/log")
    ES.run_to_table(ES.task_state_stream(read()), f"{base}/out", f"{base}/ckpt")
    assert task_rows(ES.task_state_table(spark, f"{base}/out")) == task_rows(EV.task_fields(ev))
    folders = [r.batch for r in spark.read.parquet(f"{base}/out").select("batch").distinct().orderBy("batch").collect()]
    assert folders == list(range(len(folders))) and len(folders) == 5


def test_json_lines_broken_in_every_way(spark, schema, tmp_path):
    good = ['{"run_id": "r", "seq": 0, "type": "run.started", "at": 5, "title": "t"}', '{"seq": 1, "type": "task.ready", "run_id": "r", "task_id": "t0", "unknown": [1]}']
    bad = ['{"run_id": "r", "seq": 2, "type": "ta', "not json", "[1, 2]", "", '{"run_id": "r", "seq": "two", "type": "task.ready"}']
    incomplete = ['{"run_id": "r", "type": "task.ready"}', '{"seq": 3, "type": "x"}', "{}", '{"run_id": "r", "seq": 4, "type": null}']
    (tmp_path / "a.json").write_text("\n".join(good + bad[:3]))
    (tmp_path / "b.json").write_text("\n".join(bad[3:] + incomplete + good[:1]))
    out = str(tmp_path / "out")
    ES.run_to_table(ES.parsed_events(ES.read_line_stream(spark, str(tmp_path) + "/*.json", 1), schema), out, str(tmp_path / "ckpt"), output_mode="append")
    events = ES.json_events(spark, out).orderBy("seq").collect()
    assert [(r.seq, r.type, r.at, r.title, r.task_id) for r in events] == [(0, "run.started", 5, "t", None), (1, "task.ready", None, None, "t0")]
    kept = ES.json_broken_lines(spark, out).collect()
    assert sorted(r.line for r in kept if r.problem == "unreadable") == sorted(bad)
    assert sorted(r.line for r in kept if r.problem == "incomplete") == sorted(incomplete)


def test_state_partitions_follow_the_log(spark, sf_small, monkeypatch):
    """A small log's state has one partition a core, a large one's as many as the session's shuffles; the
    session's own number is as before."""
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert ES.state_partitions(spark, 1) == cores
        assert ES.state_partitions(spark, 20 * ES.LOG_BYTES_PER_STATE) == 20
        assert ES.state_partitions(spark, 1 << 50) == 40
        ran = []
        monkeypatch.setattr(ES, "run_to_table", (lambda real: lambda *a, **k: (ran.append((a[2], k)), real(*a, **k)))(ES.run_to_table))
        ev = event_log(spark, sf_small)
        got = ES.replay_then_follow(spark, [ev.filter("seq % 2 = 0"), ev.filter("seq % 2 = 1")])
        assert task_rows(got) == task_rows(EV.task_fields(ev))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        folders = [p for p in Path(ran[0][0].removeprefix("file:") + "/state/0").iterdir() if p.name.isdigit()]
        assert len(folders) == cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
