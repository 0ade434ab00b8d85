"""Structured Streaming over the event log.

E1  replay then follow: a file-source stream over a log folder with a checkpoint; the
    backlog is processed first, new files later, each exactly once (``AvailableNow`` for a
    bounded replay).
E2  exactly-once by position: ``dropDuplicates`` on (run_id, seq), or
    ``dropDuplicatesWithinWatermark`` with an event-time watermark to bound the state.
E4/E5 per-task state with plan resets: a built-in streaming aggregate keyed by
    (run_id, task_id) plus one marker key per run for its latest plan; the reset is applied
    on read. Merged by "greatest seq wins", never by arrival order, so micro-batch
    boundaries, file order and duplicates cannot change the answer (E16 by construction).
E7  run header: a plain streaming aggregate (max_by / bool_or are order-insensitive).
E8  streamed text: a stateless append of artifact events; texts are folded on read.
S8  JSON lines: one object an event, parsed with the log's fixed schema; lines that are no event
    are kept with the reason and counted, and a position delivered twice counts once.
E16 ``replay_then_follow`` stops a stream when it has caught up and resumes it from its checkpoint
    when more files are there.

Sinks are ``foreachBatch`` writes of each micro-batch to ``<out>/batch=<id>`` (overwrite, so a
replayed batch is idempotent); readers of an update-mode sink keep, per key, the row of the
latest batch. No stream runs Python on rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.eventlog import METRICS, status_of
from tallyframe.session import scratch_path
from tallyframe.sources.tables import stored_bytes

# At most so much of a backlog in one micro-batch.
BYTES_PER_TRIGGER = 8 << 30

# The folds keep less than they read, so that a store of a part of the log this large stays small.
LOG_BYTES_PER_STATE = 64 << 20


def write_log(ev: DataFrame, path: str, files: int | None = None) -> str:
    """Materialise a log as a folder, in the files that its own partitioning gives. ``files``
    (for tests of batch boundaries) deals it anew into that many, in arrival order."""
    if files is not None:
        ev = ev.repartitionByRange(files, "ts", "run_id", "seq").sortWithinPartitions("ts", "run_id", "seq")
    ev.write.mode("overwrite").parquet(path)
    return path


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    return reader.load(path)


def dedupe_stream(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """E2 streaming: exactly-once by (run_id, seq), for consumers that must see each event
    once (a log sink, a counter).

    Without ``watermark`` the dedupe is exact and keeps one key per delivered event in the
    state store. With a watermark (e.g. "1 hour") the state is bounded by event time, which
    is only safe when the log is delivered in event-time order: rows older than the
    watermark are treated as late and dropped by Spark. The state folds below do not need
    it: every value they keep is a greatest-seq or max/or merge, which a duplicate cannot
    change, so they keep no per-event state at all."""
    if watermark is None:
        return stream.dropDuplicates(["run_id", "seq"])
    timed = stream.withColumn("_event_time", F.col("ts").cast("timestamp"))
    return timed.withWatermark("_event_time", watermark).dropDuplicatesWithinWatermark(["run_id", "seq"]).drop("_event_time")


def _latest(value: Column) -> Column:
    """Value at the greatest seq among rows where it is not null (duplicate-insensitive)."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def _seq_of(value: Column) -> Column:
    return F.max(F.when(value.isNotNull(), F.col("seq")))


def task_state_stream(stream: DataFrame) -> DataFrame:
    """E4 + E5 streaming as one built-in streaming aggregate keyed by (run_id, task_id).

    A plan.built is exploded to one 'pending' row per planned task (with the plan's owner)
    plus one run-level marker row (task_id null) carrying the plan's seq. Per key the
    state keeps the latest status and owner with their seqs, the latest attempt and
    progress, and, on the marker key, the run's latest plan seq. The plan reset is applied
    when the state is read (``task_state_table``): status and owner count only when they are
    not older than the run's latest plan. Everything is max / max_by, so the result does not
    depend on micro-batch boundaries, file order or duplicates (E16), partial aggregation
    reduces a hot run inside every map task, and the state holds one small row per task."""
    t = F.col("type")
    plan = stream.filter(t == "plan.built").select(
        "run_id", "seq", F.explode(F.concat(
            F.transform("plan_tasks", lambda p: F.struct(p["task_id"].alias("task_id"), p["agent_id"].alias("agent_id"))),
            F.array(F.struct(F.lit(None).cast("string").alias("task_id"), F.lit(None).cast("string").alias("agent_id"))),
        )).alias("_p"),
    ).select(
        "run_id",
        F.col("_p.task_id").alias("task_id"),
        "seq",
        F.when(F.col("_p.task_id").isNotNull(), F.lit("pending")).alias("status"),
        F.col("_p.agent_id").alias("owner"),
        F.lit(None).cast("int").alias("attempt"),
        F.lit(None).cast("double").alias("progress"),
        F.lit(None).cast(METRICS).alias("metrics"),
        F.when(F.col("_p.task_id").isNull(), F.col("seq")).alias("plan_seq"),
    )
    facts = stream.filter(
        t.isin("task.ready", "task.started", "task.retried", "task.failed", "task.completed", "task.progress")
    ).select(
        "run_id",
        "task_id",
        "seq",
        status_of().alias("status"),
        F.when(t.isin("task.started", "task.failed", "task.completed"), F.col("agent_id")).alias("owner"),
        F.when(t == "task.retried", F.col("attempt")).alias("attempt"),
        F.when(t == "task.progress", F.col("pct")).when(t == "task.completed", F.lit(1.0)).alias("progress"),
        F.when(t == "task.completed", F.col("metrics")).alias("metrics"),
        F.lit(None).cast("bigint").alias("plan_seq"),
    )
    rows = plan.unionByName(facts)
    return rows.groupBy("run_id", "task_id").agg(
        _latest(F.col("status")).alias("status"),
        _seq_of(F.col("status")).alias("status_seq"),
        _latest(F.col("owner")).alias("owner"),
        _seq_of(F.col("owner")).alias("owner_seq"),
        _latest(F.col("attempt")).alias("attempts"),
        _latest(F.col("progress")).alias("progress"),
        _latest(F.col("metrics")).alias("metrics"),
        F.max("plan_seq").alias("plan_seq"),
    )


def run_header_stream(stream: DataFrame) -> DataFrame:
    """E7 streaming: a plain aggregate per run (update mode); order- and duplicate-insensitive."""
    t = F.col("type")
    return stream.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"),
        F.bool_or(t == "run.started").alias("started"),
        F.bool_or(t == "run.completed").alias("completed"),
        _latest(F.when(t == "run.failed", F.col("error"))).alias("error"),
        _latest(F.when(t == "run.completed", F.col("duration_ms"))).alias("duration_ms"),
        _latest(F.when(t == "run.started", F.col("title"))).alias("requirement_title"),
        _latest(F.when(t == "run.started", F.col("seed"))).alias("seed"),
        _latest(F.when(t == "run.started", F.col("speed"))).alias("_speed"),
    )


def state_partitions(spark: SparkSession, log_bytes: int) -> int:
    """Partitions of a stream's state for a log of that size. Each costs a store to load and commit and a file
    in every micro-batch, however little it holds, and adaptive execution joins none of them: as many
    as the size needs, one a core at least, and no more than the session's shuffles have."""
    needed = max(spark.sparkContext.defaultParallelism, -(-log_bytes // LOG_BYTES_PER_STATE))
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), needed)


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """The session's number of shuffle partitions while a stream starts, which takes a copy of it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def run_to_table(result: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                 output_mode: str = "update", on_batch: Callable[[str, int], None] | None = None,
                 partitions: int | None = None) -> None:
    """Drive a streaming result into ``out`` (one folder per micro-batch) until the source
    is drained (AvailableNow) - E1's replay; re-running with the same checkpoint follows
    only files that arrived since. A replayed batch overwrites its own folder, so the sink
    is idempotent. ``on_batch("before" | "after", batch_id)`` is called around each write.
    ``partitions``: of a new checkpoint's state (a resumed stream keeps its own)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if on_batch:
            on_batch("before", batch_id)
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if on_batch:
            on_batch("after", batch_id)

    w = result.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    spark = result.sparkSession
    with shuffle_partitions(spark, partitions) if partitions else nullcontext():
        q = w.start()
    q.awaitTermination()


def latest_rows(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """Current table of an update-mode sink: per key, its row from the latest batch that
    updated it. An aggregate (the row at the greatest batch_id), so it combines map-side and
    a key present in many batches is never gathered into one task."""
    df = spark.read.parquet(out)
    rest = [c for c in df.columns if c not in key and c not in ("batch_id", "batch")]  # sink bookkeeping
    best = F.max_by(F.struct(*rest), "batch_id").alias("_b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def task_state_table(spark: SparkSession, out: str) -> DataFrame:
    """E4/E5 final state from the task-state sink: the run's latest plan seq (marker key) is
    joined back to its tasks; status and owner older than it are reset (a planned task has
    its own 'pending' row at that seq, an unplanned one leaves the maps)."""
    cur = latest_rows(spark, out, ["run_id", "task_id"])
    lp = cur.filter(F.col("task_id").isNull()).select("run_id", F.col("plan_seq").alias("_lp"))
    tasks = cur.filter(F.col("task_id").isNotNull()).join(lp, "run_id", "left")

    def fresh(v: str, s: str) -> Column:
        return F.when(F.col("_lp").isNull() | (F.col(s) >= F.col("_lp")), F.col(v))

    return tasks.select(
        "run_id", "task_id",
        fresh("status", "status_seq").alias("status"),
        fresh("owner", "owner_seq").alias("owner"),
        "attempts", "progress", "metrics",
    ).filter(
        F.col("status").isNotNull() | F.col("owner").isNotNull() | F.col("attempts").isNotNull() | F.col("progress").isNotNull()
    )


def stream_task_status(spark: SparkSession, ev: DataFrame, max_files: int | None = None, files: int | None = None) -> DataFrame:
    """Bounded end-to-end run: log -> files -> stream (fold) -> table -> final state."""
    base = scratch_path(spark, "eventstream")
    src = write_log(ev, f"{base}/log", files)
    stream = read_log_stream(spark, src, ev.schema, max_files)
    run_to_table(task_state_stream(stream), f"{base}/out", f"{base}/ckpt")
    return task_state_table(spark, f"{base}/out")


def stream_run_header(spark: SparkSession, ev: DataFrame, max_files: int | None = None, files: int | None = None) -> DataFrame:
    base = scratch_path(spark, "eventstream-header")
    src = write_log(ev, f"{base}/log", files)
    stream = read_log_stream(spark, src, ev.schema, max_files)
    run_to_table(run_header_stream(stream), f"{base}/out", f"{base}/ckpt")
    final = latest_rows(spark, f"{base}/out", ["run_id"])
    return final.select(
        "run_id", "last_seq", "started", "completed", "error", "duration_ms", "requirement_title", "seed",
        F.coalesce(F.col("_speed"), F.lit(1)).alias("speed"),
    )


def stream_event_dedupe(spark: SparkSession, ev: DataFrame, max_files: int | None = None, files: int | None = None) -> DataFrame:
    """E2 end to end: a log with redelivered events -> stream -> each event once."""
    base = scratch_path(spark, "eventstream-dedupe")
    src = write_log(ev, f"{base}/log", files)
    stream = read_log_stream(spark, src, ev.schema, max_files)
    run_to_table(dedupe_stream(stream), f"{base}/out", f"{base}/ckpt", output_mode="append")
    return spark.read.parquet(f"{base}/out").drop("batch_id", "batch")


ARTIFACT_EVENTS = ("artifact.streaming", "artifact.chunk", "artifact.created")


def artifact_event_stream(stream: DataFrame) -> DataFrame:
    """E8 streaming input: the artifact events, projected to what the text fold reads."""
    return stream.filter(F.col("type").isin(*ARTIFACT_EVENTS)).select("run_id", "artifact_id", "seq", "type", "text")


def artifact_text_table(spark: SparkSession, out: str) -> DataFrame:
    """E8 current texts from the artifact-event sink: redelivered events are dropped by
    position (an aggregate keyed by (run_id, seq), so a hot run spreads over its seqs), then
    the batch text fold runs: latest opener per (run, artifact), chunks after it in seq
    order, complete when an artifact.created follows it. The fold does not depend on the
    order in which batches arrived, so any micro-batch split gives the same texts (E16)."""
    from tallyframe.operators.eventlog import stream_text

    events = spark.read.parquet(out).drop("batch_id", "batch").dropDuplicates(["run_id", "seq"])
    return stream_text(events)


def stream_artifact_text(spark: SparkSession, ev: DataFrame, max_files: int | None = None, files: int | None = None) -> DataFrame:
    """E8 end to end. The stream itself keeps no state: each micro-batch appends its artifact
    events to the sink (idempotent per batch id) and the texts are assembled when read. A
    per-key state holding every chunk would be rewritten whole on each update (quadratic in
    the number of batches an artifact spans); here each chunk is written once."""
    base = scratch_path(spark, "eventstream-text")
    src = write_log(ev, f"{base}/log", files)
    stream = read_log_stream(spark, src, ev.schema, max_files)
    run_to_table(artifact_event_stream(stream), f"{base}/out", f"{base}/ckpt", output_mode="append")
    return artifact_text_table(spark, f"{base}/out")


# ------------------------------------------------------------------ S8


def json_line(ev: DataFrame) -> Column:
    """An event as a JSON object, times to the microsecond; null fields are left out."""
    return F.to_json(F.struct(*ev.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    return reader.load(path)


def parsed_events(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The log's columns, ``problem`` and ``line``. A line that is no JSON object of the schema's
    types is "unreadable", one without run_id, seq or type "incomplete"; both keep their text and
    set no column. Fields that the schema does not name are ignored."""
    wanted = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    read = lines.select("value", F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("_e"))
    unread = F.col("_e").isNull() | F.col("_e._broken").isNotNull() | ~F.coalesce(F.trim("value").startswith("{"), F.lit(False))
    missing = F.col("_e.run_id").isNull() | F.col("_e.seq").isNull() | F.col("_e.type").isNull()
    problem = F.when(unread, "unreadable").when(missing, "incomplete")
    told = read.withColumn("problem", problem)
    return told.select(
        *[F.when(F.col("problem").isNull(), F.col(f"_e.{f.name}")).alias(f.name) for f in schema.fields],
        "problem", F.when(F.col("problem").isNotNull(), F.col("value")).alias("line"),
    )


def json_events(spark: SparkSession, out: str) -> DataFrame:
    """The events of a JSON sink, each position once."""
    df = spark.read.parquet(out)
    return df.filter("problem IS NULL").drop("problem", "line", "batch_id", "batch").dropDuplicates(["run_id", "seq"])


def json_broken_lines(spark: SparkSession, out: str) -> DataFrame:
    """(problem, line) of every line that is no event."""
    return spark.read.parquet(out).filter("problem IS NOT NULL").select("problem", "line")


def stream_json_log(spark: SparkSession, lines: DataFrame, schema: T.StructType, max_files: int | None = None) -> str:
    """S8 end to end: lines (value) -> text files -> stream -> sink; returns the sink's folder."""
    base = scratch_path(spark, "eventstream-json")
    lines.select("value").write.text(f"{base}/log")
    run_to_table(parsed_events(read_line_stream(spark, f"{base}/log", max_files), schema), f"{base}/out", f"{base}/ckpt", output_mode="append")
    return f"{base}/out"


# ------------------------------------------------------------------ E1, E16


def replay_then_follow(spark: SparkSession, deliveries: list[DataFrame], max_files: int | None = None, files: int = 4) -> DataFrame:
    """Task state of a log that arrives in ``deliveries``: each is added to the log's folder and the
    stream resumed from its checkpoint until it has caught up."""
    base = scratch_path(spark, "eventstream-follow")
    schema = deliveries[0].schema
    partitions = None
    for part in deliveries:
        part.repartition(files).write.mode("append").parquet(f"{base}/log")
        if partitions is None:  # the state's partitions are fixed with the first delivery; allow for all of them
            partitions = state_partitions(spark, stored_bytes(spark, f"{base}/log") * len(deliveries))
        run_to_table(task_state_stream(read_log_stream(spark, f"{base}/log", schema, max_files)), f"{base}/out", f"{base}/ckpt", partitions=partitions)
    return task_state_table(spark, f"{base}/out")
