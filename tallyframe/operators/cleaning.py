"""Cleaning (C1-C9): parse, dedupe, coerce, fill, drop, each with a count.

Stages return DataFrames; stats come from separate functions that return small DataFrames
built on the same lazy chain (no hidden ``count()`` inside a stage). The only driver action
is C1's strictness check, which must fail at once (a strict parse is otherwise lazy).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import patterns as P
from tallyframe.functions.exprs import (
    count_if,
    full_match,
    guarded_cast,
    parse_multi_format,
    parse_timestamp,
    plain_regex,
    target_type,
    tidy_number_text,
)

ISO_STRICT = "iso-strict"
MULTI_FORMAT = "multi-format-day-first"


@dataclass(frozen=True)
class CleanStrategy:
    timestamp: str = MULTI_FORMAT
    ts_column: str = "order_ts"
    dedupe_on: str | None = "order_id"
    coerce: tuple[tuple[str, str], ...] = (("qty", "int"), ("unit_price", P.WIDE_PRICE_DECIMAL))
    fill_nulls: tuple[tuple[str, float], ...] = (("discount_pct", 0.0),)
    fill_type: str = P.WIDE_RATE_DECIMAL
    fallbacks: tuple[str, ...] = field(default=P.FALLBACK_SPECS)


RETAIL = CleanStrategy()


class StrictParseError(ValueError):
    def __init__(self, column: str, unparseable: int, total: int):
        super().__init__(f"strict parse of {column!r} failed: {unparseable} of {total} values unreadable")
        self.column, self.unparseable, self.total = column, unparseable, total


# ---------------------------------------------------------------- C1 / C2


def strict_failures(df: DataFrame, column: str, spec: str = P.STRICT_SPEC) -> DataFrame:
    """One row (total, unparseable) for a strict parse; the check C1 forces."""
    raw = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(raw.isNotNull() & parse_timestamp(raw, spec).isNull()).alias("unparseable"),
    )


def parse_strict(df: DataFrame, column: str, spec: str = P.STRICT_SPEC) -> DataFrame:
    """One format; any unreadable non-null value fails the job now, with the count."""
    row = strict_failures(df, column, spec).first()
    if row["unparseable"]:
        raise StrictParseError(column, row["unparseable"], row["total"])
    return df.withColumn(column, parse_timestamp(F.col(column), spec))


def parse_multi(df: DataFrame, column: str, fallbacks: tuple[str, ...] = P.FALLBACK_SPECS) -> DataFrame:
    """ISO first, then each fallback; unread values stay null (dropped and counted in C6)."""
    return df.withColumn(column, parse_multi_format(F.col(column), (P.STRICT_SPEC, *fallbacks)))


def parse_timestamps(df: DataFrame, strategy: CleanStrategy) -> DataFrame:
    if strategy.timestamp == ISO_STRICT:
        return parse_strict(df, strategy.ts_column)
    return parse_multi(df, strategy.ts_column, strategy.fallbacks)


# ---------------------------------------------------------------- C3


def dedupe_latest(df: DataFrame, key: str, ts: str, count_col: str | None = None) -> DataFrame:
    """Keep the latest whole row per key.

    Latest = greatest ``ts`` with nulls lowest; ties broken by the remaining columns in
    order, greatest first. Expressed as ``max(struct(ts, other columns...))`` per key: an
    aggregate with a map-side partial, so a key holding a third of the rows is reduced in
    every map task before the shuffle, unlike a window over the key."""
    others = [c for c in df.columns if c not in (key, ts)]
    best = F.max(F.struct(F.col(ts).alias("_ts"), *[F.col(c) for c in others])).alias("_best")
    counted = [F.count(F.lit(1)).alias(count_col)] if count_col else []
    kept = df.groupBy(key).agg(best, *counted)
    extra = [count_col] if count_col else []
    return kept.select(key, F.col("_best._ts").alias(ts), *[F.col(f"_best.{c}").alias(c) for c in others], *extra).select(
        *df.columns, *extra
    )


# ---------------------------------------------------------------- C4 / C5


def coerce_expr(column: str, target: str) -> Column:
    return guarded_cast(tidy_number_text(F.col(column)), target)


def needed_repair(column: str, target: str) -> Column:
    """A value needed repair: the plain cast fails and the tidied cast succeeds."""
    raw = F.col(column)
    return guarded_cast(raw, target).isNull() & coerce_expr(column, target).isNotNull()


def not_held(column: str, target: str, tidied: bool = True) -> Column:
    """A readable number that the target type cannot hold exactly: out of range (then null)
    or with more decimals than the type has (of the first sixteen). ``tidied`` as the column is
    read: coerced ones are."""
    text = tidy_number_text(F.col(column)) if tidied else F.col(column)
    kept = guarded_cast(text, target)
    exact = guarded_cast(text, "decimal(38,16)")
    return F.coalesce(full_match(text, plain_regex(target)) & (kept.isNull() | (kept.cast("decimal(38,16)") != exact)), F.lit(False))


def fill_expr(column: str, value: float, fill_type: str) -> Column:
    """The value read, else the fill. A number that the type cannot hold stays null: it is there,
    so the fill would be wrong (``held_counts`` has it)."""
    return F.when(too_large(column, fill_type), F.lit(None)).otherwise(
        F.coalesce(guarded_cast(F.col(column), fill_type), F.lit(value).cast(target_type(fill_type))))


def too_large(column: str, target: str) -> Column:
    """A plain number out of the target type's range."""
    return F.coalesce(full_match(F.col(column), plain_regex(target)) & guarded_cast(F.col(column), target).isNull(), F.lit(False))


# ---------------------------------------------------------------- C7 pipeline


ROWS_PER_KEY = "_rows_in_key"


def deduped(df: DataFrame, strategy: CleanStrategy = RETAIL, with_counts: bool = False) -> DataFrame:
    """The C1/C2 + C3 stage: parsed and deduplicated, nothing coerced or dropped yet. The
    C4/C5 counts and the C6 failures are measured on this stage. ``with_counts`` keeps the
    number of input rows per key (``_rows_in_key``) so the input row count needs no second
    pass over the raw extract."""
    parsed = parse_timestamps(df, strategy)
    if strategy.dedupe_on is None:
        return parsed.withColumn(ROWS_PER_KEY, F.lit(1).cast("bigint")) if with_counts else parsed
    return dedupe_latest(parsed, strategy.dedupe_on, strategy.ts_column, ROWS_PER_KEY if with_counts else None)


def _deduped(df: DataFrame, strategy: CleanStrategy, stage: DataFrame | None = None) -> DataFrame:
    return stage if stage is not None else deduped(df, strategy)


def finish(stage: DataFrame, strategy: CleanStrategy = RETAIL) -> DataFrame:
    """C4 -> C5 -> C6 on a deduplicated stage."""
    out = stage.drop(ROWS_PER_KEY) if ROWS_PER_KEY in stage.columns else stage
    return out.withColumns(finished_columns(strategy)).filter(F.col(strategy.ts_column).isNotNull())


def finished_columns(strategy: CleanStrategy = RETAIL) -> dict[str, Column]:
    """The columns that C4 and C5 replace, as expressions over the deduplicated stage."""
    return {c: coerce_expr(c, t) for c, t in strategy.coerce} | {c: fill_expr(c, v, strategy.fill_type) for c, v in strategy.fill_nulls}


def clean(df: DataFrame, strategy: CleanStrategy = RETAIL) -> DataFrame:
    """Parse -> dedupe -> coerce -> fill -> drop rows with no readable timestamp."""
    return finish(deduped(df, strategy), strategy)


def latest_per_key(df: DataFrame, strategy: CleanStrategy = RETAIL) -> DataFrame:
    """What the row counts need of the deduplicated stage, without its rows: per key the greatest
    readable timestamp and the number of input rows. Two numbers a key, so the aggregate hashes, and
    the extract is read for its key and its timestamp alone."""
    parsed = parse_timestamps(df, strategy)
    if strategy.dedupe_on is None:
        return parsed.select(strategy.ts_column, F.lit(1).cast("bigint").alias(ROWS_PER_KEY))
    return parsed.groupBy(strategy.dedupe_on).agg(
        F.max(strategy.ts_column).alias(strategy.ts_column), F.count(F.lit(1)).alias(ROWS_PER_KEY))


def clean_stats(df: DataFrame, strategy: CleanStrategy = RETAIL, stage: DataFrame | None = None) -> DataFrame:
    """C7/C9 stats, one row: rows_in, rows_after_dedupe, duplicates_removed, failures,
    rows_out, rows_dropped, resolved, drop_rate. ``stage``: a deduplicated stage with its rows per
    key, if there is one; otherwise ``latest_per_key``."""
    stage = stage if stage is not None else latest_per_key(df, strategy)
    after = stage.agg(
        F.count(F.lit(1)).alias("rows_after_dedupe"),
        count_if(F.col(strategy.ts_column).isNull()).alias("failures"),
        *([F.coalesce(F.sum(ROWS_PER_KEY), F.lit(0)).cast("bigint").alias("_rows_in")] if ROWS_PER_KEY in stage.columns else []),
    )
    if ROWS_PER_KEY in stage.columns:
        s = after.withColumnRenamed("_rows_in", "rows_in")
    else:
        s = df.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(after)
    return s.select(
        "rows_in",
        "rows_after_dedupe",
        (F.col("rows_in") - F.col("rows_after_dedupe")).alias("duplicates_removed"),
        "failures",
        (F.col("rows_after_dedupe") - F.col("failures")).alias("rows_out"),
        (F.col("rows_in") - F.col("rows_after_dedupe") + F.col("failures")).alias("rows_dropped"),
        (F.col("rows_in") - F.col("failures")).alias("resolved"),
        F.when(F.col("rows_in") > 0,
               (F.col("rows_in") - F.col("rows_after_dedupe") + F.col("failures")).cast("double")
               / F.col("rows_in").cast("double") * 100.0).otherwise(0.0).alias("drop_pct"),
    )


def coerce_counts(df: DataFrame, strategy: CleanStrategy = RETAIL, stage: DataFrame | None = None) -> DataFrame:
    """C4: (column, target, needed, not_held) over rows after dedupe and before the drop."""
    stage = _deduped(df, strategy, stage)
    aggs = [count_if(needed_repair(c, t)).alias(f"n{i}") for i, (c, t) in enumerate(strategy.coerce)]
    aggs += [count_if(not_held(c, t)).alias(f"h{i}") for i, (c, t) in enumerate(strategy.coerce)]
    wide = stage.agg(*aggs)
    stack = ", ".join(f"'{c}', '{target_type(t)}', n{i}, h{i}" for i, (c, t) in enumerate(strategy.coerce))
    return wide.selectExpr(f"stack({len(strategy.coerce)}, {stack}) as (column_name, target, needed, not_held)")


def held_counts(df: DataFrame, products: DataFrame, strategy: CleanStrategy = RETAIL,
                stage: DataFrame | None = None, cost_price: str = "cost_price") -> DataFrame:
    """(column_name, target, not_held) of every number that money is made of, against the type
    it finally gets: the coerced and the filled columns after dedupe, and the products' cost."""
    stage = _deduped(df, strategy, stage)

    def counted(frame: DataFrame, held: list[tuple[str, Column, str]]) -> DataFrame:
        wide = frame.agg(*[count_if(c).alias(f"h{i}") for i, (_n, c, _t) in enumerate(held)])
        stack = ", ".join(f"'{n}', '{target_type(t)}', h{i}" for i, (n, _c, t) in enumerate(held))
        return wide.selectExpr(f"stack({len(held)}, {stack}) as (column_name, target, not_held)")

    orders = [(c, not_held(c, t), t) for c, t in strategy.coerce]
    orders += [(c, not_held(c, strategy.fill_type, tidied=False), strategy.fill_type) for c, _v in strategy.fill_nulls]
    cost = [(cost_price, not_held(cost_price, P.WIDE_PRICE_DECIMAL, tidied=False), P.WIDE_PRICE_DECIMAL)]
    return counted(stage, orders).unionByName(counted(products, cost))


def null_rates(df: DataFrame, strategy: CleanStrategy = RETAIL, stage: DataFrame | None = None) -> DataFrame:
    """(column, nulls, rows, null_rate, unparseable_filled, fill_value) before the fill.

    ``unparseable_filled`` counts non-null text that no cast reads and that the fill also
    replaces; the rate covers true nulls only."""
    stage = _deduped(df, strategy, stage)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, _v) in enumerate(strategy.fill_nulls):
        aggs.append(count_if(F.col(c).isNull()).alias(f"z{i}"))
        unread = F.col(c).isNotNull() & guarded_cast(F.col(c), strategy.fill_type).isNull()
        aggs.append(count_if(unread & ~too_large(c, strategy.fill_type)).alias(f"u{i}"))
    wide = stage.agg(*aggs)
    stack = ", ".join(f"'{c}', z{i}, u{i}, cast({v!r} as double)" for i, (c, v) in enumerate(strategy.fill_nulls))
    long = wide.selectExpr("rows", f"stack({len(strategy.fill_nulls)}, {stack}) as (column_name, nulls, unparseable_filled, fill_value)")
    return long.select(
        "column_name",
        "nulls",
        "rows",
        F.when(F.col("rows") > 0, F.col("nulls").cast("double") / F.col("rows").cast("double")).otherwise(0.0).alias("null_rate"),
        "unparseable_filled",
        "fill_value",
    )


def choose_strategy(df: DataFrame, column: str = "order_ts") -> DataFrame:
    """Decide in one pass. Strict when the strict parse reads every non-null value,
    otherwise the multi-format strategy (inputs are immutable, so there is nothing to roll
    back). Columns: strategy, unparseable, total."""
    s = strict_failures(df, column)
    return s.select(
        F.when(F.col("unparseable") == 0, F.lit(ISO_STRICT)).otherwise(F.lit(MULTI_FORMAT)).alias("strategy"),
        "unparseable",
        "total",
    )


def clean_adaptive(df: DataFrame, strategy: CleanStrategy = RETAIL) -> DataFrame:
    """C8 as a pipeline: try the strict strategy; on failure switch to multi-format and
    clean the untouched input (at most one retry is ever needed)."""
    try:
        return clean(df, CleanStrategy(**{**strategy.__dict__, "timestamp": ISO_STRICT}))
    except StrictParseError:
        return clean(df, CleanStrategy(**{**strategy.__dict__, "timestamp": MULTI_FORMAT}))
