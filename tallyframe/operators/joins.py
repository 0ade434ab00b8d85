"""Joins with measured match rates.

No broadcast hints: the dimension sides (products, customers) grow with the data, so the
choice is left to the planner, which broadcasts only under
``spark.sql.autoBroadcastJoinThreshold`` and, with AQE, re-plans on measured shuffle sizes
(a size-checked broadcast with sort-merge beyond it). AQE's skew-join split covers a hot key
on the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.exprs import count_if


def suffix_collisions(left: DataFrame, right: DataFrame, on: str, suffix: str = "_right") -> DataFrame:
    """Rename right-side columns that collide with left ones (except the key)."""
    clash = set(left.columns) & set(right.columns) - {on}
    return right.select([F.col(c).alias(f"{c}{suffix}" if c in clash else c) for c in right.columns])


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Equi-join on one key name; right's same-named columns get ``_right``; null keys
    never match."""
    return left.join(suffix_collisions(left, right, on), on, how)


def join_stats(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row (left_rows, rows, matched, unmatched, match_rate).

    One left join against the right side pre-aggregated to (key, multiplicity): gives the
    inner-join height (sum of multiplicities), matched and unmatched in one pass. The
    right-side count is a partial aggregate, so duplicate keys cost nothing extra."""
    mult = right.groupBy(on).agg(F.count(F.lit(1)).alias("_mult"))
    j = left.select(on).join(mult, on, "left")
    s = j.agg(
        F.count(F.lit(1)).alias("left_rows"),
        F.coalesce(F.sum("_mult"), F.lit(0)).cast("bigint").alias("rows"),
        count_if(F.col("_mult").isNotNull()).alias("matched"),
        count_if(F.col("_mult").isNull()).alias("unmatched"),
    )
    return s.withColumn(
        "match_rate",
        F.when(F.col("left_rows") > 0, F.col("matched").cast("double") / F.col("left_rows").cast("double")).otherwise(0.0),
    )


def join_stats_many(left: DataFrame, sides: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """J3 for several right sides of one left table in ONE pass over the left:
    ``sides`` = [(relation, right, key)]. Each right side is pre-aggregated to
    (key, multiplicity) and left-joined in turn; one aggregate counts every relation, and
    the wide row is unpivoted to (relation, left_rows, rows, matched, unmatched, match_rate)."""
    keys = sorted({k for _, _, k in sides})
    j = left.select(*keys)
    aggs = [F.count(F.lit(1)).alias("left_rows")]
    for i, (_name, right, key) in enumerate(sides):
        m = f"_m{i}"
        j = j.join(right.groupBy(key).agg(F.count(F.lit(1)).alias(m)), key, "left")
        aggs += [
            F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(f"rows{i}"),
            count_if(F.col(m).isNotNull()).alias(f"matched{i}"),
            count_if(F.col(m).isNull()).alias(f"unmatched{i}"),
        ]
    wide = j.agg(*aggs)
    stack = ", ".join(f"'{name}', rows{i}, matched{i}, unmatched{i}" for i, (name, _, _) in enumerate(sides))
    long = wide.selectExpr("left_rows", f"stack({len(sides)}, {stack}) as (relation, rows, matched, unmatched)")
    return long.select(
        "relation", "left_rows", "rows", "matched", "unmatched",
        F.when(F.col("left_rows") > 0, F.col("matched").cast("double") / F.col("left_rows").cast("double"))
        .otherwise(0.0).alias("match_rate"),
    )


def unmatched_rows(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The left rows with no partner."""
    return left.join(right.select(on), on, "left_anti")


def resolve_conflict(df: DataFrame, column: str, losing: str) -> DataFrame:
    """J4 frame: keep ``column``, drop ``losing`` (absent losing column: unchanged)."""
    return df.drop(losing) if losing in df.columns else df


def conflict_stats(df: DataFrame, column: str, losing: str) -> DataFrame:
    """J4/J6 stats: (column, resolved_to, conflicts, rows, conflict_rate). Null on either
    side is not a conflict."""
    if losing not in df.columns:
        base = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("conflicts", F.lit(0).cast("bigint"))
    else:
        base = df.agg(
            count_if(F.col(column) != F.col(losing)).alias("conflicts"),
            F.count(F.lit(1)).alias("rows"),
        )
    return base.select(
        F.lit(column).alias("column_name"),
        F.lit(column).alias("resolved_to"),
        "conflicts",
        "rows",
        F.when(F.col("rows") > 0, F.col("conflicts").cast("double") / F.col("rows").cast("double"))
        .otherwise(0.0)
        .alias("conflict_rate"),
    )


def attribute_mismatches(child: DataFrame, parent: DataFrame, on: str, attr: str) -> DataFrame:
    """Left join child to parent and count child rows whose ``attr`` differs from the
    parent's (renamed ``<attr>_parent``). One row: (rows, missing_parent, mismatches)."""
    p = parent.select(on, F.col(attr).alias(f"{attr}_parent"))
    j = child.select(on, attr).join(p, on, "left")
    return j.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col(f"{attr}_parent").isNull()).alias("missing_parent"),
        count_if(F.col(attr) != F.col(f"{attr}_parent")).alias("mismatches"),
    )
