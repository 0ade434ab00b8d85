"""Order-dependent helpers that stay skew-safe.

A window partitioned by one key puts every row of that key in one task. When one run, user
or group may hold a third of all rows, that task is the whole job. ``running`` deals the rows
by ranges of (keys, order) instead, so that a hot key lies in as many ranges as it needs, does
the windowed work per (range, key), and carries what crosses a boundary (a count, a sum, a
maximum) through a table of one row per range and key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize

_MERGE = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def _named(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    row_number: str | None = None,
    values: Mapping[str, tuple] | None = None,
    before: bool = False,
) -> DataFrame:
    """``df`` with running figures over (partition by ``keys`` order by ``order``).

    ``row_number`` names a 1-based number; ``values`` maps a new column to ("sum" | "max" | "min",
    expression), taken up to and with the row, or without it if ``before`` (or a third element
    True for one of them). Rows that tie in ``order`` share one "max" and "min"; for numbers, sums
    and figures before a row ``order`` should be unique. Null keys are keys. ``sum`` before the
    first row, and "max" of nothing, are null.

    The rows are range-partitioned by keys and order and written once (equal rows are never
    parted), so a window holds at most one range of one key, whatever the key holds; the table
    of carried figures has at most (keys + ranges) rows."""
    given = [(name, kind, expr, (rest or [before])[0]) for name, (kind, expr, *rest) in dict(values or {}).items()]
    if row_number:
        given.append((row_number, "sum", F.lit(1).cast("bigint"), False))
    by, names = _named(order), [g[0] for g in given]
    dealt = df.withColumns({f"_v{i}": expr for i, (_, _, expr, _) in enumerate(given)}).repartitionByRange(*[F.col(k) for k in keys], *by)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    group = ["_part", *keys]
    totals = dealt.groupBy(*group).agg(*[_MERGE[kind][0](f"_v{i}").alias(f"_t{i}") for i, (_, kind, _, _) in enumerate(given)])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[_MERGE[kind][0](f"_t{i}").over(earlier).alias(f"_c{i}") for i, (_, kind, _, _) in enumerate(given)],
    )
    local = Window.partitionBy(*group).orderBy(*by)
    start, here = Window.unboundedPreceding, Window.currentRow
    within = {}
    for i, (_, kind, _, strict) in enumerate(given):
        frame = local.rowsBetween(start, -1) if strict else local.rowsBetween(start, here) if kind == "sum" else local.rangeBetween(start, here)
        within[f"_l{i}"] = _MERGE[kind][0](f"_v{i}").over(frame)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    out = dealt.withColumns(within).join(carried, same)
    figures = [F.coalesce(_MERGE[kind][1](F.col(f"_l{i}"), F.col(f"_c{i}")), F.col(f"_l{i}"), F.col(f"_c{i}")).alias(name) for i, (name, kind, _, _) in enumerate(given)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *figures)
