"""Mixing sources to target weights by systematic sampling.

Sources get a share of the mix by weight, up to ``most`` times their own size; what is over goes to the
others by weight (``targets``). Of a source every document expects target / size copies. Documents
stand in a line, their expected copies are summed along it, one random offset a source is added,
and a document is emitted once for each whole number that its stretch of the line crosses
(``systematic_copies``). So it gets its expected copies rounded down or up, and any run of the line
gets its own to within one.

The line goes from large documents to small ones: the copies of all documents above any size are
then right to within one, so that a source's words miss their target by less than its
largest document.

Sums are exact: expected copies are counted in units of 2**-40 and added as whole numbers, along
ranges of the line (``ordering.running``), so a source may hold any share of the rows and no task
holds a source. Offsets are digests of seed and source; equal input gives equal output whatever
the partitions.

Defined results: a null text has size 0; documents of size 0 may be drawn and add no words. A null
source is a source, the last. Rows that repeat stand in the line each. Null ids stay null. Other
columns are ignored. An empty table gives an empty result; if all sizes are 0 all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, salted_left_join, with_row
from tallyframe.operators.ordering import running
from tallyframe.session import materialize

#: Fixed value: what parts words.
WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 40


def n_words(text: Column) -> Column:
    """Words of a text as bigint (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def offset(seed: str, key: Column) -> Column:
    """A number from 0 to UNIT - 1 from the first 40 bits of a digest."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), key).cast("binary"), 256), 1, 10), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight and target, from rows (source, size).

    A source takes weight * level words, or ``most`` times its size where that is less, at the level
    where all together give ``share`` of all sizes. Sources fill up in the order of ``most`` * size /
    weight; those that fill below the level are full."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = running(by_source, [], [F.col("source").asc_nulls_last()], row_number="at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    capped = capped.withColumn("full_at", F.col("cap") / F.col("weight"))
    line = running(capped, [], ["full_at", "at"], values={"size_before": ("sum", F.col("source_size")), "weight_before": ("sum", F.col("weight"))}, before=True)
    line = line.fillna(0, ["size_before", "weight_before"])
    total = line.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    line = line.crossJoin(F.broadcast(total))  # one row
    asked = F.lit(float(share)) * F.col("all_size")
    full = F.col("full_at") < (asked - F.lit(float(most)) * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    line = line.withColumn("full", full)
    open_ = line.agg(
        F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))), F.lit(0)).alias("full_size"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open_weight"),
    )
    level = (asked - F.lit(float(most)) * F.col("full_size")) / F.col("open_weight")
    out = line.crossJoin(F.broadcast(open_))
    return out.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)).alias("target"))


def systematic_copies(rows: DataFrame, key: str, expected: Column, order: Sequence, seed: str = "mix", out: str = "copies") -> DataFrame:
    """``rows`` and how often each is emitted: its ``expected`` copies (a double of 0 or more, null: 0)
    rounded down or up. ``key`` is a string column without nulls; ``order`` should be unique."""
    parts = F.floor(F.coalesce(expected, F.lit(0.0)) * F.lit(float(UNIT))).cast("decimal(28,0)")
    line = running(rows.withColumn("__parts", parts), [key], order, values={"__to": ("sum", F.col("__parts"))})
    end = F.col("__to") + offset(seed, F.col(key))
    crossed = F.expr(f"CAST(__end div {UNIT}L AS BIGINT) - CAST((__end - __parts) div {UNIT}L AS BIGINT)")
    return line.withColumn("__end", end).withColumn(out, crossed).drop("__parts", "__to", "__end")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, __row, source, size, source_size, target, copies and taken (copies * size) for every row."""
    read = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))
    sizes = materialize(read, "mix-sizes")  # the texts are read once
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    goal = materialize(targets(sizes, weights, share, most).withColumn("__source", name).drop("source"), "mix-targets")
    joined = salted_left_join(sizes.withColumn("__source", name), goal, "__source", F.col(ROW))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    out = systematic_copies(joined, "__source", copies, [F.desc("size"), F.asc_nulls_first("doc_id"), ROW], seed)
    return out.select("doc_id", ROW, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` (the table that was mixed), each as often as the mix takes it, with
    ``copy`` from 1 on."""
    drawn = mixed.where("copies > 0").select(ROW, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("__copy"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return with_row(docs).join(drawn, ROW).select(*names, F.col("__copy").alias("copy"))
