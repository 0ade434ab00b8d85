"""Exact dedup: skew-safe combining in three steps, native DataFrame code only.

1. Inside each input task equal texts meet in the partial aggregate (the local step), keyed by
   digest, salt and the whole normalised text.
2. The shuffle of that aggregate merges each (digest, salt, text); a digest that holds a third of
   all rows is spread over ``salts`` partitions.
3. The winners of the salts (one row a text and salt) are combined by (digest, text).

Each step compares the full normalised text, not the digest alone. The decisions go back to the
rows by digest; two different texts of one digest would make that ambiguous, so they raise.

Defined results: a null text counts as empty and empty texts are equal to each other. Null
``doc_id`` sorts after every other. Rows that repeat (same id, same text) are a group like any
other and one of them is ``kept_row``; ``kept`` compares ids, as its contract says, and is thus
true for each repeat of the id that stays. Other columns of the input are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, identified, salt_of, salted_left_join, sha256_hex

#: The characters that the comparison ignores, [\x20\x09-\x0D].
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), IGNORED, text)


def groups_of(rows: DataFrame, salts: int) -> DataFrame:
    """digest, keep (id and row that stay) and group_size: one row a text."""
    best = F.struct(
        F.char_length("text").alias("chars"),
        F.bitwise_not(F.col("doc_id").cast("long")).alias("not_id"),  # greater for a smaller id; null loses
        F.bitwise_not(ROW).alias("not_row"),
    )
    salted = (
        rows.select("digest", "norm", best.alias("best"), salt_of(F.col(ROW), salts).alias("salt"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("best").alias("best"), F.count("*").alias("n"))
    )
    texts = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return (
        texts.groupBy("digest")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .select(
            "digest",
            F.bitwise_not("best.not_id").alias("keep_id"),
            F.bitwise_not("best.not_row").alias("keep_row"),
            F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("long")).alias("group_size"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, __row, keep_id, group_size, kept, kept_row and text_sha256 for every row of ``docs``."""
    rows = identified(docs, id_col, text_col).withColumn("norm", normalised(F.col("text"))).withColumn("digest", sha256_hex(F.col("norm")))
    repeated = groups_of(rows, salts).where(F.col("group_size") > 1)
    out = salted_left_join(rows.select("doc_id", ROW, "digest"), repeated, "digest", F.col(ROW), salts)
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        ROW,
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        (alone | (F.col(ROW) == F.col("keep_row"))).alias("kept_row"),
        F.col("digest").alias("text_sha256"),
    )
