"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(df: DataFrame) -> DataFrame:
    """Adds ``__row``, a number for each row. It is the same each time for a scan of files
    (split and position in it), which is what every caller passes."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``__row`` alone, so that no further column of
    the input can clash with those that an operator adds."""
    return with_row(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def salt_of(col: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join on ``key`` where one key may hold a large share of ``left``: the left rows of
    a key go to ``salts`` partitions by ``spread``, and each row of ``right`` (one a key) is
    copied that often. ``right`` should hold only the keys that need an answer."""
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt_of(spread, salts)).join(copies, [key, "__salt"], "left").drop("__salt")


def column_lists(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list]:
    """Per Arrow batch, the named columns as arrays."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(n)) for n in names]


def kept_in_process(name: str, version: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, once a Python worker and ``version``: workers are used for many tasks,
    and a table of words that one task has filled serves the next. One version is kept a name."""
    kept = sys.modules.setdefault("_tallyframe_kept", types.ModuleType("_tallyframe_kept")).__dict__
    if kept.get(name, (None, None))[0] != version:
        kept[name] = version, make()
    return kept[name][1]


def utf8_values(array: pa.Array) -> Iterator[bytes]:
    """The strings of an Arrow array as UTF-8 bytes, one at a time; null is empty."""
    for value in array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()):
        yield value.as_py() or b""
