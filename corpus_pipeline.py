"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as
Parquet and read again before the next. All but the last return the columns of ``documents``; rows
are told apart by their place in the written table, so that repeated or null ids are no trouble.
The one columns changed are ``text`` and ``n_chars``, where a benchmark passage is cut out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, exact_dedup, packing, quality, simhash
from tallyframe.llm.common import ROW, table, with_row
from tallyframe.session import materialize


def _keep(docs: DataFrame, rows_to_drop: DataFrame) -> DataFrame:
    """``docs`` (numbered) without the rows listed."""
    return docs.join(rows_to_drop.select(ROW), ROW, "left_anti").drop(ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    found = quality.classify(spark, docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return _keep(with_row(docs), found.where("predicted = 0"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return _keep(with_row(docs), exact_dedup.exact_dedup(docs).where(~F.col("kept_row")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return _keep(with_row(docs), simhash.near_duplicates(docs, shingle=4, distance=4).where(~F.col("kept")))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are half benchmark or more go."""
    hit = decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"), window=10, coverage=0.5)
    hit = hit.withColumnsRenamed({"text": "__text", "dropped": "__dropped"})
    joined = with_row(docs).join(hit, ROW, "left").where("__dropped IS NULL OR NOT __dropped")
    changed = F.col("__text").isNotNull()
    out = joined.withColumns({"text": F.coalesce("__text", "text"), "n_chars": F.when(changed, F.char_length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer are not SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
