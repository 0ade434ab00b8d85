"""Sources and sinks.

S1 text-typed scan, S2 named dataset lookup, S3 load stats, S4 preview, S5 metrics JSON sink,
S6 dataset artifact. S7 (schema contract) lives with profiling.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TPCH_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class UnknownDataset(FileNotFoundError):
    """A dataset name that is not in the allow-list."""


def source_path(sf_dir: str, name: str, allowed: tuple[str, ...] = TPCH_TABLES) -> str:
    """Resolve a dataset name to a path. Only names in the allow-list resolve, so a
    name can never walk out of the data folder."""
    if name not in allowed or "/" in name or name.startswith("."):
        raise UnknownDataset(f"unknown dataset {name!r}; known: {', '.join(allowed)}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(source_path(sf_dir, name))


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV with every column typed as string; empty field -> null; padding kept.

    Quotes inside a quoted field are doubled, and a quoted field may hold line feeds (so that
    a file is one split: large extracts should come as many files). Columns are found by the
    header's names, in the order of ``columns`` if given. A row with too many or too few
    fields fails the job.
    """
    df = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.select(*columns) if columns is not None else df


def load_stats(frames: Mapping[str, DataFrame]) -> DataFrame:
    """S3: (name, rows, n_columns, columns) per source, as one small table.

    Row counts are plain aggregates, one per source, unioned; nothing reaches the driver."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"),
            F.col("rows"),
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit(",".join(df.columns)).alias("columns"),
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def display_text(c: Column, dtype: T.DataType) -> Column:
    """S4 value rendering: null -> '', floating point -> 2 decimals, else its string."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        rendered = c.try_cast("decimal(38,2)").cast("string")
    else:
        rendered = c.cast("string")
    return F.coalesce(rendered, F.lit(""))


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows by an explicit order, every value rendered as text.

    A limit is the feature here (a preview); Spark plans it as TakeOrderedAndProject, a
    per-partition top-n plus one small merge."""
    cols = [display_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    keys = [F.col(k).asc_nulls_first() for k in order_by]
    ranked = df.orderBy(*keys).limit(n)
    return ranked.select(
        F.row_number().over(_preview_window(order_by)).alias("preview_row"), *cols
    )


def _preview_window(order_by: list[str]):
    from pyspark.sql import Window

    return Window.orderBy(*[F.col(k).asc_nulls_first() for k in order_by])


def metrics_json(surfaces: Mapping[str, DataFrame], order: Mapping[str, list[str]], filters: Column | None = None) -> DataFrame:
    """The metrics bundle as ONE JSON document (one row, one string column), with the filters it
    answers to if given.

    Each surface is already small (grouped output); each is folded to an array of structs, in
    the order of its ``order`` keys (kept inside the array, as a frame's order does not outlive
    an exchange), and the arrays are joined by a cross product of one-row frames. The headline is
    an object, its ``rows`` a field of the document."""
    docs = None
    for name, df in surfaces.items():
        row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
        keyed = df.agg(F.array_sort(F.collect_list(F.struct(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(order.get(name, []))], row))).alias(name))
        one = keyed.select(F.transform(name, lambda x: x["row"]).alias(name))
        docs = one if docs is None else docs.crossJoin(one)
    head = F.element_at("kpis", 1)
    parts = [head.dropFields("rows").alias("kpis"), *[F.col(n) for n in surfaces if n != "kpis"], head["rows"].alias("rows")]
    return docs.select(F.to_json(F.struct(*parts, *([] if filters is None else [filters.alias("filters")])), {"ignoreNullFields": "false"}).alias("metrics_json"))


def observed_write(df: DataFrame, path: str, figures: Mapping[str, Column] | None = None) -> dict:
    """Writes ``df`` as parquet and returns what was seen on the way: ``rows`` and the aggregates in
    ``figures``, taken by the very tasks that write (a retried task counts once), and ``bytes``,
    from the list of files. No second scan."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (figures or {}).items()]).write.mode("overwrite").parquet(path)
    return {**seen.get, "bytes": stored_bytes(df.sparkSession, path)}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of a folder's parquet files, from their listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def preview_record(written: DataFrame, size: int, order_by: list[str], n: int = 20, rows: int | None = None) -> DataFrame:
    """S4 as one record (rows, columns, bytes, sample): the sample as JSON text, a list of rows of
    text. ``written`` is a table of files, so that a count reads footers only."""
    pv = preview(written, order_by, n)
    shown = F.array_sort(F.collect_list(F.struct("preview_row", F.array(*[F.col(f"`{c}`") for c in written.columns]).alias("row"))))
    sample = pv.agg(F.to_json(F.transform(shown, lambda x: x["row"])).alias("sample"))
    counted = written.agg(F.count(F.lit(1)).alias("rows")) if rows is None else written.sparkSession.range(1).select(F.lit(rows).cast("bigint").alias("rows"))
    return counted.crossJoin(sample).select("rows", F.lit(",".join(written.columns)).alias("columns"), F.lit(size).cast("bigint").alias("bytes"), "sample")


def dataset_artifact(df: DataFrame, path: str, order_by: list[str], preview_rows: int = 20) -> DataFrame:
    """Write the frame as parquet and return its manifest row (path, rows, columns, bytes,
    preview as JSON text), rows counted while writing."""
    seen = observed_write(df, path)
    record = preview_record(df.sparkSession.read.parquet(path), seen["bytes"], order_by, preview_rows, rows=seen["rows"])
    return record.select(F.lit(path).alias("path"), "rows", "columns", "bytes", F.col("sample").alias("preview"))
