"""Profiling and diagnosis.

One unpivot turns a wide frame into (column_name, value) pairs. Nulls, timestamp shapes and type
reading are conditional counts over them (``column_figures``): a task sends one row a column and no
value is shuffled. Exact distinct counts and first-seen samples need the values: one grouped
aggregate with a map-side partial gives the value-frequency table (column_name, value, n,
first_key), where a hot value costs one row per map task, and a full profile reads everything from
it, so the frame is scanned once. ``distinct_sketches`` are the way without values: stored per
part of a table, merged when asked, with a stated error.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import patterns as P
from tallyframe.functions.exprs import count_if, full_match, parse_timestamp


#: A shape has a fixed width, so that most text needs no regex.
_WIDTHS = {shape.spec: len(datetime(2000, 1, 1).strftime(shape.duck_format)) for shape in P.TIMESTAMP_SHAPES}


def shape_of(value: Column) -> Column:
    """The first timestamp shape a text value matches, or null."""
    out = F.lit(None).cast("string")
    for shape in reversed(P.TIMESTAMP_SHAPES):
        hit = (F.length(value) == _WIDTHS[shape.spec]) & full_match(value, shape.regex)
        out = F.when(hit, F.lit(shape.spec)).otherwise(out)
    return out


def _long(df: DataFrame, columns: list[str] | None, *keys: Column) -> DataFrame:
    columns = columns or df.columns
    base = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return base.unpivot([c for c in base.columns if c not in columns], columns, "column_name", "value")


def column_figures(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P1, P3, P4, P14 in one pass without a shuffle of values: (column_name, rows, nulls, values,
    ints, nums, shape_0..), the last the values whose first matching shape is that one."""
    v = F.col("value")
    numeric = _long(df, columns).withColumn("_spec", shape_of(v)).withColumn("_int", full_match(v, P.INT_LIKE))
    return numeric.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(v.isNull()).alias("nulls"),
        F.count(v).alias("values"),
        count_if(F.col("_int")).alias("ints"),
        count_if(F.col("_int") | full_match(v, P.DECIMAL_LIKE)).alias("nums"),
        *[count_if(F.col("_spec") == shape.spec).alias(f"shape_{i}") for i, shape in enumerate(P.TIMESTAMP_SHAPES)],
    )


def _shapes() -> list[tuple[str, Column]]:
    return [(shape.spec, F.col(f"shape_{i}")) for i, shape in enumerate(P.TIMESTAMP_SHAPES)]


def _type_of(values: Column, shaped: Column, ints: Column, nums: Column, schema: T.StructType | None) -> Column:
    """P4 from counts of non-null values, of those with a timestamp shape, and of number-like ones."""
    inferred = F.when(values == 0, "empty").when(shaped > 0, "datetime").when(ints == values, "int").when(nums == values, "float").otherwise("str")
    for f in schema.fields if schema is not None else ():
        if not isinstance(f.dataType, T.StringType):
            inferred = F.when(F.col("column_name") == f.name, F.lit(f.dataType.simpleString())).otherwise(inferred)
    return inferred


def value_frequencies(df: DataFrame, columns: list[str] | None = None, order_key: str | None = None) -> DataFrame:
    """(column_name, value, n, first_key): one row per distinct (column, value), null included.

    ``order_key`` (a column of ``df``) defines "first seen" for samples; without one the
    value itself is used."""
    columns = columns or [c for c in df.columns if c != order_key]
    key = F.col(order_key) if order_key else F.lit(None).cast("long")
    return _long(df, columns, key.alias("_key")).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("_key").alias("first_key")
    )


def column_profile(freq: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """P6 without samples: (column_name, rows, nulls, distinct, inferred_type, n_formats, shape_0..)
    from the value-frequency table, regexes once per distinct value."""
    v, n = F.col("value"), F.col("n")
    keyed = freq.withColumn("_spec", shape_of(v)).withColumn("_int", full_match(v, P.INT_LIKE))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    per = keyed.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("rows"),
        total(v.isNull()).alias("nulls"),
        F.count(F.lit(1)).alias("distinct"),
        total(v.isNotNull()).alias("_values"),
        total(F.col("_int")).alias("_ints"),
        total(F.col("_int") | full_match(v, P.DECIMAL_LIKE)).alias("_nums"),
        *[total(F.col("_spec") == shape.spec).alias(f"shape_{i}") for i, shape in enumerate(P.TIMESTAMP_SHAPES)],
    )
    shaped = sum((c for _, c in _shapes()), F.lit(0))
    n_formats = sum(((c > 0).cast("bigint") for _, c in _shapes()), F.lit(0).cast("bigint"))
    inferred = _type_of(F.col("_values"), shaped, F.col("_ints"), F.col("_nums"), schema)
    return per.select("column_name", "rows", "nulls", "distinct", inferred.alias("inferred_type"), n_formats.alias("n_formats"),
                      *[f"shape_{i}" for i in range(len(P.TIMESTAMP_SHAPES))])


def profile(df: DataFrame, order_key: str | None = None, k: int = P.SAMPLE_SIZE, schema: T.StructType | None = None) -> DataFrame:
    """P6, one record a column: (column_name, rows, nulls, distinct, inferred_type, formats, samples);
    formats (spec, n) in the order of the shapes, samples the first ``k`` distinct values."""
    freq = value_frequencies(df, order_key=order_key)
    found = F.filter(F.array(*[F.when(c > 0, F.struct(F.lit(spec).alias("spec"), c.alias("n"))) for spec, c in _shapes()]), lambda x: x.isNotNull())
    shown = samples(freq, k).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("sample_rank", "value"))).alias("_s"))  # k a column
    return column_profile(freq, schema).join(shown, "column_name", "left").select(
        "column_name", "rows", "nulls", "distinct", "inferred_type", found.alias("formats"),
        F.coalesce(F.transform("_s", lambda x: x["value"]), F.array().cast("array<string>")).alias("samples"),
    )


def null_counts(figures: DataFrame) -> DataFrame:
    """(column_name, rows, nulls)."""
    return figures.select("column_name", "rows", "nulls")


def nulls_distinct(freq: DataFrame) -> DataFrame:
    """P1 + P2: (column_name, rows, nulls, distinct). Distinct counts null as one value."""
    return freq.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"),
        F.count(F.lit(1)).alias("distinct"),
    )


def formats(figures: DataFrame) -> DataFrame:
    """(column_name, spec, n) - non-null values counted once, against the first shape
    they match; shapes with no hit are absent."""
    hits = F.array(*[F.struct(F.lit(spec).alias("spec"), c.alias("n")) for spec, c in _shapes()])
    return figures.select("column_name", F.explode(hits).alias("_h")).select("column_name", "_h.*").filter("n > 0")


def inferred_types(figures: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """(column_name, inferred_type) in {empty, datetime, int, float, str}; columns that
    were not text in ``schema`` report their own type name."""
    shaped = sum((c for _, c in _shapes()), F.lit(0))
    return figures.select("column_name", _type_of(F.col("values"), shaped, F.col("ints"), F.col("nums"), schema).alias("inferred_type"))


# ------------------------------------------------------------------ P2 by sketches

#: The relative standard error of a merged sketch of 2**k registers is 1.04 / 2**(k / 2).
SKETCH_K = 14


def sketch_error(k: int = SKETCH_K, sigmas: float = 3.0) -> float:
    return sigmas * 1.04 / 2 ** (k / 2)


def distinct_sketches(df: DataFrame, part: Column, columns: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """P2 in mergeable form: (part, column_name, rows, nulls, sketch) a part of the table (a day, a file).
    A sketch has at most 2**k bytes or so, whatever the column holds; those of new parts are added
    to the stored ones, and no old part is read again."""
    return _long(df, columns or df.columns, part.cast("string").alias("_part")).groupBy(F.col("_part").alias("part"), "column_name").agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("value").isNull()).alias("nulls"), F.hll_sketch_agg("value", F.lit(k)).alias("sketch")
    )


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, distinct_estimate) over all parts; null counts as one value."""
    g = sketches.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("_values"),
    )
    return g.select("column_name", "rows", "nulls", (F.coalesce("_values", F.lit(0)) + (F.col("nulls") > 0).cast("bigint")).alias("distinct_estimate"))


def samples(freq: DataFrame, k: int = P.SAMPLE_SIZE) -> DataFrame:
    """P5: (column_name, sample_rank, value): first k distinct non-null values in key order.

    ``row_number() <= k`` lets Spark insert a partial per-partition group limit before the
    shuffle, so a column with billions of distinct values ships k rows per map task."""
    w = Window.partitionBy("column_name").orderBy(F.col("first_key").asc_nulls_last(), F.col("value"))
    ranked = freq.filter(F.col("value").isNotNull()).withColumn("sample_rank", F.row_number().over(w))
    return ranked.filter(F.col("sample_rank") <= k).select("column_name", "sample_rank", "value")


def mixed_formats(figures: DataFrame) -> DataFrame:
    """Columns carrying timestamp shapes: (column_name, n_formats, formats) with the
    specs sorted and joined by ' | '."""
    held = F.filter(F.array(*[F.when(c > 0, F.lit(spec)) for spec, c in _shapes()]), lambda x: x.isNotNull())
    return figures.select("column_name", F.array_sort(held).alias("_f")).filter(F.size("_f") > 0).select(
        "column_name", F.size("_f").cast("bigint").alias("n_formats"), F.array_join("_f", " | ").alias("formats"))


def worst_null_column(df: DataFrame) -> DataFrame:
    """The column with the most nulls (first in column order on ties), with its rate."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', {i}, _n{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_rows", f"stack({len(cols)}, {stack}) as (column_name, ordinal, nulls)")
    return (
        long.filter(F.col("nulls") > 0)
        .orderBy(F.col("nulls").desc(), F.col("ordinal").asc())
        .limit(1)
        .select(
            "column_name",
            F.col("nulls").cast("bigint").alias("nulls"),
            (F.col("nulls").cast("double") / F.col("_rows").cast("double")).alias("null_rate"),
        )
    )


def grain_check(df: DataFrame, key: str) -> DataFrame:
    """(key_column, rows, distinct_keys, repeats, grain_confirmed).

    Distinct keys come from a grouped count (partial aggregate), not count(distinct)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    s = per_key.agg(F.sum("_n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))
    return s.select(
        F.lit(key).alias("key_column"),
        F.coalesce(F.col("rows"), F.lit(0).cast("bigint")).alias("rows"),
        "distinct_keys",
        (F.coalesce(F.col("rows"), F.lit(0).cast("bigint")) - F.col("distinct_keys")).alias("repeats"),
        ((F.coalesce(F.col("rows"), F.lit(0).cast("bigint")) - F.col("distinct_keys")) == 0).alias("grain_confirmed"),
    )


def probe_format(df: DataFrame, column: str, spec: str = P.STRICT_SPEC, order_key: str | None = None,
                 k: int = P.SAMPLE_SIZE) -> DataFrame:
    """P7 + P9 + P10: one row (column_name, spec, total, parsed, unparseable, failure_rate,
    day_first_evidence, sample_1..k). Samples are the first distinct failing values."""
    raw = F.col(column)
    parsed = parse_timestamp(raw, spec)
    failing = raw.isNotNull() & parsed.isNull()
    lead = F.regexp_extract(raw, r"^([0-9]{1,2})[/-]", 1).try_cast("int")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(parsed.isNotNull()).alias("parsed"),
        count_if(failing).alias("unparseable"),
        count_if(failing & (lead > 12)).alias("day_first_evidence"),
    )
    fails = df.filter(failing).select((F.col(order_key) if order_key else F.lit(None).cast("long")).alias("k"), raw.alias("v"))
    first = fails.groupBy("v").agg(F.min("k").alias("k"))
    order = [F.col("k").asc_nulls_last(), F.col("v")]
    top = first.orderBy(*order).limit(k).withColumn("r", F.row_number().over(Window.orderBy(*order)))
    wide = top.agg(*[F.max(F.when(F.col("r") == i, F.col("v"))).alias(f"sample_{i}") for i in range(1, k + 1)])
    return counts.crossJoin(wide).select(
        F.lit(column).alias("column_name"),
        F.lit(spec).alias("spec"),
        "total",
        "parsed",
        "unparseable",
        F.when(F.col("total") > 0, F.col("unparseable").cast("double") / F.col("total").cast("double"))
        .otherwise(0.0)
        .alias("failure_rate"),
        "day_first_evidence",
        *[f"sample_{i}" for i in range(1, k + 1)],
    )


def probe_alternates(df: DataFrame, column: str, spec: str = P.STRICT_SPEC) -> DataFrame:
    """(spec, ordinal, reads) - for each other candidate, how many failing values it
    reads; counted independently; zero omitted."""
    raw = F.col(column)
    failing = df.filter(raw.isNotNull() & parse_timestamp(raw, spec).isNull())
    others = [(i, s) for i, s in enumerate(P.TIMESTAMP_SHAPES) if s.spec != spec]
    wide = failing.agg(*[count_if(parse_timestamp(raw, s.spec).isNotNull()).alias(f"a{i}") for i, s in others])
    stack = ", ".join(f"'{s.spec}', {i}, a{i}" for i, s in others)
    long = wide.selectExpr(f"stack({len(others)}, {stack}) as (spec, ordinal, reads)")
    return long.filter(F.col("reads") > 0).select("spec", F.col("ordinal").cast("int").alias("ordinal"), "reads")


def format_verdict(df: DataFrame, column: str, spec: str = P.STRICT_SPEC) -> DataFrame:
    """One row (verdict, alternate, reads, day_first_evidence) where verdict is
    no_alternate / ambiguous (an alternate reads them but nothing proves day-first) /
    day_first (some failing value leads with a number above 12).

    One aggregate over the input gives the day-first evidence (P9) and every alternate's
    read count (P8); the first alternate (by ordinal) that reads anything is picked from
    that one row."""
    raw = F.col(column)
    failing = raw.isNotNull() & parse_timestamp(raw, spec).isNull()
    lead = F.regexp_extract(raw, r"^([0-9]{1,2})[/-]", 1).try_cast("int")
    others = [(i, s) for i, s in enumerate(P.TIMESTAMP_SHAPES) if s.spec != spec]
    wide = df.agg(
        count_if(failing & (lead > 12)).alias("day_first_evidence"),
        *[count_if(failing & parse_timestamp(raw, s.spec).isNotNull()).alias(f"_a{i}") for i, s in others],
    )
    alternate = F.coalesce(*[F.when(F.col(f"_a{i}") > 0, F.lit(s.spec)) for i, s in others], F.lit(None).cast("string"))
    reads = F.coalesce(*[F.when(F.col(f"_a{i}") > 0, F.col(f"_a{i}")) for i, _ in others], F.lit(None).cast("bigint"))
    return wide.select(
        F.when(alternate.isNull(), "no_alternate")
        .when(F.col("day_first_evidence") == 0, "ambiguous")
        .otherwise("day_first")
        .alias("verdict"),
        alternate.alias("alternate"),
        reads.alias("reads"),
        "day_first_evidence",
    )


def fk_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """Child rows whose key has no parent (left anti join), as one row."""
    orphans = child.select(F.col(child_key).alias("_k")).join(
        parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti"
    )
    return orphans.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(relation).alias("relation"), "orphans")


def schema_contract(sources: dict[str, DataFrame], detail: str, order_key: str | None = None) -> DataFrame:
    """Per source one row (source, column_name=null, rows, n_columns); per column of
    ``detail`` one row with nulls, distinct, reads_as, n_formats. The detailed source is read once:
    its row count is that of its columns."""
    from tallyframe.sources.tables import load_stats

    df = sources[detail]
    columns = [c for c in df.columns if c != order_key]
    cols = column_profile(value_frequencies(df, columns, order_key), df.schema)
    none = lambda kind: F.lit(None).cast(kind)
    whole = cols.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows")).select(F.lit(detail).alias("name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
    others = {name: frame for name, frame in sources.items() if name != detail}
    summary = whole.unionByName(load_stats(others).select("name", "rows", "n_columns")) if others else whole
    return summary.select(
        F.col("name").alias("source"), none("string").alias("column_name"), "rows", "n_columns",
        none("bigint").alias("nulls"), none("bigint").alias("distinct"), none("string").alias("reads_as"), none("bigint").alias("n_formats"),
    ).unionByName(cols.select(
        F.lit(detail).alias("source"), "column_name", "rows", none("bigint").alias("n_columns"),
        "nulls", "distinct", F.col("inferred_type").alias("reads_as"), "n_formats",
    ))
