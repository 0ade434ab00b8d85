"""Profiles, sketches, previews, figures taken while writing, dataset lookup."""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profiling as PR
from tallyframe.sources import tables as S

ROWS = [
    (1, "2024-01-05T10:00:00", "7", None, "x"), (2, "05/01/2024 10:00", " -3 ", None, "x"), (3, "2024-01-05", "4", None, ""),
    (4, None, "0012", None, "1.5"), (5, "2024-01-05T10:00:00", "7", None, "."), (6, "2024-1-5", "+9", None, "y"),
]
SCHEMA = "line long, ts string, n string, nothing string, mixed string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_profile_is_one_record_a_column(df):
    got = {r.column_name: r for r in PR.profile(df, "line").collect()}
    ts = got["ts"]
    assert (ts.rows, ts.nulls, ts.distinct, ts.inferred_type) == (6, 1, 5, "datetime")
    assert [tuple(f) for f in ts.formats] == [("%Y-%m-%dT%H:%M:%S", 2), ("%d/%m/%Y %H:%M", 1), ("%Y-%m-%d", 1)]
    assert ts.samples == ["2024-01-05T10:00:00", "05/01/2024 10:00", "2024-01-05"]
    assert (got["n"].inferred_type, got["n"].distinct, got["n"].samples) == ("int", 5, ["7", " -3 ", "4"])
    assert (got["nothing"].inferred_type, got["nothing"].nulls, got["nothing"].distinct, got["nothing"].samples) == ("empty", 6, 1, [])
    assert got["mixed"].inferred_type == "str" and got["mixed"].formats == []


def test_figures_agree_with_the_value_table(df):
    text = df.drop("line")
    figures, freq = PR.column_figures(text), PR.value_frequencies(df, order_key="line")
    assert sorted(PR.null_counts(figures).collect()) == sorted((r.column_name, r.rows, r.nulls) for r in PR.nulls_distinct(freq).collect())
    types = {r.column_name: r.inferred_type for r in PR.inferred_types(figures).collect()}
    assert types == {r.column_name: r.inferred_type for r in PR.column_profile(freq).collect()}
    assert {r.column_name: (r.n_formats, r.formats) for r in PR.mixed_formats(figures).collect()} == {"ts": (3, "%Y-%m-%d | %Y-%m-%dT%H:%M:%S | %d/%m/%Y %H:%M")}


def test_figures_shuffle_no_values(df):
    """The one exchange is by column, after a partial aggregate."""
    for found in (PR.formats, PR.inferred_types, PR.mixed_formats, PR.null_counts):
        plan = found(PR.column_figures(df.drop("line")))._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
        assert len(keys) == 1 and re.fullmatch(r"column_name#\d+", keys[0])


def test_sketches_merge_within_their_error(spark):
    n = 60_000
    df = spark.range(n).select((F.col("id") % 7).alias("day"), F.col("id").cast("string").alias("all"), (F.col("id") % 1000).cast("string").alias("some"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("one"))
    stored = PR.distinct_sketches(df.filter("day < 6"), F.col("day"), ["all", "some", "one"])
    more = PR.distinct_sketches(df.filter("day = 6"), F.col("day"), ["all", "some", "one"])
    got = {r.column_name: r for r in PR.merged_distinct(stored.unionByName(more)).collect()}
    for name, want in (("all", n), ("some", 1000), ("one", 2)):
        assert abs(got[name].distinct_estimate - want) <= PR.sketch_error() * want and got[name].rows == n
    assert got["one"].nulls == n // 3


def test_write_is_observed(spark, df, tmp_path):
    path = str(tmp_path / "t")
    seen = S.observed_write(df.repartition(3), path, {"no_ts": F.count_if(F.col("ts").isNull())})
    assert (seen["rows"], seen["no_ts"]) == (6, 1) and seen["bytes"] == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    record = S.preview_record(spark.read.parquet(path), seen["bytes"], ["line"], 2).first()
    assert (record.rows, record.columns, record.bytes) == (6, "line,ts,n,nothing,mixed", seen["bytes"])
    assert record.sample == '[["1","2024-01-05T10:00:00","7","","x"],["2","05/01/2024 10:00"," -3 ","","x"]]'


@pytest.mark.parametrize("name", ["", "orderz", "../orders", "orders/../part", "/etc/passwd", ".orders", "orders.parquet", "ORDERS"])
def test_unknown_datasets_are_rejected(spark, sf_small, name):
    with pytest.raises(S.UnknownDataset, match="unknown dataset"):
        S.read_table(spark, sf_small, name)
    assert issubclass(S.UnknownDataset, FileNotFoundError)


def test_known_dataset_resolves():
    assert S.source_path("/data/", "orders") == "/data/orders.parquet"
