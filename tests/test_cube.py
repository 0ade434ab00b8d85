"""The bundle from the summary cube equals the bundle from the rows."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cube as CB
from tallyframe.operators import metrics as M
from tallyframe.plans.retail import derived_table
from tallyframe.session import materialize, scratch_path
from tallyframe.sources import tables as S

FILTERS = [M.Filters(), M.Filters("1996-01-01", "1996-12-31", "MEDIUM", "R2"), M.Filters(category="MEDIUM"), M.Filters(region="R2", date_from="nonsense"), M.Filters(category="none such")]


@pytest.fixture(scope="module")
def derived(spark, sf_small):
    return materialize(derived_table(spark, sf_small), "derived")


@pytest.fixture(scope="module")
def cube(spark, derived):
    path = scratch_path(spark, "cube")
    for year in ("early", "late"):
        CB.refresh(derived.filter((F.col("order_date") < "1996-01-01") == F.lit(year == "early")), path, year)
    CB.refresh(derived.filter(F.col("order_date").isNull()), path, "undated")
    return CB.read_cube(spark, path)


@pytest.mark.parametrize("f", FILTERS)
def test_surfaces_match_the_rows(derived, cube, f):
    want, got = M.aggregate(derived, f), CB.bundle(cube, f)
    for name in M.Bundle.SURFACES:
        a, b = getattr(want, name), getattr(got, name)
        assert [tuple(r) for r in b.select(*a.columns).collect()] == [tuple(r) for r in a.collect()], name


@pytest.mark.parametrize("f", FILTERS[:2])
def test_document_matches_and_echoes(derived, cube, f):
    b = M.aggregate(derived, f)
    rows = json.loads(S.metrics_json(b.surfaces(), M.SURFACE_ORDER, M.echo(f)).first()[0])
    read = json.loads(CB.document(cube, f).first()[0])
    assert read == rows
    assert read["filters"] == {"date_from": f.date_from, "date_to": f.date_to, "category": f.category, "region": f.region}
    assert read["rows"] == b.kpis.first().rows and isinstance(read["kpis"], dict)


def test_refresh_replaces_a_part_alone(spark, derived):
    path = scratch_path(spark, "cube")
    CB.refresh(derived, path, "a")
    before = set(spark.read.parquet(f"{path}/part=a").inputFiles())
    CB.refresh(derived, path, "b")
    CB.refresh(derived.filter("false"), path, "b")
    assert set(spark.read.parquet(f"{path}/part=a").inputFiles()) == before
    assert CB.bundle(CB.read_cube(spark, path)).kpis.first().rows == derived.count()


def test_document_reads_the_cube_once(cube):
    """One scan with the dates pushed down, nothing written, and products cut to k before the exchange."""
    plan = CB.document(cube, FILTERS[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PushedFilters: [IsNotNull(order_date)" in plan
    assert plan.count("WindowGroupLimit") == 2


def test_cube_is_built_from_its_own_columns(spark, sf_small, monkeypatch):
    """What the cube's parts are read from holds no other column, and its cells are the whole table's."""
    from tallyframe.plans import catalog

    seen = []
    real = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    cube = catalog._cube(spark, sf_small)
    assert seen == [list(CB.COLUMNS)]
    assert CB.bundle(cube).kpis.first() == M.aggregate(derived_table(spark, sf_small)).kpis.first()
