"""Scratch folders: a shared one is needed on a cluster, and no two applications share names."""

from types import SimpleNamespace

import pytest

from tallyframe import session


def fake(master, app="app-1", configured=None):
    made = []
    context = SimpleNamespace(master=master, applicationId=app, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: configured), sparkContext=context)


def test_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake("spark://host:7077"))


def test_local_without_a_folder_gets_one():
    spark = fake("local[2]", app="app-local")
    first = session.checkpoint_dir(spark)
    assert session.checkpoint_dir(spark) == first and spark.sparkContext.getCheckpointDir() == first


def test_applications_never_share_a_path():
    paths = [session.scratch_path(fake("spark://host:7077", app, "hdfs://shared/ck"), "stage") for app in ("app-1", "app-2", "app-1")]
    assert len(set(paths)) == 3 and all(p.startswith("hdfs://shared/ck/tallyframe/app-") for p in paths)


def test_missing_table_and_corrupt_table(spark, tmp_path):
    from tallyframe.operators import metrics as M

    with pytest.raises(M.NoTable):
        M.query_saved(spark, str(tmp_path / "none"))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception) as e:  # noqa: PT011  any error but NoTable
        M.query_saved(spark, str(bad))
    assert not isinstance(e.value, M.NoTable)


def test_deep_chain_levels(spark):
    from tallyframe.operators import edges as G

    n = 12
    nodes = spark.createDataFrame([("g", i) for i in range(n)], "group_id string, node long")
    chain = spark.createDataFrame([("g", i, i - 1) for i in range(1, n)], "group_id string, child long, parent long")
    got = {r.node: r.level for r in G.levels(chain, nodes).collect()}
    assert got == {i: i for i in range(n)}


def test_written_stages_can_be_removed(spark, tmp_path):
    """Only this application's folder goes."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from tallyframe.session import local_session, materialize, remove_written
spark = local_session(1, app="removes")
materialize(spark.range(5), "a"), materialize(spark.range(5), "b")
remove_written(spark)
"""
    other = tmp_path / "tallyframe" / "another-application" / "kept"
    other.mkdir(parents=True)
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], capture_output=True, env={k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK"))})
    assert [f.name for f in (tmp_path / "tallyframe").iterdir() if any(f.rglob("*"))] == ["another-application"]
