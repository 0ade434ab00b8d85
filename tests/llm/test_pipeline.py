"""The pipeline, stage by stage and as a whole, and the registered queries."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import DOCS, corpus, frame, prose, sentence, tables

import __spark_entry__ as entry
import corpus_pipeline
from compare import duck, rows_of
from tallyframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = corpus(n=120)
    rows += [(500 + i, " ".join(["$$$", "buy!!"] * 40), "en") for i in range(30)]
    items = [(1, sentence(rng, "de", 20)), (2, sentence(rng, "fr", 16))]
    rows += [(600, prose(rng) + " " + items[0][1] + " " + prose(rng), "en"), (601, items[1][1], "fr")]
    labels = [(i, 0 if 500 <= i < 530 else 1, 0) for i, _, _ in rows if i is not None and i < 600]
    docs = frame(spark, rows)
    return tables(
        spark,
        tmp_path_factory.mktemp("tables"),
        documents=docs,
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame(items, "item_id long, text string"),
    )


def test_stages(spark, sf_dir):
    """Each stage on its predecessor's table: columns stay, decisions take effect."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = f"{sf_dir}/out-{len(seen)}"
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    texts = [[r.text for r in d.select("text").collect()] for d in seen]
    assert not any("buy!!" in (t or "") for t in texts[1]) and len(texts[1]) > len(texts[0]) - 45
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(map(norm, texts[2])) == Counter(set(map(norm, texts[1])))
    assert len(texts[3]) < len(texts[2])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert any(i in (t or "") for i in items for t in texts[3])
    assert not any(i in (t or "") for i in items for t in texts[4])
    clean = Counter(t for t in texts[3] if not any(i in (t or "") for i in items))
    assert clean - Counter(texts[4]) == Counter()
    changed = [r for r in seen[4].collect() if r.text is not None and r.n_chars is not None]
    assert all(r.n_chars == len(r.text) for r in changed)
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    pieces = lambda d: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in d.collect())
    assert sum(r.length for r in last.collect()) == sum(r.length for r in whole.collect())
    assert Counter(k[0] for k in pieces(last)).keys() == Counter(k[0] for k in pieces(whole)).keys()


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_every_query_is_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}) == list(range(1, 14))
    assert set(entry.queries()) >= set(queries.QUERIES) | {"pipeline"}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    result = duck(SF).execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rows, False) == rows_of(columns, result.fetchall(), False)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_secret_scans"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


