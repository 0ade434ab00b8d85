"""The registered queries and the pipeline, on fixture tables, against plain Python."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import PAGES, corpus, frame, prose, sentence, tables
from test_dedup import by_hand, cut_by_hand, reachable
from test_search_mine_mix import plain_mine, plain_search
from test_text_operators import hits_by_hand

import corpus_pipeline
from tallyframe.llm import queries

SPAM = " ".join(["$$$", "buy!!"] * 40)


def case():
    rng = random.Random(21)
    rows = corpus(n=160)
    rows += [(500 + i, SPAM + f" {i}", "en") for i in range(40)]
    items = [(1, sentence(rng, "de", 20)), (2, sentence(rng, "fr", 16)), (3, "one two"), (4, None), (5, "!!"), (6, sentence(rng, "en", 30))]
    rows += [(600, prose(rng) + " " + items[0][1] + " " + prose(rng), "en"), (601, items[1][1], "fr"), (602, prose(rng) + items[5][1] * 2, "en"), (603, "One, two!", "en")]
    labels = [(i, 0 if 500 <= i < 540 else 1, 0) for i, _, _ in rows if i is not None and i < 600]
    return rows, items, labels


@pytest.fixture(scope="module")
def given():
    return case()


@pytest.fixture(scope="module")
def sf_dir(spark, given, tmp_path_factory):
    rows, items, labels = given
    rng = random.Random(5)
    urls = [(i, f"{s}://{h}{p}", "x" * i) for i, (s, h, p) in enumerate((rng.choice(["http", "https"]), rng.choice(["a.net", "www.example.net", "example.com", "Sub.Example.COM", "wiki.org", "freemoney.biz"]), rng.choice(["", "/", "/en/x", "/de/y?z", "/fr/a#b", "/en"])) for _ in range(80))]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.randint(0, 2)) for i in range(300)] + [(350, None, 1), (400, [1.0] * 8, None)]
    return tables(
        spark, tmp_path_factory.mktemp("tables"), documents=frame(spark, rows),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"),
        pages=spark.createDataFrame(urls + [(900, None, None), (901, "no scheme", "y")], PAGES), embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
    )


def result(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op3(spark, sf_dir, given):
    texts = [(t or "").encode() for _, t, _ in given[0]]
    want = Counter((i, len(t), gone, runs, sha(kept)) for (i, _, _), t, (kept, gone, runs) in zip(given[0], texts, cut_by_hand(texts, 200)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, sf_dir, "op3_suffix_dedup"))
    assert got == want and sum(gone > 0 for _, _, gone, _, _ in want) > 10


def test_op5_op9_columns(spark, sf_dir, given):
    ids = Counter(i for i, _, _ in given[0])
    rest = lambda i, n: zlib.crc32(str(i).encode()) % n
    scored = result(spark, sf_dir, "op5_quality")
    assert Counter(r.doc_id for r in scored) == ids and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) for r in scored if r.doc_id is not None)
    held = [r for r in scored if r.held_out and r.doc_id is not None]
    assert len(held) > 20 and all(r.predicted == (not 500 <= r.doc_id < 540) for r in held)
    named = result(spark, sf_dir, "op9_language_id")
    text = {i: (t, lang) for i, t, lang in given[0]}
    assert Counter(r.doc_id for r in named) == ids and all(0 <= r.score <= 1 for r in named)
    assert all(r.held_out == (rest(r.doc_id, 4) == 2) for r in named if r.doc_id is not None)
    for r in named:
        if r.doc_id is not None and not re.search(r"[^\W\d_]", text[r.doc_id][0] or ""):
            assert r.lang_pred == "und"
    sure = [r for r in named if r.held_out and r.doc_id is not None and r.doc_id < 160]
    assert sum(r.lang_pred == text[r.doc_id][1] for r in sure) >= 0.9 * len(sure)


def test_op6(spark, sf_dir, given):
    check_pieces([(i, t) for i, t, _ in given[0]], result(spark, sf_dir, "op6_packing"))


def check_pieces(docs, pieces, size=2048):
    """The pieces hold each document's ids once, by their sums, and sequences without gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for i, t in docs:
        ids[i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    by_start = {}
    for p in pieces:
        by_start.setdefault((p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32), []).append(p)
    left = Counter({k: len(v) for k, v in by_start.items()})

    def covered(key, raw, at):
        if at == len(raw) // 4:
            return True
        for k in [k for k in left if left[k] and k[0] == key and k[1] == len(raw) // 4 and k[2] == at and zlib.crc32(raw[4 * at : 4 * (at + k[3])]) == k[4]]:
            left[k] -= 1
            if covered(key, raw, at + k[3]):
                return True
            left[k] += 1
        return False

    for (key, raw), n in ids.items():
        assert all(covered(key, raw, 0) for _ in range(n))
    assert not any(left.values())
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= size


def test_op7(spark, sf_dir, given):
    want = Counter()
    for i, t, _ in given[0]:
        n, hit, keys = hits_by_hand(t, given[1], 10)
        want[i, n, hit, len(keys), sha(",".join(keys).encode()), hit > 0] += 1
    assert Counter(tuple(r) for r in result(spark, sf_dir, "op7_decontamination")) == want and any(k[-1] for k in want)


def test_op8(spark, sf_dir, given):
    fps = [by_hand(t) for _, t, _ in given[0]]
    groups = {}
    for (i, _, _), x in zip(given[0], reachable(fps, 4)):
        groups.setdefault(x, []).append(i)
    least = {x: min((i for i in of if i is not None), default=None) for x, of in groups.items()}
    want = Counter((i, f"{f:016x}", least[x]) for (i, _, _), f, x in zip(given[0], fps, reachable(fps, 4)))
    assert Counter(tuple(r) for r in result(spark, sf_dir, "op8_simhash")) == want


RULES = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}


def test_op10(spark, sf_dir):
    for r, u in ((r, u) for u in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() for r in result_by_id(spark, sf_dir)[u.page_id]):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u.url or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(h, p) for h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict == RULES[best] if best else r.verdict in ("allow", "block")


_BY_ID = {}


def result_by_id(spark, sf_dir):
    if sf_dir not in _BY_ID:
        _BY_ID[sf_dir] = {}
        for r in result(spark, sf_dir, "op10_url_filters"):
            _BY_ID[sf_dir].setdefault(r.page_id, []).append(r)
    return _BY_ID[sf_dir]


def test_op11(spark, sf_dir, given):
    docs = [(i, t) for i, t, _ in given[0]]
    want = Counter((given[1][p][0], *rest) for p, *rest in plain_search(docs, given[1], 50))
    assert Counter(tuple(r) for r in result(spark, sf_dir, "op11_ranked_search")) == want


def test_op12(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = Counter(plain_mine(rows, lambda i: i % 50 == 0))
    assert Counter(tuple(r) for r in result(spark, sf_dir, "op12_hard_negatives")) == want and want


def test_pipeline_against_plain_python(spark, sf_dir, given):
    """Every stage on what the one before kept. The classifier's decisions are taken as given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{sf_dir}/plain-{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    assert list(stages) == ["quality", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]

    accepted = Counter(r.doc_id for r in result(spark, sf_dir, "op5_quality") if r.predicted)
    rows = [(i, t) for i, t, _ in given[0] if accepted[i]]
    assert Counter(seen[0]) == Counter(rows)

    best = {}
    for place, (i, t) in enumerate(seen[0]):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best.setdefault(key, []).append((-len(t or ""), i is None, i or 0, place))
    assert Counter(seen[1]) == Counter(seen[0][min(of)[3]] for of in best.values())

    groups = {}
    for (i, t), x in zip(seen[1], reachable([by_hand(t) for _, t in seen[1]], 4)):
        groups.setdefault(x, []).append((i is None, i or 0, i, t))
    keep = Counter()
    for of in groups.values():
        keep[min(of, key=lambda r: r[:2])[2:]] += 1
    assert Counter(seen[2]) == keep and len(seen[2]) < len(seen[1])

    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in seen[2]:
        n, hit, _ = hits_by_hand(t, given[1], 10)
        if not hit:
            want[i, t] += 1
        elif hit < 0.5 * n:
            want[i, "cut", n - hit] += 1
    got = Counter()
    before = Counter(seen[2])
    for i, t in seen[3]:
        if before[i, t]:
            got[i, t] += 1
        else:
            assert hits_by_hand(t, given[1], 10)[1] == 0
            got[i, "cut", len(words.findall(t))] += 1
    assert got == want and any(len(k) == 3 for k in want) and len(seen[3]) < len(seen[2])

    check_pieces(seen[3], corpus_pipeline.run(spark, sf_dir).collect())
