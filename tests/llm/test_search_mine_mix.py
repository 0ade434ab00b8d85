"""Ranked search, hard negatives and mixing against brute force."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import CLASHES, corpus, frame, sentence

from tallyframe.llm import lexical, mixing, negatives
from tallyframe.llm.common import ROW

# ------------------------------------------------------------------ mixing


def plain_targets(size_of, weights=(3, 1, 2), share=1.5, most=2.0):
    """Rounds: give by weight, stop at the cap, share the rest anew."""
    names = sorted((s for s in size_of if s is not None)) + ([None] if None in size_of else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, target = share * sum(size_of.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * size_of[s]]
        if not over:
            return {**{s: most * size_of[s] for s in full}, **{s: left * weight[s] / sum(weight[x] for x in free) for s in free}}
        for s in over:
            full.add(s)
            left -= most * size_of[s]


def mixed_rows(n=400):
    rng = random.Random(8)
    rows = [(i, " ".join(["word"] * rng.choice([0, 1, 3, 5, 9, 40])), rng.choice(["hot"] * 6 + ["a", "b", "ä", None])) for i in range(n)]
    rows += [(n, "x\x1cy z \t w\x0b\n", "a"), (n + 1, None, "b"), (n + 2, "", None), (n + 3, "long " * 5000, "hot"), (None, "no id", "a"), (5, "again", "c"), (5, "again", "c")]
    return rows


def mix_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"'x' AS {c}" for c in CLASHES))


def test_mix_meets_targets(spark):
    rows = mixed_rows()
    got = mixing.mix(mix_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size_of, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size_of[s] += words(t)
        largest[s] = max(largest[s], words(t))
    target, taken = plain_targets(size_of), defaultdict(int)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, words(t), s) for i, t, s in rows)
    for r in got:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
        expected = r.target / r.source_size
        assert math.floor(expected) <= r.copies <= math.ceil(expected) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in size_of:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix_is_the_line_and_its_offset(spark):
    """Copies are the whole numbers crossed along the line, by exact sums; partitions make no difference."""
    rows = mixed_rows(150)
    got = mixing.mix(mix_frame(spark, rows).repartition(1)).collect()
    lines = defaultdict(list)
    for r in got:
        lines[r.source].append(r)
    for s, of in lines.items():
        name = "null" if s is None else "=" + s
        at = int(hashlib.sha256(f"mix|{name}".encode()).hexdigest()[:10], 16)
        part = math.floor(of[0].target / of[0].source_size * (1 << 40)) if of[0].source_size else 0
        for r in sorted(of, key=lambda r: (-r.size, r.doc_id is not None, r.doc_id or 0, r[ROW])):
            assert r.copies == ((at + part) >> 40) - (at >> 40)
            at += part
    again = mixing.mix(mix_frame(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_systematic_copies_of_unequal_rows(spark):
    """Expected copies may differ from row to row; any run of the line gets its own to within one."""
    rows = [(i, "k", (i * 7 % 13) / 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, key string, want double")
    got = mixing.systematic_copies(df, "key", F.col("want"), ["id"]).orderBy("id").collect()
    gap = np.cumsum([r.copies - r.want for r in got])
    assert gap.max() - gap.min() <= 1 + 1e-6 and all(math.floor(r.want) <= r.copies <= math.ceil(r.want) for r in got)


def test_emit_and_edges(spark):
    docs = spark.createDataFrame([("a", "one two", "s"), ("b", "three", "s"), (None, None, None)], "doc_id string, text string, source string")
    mixed = mixing.mix(docs)
    out = mixing.emit(docs, mixed).collect()
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: r.copies for r in mixed.collect() if r.copies})
    assert mixing.mix(docs.where("false")).collect() == []
    only = mixing.mix(docs.where("text IS NULL")).collect()
    assert [(r.target, r.taken) for r in only] == [(0.0, 0)]


# ------------------------------------------------------------------ ranked search


def terms(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def plain_search(docs, items, k):
    """Every item against every document: (item place, rank, doc_id, score)."""
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        found = []
        for (doc_id, _), c, size in zip(docs, counts, n):
            m = 50 + 50 * size * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(place, i, None if none else doc_id, -s) for i, (s, none, doc_id) in enumerate(sorted(found)[:k], 1)]
    return out


def search_case():
    rng = random.Random(4)
    docs = [(i, t) for i, t, _ in corpus(n=150)] + [(900 + i, "Same copy of a text, the SAME") for i in range(40)]
    docs += [(2000, "the " * 3000), (2001, "münchen ÉTÉ a1b2 x\x7fy"), (2002, "!!! ...")]
    items = [(i, sentence(rng, rng.choice(["en", "fr", "de"]), rng.randint(3, 90))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "copy"), (53, "copy"), (54, "the the THE"), (55, "München été a1B2 y"), (None, "same text"), (56, "zzzz qqqq")]
    items += [(57, " ".join(f"w{i}" for i in range(200)) + " the of and le der")]  # masks of more than 64 terms
    return docs, items


@pytest.mark.parametrize("block_docs,block_bytes,first_share", [(8192, 4 << 20, 64), (16, 4 << 20, 3), (16, 400, 3), (50, 4 << 20, 1)])
def test_search_is_exact(spark, block_docs, block_bytes, first_share):
    docs, items = search_case()
    d = frame(spark, [(i, t, None) for i, t in docs]).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *(f"'x' AS {c}" for c in CLASHES)).coalesce(1)
    got = lexical.search(spark, d, it, k=10, block_docs=block_docs, block_bytes=block_bytes, first_share=first_share).collect()
    want = plain_search(docs, items, 10)
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == Counter((items[p][0], *rest) for p, *rest in want)


def test_search_leaves_groups_out(spark):
    """Groups are evaluated from the highest maximum down, and not all of them."""
    rng = np.random.default_rng(0)
    n = rng.integers(20, 60, 3000)
    at = [np.sort(rng.choice(3000, s, replace=False)) for s in (40, 400, 1200, 2900)]
    tf = [rng.integers(1, 4, len(a)) for a in at]
    block = lexical.Block(n, np.arange(1, 5), np.array([len(a) for a in at]), np.concatenate(at), np.concatenate(tf), lexical.lengths(n, 3000, int(n.sum())))
    weights = np.array([4000, 2000, 900, 30])
    seen = []
    real = block.scores
    block.scores = lambda docs, *a: seen.extend(docs) or real(docs, *a)
    docs, score = block.best([1, 2, 3, 4], weights, 5, 1)
    every = real(np.arange(3000), [1, 2, 3, 4], weights)
    assert sorted(score)[-5:] == sorted(every)[-5:] and set(np.flatnonzero(every >= np.sort(every)[-5])) <= set(docs)
    assert len(seen) < 300


def test_search_empty_tables_and_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical.search(spark, docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical.search(spark, docs.where("false"), items).collect() == []
    assert lexical.search(spark, docs, items.where("false")).collect() == []


def test_lengths_beyond_a_long():
    n = np.array([10**12, 3], np.int64)
    assert lexical.lengths(n, 10**9, 10**13).tolist() == [50 + 50 * 10**12 * 10**9 // 10**13, 50 + 50 * 3 * 10**9 // 10**13]


# ------------------------------------------------------------------ hard negatives


def plain_mine(rows, is_anchor, n_positive=5, n_negative=3, scale=256):
    whole = []
    for place, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            whole.append((i, place, [math.floor(scale * x) for x in v], label))
    out = []
    for i, place, v, label in whole:
        if i is None or not is_anchor(i):
            continue
        others = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, p, lab) for j, p, w, lab in whole if p != place))
        pos = [o for o in others if o[4] == label][:n_positive]
        for ps, pnone, pid, pp, _ in pos:
            fit = [o for o in others if o[4] != label and 50 * -ps <= 100 * -o[0] <= 95 * -ps][:n_negative]
            out += [(i, None if pnone else pid, r, None if none else j, -ps, -s) for r, (s, none, j, _, _) in enumerate(fit, 1)]
    return out


def vectors_case(n=400, dims=6):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        size = rng.choice([0.2, 1, 1, 3])
        rows.append((i, [rng.gauss(0, 1) * size for _ in range(dims)], 0 if i % 3 else rng.randint(1, 4)))
    rows += [(n + i, rows[30][1], i % 2) for i in range(40)]  # equal products
    k = n + 100
    rows += [(k, None, 1), (k + 1, [1.0] * dims, None), (k + 2, [1.0, None] + [0.0] * (dims - 2), 1), (k + 3, [float("nan")] * dims, 1), (k + 4, [float("inf")] * dims, 0)]
    rows += [(k + 10, [], 1), (k + 20, [2.0, 1.0], 2), (k + 30, [0.0] * dims, 0), (20, rows[20][1], rows[20][2]), (None, rows[10][1], 3), (k + 40, [5.0] * dims, 7)]
    return rows


@pytest.mark.parametrize("bucket_rows,block", [(8192, 4096), (23, 7)])
def test_mining_is_exact(spark, bucket_rows, block):
    rows = vectors_case()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", *(f"'x' AS {c}" for c in CLASHES if c != "label")).repartition(3)
    got = negatives.mine(df, F.col("id") % 10 == 0, F.col("label"), bucket_rows=bucket_rows, block=block)
    want = plain_mine(rows, lambda i: i % 10 == 0)
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter(want) and len(want) > 100


def test_mining_large_numbers_and_edges(spark):
    big = 2.0**40
    rows = [(10 * i, [big * (i + 1), 3.0], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    exact = lambda a, b: int(a[0]) * int(b[0]) + 9
    vec = {i: v for i, v, _ in rows}
    with pytest.raises(Exception, match="does not fit a long"):  # 2**80
        negatives.mine(df, F.col("id") % 10 == 0, F.col("label"), scale=1, low=0, high=1000, n_positive=1)
    small = spark.createDataFrame([(i, [v[0] / 2**12, v[1]], lab) for i, v, lab in rows], df.schema)
    out = negatives.mine(small, F.col("id") % 10 == 0, F.col("label"), scale=1, low=0, high=100, n_positive=1).collect()
    vec = {i: [v[0] / 2**12, v[1]] for i, v in vec.items()}
    assert out and all(r.negative_score == exact(vec[r.anchor_id], vec[r.negative_id]) for r in out)
    assert negatives.mine(df.where("false"), F.col("id") % 10 == 0, F.col("label")).collect() == []
    assert negatives.mine(df, F.lit(False), F.col("label")).collect() == []
    named = spark.createDataFrame([("a", [1.0], 0), ("b", [0.9], 0), ("c", [0.8], 1)], "vec_id string, embedding array<float>, label long")
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in negatives.mine(named, F.col("id") == "a", F.col("label")).collect()] == [("a", "b", "c")]


def test_coordinate_ranges_leave_rows_out():
    """Feasible ranges hold every row that reaches theta, and few others where vectors are skewed."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(4000, 12)) * np.geomspace(1, 0.02, 12)
    m = np.floor(1000 * m / np.linalg.norm(m, axis=1)[:, None])  # as in a bucket: about one length
    order = np.argsort(m / negatives.lengths(m)[:, None], axis=0, kind="stable").T.astype(np.int32)
    kind, raw = negatives.smallest(m)
    bucket = negatives.Bucket({"n": 4000, "most": float(negatives.lengths(m).max()), "ids": list(range(4000)), "labels": [0] * 4000, "rows": list(range(4000)), "kind": kind, "vectors": raw, "order": order.tobytes()}, 12)
    q = m[:1]
    score = (m @ q.T)[:, 0]
    theta = np.sort(score)[-20]
    limit = negatives.lengths(q)[0] * bucket.most
    top = np.argsort(-np.abs(q[0]))[:4]
    low, high = negatives.feasible(np.array([theta / limit]), q[0, top] / negatives.lengths(q)[0])
    at = bucket.candidates(top, low, high)
    assert at is not None and set(np.flatnonzero(score >= theta)) <= set(at.tolist()) and len(at) < 2000
