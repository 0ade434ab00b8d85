"""Exact dedup, suffix-array dedup and SimHash near-dedup against brute force."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import corpus, frame

from tallyframe.llm import exact_dedup, simhash, suffix_dedup
from tallyframe.llm.components import components
from tallyframe.llm.suffix_array import permuted_prefixes, suffix_array


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def test_exact_groups(docs, rows):
    got = exact_dedup.exact_dedup(docs, salts=3).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = digest[r.text_sha256]
        assert r.group_size == len(members)
        assert r.keep_id == min(members)[3]
        assert r.kept == (r.doc_id == r.keep_id)
    kept = Counter(r.text_sha256 for r in got if r.kept_row)
    assert set(kept) == set(digest) and set(kept.values()) == {1}  # repeated rows too


def test_exact_hot_group_and_tie(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", None) for i in range(300)] + [(1000, "s a m e text", None)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), salts=4).collect()}
    assert got[0].keep_id == 1000 and got[0].group_size == 101  # most characters wins
    assert got[1].group_size == 1 and got[1].kept


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def naive_order(t):
    return sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_array_random():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k = int(rng.integers(1, 6))
        t = np.append(rng.integers(1, k + 1, rng.integers(1, 80)), 0)
        order = suffix_array(t, k + 1)
        assert order.tolist() == naive_order(t)
        shared = permuted_prefixes(t, order, 1000)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while b + n < len(t) and a + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n


@pytest.mark.parametrize("unit", ["a", "ab", "aab", "abcab"])
def test_suffix_array_periodic(unit):
    t = np.append(np.frombuffer((unit * 40).encode(), np.uint8).astype(int), 0)
    assert suffix_array(t, 258).tolist() == naive_order(t)


def cut_by_hand(texts, window):
    counts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        keep = np.ones(len(t), bool)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                keep[i : i + window] = False
        runs = int((np.diff(np.concatenate([[0], ~keep])) == 1).sum()) if len(t) else 0
        out.append((np.frombuffer(t, np.uint8)[keep].tobytes(), int((~keep).sum()), runs))
    return out


@pytest.mark.parametrize("shard_bytes,stretch", [(8 << 20, 4 << 20), (8 << 20, 1000), (600, 4 << 20)])
def test_suffix_removal(docs, rows, shard_bytes, stretch):
    """Also with stretches of a few segments, and with most keys too large for a task."""
    got = suffix_dedup.removed(docs, window=50, gram=16, stretch=stretch, shard_bytes=shard_bytes).collect()
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter((i, len(t), gone, runs, kept) for (i, _, _), t, (kept, gone, runs) in zip(rows, texts, cut_by_hand(texts, 50)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_suffix_hot_line(spark):
    """A line that a third of all texts hold, with different neighbours, is no repeat of 200 bytes."""
    rng = random.Random(2)
    other = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = other(120)
    rows = [(i, other(300) + (line if i % 3 else "") + other(300), None) for i in range(90)] + [(500, line * 2, None), (501, line * 2, None)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed(frame(spark, rows), shard_bytes=2000).collect()}
    assert got == {i: 240 if i >= 500 else 0 for i in got}


@pytest.mark.parametrize("shard_bytes", [8 << 20, 3000])
def test_suffix_production_window(spark, shard_bytes):
    """The window of the query, whole texts against brute force: shared passages, lines that only share
    less than the window, periodic texts, copies; also with most repeated keys too large for a task."""
    rng = random.Random(9)
    other = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages, line = [other(n) for n in (199, 200, 230, 400, 1500)], other(150)
    rows = [(i, other(rng.randint(0, 500)) + rng.choice(passages) + other(rng.randint(0, 300)) + line + other(100), None) for i in range(120)]
    rows += [(200, "ab" * 300, None), (201, "x" * 250, None), (202, other(900) * 2, None), (203, passages[4][100:], None), (204, None, None), (205, "é" * 99, None)]
    rows += [(300 + i, rows[i][1], None) for i in range(20)]
    got = suffix_dedup.removed(frame(spark, rows), shard_bytes=shard_bytes).collect()
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter((i, len(t), gone, runs, kept) for (i, _, _), t, (kept, gone, runs) in zip(rows, texts, cut_by_hand(texts, 200)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_large_keys_count_distinct_segments(spark):
    """A passage in very many copies is no large key; as many different texts round one gram are."""
    rng = random.Random(3)
    other = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    gram, copy = other(40), other(300)
    rows = [(i, copy, None) for i in range(300)]
    keys = suffix_dedup.keys_of(suffix_dedup.identified(frame(spark, rows)), 200, 40)
    shared = keys.groupBy("key").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert suffix_dedup.large_keys(keys, shared, 200, 40, 20_000).count() == 0
    rows = [(i, other(200) + gram + other(200), None) for i in range(300)]
    keys = suffix_dedup.keys_of(suffix_dedup.identified(frame(spark, rows)), 200, 40)
    shared = keys.groupBy("key").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    sizes = shared.where("n > 100").count()
    assert suffix_dedup.large_keys(keys, shared, 200, 40, 20_000).count() == sizes


def test_suffix_empty(spark):
    assert suffix_dedup.removed(frame(spark, [])).collect() == []


def by_hand(text, shingle=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(fps, distance):
    """Of each index the set of those linked to it."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_simhash(docs, rows, block_rows):
    got = simhash.near_duplicates(docs, 4, 4, block_rows=block_rows).collect()
    fps = [by_hand(t) for _, t, _ in rows]
    label = reachable(fps, 4)
    firsts = {}
    for (i, _, _), x in zip(rows, label):
        firsts.setdefault(x, []).append(i)
    least = {x: min((i for i in ids if i is not None), default=None) for x, ids in firsts.items()}
    want = Counter((i, f"{f:016x}", least[x]) for (i, _, _), f, x in zip(rows, fps, label))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(firsts)  # one row a component


def test_dense_ball_of_fingerprints(spark):
    """Thousands of fingerprints round one point, and chains of links: forests lose no link."""
    rng = random.Random(8)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 1200:
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << b
        fps.add(f)
    chain = rng.getrandbits(64)
    for b in range(0, 64, 4):
        chain ^= 0b1111 << b
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    fps = sorted(fps)
    values = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4)
        to = label[near].min()
        label[np.isin(label, label[near])] = to
    df = spark.createDataFrame([(int(np.int64(np.uint64(f).view(np.int64))),) for f in fps], "fp long")
    for block_rows in (20_000, 300):
        root = {r.node: r.root for r in components(simhash.links(df, 4, block_rows)).collect()}
        mine = {}
        for f, x in zip(values.view(np.int64).tolist(), label.tolist()):
            mine.setdefault(x, set()).add(root.get(f, f))
        assert all(len(v) == 1 for v in mine.values()) and len({next(iter(v)) for v in mine.values()}) == len(mine)


def test_long_text_fingerprint():
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(70_000))
    assert simhash.fingerprint(text.encode(), 4) == by_hand(text)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
