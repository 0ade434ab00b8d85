"""SimHash near-dedup: exact pairs within a Hamming distance, by vantage-point trees.

Fingerprints are made in Arrow batches and written once (id, row, fingerprint); everything after
that works on distinct fingerprints, never on documents or texts.

Shards. Around a fingerprint lies a ball of ``distance`` bits. Cut the 64 bits into
``distance + 1`` blocks: two fingerprints in one ball agree on at least one block, so that a ball
overlaps exactly ``distance + 1`` shards, those of its own block values. Each fingerprint is filed
in all of them, which makes every shard's search exact on its own. (Shards split by the distance
of all 64 bits to a vantage point prune next to nothing at the top: for even fingerprints
distances to any point are 32 +- 4, so a median split sends two thirds of all points, and a tree
of k levels 1.7**k copies, to both sides.)

Inside a shard a vantage-point tree parts the points by their distance to a vantage point at the
median; a search descends only into sides that the triangle inequality leaves open, and compares
leaves exactly. Shards above ``block_rows`` are cut into chunks, and each pair of chunks is one
task's work, so that no task holds more than two chunks. A task links what it finds into a
spanning forest: no more links than points, however dense a group is.

Components then form by alternating stars over the links, each round written once.

Defined results: null text is empty; a text without words has fingerprint zero and links like
any other. Rows that repeat share their component. Null ids never name a component unless all
ids of it are null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, ROW, column_lists, identified, salted_left_join, utf8_values
from tallyframe.llm.components import components
from tallyframe.session import materialize

SEED = 42
BITS = 64


def fingerprint(raw: bytes, shingle: int) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included."""
    words = raw.translate(LOWER).split()  # ASCII white space, [\\x20\\x09-\\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    h64, total, done = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for a in range(0, done, 65_536):  # bounded memory however long the text
        b = min(done, a + 65_536)
        hashes = np.array([h64(joined[s:e], SEED) for s, e in zip(starts[a:b], ends[a + shingle - 1 : b + shingle - 1] or ends[-1:])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > done, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __row and fp (the fingerprint's bits as a signed long)."""
    rows = identified(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, text in column_lists(batches, "doc_id", ROW, "text"):
            fps = np.fromiter((fingerprint(t, shingle) for t in utf8_values(text)), np.uint64, len(text)).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(fps)], ["doc_id", ROW, "fp"])

    return rows.mapInArrow(task, f"doc_id {id_type}, {ROW} long, fp long")


class Forest:
    """Components of points 0..n-1 by links, with labels that arrays can be compared by."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray, adjacent: np.ndarray) -> None:
        """Joins a[i] and b[j] wherever adjacent[i, j]; each pass takes one link an a whose
        ends are still apart, so dense groups cost passes, not pairs."""
        while True:
            apart = adjacent & (self.label[a][:, None] != self.label[b][None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                return
            for i, j in zip(a[rows], b[apart[rows].argmax(axis=1)]):
                x, y = i, j
                while self.label[x] != x:
                    x = self.label[x]
                while self.label[y] != y:
                    y = self.label[y]
                self.label[max(x, y)] = min(x, y)
            while (up := self.label[self.label] != self.label).any():
                self.label[up] = self.label[self.label[up]]


def vantage_links(points: np.ndarray, queries: np.ndarray, distance: int, forest: Forest, values: np.ndarray, leaf: int = 256) -> None:
    """Links every query to every point within ``distance``; both index ``values``."""
    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > leaf:
            vantage = values[p[len(p) // 2]]
            to_p = np.bitwise_count(values[p] ^ vantage).astype(np.int16)
            radius = int(np.median(to_p))
            near = to_p <= radius
            if not near.all():
                to_q = np.bitwise_count(values[q] ^ vantage).astype(np.int16)
                stack.append((p[near], q[to_q <= radius + distance]))  # d(q,v) <= d(p,v) + distance
                stack.append((p[~near], q[to_q > radius - distance]))  # d(q,v) >= d(p,v) - distance
                continue
        for a in range(0, len(q), 2048):
            for b in range(0, len(p), 2048):
                qa, pb = q[a : a + 2048], p[b : b + 2048]
                close = np.bitwise_count(values[qa][:, None] ^ values[pb][None, :]) <= distance
                if close.any():
                    forest.link(qa, pb, close)


def shard_links(values: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over one shard's distinct ``values``; ``left`` are searched for
    near ``right`` (index arrays, the same for a shard of one chunk)."""
    forest = Forest(len(values))
    vantage_links(right, left, distance, forest, values)
    linked = np.flatnonzero(forest.label != np.arange(len(values)))
    return values[linked], values[forest.label[linked]]


def links(fps: DataFrame, distance: int, block_rows: int = 20_000) -> DataFrame:
    """a, b: links between distinct fingerprints that connect every pair within ``distance``."""
    blocks = distance + 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    filed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int").alias("value")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
        ).alias("s"),
    ).select("fp", "s.*")
    # one row a block and value: no more than blocks * 2**(64 / blocks), whatever the corpus
    sizes = filed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = sizes.select("block", "value", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("chunks"))
    if blocks << -(-BITS // blocks) <= 1_000_000:
        sizes = F.broadcast(sizes)
    pieces = (
        filed.join(sizes, ["block", "value"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "block", "value", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") > F.col("other")).alias("high"))
    )
    key = ["block", "value", "lo", "hi"]
    dealt = pieces.repartition(*key).sortWithinPartitions(*key)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def group(rows: np.ndarray) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            fp, high, same = rows["fp"].view(np.uint64), rows["high"], rows["lo"][0] == rows["hi"][0]
            index = np.arange(len(rows))
            a, b = shard_links(fp, index if same else index[high], index if same else index[~high], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]) if len(a) else None

        kind = np.dtype([("fp", np.int64), ("high", np.bool_)] + [(k, np.int32) for k in key])
        for cols in column_lists(batches, *kind.names):
            rows = np.empty(len(cols[0]), kind)
            for name, col in zip(kind.names, cols):
                rows[name] = col.to_numpy(zero_copy_only=False)
            held.append(rows)
            if rows[key][-1] == held[0][key][0]:
                continue  # still the same shard
            rows = np.concatenate(held)
            *done, last = np.split(rows, np.flatnonzero(rows[key][1:] != rows[key][:-1]) + 1)
            held = [last]
            found = [g for r in done if (g := group(r)) is not None]
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
        if held and (g := group(np.concatenate(held))) is not None:
            yield g

    return dealt.mapInArrow(task, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 20_000, salts: int = 16) -> DataFrame:
    """doc_id, __row, fingerprint, component_id, kept (one row of each component, that of the
    smallest id) for every row of ``docs``."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    nodes = rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    nodes = materialize(nodes, "simhash-nodes")
    linked = components(links(nodes.select("fp"), distance, block_rows))
    roots = nodes.join(linked.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = roots.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where(F.col("n") > 1)
    groups = roots.select("fp", "root").join(firsts, "root").select("fp", F.col("first").alias("of"))
    alone = F.col("of").isNull()
    return salted_left_join(rows, groups, "fp", F.col(ROW), salts).select(
        "doc_id",
        ROW,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("of.id")).alias("component_id"),
        (alone | (F.col(ROW) == F.col("of.row"))).alias("kept"),
    )
