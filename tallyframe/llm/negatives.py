"""Hard-negative mining with coordinate pruning, after LEMP (retrieval of large inner products).

Rows lie in buckets of about equal vector length, longest first, each bucket with a sorted list for
every coordinate of its vectors scaled to length 1. An anchor that asks a bucket for inner products
of at least theta needs a cosine of theta / (anchor's length * bucket's greatest length). Two vectors
at an angle of at most tau differ by at most tau in their angles to any axis, so each of the
anchor's focus coordinates, its largest, leaves a feasible range of values in that
coordinate's list. The ranges are intersected, and what is left is verified with exact products.

1. ``build_index`` deals the rows by ranges of length and writes buckets of at most ``bucket_rows``.
2. ``largest`` asks rounds of buckets, each ``GROWTH`` times as many as the one before, and theta rises
   from round to round: the score of an anchor's last place so far. Anchors go in blocks; a block
   meets a bucket in one task of bounded size, and no more than an anchor's best rows come back.
   Nothing depends on how many rows share a label.
3. Positives are the ``n_positive`` rows of the anchor's label with the highest products. Each positive
   asks for rows of other labels whose product lies within ``low`` and ``high`` hundredths of its
   own: a window whose lower end is theta until its places are taken.

Vectors are whole numbers, floor(scale * x), and products are exact: in doubles where lengths prove
that every partial sum is below 2**53, in Python's integers elsewhere. A product beyond a long is
an error.

Defined results: rows with a null label, a null vector, or a component that is null or not finite (or
not so once scaled) take no part. A vector without components has product 0 with all; shorter
vectors are filled up with 0. Rows that repeat are rows; an anchor is no other row of itself.
Equal products go by ascending id, then by the row's place. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, with_row
from tallyframe.operators.ordering import running
from tallyframe.session import materialize

EXACT = float(1 << 53)
GROWTH = 4
ASKS = "array<struct<slot:int,low:bigint,high:bigint>>"


def prepared(rows: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label, __row and scaled (doubles) of the rows that take part."""
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    read = with_row(rows.select(F.col(id_col).alias("id"), label.cast("long").alias("label"), scaled.alias("scaled")))
    sound = F.forall("scaled", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return read.where(F.col("label").isNotNull() & F.col("scaled").isNotNull() & sound)


def whole(lists: pa.Array, width: int) -> np.ndarray:
    """The floors of Arrow lists as rows of ``width`` doubles."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out)


def lengths(m: np.ndarray) -> np.ndarray:
    most = np.abs(m).max(axis=1, initial=0.0)
    scaled = m / np.where(most > 0, most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt((scaled * scaled).sum(axis=1)) * (1 + 1e-12), np.finfo(float).max)


def smallest(m: np.ndarray) -> tuple[str, bytes]:
    """The name of the smallest type that holds the numbers, and their bytes in it."""
    most = np.abs(m).max(initial=0.0)
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"
    return kind, m.astype(kind).tobytes()


def with_vectors(rows: DataFrame, width: int) -> DataFrame:
    """The rows with ``v`` (whole numbers as bytes of doubles) and ``long`` (their length) for ``scaled``."""
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, label, row, scaled in column_lists(batches, "id", "label", ROW, "scaled"):
            m = whole(scaled, width)
            yield pa.RecordBatch.from_arrays([ids, label, row, pa.array([x.tobytes() for x in m], pa.binary()), pa.array(lengths(m))], ["id", "label", ROW, "v", "long"])

    return rows.select("id", "label", ROW, "scaled").mapInArrow(task, f"id {kind}, label long, {ROW} long, v binary, long double")


def build_index(vectors: DataFrame, width: int, bucket_rows: int) -> DataFrame:
    """Buckets, one a row, numbered by falling length: bucket, n, most (the greatest length), ids, labels,
    rows, and as bytes the vectors (n by width, of type ``kind``) and the sorted lists (width by n places)."""
    id_kind = vectors.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = count(TaskContext.get().partitionId() << 32), [], 0

        def bucket(t: pa.Table) -> pa.RecordBatch:
            m = np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(t.num_rows, width)
            long = t["long"].to_numpy()
            order = np.argsort(m / np.where(long > 0, long, 1)[:, None], axis=0, kind="stable").T
            kind, raw = smallest(m)
            lists = [pa.array([t[c].to_pylist()], pa.list_(t.schema.field(c).type)) for c in ("id", "label", ROW)]
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)]), pa.array([t.num_rows]), pa.array([float(long.max(initial=0.0))]), *lists, pa.array([kind]), pa.array([raw], pa.binary()), pa.array([order.astype(np.int32).tobytes()], pa.binary())],
                ["bucket", "n", "most", "ids", "labels", "rows", "kind", "vectors", "order"],
            )

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, bucket_rows - size))
                size, batch = size + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if size == bucket_rows:
                    yield bucket(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield bucket(pa.Table.from_batches(held))

    by = [F.desc("long"), F.xxhash64(ROW)]  # equal lengths are parted too
    buckets = vectors.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(task, f"bucket long, n long, most double, ids array<{id_kind}>, labels array<long>, rows array<long>, kind string, vectors binary, order binary")
    buckets = materialize(buckets, "lemp-buckets")
    places = materialize(running(buckets.select("bucket"), [], ["bucket"], row_number="at"), "lemp-places")  # a number a bucket
    return buckets.join(places, "bucket")


def feasible(cosine: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that a coordinate of a unit vector may have if its cosine with one whose coordinate
    is ``value`` is at least ``cosine``; a little wider for rounding."""
    tau, alpha = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(value, -1, 1))
    return np.cos(np.minimum(np.pi, alpha + tau)) - 1e-9, np.cos(np.maximum(0, alpha - tau)) + 1e-9


def products(m: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of the rows of ``m`` with those of ``q``."""
    if bound < EXACT:
        return m @ q.T
    exact = np.array([[int(x) for x in r] for r in m], object) @ np.array([[int(x) for x in r] for r in q], object).T
    if max(abs(x) for x in exact.flat) >= 1 << 63:
        raise OverflowError("an inner product does not fit a long")
    return exact


class Bucket:
    """One row of the index, and what an anchor finds in it."""

    def __init__(self, b: dict, width: int):
        n = b["n"]
        self.m = np.frombuffer(b["vectors"], b["kind"]).reshape(n, width).astype(np.float64)
        self.most, self.ids = b["most"], b["ids"]
        self.labels, self.rows = np.array(b["labels"], np.int64), np.array(b["rows"], np.int64)
        long = lengths(self.m)
        self.unit = self.m / np.where(long > 0, long, 1)[:, None]
        self.order = np.frombuffer(b["order"], np.int32).reshape(width, n)
        self.lists = np.take_along_axis(self.unit.T, self.order.astype(np.int64), axis=1)

    def candidates(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        """Places whose focus coordinates all lie in their ranges: the shortest range of a sorted list,
        cut by the others. None if no range leaves anything out."""
        spans = []
        for f, a, b in zip(focus.tolist(), low.tolist(), high.tolist()):
            first, last = np.searchsorted(self.lists[f], (a, b)).tolist()
            if last - first < len(self.m):
                spans.append((last - first, f, first, last, a, b))
        if not spans:
            return None
        _, f, first, last, _, _ = min(spans)
        picked = self.order[f, first:last]
        for _, other, _, _, a, b in spans:
            if other != f:
                x = self.unit[picked, other]
                picked = picked[(x >= a) & (x < b)]
        return picked

    def best(self, score: np.ndarray, at: np.ndarray, asks: list[dict], k: int) -> Iterator[tuple]:
        """slot, id, row and score of the ``k`` best of each ask."""
        for x in asks:
            fit = np.ones(len(score), bool)
            if x["low"] is not None:
                fit &= score >= x["low"]
            if x["high"] is not None:
                fit &= score <= x["high"]
            fit = np.flatnonzero(fit)
            if len(fit) > 4 * k and score.dtype != object:  # the k-th best score and what equals it
                of = score[fit]
                fit = fit[of >= np.partition(of, len(of) - k)[len(of) - k]]
            key = lambda i: (-score[i], (e := self.ids[at[i]]) is None, 0 if e is None else e, self.rows[at[i]])
            for i in sorted(fit.tolist(), key=key)[:k]:
                yield x["slot"], self.ids[at[i]], int(self.rows[at[i]]), int(score[i])


def asked(bucket: Bucket, q: np.ndarray, rows: list[int], labels: np.ndarray, asks: list[list[dict]], same: bool, k: int, focus: int) -> Iterator[tuple]:
    """What a block of anchors finds in a bucket: a_row, slot, id, row, score."""
    long = lengths(q)
    theta = np.array([-np.inf if any(x["low"] is None for x in of) else min(x["low"] for x in of) for of in asks], float)
    limit = long * bucket.most
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(theta > 0, theta / limit, -1.0)
    top = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :focus]
    low, high = feasible(cosine[:, None], np.take_along_axis(q, top, axis=1) / np.where(long > 0, long, 1)[:, None])
    unpruned = []

    def found(i: int, at: np.ndarray, score: np.ndarray) -> Iterator[tuple]:
        fit = bucket.labels[at] == labels[i] if same else bucket.labels[at] != labels[i]
        if theta[i] > -np.inf:
            fit &= (score >= theta[i]).astype(bool)
        if same:
            fit &= bucket.rows[at] != rows[i]
        for got in bucket.best(score[fit], at[fit], asks[i], k):
            yield rows[i], *got

    for i in np.flatnonzero(~(cosine > 1 + 1e-9)).tolist():
        at = bucket.candidates(top[i], low[i], high[i]) if cosine[i] > -1 else None
        if at is None:
            unpruned.append(i)
        elif len(at):
            yield from found(i, at, products(bucket.m[at], q[i : i + 1], limit[i])[:, 0])
    every = np.arange(len(bucket.m))
    for a in range(0, len(unpruned), 128):
        some = unpruned[a : a + 128]
        score = products(bucket.m, q[some], float(limit[some].max())).T
        for i, of in zip(some, np.ascontiguousarray(score)):
            yield from found(i, every, of)


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), ROW)


def largest(index: DataFrame, anchors: DataFrame, width: int, same: bool, k: int, focus: int, block: int) -> DataFrame:
    """For each place that an anchor asks for the ``k`` best rows: a_row, slot, id, __row, score, rank.

    ``anchors``: a_row, a_label, v and asks (slot, low, high: products from low to high; null: no
    bound), of rows with the anchor's label (but not itself), or of those with other labels."""
    n_anchors, n_buckets = anchors.count(), index.count()
    n_blocks = max(1, -(-n_anchors // block))
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"a_row long, slot int, id {id_kind}, {ROW} long, score long"
    id_type = pa.schema(index.select(F.element_at("ids", 1).alias("id")).limit(0).toArrow().schema).field("id").type

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            q = np.frombuffer(b"".join(left["v"].to_pylist()), np.float64).reshape(left.num_rows, width)
            for b in right.to_pylist():
                out += asked(Bucket(b, width), q, left["a_row"].to_pylist(), left["a_label"].to_numpy(), left["asks"].to_pylist(), same, k, focus)
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), id_type, pa.int64(), pa.int64()))], ["a_row", "slot", "id", ROW, "score"])

    best = anchors.sparkSession.createDataFrame([], schema + ", rank int")
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("a_row"), F.lit(n_blocks)).cast("int"))
    first, many = 1, 1
    while first <= n_buckets and n_anchors:
        last = min(n_buckets, first + many - 1)
        full = best.where(F.col("rank") == k).groupBy("a_row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("__full"))  # an entry a slot
        raised = F.transform("asks", lambda x: F.struct(x["slot"].alias("slot"), F.greatest(x["low"], F.col("__full")[x["slot"]]).alias("low"), x["high"].alias("high")))
        left = dealt.join(full, "a_row", "left").select("block", "a_row", "a_label", "v", F.when(F.col("__full").isNull(), F.col("asks")).otherwise(raised).alias("asks"))
        left = left.withColumn("at", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        right = index.where(F.col("at").between(first, last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        found = left.groupBy("block", "at").cogroup(right.groupBy("block", "at")).applyInArrow(meet, schema)
        best = materialize(best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(in_order("a_row", "slot"))).where(F.col("rank") <= k), "lemp-best")
        first, many = last + 1, GROWTH * many
    return best


def mine(rows: DataFrame, is_anchor: Column, label: Column, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, scale: int = 256, focus: int = 4, bucket_rows: int = 8192, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and the rows of the three
    (__row, __positive, __negative). ``is_anchor`` is a condition on ``id``; ``label`` an expression over
    ``rows``."""
    held = prepared(rows, scale, id_col, vector_col, label)
    width = held.agg(F.coalesce(F.max(F.size("scaled")), F.lit(0))).first()[0]
    vectors = materialize(with_vectors(held, width), "lemp-vectors")
    index = build_index(vectors, width, bucket_rows)
    anchors = vectors.where(is_anchor).select(F.col("id").alias("anchor_id"), F.col(ROW).alias("a_row"), F.col("label").alias("a_label"), "v")
    anything = F.expr(f"CAST(array(named_struct('slot', 0, 'low', NULL, 'high', NULL)) AS {ASKS})")
    near = largest(index, anchors.withColumn("asks", anything), width, True, n_positive, focus, block)
    positives = near.select("a_row", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col(ROW).alias("__positive"), F.col("score").alias("positive_score"))
    # low <= 100 * negative / positive <= high, in whole numbers; below 0 no product fits
    window = F.expr(f"struct(slot, CAST((CAST(positive_score AS DECIMAL(20,0)) * {low} + 99) div 100 AS BIGINT) AS low, CAST((CAST(positive_score AS DECIMAL(20,0)) * {high}) div 100 AS BIGINT) AS high)")
    asks = positives.where("positive_score >= 0").groupBy("a_row").agg(F.collect_list(window).cast(ASKS).alias("asks"))  # one a positive
    far = largest(index, materialize(anchors.join(asks, "a_row"), "lemp-anchors"), width, False, n_negative, focus, block)
    far = far.select("a_row", "slot", "rank", F.col("id").alias("negative_id"), F.col(ROW).alias("__negative"), F.col("score").alias("negative_score"))
    out = far.join(positives, ["a_row", "slot"]).join(anchors.select("a_row", "anchor_id"), "a_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("a_row").alias(ROW), "__positive", "__negative")
