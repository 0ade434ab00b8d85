"""Suffix-array dedup: removes every byte that a repeated string of ``window`` bytes covers.

Which suffixes must meet. A suffix array needs all places that may share a ``window``-byte string in
one shard. Every string of that length has a key: the least hash among its ``gram``-byte substrings. Equal
strings have equal keys, so shards are dealt by key, and a key that occurs once in the corpus cannot
be the key of a repeated string. A document is cut into segments, the longest stretches of string
starts with one key; only segments of keys that occur twice are sorted.

1. Each document's keys are written once, and counted over the corpus.
2. Documents get back their repeated keys and give their segments; a task sends each distinct
   segment once, with its count.
3. Shards of whole keys are sorted by induced sorting in stretches of bounded size, and permuted
   common prefixes of ``window`` or more mark the repeated strings (see ``suffix_array``). A distinct segment
   that occurs twice is repeated as a whole, and a key whose only segment it is needs no sorting.
4. A key whose distinct segments may exceed ``shard_bytes`` is too large for a task (``large_keys``;
   copies of one segment are sent once a task and count nothing). Its strings are dealt anew one by
   one, by their 128-bit digests, and counted.
5. The marked ranges go back to the documents, by segment.

Texts are handled as UTF-8 bytes, and strings are judged on the input. Defined results: null is
empty; texts shorter than ``window`` lose nothing. Rows that repeat are repeated texts. Null ids
stay null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, identified, utf8_values
from tallyframe.llm.suffix_array import permuted_prefixes, suffix_array
from tallyframe.session import materialize

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(2 * n, BASE, np.uint64))
                self.down = np.cumprod(np.full(2 * n, pow(BASE, -1, 1 << 64), np.uint64))
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def prefix_sums(raw: bytes, powers: Powers) -> np.ndarray:
    """Sums of the bytes times powers of the base: the hash of any stretch is a difference of two."""
    up, _ = powers.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def gram_hashes(sums: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte substring."""
    return mixed((sums[gram:] - sums[:-gram]) * powers.to(len(sums))[1][: len(sums) - gram])


def sliding(a: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each stretch of n."""
    k = 1
    while 2 * k <= n:
        a, k = pick(a[:-k], a[k:]), 2 * k
    return pick(a[: len(a) - (n - k)], a[n - k :]) if k < n else a


def string_keys(raw: bytes, window: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each ``window``-byte string, the hashes of all grams, and the prefix sums."""
    sums = prefix_sums(raw, powers)
    h = gram_hashes(sums, gram, powers)
    return sliding(h, window - gram + 1), h, sums


def key_places(raw: bytes, window: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a text, at how many places each is a key's gram, and the bytes of its segments
    with a digest of them."""
    keys, h, sums = string_keys(raw, window, gram, powers)
    reach = window - gram
    ends = np.concatenate([np.zeros(reach, np.uint64), keys, np.zeros(reach, np.uint64)])
    is_key = h == sliding(ends, reach + 1, np.maximum)
    found, n = np.unique(h[is_key], return_counts=True)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(keys)) + (window - 1)
    order = np.argsort(keys[first], kind="stable")
    first, last = first[order], last[order]
    group = np.flatnonzero(np.append(True, keys[first][1:] != keys[first][:-1]))
    digest = mixed((sums[last] - sums[first]) * powers.to(len(sums))[1][first])
    return found, n, np.add.reduceat(last - first, group), np.add.reduceat(digest, group)


def segments(raw: bytes, keys: np.ndarray, wanted: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, number of string starts, key) of each stretch of one key of ``wanted`` (sorted)."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(keys))
    at = np.searchsorted(wanted, keys[starts])
    found = wanted[np.minimum(at, len(wanted) - 1)] == keys[starts]
    for a, b, k in zip(starts[found].tolist(), ends[found].tolist(), keys[starts[found]].view(np.int64).tolist()):
        for s in range(a, b, most):
            yield s, min(most, b - s), k


def repeated_starts(texts: list[bytes], window: int) -> list[np.ndarray]:
    """For each text, which string starts occur elsewhere among the texts (or in itself)."""
    sizes = np.array([len(x) + 1 for x in texts])
    t = np.empty(sizes.sum() + 1, np.uint16)
    t[:-1] = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8)
    t += 2
    ends = np.cumsum(sizes)
    t[ends - 1] = 1  # parts the texts; lower than every byte
    t[-1] = 0
    order = suffix_array(t, 258)
    shared = permuted_prefixes(t, order, window) >= window
    hit = shared.copy()
    upper = order[1:][shared[order[1:]]]
    before = np.empty(len(t), np.int32)
    before[order[1:]] = order[:-1]
    hit[before[upper]] = True
    return [hit[e - n : e - n + max(0, n - window)] for e, n in zip(ends.tolist(), sizes.tolist())]


def ranges(hit: np.ndarray) -> list[dict]:
    """Runs of True as ranges."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def keys_of(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each text and key: __row, key, n (places), bytes and digest (of its segments there)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for row, text in column_lists(batches, ROW, "text"):
            out = [(r, *key_places(raw, window, gram, powers)) for r, raw in zip(row.to_pylist(), utf8_values(text)) if len(raw) >= window]
            if out:
                row, *columns = zip(*out)
                key, n, size, digest = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, list(map(len, columns[0])))), *map(pa.array, (key.view(np.int64), n, size, digest.view(np.int64)))], [ROW, "key", "n", "bytes", "digest"])

    return rows.select(ROW, "text").mapInArrow(task, f"{ROW} long, key long, n long, bytes long, digest long")


def large_keys(keys: DataFrame, shared: DataFrame, window: int, gram: int, shard_bytes: int) -> DataFrame:
    """Keys whose distinct segments may exceed ``shard_bytes``: of keys with so many places that they
    could, the bytes of each distinct set of segments that a text has."""
    many = shared.where(F.col("n") * (2 * window - gram) > shard_bytes).select("key")
    per_set = keys.join(many, "key", "left_semi").groupBy("key", "digest").agg(F.max("bytes").alias("bytes"))
    return per_set.groupBy("key").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > shard_bytes).select("key")


def segments_of(marked: DataFrame, window: int, gram: int, held_bytes: int = 16 << 20) -> DataFrame:
    """Rows of two kinds: places (row, start, long, sid) and, once a task and segment, texts (key,
    sid, text, n). ``marked``: doc_id, row, text, keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        texts: dict[bytes, list] = {}
        held = 0
        names = [ROW, "start", "long", "sid", "key", "text", "n"]

        def sent() -> pa.RecordBatch:
            none = pa.nulls(len(texts), pa.int64())
            key, text, n = zip(*texts.values())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int32()), pa.array(list(texts), pa.binary()), pa.array(key, pa.int64()), pa.array(text, pa.binary()), pa.array(n, pa.int64())], names)

        for row, text, wanted in column_lists(batches, ROW, "text", "keys"):
            places = []
            for r, raw, of in zip(row.to_pylist(), utf8_values(text), wanted):
                keys, _, _ = string_keys(raw, window, gram, powers)
                sorted_keys = np.sort(of.values.to_numpy().view(np.uint64))
                for start, long, key in segments(raw, keys, sorted_keys, window - gram + 1):
                    part = raw[start : start + long + window - 1]
                    sid = hashlib.blake2b(part, digest_size=16).digest()
                    places.append((r, start, long, sid))
                    if (known := texts.get(sid)) is None:
                        texts[sid] = [key, part, 1]
                        held += len(part)
                    else:
                        known[2] += 1
                if held > held_bytes:
                    yield sent()
                    texts, held = {}, 0
            if places:
                r, start, long, sid = zip(*places)
                none = pa.nulls(len(places), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(start, pa.int32()), pa.array(long, pa.int32()), pa.array(sid, pa.binary()), none, pa.nulls(len(places), pa.binary()), none], names)
        if texts:
            yield sent()

    return marked.mapInArrow(task, f"{ROW} long, start int, long int, sid binary, key long, text binary, n long")


def sorted_hits(texts: DataFrame, window: int, stretch: int) -> DataFrame:
    """sid and the ranges of string starts that repeat, from texts (key, sid, text, n) dealt by key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, list]] = []
        pool: list[tuple[bytes, bytes, int]] = []  # of whole keys: sid, text, n
        group: dict[bytes, list] = {}
        size, at = 0, None

        def whole(text: bytes) -> list[dict]:
            return [{"a": 0, "b": len(text) - window + 1}]

        def end_group() -> None:
            nonlocal size
            if len(group) == 1 and (one := next(iter(group.items())))[1][1] > 1:
                out.append((one[0], whole(one[1][0])))
            else:
                for sid, (text, n) in group.items():
                    pool.append((sid, text, n))
                    size += len(text)
            group.clear()

        def sort_pool() -> None:
            nonlocal size
            for (sid, text, n), hit in zip(pool, repeated_starts([p[1] for p in pool], window)):
                if found := whole(text) if n > 1 else ranges(hit):
                    out.append((sid, found))
            pool.clear()
            size = 0

        def sent() -> pa.RecordBatch:
            sids, found = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(found, RANGES)], ["sid", "hits"])

        for cols in column_lists(batches, "key", "sid", "text", "n"):
            for key, sid, text, n in zip(*(c.to_pylist() for c in cols)):
                if key != at:
                    end_group()
                    at = key
                    if size > stretch:
                        sort_pool()
                if sid in group:
                    group[sid][1] += n
                else:
                    group[sid] = [text, n]
            if out:
                yield sent()
        end_group()
        if pool:
            sort_pool()
        if out:
            yield sent()

    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(task, "sid binary, hits array<struct<a:int,b:int>>")


def counted_hits(texts: DataFrame, window: int) -> DataFrame:
    """The same for keys too large for a task: each string by its digest, counted over all."""
    texts = texts.groupBy("sid").agg(F.first("text").alias("text"), F.sum("n").alias("n"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in column_lists(batches, "sid", "text", "n"):
            for sid, text, n in zip(*(c.to_pylist() for c in cols)):
                starts = len(text) - window + 1
                digests = [hashlib.blake2b(text[i : i + window], digest_size=16).digest() for i in range(starts)]
                yield pa.RecordBatch.from_arrays([pa.array([sid] * starts, pa.binary()), pa.array(range(starts), pa.int32()), pa.array(digests, pa.binary()), pa.array([n] * starts, pa.int64())], ["sid", "at", "string", "n"])

    strings = texts.mapInArrow(task, "sid binary, at int, string binary, n long")
    repeated = strings.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    return strings.join(repeated, "string", "left_semi").groupBy("sid").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("hits"))  # one a start of a segment


def repeats(docs: DataFrame, window: int = 200, gram: int = 40, stretch: int = 2 << 20, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __row, text and spans (byte ranges to remove, merged, in order; null: none)."""
    rows = identified(docs, id_col, text_col)
    keys = materialize(keys_of(rows, window, gram), "repeats-keys")
    shared = materialize(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "repeats-shared")
    # without the hint a small table of keys would be sent to all tasks and a large one would not
    marks = materialize(keys.select(ROW, "key").join(shared.select("key").hint("shuffle_hash"), "key", "left_semi").groupBy(ROW).agg(F.collect_list("key").alias("keys")), "repeats-marks")  # a text's own keys
    # The texts are dealt by row once: this join and the last one have the same left side, and Spark
    # uses its exchange for both. Segments are cut anew for each of their two uses.
    found = segments_of(rows.join(marks, ROW).select("doc_id", ROW, "text", "keys"), window, gram)
    texts = found.where("text IS NOT NULL").select("key", "sid", "text", "n")
    large = materialize(large_keys(keys, shared, window, gram, shard_bytes), "repeats-large")
    if large.isEmpty():
        hits = sorted_hits(texts, window, stretch)
    else:
        hits = sorted_hits(texts.join(large, "key", "left_anti"), window, stretch).unionByName(counted_hits(texts.join(large, "key", "left_semi"), window))
    places = found.where("text IS NULL").select(ROW, "start", "sid")
    marked = places.join(hits, "sid").select(ROW, F.transform("hits", lambda h: F.struct((h["a"] + F.col("start")).alias("a"), (h["b"] + F.col("start") + (window - 1)).alias("b"))).alias("spans"))
    spans = marked.groupBy(ROW).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return rows.join(spans, ROW, "left")


def removed(docs: DataFrame, **names) -> DataFrame:
    """doc_id, __row, kept (the bytes left), n_bytes, n_removed and n_spans for every row."""
    found = repeats(docs, **names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, text, spans in column_lists(batches, "doc_id", ROW, "text", "spans"):
            kept, counts = [], []
            for raw, of in zip(utf8_values(text), spans.to_pylist()):
                parts, at, gone, runs = [], 0, 0, 0
                for s in of or ():
                    if s["b"] <= at and runs:
                        continue
                    if s["a"] > at or not runs:
                        parts.append(raw[at : s["a"]])
                        runs += 1
                        at = s["a"]
                    gone += s["b"] - at
                    at = s["b"]
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                counts.append((len(raw), gone, runs))
            columns = (pa.array(c, pa.int64()) for c in zip(*counts))
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(kept, pa.binary()), *columns], ["doc_id", ROW, "kept", "n_bytes", "n_removed", "n_spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", ROW, "text", "spans").mapInArrow(task, f"doc_id {kind}, {ROW} long, kept binary, n_bytes long, n_removed long, n_spans long")
