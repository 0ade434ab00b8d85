"""Ranked lexical search by presence-mask grouping.

Queries are sets of terms; each asks for the ``k`` best documents under a whole-number BM25.

1. One pass over the documents writes posting blocks: of up to ``block_docs`` documents, for each
   query term the places of the documents that hold it and how often. Terms of no query are only
   counted. Document frequencies, their number and their length come from the blocks.
2. In a block the terms of a query are bitmaps over its documents. Turned on their side they are
   each document's presence mask, and documents of one mask form a group. A group's score is at
   most what its terms give at the highest frequency in the block and the least length in the
   group. Groups are evaluated from the highest maximum down, until ``k`` documents score more
   than the next group can.
3. A first share of the blocks gives each query a score that its ``k``-th best document reaches; in
   the other blocks groups below it are not evaluated at all. The best of all blocks are ranked.

Nothing is pruned that could be among the ``k`` best, ties included, so the ranking is exact. Equal
term sets are searched once. Term sets are sent to the tasks in blocks of ``block_bytes``; each block
of them reads the documents once.

Terms are runs of letters and digits (every character beyond ASCII among them), A-Z lower-cased.
Defined results: a null text has no term; documents without a term are not counted. An item without
a term finds nothing. Items and documents whose rows repeat count each. Equal scores go by
ascending id, null last, then by the row's place. Other columns are ignored. An empty table on either
side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, utf8_values, with_row
from tallyframe.session import materialize

#: ASCII that is no letter or digit becomes a space, A-Z becomes a-z, bytes of other characters stay.
TERMS = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(raw: bytes, stretch: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``stretch`` bytes."""
    clean, a = raw.translate(TERMS), 0
    while a < len(clean):
        b = clean.find(b" ", a + stretch)
        b = len(clean) if b < 0 else b
        yield clean[a:b].split()
        a = b


def term_sets(items: DataFrame) -> DataFrame:
    """item_id, __row and terms (distinct, sorted) of the rows (item_id, __row, text) with a term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, text in column_lists(batches, "item_id", ROW, "text"):
            found = [sorted({t for part in terms_of(raw) for t in part}) for raw in utf8_values(text)]
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(found, pa.list_(pa.binary()))], ["item_id", ROW, "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(task, f"item_id {kind}, {ROW} long, terms array<binary>").where(F.size("terms") > 0)


def set_blocks(sets: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The distinct sets (name, terms) in lists of bounded size, one at a time: hash buckets, as many
    as the total size asks for."""
    total = sets.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(count)))
    return ([(r.name, [bytes(t) for t in r.terms]) for r in dealt.where(F.col("block") == i).toLocalIterator()] for i in range(count))


BLOCK = ["n_docs", "n_terms", "ids", "rows", "n", "term", "size", "at", "tf"]


def posting_blocks(docs: DataFrame, vocabulary: dict[bytes, int], block_docs: int, block_terms: int = 1 << 21) -> DataFrame:
    """One row a block of the rows (doc_id, __row, text): n_docs and n_terms of all its documents with a
    term; ids, rows and n (terms) of those that hold a query term; for each such term (numbered from 1)
    its number of documents, their places in the block (in order) and its occurrences there."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, id_type = sent.value.get, None
        ids, rows, n, found, flat = [], [], [], [], []
        n_docs = n_terms = 0

        def block() -> pa.RecordBatch:
            size = max(1, len(ids))
            key = np.array(flat, np.int64) * size + np.repeat(np.arange(len(ids)), found)
            key, tf = np.unique(key, return_counts=True)
            term, of = np.unique(key // size, return_counts=True)
            lists = (pa.array([x], pa.list_(t)) for x, t in ((ids, id_type), (rows, pa.int64()), (n, pa.int64()), (term.tolist(), pa.int32()), (of.tolist(), pa.int32()), ((key % size).tolist(), pa.int32()), (tf.tolist(), pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *lists], BLOCK)

        for doc_id, row, text in column_lists(batches, "doc_id", ROW, "text"):
            id_type = doc_id.type
            for key, at, raw in zip(doc_id.to_pylist(), row.to_pylist(), utf8_values(text)):
                terms, before = 0, len(flat)
                for part in terms_of(raw):
                    terms += len(part)
                    flat.extend(filter(None, map(get, part)))
                n_docs += terms > 0
                n_terms += terms
                if len(flat) > before:
                    ids.append(key)
                    rows.append(at)
                    n.append(terms)
                    found.append(len(flat) - before)
                if len(ids) >= block_docs or len(flat) >= block_terms:
                    yield block()
                    ids, rows, n, found, flat = [], [], [], [], []
                    n_docs = n_terms = 0
        if n_docs:
            yield block()

    return docs.mapInArrow(task, f"n_docs long, n_terms long, ids array<{kind}>, rows array<long>, n array<long>, term array<int>, size array<int>, at array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The share of the mean length that weighs against a document, in hundredths."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 50 + 50 * n * n_docs // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Block:
    """Postings of a block, and the search of one set of terms in them."""

    def __init__(self, n: np.ndarray, term: np.ndarray, size: np.ndarray, at: np.ndarray, tf: np.ndarray, m: np.ndarray):
        ends = np.cumsum(size)
        self.m, self.at, self.impact = m, at, impact(tf, m[at])
        self.range = dict(zip(term.tolist(), zip((ends - size).tolist(), ends.tolist())))
        self.most_tf = dict(zip(term.tolist(), np.maximum.reduceat(tf, ends - size).tolist())) if len(term) else {}

    def groups(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold a term, dealt by presence mask: the documents in the order of their
        groups, where each group starts, and the masks (group by term)."""
        bits = np.zeros((len(terms), len(self.m)), bool)
        for j, t in enumerate(terms):
            a, b = self.range[t]
            bits[j, self.at[a:b]] = True
        held = np.flatnonzero(bits.any(axis=0))
        packed = np.packbits(bits[:, held], axis=0)
        words = np.zeros((-(-len(packed) // 8) * 8, len(held)), np.uint8)
        words[: len(packed)] = packed
        group = np.zeros(len(held), np.int64)
        for word in np.ascontiguousarray(words.T).view(np.uint64).T:
            seen, of = np.unique(word, return_inverse=True)
            group = np.unique(group * len(seen) + of, return_inverse=True)[1]
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(group[by]) > 0))
        docs = held[by]
        return docs, starts, bits[:, docs[starts]].T

    def scores(self, docs: np.ndarray, terms: list[int], weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for t, w in zip(terms, weights.tolist()):
            a, b = self.range[t]
            place = np.minimum(np.searchsorted(self.at[a:b], docs), b - a - 1) + a
            total += np.where(self.at[place] == docs, w * self.impact[place], 0)
        return total

    def best(self, terms: list[int], weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among the ``k`` best, if they reach ``floor``."""
        docs, starts, masks = self.groups(terms)
        least = np.minimum.reduceat(self.m[docs], starts)
        most_tf = np.array([self.most_tf[t] for t in terms], np.int64)
        bound = (masks * (weights * impact(most_tf, least[:, None]))).sum(axis=1)
        sizes = np.diff(np.append(starts, len(docs)))
        order = np.argsort(-bound, kind="stable")
        reach, done, step = np.cumsum(sizes[order]), 0, k
        found, score = [], []
        while done < len(order) and bound[order[done]] >= floor:
            upto = min(len(order), int(np.searchsorted(reach, (reach[done - 1] if done else 0) + step)) + 1)
            now = order[done:upto]
            now = now[bound[now] >= floor]
            picked = np.concatenate([docs[starts[g] : starts[g] + sizes[g]] for g in now.tolist()])
            got = self.scores(picked, terms, weights)
            found.append(picked[got >= floor])
            score.append(got[got >= floor])
            if (all_ := np.concatenate(score)).size >= k:
                floor = max(floor, int(np.partition(all_, len(all_) - k)[len(all_) - k]))
            done, step = upto, 2 * step
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, score = np.concatenate(found), np.concatenate(score)
        return found[score >= floor], score[score >= floor]


def search_blocks(blocks: DataFrame, sets: list[tuple[str, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, floors: dict[str, int]) -> DataFrame:
    """name, doc_id, __row and score: up to ``k`` documents a block and set."""
    sent = blocks.sparkSession.sparkContext.broadcast((sets, weights, floors))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, weights, floors = sent.value
        for columns in column_lists(batches, *BLOCK[2:]):
            for ids, rows, *numbers in zip(*columns):
                n, term, size, at, tf = (x.values.to_numpy() for x in numbers)
                block = Block(n, term, size, at, tf, lengths(n, n_docs, n_terms))
                keys, places = ids.values.to_pylist(), rows.values.to_numpy()
                out: list[tuple] = []
                for name, terms in sets:
                    held = [t for t in terms if t in block.range]
                    if not held:
                        continue
                    docs, score = block.best(held, weights[held], k, floors.get(name, 1))
                    if len(docs) > k:  # equal scores at the end
                        first = sorted(range(len(docs)), key=lambda i: (-score[i], (key := keys[docs[i]]) is None, key if key is not None else 0, places[docs[i]]))[:k]
                        docs, score = docs[first], score[first]
                    out += zip([name] * len(docs), docs.tolist(), score.tolist())
                if out:
                    names, docs, score = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(names), ids.values.take(pa.array(docs, pa.int32())), rows.values.take(pa.array(docs, pa.int32())), pa.array(score, pa.int64())], ["name", "doc_id", ROW, "score"])

    return blocks.select(*BLOCK[2:]).mapInArrow(task, f"name string, doc_id {kind}, {ROW} long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each set with their rank; each task passes on no more than that."""
    by = Window.partitionBy("name").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), ROW)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50, block_docs: int = 8192, block_bytes: int = 4 << 20, first_share: int = 64, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, __item (the item's row), rank, doc_id, __row and score for the ``k`` best of each item."""
    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    asked = term_sets(with_row(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))))
    asked = materialize(asked.withColumn("name", F.sha2(F.array_join(F.transform("terms", lambda t: F.hex(t)), " ").cast("binary"), 256)), "search-items")
    sets = asked.select("name", "terms").dropDuplicates(["name"])

    def against(block: list[tuple[str, list[bytes]]]) -> DataFrame:
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}), 1)}
        numbered = [(name, [vocabulary[t] for t in terms]) for name, terms in block]
        blocks = materialize(posting_blocks(rows, vocabulary, block_docs), "search-postings")
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = blocks.select(F.explode(F.arrays_zip("term", "size")).alias("t")).groupBy("t.term").agg(F.sum("t.size").alias("df"))
        weights = np.zeros(len(vocabulary) + 1, np.int64)
        for term, n in df.collect():  # at most the block's vocabulary
            weights[term] = weight(n_docs, n)
        is_first = F.pmod(F.xxhash64(F.element_at("rows", 1)), F.lit(first_share)) == 0
        held = blocks.where(F.size("ids") > 0)
        give = lambda of, floors: search_blocks(of, numbered, weights, n_docs, n_terms, k, floors)
        first = materialize(ranked(give(held.where(is_first), {}), k), "search-first")
        floors = {r.name: r.score for r in first.where(F.col("rank") == k).select("name", "score").toLocalIterator()}  # one a set of the block
        return ranked(first.drop("rank").unionByName(give(held.where(~is_first), floors)), k)

    found = [against(block) for block in set_blocks(sets, block_bytes)]
    answers = reduce(DataFrame.unionByName, found)
    return asked.select("item_id", F.col(ROW).alias("__item"), "name").join(answers, "name").select("item_id", "__item", "rank", "doc_id", ROW, "score")
