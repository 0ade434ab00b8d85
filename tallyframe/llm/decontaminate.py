"""Benchmark decontamination: texts are streamed through a generalised suffix automaton of the
normalised test items.

The items are a stated query set. They are dealt into blocks of about ``block_bytes`` (by a running
total over ordered buckets), so that what is sent to the executors has a size bound however large the
benchmark: one block is collected, broadcast, and held against all documents in one pass without
any shuffle; several blocks' findings are joined by row. Matching keeps one state and one length
a text, so that memory does not grow with the text beyond its words.

A span of the text that lies in windows is cut out (``clean``) unless the hit share of the text's
words passes ``coverage``: then the document goes.

Defined results: null texts have no words and hit nothing; an item without words has no window.
Items that repeat count once by id; an item with a null id is counted under the empty string.
Documents that repeat each get their answer. Other columns are ignored. Without items, or
without documents, nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.automaton import SuffixAutomaton
from tallyframe.llm.common import ROW, column_lists, identified, utf8_values

#: ASCII that is no word character becomes a space, A-Z becomes a-z, bytes of other characters stay.
WORDS = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: The same words where they stand in the text, before lower-casing.
PLACED = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORDS).split()


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The items in lists of bounded size, one at a time: hash buckets, as many as the total size
    asks for."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    return count, ([(r.id, bytes(r.text)) for r in dealt.where(F.col("block") == i).toLocalIterator()] for i in range(count))


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, __row, n_words, spans (array of word start and end), items (ids, sorted as strings)
    and, if asked for, ``cut`` (the text without its spans; null if it has none) for every row of
    ``docs``."""
    rows = identified(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {ROW} long, n_words long, spans array<struct<a:int,b:int>>, items array<string>, cut string"

    def against(block: list[tuple[str, bytes]], cutting: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(((key, words_of(raw)) for key, raw in sent.value), window)
            for ids, row, text in column_lists(batches, "doc_id", ROW, "text"):
                n, spans, items, cut = [], [], [], []
                for raw in utf8_values(text):
                    words = words_of(raw)
                    found, keys = automaton.stream(words)
                    n.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in found])
                    items.append(sorted(keys))
                    cut.append(without(raw, found).decode() if found and cutting else None)
                yield pa.RecordBatch.from_arrays([ids, row, pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string())), pa.array(cut, pa.string())], ["doc_id", ROW, "n_words", "spans", "items", "cut"])

        return rows.mapInArrow(task, schema)

    count, blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    found = [against(block, with_text and count == 1) for block in blocks]

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        more = right.where(F.size("spans") > 0).select(ROW, F.col("spans").alias("more_spans"), F.col("items").alias("more_items"))
        joined = left.join(more, ROW, "left")
        union = lambda c: F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"more_{c}"))
        return joined.withColumns({"spans": union("spans"), "items": F.array_sort(F.array_distinct(union("items")))}).drop("more_spans", "more_items")

    out = reduce(both, found)
    if len(found) > 1:
        out = out.withColumn("spans", merged("spans"))
        if with_text:  # only now are all spans known
            out = out.drop("cut").join(rows.select(ROW, "text"), ROW).mapInArrow(_cutting, f"{schema}")
    return out if with_text else out.drop("cut")


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, row, n_words, spans, items, text in column_lists(batches, "doc_id", ROW, "n_words", "spans", "items", "text"):
        cut = [without(raw, [(s["a"], s["b"]) for s in found]).decode() if found else None for raw, found in zip(utf8_values(text), spans.to_pylist())]
        yield pa.RecordBatch.from_arrays([ids, row, n_words, spans, items, pa.array(cut, pa.string())], ["doc_id", ROW, "n_words", "spans", "items", "cut"])


def merged(col: str):
    """Spans as disjoint runs, in order."""
    of = "array<struct<a:int,b:int>>"
    return F.aggregate(
        F.array_sort(col),
        F.array().cast(of),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= s["a"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(done, F.lit(-1))["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
    )


def n_hit(col: str = "spans"):
    return F.aggregate(col, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in PLACED.finditer(raw)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]])


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, **names) -> DataFrame:
    """__row, text (without the spans) and dropped (the share of hit words reaches
    ``coverage``) for the rows of ``docs`` that have a hit."""
    hit = hits(spark, docs, benchmark, window, with_text=True, **names).where(F.size("spans") > 0)
    return hit.select(ROW, F.col("cut").alias("text"), (n_hit() >= F.lit(coverage) * F.col("n_words")).alias("dropped"))
