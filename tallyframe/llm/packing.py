"""Packing: order-preserving dynamic programming over window cuts.

The documents of an input split, in their order, form one stream of token ids. A sequence is a
window of at most ``size`` ids of that stream. Cuts are allowed at ends of documents (free), at
ends of sentences (``SENTENCE``) and, inside a sentence that runs long, every ``STRIDE`` ids
(``INSIDE``). The chosen cuts minimise padding plus these penalties:

    best[j] = pen[j] + size - at[j] + min over i with at[j] - at[i] <= size of (best[i] + at[i])

whose minimum runs over a sliding window, so a monotone queue gives each cut in constant time.

Splits need no shuffle and do not talk to each other; a task keeps one stretch of about
``stretch`` ids, and the last, unfinished window goes on into the next stretch. A document longer
than a stretch is one stretch. Sequence ids are the split's number and a count in it.

Defined results: a null text is empty and still has its closing id. Rows that repeat are packed
each. Null ids stay null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column_lists, kept_in_process

#: The id that closes a document; penalties of a cut, in ids of padding.
CLOSING = 1
SENTENCE, INSIDE, STRIDE = 2, 16, 16


class Encoder:
    """Ids of texts by a tokenizer file that parts texts at white space and parts letters from
    other characters, lower-cases, and marks the last token of each part with ``</w>``.

    Texts are cut at spaces and line feeds, and the distinct pieces of a batch are looked at once. A
    piece of plain letters between marks is three parts, two of them mostly empty; any other piece
    (other alphabets, digits, marks that combine) is one part that the tokenizer gets as it is. New
    parts of letters or marks are encoded together as one text that is cut at the marks.

    Ids of parts are remembered in two generations of ``most`` parts: when the younger is full it
    becomes the older, and parts of the older that come up again are taken over. So memory is bounded
    and parts that go on coming up are never forgotten."""

    MARKS = r"[!-&(-/:;=-@\[-`{-~]*"  # ASCII but the apostrophe, and < which opens special tokens
    LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]*"
    PLAIN = rf"^(?P<head>{MARKS})(?P<word>{LETTERS})(?P<tail>{MARKS})$"

    def __init__(self, vocabulary: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(vocabulary, encoding="utf-8") as f:
            plain = json.load(f)
        # the same model for parts that need neither lower-casing nor parting any more
        plain |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.tokenizer, self.plain, self.most = Tokenizer.from_file(vocabulary), Tokenizer.from_str(json.dumps(plain)), most
        vocab = plain["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 3, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, plain: list[str], other: list[str]) -> None:
        for a in range(0, len(plain), 1000):
            some = plain[a : a + 1000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark the ends of words")
            raw = ids.tobytes()
            self.young.update((w, raw[4 * s : 4 * e]) for w, s, e in zip(some, [0, *ends[:-1].tolist()], ends.tolist()))
        for a in range(0, len(other), 1000):
            some = other[a : a + 1000]
            self.young.update((p, np.array(got.ids, np.uint32).tobytes()) for p, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))

    def _ids_of(self, parts: list[str], plain: int) -> list[bytes]:
        """The ids of distinct parts, of which the first ``plain`` are of letters or marks."""
        if len(self.young) > self.most:
            self.young, self.old = {"": b""}, self.young
        found = list(map(self.young.get, parts))
        missing = [i for i, f in enumerate(found) if f is None]
        new = []
        for i in missing:
            if (known := self.old.get(parts[i])) is None:
                new.append(i)
            else:
                self.young[parts[i]] = known
        self._learn([parts[i] for i in new if i < plain], [parts[i] for i in new if i >= plain])
        for i in missing:
            found[i] = self.young[parts[i]]
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        one = pieces.dictionary
        three = pc.extract_regex(one, self.PLAIN)
        is_plain = three.is_valid().to_numpy(zero_copy_only=False)
        whole = three.filter(three.is_valid())
        parts = pa.concat_arrays([whole.field("head"), pc.utf8_lower(whole.field("word")), whole.field("tail")]).dictionary_encode()
        other = one.filter(pc.invert(three.is_valid()))
        of = np.zeros((len(one), 3), np.int64)  # the parts of each distinct piece; the first part of all is the empty one
        strings = lambda a: a.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  a third of to_pylist's time
        distinct = ["", *strings(parts.dictionary)]
        of[is_plain] = parts.indices.to_numpy().reshape(3, -1).T + 1
        of[~is_plain, 0] = len(distinct) + np.arange(len(other))
        ids = self._ids_of(distinct + strings(other), len(distinct))
        pool = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        used = of[pieces.indices.to_numpy()].ravel()
        used = used[size[used] > 0]
        n = size[used]
        upto = np.cumsum(n)
        flat = pool[np.repeat(start[used] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        per_piece = size[of].sum(axis=1)[pieces.indices.to_numpy()]
        ends = np.append(0, np.cumsum(per_piece))[cut.offsets.to_numpy()]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def ids(self, texts: list[str], stretch: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, encoded in batches of about ``stretch`` characters; longer texts are
        cut at spaces."""
        batch, held = [], 0
        for text in texts:
            if len(text) > stretch:
                yield from self(batch)
                batch, held, a, found = [], 0, 0, []
                while a < len(text):
                    b = text.find(" ", a + stretch)
                    b = len(text) if b < 0 else b
                    found += self([text[a:b]])
                    a = b + 1
                yield np.concatenate(found)
                continue
            batch.append(text)
            held += len(text)
            if held >= stretch:
                yield from self(batch)
                batch, held = [], 0
        yield from self(batch)


def sentence_ends(vocabulary: str) -> np.ndarray:
    """True at the ids of tokens that close a sentence."""
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 3, bool)
    ends[[i for token, i in vocab.items() if (bare := token.removesuffix("</w>")) and not bare.strip(".!?")]] = True
    return ends


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut (0 and its end among them) and their penalties."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[np.flatnonzero(ends[ids]) + 1] = SENTENCE
    penalty[doc_ends] = 0
    penalty[[0, len(ids)]] = 0
    sure = np.flatnonzero(penalty >= 0)
    for a, b in zip(sure[:-1][(long := np.diff(sure) > STRIDE)], sure[1:][long]):
        penalty[a + STRIDE : b : STRIDE] = INSIDE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """The chosen places, first and last of ``at`` among them."""
    at_l, pen_l = at.tolist(), penalty.tolist()
    before = [0] * len(at_l)
    queue: deque[tuple[int, int, int]] = deque([(at_l[0], at_l[0], 0)])  # best + at, at, index; best + at rises
    for j in range(1, len(at_l)):
        here = at_l[j]
        while queue[0][1] < here - size:
            queue.popleft()
        least, _, i = queue[0]
        before[j] = i
        value = least + size + pen_l[j]  # best[j] + at[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    cuts, j = [at_l[-1]], len(at_l) - 1
    while j:
        j = before[j]
        cuts.append(at_l[j])
    return cuts[::-1]


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, stretch: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = kept_in_process("token ids", vocabulary, lambda: (Encoder(vocabulary), sentence_ends(vocabulary)))
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[object, int, int, np.ndarray]] = []  # id, ids before these, ids of the document, these
        total = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, total, sequence
            ids = np.concatenate([h[3] for h in held])
            bounds = np.cumsum([0] + [len(h[3]) for h in held])
            at, penalty = cut_points(ids, bounds[1:], ends, size)
            cuts = best_cuts(at, penalty, size)
            if not last and len(cuts) > 2:
                cuts.pop()  # the last window goes on
            marks = np.unique(np.concatenate([cuts, bounds[bounds <= cuts[-1]]]))
            a, b = marks[:-1], marks[1:]
            doc = np.searchsorted(bounds, a, "right") - 1
            window = np.searchsorted(cuts, a, "right") - 1
            start = a - bounds[doc] + np.array([h[1] for h in held])[doc]
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
            owner = pa.array([held[d][0] for d in doc.tolist()], id_type)
            columns = start, b - a, crc, np.array([h[2] for h in held])[doc], sequence + window, a - np.array(cuts)[window]
            yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])
            sequence += len(cuts) - 1
            left = cuts[-1]
            held = [(h[0], h[1] + max(0, left - lo), h[2], h[3][max(0, left - lo) :]) for h, lo in zip(held, bounds.tolist()) if lo + len(h[3]) > left]
            total = sum(len(h[3]) for h in held)

        id_type = None
        for doc_id, text in column_lists(batches, "doc_id", "text"):
            id_type = doc_id.type
            for key, of in zip(doc_id.to_pylist(), encode.ids(text.to_pylist())):
                ids = np.append(of, np.uint32(CLOSING))
                held.append((key, 0, len(ids), ids))
                total += len(ids)
                if total >= stretch:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return rows.mapInArrow(task, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names))
