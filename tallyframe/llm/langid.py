"""Language ID: a linear-chain conditional random field labels every word, so that code-switched
texts get a share for each language.

A word's emission sums the weights of its hashed features: prefixes and suffixes of 1 to 3
characters, character trigrams, the word itself, and the lexicons that list it (words that the
sample shows nearly always in one language). Transitions between the languages of neighbouring
words are learnt with them, by gradient steps on the exact likelihood (forward-backward).

Training takes a bounded sample (``sample`` documents of least id hash, ``pieces`` stretches of
``stretch`` words of each), one task's work. The model is at most ``2**BITS`` x languages numbers
and its lexicons; it is broadcast and every document is labelled where it lies. Texts are labelled
whole: chains of similar length go through forward-backward side by side.

Defined results: a text that is null or has no letter gives ``und`` and score 0. Null ids are
neither held out nor learnt from; null languages are not learnt from. Without any language
learnt all rows are ``und``. Ties go to the first language in string order. Rows that repeat give
the same answer. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, identified, kept_in_process
from tallyframe.llm.quality import remainder

BITS = 16
SIZE = 1 << BITS
UNKNOWN = "und"


def bare(token: str) -> str:
    """The token's lower-case form without what is no letter at its ends; empty if it has none."""
    if token.isalpha():
        return token.lower()
    at = [i for i, c in enumerate(token) if c.isalpha()]
    return token[at[0] : at[-1] + 1].lower() if at else ""


FIXED = 8  # features of every word beside its trigrams
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Features:
    """Hashed features of ``words``: ``fixed`` (three prefixes, three suffixes, the word, its lexicon;
    ``SIZE`` for none) and ``grams``, the character trigrams of word i from ``first[i]`` on."""

    def __init__(self, words: list[str], lexicon: dict[str, int]):
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(self.counts + 2)
        starts = ends - self.counts - 2
        self.first = np.cumsum(self.counts) - self.counts
        at = np.repeat(starts - self.first, self.counts) + np.arange(self.counts.sum())
        self.grams = self._hash(0, codes[at], codes[at + 1], codes[at + 2])
        head = [codes[np.minimum(starts + k, ends - 1)] for k in (1, 2, 3)]
        tail = [codes[np.maximum(ends - 1 - k, starts)] for k in (1, 2, 3)]
        whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
        listed = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
        named = self._hash(8, np.maximum(listed, 0).astype(np.uint64))
        self.fixed = np.stack([self._hash(1 + k, *head[: k + 1]) for k in range(3)] + [self._hash(4 + k, *tail[: k + 1]) for k in range(3)] + [self._hash(7, whole), np.where(listed < 0, SIZE, named)], axis=1)

    @staticmethod
    def _hash(kind: int, *chars: np.ndarray) -> np.ndarray:
        h = np.full(len(chars[0]), kind + 1, np.uint64) * MIX[3]
        for c, m in zip(chars, MIX):
            h = (h ^ (h >> np.uint64(29))) * m + c * MIX[2]
        return ((h ^ (h >> np.uint64(32))) * MIX[1] >> np.uint64(64 - BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.fixed].sum(axis=1) + np.add.reduceat(weights[self.grams], self.first, axis=0)


class Words:
    """Row numbers of tokens in a table of emissions, which grows as new tokens come."""

    def __init__(self, weights: np.ndarray, lexicon: dict[str, int], most: int = 200_000):
        self.weights, self.lexicon, self.most = weights, lexicon, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.emission = np.ones((0, self.weights.shape[1]), np.float32)

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text the emission rows of its tokens that have a letter."""
        fresh = list({t for tokens in texts for t in tokens}.difference(self.place))
        if fresh:
            words = [bare(t) for t in fresh]
            rows = {w: len(self.emission) + i for i, w in enumerate({w for w in words if w})}
            if rows:
                sums = Features(list(rows), self.lexicon).scores(self.weights)
                self.emission = np.concatenate([self.emission, np.exp(sums - sums.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-30)])
            self.place.update((t, rows.get(w, -1)) for t, w in zip(fresh, words))
        out = []
        for tokens in texts:
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int32, len(tokens))
            out.append(at[at >= 0])
        return out


def lockstep(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Forward-backward over chains side by side. ``emission`` is (time, chain, label), chains by
    falling length. Yields from the last step to the first (t, chains alive, their posteriors,
    forward before t or None's stand-in, backward times emission at t)."""
    steps = len(emission)
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")  # chains with length > t
    forward = np.empty_like(emission)
    for t in range(steps):
        a = alive[t]
        f = emission[t, :a] if t == 0 else (forward[t - 1, :a] @ transition) * emission[t, :a]
        forward[t, :a] = f / f.sum(axis=1, keepdims=True)
    backward = np.ones(emission.shape[1:], emission.dtype)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        posterior = forward[t, :a] * backward[:a]
        posterior /= posterior.sum(axis=1, keepdims=True)
        carried = backward[:a] * emission[t, :a]
        yield t, a, posterior, forward[t - 1, :a] if t else None, carried
        b = carried @ transition.T
        backward[:a] = b / b.sum(axis=1, keepdims=True)


def padded(rows: list[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, chain, label) emissions of chains that come by falling length."""
    lengths = np.array([len(r) for r in rows])
    at = np.zeros((lengths[0], len(rows)), np.int32)
    for c, r in enumerate(rows):
        at[: len(r), c] = r
    return table[at], lengths


def shares(rows: list[np.ndarray], words: Words, transition: np.ndarray, cells: int = 1 << 19) -> np.ndarray:
    """Mean posterior of each language over each text's words (no words: zeros)."""
    out = np.zeros((len(rows), transition.shape[0]))
    order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: -len(rows[i]))
    at = 0
    while at < len(order):
        some = order[at : at + max(1, cells // len(rows[order[at]]))]
        at += len(some)
        emission, lengths = padded([rows[i] for i in some], words.emission)
        total = np.zeros((len(some), transition.shape[0]))
        for _, a, posterior, _, _ in lockstep(emission, lengths, transition):
            total[:a] += posterior
        out[some] = total / lengths[:, None]
    return out


def stretches(text: str, stretch: int, pieces: int) -> tuple[str, str]:
    """What is learnt of a text: its distinct words, and the stretches (one a line) of its words."""
    words = [w for w in map(bare, text.split()) if w]
    starts = range(0, len(words), stretch)
    some = [starts[i] for i in np.unique(np.linspace(0, len(starts) - 1, pieces).astype(int))] if words else []
    return " ".join(dict.fromkeys(words)), "\n".join(" ".join(words[s : s + stretch]) for s in some)


def fit(words: list[str], lines: list[str], languages: list[str], epochs: int = 6, rate: float = 0.3, batch: int = 256) -> dict:
    """Weights, transitions, lexicon and languages. ``words`` and ``lines`` as by ``stretches``."""
    names = sorted(set(languages))
    label = {name: i for i, name in enumerate(names)}
    chains, gold = [], []
    counts: dict[str, Counter] = {}
    for distinct, some, language in zip(words, lines, languages):
        for w in distinct.split():
            counts.setdefault(w, Counter())[label[language]] += 1
        for line in some.split("\n") if some else []:
            chains.append(line.split())
            gold.append(label[language])
    sizes = Counter(label[x] for x in languages)
    lexicon = {}
    for w, c in counts.items():
        rates = {k: n / sizes[k] for k, n in c.items()}
        k = max(rates, key=lambda x: (rates[x], -x))
        if sum(c.values()) >= 5 and rates[k] >= 0.9 * sum(rates.values()):
            lexicon[w] = k
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    found = Features(list(vocabulary), lexicon)
    k = len(names)
    weights, squares = np.zeros((SIZE + 1, k)), np.full((SIZE + 1, k), 1e-6)  # the last row stands for no feature
    bond, bond_squares = np.eye(k), np.full((k, k), 1e-6)
    index = [np.fromiter(map(vocabulary.__getitem__, c), np.int64, len(c)) for c in chains]
    order = np.random.default_rng(11)
    for _ in range(epochs if index else 0):  # texts without a letter teach nothing
        for some in np.array_split(order.permutation(len(index)), max(1, len(index) // batch)):
            some = sorted(some, key=lambda i: -len(index[i]))
            used = np.unique(np.concatenate([index[i] for i in some]))
            counts_of = found.counts[used]
            bounds = np.cumsum(counts_of) - counts_of
            grams = found.grams[np.repeat(found.first[used] - bounds, counts_of) + np.arange(counts_of.sum())]
            sums = weights[found.fixed[used]].sum(axis=1) + np.add.reduceat(weights[grams], bounds, axis=0)
            rows = [np.searchsorted(used, index[i]) for i in some]
            emission, lengths = padded(rows, np.exp(sums - sums.max(axis=1, keepdims=True)) + 1e-30)
            right = np.array([gold[i] for i in some])
            moved, to_word = np.exp(bond), np.zeros((len(used), k))
            to_bond = np.zeros((k, k))
            for t, a, posterior, before, carried in lockstep(emission, lengths, moved):
                step = -posterior
                step[np.arange(a), right[:a]] += 1
                np.add.at(to_word, [rows[c][t] for c in range(a)], step)
                if before is not None:
                    pair = before[:, :, None] * moved[None] * carried[:, None, :]
                    to_bond -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                    np.add.at(to_bond, (right[:a], right[:a]), 1.0)
            scale = lengths.sum()
            gradient = np.zeros((SIZE + 1, k))
            np.add.at(gradient, grams, np.repeat(to_word, counts_of, axis=0) / scale)
            np.add.at(gradient, found.fixed[used].ravel(), np.repeat(to_word, FIXED, axis=0) / scale)
            gradient[SIZE] = 0
            gradient -= 1e-6 * weights
            squares += gradient**2
            weights += rate * gradient / np.sqrt(squares)
            to_bond = to_bond / scale - 1e-3 * (bond - np.eye(k))
            bond_squares += to_bond**2
            bond += 0.1 * to_bond / np.sqrt(bond_squares)
    return {"names": names, "weights": weights.astype(np.float32), "transition": np.exp(bond).astype(np.float32), "lexicon": lexicon}


def train(docs: DataFrame, learn_from: Column, sample: int = 3000, pieces: int = 4, stretch: int = 48, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(learn_from & F.expr("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bound of what is broadcast
    # One row an id, reduced in each task: an id that many rows have neither fills the sample nor the one group.
    some = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.*")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            words, lines = zip(*[stretches(t, stretch, pieces) for t in d["text"]]) if len(d) else ((), ())
            yield pd.DataFrame({"doc_id": d["doc_id"], "lang": d["lang"], "words": list(words), "lines": list(lines)})

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        return pd.DataFrame({"model": [pickle.dumps(fit(group["words"].tolist(), group["lines"].tolist(), group["lang"].tolist()))]})

    kind = some.schema["doc_id"].dataType.simpleString()
    found = some.mapInPandas(cut, f"doc_id {kind}, lang string, words string, lines string").groupBy().applyInPandas(one, "model binary").first()
    return pickle.loads(found.model) if found else None


def identify(spark: SparkSession, docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """doc_id, __row, held_out, lang_pred, score and shares (language to mean posterior) for
    every row of ``docs``. Documents whose id's remainder is ``held`` are never learnt from."""
    model = train(docs, remainder(F.col("doc_id"), folds) != held, id_col=id_col, text_col=text_col, **names)
    sent, run = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = identified(docs, id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = kept_in_process("emissions", run, lambda: Words(model["weights"], model["lexicon"])) if model else None
        for ids, row, text in column_lists(batches, "doc_id", ROW, "text"):
            values, languages, scores, parts = text.to_pylist(), [], [], []
            of: list[np.ndarray] = []
            if model:
                for a in range(0, len(values), 4000):  # chains of like length are many in a large batch
                    if len(words.place) > words.most:
                        words.forget()
                    some = [r for b in range(a, min(a + 4000, len(values)), 250) for r in words.rows([v.split() for v in values[b : b + 250]])]
                    of.extend(shares(some, words, model["transition"]))
            for i in range(len(values)):
                known = model is not None and of[i].any()
                best = int(of[i].argmax()) if known else 0
                languages.append(model["names"][best] if known else UNKNOWN)
                scores.append(min(1.0, float(of[i][best])) if known else 0.0)
                parts.append(list(zip(model["names"], of[i].tolist())) if known else [])
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(languages), pa.array(scores), pa.array(parts, pa.map_(pa.string(), pa.float64()))], ["doc_id", ROW, "lang_pred", "score", "shares"])

    found = rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROW} long, lang_pred string, score double, shares map<string,double>")
    return found.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)))
