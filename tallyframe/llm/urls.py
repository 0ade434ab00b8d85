"""URL filters: rules first, then naive Bayes over segmented host words and path tokens.

Word counts come from the text of every page (tags removed), by a grouped count. Words are runs of
letters of any script with their marks, of any length. A host token such as ``spamfarm`` is split by a unigram Viterbi: of all ways to cut it the likeliest, where a word of
the corpus has its relative frequency and an unseen piece a price that grows tenfold a letter. The
vocabulary is never broadcast: only the pieces of distinct host tokens are looked up in it, by a
join, and each token's own pieces (at most ``LONGEST`` a letter) come together for its Viterbi.
``LONGEST`` is the length of a label in a host name; a token above it may still be one word as a whole.

The classifier learns from the URLs that a rule decides and judges those that none does. Its counts
are kept in ``2**BITS`` hash buckets, which bounds what is broadcast; multinomial, add-one.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged by the
classifier's prior. Ties, and a classifier without any example, allow. Of rules of one length the
first wins. Rows that repeat give the same answer; null ids stay null. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, salted_left_join, with_row
from tallyframe.session import materialize

BITS = 16
LONGEST = 63
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains of it, if the URL's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parted(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWERED), F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The fitting rule of greatest length as (rule, verdict), or null."""
    fits = [(F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))) for r in sorted(rules, key=lambda r: -len(r.text))]
    return F.coalesce(*fits)


def host_tokens(host: Column) -> Column:
    return F.filter(F.split(F.lower(host), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def path_tokens(path: Column) -> Column:
    """Lower-case words; a run of digits counts by its length."""
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(words, lambda t: F.when(F.regexp_like(t, F.lit(r"^\p{N}+$")), F.concat(F.lit("#"), F.char_length(t))).otherwise(t))


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n over the text of all pages."""
    text = F.regexp_replace(F.lower(F.col(html_col)), "<[^>]*>", " ")
    return pages.select(F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def viterbi(token: str, logs: dict[str, float], unseen: float) -> list[str]:
    """The likeliest cut of ``token`` into pieces; ``logs`` are the log probabilities of its pieces
    that are words, ``unseen`` that of an unseen piece of no letters."""
    best, cut = [0.0] + [-math.inf] * len(token), [0] * (len(token) + 1)
    for end in range(1, len(token) + 1):
        for start in range(max(0, end - LONGEST), end):
            piece = token[start:end]
            value = best[start] + logs.get(piece, unseen - (end - start) * math.log(10))
            if value > best[end]:
                best[end], cut[end] = value, start
    if len(token) > LONGEST and logs.get(token, -math.inf) > best[-1]:
        return [token]
    pieces, end = [], len(token)
    while end:
        pieces.append(token[cut[end] : end])
        end = cut[end]
    return pieces[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and its words, for distinct ``hosts`` (host)."""
    parts = hosts.select("host", F.posexplode(host_tokens(F.col("host"))).alias("at", "token"))
    tokens = parts.select("token").distinct()
    starts = tokens.select("token", F.explode(F.sequence(F.lit(1), F.char_length("token"))).alias("start"))
    pieces = starts.select("token", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length("token") - F.col("start") + 1))).alias("long"), "start").select("token", F.substring("token", F.col("start"), F.col("long")).alias("word"))
    pieces = pieces.unionByName(tokens.select("token", F.col("token").alias("word")).where(F.char_length("token") > LONGEST)).distinct()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first().total
    known = pieces.join(counts, "word").groupBy("token").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))  # at most LONGEST a letter
    unseen = -math.log(max(1, total))

    @F.pandas_udf("array<string>")
    def split(token: pd.Series, words: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series(
            [viterbi(t, {} if w is None else {word: math.log(n) + unseen for word, n in zip(w, k)}, unseen) for t, w, k in zip(token, words, ns)]
        )

    cut = tokens.join(known, "token", "left").select("token", split("token", "words", "ns").alias("words"))
    return parts.join(cut, "token").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts")).select("host", F.flatten(F.col("parts.words")).alias("words"))


def bucket(token: Column) -> Column:
    return F.crc32(token.cast("binary")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def weights(examples: DataFrame) -> tuple[float, np.ndarray]:
    """The log odds of block: of a URL, and of each bucket's tokens. ``examples``: tokens, verdict."""
    urls = {r.verdict: r.n for r in examples.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # two rows
    found = examples.select("verdict", F.explode("tokens").alias("token")).groupBy(bucket(F.col("token")).alias("bucket")).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("block", "allow")])
    counts = np.zeros((2, 1 << BITS))
    for r in found.toLocalIterator():  # at most one row a bucket
        counts[:, r.bucket] = r.block, r.allow
    used = max(1, np.count_nonzero(counts.sum(axis=0)))
    block, allow = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + used)
    prior = math.log((urls.get("block", 0) + 1) / (urls.get("allow", 0) + 1))
    return prior, block - allow


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 8) -> DataFrame:
    """page_id, __row, host, path, words (segmented host, then path tokens), rule, verdict and odds
    (log odds of block by the classifier) for every row of ``pages``."""
    host, path = parted(F.col("url"))
    rows = with_row(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rows = rows.select("page_id", ROW, host.alias("host"), path.alias("path")).withColumn("fit", ruled(F.col("host"), F.col("path"), rules))
    counts = materialize(word_counts(pages, html_col), "url-words")
    words = segmented(rows.select("host").where("host <> ''").distinct(), counts)
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), path_tokens(F.col("path")))
    read = materialize(salted_left_join(rows, words, "host", F.col(ROW), salts).withColumn("tokens", tokens).drop("words"), "url-tokens")
    prior, odds = weights(read.where("fit IS NOT NULL").select("tokens", "fit.verdict"))
    sent = spark.sparkContext.broadcast(odds)
    kind = read.schema["page_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = sent.value
        for page, row, host, path, rule, verdict, tokens in column_lists(batches, "page_id", ROW, "host", "path", "rule", "verdict", "tokens"):
            totals = [prior + sum(odds[zlib.crc32(t.encode()) & (len(odds) - 1)] for t in ts) for ts in tokens.to_pylist()]
            verdicts = [v or ("block" if x > 0 else "allow") for v, x in zip(verdict.to_pylist(), totals)]
            yield pa.RecordBatch.from_arrays([page, row, host, path, tokens, rule, pa.array(verdicts), pa.array(totals, pa.float64())], ["page_id", ROW, "host", "path", "words", "rule", "verdict", "odds"])

    return read.select("page_id", ROW, "host", "path", "fit.rule", "fit.verdict", "tokens").mapInArrow(task, f"page_id {kind}, {ROW} long, host string, path string, words array<string>, rule string, verdict string, odds double")
