"""The corpus queries: each applies one operator to its whole table with production parameters.
The columns that a query returns are digests of what the operator gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, exact_dedup, langid, lexical, mixing, negatives, packing, quality, secrets, simhash, suffix_dedup, urls, warc
from tallyframe.llm.common import table
from tallyframe.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM g""")
def op1_warc(spark, sf):
    pages = table(spark, sf, "pages")
    folder = scratch_path(spark, "warc")
    index = materialize(warc.write_archives(pages, folder, least=1000), "warc-index")
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, folder, index).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


@register("op2_exact_dedup", r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)""")
def op2_exact_dedup(spark, sf):
    return exact_dedup.exact_dedup(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf):
    return suffix_dedup.removed(table(spark, sf, "documents"), window=200).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    def kind(i: int, r: secrets.Rule) -> str:
        re = _quoted(r.pattern)
        return (
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, {re}, 0) AS m, "
            f"regexp_extract_all(t, {re}, {r.group}) AS g, string_split_regex(t, {re}) AS p, {r.least} AS least "
            f"FROM d WHERE regexp_matches(t, {re})"
        )

    kinds = "\nUNION ALL ".join(kind(i, r) for i, r in enumerate(secrets.RULES))
    n_base = len(secrets.BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
s AS (SELECT doc_id, rank, kind, m[i] AS hit, g[i] AS counted, least,
             list_sum(list_transform(p[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)::BIGINT AS b FROM x),
f AS (SELECT doc_id, rank, kind, b, kind || ':' || b || ':' || (b + length(hit)) AS span FROM s WHERE length(counted) >= least),
a AS (SELECT doc_id, {sums}, string_agg(span, ',' ORDER BY b, rank) FILTER (WHERE rank < {n_base}) AS base,
             string_agg(span, ',' ORDER BY b, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


@register("op4_secret_scans", _secrets_sql())
def op4_secret_scans(spark, sf):
    found = secrets.scan_documents(spark, table(spark, sf, "documents"), scratch_path(spark, "secrets-ledger"))
    base = [r.kind for r in secrets.BASE]
    every = F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,`end`:int,rule:string>>"))
    of = lambda *kinds: F.filter(every, lambda s: s["rule"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(text(of(*base)).cast("binary"), 256).alias("base_sha256"),
        text(every).alias("spans"),
    )


@register("op5_quality")
def op5_quality(spark, sf):
    return quality.classify(spark, table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


@register("op6_packing")
def op6_packing(spark, sf):
    import public_tokenizers

    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


@register("op7_decontamination")
def op7_decontamination(spark, sf):
    found = decontaminate.hits(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@register("op8_simhash")
def op8_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=4, distance=4).select("doc_id", "fingerprint", "component_id")


@register("op9_language_id")
def op9_language_id(spark, sf):
    return langid.identify(spark, table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@register("op10_url_filters")
def op10_url_filters(spark, sf):
    return urls.judge(spark, table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register("op13_mixing", r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(place - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS full_at, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
             coalesce(sum(source_size) OVER p, 0) AS size_before, coalesce(sum(weight) OVER p, 0) AS weight_before
      FROM w WINDOW p AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, full_at < (1.5::DOUBLE * all_size - 2.0::DOUBLE * size_before) / (all_weight - weight_before) AS is_full FROM l),
o AS (SELECT coalesce(sum(source_size) FILTER (WHERE is_full), 0) AS full_size, sum(weight) FILTER (WHERE NOT is_full) AS open_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, weight * ((1.5::DOUBLE * all_size - 2.0::DOUBLE * full_size) / open_weight)) END AS target,
             coalesce('=' || source, 'null') AS name FROM f CROSS JOIN o),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.name,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 1099511627776) ELSE 0 END::HUGEINT AS parts,
             ('0x' || substr(sha256('mix|' || t.name), 1, 10))::HUGEINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, start + sum(parts) OVER (PARTITION BY name ORDER BY size DESC, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS reach FROM j)
SELECT doc_id, size, source_size, target, ((reach // 1099511627776 - (reach - parts) // 1099511627776) * size)::BIGINT AS taken FROM e""")
def op13_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


@register("op11_ranked_search", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
q AS (SELECT item_id, i, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
      FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark WHERE text IS NOT NULL)),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN c GROUP BY term),
s AS (SELECT q.item_id, q.i, p.r, p.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""")
def op11_ranked_search(spark, sf):
    return lexical.search(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50).select("item_id", "rank", "doc_id", "score")


@register("op12_hard_negatives", r"""
WITH e AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS ar, o.vec_id AS id, o.r, a.label = o.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score FROM e a JOIN e o ON a.r <> o.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, id AS positive_id, r AS pr, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, r) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY ar, pr ORDER BY score DESC, id, r)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (ar) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY ar, pr ORDER BY score DESC, id, r) <= 3""")
def op12_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, label)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
