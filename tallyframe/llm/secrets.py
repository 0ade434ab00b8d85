r"""Secret scans: an incremental blob ledger, native DataFrame code only.

Every version of every path is addressed by its content (SHA-256 of the UTF-8 text). The ledger is
a Parquet table of (blob, rule, rule_version) pairs already scanned, with the spans found. A scan
reads only blobs with a pair that the ledger lacks, appends the new pairs, and joins the findings
back to every path that holds the blob. A blob with a third of all paths is scanned once; in the
join its paths are spread by salt.

Spans are code-point positions. A text splits at its matches into pieces and matches that take
turns, so the start of match i is the length of all pieces up to it and of all matches before it.

Defined results: a null text is the empty blob. Rows that repeat each get their findings. Null ids
stay null. Other columns are ignored. An empty table gives an empty ledger and an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, identified, salted_left_join, sha256_hex

SPAN = "struct<start:int,`end`:int>"
LEDGER = f"blob string, rule string, rule_version int, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts (0: the match), and the least length. Matches
    are leftmost and do not overlap; a match that is too short is dropped but has used its text."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


#: The base rules, in the order of their listing.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # a run is taken whole, so that shorter ones can be left out at once
)
#: Rules that this library adds; their spans come beside the base ones.
ADDED = (Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),)
RULES = BASE + ADDED


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in ``text`` as an array of (start, end), or null where there is none."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    steps = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), F.transform(found, F.char_length).alias("match"), sized.alias("counted")),
        lambda x: F.struct(x["piece"].alias("piece"), x["match"].alias("match"), x["counted"].alias("counted")),
    )
    empty = F.array().cast(f"array<struct<start:int,`end`:int,counted:int>>")
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))
    placed = F.aggregate(
        steps,
        empty,
        lambda done, x: F.concat(
            done,
            F.array(F.struct((last(done) + x["piece"]).alias("start"), (last(done) + x["piece"] + x["match"]).alias("end"), x["counted"].alias("counted"))),
        ),
    )
    kept = F.transform(F.filter(placed, lambda x: x["counted"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(F.regexp_like(text, pattern), kept)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(spark: SparkSession, versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date with ``versions`` (blob, text), and returns it. Only
    unseen (blob, rule version) pairs are scanned; one row a scanned pair is appended."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("seen"))  # as many as there are rules
    first = versions.select("blob", "text").dropDuplicates(["blob"])  # met in each task before the shuffle
    unseen = first.join(seen, "blob", "left").withColumn("due", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<rule:string,rule_version:int>>")))).where(F.size("due") > 0)
    results = [
        F.struct(
            F.lit(r.kind).alias("rule"),
            F.lit(r.version).alias("rule_version"),
            F.when(F.array_contains(F.transform("due", lambda d: F.concat_ws(":", d["rule"], d["rule_version"])), f"{r.kind}:{r.version}"), F.coalesce(spans(F.col("text"), r), F.array().cast(f"array<{SPAN}>"))).alias("spans"),
        )
        for r in rules
    ]
    pairs = unseen.select("blob", F.explode(F.array(*results)).alias("pair")).select("blob", "pair.*").where(F.col("spans").isNotNull())
    pairs.write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def scan_documents(spark: SparkSession, docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, __row, blob and ``found`` (array of rank, rule, start, end by start, then rank; null: none)
    for every row of ``docs``."""
    rows = identified(docs, id_col, text_col).withColumn("blob", sha256_hex(F.col("text")))
    current = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    found = (
        scan(spark, rows, ledger, rules)
        .where(F.size("spans") > 0)
        .withColumn("rank", current[F.concat_ws(":", "rule", "rule_version")])
        .where(F.col("rank").isNotNull())
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("rule").alias("rule"))).alias("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))  # one array a rule
    )
    return salted_left_join(rows.select("doc_id", ROW, "blob"), found, "blob", F.col(ROW), salts)
