"""Column expressions shared by the operators. All JVM-side; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import patterns as P


def full_match(c: Column, regex: str) -> Column:
    """True when the whole text matches ``regex`` (null stays null)."""
    return c.rlike(f"^(?:{regex})\\z")


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` only removes spaces). Text
    that begins and ends with a printing ASCII character has none, which is most text."""
    plain = lambda end: F.substring(c, end, 1).between("!", "~")
    return F.when(plain(1) & plain(-1), c).otherwise(F.regexp_replace(c, f"^{P.WHITE_SPACE}+|{P.WHITE_SPACE}+$", ""))


def tidy_number_text(c: Column) -> Column:
    """Coercion tidy step: strip whitespace, then drop a redundant ``.0`` tail."""
    bare = strip_ws(c)
    return F.when(bare.endswith("0"), F.regexp_replace(bare, P.REDUNDANT_DECIMAL_TAIL, "")).otherwise(bare)


TARGET_TYPES = {"int": "bigint", "float": "double"}


def target_type(target: str) -> str:
    return TARGET_TYPES.get(target, target)


def plain_regex(target: str) -> str:
    return P.PLAIN_INT if target_type(target) in ("bigint", "int") else P.PLAIN_FLOAT


def guarded_cast(c: Column, target: str) -> Column:
    """Lenient cast that reads only text a plain cast would read: sign, digits, one point,
    exponent. Spark alone would also read ' 3' (whitespace) and '1d' / '1.5f' (suffixes);
    the regex guard keeps those as null so the repair count means the same thing everywhere.
    Overflow is null (try_cast)."""
    t = target_type(target)
    return F.when(full_match(c, plain_regex(target)), c.try_cast(t))


def parse_timestamp(c: Column, spec: str) -> Column:
    """Lenient parse of one spec; unreadable -> null. Result is timestamp without zone. Text without
    the spec's separator is not tried: a parse that fails costs many times one that succeeds."""
    shape = P.SHAPES_BY_SPEC[spec]
    separator = "/" if "/" in shape.spark_format else "-"
    return F.when(c.contains(separator), F.try_to_timestamp(c, F.lit(shape.spark_format))).cast("timestamp_ntz")


def parse_multi_format(c: Column, specs: tuple[str, ...]) -> Column:
    """First spec that reads a value wins."""
    return F.coalesce(*[parse_timestamp(c, s) for s in specs])


def ratio(n: Column, d: Column) -> Column:
    """Guarded ratio in double precision: 0.0 when the denominator is 0 or null."""
    nd, dd = n.cast("double"), d.cast("double")
    return F.when(dd.isNotNull() & (dd != 0), nd / dd).otherwise(F.lit(0.0))


def null_when_zero_ratio(n: Column, d: Column) -> Column:
    """Ratio that is NULL (not 0) when the denominator is 0 (per-row margin_pct)."""
    nd, dd = n.cast("double"), d.cast("double")
    return F.when(dd != 0, nd / dd)


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))
