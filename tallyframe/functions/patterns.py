"""Fixed values that must equal the behaviour being matched.

FIXED VALUES (kept together, in their natural order):

Timestamp shapes, most specific first. Each entry: (spec name as reported, Spark datetime
pattern, anchored regex for the raw text).
    1. %Y-%m-%dT%H:%M:%S   yyyy-MM-dd'T'HH:mm:ss   ^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}$
    2. %Y-%m-%d %H:%M:%S   yyyy-MM-dd HH:mm:ss     ^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$
    3. %d/%m/%Y %H:%M      dd/MM/yyyy HH:mm        ^\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}$
    4. %Y-%m-%d            yyyy-MM-dd              ^\\d{4}-\\d{2}-\\d{2}$
(In the code the digits are written [0-9], which is what \\d means in Java's and RE2's patterns, so that
neither engine's flags can change it.)
Strict timestamp spec: %Y-%m-%dT%H:%M:%S. Fallback specs, tried in order: %d/%m/%Y %H:%M.
Integer-looking text (type reading): optional whitespace, optional sign, digits.
Decimal-looking text (type reading): optional sign, digits '.' digits with either side
optional but not both.
Revenue status: completed. Returned status: returned. Top products: 10.
Money tolerance for reconciliation checks: 0.01. Drop budget: 0.5% of input rows.
Sample size for first-k distinct values: 3.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TimestampShape:
    spec: str          # the name reported in profiles and probes
    spark_format: str  # Spark datetime pattern
    duck_format: str   # strptime format (oracle side)
    regex: str         # full-match regex on the raw text


TIMESTAMP_SHAPES: tuple[TimestampShape, ...] = (
    TimestampShape("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S",
                   "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"),
    TimestampShape("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S",
                   "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"),
    TimestampShape("%d/%m/%Y %H:%M", "dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M",
                   "[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}"),
    TimestampShape("%Y-%m-%d", "yyyy-MM-dd", "%Y-%m-%d",
                   "[0-9]{4}-[0-9]{2}-[0-9]{2}"),
)
SHAPES_BY_SPEC = {s.spec: s for s in TIMESTAMP_SHAPES}

STRICT_SPEC = "%Y-%m-%dT%H:%M:%S"
FALLBACK_SPECS: tuple[str, ...] = ("%d/%m/%Y %H:%M",)

# Type reading (full match).
INT_LIKE = r"\s*[-+]?[0-9]+\s*"
DECIMAL_LIKE = r"\s*[-+]?[0-9]*\.[0-9]+\s*|\s*[-+]?[0-9]+\.[0-9]*\s*"

# What a plain (untidied) cast accepts, by target (full match). Whitespace, suffixes such as
# 'L'/'d'/'f', and a redundant '.0' tail are not plain.
PLAIN_INT = r"[-+]?[0-9]+"
PLAIN_FLOAT = r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"

# White space as text strippers know it, beyond what \s means in Java and RE2.
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Tidy step of a coercion: surrounding whitespace, then a redundant decimal tail.
REDUNDANT_DECIMAL_TAIL = r"\.0+$"

REVENUE_STATUS = "completed"
RETURNED_STATUS = "returned"
TOP_PRODUCT_LIMIT = 10
MONEY_TOLERANCE = 0.01
DROP_BUDGET_FRACTION = 0.005
SAMPLE_SIZE = 3

# Money types (decision: exact decimals inside, double at the output).
# Text that a type cannot hold (more digits before or behind the point) is counted as ``not_held``.
# The types of the oracle's product, which has exactly 38 digits:
QTY_DECIMAL = "decimal(10,0)"
PRICE_DECIMAL = "decimal(19,6)"
RATE_DECIMAL = "decimal(8,6)"
# What the columns are read into: every BIGINT quantity, prices of 18 digits before the point and 6
# behind, rates of 21 before and 12 behind. Amounts (quantity times price) have 32 digits before the
# point and are never rounded.
WIDE_QTY_DECIMAL = "decimal(20,0)"
WIDE_PRICE_DECIMAL = "decimal(24,6)"
WIDE_RATE_DECIMAL = "decimal(33,12)"
AMOUNT_DECIMAL = "decimal(38,6)"
# A net is exact to ten decimals where gross and rate fit these (their product has 38 digits), otherwise
# it is rounded to six; net and cost of goods have 27 digits before the point.
EXACT_GROSS_DECIMAL = "decimal(22,6)"
EXACT_RATE_DECIMAL = "decimal(14,10)"
NET_DECIMAL = "decimal(37,10)"
