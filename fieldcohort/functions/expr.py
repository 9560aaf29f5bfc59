"""Scalar and aggregate expressions; all stay inside code generation.

Missing values: NaN and infinities become NULL where data come in (``finite``), because Spark orders NaN above all numbers
and would let it pass ``>=`` filters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that a numeric column may hold; a guard, since a cast alone also takes suffixes such as "1d".
NUMERIC = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*$"
#: Tokens that stand for a missing value in delimited text.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == math.inf), None).otherwise(d)


def to_number(c: Column) -> Column:
    """Text as a double, NULL where it is no number."""
    s = c.cast("string")
    return F.when(F.lower(s).rlike(NUMERIC), s.try_cast("double"))


def truthy(c: Column) -> Column:
    """Text form, trimmed and lower-cased, is one of 1, true, yes, y; NULL is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def strict_true(c: Column) -> Column:
    """Lower-cased text form is exactly true; NULL is false."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def null_token(c: Column) -> Column:
    """Text with the usual tokens for a missing value as NULL."""
    return F.when(c.isin(*NULL_TOKENS), None).otherwise(c)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clean_ratio(num: Column, den: Column) -> Column:
    """num / den where both are there and den is positive."""
    return F.when(den > 0, num / den)


def pearson(x: str, y: str) -> Column:
    """Correlation over the rows of a group where both are there; NULL for under two rows or no spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.try_divide(F.covar_pop(a, b), spread))


def summary(c: Column, prefix: str) -> list[Column]:
    """n, mean, median, p25, p75 and p95 (linear interpolation) of the finite values of a group."""
    v = finite(c)
    p = F.percentile(v, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.95)]))
    return [F.count(v).alias(f"{prefix}_n_voxels"), F.avg(v).alias(f"{prefix}_mean"), *[F.get(p, k).alias(f"{prefix}_{n}") for k, n in enumerate(("p25", "median", "p75", "p95"))]]


def five_numbers(c: Column, prefix: str = "") -> list[Column]:
    """Minimum, quartiles and maximum of a group."""
    v = finite(c)
    p = F.percentile(v, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return [F.get(p, k).alias(prefix + n) for k, n in enumerate(("minimum", "q1", "median", "q3", "maximum"))]


def dice(a: Column, b: Column) -> Column:
    """Overlap of two masks over a group; 1 where both are empty."""
    x, y = F.coalesce(a, F.lit(False)).cast("long"), F.coalesce(b, F.lit(False)).cast("long")
    total = F.sum(x) + F.sum(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.sum(x * y) / total)


def draw(modulus: Column, *key: Column) -> Column:
    """A number from 0 to modulus - 1 that a hash of the key decides; the same in every engine that has MD5."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % modulus


def p_text(p: Column) -> Column:
    """A p-value for a table."""
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


#: Replacements in TeX text, in this order. Fixed values.
TEX = (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"))


def tex_escape(c: Column) -> Column:
    """Text with TeX's special characters escaped; each character is replaced once."""
    out = F.split(c, "")
    table = F.create_map(*[F.lit(x) for pair in TEX for x in pair])
    return F.array_join(F.transform(out, lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def basename(c: Column) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(c, "/"), -1)
