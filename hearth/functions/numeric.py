"""Numeric helpers with explicit, engine-independent semantics.

Three rounding rules occur in the source system (see SURVEY §2.12 no. 3):

* ETL rounding (pandas ``.round``): half-to-even on the scaled binary value
  -> ``round_half_even`` = ``rint(x * 10^k) / 10^k``.
* Service rounding (Python ``round``): same half-to-even rule; we use the
  identical formula (exact for all values that are not binary ties).
* Warehouse ``ROUND``: half away from zero -> ``round_half_up``, written as
  ``sign(x) * floor(|x| * 10^k + 0.5) / 10^k`` so every engine computes the
  same bits (built-in ``round`` converts through decimal strings in Spark
  but multiplies in other engines, and they disagree on ties like 0.15).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strict decimal literal, surrounding blanks allowed. Anything else
# ('1d', 'NaN', '1,000', '', 'n/a') is missing, as in pandas to_numeric.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_num(c) -> Column:
    """Coercing numeric cast: strict pattern first, then ``try_cast``."""
    c = col_(c).cast("string")
    return F.when(c.rlike(NUMERIC_PATTERN), F.trim(c).try_cast("double"))


def to_int(c) -> Column:
    v = to_num(c)
    return F.when(v == F.floor(v), v.cast("bigint"))


def _scale(k: int) -> float:
    return float(10 ** k) if k >= 0 else 1.0 / float(10 ** (-k))


def round_half_even(c, k: int = 0) -> Column:
    c = col_(c)
    if k >= 0:
        return F.rint(c * _scale(k)) / _scale(k)
    return F.rint(c / float(10 ** (-k))) * float(10 ** (-k))


def round_half_up(c, k: int = 0) -> Column:
    c = col_(c)
    return F.signum(c) * F.floor(F.abs(c) * _scale(k) + 0.5) / _scale(k)


def clip(c, lo=None, hi=None) -> Column:
    """pandas ``clip``: NULL stays NULL (Spark's least/greatest skip NULLs)."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, col_(lo) if not isinstance(lo, (int, float)) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, col_(hi) if not isinstance(hi, (int, float)) else F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def nonzero(c, replacement: float = 1.0) -> Column:
    """Replace 0 by ``replacement`` in a denominator (pandas ``replace(0,1)``)."""
    c = col_(c)
    return F.when(c == 0, F.lit(replacement)).otherwise(c)


def falsy_to(c, default) -> Column:
    """Python ``a or b``: NULL and 0 both fall through to the default."""
    c = col_(c)
    d = default if not isinstance(default, (int, float, str)) else F.lit(default)
    return F.coalesce(F.nullif(c, F.lit(0)), d)


def exact_mean(c, decimals: int = 0) -> Column:
    """Average of values that carry at most ``decimals`` decimals.

    Sums the scaled integers (exact in double below 2^53, so independent of
    partition order) and divides once: the result does not depend on how
    the rows were shuffled.
    """
    c = col_(c)
    s = _scale(decimals)
    return F.sum(F.rint(c * s)) / (F.count(c).cast("double") * s)


def mean_round_half_up(c, decimals: int | None, digits: int) -> Column:
    """``ROUND(AVG(c), digits)``, half away from zero.

    ``decimals=None``: plain ``avg`` (exact across engines whenever the
    values are whole numbers, since their sum is exact). ``decimals=k``:
    the column is known to carry k decimals (a derived, rounded score);
    the average is then computed from scaled integers (``exact_mean``).
    """
    c = col_(c)
    if decimals is None:
        return round_half_up(F.avg(c), digits)
    s = _scale(decimals)
    scaled_mean = F.sum(F.rint(c * s)) / F.count(c).cast("double")
    if digits == decimals:
        return F.signum(scaled_mean) * F.floor(F.abs(scaled_mean) + 0.5) / s
    return round_half_up(scaled_mean / s, digits)
