"""Scalar Column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``, so it
stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F1 -------------------------------------------------------------------------
def ns_to_timestamp(ns) -> Column:
    """Epoch nanoseconds (long) -> TIMESTAMP (micro precision; ns are floored)."""
    return F.timestamp_micros(F.floor(_c(ns).cast("decimal(20,0)") / F.lit(1000)).cast("long"))


# F2 -------------------------------------------------------------------------
def floor_second(ts) -> Column:
    """Floor a timestamp to the whole second (keeps TIMESTAMP / TIMESTAMP_NTZ type)."""
    return F.date_trunc("second", _c(ts))


def epoch_seconds(ts) -> Column:
    """Whole epoch seconds of a TIMESTAMP or TIMESTAMP_NTZ (session zone UTC)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def epoch_micros(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


# P5 / F3 ---------------------------------------------------------------------
SENSOR_PREFIX_PATTERN = r"(/[^/]+/)([^/]+/){3}"  # fixed value: first four path parts


def metric_from_path(sensor) -> Column:
    """Sensor path -> metric name: the first four path parts are removed."""
    return F.regexp_replace(_c(sensor), SENSOR_PREFIX_PATTERN, "")


def strip_slashes(path) -> Column:
    return F.regexp_replace(_c(path), "/", "")


# F4 -------------------------------------------------------------------------
def node_number(node) -> Column:
    """Digits after the first character of a node name (``N12`` -> 12)."""
    return F.substring(_c(node), 2, 1 << 20).try_cast("int")


# P10 ------------------------------------------------------------------------
def truncate_decimals(x, d: int = 2) -> Column:
    """Cut (not round) the printed decimal number after ``d`` decimals, so 0.29
    stays 0.29 although its binary value lies below."""
    printed = _c(x).cast("string").cast(f"decimal(38,{18})")
    whole = F.floor(F.abs(printed) * 10 ** d).cast("double") / float(10 ** d)
    return F.when(printed < 0, -whole).otherwise(whole)


# F6 -------------------------------------------------------------------------
def clean_correlation(x) -> Column:
    """NaN/NULL -> 0, +inf -> 1, -inf -> -1."""
    x = _c(x)
    return (F.when(x.isNull() | F.isnan(x), F.lit(0.0))
            .when(x == float("inf"), F.lit(1.0))
            .when(x == float("-inf"), F.lit(-1.0))
            .otherwise(x))


def safe_ratio(num, den, default: float | None = 0.0) -> Column:
    """``num / den`` with ``default`` where the ratio is undefined (ANSI safe)."""
    r = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return r if default is None else F.coalesce(r, F.lit(float(default)))


# F10 ------------------------------------------------------------------------
def mahalanobis(diffs: Sequence[Column], inv_cov: Sequence[Sequence[Column | float]]) -> Column:
    """sqrt(d' C^-1 d) for a small, fixed dimension; C^-1 entries are Columns or numbers."""
    terms = []
    for i, di in enumerate(diffs):
        for j, dj in enumerate(diffs):
            cij = inv_cov[i][j]
            cij = cij if isinstance(cij, Column) else F.lit(float(cij))
            terms.append(di * cij * dj)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.sqrt(F.greatest(total, F.lit(0.0)))


# F11 ------------------------------------------------------------------------
def outlier_label(cluster, distance, threshold: float = 2.0) -> Column:
    """Cluster label, or ``outlier`` where distance > threshold (strict)."""
    return F.when(_c(distance) > F.lit(float(threshold)), F.lit("outlier")).otherwise(
        _c(cluster).cast("string"))


# Rounding ---------------------------------------------------------------------
def quantize(c, digits: int = 6) -> Column:
    """``floor(x * 10^d + 0.5001) / 10^d``: the same IEEE operations in Spark and
    DuckDB, so both sides agree even on half-way values (unlike ``round``, which
    is decimal HALF_UP in Spark and binary in DuckDB)."""
    scale = float(10 ** digits)
    return (F.floor(c * F.lit(scale) + F.lit(0.5001)) / F.lit(scale)).cast("double")
