"""Scalar expressions: raw metrics, normalizers, calibrators and weights. All are plain columns that Catalyst can fold."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16
#: A score this near 1 carries no loss.
LOSS_TOLERANCE = 1e-12
LN2 = 0.6931471805599453


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bloat_raw(lines: Column | str) -> Column:
    return F.log2(F.greatest(_c(lines).cast("double"), F.lit(1.0)))


def state_raw(card_log2: Column | str) -> Column:
    return F.greatest(_c(card_log2), F.lit(0.0))


def economy_raw(ratio: Column | str) -> Column:
    return F.log2(F.greatest(_c(ratio), F.lit(1.0)))


def coupling_raw(edges: Column | str) -> Column:
    return _c(edges).cast("double")


def ratio_normalize(raw: Column, threshold: Column) -> Column:
    """raw / threshold; 0 where the threshold is not positive."""
    return F.when(threshold <= EPSILON, F.lit(0.0)).otherwise(raw / threshold)


def exceeds_target(normalized: Column) -> Column:
    return normalized > 1.0


def clamp01(x: Column) -> Column:
    """NaN stays NaN: Spark orders it above every number."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


# The calibrators below stay in 0..1 by themselves, and NaN stays NaN: Spark orders it above every number.


def capped_reciprocal(n: Column) -> Column:
    return F.when(n <= 1.0, F.lit(1.0)).otherwise(1.0 / n)


def exponential_decay(n: Column, half_life: float) -> Column:
    if half_life <= EPSILON:
        return F.lit(0.0)
    return F.exp(F.lit(-LN2) * F.greatest(n, F.lit(0.0)) / half_life)


def linear_decay(n: Column, zero_at: float) -> Column:
    """1 up to n = 1, then straight down to 0 at ``zero_at``; a step if ``zero_at`` is not above 1."""
    if zero_at <= 1.0 + EPSILON:
        return F.when(n <= 1.0, F.lit(1.0)).otherwise(0.0)
    return F.when(n <= 1.0, F.lit(1.0)).otherwise(F.greatest(1.0 - (n - 1.0) / (zero_at - 1.0), F.lit(0.0)))


def stretched_decay(n: Column, half_life: float, shape: float) -> Column:
    if half_life <= EPSILON:
        return F.lit(0.0)
    return F.exp(F.lit(-LN2) * F.pow(F.greatest(n, F.lit(0.0)) / half_life, F.lit(float(shape))))


def has_loss(score: Column) -> Column:
    return score < 1.0 - LOSS_TOLERANCE


def loss(score: Column) -> Column:
    return 1.0 - score


def size_weight(size: Column, kind: str = "sqrt") -> Column:
    s = F.greatest(size.cast("double"), F.lit(1.0))
    if kind == "uniform":
        return F.lit(1.0)
    if kind == "linear":
        return s
    if kind == "sqrt":
        return F.sqrt(s)
    if kind == "log2":
        return F.greatest(F.log2(s), F.lit(1.0))
    raise ValueError(f"unknown size weighting {kind!r}")


def valid_threshold(t: Column) -> Column:
    return t.isNotNull() & ~F.isnan(t) & (t > EPSILON) & (t < float("inf"))


def iqr(q25: Column, q75: Column) -> Column:
    return q75 - q25


def robust_stddev(q25: Column, q75: Column) -> Column:
    return (q75 - q25) / 1.349


def overhead_ratio(production: Column, macros: Column, public: Column, exported: Column) -> Column:
    below = (public + exported).cast("double")
    return F.when(below == 0, F.lit(0.0)).otherwise((production + macros).cast("double") / below)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; 0 where there is nothing below."""
    return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def assess_delta(delta: Column, higher_is_better: Column) -> Column:
    """'unchanged' at exactly 0 and for NaN, else by the metric's direction."""
    better = F.when(higher_is_better, delta > 0).otherwise(delta < 0)
    return F.when((delta == 0) | F.isnan(delta), "unchanged").when(better, "improved").otherwise("regressed")


def assess_loss_delta(delta: Column, tolerance: float = 1e-10) -> Column:
    return F.when(F.abs(delta) < tolerance, "unchanged").when(delta < 0, "improved").otherwise("regressed")


def paths_suffix_match(a: Column, b: Column) -> Column:
    """Equal paths, or one is the tail of the other from a ``/`` on; symmetric."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def saturating_product(a: Column, b: Column, most: int = 2**63 - 1) -> Column:
    """Product of two non-negative BIGINTs that stops at ``most`` instead of failing."""
    return F.coalesce(F.try_multiply(a, b), F.lit(most))
