"""Scalar functions of the telemetry domain, all built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
LOWER_IS_BETTER = ["rmse", "mae", "nasa_score", "loss", "brier"]


def md5_01(*parts: Column | str, seed: int = 42) -> Column:
    """A repeatable number in [0, 1) from a seed and key columns; the same in any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def md5_rank(*parts: Column | str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def cap_rul(rul: Column, cap: float) -> Column:
    return F.least(rul, F.lit(cap))


def will_fail(rul: Column, horizon: int) -> Column:
    """1 where the uncapped remaining life is within the horizon."""
    return (rul <= horizon).cast("long")


def zscore(value: Column, mean: Column | float, std: Column | float) -> Column:
    return (value - mean) / std


def unscale(z: Column, mean: Column | float, std: Column | float) -> Column:
    return z * std + mean


def safe_std(std: Column) -> Column:
    """A constant column keeps its values: std 0 becomes 1."""
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def fuse(a: Column, b: Column, weight: Column | float) -> Column:
    """weight * a + (1 - weight) * b; the weight lies in [0, 1]."""
    if isinstance(weight, (int, float)):
        if not 0 <= weight <= 1:
            raise ValueError("weight must lie in [0, 1]")
        weight = F.lit(float(weight))
    return weight * a + (1 - weight) * b


def psi_term(reference: Column, production: Column, floor: float = 1e-4) -> Column:
    r, p = F.greatest(reference, F.lit(floor)), F.greatest(production, F.lit(floor))
    return (p - r) * F.ln(p / r)


def psi_band(psi: Column, moderate: float = 0.1, significant: float = 0.25) -> Column:
    return F.when(psi >= significant, "significant").when(psi >= moderate, "moderate").otherwise("none")


def severity(predicted: Column, horizon: float) -> Column:
    return F.when(predicted > horizon, "none").when(predicted <= horizon / 2, "critical").otherwise("warning")


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = reduce(lambda s, a: s * t + a, reversed(ERF[:-1]), F.lit(ERF[-1])) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def failure_probability(predicted: Column, horizon: float, rmse: float) -> Column:
    """Normal probability that the life ends within the horizon; a step where the error is not positive."""
    if rmse <= 0:
        return (predicted <= horizon).cast("double")
    return 0.5 * (1 + erf((F.lit(float(horizon)) - predicted) / (rmse * 2**0.5)))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value; 1 where the scaled statistic is under 0.2."""
    lam = d * F.sqrt(n * m / (n + m))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def higher_is_better(metric: Column) -> Column:
    return ~F.regexp_replace(metric, "^(val|test|train)_", "").isin(LOWER_IS_BETTER)


def scrub_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "://[^/@]*@", "://")


def version_label(framework: Column, seed: Column, sha: Column) -> Column:
    return F.concat_ws("-", framework, seed.cast("string"), F.coalesce(F.substring(sha, 1, 8), F.lit("nogit")))


def seconds_since(now: Column, then: Column) -> Column:
    """Never negative; null where there is no earlier instant."""
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then)) + F.when(then.isNull(), F.lit(None)).otherwise(0)


def cooldown_remaining(now: Column, last: Column, cooldown: int) -> Column:
    return F.coalesce(F.greatest(F.lit(0), cooldown - (F.unix_timestamp(now) - F.unix_timestamp(last))), F.lit(0))


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def flatten_window(win: Column, features: list[str]) -> Column:
    """Time-major vector of a window of structs."""
    return F.flatten(F.transform(win, lambda s: F.array(*[s.getField(f).cast("double") for f in features])))


def squared_error(x: Column, xhat: Column) -> Column:
    return F.aggregate(F.zip_with(x, xhat, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(x)
