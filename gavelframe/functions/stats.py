"""Exact and approximate intervals, agreement and decision rules as Column expressions.

All of them work on counts that are already aggregated, so they cost nothing next to the scan.
Names of columns are passed as strings; every function returns Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
# Lanczos coefficients (g = 7) for the logarithm of the gamma function.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def wilson(k: str, n: str, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) without trials."""
    m = F.nullif(F.col(n), F.lit(0))
    p = F.col(k) / m
    denominator = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / denominator
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / denominator
    none = F.col(n) == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def _lgamma(z: str) -> str:
    series = " + ".join([f"{_LANCZOS[0]!r}D", *(f"{c!r}D / ({z} - 1 + {i})" for i, c in enumerate(_LANCZOS[1:], 1))])
    return f"(0.9189385332046727D + ({z} - 0.5D) * ln({z} + 6.5D) - ({z} + 6.5D) + ln({series}))"


def _fraction(x: str, a: str, b: str, steps: str) -> str:
    """Continued fraction of the incomplete beta function (two half steps a term)."""
    m = "cast(floor(cf_j / 2) as double)"
    coefficient = f"if(cf_j % 2 = 0, {m} * ({b} - {m}) * {x} / (({a} - 1 + 2 * {m}) * ({a} + 2 * {m})), -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 1 + 2 * {m})))"
    first = f"1 / (1 - ({a} + {b}) * {x} / ({a} + 1))"
    return f"aggregate(sequence(2, {steps}), struct(1D as c, {first} as d, {first} as h), (cf_f, cf_j) -> transform(array({coefficient}), cf_q -> struct(1 + cf_q / cf_f.c as c, 1 / (1 + cf_q * cf_f.d) as d, cf_f.h * (1 + cf_q / cf_f.c) / (1 + cf_q * cf_f.d) as h))[0], cf_f -> cf_f.h)"


def incomplete_beta(x: str, a: str, b: str, n: str) -> str:
    """SQL of I_x(a, b) for 0 < x < 1 and positive a, b with a + b about n; the cost grows as the square root of n."""
    steps = f"cast(120 + 4 * sqrt({n}) as int)"
    front = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ({_lgamma(a)} + {_lgamma(b)} - {_lgamma(f'({a} + {b})')}))"
    return f"if({x} < ({a} + 1) / ({a} + {b} + 2), {front} * {_fraction(x, a, b, steps)} / {a}, 1 - {front} * {_fraction(f'(1 - {x})', b, a, steps)} / {b})"


def _upper(k: str, n: str, alpha: str) -> str:
    """Upper Clopper-Pearson bound by 60 bisections on P(X <= k | p) = I_(1-p)(n - k, k + 1)."""
    p = "((cp_s.lo + cp_s.hi) / 2)"
    cdf = f"if({p} >= 1, 0D, if({p} <= 0, 1D, {incomplete_beta(f'(1 - {p})', f'cast({n} - {k} as double)', f'cast({k} + 1 as double)', n)}))"
    step = f"if({cdf} > {alpha} / 2, struct({p} as lo, cp_s.hi as hi), struct(cp_s.lo as lo, {p} as hi))"
    return f"if({k} >= {n}, 1D, aggregate(sequence(1, 60), struct(cast({k} as double) / {n} as lo, 1D as hi), (cp_s, cp_i) -> {step}, cp_s -> cp_s.hi))"


def clopper_pearson(k: str, n: str, alpha: str = "0.05D") -> tuple[Column, Column]:
    """Exact binomial interval; (0, 1) without trials. alpha is a SQL expression.

    The cost does not depend on k and grows as the square root of n.
    """
    low, high = _upper(f"({n} - {k})", n, alpha), _upper(k, n, alpha)
    return F.expr(f"if({n} = 0, 0D, 1 - {low})"), F.expr(f"if({n} = 0, 1D, {high})")


def binomial_cdf(k: str, n: str, p: str) -> Column:
    """P(X <= k) of a binomial variable, from the incomplete beta function."""
    inside = incomplete_beta(f"(1 - {p})", f"cast({n} - {k} as double)", f"cast({k} + 1 as double)", n)
    return F.expr(f"if({k} >= {n} or {p} <= 0, 1D, if({k} < 0 or {p} >= 1, 0D, {inside}))")


def kappa(both: str, first_only: str, second_only: str, neither: str) -> Column:
    """Cohen's kappa of a 2x2 table; null when it is undefined."""
    n = F.nullif(F.col(both) + F.col(first_only) + F.col(second_only) + F.col(neither), F.lit(0))
    a, b = (F.col(both) + F.col(first_only)) / n, (F.col(both) + F.col(second_only)) / n
    observed, expected = (F.col(both) + F.col(neither)) / n, a * b + (1 - a) * (1 - b)
    return (observed - expected) / F.nullif(1 - expected, F.lit(0.0))


def newcombe(k1: str, n1: str, k2: str, n2: str) -> tuple[Column, Column, Column]:
    """(difference, low, high) of two proportions from their Wilson intervals; null without trials on a side."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = F.col(k1) / F.nullif(F.col(n1), F.lit(0)), F.col(k2) / F.nullif(F.col(n2), F.lit(0))
    d, ok = p1 - p2, (F.col(n1) > 0) & (F.col(n2) > 0)
    return F.when(ok, d), F.when(ok, d - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2))), F.when(ok, d + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2)))


def rogan_gladen(rate: Column, sensitivity: Column, specificity: Column) -> Column:
    """True rate behind an apparent one, clipped to [0, 1]; null if the test carries no information."""
    denominator = sensitivity + specificity - 1
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rate + specificity - 1) / F.when(denominator > 0, denominator))) + F.when(denominator > 0, 0.0)


def begg_greenes(q: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Sensitivity and specificity from the pass rate and the success rates within passes and fails."""
    sp, fp, sf, ff = q * a, q * (1 - a), (1 - q) * b, (1 - q) * (1 - b)
    return sp / F.nullif(sp + sf, F.lit(0.0)), ff / F.nullif(fp + ff, F.lit(0.0))


def check_status(low: Column, fail_high: Column, trials: Column, errors: Column, threshold: Column, min_trials: int = 10, max_missing: float = 0.1) -> Column:
    """PASS on the exact 95 % lower bound, FAIL on an upper bound at the error budget's alpha, else UNVALIDATED."""
    gaps = errors > max_missing * (trials + errors)
    return F.when(gaps | (trials < min_trials), "UNVALIDATED").when(low >= threshold, "PASS").when(fail_high < threshold, "FAIL").otherwise("UNVALIDATED")


def decide_check(successes: str, trials: str, errors: str, threshold: str, alpha_fail: str) -> tuple[Column, Column, Column]:
    """(status, low, high) of one check from its counts."""
    low, high = clopper_pearson(successes, trials)
    fail_high = clopper_pearson(successes, trials, alpha_fail)[1]
    return check_status(low, fail_high, F.col(trials), F.col(errors), F.expr(threshold)), low, high
