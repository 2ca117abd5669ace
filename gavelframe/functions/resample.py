"""Resampling of grouped evidence by hash draws.

Cases that carry the same counts are interchangeable, so a resample needs one number a kind of
case, not one a case: its cost follows the number of different kinds, never the number of cases.
Every draw is a function of (seed, draw number, kind), so any engine repeats it.

``weights`` draws how often the cases of a kind enter a resample: Poisson with the kind's number of
cases as mean (the Poisson bootstrap), by inversion up to EXACT cases and by a rounded normal
beyond.  ``subsets`` draws how many cases of a kind enter a random half: one hash bit a case, up to
EXACT_BITS words of 52 cases, a rounded normal beyond.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions.rng import digest, u01

EXACT = 64
WORD = 52
EXACT_BITS = 64


def normal(*keys: Column | str) -> Column:
    """A standard normal from two hash uniforms."""
    radius = F.sqrt(-2 * F.log(1 - u01("radius", *keys)))
    return radius * F.cos(2 * math.pi * u01("angle", *keys))


def _poisson_cdf(n: str) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable with mean n, far into the upper tail."""
    start = f"struct(array(exp(-cast({n} as double))) as c, exp(-cast({n} as double)) as p)"
    step = f"struct(array_append(s.c, element_at(s.c, -1) + s.p * {n} / k) as c, s.p * {n} / k as p)"
    return F.expr(f"aggregate(sequence(1, cast({n} + 12 * sqrt({n}) + 12 as int)), {start}, (s, k) -> {step}, s -> s.c)")


def weights(kinds: DataFrame, kind: str, n: str, draws: int, seed: str, observed: bool = False) -> DataFrame:
    """kinds x draws with draw (from 0) and w, the number of the kind's n cases in that resample; with observed, draw -1 has the cases as they are."""
    table = kinds.withColumn("_cdf", F.when(F.col(n) <= EXACT, _poisson_cdf(f"least({n}, {EXACT})")))
    rows = table.withColumn("draw", F.explode(F.sequence(F.lit(-1 if observed else 0), F.lit(draws - 1))))
    keys = (seed, F.col("draw"), F.col(kind))
    rows = rows.withColumn("_u", u01("poisson", *keys))
    exact = F.size(F.filter("_cdf", lambda c: F.col("_u") > c)).cast("long")
    rough = F.greatest(F.lit(0.0), F.round(F.col(n) + F.sqrt(F.col(n).cast("double")) * normal(*keys))).cast("long")
    return rows.withColumn("w", F.when(F.col("draw") < 0, F.col(n)).when(F.col(n) <= EXACT, exact).otherwise(rough)).drop("_cdf", "_u")


def subsets(kinds: DataFrame, kind: str, n: str, draws: int, seed: str) -> DataFrame:
    """kinds x draws with draw and w, the number of the kind's n cases in that random half."""
    table = kinds.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    few = F.col(n) <= WORD * EXACT_BITS
    words = F.when(few, F.sequence(F.lit(0), F.ceil(F.col(n) / WORD).cast("int") - 1)).otherwise(F.array(F.lit(0)))

    def bits(i: Column) -> Column:
        value = F.conv(F.substring(digest("half", seed, F.col("draw"), F.col(kind), i), 1, 13), 16, 10).cast("long")
        left = F.least(F.lit(WORD), F.col(n) - i * WORD)
        return F.bit_count(F.floor(value / F.pow(F.lit(2.0), WORD - left)).cast("long")).cast("long")

    exact = F.aggregate(F.transform(words, bits), F.lit(0).cast("long"), lambda a, x: a + x)
    rough = F.round(F.col(n) / 2 + F.sqrt(F.col(n).cast("double")) / 2 * normal(seed, F.col("draw"), F.col(kind)))
    inside = F.greatest(F.lit(0.0), F.least(F.col(n).cast("double"), rough)).cast("long")
    return table.withColumn("w", F.when(few, exact).otherwise(inside))


def sorted_values(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, values): the defined values of all draws in order; one row a key, as many values as draws."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def percentile(values: str, alpha: Column | float) -> tuple[Column, Column]:
    """The bounds of sorted values at a level, at whole positions; (0, 1) without values."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    n = F.size(values)
    low = F.get(values, F.greatest(F.lit(0), F.floor(a / 2 * n).cast("int")))
    high = F.get(values, F.least(n - 1, F.floor((1 - a / 2) * n).cast("int")))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)


# -- SQL twins ------------------------------------------------------------------------------
def u01_sql(*keys: str) -> str:
    return "(('0x' || substr(sha256(concat_ws('|', " + ", ".join(keys) + ")), 1, 13))::BIGINT / 4503599627370496.0)"


def normal_sql(*keys: str) -> str:
    return f"sqrt(-2 * ln(1 - {u01_sql(chr(39) + 'radius' + chr(39), *keys)})) * cos(2 * pi() * {u01_sql(chr(39) + 'angle' + chr(39), *keys)})"


def weights_sql(kinds: str, kind: str, n: str, draws: int, seed: str) -> str:
    """SELECT of kinds x draws with draw and w, as weights() gives them."""
    keys = (f"'{seed}'", "draw", kind)
    cdf = f"list_transform(range(0, ({n} + 12 * sqrt({n}) + 12)::INTEGER + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-{n} + i * ln({n}) - lgamma(i + 1)))))"
    table = f"SELECT *, CASE WHEN {n} <= {EXACT} THEN {cdf} END AS cdf FROM {kinds}"
    drawn = f"SELECT t.*, draw, {u01_sql(chr(39) + 'poisson' + chr(39), *keys)} AS u FROM ({table}) t, range({draws}) d(draw)"
    return f"SELECT * EXCLUDE (cdf, u), CASE WHEN {n} <= {EXACT} THEN len(list_filter(cdf, lambda c: u > c)) ELSE greatest(0, round({n} + sqrt({n}::DOUBLE) * {normal_sql(*keys)}))::BIGINT END AS w FROM ({drawn})"


def subsets_sql(kinds: str, kind: str, n: str, draws: int, seed: str) -> str:
    """SELECT of kinds x draws with draw and w, as subsets() gives them (up to the exact bound)."""
    value = f"('0x' || substr(sha256(concat_ws('|', 'half', '{seed}', draw, {kind}, i)), 1, 13))::BIGINT"
    bits = f"bit_count(floor({value} / pow(2.0, {WORD} - least({WORD}, {n} - i * {WORD})))::BIGINT)"
    return f"SELECT t.*, draw, list_sum(list_transform(range(0, ceil({n} / {WORD}.0)::BIGINT), lambda i: {bits}))::BIGINT AS w FROM {kinds} t, range({draws}) d(draw)"
