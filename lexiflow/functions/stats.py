"""Statistical Column expressions shared by keyness, collocation and plots."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chi-square (1 df) critical values of the log-likelihood
# statistic for p = 0.05, 0.01, 0.001.
LL_CRITICAL = {0.05: 3.841458820694124, 0.01: 6.634896601021213, 0.001: 10.827566170662733}

# Coefficients of the rational Chebyshev approximation of erfc
# (Numerical Recipes, "erfcc"; fractional error below 1.2e-7).
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def xlogx_ratio(o: Column, e: Column) -> Column:
    """o * ln(o / e) with 0 * ln 0 = 0."""
    return F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))


def erfc(x: Column) -> Column:
    """erfc(x) for x >= 0 as plain Column arithmetic (no UDF)."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = f"{ERFC_COEFFS[-1]!r}"
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = f"(({poly}) * {t} + {c!r})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


#: Terms of the continued fraction; it converges to double precision far earlier for any sample size.
BETA_TERMS = 200
_TINY = 1e-300

# Lanczos coefficients (g = 7, n = 9) of the gamma function.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 0.5."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def _away_from_zero(v: Column) -> Column:
    return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)


def with_term(half, term: Column):
    """A function of one argument (a second one would be taken for the element's index)."""
    return lambda s: half(s, term)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz),
    as a fold over its terms: plain Column arithmetic, no UDF."""
    one = F.lit(1.0)
    d0 = one / _away_from_zero(one - (a + b) * x / (a + 1.0))
    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s, m):
        even = m * (b - m) * x / ((a + m * 2.0 - 1.0) * (a + m * 2.0))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2.0) * (a + m * 2.0 + 1.0))

        def half(s, term):
            return F.struct(_away_from_zero(one + term / s["c"]).alias("c"),
                            (one / _away_from_zero(one + term * s["d"])).alias("d"), s["h"].alias("h"))

        def told(s):
            return F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h"))

        for term in (even, odd):       # one-element transforms bind each half's result once
            s = F.transform(F.transform(F.array(s), with_term(half, term)), told)[0]
        return s

    terms = F.transform(F.sequence(F.lit(1), F.lit(BETA_TERMS)), lambda m: m.cast("double"))
    return F.aggregate(terms, start, step)["h"]


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), a and b at least 0.5."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    return (F.when(x <= 0.0, F.lit(0.0)).when(x >= 1.0, F.lit(1.0))
             .when(x < (a + 1.0) / (a + b + 2.0), front * _beta_fraction(a, b, x) / a)
             .otherwise(1.0 - front * _beta_fraction(b, a, 1.0 - x) / b))


def student_t_p(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r over n pairs (Student's t with n - 2 degrees
    of freedom); null without any."""
    df = (n - 2).cast("double")
    x = 1.0 - r * r              # df / (df + t^2)
    return (F.when((df <= 0) | r.isNull() | F.isnan(r), F.lit(None).cast("double"))
             .when(F.abs(r) >= 1.0, F.lit(0.0))
             .otherwise(beta_inc(df / 2.0, F.lit(0.5), x)))


def student_t_p_sql(r: str, n: str) -> str:
    """The same as DuckDB SQL: the same fraction as a fold over its terms."""
    def fraction(a, b, x):
        away = lambda v: f"(CASE WHEN abs({v}) < {_TINY!r} THEN {_TINY!r} ELSE {v} END)"
        even = f"(m * ({b} - m) * {x} / (({a} + m * 2.0 - 1.0) * ({a} + m * 2.0)))"
        odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / (({a} + m * 2.0) * ({a} + m * 2.0 + 1.0)))"
        half = lambda s, t: f"{{'m': 0.0::DOUBLE, 'c': {away(f'(1.0 + {t} / {s}.c)')}, 'd': 1.0 / {away(f'(1.0 + {t} * {s}.d)')}, 'h': {s}.h}}"
        told = lambda s: f"{{'m': 0.0::DOUBLE, 'c': {s}.c, 'd': {s}.d, 'h': {s}.h * {s}.c * {s}.d}}"
        d0 = f"(1.0 / {away(f'(1.0 - ({a} + {b}) * {x} / ({a} + 1.0))')})"
        # every term is two entries of the list: first its even, then its odd half
        begin = f"{{'m': 0.0::DOUBLE, 'c': 1.0::DOUBLE, 'd': {d0}, 'h': {d0}}}"
        entries = f"list_transform(range(2, {2 * BETA_TERMS + 2}), lambda k: {{'m': CAST(k AS DOUBLE), 'c': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'h': 0.0::DOUBLE}})"
        term = f"(CASE WHEN e.m % 2 = 0 THEN {even.replace('m', 'floor(e.m / 2)')} ELSE {odd.replace('m', 'floor(e.m / 2)')} END)"
        step = told(f"list_transform([{half('s', term)}], lambda v: v)[1]")
        return f"list_reduce(list_prepend({begin}, {entries}), lambda s, e: {step}).h"

    def lgamma(v):
        return f"lgamma({v})"

    df, x = f"(({n} - 2) / 2.0)", f"(1.0 - {r} * {r})"
    front = f"exp({lgamma(f'{df} + 0.5')} - {lgamma(df)} - {lgamma('0.5')} + {df} * ln({x}) + 0.5 * ln({r} * {r}))"
    return (f"CASE WHEN {n} <= 2 OR {r} IS NULL OR isnan({r}) THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
            f"WHEN {x} >= 1.0 THEN 1.0 "
            f"WHEN {x} < ({df} + 1.0) / ({df} + 2.5) THEN {front} * {fraction(df, '0.5', x)} / {df} "
            f"ELSE 1.0 - {front} * {fraction('0.5', df, f'({r} * {r})')} / 0.5 END")
