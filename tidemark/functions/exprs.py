"""Scalar column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | float | Column) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def bucket(x, size) -> Column:
    """Nearest multiple of ``size``; halves go to the even multiple."""
    return F.rint(c(x) / c(size)) * c(size)


def div(a, b) -> Column:
    """a / b, null when b is zero or null."""
    return c(a) / F.when(c(b) != 0, c(b))


def log_ratio(a, b) -> Column:
    """ln(a / b), null unless both are positive."""
    return F.when((c(a) > 0) & (c(b) > 0), F.log(c(a) / c(b)))


def sign(x) -> Column:
    return F.signum(c(x)).cast("int")


def half_up(x) -> Column:
    """Round to the nearest integer, halves towards plus infinity."""
    return F.floor(c(x) + 0.5)


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.least(c(x), c(hi)), c(lo))


def ladder(*steps, otherwise=None) -> Column:
    """First matching (condition, value) pair."""
    out = None
    for cond, val in steps:
        v = c(val) if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out if otherwise is None else out.otherwise(otherwise)


# Numerator and denominator of the double-precision rational form of the normal tail (Hart, 1968).
CDF_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
CDF_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def _poly(x: Column, coeffs: list[float]) -> Column:
    acc = F.lit(coeffs[0])
    for k in coeffs[1:]:
        acc = acc * x + F.lit(k)
    return acc


def norm_cdf(x) -> Column:
    """Standard normal distribution function."""
    x = c(x)
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _poly(a, CDF_NUM) / _poly(a, CDF_DEN)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _stirling(y: Column) -> Column:
    """What Stirling's series adds to (y - 1/2) ln y - y + ln(2 pi) / 2, for y of 10 or more."""
    u = 1 / (y * y)
    return (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u * (1 / 1680 - u / 1188)))) / y


def log_gamma(z) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series ten steps on, taken back by the product."""
    z = c(z).cast("double")
    back = F.lit(0.0)
    for i in range(10):
        back = back + F.log(z + i)
    y = z + 10
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + _stirling(y) - back


def _log_gamma_step(z: Column, d: Column) -> Column:
    """log_gamma(z + d) - log_gamma(z), without the loss of digits of that difference when z is large."""
    back = F.lit(0.0)
    for i in range(10):
        back = back + F.log1p(d / (z + i))
    y = z + 10
    return (y - 0.5) * F.log1p(d / y) + d * F.log(y + d) - d + _stirling(y + d) - _stirling(y) - back


BETA_TERMS = 128  # of the continued fraction; one side of its turning point 80 are enough for any argument met here


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term back to the first."""

    def term(below: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / below

    return F.aggregate(F.sequence(F.lit(BETA_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), term)


def incomplete_beta(x, a, b, rest=None) -> Column:
    """Regularised incomplete beta function I_x(a, b) for 0 <= x <= 1 and positive a and b.

    ``rest`` is 1 - x, for callers that know it to more digits than the difference would have.
    """
    x, a, b = (c(v).cast("double") for v in (x, a, b))
    y = 1 - x if rest is None else c(rest).cast("double")
    log = lambda u, other: F.when(u > 0.5, F.log1p(-other)).otherwise(F.log(u))
    large, small = F.greatest(a, b), F.least(a, b)
    front = F.exp(a * log(x, y) + b * log(y, x) + _log_gamma_step(large, small) - log_gamma(small))
    left = front / (a * _beta_fraction(x, a, b))
    right = 1 - front / (b * _beta_fraction(y, b, a))
    inner = F.when(x < (a + 1) / (a + b + 2), left).otherwise(right)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def student_p(t, df) -> Column:
    """Two-sided p-value of a t statistic with ``df`` degrees of freedom."""
    t, df = c(t).cast("double"), c(df).cast("double")
    return F.when(df > 0, incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5), t * t / (df + t * t)))


def _d1(s, k, t, sigma, r) -> Column:
    s, k, t, sigma, r = (c(v) for v in (s, k, t, sigma, r))
    return (F.log(s / k) + (r + 0.5 * sigma * sigma) * t) / (sigma * F.sqrt(t))


def _priced(s, k, t, sigma) -> Column:
    return (c(s) > 0) & (c(k) > 0) & (c(t) > 0) & (c(sigma) > 0)


def bs_gamma(s, k, t, sigma, r=0.0) -> Column:
    """Black-Scholes gamma; 0 for inputs that cannot be priced."""
    d1 = _d1(s, k, t, sigma, r)
    g = F.exp(-0.5 * d1 * d1) / math.sqrt(2 * math.pi) / (c(s) * c(sigma) * F.sqrt(c(t)))
    return F.when(_priced(s, k, t, sigma), g).otherwise(0.0)


def bs_delta(s, k, t, r, sigma, is_call) -> Column:
    """Black-Scholes delta; 0 for inputs that cannot be priced."""
    cdf = norm_cdf(_d1(s, k, t, sigma, r))
    d = F.when(c(is_call), cdf).otherwise(cdf - 1)
    return F.when(_priced(s, k, t, sigma), d).otherwise(0.0)


def parse_date(x) -> Column:
    """A day in any of the accepted spellings, as DATE; null when none fits."""
    x = F.trim(c(x))
    # The accepted formats, tried in this order.
    # fixed values: the date patterns in the order they are tried
    formats = ["yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "M/d/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]).cast("date")


def looks_like_date(x) -> Column:
    x = F.trim(c(x))
    return (
        x.rlike(r"^\d{4}-\d{2}-\d{2}$")
        | x.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$")
        | x.rlike(r"^\d{1,2}\s+[A-Za-z]{3,}\s+\d{2,4}$")
    )


def accounting_number(x) -> Column:
    """'(45.6)' is negative, dashes and blanks are zero, thousands commas are dropped, junk is null."""
    raw = c(x)
    s = F.trim(F.regexp_replace(F.trim(raw), "[,$]", ""))
    blank = s.isin("", "-", "—", "N/A", "n/a")
    negative = s.startswith("(") & s.endswith(")")
    body = F.when(negative, F.regexp_extract(s, r"^\((.*)\)$", 1)).otherwise(s)
    v = body.try_cast("double")
    return F.when(raw.isNull(), None).when(blank, 0.0).when(negative, -v).otherwise(v)


def correlation(x, y) -> Column:
    """Aggregate: Pearson correlation over complete pairs, null (not an error) when either side is constant."""
    a = F.when(c(y).isNotNull(), c(x).cast("double"))
    b = F.when(c(x).isNotNull(), c(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)
