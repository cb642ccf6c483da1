"""Tail probabilities of test statistics: for numbers on the driver, and of normal and chi-square statistics for columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 97.5 % point of the normal distribution.
Z975 = 1.959963984540054


#: Terms of the expansions of the normal tail, and where the one for large values takes over.
TERMS, FAR = 120, 2.0
#: Terms of the incomplete beta function, degrees of freedom from which t tails come from normal ones, and rows up to which Smirnov's sum is taken.
BETA_TERMS, T_NORMAL, KS_TERMS = 240, 400, 1 << 20


def two_sided_p(z: Column) -> Column:
    """Probability that a normal variable is farther from 0 than ``z``: a power series near 0, a continued fraction beyond."""
    x = F.abs(z.cast("double"))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    down = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(down, F.lit(1.0), lambda t, k: 1 + x * x / (2 * k + 1) * t)
    fraction = F.aggregate(down, F.lit(0.0), lambda t, k: k / (x + t))
    return F.when(x < FAR, 1 - 2 * density * x * series).otherwise(2 * density / (x + fraction))


def chi_square_1_p(x: Column) -> Column:
    """Upper tail of a chi-square variable with one degree of freedom."""
    return two_sided_p(F.sqrt(F.greatest(x.cast("double"), F.lit(0.0))))


def lgamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series ten steps up, and back."""
    up = z + 10.0
    back = z
    for k in range(1, 10):
        back = back * (z + float(k))
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(back)


def incomplete_beta_column(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for a and b up to some hundreds: its continued fraction from BETA_TERMS down."""

    def lower(a: Column, b: Column, x: Column) -> Column:
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        down = F.sequence(F.lit(BETA_TERMS), F.lit(1), F.lit(-1))

        def term(t: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / t

        return front / F.aggregate(down, F.lit(1.0), term)

    inner = F.when(x > (a + 1) / (a + b + 2), 1 - lower(b, a, 1 - x)).otherwise(lower(a, b, x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Probability that a t variable is farther from 0; null without degrees of freedom.

    From T_NORMAL degrees on by Hill's normal deviate, whose relative error is then below 1e-9 for p above 1e-35 and some millionths beyond.
    """
    t, v = t.cast("double"), df.cast("double")
    a = v - 0.5
    b = 48 * a * a
    w = F.sqrt(a * F.log1p(t * t / v))
    z = w + (w**3 + 3 * w) / b - (4 * w**7 + 33 * w**5 + 240 * w**3 + 855 * w) / (10 * b * (b + 0.8 * w**4 + 100))
    exact = incomplete_beta_column(v / 2, F.lit(0.5), v / (v + t * t))
    return F.when((v > 0) & t.isNotNull(), F.when(v >= T_NORMAL, two_sided_p(z)).otherwise(exact))


def ks_two_sided_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sample Kolmogorov-Smirnov probability: twice Smirnov's one-sided sum at the harmonic sample size, at most 1.

    Beyond KS_TERMS rows the limit distribution with its next terms takes over; its relative error there is below 1e-3 for p above 1e-20.
    """
    n1, n2, d = n1.cast("double"), n2.cast("double"), d.cast("double")
    n = F.round(n1 * n2 / F.nullif(n1 + n2, F.lit(0.0)))

    def step(s: Column, j: Column) -> Column:
        x, y = d + j / n, 1 - d - j / n
        tail = F.when(n > j, (n - j) * F.log(F.greatest(y, F.lit(1e-300)))).otherwise(0.0)
        part = F.when((y <= 0) & (n > j), 0.0).otherwise(F.exp(s["c"] + (j - 1) * F.log(x) + tail))
        return F.struct((s["sum"] + part).alias("sum"), F.when(n > j, s["c"] + F.log((n - j) / (j + 1))).otherwise(s["c"]).alias("c"))

    last = F.least(F.floor(n * (1 - d)), F.lit(KS_TERMS)).cast("int")
    exact = F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("c")), step, lambda s: F.least(2 * d * s["sum"], F.lit(1.0)))
    x = d * F.sqrt(n)
    v = x + 1 / (6 * F.sqrt(n)) + (x - 1) / (4 * n)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * v * v))
    limit = F.when(v < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))
    return F.when((n1 > 0) & (n2 > 0), F.when(d <= 0, 1.0).when(d >= 1, 0.0).when(n > KS_TERMS, limit).otherwise(exact))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_1(x: float) -> float:
    """Upper tail with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the modified Lentz continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            f *= step
        if abs(step - 1) < 1e-16:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    if not df > 0 or math.isnan(t):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Two-sided quantile: |t| exceeds it with probability 1 - p."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 1 - p:
        hi *= 2
        if hi > 1e12:
            return math.nan
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - p else (lo, mid)
    return hi


def ks_two_sided(d: float, n1: int, n2: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value: twice Smirnov's one-sided sum at the harmonic sample size."""
    n = round(n1 * n2 / (n1 + n2)) if n1 and n2 else 0
    if not n or d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    total = 0.0
    for j in range(int(math.floor(n * (1 - d))) + 1):
        x, y = d + j / n, 1 - d - j / n
        if y <= 0 and n - j > 0:
            continue
        log = math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + (j - 1) * math.log(x) + ((n - j) * math.log(y) if n - j else 0.0)
        total += math.exp(log)
    return min(1.0, 2 * d * total)
