"""Scalar expressions and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of each range, by its lower bound.
PBO = ((0.5, "high"), (0.3, "moderate"), (0.1, "low"), (None, "very low"))
STABILITY = ((0.8, "stable"), (0.5, "fair"), (0.0, "weak"), (None, "failed"))
PERSISTENCE = ((0.98, "very high"), (0.90, "high"), (None, "moderate"))
RISK = ((75.0, "aggressive"), (50.0, "growth"), (25.0, "balanced"), (None, "careful"))
SCORE = ((70.0, "stable"), (40.0, "mixed"), (None, "unstable"))


SEASONALITY = ((3.0, "high"), (1.5, "moderate"), (None, "low"))
CORRELATION = ((0.10, "raised"), (None, "normal"))
ALPHA = ((0.15, "high"), (None, "moderate"))
BETA = ((0.9, "very persistent"), (0.7, "persistent"), (None, "fleeting"))
KURTOSIS = ((1.0, "fat"), (None, "normal"))
#: Lower bound, upper bound, and the labels below, between and above.
PERCENTILE = (20.0, 80.0, "low", "normal", "high")
SKEW = (-0.5, 0.5, "left", "even", "right")


def between(value: Column, bounds: tuple) -> Column:
    """The label of a value below, above, or within two bounds (both included)."""
    low, high, below, inside, above = bounds
    return F.when(value < low, below).when(value > high, above).when(value.isNotNull(), inside)


def label(value: Column, ranges: tuple, strict: bool = False) -> Column:
    """The first range whose bound the value reaches (strict: exceeds)."""
    out = None
    for bound, name in ranges:
        if bound is None:
            return F.when(value.isNotNull(), (out if out is not None else F).when(F.lit(True), F.lit(name)))
        out = (out if out is not None else F).when(value > bound if strict else value >= bound, F.lit(name))
    return out


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normal_pdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (F.lit(math.sqrt(2 * math.pi)) * sd)


def linspace(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced values as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / (n - 1))


def stability_score(revert_share: Column, median_half_life: Column, pc1_share: Column, divergence: Column) -> Column:
    """0 to 100: share of reverting factors (30), short half-lives (30), little weight of the first factor (25), z-scores that agree (15)."""
    parts = 30 * revert_share + F.greatest(30 - median_half_life, F.lit(0.0)) + 25 * (1 - pc1_share) + F.greatest(15 - 10 * divergence, F.lit(0.0))
    return clip(parts, 0.0, 100.0)


def filled(value: Column, diagonal: Column) -> Column:
    """Missing cells of a matrix: one on the diagonal, else zero."""
    return F.coalesce(value, F.when(diagonal, 1.0).otherwise(0.0))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


# The published rational approximations (Wichura, algorithm AS 241) of the normal quantile near the middle, towards the tails, and in
# them; numerators, then denominators after 1, by rising powers.
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
SIDES = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAILS = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_ppf(p: Column) -> Column:
    """The standard normal quantile of p; null outside (0, 1)."""

    def ratio(r: Column, parts: tuple) -> Column:
        def sum_(coefficients) -> Column:
            out = F.lit(float(coefficients[-1]))
            for c in reversed(coefficients[:-1]):
                out = out * r + F.lit(float(c))
            return out

        return sum_(parts[0]) / sum_((1.0, *parts[1]))

    q = p - 0.5
    r = F.sqrt(-F.ln(F.when((p > 0) & (p < 1), F.least(p, 1 - p))))
    far = F.when(r <= 5, ratio(r - 1.6, SIDES)).otherwise(ratio(r - 5, TAILS))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, MIDDLE)).otherwise(F.signum(q) * far))
