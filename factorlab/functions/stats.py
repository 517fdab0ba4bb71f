"""Distribution functions and counter-based draws as native column expressions.

The p-values are finite or rapidly converging series folded with
``F.aggregate``, so summary tables stay on the JVM without a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def student_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided Student-t p-value for integer degrees of freedom.

    The t distribution with integer ``dof`` has a finite trigonometric series
    in theta = atan(|t| / sqrt(dof)); odd and even ``dof`` use different terms.
    """
    nu = dof.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    cos, sin = F.cos(theta), F.sin(theta)
    odd = (dof % 2) == 1
    steps = F.floor((dof - F.when(odd, 3).otherwise(2)) / 2).cast("int")

    def fold(first: Column, shift: Column) -> Column:
        start = F.struct(first.alias("term"), first.alias("total"))

        def step(acc: Column, k: Column) -> Column:
            term = acc["term"] * cos * cos * (2 * k - 1 + shift) / (2 * k + shift)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        ks = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(ks, lambda k: k.cast("double")), start, step, lambda acc: acc["total"])

    series = fold(F.when(odd, cos).otherwise(F.lit(1.0)), F.when(odd, 1.0).otherwise(0.0))
    area_odd = (theta + F.when(dof > 1, sin * series).otherwise(0.0)) * (2 / math.pi)
    area = F.when(odd, area_odd).otherwise(sin * series)
    return F.when(dof >= 1, F.greatest(F.lit(0.0), 1 - area))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided standard normal p-value, with full relative precision in the tails.

    Near 0 one minus the all-positive error-function series; beyond ``x = 2`` the
    continued fraction of the complement itself, so that small values keep their digits.
    """
    size = F.abs(z) / math.sqrt(2.0)
    x = F.least(size, F.lit(2.0))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ks = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: k.cast("double"))
    total = F.aggregate(ks, start, step, lambda acc: acc["total"])
    erf = total * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    far = F.greatest(size, F.lit(2.0))
    down = F.transform(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), lambda k: k.cast("double") / 2)
    tail = F.exp(-far * far) / (far + F.aggregate(down, F.lit(0.0), lambda acc, k: k / (far + acc))) / math.sqrt(math.pi)
    return F.when(z.isNotNull(), F.when(size > 2.0, tail).otherwise(1 - erf))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def hash_int(*parts: Column | str | int) -> Column:
    """Uniform 48-bit integer from the identity of a draw.

    Counter-based: the value depends only on the named counters, so results do
    not change with partitioning, retries or executor loss.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("long")
