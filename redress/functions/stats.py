"""Chi-square tail probability as a column expression.

The p-value is the regularised upper incomplete gamma Q(dof / 2, chi2 / 2),
by its power series below a + 1 and by the Lentz continued fraction above
(the usual split; both converge fast on their side).  Both are folds over a
sequence of step numbers whose length follows the degrees of freedom, so all
of it stays in the JVM.  ln gamma of a half or whole number is a sum of
logarithms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _steps(count: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int"))


def _log_gamma_half(dof: Column) -> Column:
    """ln gamma(dof / 2) for whole dof >= 1: the logarithms of 1 .. dof/2 - 1,
    or of 1/2, 3/2 .. dof/2 - 1 and of the root of pi."""
    odd = dof % 2
    last = F.floor((dof + odd) / 2) - 1
    shift = odd.cast("double") / 2
    add = lambda acc, k: acc + F.when(k <= last, F.log(k - shift)).otherwise(0.0)
    return F.aggregate(_steps(last), odd.cast("double") * (math.log(math.pi) / 2), add)


def _series(a: Column, x: Column, steps: Column) -> Column:
    """sum of x^n / (a (a + 1) .. (a + n))."""
    first = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(steps, first, add)["total"]


def _fraction(a: Column, x: Column, steps: Column) -> Column:
    """1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ..))."""
    apart = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    b = x + 1.0 - a
    start = F.lit(1.0) / apart(b)
    first = F.struct(F.lit(1.0 / _TINY).alias("c"), start.alias("d"), start.alias("h"))

    def add(acc: Column, i: Column) -> Column:
        an, bn = -i * (i - a), b + i * 2.0
        d = F.lit(1.0) / apart(an * acc["d"] + bn)
        c = apart(bn + an / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    return F.aggregate(steps, first, add)["h"]


def chi2_p_value(statistic: Column, dof: Column) -> Column:
    """Column of chi-square upper-tail probabilities; dof 0 gives 1, a null
    or NaN statistic or a null dof gives NaN."""
    s, k = statistic.cast("double"), dof.cast("long")
    a, x = k.cast("double") / 2, s / 2
    steps = _steps(F.lit(100) + 12 * F.sqrt(a + 1))
    front = F.exp(a * F.log(x) - x - _log_gamma_half(k))
    below = F.greatest(F.lit(0.0), F.lit(1.0) - _series(a, x, steps) * front)
    return (
        F.when(s.isNull() | k.isNull() | F.isnan(s), F.lit(float("nan")))
        .when((k <= 0) | (x <= 0), F.lit(1.0))
        .when(x < a + 1, below)
        .otherwise(front * _fraction(a, x, steps))
    )
