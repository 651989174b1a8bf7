"""Names that several test files share.  They are not in ``conftest.py``:
every folder of tests may have a module of that name."""

from __future__ import annotations

import datetime as dt
import math

from redress.sources.complaints import COMPLAINT_SCHEMA

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def complaint(**values):
    """A complaint row as a tuple in schema order; unnamed columns are null."""
    names = [f.name for f in COMPLAINT_SCHEMA.fields]
    unknown = set(values) - set(names)
    assert not unknown, unknown
    return tuple(values.get(n) for n in names)


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


_EPS = 1e-16
_TINY = 1e-300
_MAX_ITER = 10_000


def _upper_gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) for a > 0, x >= 0."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = 1.0 / a
        total = term
        ap = a
        for _ in range(_MAX_ITER):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        if abs(d) < _TINY:
            d = _TINY
        c = b + an / c
        if abs(c) < _TINY:
            c = _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(log_front) * h


def chi2_sf(statistic: float, dof: int) -> float:
    """P(X >= statistic) for X ~ chi-square(dof); dof 0 gives 1.0."""
    if statistic is None or dof is None or (isinstance(statistic, float) and math.isnan(statistic)):
        return float("nan")
    if dof <= 0:
        return 1.0
    return _upper_gamma_q(dof / 2.0, statistic / 2.0)
