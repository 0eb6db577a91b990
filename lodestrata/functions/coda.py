"""Log-ratio algebra on compositions: functions of columns, so Catalyst sees every expression.

A composition is a list of column names or columns (its parts).  Results are lists of columns in the same order.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Parts = list[str] | list[Column]


def _columns(parts: Parts) -> list[Column]:
    return [F.col(p) if isinstance(p, str) else p for p in parts]


def total(parts: Parts) -> Column:
    return reduce(add, _columns(parts))


def closure(parts: Parts, check: bool = False) -> list[Column]:
    """Parts divided by their sum; with ``check``, negative parts and zero sums raise an error."""
    x = _columns(parts)
    whole = total(x)
    if check:
        ok = reduce(lambda a, b: a & b, [c >= 0 for c in x]) & (whole > 0)
        whole = F.when(ok, whole).otherwise(F.raise_error(F.lit("a composition needs non-negative parts and a positive sum")))
    return [F.try_divide(c, whole) for c in x]


def multiplicative_replacement(parts: Parts, delta: float | None = None) -> list[Column]:
    """Closed parts with zeros (and values below) replaced by ``delta``, the others shrunk in proportion."""
    x = [F.greatest(c, F.lit(0.0)) for c in _columns(parts)]
    delta = (1 / len(x)) ** 2 if delta is None else delta
    zeros = reduce(add, [F.when(c <= 0, 1).otherwise(0) for c in x])
    return [F.when(c <= 0, F.lit(delta)).otherwise(y * (1 - zeros * delta)) for c, y in zip(x, closure(x))]


def _mean_ln(parts: list[Column]) -> Column:
    return reduce(add, [F.ln(c) for c in parts]) / len(parts)


def clr(parts: Parts) -> list[Column]:
    x = _columns(parts)
    middle = _mean_ln(x)
    return [F.ln(c) - middle for c in x]


def clr_inv(parts: Parts) -> list[Column]:
    return closure([F.exp(c) for c in _columns(parts)])


def alr(parts: Parts, denominator: int = 0) -> list[Column]:
    x = _columns(parts)
    return [F.ln(c) - F.ln(x[denominator]) for i, c in enumerate(x) if i != denominator]


def alr_inv(coords: Parts, denominator: int = 0) -> list[Column]:
    x = [F.exp(c) for c in _columns(coords)]
    return closure(x[:denominator] + [F.lit(1.0)] + x[denominator:])


def ilr_basis(parts: int) -> list[list[float]]:
    """Orthonormal contrasts: the first k+1 parts against the next."""
    out = []
    for k in range(1, parts):
        scale = math.sqrt(k / (k + 1))
        out.append([scale / k] * k + [-scale] + [0.0] * (parts - k - 1))
    return out


def ilr(parts: Parts, basis: list[list[float]] | None = None) -> list[Column]:
    x = [F.ln(c) for c in _columns(parts)]
    return [reduce(add, [c * w for c, w in zip(x, row) if w]) for row in basis or ilr_basis(len(x))]


def ilr_inv(coords: Parts, basis: list[list[float]] | None = None) -> list[Column]:
    z = _columns(coords)
    basis = basis or ilr_basis(len(z) + 1)
    return clr_inv([reduce(add, [c * row[i] for c, row in zip(z, basis)]) for i in range(len(basis[0]))])


def perturb(parts: Parts, other: Parts) -> list[Column]:
    return closure([a * b for a, b in zip(_columns(parts), _columns(other))])


def perturb_difference(parts: Parts, center: Parts) -> list[Column]:
    """Closed parts, each divided by the centre's, and closed."""
    return closure([F.try_divide(a, b) for a, b in zip(closure(parts), _columns(center))])


def power(parts: Parts, exponent: float) -> list[Column]:
    return closure([F.pow(c, F.lit(exponent)) for c in _columns(parts)])


def group_balance(numerator: Parts, denominator: Parts) -> Column:
    """sqrt(rs/(r+s)) times the difference of the groups' mean logarithms."""
    num, den = _columns(numerator), _columns(denominator)
    r, s = len(num), len(den)
    if not r or not s:
        raise ValueError("both groups need a part")
    return math.sqrt(r * s / (r + s)) * (_mean_ln(num) - _mean_ln(den))


def balance_of(df: DataFrame, numerator: list[str], denominator: list[str]) -> Column:
    """A balance of the parts that ``df`` has; counts are taken after absent parts are dropped."""
    if both := set(numerator) & set(denominator):
        raise ValueError(f"parts in both groups: {sorted(both)}")
    have = set(df.columns)
    return group_balance([p for p in numerator if p in have], [p for p in denominator if p in have])


def symmetric_coefficients(parts: int) -> tuple[float, float]:
    if parts < 3:
        raise ValueError("symmetric balances need three parts")
    common = parts - 1 + math.sqrt(parts * (parts - 2))
    return 1 / common, (parts - 2 + math.sqrt(parts)) / (math.sqrt(parts - 2) * common)


def symmetric_balance(parts: Parts, i: int, j: int, zero_sum: bool = False) -> tuple[Column, Column]:
    """The pair of symmetric balances of parts i and j.

    As defined it is no log-contrast (coefficients do not add up to zero), so give closed parts.  ``zero_sum`` gives the
    variant whose coefficients do: each balance of one part against weighted others.
    """
    x = [F.ln(c) for c in _columns(parts)]
    d = len(x)
    if i == j:
        raise ValueError("two different parts are needed")
    alpha, beta = symmetric_coefficients(d)
    others = reduce(add, [c for k, c in enumerate(x) if k not in (i, j)])
    scale = math.sqrt((d - 1 + math.sqrt(d * (d - 2))) / (2 * d))
    if zero_sum:
        beta = (1 - alpha) / (d - 2)
        return scale * (x[i] - alpha * x[j] - beta * others), scale * (x[j] - alpha * x[i] - beta * others)
    shared = alpha * (x[i] + x[j]) - beta * others
    return scale * (x[i] - x[j]) + shared, -scale * (x[i] - x[j]) + shared


def center_aggregates(parts: Parts) -> list[Column]:
    """Aggregates for a compositional centre: geometric means of closed parts, still to be closed."""
    return [F.exp(F.avg(F.ln(c))) for c in closure(parts)]


def center(df: DataFrame, parts: list[str], by: list[str] | None = None, suffix: str = "") -> DataFrame:
    """One closed geometric-mean composition for all rows or for each group."""
    means = df.groupBy(*(by or [])).agg(*[a.alias(p) for a, p in zip(center_aggregates(parts), parts)])
    return means.select(*(by or []), *[c.alias(p + suffix) for c, p in zip(closure(parts), parts)])


def centralize(df: DataFrame, parts: list[str]) -> DataFrame:
    """``df`` with its parts divided by their centre; the centre is one row."""
    mid = center(df, parts, suffix="__center")
    moved = perturb_difference(parts, [p + "__center" for p in parts])
    return df.crossJoin(F.broadcast(mid)).withColumns(dict(zip(parts, moved))).drop(*[p + "__center" for p in parts])
