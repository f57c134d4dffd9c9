"""Eigenvectors of small symmetric matrices as column expressions: cyclic Jacobi rotations, a fixed number of sweeps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let


def _rotated(state: Column, n: int, p: int, q: int) -> Column:
    """state after the rotation that makes entry (p, q) zero."""
    a = lambda s, i, j: s[f"a{min(i, j)}{max(i, j)}"]
    apart = (a(state, q, q) - a(state, p, p)) / (2 * a(state, p, q))
    tangent = F.when(a(state, p, q) == 0, 0.0).otherwise(F.when(apart < 0, -1.0).otherwise(1.0) / (F.abs(apart) + F.sqrt(apart * apart + 1)))

    def turn(t: Column) -> Column:
        new = {(i, j): a(state, i, j) for i in range(n) for j in range(i, n)}
        new[p, p] = a(state, p, p) - t["t"] * a(state, p, q)
        new[q, q] = a(state, q, q) + t["t"] * a(state, p, q)
        new[p, q] = F.lit(0.0)
        for r in set(range(n)) - {p, q}:
            new[min(r, p), max(r, p)] = t["c"] * a(state, r, p) - t["s"] * a(state, r, q)
            new[min(r, q), max(r, q)] = t["s"] * a(state, r, p) + t["c"] * a(state, r, q)
        v = {(i, j): state[f"v{i}{j}"] for i in range(n) for j in range(n)}
        for i in range(n):
            v[i, p], v[i, q] = t["c"] * v[i, p] - t["s"] * v[i, q], t["s"] * v[i, p] + t["c"] * v[i, q]
        return F.struct(*[x.alias(f"a{i}{j}") for (i, j), x in new.items()], *[x.alias(f"v{i}{j}") for (i, j), x in v.items()])

    def angles(t: Column) -> Column:
        c = 1 / F.sqrt(t * t + 1)
        return F.struct(t.alias("t"), c.alias("c"), (t * c).alias("s"))

    return let(tangent, lambda t: let(angles(t), turn))


def symmetric(entries: Mapping[tuple[int, int], Column], n: int, sweeps: int = 8) -> Column:
    """Array of struct(value, vector) of the matrix with entries (i, j), i <= j < n, by ascending value; vectors have length
    1 and any sign."""
    start = F.struct(
        *[entries[i, j].cast("double").alias(f"a{i}{j}") for i in range(n) for j in range(i, n)],
        *[F.lit(float(i == j)).alias(f"v{i}{j}") for i in range(n) for j in range(n)],
    )

    def sweep(state: Column, _) -> Column:
        pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]
        step = lambda s, k: _rotated(s, n, *pairs[k]) if k == len(pairs) - 1 else let(_rotated(s, n, *pairs[k]), lambda x: step(x, k + 1))
        return step(state, 0)

    def sorted_pairs(s: Column) -> Column:
        return F.array_sort(F.array(*[F.struct(s[f"a{j}{j}"].alias("value"), F.array(*[s[f"v{i}{j}"] for i in range(n)]).alias("vector")) for j in range(n)]))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, sweep), sorted_pairs)


def led_positive(vector: Column, n: int) -> Column:
    """vector with the sign that makes its largest component (the first of equal ones) positive."""
    largest = lambda v: F.array_max(F.transform(v, F.abs))
    lead = lambda v: F.element_at(F.filter(v, lambda x: F.abs(x) == largest(v)), 1)
    return let(vector, lambda v: F.transform(v, lambda x: F.when(lead(v) < 0, -x).otherwise(x)))
