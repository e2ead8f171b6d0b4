"""Column functions over dense probability and weight arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def softmax(z: Column) -> Column:
    """Max-subtracted softmax, exponents clipped at -300."""

    def exponents(zs: Column) -> Column:
        return let(F.array_max(zs), lambda m: F.transform(zs, lambda x: F.exp(F.greatest(x - m, F.lit(-300.0)))))

    def scaled(e: Column) -> Column:
        return let(array_total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(let(z, exponents), scaled)


def log_odds(p: Column, ref: int) -> Column:
    """``ln p[ref] - ln p[k]`` for every k but ``ref``; null where a probability is 0."""

    def odds(ps: Column) -> Column:
        return let(
            F.element_at(ps, ref + 1),
            lambda base: F.transform(ps, lambda x: F.when((x > 0) & (base > 0), F.ln(base) - F.ln(x))),
        )

    return F.filter(let(p, odds), lambda _x, i: i != ref)


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first on ties."""
    return let(p, lambda ps: (F.array_position(ps, F.array_max(ps)) - 1).cast("int"))


def top_k(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == label).cast("double"))


def smooth_one_hot(label: Column, size: int) -> Column:
    """1/100 in every cell and ``1 - max_label/100`` at the label."""
    top = F.lit(1.0 - (size - 1) / 100.0)
    cells = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(cells, lambda k: F.when(k == label, top).otherwise(F.lit(0.01)))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def margin(p: Column) -> Column:
    """Minus the gap between the two largest probabilities."""
    return let(top_k(p, 2), lambda two: F.element_at(two, 2) - F.element_at(two, 1))


def square_sum(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * x)


def gradient(p: Column) -> Column:
    return -square_sum(p)


def no_score(_p: Column) -> Column:
    return F.lit(0.0)


SCORES = {"entropy": entropy, "margin": margin, "gradient": gradient, "constant": no_score}
