"""Exact quantiles whose state stays small, however many values there are."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values, or rows, that are brought to the driver with their counts.
SETTLED = 50_000
#: Accuracy of the sketches that narrow the search.
ACCURACY = 10_000


def quantiles(df: DataFrame, column: Column, probabilities: Sequence[float], *, distinct: bool = False) -> list[float] | None:
    """Quantiles of the non-null values (each once, with ``distinct``), linear between neighbours; None without values.

    Few distinct values are counted and looked up. Otherwise sketches give brackets
    that hold the wanted ranks for certain, and the search goes on inside them.
    """
    values = df.select(column.cast("double").alias("x")).where("x IS NOT NULL")
    if distinct:
        values = values.distinct()
    n, different = values.agg(F.count("*"), F.approx_count_distinct("x")).first()
    if not n:
        return None
    places = [p * (n - 1) for p in probabilities]
    at = _at_ranks(values, {r for p in places for r in (math.floor(p), math.ceil(p))}, n, different <= SETTLED)
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def _at_ranks(values: DataFrame, ranks: set[int], n: int, few: bool) -> dict[int, float]:
    """The values of the given ranks in order, from 0."""
    found: dict[int, float] = {}
    # Brackets: lowest and highest value, rows below, rows inside; and their ranks.
    brackets: dict[tuple, set[int]] = {(None, None, 0, n): set(ranks)}
    while brackets:
        narrower: dict[tuple, set[int]] = {}
        for (low, high, below, size), mine in brackets.items():
            if low is not None and low == high:
                found |= dict.fromkeys(mine, low)
                continue
            inside = values if low is None else values.where(F.col("x").between(low, high))
            if few or size <= SETTLED:
                found |= _counted(inside, mine, below)
                continue
            order, asked = sorted(mine), []
            for r in order:
                share, slack = (r - below) / (size - 1), 2 / ACCURACY
                asked += [max(0.0, share - slack), min(1.0, share + slack)]
            ends = inside.agg(F.percentile_approx("x", F.array(*map(F.lit, asked)), F.lit(ACCURACY))).first()[0]
            pairs = list(zip(ends[::2], ends[1::2], strict=True))
            counts = inside.agg(*(F.count(F.when(test, True)) for a, b in pairs for test in (F.col("x") < a, F.col("x").between(a, b)))).first()
            for k, r in enumerate(order):
                bracket = (*pairs[k], below + counts[2 * k], counts[2 * k + 1])
                if not bracket[2] <= r < bracket[2] + bracket[3] or bracket[3] == size:
                    # A sketch off its promise narrows nothing: count instead.
                    found |= _counted(inside, {r}, below)
                else:
                    narrower.setdefault(bracket, set()).add(r)
        brackets = narrower
    return found


def _counted(inside: DataFrame, ranks: set[int], below: int) -> dict[int, float]:
    found, at = {}, below
    for value, many in sorted(tuple(r) for r in inside.groupBy("x").count().collect()):
        found |= {r: value for r in ranks if at <= r < at + many}
        at += many
    return found
