"""Small data sets by rule: full factorial designs, and demonstration data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designloom.plans.errors import FormulaError


def balanced(spark: SparkSession, *, repeat: int = 1, **levels: int) -> DataFrame:
    """All combinations of ``levels`` (name -> number), ``repeat`` times; the last name in order varies fastest.

    Rows come from a range by arithmetic; nothing is joined or collected.
    """
    names = sorted(levels)
    size = math.prod(levels.values())
    rows, stride, columns = spark.range(size * repeat), size, []
    for name in names:
        stride //= levels[name]
        number = F.floor(F.col("id") / F.lit(stride)) % levels[name] + 1
        columns.append(F.concat(F.lit(name), number.cast("string")).alias(name))
    return rows.select(*columns)


def demo_data(spark: SparkSession, *names: str, nlevels: int = 2, min_rows: int = 5) -> DataFrame:
    """Names from a to n are balanced factors, from p to z standard normal draws (in order of names, seed 0)."""
    factors, numbers = [], []
    for name in names:
        if "a" <= name[:1] <= "n":
            factors.append(name)
        elif "p" <= name[:1] <= "z":
            numbers.append(name)
        else:
            raise FormulaError(f"bad name {name!r}")
    size = nlevels ** len(set(factors))
    rows = size * math.ceil(min_rows / size)
    columns: dict[str, list] = {}
    ordered = sorted(set(factors))
    for k, name in enumerate(ordered):
        stride = nlevels ** (len(ordered) - 1 - k)
        columns[name] = [f"{name}{i // stride % nlevels + 1}" for i in range(rows)]
    random = np.random.RandomState(0)
    for name in sorted(set(numbers)):
        columns[name] = random.normal(size=rows).tolist()
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns)) if columns else spark.createDataFrame([()] * rows, "")
