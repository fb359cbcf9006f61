"""Data in pieces, for what users write in Python."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a piece, and rows that tell what a function returns.
CHUNK_ROWS, PROBE_ROWS = 10_000, 100


def as_array(values: object) -> np.ndarray:
    """A column as NumPy has it: numbers with NaN for null, arrays as rows, anything else as objects."""
    values = list(values)
    first = next((v for v in values if v is not None), None)
    if isinstance(first, (list, tuple, np.ndarray)):
        gap = np.full(len(first), np.nan)
        return np.array([gap if v is None else v for v in values], dtype=float)
    if isinstance(first, (bool, np.bool_)) and None not in values:
        return np.array(values, dtype=bool)
    if isinstance(first, (int, float, np.number)) and not isinstance(first, (bool, np.bool_)):
        return np.array([np.nan if v is None else v for v in values], dtype=float if None in values else None)
    return np.array(values, dtype=object)


def chunks(df: DataFrame, rows: int = CHUNK_ROWS) -> Iterator[dict[str, np.ndarray]]:
    """Columns of pieces of ``df`` in order; the driver holds a partition or two at a time."""
    stream = df.toLocalIterator(prefetchPartitions=True)
    while part := list(islice(stream, rows)):
        yield {name: as_array(column) for name, column in zip(df.columns, zip(*part, strict=True), strict=True)}


def kind_of(found: object) -> tuple[str, int]:
    """What a function returned: "num", "bool" or "text", and its number of columns (0 for a plain one)."""
    array = np.asarray(found)
    if array.ndim == 2:
        return "num", array.shape[1]
    if array.dtype.kind == "O":
        array = np.asarray([v for v in array.ravel() if v is not None][:1])
        array = np.asarray(array.tolist())
    return ("bool" if array.dtype.kind == "b" else "text" if array.dtype.kind in "US" else "num"), 0


#: Types of Spark by kind.
SPARK_TYPES = {"num": "double", "bool": "boolean", "text": "string"}


def spark_type(kind: str, width: int) -> str:
    return "array<double>" if width else SPARK_TYPES[kind]


def as_series(found: object, rows: int, kind: str, width: int) -> pd.Series:
    """What a function returned, as a column of ``rows`` rows."""
    if width:
        return pd.Series(list(np.asarray(found, dtype=float).reshape(rows, width)))
    if kind == "num":
        return pd.Series(np.broadcast_to(np.asarray(found, dtype=float), rows))
    return pd.Series(np.broadcast_to(np.asarray(found, dtype=object), rows), dtype=object)
