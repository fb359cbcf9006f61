"""What counts as missing, and what becomes of rows that miss something."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from designloom.functions.chunks import as_array


@dataclass(frozen=True)
class NAAction:
    """``on_NA``: "drop" or "raise"; ``NA_types``: any of "None" (null categories) and "NaN" (NaN, and null numbers)."""

    on_NA: str = "drop"  # noqa: N815
    NA_types: tuple[str, ...] = ("None", "NaN")

    def __init__(self, on_NA: str = "drop", NA_types: Sequence[str] = ("None", "NaN")) -> None:  # noqa: N803
        if on_NA not in ("drop", "raise"):
            raise ValueError(f"invalid on_NA action {on_NA!r} (should be 'drop' or 'raise')")
        if isinstance(NA_types, str):
            raise ValueError("NA_types should be a sequence of strings")
        for kind in NA_types:
            if kind not in ("None", "NaN"):
                raise ValueError(f"invalid NA_type {kind!r} (should be 'None' or 'NaN')")
        object.__setattr__(self, "on_NA", on_NA)
        object.__setattr__(self, "NA_types", tuple(NA_types))

    # Subclasses may redefine these two, for values as Python has them.

    def is_numerical_NA(self, values: np.ndarray) -> np.ndarray:  # noqa: N802
        """Which rows of an array of numbers (one row or several columns each) are missing."""
        missing = np.isnan(np.asarray(values, dtype=float)) if "NaN" in self.NA_types else np.zeros(np.shape(values), bool)
        return missing.any(axis=1) if missing.ndim > 1 else missing

    def is_categorical_NA(self, value: object) -> bool:  # noqa: N802
        """Whether one value of a categorical factor is missing."""
        if value is None:
            return "None" in self.NA_types
        return "NaN" in self.NA_types and isinstance(value, float) and math.isnan(value)

    def redefines(self, name: str) -> bool:
        return getattr(type(self), name) is not getattr(NAAction, name)

    def numerical(self, columns: Sequence[Column]) -> Column | None:
        """Rows where any of ``columns`` is missing; None if none can be."""
        if self.redefines("is_numerical_NA"):
            return self._asked(F.array(*columns) if len(columns) > 1 else columns[0])
        if "NaN" not in self.NA_types:
            return None
        found = None
        for c in columns:
            one = c.isNull() | F.isnan(c)
            found = one if found is None else found | one
        return found

    def _asked(self, column: Column) -> Column:
        @F.pandas_udf("boolean")
        def missing(series: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(self.is_numerical_NA(as_array(series)), dtype=bool))

        return missing(column)

    def array(self, column: Column) -> Column | None:
        """The same for the elements of an array column."""
        if self.redefines("is_numerical_NA"):
            return self._asked(column)
        return column.isNull() | F.exists(column, lambda x: x.isNull() | F.isnan(x)) if "NaN" in self.NA_types else None

    def categorical(self, column: Column, is_float: bool) -> Column | None:
        if self.redefines("is_categorical_NA"):

            @F.pandas_udf("boolean")
            def missing(series: pd.Series) -> pd.Series:
                return pd.Series([bool(self.is_categorical_NA(None if v is None or v is pd.NA else v)) for v in series], dtype=bool)

            return missing(column)
        found = column.isNull() if "None" in self.NA_types else None
        if is_float and "NaN" in self.NA_types:
            found = F.isnan(column) if found is None else found | F.isnan(column)
        return found

    def is_level(self, value: object) -> bool:
        """Whether a value that the data hold is a level of its factor."""
        return not self.is_categorical_NA(value)


def as_action(action: str | NAAction) -> NAAction:
    return NAAction(on_NA=action) if isinstance(action, str) else action
