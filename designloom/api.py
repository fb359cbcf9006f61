"""What users call."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from designloom.functions.compile import Env
from designloom.functions.levels import Names
from designloom.operators.fit import design_matrix_builders
from designloom.operators.missing import NAAction
from designloom.plans.algebra import ModelDesc
from designloom.plans.design import DesignInfo, build_design_matrices
from designloom.plans.errors import FormulaError


#: Columns up to which a design is planned before anyone asks for some of them.
EAGER_COLUMNS = 256


class DesignMatrix:
    """A Spark DataFrame ``df`` whose columns are those of ``design_info`` (after any kept ones).

    It may be given by a function of the names of wanted columns (None: all). Then
    ``df`` is made when it is asked for, and ``select`` plans what it selects alone.
    """

    def __init__(self, df: DataFrame | Callable[[Sequence[str] | None], DataFrame], design_info: DesignInfo, prefix: str = "", keep: Sequence[str] = ()) -> None:
        self._made, self.design_info, self.prefix, self.keep = df, design_info, prefix, tuple(keep)

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._made, DataFrame):
            self._made = self._made(None)
        return self._made

    def select(self, *names: str) -> DataFrame:
        """Columns of ``df`` by name, kept ones included."""
        found = self._made if isinstance(self._made, DataFrame) else self._made([n for n in dict.fromkeys(names) if n not in self.keep])
        return found.select(*(F.col("`" + n.replace("`", "``") + "`") for n in names))

    def select_term(self, what: object) -> DataFrame:
        return self.select(*(self.prefix + n for n in self.design_info.column_names[self.design_info.slice(what)]))

    def to_numpy(self) -> np.ndarray:
        found = self.df.toArrow()
        return np.column_stack([found.column(self.prefix + n).to_numpy() for n in self.design_info.column_names])

    def __repr__(self) -> str:
        return show(self)

    def _repr_pretty_(self, printer: object, cycle: bool) -> None:
        printer.text("DesignMatrix(...)" if cycle else show(self))


def _made(make: Callable[[Sequence[str] | None], DataFrame], *designs: DesignInfo) -> DataFrame | Callable[[Sequence[str] | None], DataFrame]:
    """All columns, which shows errors at once; of wide designs only those asked for, and then."""
    return make if any(isinstance(d.column_names, Names) or len(d.column_names) > EAGER_COLUMNS for d in designs) else make(None)


def _env(env: Env | int) -> Env:
    return env if isinstance(env, Env) else Env.capture(env + 2)


def _model(formula_like: object) -> ModelDesc:
    if hasattr(formula_like, "__model_desc__"):
        formula_like = formula_like.__model_desc__()
        if not isinstance(formula_like, ModelDesc):
            raise FormulaError("bad value from __model_desc__")
    if isinstance(formula_like, str):
        return ModelDesc.from_formula(formula_like)
    if isinstance(formula_like, ModelDesc):
        return formula_like
    raise FormulaError(f"can't understand a formula of type {type(formula_like).__name__}")


def _data(data: DataFrame | Sequence[DataFrame] | None) -> DataFrame:
    """A DataFrame, or the union of several (chunks)."""
    if data is None or not isinstance(data, DataFrame) and not len(data):
        raise FormulaError("without data there is no number of rows; give a DataFrame")
    return data if isinstance(data, DataFrame) else reduce(DataFrame.unionByName, data)


def _designs(formula_like: object, data: DataFrame, env: Env, NA_action: str | NAAction) -> tuple[DesignInfo, DesignInfo]:  # noqa: N803
    if isinstance(formula_like, DesignInfo):
        return DesignInfo([], {}, {}), formula_like
    if isinstance(formula_like, tuple) and len(formula_like) == 2 and all(isinstance(d, DesignInfo) for d in formula_like):
        return formula_like
    model = _model(formula_like)
    left, right = design_matrix_builders([model.lhs, model.rhs], data, env, NA_action)
    return left, right


def incr_dbuilder(formula_like: object, data: DataFrame | Sequence[DataFrame], env: Env | int = 0, NA_action: str | NAAction = "drop") -> DesignInfo:  # noqa: N803
    """Fit a design without an outcome."""
    left, right = _designs(formula_like, _data(data), _env(env), NA_action)
    if left.column_names:
        raise FormulaError("encountered outcome variables for a model that does not expect them")
    return right


def incr_dbuilders(formula_like: object, data: DataFrame | Sequence[DataFrame], env: Env | int = 0, NA_action: str | NAAction = "drop") -> tuple[DesignInfo, DesignInfo]:  # noqa: N803
    """Fit designs of outcome and predictors."""
    left, right = _designs(formula_like, _data(data), _env(env), NA_action)
    if not left.column_names:
        raise FormulaError("model is missing required outcome variables")
    return left, right


def _numbers(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> tuple[list[str], list[Column]]:
    """Columns of a DataFrame of numbers; those of an array are named by ``prefix`` and their place."""
    names, columns = [], []
    for field in df.schema.fields:
        if field.name in keep:
            continue
        column = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, T.ArrayType):
            first = df.select(F.size(column)).first()
            elements = [F.get(column, F.lit(i)).cast("double") for i in range(max(0, first[0] if first else 0))]
            names += [f"{prefix}{len(names) + i}" for i in range(len(elements))]
            columns += elements
        else:
            names.append(field.name)
            columns.append(column.cast("double"))
    return names, columns


def _passed_through(formula_like: object) -> DesignMatrix | None:
    """A matrix instead of a formula: a DataFrame of numbers."""
    if isinstance(formula_like, DesignMatrix):
        return formula_like
    if isinstance(formula_like, DataFrame):
        names, columns = _numbers(formula_like, "x")
        return DesignMatrix(formula_like.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), DesignInfo(names))
    return None


def _passed_pair(pair: tuple, keep: Sequence[str], prefixes: Sequence[str]) -> tuple[DesignMatrix, DesignMatrix]:
    """Two matrices instead of a formula. Rows of DataFrames have no order: columns ``keep``, which both have, tell which belong together."""
    if not keep:
        raise FormulaError("two DataFrames have no common order of rows; name the columns that match them with keep=")
    sides, infos = [], []
    for frame, prefix, letter in zip(pair, prefixes, "yx", strict=True):
        if isinstance(frame, DesignMatrix):
            mine = [frame.prefix + n for n in frame.design_info.column_names]
            names, columns, frame = frame.design_info.column_names, [F.col("`" + n.replace("`", "``") + "`") for n in mine], frame.df
        else:
            names, columns = _numbers(frame, letter, keep)
        sides.append(frame.select(*keep, *[c.alias(prefix + n) for c, n in zip(columns, names, strict=True)]))
        infos.append(DesignInfo(names))
    both = sides[0].join(sides[1], list(keep))
    return DesignMatrix(both, infos[0], prefixes[0]), DesignMatrix(both, infos[1], prefixes[1])


def dmatrix(
    formula_like: object, data: DataFrame | Sequence[DataFrame] | None = None, env: Env | int = 0, NA_action: str | NAAction = "drop", return_type: str = "matrix", *, keep: Sequence[str] = (), dtype: str = "double"  # noqa: N803
) -> DesignMatrix | object:
    """One design matrix. ``return_type``: "matrix" (lazy), or "dataframe" (pandas)."""
    if return_type not in ("matrix", "dataframe"):
        raise FormulaError(f"unrecognized output type {return_type!r}, should be 'matrix' or 'dataframe'")
    if isinstance(formula_like, tuple) and any(isinstance(x, (DataFrame, DesignMatrix)) for x in formula_like):
        raise FormulaError("outcome and predictors are given, where predictors alone are asked for")
    found = _passed_through(formula_like)
    if found is None:
        data = _data(data)
        left, right = _designs(formula_like, data, _env(env), NA_action)
        if left.column_names:
            raise FormulaError("encountered outcome variables for a model that does not expect them")
        found = DesignMatrix(_made(lambda columns: build_design_matrices([right], data, NA_action, keep=keep, dtype=dtype, columns=columns), right), right, keep=keep)
    return found.df.toPandas() if return_type == "dataframe" else found


def dmatrices(
    formula_like: object, data: DataFrame | Sequence[DataFrame] | None = None, env: Env | int = 0, NA_action: str | NAAction = "drop", return_type: str = "matrix", *,  # noqa: N803
    keep: Sequence[str] = (), prefixes: Sequence[str] = ("y.", "X."), dtype: str = "double",
) -> tuple[DesignMatrix, DesignMatrix] | object:
    """Outcome and predictors, as two views of one DataFrame with prefixed columns, so rows stay aligned.

    A pair of matrices (DataFrames of numbers) passes through, matched by the columns ``keep``.
    """
    if isinstance(formula_like, tuple) and len(formula_like) == 2 and all(isinstance(x, (DataFrame, DesignMatrix)) for x in formula_like):
        one, two = _passed_pair(formula_like, keep, prefixes)
        both, left, right = one.df, one.design_info, two.design_info
    else:
        data = _data(data)
        left, right = _designs(formula_like, data, _env(env), NA_action)
        if not left.column_names:
            raise FormulaError("model is missing required outcome variables")
        both = _made(lambda columns: build_design_matrices([left, right], data, NA_action, keep=keep, prefixes=prefixes, dtype=dtype, columns=columns), left, right)
    if return_type == "dataframe":
        pandas = (both if isinstance(both, DataFrame) else both(None)).toPandas()
        n = len(keep) + len(left.column_names)
        return pandas.iloc[:, len(keep) : n].set_axis(left.column_names, axis=1), pandas.iloc[:, n:].set_axis(right.column_names, axis=1)
    return DesignMatrix(both, left, prefixes[0], keep), DesignMatrix(both, right, prefixes[1], keep)


def formatted(column: Sequence[float], precision: int = 5) -> list[str]:
    """Numbers of a column with the fewest decimals, up to ``precision``, that all of them need."""
    texts = [f"{v:.{precision}f}" for v in column]
    while any("." in t for t in texts) and all(t[-1] in "0." for t in texts if "." in t):
        last = {t[-1] for t in texts if "." in t}
        texts = [t[:-1] if "." in t else t for t in texts]
        if "." in last:
            break
    return texts


def show(matrix: DesignMatrix, *, max_rows: int = 30, max_width: int = 78, precision: int = 5) -> str:
    """A table of the first rows, and the columns of each term. The data are read for one row more."""
    info = matrix.design_info
    names = [matrix.prefix + n for n in info.column_names]
    rows = [tuple(r) for r in matrix.df.select(*("`" + n.replace("`", "``") + "`" for n in names)).limit(max_rows + 1).collect()]
    more, rows = len(rows) > max_rows, rows[:max_rows]
    columns = [formatted([r[i] for r in rows], precision) for i in range(len(names))]
    widths = [max([len(n), *map(len, c)]) for n, c in zip(info.column_names, columns, strict=True)]
    lines = [f"DesignMatrix with {len(names)} columns" + (f" (more than {max_rows} rows)" if more else f" and {len(rows)} rows")]
    if sum(widths) + 2 * len(widths) <= max_width:
        lines.append("".join(f"  {n:>{w}}" for n, w in zip(info.column_names, widths, strict=True)))
        lines += ["".join(f"  {c[k]:>{w}}" for c, w in zip(columns, widths, strict=True)) for k in range(len(rows))]
        lines += ["  [rows omitted]"] * more
    else:
        lines.append("  Columns:\n    " + repr(info.column_names))
    lines.append("  Terms:")
    lines += [f"    {name!r} (" + (f"column {s.start}" if s.stop - s.start == 1 else f"columns {s.start}:{s.stop}") + ")" for name, s in info.term_name_slices.items()]
    return "\n".join(lines)
