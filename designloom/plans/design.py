"""The fitted plan of a design matrix: factors, codings, column names; and applying it."""

from __future__ import annotations

import json
import math
import warnings
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from designloom.functions.compile import Compiler, Env, Value
from designloom.functions.contrasts import ContrastMatrix
from designloom.functions.levels import Levels, Names
from designloom.functions.stateful import Stateful
from designloom.operators.missing import NAAction, as_action

from .algebra import INTERCEPT, EvalFactor, LookupFactor, ModelDesc, Term
from .constraint import LinearConstraint, linear_constraint
from .errors import FormulaError


#: Levels that are told apart by CASE; more are looked up in a table.
CASED = 256
#: Levels whose table is broadcast; for more Spark chooses the join.
BROADCAST_LEVELS = 2_000_000


@dataclass
class FactorInfo:
    """A factor, as numbers of ``num_columns`` columns or as ``categories``; ``states`` of its transforms by call text."""

    factor: object
    kind: str
    states: dict[str, Stateful] = field(default_factory=dict)
    num_columns: int | None = None
    categories: tuple | Levels | None = None
    multi: bool = False
    #: What Python calls in the factor return (see ``Compiler``).
    shapes: dict[str, tuple[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("numerical", "categorical"):
            raise ValueError("kind must be 'numerical' or 'categorical'")
        if (self.kind == "numerical") != (self.num_columns is not None) or (self.kind == "categorical") != (self.categories is not None):
            raise ValueError("numerical factors have num_columns, categorical ones categories")


@dataclass
class SubtermInfo:
    """One primitive interaction: numbers, and a contrast matrix for each categorical factor."""

    factors: tuple
    contrast_matrices: dict
    num_columns: int


class DesignInfo:
    """Column names, factors and ordered term codings of a design; applies itself to DataFrames."""

    def __init__(self, column_names: Sequence[str], factor_infos: dict | None = None, term_codings: dict[Term, list[SubtermInfo]] | None = None, env: Env | None = None) -> None:
        self.column_names = column_names if isinstance(column_names, Names) else [str(c) for c in column_names]
        twice = None
        if isinstance(column_names, Names):
            twice = column_names.repeated()
        elif len(set(self.column_names)) < len(self.column_names):
            twice = next(c for c in self.column_names if self.column_names.count(c) > 1)
        if twice is not None:
            raise FormulaError(f"duplicate column name: {twice}")
        if (factor_infos is None) != (term_codings is None):
            raise ValueError("must specify either both or neither of factor_infos= and term_codings=")
        self.factor_infos, self.term_codings, self.env = factor_infos, term_codings, env or Env()
        self.term_slices: dict[Term, slice] | None = None
        if term_codings is not None:
            self.term_slices, at = {}, 0
            if {f for t in term_codings for f in t.factors} != set(factor_infos):
                raise ValueError("factors of the terms and factor_infos don't agree")
            for term, subterms in term_codings.items():
                for s in subterms:
                    self._check(term, s)
                width = sum(s.num_columns for s in subterms)
                self.term_slices[term] = slice(at, at + width)
                at += width
            if at != len(self.column_names):
                raise ValueError(f"mismatch between column_names and columns coded by the terms: {len(self.column_names)} and {at}")

    def _check(self, term: Term, subterm: SubtermInfo) -> None:
        if not set(subterm.factors) <= set(term.factors):
            raise ValueError("unexpected factors in subterm")
        width = 1
        for f in subterm.factors:
            info = self.factor_infos[f]
            if info.kind == "numerical":
                width *= info.num_columns
                if f in subterm.contrast_matrices:
                    raise ValueError("a numerical factor has a contrast matrix")
            else:
                rows, columns = subterm.contrast_matrices[f].shape
                if rows != len(info.categories):
                    raise ValueError("contrast matrix and categories don't agree")
                width *= columns
        if width != subterm.num_columns:
            raise ValueError(f"unexpected number of columns in subterm: {subterm.num_columns} for {width}")

    # Metadata.

    @property
    def terms(self) -> list[Term] | None:
        return None if self.term_codings is None else list(self.term_codings)

    @property
    def term_names(self) -> list[str]:
        return list(self.column_names) if self.terms is None else [t.name() for t in self.terms]

    @property
    def term_name_slices(self) -> dict[str, slice]:
        if self.term_slices is None:
            return {n: slice(i, i + 1) for i, n in enumerate(self.column_names)}
        return {t.name(): s for t, s in self.term_slices.items()}

    @property
    def builder(self) -> DesignInfo:
        """Old name: a design applies itself."""
        warnings.warn("DesignInfo.builder is the design itself; use that", DeprecationWarning, stacklevel=2)
        return self

    @property
    def design_info(self) -> DesignInfo:
        """Old name, from when designs were told from their builders."""
        warnings.warn("this is a DesignInfo already; use it itself", DeprecationWarning, stacklevel=2)
        return self

    def __repr__(self) -> str:
        if self.term_codings is None:
            return f"DesignInfo({self.column_names!r})"
        coded = {t.name(): [s.num_columns for s in subterms] for t, subterms in self.term_codings.items()}
        kinds = {f.name(): i.kind for f, i in self.factor_infos.items()}
        return f"DesignInfo({self.column_names!r}, factors={kinds!r}, columns_of_terms={coded!r})"

    def _repr_pretty_(self, printer: object, cycle: bool) -> None:
        printer.text("DesignInfo(...)" if cycle else repr(self))

    def __reduce__(self) -> tuple:
        raise TypeError("designs are written by to_json() and read by from_json(), not pickled")

    @property
    def column_name_indexes(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.column_names)}

    def names_table(self, spark: SparkSession) -> DataFrame:
        """Column names as rows of (i, column_name), however many there are."""
        return (self.column_names if isinstance(self.column_names, Names) else Names([[self.column_names]])).table(spark)

    def slice(self, what: object) -> slice:
        """Columns of a term, a term's name, a column's name, an index or a slice."""
        if isinstance(what, slice):
            return what
        if isinstance(what, int):
            return slice(what, what + 1)
        if isinstance(what, Term) and self.term_slices is not None and what in self.term_slices:
            return self.term_slices[what]
        if what in self.term_name_slices:
            return self.term_name_slices[what]
        with suppress(ValueError):
            at = self.column_names.index(what)
            return slice(at, at + 1)
        raise FormulaError(f"unknown column specified {what!r}")

    def subterm(self, at: int) -> tuple[SubtermInfo, int]:
        """The part that codes a column, and the column's place in it."""
        subterms = [s for found in self.term_codings.values() for s in found]
        starts = [0, *accumulate(s.num_columns for s in subterms)]
        which = bisect_right(starts, at) - 1
        return subterms[which], at - starts[which]

    def describe(self) -> str:
        names = ["1" if t == INTERCEPT else t.name() for t in self.terms or ()]
        return " + ".join(names if self.terms is None or INTERCEPT in self.terms else ["0", *names]) or "0"

    def linear_constraint(self, like: object) -> LinearConstraint:
        return linear_constraint(like, self.column_names)

    def subset(self, which: str | Sequence[Term | str]) -> DesignInfo:
        """The design of some terms (a formula's right side, or a list), coded as they are here."""
        if self.term_codings is None:
            raise ValueError("this design has no terms to choose from")
        if isinstance(which, str):
            found = ModelDesc.from_formula(which)
            if found.lhs:
                raise FormulaError("right-hand-side-only formula required")
            wanted = list(found.rhs)
        else:
            named = dict(zip(self.term_names, self.terms, strict=True))
            wanted = [t if isinstance(t, Term) else named[t] if t in named else self._absent(t) for t in which]
        names, codings = [], {}
        for term in wanted:
            if term not in self.term_codings:
                self._absent(term.name())
            codings[term] = self.term_codings[term]
        if isinstance(self.column_names, Names):
            parts = dict(zip([(t, k) for t, subterms in self.term_codings.items() for k in range(len(subterms))], self.column_names.parts, strict=True))
            names = Names([parts[t, k] for t, subterms in codings.items() for k in range(len(subterms))])
        else:
            names = [n for t in codings for n in self.column_names[self.term_slices[t]]]
        factors = {f: self.factor_infos[f] for t in codings for f in t.factors}
        return DesignInfo(names, factors, codings, self.env)

    @staticmethod
    def _absent(name: str) -> Term:
        raise FormulaError(f"requested term '{name}' not found in this design")

    @classmethod
    def from_columns(cls, columns: Iterable[object], default_column_prefix: str = "column") -> DesignInfo:
        return cls([c if isinstance(c, str) else f"{default_column_prefix}{c}" for c in columns])

    # JSON.

    def to_json(self) -> str:
        """Everything needed to apply the design elsewhere, save functions of the environment."""
        if self.term_codings is None:
            return json.dumps({"column_names": self.column_names})
        factors = list(self.factor_infos)
        index = {f: i for i, f in enumerate(factors)}
        return json.dumps(
            {
                "column_names": list(self.column_names),
                "factors": [_factor_json(self.factor_infos[f]) for f in factors],
                "terms": [
                    {
                        "factors": [index[f] for f in t.factors],
                        "subterms": [
                            {"factors": [index[f] for f in s.factors], "columns": s.num_columns, "contrasts": {index[f]: m.to_json() for f, m in s.contrast_matrices.items()}}
                            for s in subterms
                        ],
                    }
                    for t, subterms in self.term_codings.items()
                ],
            }
        )

    @classmethod
    def from_json(cls, text: str, env: Env | None = None) -> DesignInfo:
        data = json.loads(text)
        if "factors" not in data:
            return cls(data["column_names"])
        infos = [_factor_from(d) for d in data["factors"]]
        factors = [i.factor for i in infos]
        codings = {
            Term(factors[i] for i in t["factors"]): [
                SubtermInfo(tuple(factors[i] for i in s["factors"]), {factors[int(i)]: ContrastMatrix.from_json(m) for i, m in s["contrasts"].items()}, s["columns"]) for s in t["subterms"]
            ]
            for t in data["terms"]
        }
        return cls(data["column_names"], dict(zip(factors, infos, strict=True)), codings, env)


def _level_json(level: object) -> list:
    if isinstance(level, bytes):
        return ["bytes", level.hex()]
    if level is None or isinstance(level, (bool, int, float, str)):
        return [type(level).__name__, level]
    raise TypeError(f"levels of type {type(level).__name__} can't be written as JSON")


def _level_from(pair: list) -> object:
    return bytes.fromhex(pair[1]) if pair[0] == "bytes" else float(pair[1]) if pair[0] == "float" else pair[1]


def _factor_json(info: FactorInfo) -> dict:
    f = info.factor
    if not isinstance(f, (EvalFactor, LookupFactor)):
        raise TypeError(f"a factor of type {type(f).__name__} can't be written as JSON")
    code = {"code": f.code} if isinstance(f, EvalFactor) else {"column": f.column, "categorical": f.force_categorical, "levels": None if f.levels is None else [_level_json(v) for v in f.levels]}
    return code | {
        "kind": info.kind, "num_columns": info.num_columns, "multi": info.multi,
        "categories": None if info.categories is None else [_level_json(c) for c in info.categories],
        "states": {k: s.learned for k, s in info.states.items()},
        "shapes": info.shapes,
    }


def _factor_from(data: dict) -> FactorInfo:
    if "code" in data:
        factor: object = EvalFactor(data["code"])
    else:
        factor = LookupFactor(data["column"], data["categorical"], levels=None if data["levels"] is None else tuple(map(_level_from, data["levels"])))
    states = {}
    for key, learned in data["states"].items():
        states[key] = Stateful()
        states[key].learned = learned
    categories = None if data["categories"] is None else tuple(map(_level_from, data["categories"]))
    return FactorInfo(factor, data["kind"], states, data["num_columns"], categories, data["multi"], {k: tuple(v) for k, v in data["shapes"].items()})


# Applying designs.


def same_level(column: Column, level: object, value: Value) -> Column:
    if level is None:
        return column.isNull()
    if isinstance(level, float) and math.isnan(level):
        return F.isnan(column)
    return column == (F.lit(bytearray(level)) if isinstance(level, bytes) else F.lit(float(level)) if value.kind == "num" else F.lit(level))


def _evaluated(info: FactorInfo, compiler: Compiler, action: NAAction) -> tuple[list[Column], Column | None, Value]:
    """Columns of a factor (numbers; of a categorical one its values), when it is missing, and what it was compiled to."""
    compiler.states = info.states
    value, f = compiler.factor(info.factor), info.factor
    if info.kind == "numerical":
        if value.categorical or value.kind != "num":
            raise FormulaError(f"when evaluating factor {f.name()}, I got non-numerical data where I expected numbers", f)
        if value.array:
            array, n = value.columns[0], info.num_columns
            wrong = F.raise_error(F.lit(f"factor {f.name()} has rows of another width than {n}"))
            return [F.when(array.isNull() | (F.size(array) == n), array).otherwise(wrong.cast("array<double>"))], action.array(array), value
        columns = list(value.columns)
        if len(columns) != info.num_columns:
            raise FormulaError(f"when evaluating factor {f.name()}, I got {len(columns)} columns where I expected {info.num_columns}", f)
        return columns, action.numerical(columns[:1] if value.together else columns), value
    if not value.categorical and value.kind == "num":
        raise FormulaError(f"when evaluating numeric factor {f.name()}, I expected categories", f)
    if value.levels is not None and (len(value.levels) != len(info.categories) or tuple(value.levels) != tuple(info.categories)):
        raise FormulaError(f"mismatching levels: expected {info.categories!r}, got {tuple(value.levels)!r}", f)
    is_bool = value.kind == "bool"
    if is_bool != (not isinstance(info.categories, Levels) and all(isinstance(c, bool) for c in info.categories)) and value.kind != "text":
        raise FormulaError(f"factor {f.name()} changed between numbers and true-or-false values", f)
    return list(value.columns), action.categorical(value.columns[0], value.is_float), value


def _code(info: FactorInfo, column: Column, value: Value, looked_up: Column | None) -> Column:
    """The number of a value's level; an error for a value that is none."""
    categories = info.categories
    shown = ", ".join(map(repr, categories[:5])) + (", ..." if len(categories) > 5 else "")
    error = F.raise_error(F.concat(F.lit(f"Error converting data to categorical: factor {info.factor.name()}: observation with value "), F.coalesce(column.cast("string"), F.lit("NULL")), F.lit(f" does not match any of the expected levels (expected: {shown})"))).cast("int")
    if looked_up is not None:
        return F.coalesce(looked_up, error)
    code = None
    for i, level in enumerate(categories):
        test = same_level(column, level, value)
        code = F.when(test, F.lit(i)) if code is None else code.when(test, F.lit(i))
    return error if code is None else code.otherwise(error)


def _with_codes(df: DataFrame, name: str, info: FactorInfo, value: Value) -> DataFrame:
    """``df`` with the level's number in ``name + "_code"``, by a table of the levels of ``name``."""
    kind = df.schema[name].dataType
    if isinstance(info.categories, Levels):
        given = info.categories
        table = given.table.select(F.col("number").cast("int").alias(f"{name}_code"), F.col("level").cast(kind).alias(f"{name}_level"))
        same = F.col(name).eqNullSafe(F.col(f"{name}_level")) if given.null else F.col(name) == F.col(f"{name}_level")
        return df.join(F.broadcast(table) if len(given) <= BROADCAST_LEVELS else table, same, "left").drop(f"{name}_level")
    levels = [(i, bytearray(c) if isinstance(c, bytes) else float(c) if value.kind == "num" and c is not None else c) for i, c in enumerate(info.categories)]
    table = df.sparkSession.createDataFrame(levels, T.StructType([T.StructField(f"{name}_code", T.IntegerType()), T.StructField(f"{name}_level", kind)]))
    found = df.join(F.broadcast(table), F.col(name).eqNullSafe(F.col(f"{name}_level")), "left")
    return found.drop(f"{name}_level")


def _factor_column(matrix: ContrastMatrix | None, values: list[Column], at: int) -> Column | None:
    """A factor's column (None: all ones) from its numbers, or from the number of its level."""
    if matrix is None:
        return values[at]
    code = values[0]
    # Levels of equal weight share a branch; the most common weight is the default.
    common, rows = matrix.column(at)
    if not rows:
        return None if common == 1 else F.lit(float(common))
    found = None
    for w, codes in rows.items():
        test = code.isin(codes) if len(codes) > 1 else code == codes[0]
        found = F.when(test, F.lit(w)) if found is None else found.when(test, F.lit(w))
    return found.otherwise(F.lit(common))


def _subterm_columns(subterm: SubtermInfo, values: dict, wanted: Iterable[int]) -> list[Column]:
    """Those ``wanted`` of the products of the factors' columns, the leftmost factor varying fastest."""
    parts = []
    for f in subterm.factors:
        matrix = subterm.contrast_matrices.get(f)
        parts.append((matrix, values[f], len(values[f]) if matrix is None else matrix.shape[1], {}))
    out = []
    for k in wanted:
        total = None
        for matrix, own, width, made in parts:
            k, at = divmod(k, width)
            if at not in made:
                made[at] = _factor_column(matrix, own, at)
            if made[at] is not None:
                total = made[at] if total is None else total * made[at]
        out.append(F.lit(1.0) if total is None else total)
    return out


def _placed(design_infos: Sequence[DesignInfo], prefixes: Sequence[str], name: str) -> list[tuple[int, int]]:
    """The designs that have a column, and where."""
    found = []
    for d, (design, prefix) in enumerate(zip(design_infos, prefixes, strict=True)):
        with suppress(ValueError):
            if name.startswith(prefix):
                found.append((d, design.column_names.index(name[len(prefix) :])))
    return found


def build_design_matrices(
    design_infos: Sequence[DesignInfo], df: DataFrame, NA_action: str | NAAction = "drop", *, keep: Sequence[str] = (), prefixes: Sequence[str] | None = None, dtype: str = "double",  # noqa: N803
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One DataFrame with the columns of all designs: one filter for missing values, and projections.

    All designs keep the same rows. ``prefixes`` (one per design) go before
    column names; ``keep`` passes columns through. No shuffle takes place, and
    streaming DataFrames work alike. Factors of more than ``CASED`` levels find the
    number of a level by a join with the table of levels, which is broadcast up to
    ``BROADCAST_LEVELS``. ``columns`` names those wanted, after kept ones; no other
    column is planned, but rows are the same.
    """
    if dtype not in ("double", "float"):
        raise ValueError("dtype is double or float")
    action, prefixes = as_action(NA_action), prefixes or [""] * len(design_infos)
    infos: dict = {}
    for design in design_infos:
        if design.term_codings is None:
            raise ValueError("this design has no factors to evaluate")
        for f, info in design.factor_infos.items():
            infos.setdefault(f, (info, design.env))
    inner, values, missing, guards = [quoted.alias(f"__keep{i}") for i, quoted in enumerate(map(_quoted, keep))], {}, None, []
    large: list[tuple[str, FactorInfo, Value]] = []
    places = None
    if columns is not None:
        for design, prefix in zip(design_infos, prefixes, strict=True):
            if isinstance(design.column_names, Names):
                design.column_names.look_up(n[len(prefix) :] for n in columns if n.startswith(prefix))
        found = [_placed(design_infos, prefixes, n) for n in columns]
        if any(len(x) > 1 for x in found) or any(_placed(design_infos, prefixes, n) for n in keep):
            raise FormulaError("columns of the designs share names; give prefixes")
        for name, x in zip(columns, found, strict=True):
            if not x:
                raise FormulaError(f"unknown column specified {name!r}")
        places = [x[0] for x in found]
    needed = None if places is None else {f for d, at in places for f in design_infos[d].subterm(at)[0].factors}
    for number, (f, (info, env)) in enumerate(infos.items()):
        evaluated, absent, value = _evaluated(info, Compiler(df.schema, env, shapes=info.shapes), action)
        names = [f"__f{number}_{i}" for i in range(len(evaluated))]
        if info.kind == "categorical" and len(info.categories) > CASED:
            if needed is None or f in needed:
                large.append((names[0], info, value))
        elif info.kind == "categorical":
            evaluated = [_code(info, evaluated[0], value, None)]
        inner += [c.alias(n) for c, n in zip(evaluated, names, strict=True)]
        values[f] = [F.col(n) for n in names]
        if info.kind == "numerical" and value.array:
            values[f] = [F.get(F.col(names[0]), F.lit(i)) for i in range(info.num_columns)]
        if absent is not None:
            guards.append((absent, f))
            missing = absent if missing is None else missing | absent
    if missing is not None:
        if action.on_NA == "drop":
            df = df.where(~missing)
        else:
            found = F.lit(True)
            for absent, f in guards:
                text = f"factor contains missing values: {f.name()}" + (f"\n{f.span.underlined(4)}" if getattr(f, "span", None) else "")
                found = found & F.when(absent, F.raise_error(F.lit(text)).cast("boolean")).otherwise(F.lit(True))
            df = df.where(found)
    # A second projection refers to the factors by name, so each is worked out once.
    df = df.select(*inner) if inner else df.select(F.lit(1).alias("__row"))
    for name, info, value in large:
        df = _with_codes(df, name, info, value)
        df = df.withColumn(name, _code(info, F.col(name), value, F.col(f"{name}_code"))).drop(f"{name}_code")
    out = [F.col(f"__keep{i}").alias(name) for i, name in enumerate(keep)]
    if places is not None:
        for name, (d, at) in zip(columns, places, strict=True):
            subterm, k = design_infos[d].subterm(at)
            out += [c.cast(dtype).alias(name) for c in _subterm_columns(subterm, values, [k])]
        return df.select(*out)
    for design, prefix in zip(design_infos, prefixes, strict=True):
        made = [c for subterms in design.term_codings.values() for s in subterms for c in _subterm_columns(s, values, range(s.num_columns))]
        out += [c.cast(dtype).alias(prefix + n) for c, n in zip(made, design.column_names, strict=True)]
    if len(set(names := [*keep, *(p + n for d, p in zip(design_infos, prefixes, strict=True) for n in d.column_names)])) < len(names):
        raise FormulaError("columns of the designs share names; give prefixes")
    return df.select(*out)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
