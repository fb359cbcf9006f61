"""Factors to Spark columns: Python expressions are compiled, not run.

Tier A: arithmetic, comparisons, known NumPy and math functions, built-ins and
stateful transforms become Column expressions with NumPy's semantics. Tier B:
functions marked ``column_function`` get Columns. Tier C: any other call is
evaluated per Arrow batch by a pandas UDF over the columns it names; what it
returns (numbers, truth values, text, several columns) is tried out on a few rows
when fitting, and kept with the factor.
"""

from __future__ import annotations

import __future__
import ast
import builtins as _builtins
import functools
import math
import operator
import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from designloom.plans.algebra import EvalFactor, LookupFactor
from designloom.plans.errors import FormulaError
from designloom.plans.lexer import respaced

from . import contrasts, stateful
from .chunks import PROBE_ROWS, as_array, as_series, chunks, kind_of, spark_type
from .stateful import Stateful

NAN, INF = float("nan"), float("inf")


@dataclass(frozen=True)
class Value:
    """A compiled expression: columns of one kind, or a constant of the driver."""

    kind: str  # "num", "bool", "text" (any other plain type), or "const"
    columns: tuple[Column, ...] = ()
    const: object = None
    #: A numerical value made of several columns, named x[0], x[1], ...
    multi: bool = False
    #: Set by C(): categorical whatever the kind, with these.
    categorical: bool = False
    contrast: object = None
    levels: tuple | None = None
    is_float: bool = False
    #: All columns are missing where the first one is.
    together: bool = False
    #: The one column is an array, whose elements are the columns.
    array: bool = False

    @property
    def one(self) -> Column:
        if len(self.columns) != 1 or self.multi:
            raise FormulaError("an operand must be one column")
        return self.columns[0]


def column_function(fn: Callable) -> Callable:
    """Mark ``fn`` as taking and returning Columns."""
    fn.takes_columns = True
    return fn


def stateful_transform(cls: type) -> type:
    """Make a transform class usable in formulas: a ``Stateful``, or one with ``memorize_chunk``, ``memorize_finish`` and ``transform``."""
    if issubclass(cls, Stateful):
        return cls

    class Chunked(Stateful):
        """Fitted chunk by chunk, applied per Arrow batch.

        With a method ``merge(other)`` every task fits its own rows, and only the
        fitted objects come together; without, the rows pass through the driver,
        a partition at a time.
        """

        data_args = None
        many_columns = False
        inner_class = cls

        def configure(self, **named: object) -> None:
            self.named, self.inner = named, cls()

        def learn(self, args: list[list[Column]]):  # noqa: ANN202
            groups, named = _grouped(args), self.named

            def feed(df: DataFrame) -> tuple:
                rows = df.select(*[c.alias(f"a{i}") for i, c in enumerate(groups)])
                if hasattr(cls, "merge"):

                    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                        inner = cls()
                        for batch in batches:
                            inner.memorize_chunk(*[as_array(c.to_pylist()) for c in batch.columns], **named)
                        yield pa.record_batch([pa.array([cloudpickle.dumps(inner)], pa.binary())], names=["state"])

                    first, *others = (cloudpickle.loads(r.state) for r in rows.mapInArrow(partial, "state binary").collect())
                    for other in others:
                        first.merge(other)
                    self.inner = first
                else:
                    for part in chunks(rows):
                        self.inner.memorize_chunk(*part.values(), **named)
                self.inner.memorize_finish()
                sample = rows.limit(PROBE_ROWS).collect()
                out = self.inner.transform(*[as_array(c) for c in zip(*sample, strict=True)], **named) if sample else 0.0
                self.learned["width"] = kind_of(out)[1]
                return ()

            yield feed

        def apply(self, args: list[list[Column]]) -> list[Column]:
            inner, named, width = self.inner, self.named, self.learned["width"]

            @F.pandas_udf(spark_type("num", width))
            def run(*series: pd.Series) -> pd.Series:
                return as_series(inner.transform(*map(as_array, series), **named), len(series[0]), "num", width)

            found = run(*_grouped(args))
            return [F.get(found, F.lit(i)) for i in range(width)] if width else [found]

    Chunked.__name__ = cls.__name__
    return Chunked


def _grouped(args: list[list[Column]]) -> list[Column]:
    """One column for each argument: those of several columns as arrays."""
    return [a[0] if len(a) == 1 else F.array(*a) for a in args]


class C:
    """Marks a categorical value; see ``Compiler``."""


class I:  # noqa: E742
    """Hides arithmetic from the formula parser."""


class Q:
    """Looks a column up by any name."""


# The names that formulas know without being given them.
BUILTINS: dict[str, object] = {
    "I": I, "Q": Q, "C": C,
    "center": stateful.Center, "standardize": stateful.Standardize, "scale": stateful.Standardize,
    "bs": stateful.BSpline, "cr": stateful.CubicSpline, "cc": stateful.CyclicSpline, "te": stateful.Tensor,
    "ContrastMatrix": contrasts.ContrastMatrix, "Treatment": contrasts.Treatment, "Poly": contrasts.Poly,
    "Sum": contrasts.Sum, "Helmert": contrasts.Helmert, "Diff": contrasts.Diff,
}


#: Compiler flags of the features that a module may import from the future.
_FUTURE = functools.reduce(operator.or_, (getattr(__future__, n).compiler_flag for n in __future__.all_feature_names), 0)


class Env:
    """Namespaces, looked up in order, and the compiler flags of the code that they belong to."""

    def __init__(self, *namespaces: Mapping[str, object], flags: int = 0) -> None:
        self.namespaces, self.flags = namespaces, flags & _FUTURE

    @staticmethod
    def capture(depth: int = 0) -> Env:
        """Locals and globals of the caller, ``depth`` frames further up."""
        import sys

        frame = sys._getframe(depth + 1)
        return Env(dict(frame.f_locals), frame.f_globals, flags=frame.f_code.co_flags)

    def find(self, name: str) -> object:
        for space in (*self.namespaces, BUILTINS, vars(_builtins)):
            if name in space:
                return space[name]
        raise NameError(name)

    def outer(self, *namespaces: Mapping[str, object]) -> Env:
        """The same, with namespaces that are looked up after all of its own."""
        return Env(*self.namespaces, *namespaces, flags=self.flags)

    def eval(self, code: str | ast.Expression, inner: Mapping[str, object] | None = None) -> object:
        """The value of an expression; ``inner`` is looked up first."""
        tree = ast.parse(code, mode="eval") if isinstance(code, str) else code
        space = {n.id: (inner or {})[n.id] if n.id in (inner or {}) else self.find(n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
        return eval(compile(tree, "<formula>", "eval", self.flags, dont_inherit=True), {"__builtins__": _builtins}, space)  # noqa: S307

    def subset(self, names: set[str]) -> Env:
        found = {}
        for name in names:
            try:
                found[name] = self.find(name)
            except NameError:
                continue
        return Env(found, flags=self.flags)

    def __eq__(self, other: object) -> bool:
        """Whether the namespaces are the same objects, or plain copies of equal ones."""
        if not isinstance(other, Env) or self.flags != other.flags or len(self.namespaces) != len(other.namespaces):
            return False
        return all(a is b or a.keys() == b.keys() and all(a[k] is b[k] for k in a) for a, b in zip(self.namespaces, other.namespaces, strict=True))

    def __hash__(self) -> int:
        return hash((self.flags, len(self.namespaces)))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# NumPy's semantics on Spark columns (of doubles).


def _log(x: Column, fn: Callable[[Column], Column] = F.log) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(fn(x))


def _divide(x: Column, y: Column) -> Column:
    zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y != 0, F.try_divide(x, y)).when(y.isNull() | x.isNull(), F.lit(None).cast("double")).otherwise(zero)


def _floor(x: Column) -> Column:
    # Beyond 2**52 every double is whole, and floor() would leave the range of longs.
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double"))


def _modulo(x: Column, y: Column) -> Column:
    rest = F.try_mod(x, y)
    return F.when(y == 0, F.lit(NAN)).otherwise(F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest + 0.0))


def _extreme(pick: Callable) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).when(x.isNull() | y.isNull(), F.lit(None).cast("double")).otherwise(pick(x, y))


_SHARED: dict[str, Callable] = {
    "log": _log, "log10": lambda x: _log(x, F.log10), "log2": lambda x: _log(x, F.log2), "log1p": lambda x: _log(x + 1, lambda _: F.log1p(x)),
    "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "floor": _floor, "ceil": lambda x: -_floor(-x), "fabs": F.abs, "degrees": F.degrees, "radians": F.radians,
}
_NUMPY: dict[str, Callable] = _SHARED | {
    "abs": F.abs, "absolute": F.abs, "square": lambda x: x * x, "negative": lambda x: -x, "cbrt": F.cbrt, "sign": lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x)),
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "reciprocal": lambda x: _divide(F.lit(1.0), x),
    "add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": _divide, "true_divide": _divide,
    "power": F.pow, "maximum": _extreme(F.greatest), "minimum": _extreme(F.least), "arctan2": F.atan2, "hypot": F.hypot, "mod": _modulo,
}
#: Keyed by the function object, so that what a name stands for decides, not the name.
KNOWN: dict[int, Callable] = (
    {id(getattr(np, n)): f for n, f in _NUMPY.items()}
    | {id(getattr(math, n)): f for n, f in _SHARED.items()}
    | {id(abs): F.abs, id(float): lambda x: x, id(pow): F.pow, id(math.pow): F.pow}
)

_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: _divide, ast.Pow: F.pow,
    ast.FloorDiv: lambda x, y: F.when(F.isnan(x) | F.isnan(y) | (y == 0), F.when(y == 0, _divide(x, y)).otherwise(F.lit(NAN))).otherwise(_floor(_divide(x, y))), ast.Mod: _modulo,
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y, ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y,
}


def factor_key(factor: object) -> str:
    return f"factor:{factor.name()}"


class FactorState(Stateful):
    """What a factor that memorizes for itself has memorized."""

    def __init__(self, inner: dict) -> None:
        super().__init__()
        self.inner = inner


class _Unready(Exception):
    """A stateful call inside has not learned yet."""


@dataclass
class Compiler:
    """Compiles factors against the columns of a schema; ``states`` holds fitted transforms by the text of their calls."""

    schema: T.StructType
    env: Env
    states: dict[str, Stateful] = field(default_factory=dict)
    #: What Python calls return, and widths of arrays, by their text.
    shapes: dict[str, tuple[str, int]] = field(default_factory=dict)
    #: Gives the first rows of some columns (when fitting).
    probe: Callable[[list[Column]], list[tuple]] | None = None

    def __post_init__(self) -> None:
        self.fields = {f.name: f for f in self.schema.fields}

    # Leaves.

    def column(self, name: str) -> Value:
        kind, c = self.fields[name].dataType, quoted(name)
        if isinstance(kind, T.BooleanType):
            return Value("bool", (c,))
        if isinstance(kind, (T.NumericType,)):
            return Value("num", (c.cast("double") if not isinstance(kind, T.DoubleType) else c,), is_float=isinstance(kind, (T.FloatType, T.DoubleType)))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            return Value("num", (c.cast("array<double>"),), multi=True, array=True)
        if type(kind).__name__ == "VectorUDT":
            from pyspark.ml.functions import vector_to_array

            return Value("num", (vector_to_array(c),), multi=True, array=True)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            raise FormulaError(f"column '{name}' of type {kind.simpleString()} is neither numerical nor categorical")
        # Levels that column metadata declare (as pandas categories do) are authoritative.
        declared = self.fields[name].metadata.get("ml_attr", {}).get("vals")
        return Value("text", (c,), categorical=declared is not None, levels=tuple(declared) if declared is not None else None)

    def factor(self, factor: object) -> Value:
        try:
            if isinstance(factor, LookupFactor):
                if factor.column not in self.fields:
                    raise FormulaError(f"no column named '{factor.column}'")
                found = self.column(factor.column)
                return replace(found, categorical=True, contrast=factor.contrast, levels=factor.levels) if factor.force_categorical else found
            if isinstance(factor, EvalFactor):
                found = self.node(self.parse(factor.code))
                if found.kind == "const":
                    found = self.constant_factor(found.const)
                return found
            if hasattr(factor, "compile"):
                return factor.compile(self)
            return self.evaluated_by(factor)
        except FormulaError as e:
            e.locate(factor)
            raise
        except (NameError, TypeError, ValueError, KeyError, AttributeError, SyntaxError) as e:
            raise FormulaError(f"Error evaluating factor: {type(e).__name__}: {e}", factor) from e

    def shape(self, key: str, columns: list[Column], tell: Callable[[list[np.ndarray]], tuple[str, int]]) -> tuple[str, int]:
        """What ``tell`` finds in the first rows of ``columns``, asked once; a plain number without rows."""
        if key not in self.shapes:
            rows = self.probe(columns) if self.probe else []
            self.shapes[key] = tell([as_array(c) for c in zip(*rows, strict=True)]) if rows else ("num", 0)
        return self.shapes[key]

    def evaluated_by(self, factor: object) -> Value:
        """A factor that memorizes and evaluates for itself, over chunks of all columns."""
        if not hasattr(factor, "eval"):
            raise TypeError(f"a {type(factor).__name__} is no factor")
        state = getattr(self.states.get(factor_key(factor)), "inner", {})
        names = list(self.fields)
        columns = [quoted(n) for n in names]

        def evaluate(arrays: list[np.ndarray]) -> object:
            return factor.eval(state, dict(zip(names, arrays, strict=True)))

        kind, width = self.shape(factor_key(factor), columns, lambda arrays: kind_of(evaluate(arrays)))

        @F.pandas_udf(spark_type(kind, width))
        def run(*series: pd.Series) -> pd.Series:
            return as_series(evaluate([as_array(s) for s in series]), len(series[0]), kind, width)

        return Value(kind, (run(*columns),), multi=width > 0, array=width > 0, is_float=kind == "num")

    @staticmethod
    def parse(code: str) -> ast.expr:
        return ast.parse(code, mode="eval").body

    @staticmethod
    def constant_factor(value: object) -> Value:
        if isinstance(value, (bool, np.bool_)):
            return Value("bool", (F.lit(bool(value)),))
        if isinstance(value, (int, float, np.number)):
            return Value("num", (F.lit(float(value)),))
        if isinstance(value, (str, bytes)):
            return Value("text", (F.lit(value),))
        raise FormulaError(f"a factor can't be a {type(value).__name__} that is not a column")

    def resolve(self, node: ast.expr) -> object:
        """The driver object that a name or attribute chain stands for, unless it is a column."""
        if isinstance(node, ast.Name):
            if node.id in self.fields:
                raise LookupError
            return self.env.find(node.id)
        if isinstance(node, ast.Attribute):
            return getattr(self.resolve(node.value), node.attr)
        raise LookupError

    def mentions_column(self, node: ast.expr) -> bool:
        for n in ast.walk(node):
            if isinstance(n, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                raise FormulaError("lambda expressions and comprehensions are not allowed in formulas")
            if isinstance(n, ast.Name) and n.id in self.fields:
                return True
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id not in self.fields and self.env.find(n.func.id) is Q:
                return True
        return False

    def constant(self, node: ast.expr) -> object:
        return self.env.eval(ast.fix_missing_locations(ast.Expression(node)))

    # Nodes.

    def node(self, node: ast.expr) -> Value:
        if not self.mentions_column(node):
            found = self.special_call(node)
            return found if found is not None else Value("const", const=self.constant(node))
        if isinstance(node, ast.Name):
            return self.column(node.id)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return self.broadcast(_BINARY[type(node.op)], [self.node(node.left), self.node(node.right)])
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            x, y = self.boolean(self.node(node.left)), self.boolean(self.node(node.right))
            return Value("bool", (x & y if isinstance(node.op, ast.BitAnd) else x | y if isinstance(node.op, ast.BitOr) else x != y,))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = self.node(node.operand)
            return self.broadcast(lambda x: -x if isinstance(node.op, ast.USub) else x, [inner])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            return Value("bool", (~self.boolean(self.node(node.operand)),))
        if isinstance(node, ast.Compare):
            return self.compare(node)
        if isinstance(node, ast.Subscript) and (found := self.element(node)) is not None:
            return found
        if isinstance(node, ast.Call):
            return self.call(node)
        return self.fallback(node)

    def element(self, node: ast.Subscript) -> Value | None:
        """An element, or a slice, of an array column; None if its place is not a constant."""
        base = self.node(node.value)
        if not base.array or self.mentions_column(node.slice):
            return None
        array, size = base.columns[0], F.size(base.columns[0])
        at = self.constant(ast.Call(ast.Name("slice", ast.Load()), [x or ast.Constant(None) for x in (node.slice.lower, node.slice.upper, node.slice.step)], []) if isinstance(node.slice, ast.Slice) else node.slice)
        if isinstance(at, (int, np.integer)):
            return Value("num", (F.get(array, F.lit(int(at)) if at >= 0 else size + int(at)),), is_float=True)
        if isinstance(at, slice) and at.step in (None, 1):
            ends = [F.lit(0) if at.start is None else at.start, size if at.stop is None else at.stop]
            low, high = (F.greatest(F.lit(0), size + e) if isinstance(e, int) and e < 0 else F.least(F.lit(e) if isinstance(e, int) else e, size) for e in ends)
            return replace(base, columns=(F.slice(array, low + 1, F.greatest(F.lit(0), high - low)),))
        return None

    def number(self, value: Value) -> Column:
        if value.kind == "const":
            return F.lit(float(value.const))
        if value.kind == "text":
            raise FormulaError("text can't be used in arithmetic")
        return value.one.cast("double") if value.kind == "bool" else value.one

    @staticmethod
    def boolean(value: Value) -> Column:
        if value.kind == "const":
            return F.lit(bool(value.const))
        if value.kind != "bool":
            raise FormulaError("&, |, ^ and ~ need true-or-false operands")
        return value.one

    def broadcast(self, fn: Callable, values: list[Value]) -> Value:
        """``fn`` over numbers, element by element where values have several columns."""
        if not any(v.multi for v in values):
            return Value("num", (fn(*[self.number(v) for v in values]),), is_float=True)
        arrays = [v.columns[0] for v in values if v.array]
        wide = {len(v.columns) for v in values if v.multi and not v.array}
        if len(wide) > 1 or arrays and wide:
            raise FormulaError("operands have different numbers of columns")
        if wide:
            (width,) = wide
            rows = [v.columns if v.multi else (self.number(v),) * width for v in values]
            return Value("num", tuple(fn(*row) for row in zip(*rows, strict=True)), multi=True)
        if len(arrays) == 1:
            return Value("num", (F.transform(arrays[0], lambda x: fn(*[x if v.array else self.number(v) for v in values])),), multi=True, array=True)
        return Value("num", (F.zip_with(*arrays, fn),), multi=True, array=True)

    def compare(self, node: ast.Compare) -> Value:
        values = [self.node(n) for n in (node.left, *node.comparators)]
        out = None
        for op, x, y in zip(node.ops, values, values[1:], strict=False):
            if type(op) not in _COMPARE:
                return self.fallback(node)
            if "text" in (x.kind, y.kind):
                a, b = (F.lit(v.const) if v.kind == "const" else v.one for v in (x, y))
                found = _COMPARE[type(op)](a, b)
            else:
                a, b = self.number(x), self.number(y)
                # NaN (and null) compares false, unequal to anything.
                lost = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
                found = F.when(lost, F.lit(isinstance(op, ast.NotEq))).otherwise(_COMPARE[type(op)](a, b))
            out = found if out is None else out & found
        return Value("bool", (out,))

    def special_call(self, node: ast.expr) -> Value | None:
        """C, I, Q and stateful calls, which count as columns even over constants."""
        if not isinstance(node, ast.Call):
            return None
        try:
            fn = self.resolve(node.func)
        except (LookupError, NameError):
            return None
        if fn in (C, I, Q) or isinstance(node.func, ast.Name) and isinstance(fn, type) and issubclass(fn, Stateful):
            return self.call(node)
        return None

    def call(self, node: ast.Call) -> Value:
        try:
            fn = self.resolve(node.func)
        except LookupError:
            return self.fallback(node)
        if fn is I:
            (arg,) = node.args
            return self.node(arg)
        if fn is Q:
            (arg,) = node.args
            name = self.constant(arg)
            if name not in self.fields:
                raise NameError(f"no data named {name!r} found")
            return self.column(name)
        if fn is C:
            return self.mark_categorical(node)
        if isinstance(node.func, ast.Name) and isinstance(fn, type) and issubclass(fn, Stateful):
            return self.transformed(node, fn)
        plain = not node.keywords and not any(isinstance(a, ast.Starred) for a in node.args)
        if plain and id(fn) in KNOWN:
            return self.broadcast(KNOWN[id(fn)], [self.node(a) for a in node.args])
        if plain and fn is np.where and len(node.args) == 3:
            test, x, y = map(self.node, node.args)
            return Value("num", (F.when(self.boolean(test), self.number(x)).otherwise(self.number(y)),), is_float=True)
        if plain and fn in (np.isnan, math.isnan):
            x = self.number(self.node(node.args[0]))
            return Value("bool", (x.isNull() | F.isnan(x),))
        if getattr(fn, "takes_columns", False):
            args = [v.const if (v := self.node(a)).kind == "const" else v.one for a in node.args]
            named = {k.arg: v.const if (v := self.node(k.value)).kind == "const" else v.one for k in node.keywords}
            return Value("num", (fn(*args, **named).cast("double"),), is_float=True)
        return self.fallback(node)

    def mark_categorical(self, node: ast.Call) -> Value:
        names = ["data", "contrast", "levels"]
        given = dict(zip(names, node.args, strict=False)) | {k.arg: k.value for k in node.keywords}
        if set(given) - set(names) or "data" not in given or len(node.args) > 3:
            raise TypeError("C() takes data, contrast and levels")
        inner = self.node(given["data"])
        if inner.kind == "const":
            inner = self.constant_factor(inner.const)
        if inner.multi:
            raise FormulaError("categorical data must be one column")
        contrast = self.constant(given["contrast"]) if "contrast" in given else None
        levels = self.constant(given["levels"]) if "levels" in given else None
        # Of nested marks, the outer one's arguments win.
        return replace(
            inner, categorical=True, contrast=inner.contrast if contrast is None else contrast, levels=inner.levels if levels is None else tuple(levels)
        )

    def fallback(self, node: ast.expr) -> Value:
        """Tier C: evaluate per Arrow batch, with the columns as arrays."""
        names = sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)})
        columns = [n for n in names if n in self.fields]
        calls: dict[str, Value] = {}

        class Lift(ast.NodeTransformer):
            """Stateful calls and Q() inside become inputs."""

            def visit_Call(lift, call: ast.Call) -> ast.AST:  # noqa: N802, N805
                if (found := self.special_call(call)) is not None and self.mentions_column(call):
                    key = f"_input{len(calls)}"
                    calls[key] = found
                    return ast.copy_location(ast.Name(key, ast.Load()), call)
                return lift.generic_visit(call)

        code = ast.unparse(Lift().visit(ast.parse(ast.unparse(node), mode="eval")))
        known = {n: self.env.find(n) for n in names if n not in columns and n not in BUILTINS}
        inputs = {n: self.column(n) for n in columns} | calls
        names, given = list(inputs), _grouped([list(v.columns) for v in inputs.values()])
        warnings.warn(f"'{code}' is evaluated batch by batch in Python; functions that look beyond a row see their batch only", stacklevel=2)

        def evaluate(arrays: list[np.ndarray]) -> object:
            return eval(code, {"__builtins__": _builtins, **known}, dict(zip(names, arrays, strict=True)))  # noqa: S307

        kind, width = self.shape(f"call:{code}", given, lambda arrays: kind_of(evaluate(arrays)))

        @F.pandas_udf(spark_type(kind, width))
        def run(*series: pd.Series) -> pd.Series:
            return as_series(evaluate([as_array(s) for s in series]), len(series[0]), kind, width)

        return Value(kind, (run(*given),), multi=width > 0, array=width > 0, is_float=kind == "num")

    # Stateful calls.

    def transformed(self, node: ast.Call, cls: type[Stateful]) -> Value:
        key = respaced(ast.unparse(node))
        args, instance = self.stateful_args(node, cls)
        found = self.states.get(key)
        if found is None:
            raise _Unready
        instance.learned = found.learned
        if hasattr(found, "inner"):
            instance.inner = found.inner
        out = tuple(instance.apply(args))
        return Value("num", out, multi=len(out) > 1 or cls.many_columns or instance.learned.get("width", 0) > 0, is_float=True, together=cls.many_columns)

    def stateful_args(self, node: ast.Call, cls: type[Stateful]) -> tuple[list[list[Column]], Stateful]:
        given, named = list(node.args), {k.arg: k.value for k in node.keywords}
        if not given and "x" in named:
            given.insert(0, named.pop("x"))
        many = len(given) if cls.data_args is None else cls.data_args
        if len(given) < many or not given:
            raise TypeError(f"{cls.__name__} needs data")
        args = []
        for a in given[:many]:
            value = self.node(a)
            if value.kind == "const":
                value = self.constant_factor(value.const)
            if value.array:
                # Element by element, as many as the first row has.
                array = value.columns[0]
                _, width = self.shape(f"array:{respaced(ast.unparse(a))}", [array], lambda arrays: ("num", arrays[0].shape[1] if arrays[0].ndim == 2 else 0))
                value = replace(value, columns=tuple(F.get(array, F.lit(i)) for i in range(width)), array=False)
            args.append([self.number(replace(value, columns=(c,), multi=False)) for c in value.columns])
        return args, cls(*[self.constant(a) for a in given[many:]], **{k: self.constant(v) for k, v in named.items()})

    def pending(self, factor: object) -> dict[str, tuple[list[list[Column]], Stateful]]:
        """Stateful calls that have not learned, and whose arguments are ready."""
        if not isinstance(factor, EvalFactor):
            return {}
        out: dict[str, tuple[list[list[Column]], Stateful]] = {}

        def walk(node: ast.AST) -> None:
            for child in ast.iter_child_nodes(node):
                walk(child)
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id not in self.fields:
                fn = self.env.find(node.func.id)
                key = respaced(ast.unparse(node))
                if isinstance(fn, type) and issubclass(fn, Stateful) and key not in self.states and key not in out:
                    try:
                        out[key] = self.stateful_args(node, fn)
                    except _Unready:
                        pass

        try:
            walk(ast.Expression(self.parse(factor.code)))
        except FormulaError as e:
            e.locate(factor)
            raise
        except (NameError, TypeError, ValueError, SyntaxError) as e:
            raise FormulaError(f"Error evaluating factor: {type(e).__name__}: {e}", factor) from e
        return out
