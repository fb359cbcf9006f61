"""Stateful transforms: what they learn is a few aggregates, what they do is a projection.

A transform learns in a coroutine: ``learn(args)`` yields aggregate columns (a
list) or a function of the DataFrame that returns a row, and receives the
values. The planner runs the coroutines of all transforms of one nesting level
in step, each round as one aggregation over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designloom.operators.quantiles import quantiles
from designloom.plans.errors import FormulaError

from .piecewise import Piecewise

Columns = list[Column]
Learning = Generator[list[Column] | Callable[[DataFrame], object], Sequence, None]


def strict(x: Column) -> Column:
    """Null as NaN, so that it spoils an aggregate as NaN does."""
    return F.coalesce(x, F.lit(float("nan")))


class Stateful:
    """Base of transforms; ``learned`` holds what JSON can write."""

    #: How many leading positional arguments are data (None: all).
    data_args: int | None = 1
    #: Whether one input gives several columns, which are missing together.
    many_columns = False

    def __init__(self, *options: object, **named: object) -> None:
        self.learned: dict = {}
        self.configure(*options, **named)

    def configure(self) -> None:
        """Take the options of the call."""

    def learn(self, args: list[Columns]) -> Learning:
        yield from ()

    def apply(self, args: list[Columns]) -> Columns:
        raise NotImplementedError


class Center(Stateful):
    def learn(self, args: list[Columns]) -> Learning:
        means = yield [F.avg(strict(x)) for x in args[0]]
        self.learned["means"] = [float("nan") if m is None else float(m) for m in means]

    def apply(self, args: list[Columns]) -> Columns:
        return [x - F.lit(m) for x, m in zip(args[0], self.learned["means"], strict=True)]


class Standardize(Stateful):
    def configure(self, center: bool = True, rescale: bool = True, ddof: int = 0) -> None:
        self.center, self.rescale, self.ddof = center, rescale, ddof

    def learn(self, args: list[Columns]) -> Learning:
        found = yield [F.count("*"), *(f(strict(x)) for x in args[0] for f in (F.avg, F.var_pop))]
        n, values = found[0], [float("nan") if v is None else float(v) for v in found[1:]]
        self.learned["means"] = values[0::2]
        free = n - self.ddof
        self.learned["scales"] = [float(np.sqrt(v * n / free)) if free > 0 else float("nan") for v in values[1::2]]

    def apply(self, args: list[Columns]) -> Columns:
        out = []
        for x, mean, scale in zip(args[0], self.learned["means"], self.learned["scales"], strict=True):
            if self.center:
                x = x - F.lit(mean)
            if self.rescale:
                # By a multiple of a constant, as x / 0 raises: a constant column has no scale.
                x = x / F.lit(scale) if scale else F.when(x == 0, F.lit(float("nan"))).otherwise(x * F.lit(float("inf")))
            out.append(x)
        return out


def _single(args: list[Columns], name: str) -> Column:
    if len(args[0]) != 1:
        raise FormulaError(f"input to '{name}' must be one column")
    return args[0][0]


def _finite(values: Sequence, name: str) -> list[float]:
    out = [float("nan") if v is None else float(v) for v in values]
    if not np.isfinite(out).all():
        raise FormulaError(f"the data of '{name}' hold missing or infinite values, or no rows")
    return out


def bspline(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline basis by the Cox-de Boor recursion; spans are half-open."""
    x, knots = np.asarray(x, dtype=float)[:, None], np.asarray(knots, dtype=float)
    basis = ((knots[:-1] <= x) & (x < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nan_to_num((x - knots[: -d - 1]) / (knots[d:-1] - knots[: -d - 1]), nan=0.0, posinf=0.0, neginf=0.0)
            down = np.nan_to_num((knots[d + 1 :] - x) / (knots[d + 1 :] - knots[1:-d]), nan=0.0, posinf=0.0, neginf=0.0)
        basis = up * basis[:, :-1] + down * basis[:, 1:]
    return basis


class BSpline(Stateful):
    """``bs(x, df, knots, degree, include_intercept, lower_bound, upper_bound)``."""

    many_columns = True

    def configure(self, df: int | None = None, knots: Sequence | None = None, degree: int = 3, include_intercept: bool = False, lower_bound: float | None = None, upper_bound: float | None = None) -> None:
        if degree < 0 or int(degree) != degree:
            raise FormulaError(f"degree must be a nonnegative integer (not {degree!r})")
        if df is None and knots is None:
            raise FormulaError("must specify either df or knots")
        self.degree, self.intercept = int(degree), bool(include_intercept)
        self.bounds, self.knots, self.inner = (lower_bound, upper_bound), None if knots is None else [float(k) for k in np.ravel(knots)], None
        if df is not None:
            self.inner = df - (self.degree + 1) + (0 if self.intercept else 1)
            if self.inner < 0:
                raise FormulaError(f"df={df} is too small for degree={degree} and include_intercept={include_intercept}")
            if self.knots is not None and len(self.knots) != self.inner:
                raise FormulaError(f"df={df} with degree={degree} implies {self.inner} knots, but {len(self.knots)} knots were provided")

    def learn(self, args: list[Columns]) -> Learning:
        x = strict(_single(args, "bs"))
        wanted = [F.min(x), F.max(x)] if None in self.bounds else []
        ask_knots = self.knots is None and self.inner
        wanted += [F.max(F.isnan(x))] if ask_knots else []
        found = list((yield wanted)) if wanted else []
        low, high = _finite(found[:2], "bs") if None in self.bounds else (None, None)
        low = low if self.bounds[0] is None else float(self.bounds[0])
        high = high if self.bounds[1] is None else float(self.bounds[1])
        inner = self.knots or []
        if ask_knots:
            if found[-1]:
                raise FormulaError("the data of 'bs' hold missing values")
            (inner,) = yield lambda df: (quantiles(df, x, np.linspace(0, 1, self.inner + 2)[1:-1].tolist()),)
            inner = _finite(inner or [None], "bs")
        inner = sorted(inner)
        if low > high:
            raise FormulaError(f"lower_bound > upper_bound ({low!r} > {high!r})")
        if any(k < low for k in inner):
            raise FormulaError(f"some knot values ({[k for k in inner if k < low]}) fall below lower bound ({low!r})")
        if any(k > high for k in inner):
            raise FormulaError(f"some knot values ({[k for k in inner if k > high]}) fall above upper bound ({high!r})")
        self.learned.update(low=low, high=high, inner=inner)

    def pieces(self) -> Piecewise:
        low, high, inner = self.learned["low"], self.learned["high"], self.learned["inner"]
        order = self.degree + 1
        knots = np.sort(np.concatenate([[low, high] * order, inner]))
        edges = np.unique([low, high, *inner])
        if len(edges) < 2:
            raise FormulaError("'bs' needs data or bounds of more than one value")
        found = Piecewise.of(lambda x: bspline(x, knots, self.degree), edges, self.degree)
        return found if self.intercept else found.times(np.eye(found.coefs.shape[1])[:, 1:])

    def apply(self, args: list[Columns]) -> Columns:
        x = _single(args, "bs")
        outside = (x < F.lit(self.learned["low"])) | (x > F.lit(self.learned["high"])) & ~F.isnan(x)
        message = "some data points fall outside the outermost knots of 'bs', and it cannot extrapolate"
        first, *rest = self.pieces().columns(x)
        return [F.when(outside, F.raise_error(F.lit(message)).cast("double")).otherwise(first), *rest]


def null_space(constraints: np.ndarray) -> np.ndarray:
    """Columns that span what the constraint rows leave free."""
    q, _ = np.linalg.qr(np.asarray(constraints, dtype=float).T, mode="complete")
    return q[:, len(constraints) :]


def second_derivatives(knots: np.ndarray, cyclic: bool) -> np.ndarray:
    """From values at the knots to second derivatives there, of the interpolating cubic spline."""
    h = np.diff(knots)
    if cyclic:
        n = len(h)
        b, d = np.zeros((n, n)), np.zeros((n, n))
        for i in range(n):
            left, right = h[i - 1], h[i]
            for j, x, y in ((i, (left + right) / 3, -1 / left - 1 / right), ((i - 1) % n, left / 6, 1 / left), ((i + 1) % n, right / 6, 1 / right)):
                b[i, j] += x
                d[i, j] += y
        return np.linalg.solve(b, d)
    n = len(knots)
    b, d = np.zeros((n - 2, n - 2)), np.zeros((n - 2, n))
    for i in range(n - 2):
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            b[i, i - 1] = b[i - 1, i] = h[i] / 6
        d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
    return np.vstack([np.zeros(n), np.linalg.solve(b, d) if n > 2 else np.zeros((0, n)), np.zeros(n)])


def cubic_basis(x: np.ndarray, knots: np.ndarray, cyclic: bool) -> np.ndarray:
    """Cubic regression spline basis: a column per knot, its value 1 there; linear beyond the ends."""
    x, bends = np.asarray(x, dtype=float), second_derivatives(knots, cyclic)
    j = np.clip(np.searchsorted(knots, x) - 1, 0, len(knots) - 2)
    h, right, left = knots[j + 1] - knots[j], knots[j + 1] - x, x - knots[j]
    columns = len(knots) - cyclic
    at, after = np.eye(columns)[j], np.eye(columns)[(j + 1) % columns]
    cubic = lambda z, inside: np.where(inside, z**3, 0) / (6 * h) - h * z / 6
    return (
        at * (right / h)[:, None] + after * (left / h)[:, None]
        + bends[j] * cubic(right, x <= knots[-1])[:, None] + bends[(j + 1) % len(bends)] * cubic(left, x >= knots[0])[:, None]
    )


class CubicSpline(Stateful):
    """``cr`` and ``cc``: natural and cyclic cubic regression splines."""

    many_columns, cyclic, name = True, False, "cr"

    def configure(self, df: int | None = None, knots: Sequence | None = None, lower_bound: float | None = None, upper_bound: float | None = None, constraints: object = None) -> None:
        if isinstance(constraints, str) and constraints != "center":
            raise FormulaError("constraints must be 'center' or a matrix")
        if df is None and knots is None:
            raise FormulaError("must specify either 'df' or 'knots'")
        self.center = isinstance(constraints, str)
        self.given = None if constraints is None or self.center else np.atleast_2d(np.asarray(constraints, dtype=float)).tolist()
        if self.given is not None and np.ndim(self.given) != 2:
            raise FormulaError("constraints must be 2-d array or 1-d vector")
        self.bounds, self.knots, self.inner = (lower_bound, upper_bound), None if knots is None else sorted({float(k) for k in np.ravel(knots)}), None
        if df is not None:
            rows = 1 if self.center else len(self.given or ())
            least = 1 if self.cyclic or rows else 2
            if df < least:
                raise FormulaError(f"'df'={df} must be greater than or equal to {least}")
            self.inner = df - 2 + rows + self.cyclic
            if self.inner < 0:
                raise FormulaError(f"'df'={df} is too small")
            if self.knots is not None and len(self.knots) != self.inner:
                raise FormulaError(f"number of inner knots ({len(self.knots)}) does not match what 'df'={df} implies ({self.inner})")

    def learn(self, args: list[Columns]) -> Learning:
        x = strict(_single(args, self.name))
        low, high = self.bounds
        if None in self.bounds:
            found = _finite((yield [F.min(x), F.max(x)]), self.name)
            low, high = (found[0] if low is None else float(low)), (found[1] if high is None else float(high))
        if high < low:
            raise FormulaError(f"lower_bound > upper_bound ({low!r} > {high!r})")
        inner = self.knots
        if inner is None and self.inner:
            inside = F.when(x.between(low, high), x)
            # An answer of None would read as the start of a round.
            (inner,) = yield lambda df: (quantiles(df, inside, np.linspace(0, 1, self.inner + 2)[1:-1].tolist(), distinct=True),)
            if inner is None:
                raise FormulaError(f"no data values between lower_bound (={low!r}) and upper_bound (={high!r}): cannot compute requested {self.inner} inner knot(s)")
            inner = sorted(set(inner))
        inner = inner or []
        if any(k < low for k in inner):
            raise FormulaError(f"some knot values ({[k for k in inner if k < low]}) fall below lower bound ({low!r})")
        if any(k > high for k in inner):
            raise FormulaError(f"some knot values ({[k for k in inner if k > high]}) fall above upper bound ({high!r})")
        knots = sorted({low, high, *inner})
        if len(knots) != (self.inner if self.inner is not None else len(inner)) + 2:
            raise FormulaError(f"unable to compute {self.inner if self.inner is not None else len(inner)} inner knots distinct from the bounds: got {len(knots)} knots in all")
        self.learned["knots"] = knots
        constraints = self.given
        if self.center:
            means = yield [F.avg(c) for c in self._free().columns(self._wrapped(x))]
            constraints = [_finite(means, self.name)]
        if constraints is not None and len(constraints[0]) != len(knots) - self.cyclic:
            raise FormulaError(f"constraints array should have {len(knots) - self.cyclic} columns but {len(constraints[0])} found")
        self.learned["constraints"] = constraints

    def _free(self) -> Piecewise:
        knots = np.array(self.learned["knots"])
        span = knots[-1] - knots[0]
        return Piecewise.of(lambda x: cubic_basis(x, knots, self.cyclic), np.concatenate([[knots[0] - span], knots, [knots[-1] + span]]), 3)

    def _wrapped(self, x: Column) -> Column:
        if not self.cyclic:
            return x
        low, high = F.lit(self.learned["knots"][0]), F.lit(self.learned["knots"][-1])
        inside = F.when(x > high, low + F.pmod(x - high, high - low)).when(x < low, high - F.pmod(low - x, high - low)).otherwise(x)
        return F.when(F.isnan(x), x).otherwise(inside)

    def pieces(self) -> Piecewise:
        free = self._free()
        return free if self.learned.get("constraints") is None else free.times(null_space(self.learned["constraints"]))

    def apply(self, args: list[Columns]) -> Columns:
        return self.pieces().columns(self._wrapped(_single(args, self.name)))


class CyclicSpline(CubicSpline):
    cyclic, name = True, "cc"


class Tensor(Stateful):
    """``te(s1, ..., sn, constraints)``: products of the columns of smooths, the first one slowest."""

    data_args, many_columns = None, True

    def configure(self, constraints: object = None) -> None:
        if isinstance(constraints, str) and constraints != "center":
            raise FormulaError("constraints must be 'center' or a matrix")
        self.center = isinstance(constraints, str)
        self.given = None if constraints is None or self.center else np.atleast_2d(np.asarray(constraints, dtype=float)).tolist()

    @staticmethod
    def _products(args: list[Columns]) -> Columns:
        if not args:
            raise FormulaError("te() needs at least one smooth")
        out = args[0]
        for more in args[1:]:
            out = [a * b for a in out for b in more]
        return out

    def learn(self, args: list[Columns]) -> Learning:
        products = self._products(args)
        constraints = self.given
        if self.center:
            constraints = [_finite((yield [F.avg(c) for c in products]), "te")]
        if constraints is not None and len(constraints[0]) != len(products):
            raise FormulaError(f"constraints array should have {len(products)} columns but {len(constraints[0])} found")
        self.learned["constraints"] = constraints

    def apply(self, args: list[Columns]) -> Columns:
        products = self._products(args)
        if self.learned.get("constraints") is None:
            return products
        out = []
        for weights in null_space(self.learned["constraints"]).T:
            total = None
            for w, p in zip(weights, products, strict=True):
                part = F.lit(float(w)) * p
                total = part if total is None else total + part
            out.append(total)
        return out
