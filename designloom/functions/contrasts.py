"""Contrast coding of categorical factors: small matrices on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from designloom.plans.errors import FormulaError

from .levels import LevelNames, Levels, level_text


def bracketed(prefix: str, levels: Sequence) -> list[str]:
    return [f"[{prefix}{level_text(level)}]" for level in levels]


def level_index(levels: Sequence, wanted: object) -> int:
    """Position of a level given by value, or failing that by (negative) index."""
    levels = levels if isinstance(levels, Levels) else list(levels)
    if wanted in levels:
        return levels.index(wanted)
    if isinstance(wanted, int) and not isinstance(wanted, bool):
        if not -len(levels) <= wanted < len(levels):
            raise FormulaError(f"specified level {wanted!r} is out of range")
        return wanted % len(levels)
    raise FormulaError(f"specified level {wanted!r} not found")


class ContrastMatrix:
    """Rows are levels; ``column_suffixes`` name the columns."""

    def __init__(self, matrix: object, column_suffixes: Sequence[str]) -> None:
        self.matrix, self.column_suffixes = np.asarray(matrix, dtype=float), list(column_suffixes)
        if self.matrix.ndim != 2 or self.matrix.shape[1] != len(self.column_suffixes):
            raise FormulaError("matrix and column_suffixes don't conform")

    @property
    def shape(self) -> tuple[int, int]:
        return self.matrix.shape

    def column(self, at: int) -> tuple[float, dict[float, list[int]]]:
        """The most common weight of a column, and the rows of each other weight."""
        rows: dict[float, list[int]] = {}
        for i, w in enumerate(self.matrix[:, at].tolist()):
            rows.setdefault(w, []).append(i)
        common = max(rows, key=lambda w: len(rows[w]))
        return common, {w: r for w, r in rows.items() if w != common}

    def to_json(self) -> list:
        return [self.matrix.tolist(), self.column_suffixes]

    @staticmethod
    def from_json(data: list) -> ContrastMatrix:
        return OneHot(*data) if len(data) == 3 else ContrastMatrix(*data)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ContrastMatrix) and self.column_suffixes == other.column_suffixes and np.array_equal(self.matrix, other.matrix)

    __hash__ = None


class OneHot(ContrastMatrix):
    """A dummy for each of the levels ``chosen`` of ``rows``; the square matrix is only made when asked for."""

    def __init__(self, rows: int, chosen: Sequence[int], column_suffixes: Sequence[str]) -> None:
        self.rows, self.chosen, self.column_suffixes = rows, list(chosen), list(column_suffixes)

    @property
    def matrix(self) -> np.ndarray:
        return np.eye(self.rows)[:, self.chosen]

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, len(self.chosen)

    def column(self, at: int) -> tuple[float, dict[float, list[int]]]:
        return (1.0, {}) if self.rows == 1 else (0.0, {1.0: [self.chosen[at]]})

    def to_json(self) -> list:
        return [self.rows, self.chosen, self.column_suffixes]


class OneHotOfTable(OneHot):
    """The same for levels in a table, all of them or all but one; ``column_suffixes`` are there, too."""

    def __init__(self, rows: int, column_suffixes: LevelNames) -> None:
        self.rows, self.column_suffixes = rows, column_suffixes

    @property
    def chosen(self) -> list[int]:
        return [i for i in range(self.rows) if i != self.column_suffixes.without]

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, len(self.column_suffixes)

    def column(self, at: int) -> tuple[float, dict[float, list[int]]]:
        return (1.0, {}) if self.rows == 1 else (0.0, {1.0: [self.column_suffixes.level(at)]})

    def to_json(self) -> list:
        return [self.rows, self.chosen, list(self.column_suffixes)]


def _with_mean(reduced: ContrastMatrix, suffixes: list[str]) -> ContrastMatrix:
    return ContrastMatrix(np.column_stack([np.ones(len(reduced.matrix)), reduced.matrix]), suffixes)


@dataclass(frozen=True)
class Treatment:
    """Dummies; the reduced form leaves the reference level out (the first one, unless given)."""

    reference: object = None

    def code_with_intercept(self, levels: Sequence) -> ContrastMatrix:
        if isinstance(levels, Levels):
            return OneHotOfTable(len(levels), LevelNames("[", levels))
        return OneHot(len(levels), range(len(levels)), bracketed("", levels))

    def code_without_intercept(self, levels: Sequence) -> ContrastMatrix:
        out = 0 if self.reference is None else level_index(levels, self.reference)
        if isinstance(levels, Levels):
            return OneHotOfTable(len(levels), LevelNames("[T.", levels, out))
        rest = [i for i in range(len(levels)) if i != out]
        return OneHot(len(levels), rest, bracketed("T.", [levels[i] for i in rest]))


@dataclass(frozen=True)
class Sum:
    """Deviations from the mean of levels; the omitted level (the last one, unless given) has -1 throughout."""

    omit: object = None

    def code_without_intercept(self, levels: Sequence) -> ContrastMatrix:
        out = len(levels) - 1 if self.omit is None else level_index(levels, self.omit)
        rest = [i for i in range(len(levels)) if i != out]
        matrix = np.eye(len(levels))[:, rest]
        matrix[out] = -1
        return ContrastMatrix(matrix, bracketed("S.", [levels[i] for i in rest]))

    def code_with_intercept(self, levels: Sequence) -> ContrastMatrix:
        reduced = self.code_without_intercept(levels)
        return _with_mean(reduced, ["[mean]", *reduced.column_suffixes])


@dataclass(frozen=True)
class Helmert:
    """Each level against those before it."""

    def code_without_intercept(self, levels: Sequence) -> ContrastMatrix:
        n = len(levels)
        i, j = np.arange(n)[:, None], np.arange(n - 1)[None, :]
        return ContrastMatrix(np.where(i <= j, -1.0, np.where(i == j + 1, j + 1.0, 0.0)), bracketed("H.", levels[1:]))

    def code_with_intercept(self, levels: Sequence) -> ContrastMatrix:
        reduced = self.code_without_intercept(levels)
        return _with_mean(reduced, ["[H.intercept]", *reduced.column_suffixes])


@dataclass(frozen=True)
class Diff:
    """Each level against the one before it."""

    def code_without_intercept(self, levels: Sequence) -> ContrastMatrix:
        n = len(levels)
        i, j = np.arange(n)[:, None], np.arange(n - 1)[None, :]
        return ContrastMatrix((j + 1 - n * (i <= j)) / n, bracketed("D.", levels[:-1]))

    def code_with_intercept(self, levels: Sequence) -> ContrastMatrix:
        return _with_mean(self.code_without_intercept(levels), bracketed("D.", levels))


@dataclass(frozen=True)
class Poly:
    """Orthogonal polynomials over the levels' scores (0, 1, 2, ..., unless given)."""

    scores: tuple | None = None

    def __init__(self, scores: Sequence | None = None) -> None:
        object.__setattr__(self, "scores", None if scores is None else tuple(scores))

    def _coded(self, levels: Sequence) -> ContrastMatrix:
        n = len(levels)
        scores = np.arange(n, dtype=float) if self.scores is None else np.asarray(self.scores, dtype=float)
        if len(scores) != n:
            raise FormulaError(f"number of levels ({n}) does not match number of scores ({len(scores)})")
        q, r = np.linalg.qr((scores - scores.mean())[:, None] ** np.arange(n))
        q = q * np.sign(np.diag(r))
        q[:, 0] = 1
        names = [".Constant", ".Linear", ".Quadratic", ".Cubic", *(f"^{k}" for k in range(4, n))]
        return ContrastMatrix(q, names[:n])

    def code_with_intercept(self, levels: Sequence) -> ContrastMatrix:
        return self._coded(levels)

    def code_without_intercept(self, levels: Sequence) -> ContrastMatrix:
        full = self._coded(levels)
        return ContrastMatrix(full.matrix[:, 1:], full.column_suffixes[1:])


def coded(contrast: object, levels: Sequence, full: bool) -> ContrastMatrix:
    """Code ``levels``: by the default, a contrast (class, instance or factory), a ContrastMatrix or a plain matrix."""
    contrast = Treatment if contrast is None else contrast
    if isinstance(contrast, ContrastMatrix):
        found = contrast
    else:
        if not hasattr(contrast, "code_with_intercept") and callable(contrast) or isinstance(contrast, type):
            contrast = contrast()
        if isinstance(levels, Levels) and not isinstance(contrast, Treatment):
            # The matrix has a row for each level, so these are few enough for a list.
            levels = tuple(levels)
        if hasattr(contrast, "code_with_intercept"):
            found = contrast.code_with_intercept(levels) if full else contrast.code_without_intercept(levels)
        else:
            matrix = np.asarray(contrast, dtype=float)
            if matrix.ndim != 2:
                raise FormulaError("a contrast matrix has two dimensions")
            found = ContrastMatrix(matrix, [f"[custom{i}]" for i in range(matrix.shape[1])])
    if found.shape[0] != len(levels):
        raise FormulaError(f"contrast matrix has wrong number of rows: {found.shape[0]} for {len(levels)} levels")
    return found
