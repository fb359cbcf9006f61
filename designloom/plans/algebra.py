"""Formula algebra: trees to lists of terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from .errors import FormulaError, Span
from .grammar import Node, Operator, parse_formula
from .lexer import respaced


@dataclass(frozen=True)
class EvalFactor:
    """A Python expression over columns; equal when its canonical text is."""

    code: str
    span: Span | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "code", respaced(self.code))

    def name(self) -> str:
        return self.code


@dataclass(frozen=True)
class LookupFactor:
    """A column by its name, whatever characters that has."""

    column: str
    force_categorical: bool = False
    contrast: object = field(default=None, compare=False)
    levels: tuple | None = None
    span: Span | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if (self.contrast is not None or self.levels is not None) and not self.force_categorical:
            raise ValueError("contrast and levels need force_categorical=True")
        if self.levels is not None:
            object.__setattr__(self, "levels", tuple(self.levels))

    def name(self) -> str:
        return self.column


class Term:
    """A set of factors; their order matters for names only. Without factors it is the intercept."""

    def __init__(self, factors: Iterable) -> None:
        self.factors = tuple(dict.fromkeys(factors))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Term) and frozenset(self.factors) == frozenset(other.factors)

    def __hash__(self) -> int:
        return hash(frozenset(self.factors))

    def name(self) -> str:
        return ":".join(f.name() for f in self.factors) or "Intercept"

    def __repr__(self) -> str:
        return f"Term({self.name()})"


INTERCEPT = Term(())


@dataclass(frozen=True)
class ModelDesc:
    """Term lists of the outcome and of the predictors."""

    lhs: tuple[Term, ...]
    rhs: tuple[Term, ...]

    def __init__(self, lhs: Iterable[Term], rhs: Iterable[Term]) -> None:
        object.__setattr__(self, "lhs", tuple(dict.fromkeys(lhs)))
        object.__setattr__(self, "rhs", tuple(dict.fromkeys(rhs)))

    @classmethod
    def from_formula(cls, formula: str | Node, algebra: Algebra | None = None) -> ModelDesc:
        tree = parse_formula(formula) if isinstance(formula, str) else formula
        found = (algebra or Algebra()).run(tree)
        if not isinstance(found, ModelDesc):
            raise FormulaError("not a formula", tree)
        return found

    def describe(self) -> str:
        def side(terms: tuple[Term, ...], implicit: bool) -> list[str]:
            names = ["1" if t == INTERCEPT else t.name() for t in terms]
            if implicit:
                if "1" in names:
                    names.remove("1")
                else:
                    names.insert(0, "0")
            return names

        left, right = side(self.lhs, False), side(self.rhs, True)
        return " ".join(([" + ".join(left)] if left else []) + ["~", " + ".join(right) or "1"])


@dataclass(frozen=True)
class Partial:
    """A side of a formula so far: terms, and what its text says about the intercept."""

    terms: tuple[Term, ...] = ()
    #: None: not mentioned; True: added (at ``span``); False: removed.
    one: bool | None = None
    span: Span | None = None

    def merged(self, other: Partial) -> Partial:
        """Both terms; what ``other`` adds of the intercept prevails."""
        terms = tuple(dict.fromkeys(self.terms + other.terms))
        return replace(other if other.one else self, terms=terms)

    def free(self) -> Partial:
        if self.one:
            raise FormulaError("the intercept can't take part in an interaction", self.span)
        return self


def crossed(left: Partial, right: Partial) -> tuple[Term, ...]:
    left.free(), right.free()
    return tuple(dict.fromkeys(Term(a.factors + b.factors) for a in left.terms for b in right.terms))


class Algebra:
    """Meaning of each operator; ``rules`` maps (kind, arity) to a function of (algebra, node)."""

    def __init__(self) -> None:
        self.rules: dict[tuple[str, int], Callable[[Algebra, Node], object]] = {
            ("~", 1): Algebra.one_sided, ("~", 2): Algebra.two_sided,
            ("+", 2): Algebra.plus, ("-", 2): Algebra.minus, ("*", 2): Algebra.product, ("/", 2): Algebra.nested,
            (":", 2): Algebra.interact, ("**", 2): Algebra.power,
            ("+", 1): lambda self, node: self.side(node.args[0]), ("-", 1): Algebra.negative,
            ("zero", 0): lambda self, node: Partial(one=False), ("one", 0): lambda self, node: Partial(one=True, span=node.span),
            ("number", 0): Algebra.number, ("python", 0): lambda self, node: Partial((Term([EvalFactor(node.text, node.span)]),)),
        }

    def add_op(self, operator: Operator, rule: Callable[[Algebra, Node], Partial]) -> None:
        self.rules[operator.symbol, operator.arity] = rule

    def run(self, node: Node) -> object:
        rule = self.rules.get((node.kind, len(node.args)))
        if rule is None:
            raise FormulaError(f"there is no rule for the operator '{node.kind}' here", node.token)
        return rule(self, node)

    def side(self, node: Node) -> Partial:
        found = self.run(node)
        if isinstance(found, ModelDesc):
            raise FormulaError("~ may stand once, outside of all parentheses", node)
        if not isinstance(found, Partial):
            raise FormulaError("the rule of this operator gave no side of a formula", node)
        return found

    def one_sided(self, node: Node) -> ModelDesc:
        return self._model(Partial(one=False), self.side(node.args[0]))

    def two_sided(self, node: Node) -> ModelDesc:
        return self._model(self.side(node.args[0]), self.side(node.args[1]))

    @staticmethod
    def _model(left: Partial, right: Partial) -> ModelDesc:
        # Only predictors have an intercept unless told otherwise.
        lead = lambda yes: (INTERCEPT,) if yes else ()
        return ModelDesc(lead(left.one is True) + left.terms, lead(right.one is not False) + right.terms)

    def plus(self, node: Node) -> Partial:
        left, right = map(self.side, node.args)
        # Only the bare literal 0 on the right removes; in parentheses it is a literal still.
        return replace(left, one=False, span=None) if node.args[1].kind == "zero" else left.merged(right)

    def minus(self, node: Node) -> Partial:
        left, right = map(self.side, node.args)
        if node.args[1].kind == "zero":
            return replace(left, one=True, span=node.args[1].span)
        left = replace(left, terms=tuple(t for t in left.terms if t not in right.terms))
        return replace(left, one=False, span=None) if right.one else left

    def interact(self, node: Node) -> Partial:
        return Partial(crossed(*map(self.side, node.args)))

    def product(self, node: Node) -> Partial:
        left, right = map(self.side, node.args)
        return Partial(tuple(dict.fromkeys(left.terms + right.terms + crossed(left, right))))

    def nested(self, node: Node) -> Partial:
        """``a/b`` is ``a + a:b``; all of the left side nests the right one together."""
        left, right = map(self.side, node.args)
        whole = Partial((Term(f for t in left.free().terms for f in t.factors),))
        return Partial(tuple(dict.fromkeys(left.terms + crossed(whole, right))))

    def power(self, node: Node) -> Partial:
        base, exponent = self.side(node.args[0]).free(), node.args[1]
        try:
            times = int(exponent.text) if exponent.kind in ("one", "number") else 0
        except ValueError:
            times = 0
        if times < 1:
            raise FormulaError("the power must be a whole number above 0", exponent)
        found = newest = base.terms
        # Beyond one factor of each term nothing new appears.
        for _ in range(min(times, len(base.terms)) - 1):
            newest = crossed(base, Partial(newest))
            found = found + newest
        return Partial(tuple(dict.fromkeys(found)))

    def negative(self, node: Node) -> Partial:
        inner = node.args[0].kind
        if inner not in ("zero", "one"):
            raise FormulaError("only 0 and 1 can have a sign of their own", node)
        return Partial(one=True, span=node.span) if inner == "zero" else Partial(one=False)

    def number(self, node: Node) -> Partial:
        raise FormulaError("no number but 0 and 1 is a term", node)
