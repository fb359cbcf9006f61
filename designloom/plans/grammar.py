"""Precedence-climbing parser, for formulas and for linear constraints."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from .errors import FormulaError, Span
from .lexer import Token, formula_tokens


@dataclass(frozen=True)
class Operator:
    symbol: str
    arity: int
    precedence: int


@dataclass(frozen=True)
class Node:
    kind: str
    token: Token | None
    span: Span | None
    args: tuple[Node, ...] = field(default=())

    @property
    def text(self) -> str:
        return self.token.text if self.token else ""

    def __str__(self) -> str:
        return f"({' '.join([self.kind, *map(str, self.args)])})" if self.args else self.text


class _Parser:
    def __init__(self, tokens: Iterable[Token], operators: Iterable[Operator], leaves: frozenset[str]) -> None:
        self.tokens, self.at, self.leaves = list(tokens), 0, leaves
        self.unary = {o.symbol: o for o in operators if o.arity == 1}
        self.binary = {o.symbol: o for o in operators if o.arity == 2}

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def operand(self) -> Node:
        token = self.peek()
        if token is None:
            raise FormulaError("the text ends where a term should follow", self.tokens[-1] if self.tokens else None)
        if token.kind == "(":
            self.take()
            inner = self.expression(None)
            if self.peek() is None:
                raise FormulaError("this parenthesis is never closed", token)
            return Node(inner.kind, inner.token, Span.cover([token, self.take()]), inner.args)
        if token.kind in self.leaves:
            self.take()
            return Node(token.kind, token, token.span)
        if token.kind in self.unary:
            self.take()
            inner = self.expression(self.unary[token.kind].precedence)
            return Node(token.kind, token, Span.cover([token, inner]), (inner,))
        raise FormulaError(f"a term should stand here, not '{token.span.text}'", token)

    def expression(self, above: int | None) -> Node:
        """Operators that bind tighter than ``above`` (all, if None); equal ones group to the left."""
        left = self.operand()
        while (token := self.peek()) is not None and token.kind != ")":
            operator = self.binary.get(token.kind)
            if operator is None:
                raise FormulaError(f"an operator should stand before '{token.span.text}'", token)
            if above is not None and operator.precedence <= above:
                break
            self.take()
            right = self.expression(operator.precedence)
            left = Node(token.kind, token, Span.cover([left, right]), (left, right))
        return left


def parse(tokens: Iterable[Token], operators: Iterable[Operator], leaves: frozenset[str]) -> Node:
    parser = _Parser(tokens, list(operators), leaves)
    tree = parser.expression(None)
    if (extra := parser.peek()) is not None:
        raise FormulaError("this parenthesis closes nothing", extra)
    return tree


# The operators of formulas.
FORMULA_OPERATORS = [
    Operator("~", 1, -100), Operator("~", 2, -100),
    Operator("+", 1, 100), Operator("-", 1, 100),
    Operator("+", 2, 100), Operator("-", 2, 100),
    Operator("*", 2, 200), Operator("/", 2, 200),
    Operator(":", 2, 300), Operator("**", 2, 500),
]
FORMULA_LEAVES = frozenset({"zero", "one", "number", "python"})


def parse_formula(code: str, extra_operators: Iterable[Operator] = ()) -> Node:
    """The tree of a formula, whose root is a ``~`` of one or two arguments."""
    extra = list(extra_operators)
    if any(o.precedence < 0 for o in extra):
        raise ValueError("own operators bind no looser than precedence 0")
    operators = [*FORMULA_OPERATORS, *extra]
    tree = parse(formula_tokens(code if code.strip() else "~ 1", {o.symbol for o in operators}), operators, FORMULA_LEAVES)
    return tree if tree.kind == "~" else Node("~", None, tree.span, (tree,))
