"""Lexing of formulas: Python tokens, their canonical spacing, and formula tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from .errors import FormulaError, Span

_TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<comment>\#.*)
  | (?P<string>(?i:[rbfu]{0,2})(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"))
  | (?P<number>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9_]+)?[jJ]?))
  | (?P<name>[^\W\d]\w*)
  | (?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|<>|[-+*/%@&|^~<>()\[\]{},:.;=])
    """,
    re.VERBOSE | re.DOTALL,
)

# Operators written with a space on both sides, and those with one after or before.
SPACED = set("+ - * / % & ^ | < > == <> != <= >= << >> ** //".split())
SPACED_BEFORE = SPACED | {"!", "~"}
SPACED_AFTER = SPACED | {",", ":"}
OPENING, CLOSING = "([{", ")]}"


@dataclass(frozen=True)
class Lexeme:
    kind: str
    text: str
    span: Span

    @property
    def wordlike(self) -> bool:
        return self.kind in ("name", "number", "string")


def python_lexemes(code: str) -> Iterator[Lexeme]:
    """Tokens of Python text; white space (newlines too) is dropped, comments are refused."""
    at = 0
    while at < len(code):
        m = _TOKEN.match(code, at)
        if m is None:
            raise FormulaError("no Python token begins here (is a string left open?)", Span(code, at, at + 1))
        span = Span(code, *m.span())
        if m.lastgroup == "comment":
            raise FormulaError("a formula can't hold a comment", span)
        if m.lastgroup != "space":
            yield Lexeme(m.lastgroup, m[0], span)
        at = m.end()


def spaced(lexemes: Iterable[Lexeme]) -> str:
    """Canonical spacing of an expression; it decides which factors are equal, and column names."""
    out = ""
    wants_space = after_word = after_operand = after_opening = False
    depth: list[str] = []
    for lexeme in lexemes:
        text = lexeme.text
        if lexeme.wordlike:
            out += " " * (wants_space or after_word) + text
            wants_space, after_word, after_operand, after_opening = False, True, True, False
            continue
        if text in OPENING:
            depth.append(text)
        elif depth and text in CLOSING:
            depth.pop()
        before, after = text in SPACED_BEFORE, text in SPACED_AFTER
        if text == ":" and depth[-1:] == ["["]:
            after = False  # a slice
        if text in ("*", "**") and after_opening or text in ("+", "-") and not after_operand:
            before = after = False  # unpacking, or a sign
        if text == "=" and not depth:
            before = after = True
        out += " " * (wants_space or before) + text
        wants_space, after_word, after_operand, after_opening = after, False, text == ")", text in ("(", ",")
    return out


def respaced(code: str) -> str:
    return spaced(python_lexemes(code))


@dataclass(frozen=True)
class Token:
    """A formula token: an operator or parenthesis, or a leaf ``zero``, ``one``, ``number`` or ``python``."""

    kind: str
    span: Span
    text: str = ""


def _leaf_kind(text: str) -> str:
    if text in ("0", "1"):
        return ("zero", "one")[int(text)]
    try:
        float(text)
    except ValueError:
        return "python"
    return "number"


def formula_tokens(code: str, operators: set[str]) -> Iterator[Token]:
    """Split a formula at operators and parentheses outside of embedded Python expressions."""
    held: list[Lexeme] = []
    depth = 0

    def leaf() -> Iterator[Token]:
        if held:
            if depth:
                raise FormulaError("a bracket in this expression is left open", Span.cover(held))
            text = spaced(held)
            yield Token(_leaf_kind(text), Span.cover(held), text)
            held.clear()

    for lexeme in python_lexemes(code):
        text = lexeme.text
        # Inside an expression an opening parenthesis is a call; elsewhere it groups.
        ends = text in operators or text == ")" or text == "(" and not held
        if not depth and ends:
            yield from leaf()
            yield Token(text, lexeme.span, text)
            continue
        depth += (text in OPENING) - (text in CLOSING)
        if depth < 0:
            raise FormulaError("this bracket closes nothing", lexeme)
        held.append(lexeme)
    yield from leaf()
