"""Errors that point into the text of a formula."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """A stretch of a source text."""

    code: str
    start: int
    end: int

    @staticmethod
    def cover(items: object) -> Span | None:
        """Smallest span over all ``items`` (spans, things with a ``span``, or None) of one text."""
        spans = [s for s in (getattr(i, "span", i) for i in items) if isinstance(s, Span)]
        if not spans:
            return None
        if len({s.code for s in spans}) > 1:
            raise ValueError("spans of different texts")
        return Span(spans[0].code, min(s.start for s in spans), max(s.end for s in spans))

    @property
    def text(self) -> str:
        return self.code[self.start : self.end]

    def underlined(self, indent: int = 0) -> str:
        pad = " " * indent
        return f"{pad}{self.code}\n{pad}{' ' * self.start}{'^' * max(1, self.end - self.start)}"


class FormulaError(Exception):
    """The one error of this package that users see; ``span`` tells where it arose, if known."""

    def __init__(self, message: str, where: object = None) -> None:
        super().__init__(message)
        self.message = message
        self.span: Span | None = None
        self.locate(where)

    def locate(self, where: object) -> None:
        """Set the span, unless there is one."""
        found = getattr(where, "span", where)
        if self.span is None and isinstance(found, Span):
            self.span = found

    def __str__(self) -> str:
        return self.message if self.span is None else f"{self.message}\n{self.span.underlined(4)}"
