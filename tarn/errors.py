"""Errors that the engine raises."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package."""


class SpanError(EngineError):
    """An error at a place of the query, shown with a caret below it."""

    def __init__(self, message: str, query: str = "", start: int = 0, end: int | None = None):
        self.message, self.query, self.start = message, query, start
        self.end = start + 1 if end is None else end
        super().__init__(self.render())

    def render(self) -> str:
        if not self.query:
            return self.message
        line_start = self.query.rfind("\n", 0, self.start) + 1
        line = self.query[line_start:].split("\n", 1)[0]
        return f"{self.message}\n{line}\n{' ' * (self.start - line_start)}{'^' * max(1, self.end - self.start)}"


class LexError(SpanError):
    """Characters that make no token."""


class ParseError(SpanError):
    """Tokens that make no statement."""


class AnalysisError(EngineError):
    """Unknown names, classes that do not fit, statements without an execution."""


class FileFormatError(EngineError):
    """A database file that breaks its format."""
