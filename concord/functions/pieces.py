"""Text as a row of pieces, and a reader that walks along it.

A piece is a run of digits, a run of letters, a run of blanks, or one mark.
Parsers of notes and citations step over pieces instead of characters.
"""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple

DIGITS, LETTERS, BLANKS, MARK = "digits", "letters", "blanks", "mark"


class Piece(NamedTuple):
    kind: str
    text: str
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def _kind(c: str) -> str:
    return DIGITS if c.isdecimal() else LETTERS if c.isalpha() or c == "_" else BLANKS if c.isspace() else MARK


def pieces(text: str) -> list[Piece]:
    row, at = [], 0
    for kind, run in groupby(text, _kind):
        whole = "".join(run)
        row += [Piece(kind, c, at + k) for k, c in enumerate(whole)] if kind == MARK else [Piece(kind, whole, at)]
        at += len(whole)
    return row


class Reader:
    """Takes what it is asked for, or leaves its place as it was and answers None."""

    def __init__(self, row: list[Piece], at: int = 0):
        self.row, self.at = row, at

    def peek(self) -> Piece | None:
        return self.row[self.at] if self.at < len(self.row) else None

    def _take(self, kind: str, fits) -> str | None:
        piece = self.peek()
        if piece is None or piece.kind != kind or not fits(piece.text):
            return None
        self.at += 1
        return piece.text

    def number(self, *sizes: int) -> str | None:
        """Digits, as many as one of the sizes."""
        return self._take(DIGITS, lambda t: len(t) in sizes)

    def word(self, *choices: str) -> str | None:
        """One of the words, or any word."""
        return self._take(LETTERS, lambda t: not choices or t in choices)

    def mark(self, choices: str) -> str | None:
        return self._take(MARK, lambda t: t in choices)

    def blanks(self) -> str | None:
        return self._take(BLANKS, bool)

    def fresh(self) -> bool:
        """Nothing that belongs to a word or number stands just before."""
        return not self.at or self.row[self.at - 1].kind not in (DIGITS, LETTERS)

    def over(self) -> bool:
        """Nothing that belongs to a word or number follows."""
        piece = self.peek()
        return piece is None or piece.kind not in (DIGITS, LETTERS)
