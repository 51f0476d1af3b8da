"""Dates in cells and in the citations of notes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType

from concord.functions.pieces import DIGITS, LETTERS, Reader, pieces

#: Names of the months, written whole or by their first three letters, September also by four;
#: what follows a day's number; marks that may close a note; years that a note can close with.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
LONGER = {"Sept": 9}
ORDINALS = ("st", "nd", "rd", "th")
CLOSERS = ".,;:)]'’\"”"
YEARS = range(1500, 2100)
MONTH_NUMBERS = {name[:n]: k for k, name in enumerate(MONTHS, 1) for n in (3, len(name))} | LONGER


def parse_cell(c: Column) -> Column:
    """``d/M/yyyy``, or a year from 1500 to 2099 as its first of January; else null."""
    year = F.expr("try_cast(NULL as int)") if c is None else F.trim(c).try_cast("int")
    exact = F.when(F.trim(c).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(F.trim(c), "d/M/yyyy"))
    return F.coalesce(exact, F.when(F.trim(c).rlike(r"^\d+$") & year.between(YEARS[0], YEARS[-1]), F.make_date(year, F.lit(1), F.lit(1))))


def _slashed(r: Reader) -> tuple[str, int, str] | None:
    """Day, month and year between slashes; the second slash may be doubled or left out."""
    day = r.number(1, 2)
    if not day or not r.mark("/"):
        return None
    if joined := r.number(6):
        return joined[2:], int(joined[:2]), day
    month = r.number(1, 2)
    if not month or not r.mark("/"):
        return None
    r.mark("/")
    year = r.number(4)
    return (year, int(month), day) if year else None


def _month(r: Reader) -> int | None:
    name = r.word(*MONTH_NUMBERS)
    if name:
        r.mark(".")
    return MONTH_NUMBERS.get(name)


def _month_first(r: Reader) -> tuple[str, int, str] | None:
    month = _month(r)
    day = month and r.blanks() and r.number(1, 2)
    if not day:
        return None
    r.word(*ORDINALS)
    r.mark(",")
    year = r.blanks() and r.number(4)
    return (year, month, day) if year else None


def _day_and_month(r: Reader) -> tuple[str, int] | None:
    day = r.number(1, 2)
    if not day:
        return None
    r.word(*ORDINALS)
    if not r.blanks() or (r.word("of") and not r.blanks()):
        return None
    month = r.word(*MONTH_NUMBERS)
    return (day, MONTH_NUMBERS[month]) if month else None


def _day_first(r: Reader) -> tuple[str, int, str] | None:
    found = _day_and_month(r)
    if not found:
        return None
    r.mark(".")
    r.mark(",")
    year = r.blanks() and r.number(4)
    return (year, found[1], found[0]) if year else None


def full_dates(note: str) -> Iterator[dt.date]:
    """Dates with day, month and year, in order; those not in the calendar are left out."""
    row = pieces(note)
    for at in range(len(row)):
        for form in (_slashed, _month_first, _day_first):
            r = Reader(row, at)
            found = form(r) if r.fresh() else None
            if found and r.over():
                try:
                    yield dt.date(int(found[0]), found[1], int(found[2]))
                except ValueError:
                    continue


def full_date(note: str) -> dt.date | None:
    """The last valid full date of a note."""
    return next(iter([*full_dates(note)][-1:]), None)


def closing_year(note: str) -> int | None:
    """A year with which the note ends, but for closing marks."""
    end = len(note)
    while end and (note[end - 1].isspace() or note[end - 1] in CLOSERS):
        end -= 1
    row = pieces(note[:end])
    if not row or row[-1].kind != DIGITS or len(row[-1].text) != 4 or (len(row) > 1 and row[-2].kind == LETTERS):
        return None
    year = int(row[-1].text)
    return year if year in YEARS else None


def note_date(note: str | None) -> dt.date | None:
    """A note's citation date: its last full date, else a year that ends it."""
    if not note or not note.strip():
        return None
    found = full_date(note)
    year = closing_year(note) if found is None else None
    return dt.date(year, 1, 1) if year else found


def has_fragment(note: str) -> bool:
    """Two numbers about a slash, or a month beside the number of a day."""
    row = pieces(note)
    for at, piece in enumerate(row):
        if piece.text == "/" and 0 < at < len(row) - 1 and row[at - 1].kind == row[at + 1].kind == DIGITS:
            return True
        r = Reader(row, at)
        if r.fresh() and ((_month(r) and r.blanks() and r.number(1, 2)) and r.over()):
            return True
        r = Reader(row, at)
        if r.fresh() and _day_and_month(r) and r.over():
            return True
    return False


@F.pandas_udf(DateType())
def parse_note(notes: pd.Series) -> pd.Series:
    return notes.map(note_date, na_action="ignore")


@F.pandas_udf(BooleanType())
def looks_dated(notes: pd.Series) -> pd.Series:
    """A fragment of a date stands there, but no full date."""
    return notes.map(lambda n: bool(n) and has_fragment(n) and full_date(n) is None)
