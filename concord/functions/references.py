"""Scripture references: books, numerals, citations, canonical keys."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from concord.functions.pieces import BLANKS, DIGITS, Piece, Reader, pieces

#: Canonical ids of the books in order, each with its further names.
BOOKS = {
    "genesis": ["gen"],
    "exodus": ["exod", "ex"],
    "leviticus": ["lev"],
    "numbers": ["num", "numb", "earrooyn"],
    "deuteronomy": ["deut", "deu"],
    "joshua": ["josh"],
    "judges": ["judg", "jud", "briwnyn"],
    "ruth": [],
    "1-samuel": ["1 sam"],
    "2-samuel": ["2 sam"],
    "1-kings": ["1 kgs", "1 kin", "1 king", "1 reeaghyn"],
    "2-kings": ["2 kgs", "2 kin", "2 king", "2 reeaghyn"],
    "1-chronicles": ["1 chron", "1 chro", "1 chr", "1 recortyssyn"],
    "2-chronicles": ["2 chron", "2 chro", "2 chr", "2 recortyssyn"],
    "ezra": [],
    "nehemiah": ["neh"],
    "esther": ["esth", "est"],
    "job": [],
    "psalms": ["psalm", "psal", "psl", "ps", "psalmyn"],
    "proverbs": ["prov", "pro", "raaghyn creeney"],
    "ecclesiastes": ["eccles", "eccl", "ecc"],
    "song-of-solomon": ["song of songs", "canticles", "cant", "arrane solomon"],
    "isaiah": ["isa", "is"],
    "jeremiah": ["jer"],
    "lamentations": ["lam", "dobberan"],
    "ezekiel": ["ezek", "ezk", "ez"],
    "daniel": ["dan"],
    "hosea": ["hos"],
    "joel": [],
    "amos": [],
    "obadiah": ["obad"],
    "jonah": ["jon"],
    "micah": ["mic"],
    "nahum": ["nah"],
    "habakkuk": ["hab"],
    "zephaniah": ["zeph", "zep"],
    "haggai": ["hag"],
    "zechariah": ["zech", "zec"],
    "malachi": ["mal"],
    "matthew": ["matt", "mat", "mian"],
    "mark": [],
    "luke": [],
    "john": ["ean"],
    "acts": ["act", "jannoo"],
    "romans": ["rom", "romanee"],
    "1-corinthians": ["1 cor", "1 corinthianee"],
    "2-corinthians": ["2 cor", "2 corinthianee"],
    "galatians": ["gal", "galatianee"],
    "ephesians": ["eph", "ephesianee"],
    "philippians": ["phil", "philippianee"],
    "colossians": ["col", "colossianee"],
    "1-thessalonians": ["1 thess", "1 thes", "1 thessalonianee"],
    "2-thessalonians": ["2 thess", "2 thes", "2 thessalonianee"],
    "1-timothy": ["1 tim"],
    "2-timothy": ["2 tim"],
    "titus": ["tit"],
    "philemon": ["philem"],
    "hebrews": ["heb", "hebrewnee"],
    "james": ["jas", "jam", "screeuyn yamys"],
    "1-peter": ["1 pet", "1 peddyr"],
    "2-peter": ["2 pet", "2 peddyr"],
    "1-john": ["1 ean"],
    "2-john": ["2 ean"],
    "3-john": ["3 ean"],
    "jude": [],
    "revelation": ["rev", "ashlish"],
}
#: Letters of numerals for chapters, and marks between a citation's parts.
NUMERALS, STOPS, DASHES = "ivxlcdm", " .,:;", "-–"


@functools.cache
def books() -> dict[str, str]:
    """Every name of a book, normalised, to its id."""
    return {name: book for book, names in BOOKS.items() for name in [book.replace("-", " "), *names]}


def roman(value: str) -> int | None:
    """Additive and subtractive numerals; None on any other letter."""
    worth, total, last = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True)), 0, 0
    for c in reversed(value.lower()):
        if c not in worth:
            return None
        total += -worth[c] if worth[c] < last else worth[c]
        last = max(last, worth[c])
    return total or None


def number(value: str) -> int | None:
    return int(value) if value.isdigit() else roman(value)


def find_book(name: str | None) -> str | None:
    clean = re.sub(r"\s+", " ", re.sub(r"[.,]+", " ", (name or "").replace("[", "").replace("]", "").lower())).strip()
    clean = re.sub(r"^(i{1,3})(?= )", lambda m: str(len(m[1])), clean)
    return books().get(clean)


def parse_citation(text: str | None) -> str | None:
    """Canonical key of a free citation: a book, a chapter and a verse, of which the first of several counts.

    Words before the book that belong to no name of it are passed over.
    """
    bare = (text or "").replace("[", "").replace("]", "")
    words = "".join(" " if c in STOPS or c.isspace() else c for c in bare).split()
    for at in range(1, len(words) - 1):
        verse = first_verse(" ".join(words[at + 1 :]))
        if verse is not None and is_chapter(words[at]):
            chapter = number(words[at])
            found = (find_book(" ".join(words[k:at])) for k in range(at))
            book = next((b for b in found if b), None) if chapter else None
            return f"{book}.{chapter}.{verse}" if book else None
    return None


def is_chapter(word: str) -> bool:
    return word.isdecimal() and len(word) <= 3 or len(word) <= 9 and set(word.lower()) <= set(NUMERALS)


def first_verse(listed: str) -> int | None:
    """The first of verses that spaces or dashes join; None if anything else stands among them."""
    for dash in DASHES:
        listed = listed.replace(dash, "-")
    groups = [part.split() for part in listed.split("-")]
    numbers = [n for group in groups for n in group]
    return int(numbers[0]) if all(groups) and all(n.isdecimal() and len(n) <= 3 for n in numbers) else None


def _printed(row: list[Piece], at: int, numbered: bool) -> int | None:
    """Where a printed citation that begins at a piece ends in the text; None if there is none.

    It is a book's name with a capital, with or without its number, then the
    chapter and the verse, which may begin a range.
    """
    r = Reader(row, at)
    if numbered:
        if r.word("I", "II", "III"):
            r.mark(".")
        elif r.number(1) not in ("1", "2", "3"):
            return None
        if not r.blanks():
            return None
    name = ""
    while part := r.word() or r.mark("[]"):
        name += part
    if not 2 <= len(name) <= 21 or not name[0].isupper() or "_" in name:
        return None
    r.mark(".")
    if not r.blanks():
        return None
    chapter = r.number(1, 2, 3) or r.word()
    if not chapter or not (chapter.isdecimal() or set(chapter) <= set("ivxlc") or set(chapter) <= set("IVXLC")):
        return None
    r.mark(".,:")
    r.blanks()
    verse = r.peek()
    if verse is None or verse.kind != DIGITS:
        return None
    end, whole = verse.start + min(3, len(verse.text)), len(verse.text) <= 3
    r.at += 1
    r.blanks()
    if whole and r.mark(DASHES):
        r.blanks()
        last = r.peek()
        if last is not None and last.kind == DIGITS:
            end = last.start + min(3, len(last.text))
    return end


def spans(text: str) -> list[tuple[int, int]]:
    """Where citations seem to stand in a text; whether their books are known is not asked."""
    row, found, done = pieces(text), [], 0
    for at, piece in enumerate(row):
        if piece.start >= done and piece.kind != BLANKS and Reader(row, at).fresh():
            end = _printed(row, at, True) or _printed(row, at, False)
            if end:
                found.append((piece.start, end))
                done = end
    return found


@F.pandas_udf(StringType())
def citation_key(texts: pd.Series) -> pd.Series:
    return texts.map(parse_citation, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def find_citations(texts: pd.Series) -> pd.Series:
    """Printed citations that resolve, each once, in order."""

    def find(text: str | None) -> list[str]:
        printed = [text[a:b] for a, b in spans(text or "")]
        return [c for c in dict.fromkeys(printed) if parse_citation(c)]

    return texts.map(find)


def without_citations(text: str) -> str:
    """A space in place of each aside in round brackets that is a citation, and of each bare citation with its full stop."""
    out, at = [], 0
    for lo, hi in enclosed(text, "(", ")"):
        inner = text[lo + 1 : hi - 1].strip()
        if len(inner) <= 60 and parse_citation(inner):
            out += [text[at:lo], " "]
            at = hi
    text, out, at = "".join([*out, text[at:]]), [], 0
    for lo, hi in spans(text):
        if parse_citation(text[lo:hi]):
            out += [text[at:lo], " "]
            at = hi + (text[hi : hi + 1] == ".")
    return "".join([*out, text[at:]])


def enclosed(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Innermost bracketed parts, with their brackets; any of the openings pairs with any of the closings."""
    found, lo = [], -1
    for k, c in enumerate(text):
        if c in opening:
            lo = k
        elif c in closing and lo >= 0:
            found.append((lo, k + 1))
            lo = -1
    return found


def without_notes(text: str, events: frozenset[str]) -> str:
    """A space in place of editors' ``sic`` notes, and of the named events in square brackets."""
    out, at = [], 0
    for lo, hi in enclosed(text, "[(", "])"):
        inner = text[lo + 1 : hi - 1].strip().lower()
        words = [p.text for p in pieces(inner)[:2]]
        sic = words[:1] == ["sic"] and (len(words) < 2 or not words[1].isdecimal())
        if sic or (inner in events and text[lo] == "[" and text[hi - 1] == "]"):
            out += [text[at:lo], " "]
            at = hi
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def strip_citations(texts: pd.Series) -> pd.Series:
    return texts.map(without_citations, na_action="ignore")


@F.pandas_udf(StringType())
def strip_apparatus(texts: pd.Series, events: pd.Series) -> pd.Series:
    """Without citations, ``sic`` notes and the events that each row names."""
    own = [frozenset(e.strip().lower() for e in named if e and e.strip()) if named is not None else frozenset() for named in events]
    return pd.Series([None if t is None else without_notes(without_citations(t), e) for t, e in zip(texts, own, strict=True)], dtype=object)


def roman_number(c: Column) -> Column:
    """Roman numerals natively, by a fold from the right."""
    worth = F.create_map(*(F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair))
    values = F.transform(F.reverse(F.split(F.lower(c), "")), lambda x: F.try_element_at(worth, x))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda a, v: F.struct((a.total + F.when(v < a.last, -v).otherwise(v)).alias("total"), F.greatest(a.last, v).alias("last"))
    return F.when(c.rlike("(?i)^[ivxlcdm]+$"), F.aggregate(values, start, step)["total"])


def book_id(c: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, "[]", "")), r"[.,]+", " "), r"\s+", " "))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "^iii ", "3 "), "^ii ", "2 "), "^i ", "1 ")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in books().items() for x in pair)), clean)


def parse_key(c: Column) -> Column:
    """``(book, chapter, verse)`` of a canonical key: a known book and one or two positive numbers; else null."""
    parts = F.split(c, r"\.")
    number = lambda k: F.when(F.get(parts, F.lit(k)).rlike("^[0-9]{1,9}$"), F.get(parts, F.lit(k)).cast("int"))
    chapter, verse = number(1), number(2)
    known = F.get(parts, F.lit(0)).isin(*BOOKS)
    whole = known & (chapter > 0) & ((F.size(parts) == 2) | ((F.size(parts) == 3) & (verse > 0)))
    return F.when(whole, F.struct(F.get(parts, F.lit(0)).alias("book"), chapter.alias("chapter"), verse.alias("verse")))


def format_key(book: Column, chapter: Column, verse: Column) -> Column:
    """The key of a book, a chapter, and a verse or null; null unless the book is known and the numbers positive."""
    tail = F.when(verse.isNull(), "").when(verse > 0, F.concat(F.lit("."), verse.cast("string")))
    return F.when(book.isin(*BOOKS) & (chapter > 0), F.concat(book, F.lit("."), chapter.cast("string"), tail))
