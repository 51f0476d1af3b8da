"""Line preparation at load time: ordered walks as windows over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import dates, references
from concord.operators.search import once

#: Names of the inline reference formats, and the words of headings.
FORMATS = ["bracketed-citation", "bracketed-number", "leading-number", "incipit-psalm-heading", "colon-verse", "heading-line"]
CHAPTER_WORDS, PSALM_WORDS = ["cab", "cab.", "cabdil", "chapter"], ["psalm", "psalms"]
#: The most characters of a book's name or an incipit that stand before or after a number.
BOOK, INCIPIT = 40, 81
REFERENCE = "struct<ref:string,rest:string>"


def language(line: Column, default: Column) -> Column:
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(clean(line), clean(default), F.lit("gv"))


def _open(c: Column) -> Column:
    """Without the blanks that it begins with."""
    return F.regexp_replace(c, r"^\s+", "")


def _from(c: Column, at: Column) -> Column:
    return F.substr(c, F.greatest(at, F.lit(1)))


def _digits(c: Column) -> Column:
    """The digits that it begins with."""
    return F.regexp_extract(c, "^[0-9]+", 0)


def _without(c: Column, mark: str) -> Column:
    """Without one of the marks at its beginning."""
    return F.regexp_replace(c, f"^[{mark}]", "")


def _unstopped(c: Column) -> Column:
    """Without a full stop at its end."""
    return F.regexp_replace(c, r"[.]\z", "")


def _blank(c: Column) -> Column:
    """Whether it begins with a blank."""
    return c.rlike(r"^\s")


def _numeral(c: Column, most: int = 3) -> Column:
    """Whether it is all digits, at most so many, or all letters of Roman numerals, at most nine."""
    roman = (F.translate(F.lower(c), references.NUMERALS, "") == "") & (F.length(c) <= 9)
    return (c != "") & (roman | (F.translate(c, "0123456789", "") == "") & (F.length(c) <= most))


def speaker(text: Column, codes: Column | list[str], present: Column) -> tuple[Column, Column]:
    """The speaker that a code at the start names, and the text without the code.

    ``codes`` may differ from row to row.  A code stands in square brackets, or
    is followed by a full stop, a colon, a blank or nothing; the longest that
    fits counts, whatever its case.  A speaker already there stays.
    """
    if isinstance(codes, list):
        if not codes:
            return present, text
        codes = F.array(*map(F.lit, codes))
    start = _open(text)
    low = F.lower(start)
    known = F.transform(F.filter(codes, lambda c: F.trim(c) != ""), lambda x: F.trim(x))
    bracketed = F.filter(known, lambda c: low.startswith(F.concat(F.lit("["), F.lower(c), F.lit("]"))))
    after = lambda c: F.substr(start, F.length(c) + 1)
    bare = F.filter(known, lambda c: low.startswith(F.lower(c)) & ((after(c) == "") | after(c).startswith(".") | after(c).startswith(":") | _blank(after(c))))
    longest = lambda a: F.array_max(F.transform(a, lambda c: F.struct(F.length(c).alias("n"), F.upper(c).alias("code"))))
    framed, plain = longest(bracketed), longest(bare)
    tail = F.substr(start, plain["n"] + 1)
    rest = F.when(framed.isNotNull(), _open(F.substr(start, framed["n"] + 3))).when(plain.isNotNull(), _open(_without(tail, ".:")))
    return F.coalesce(F.nullif(F.trim(present), F.lit("")), framed["code"], plain["code"]), F.coalesce(rest, text)


def _inline(text: Column, name: str) -> Column:
    """``(ref, rest)`` of a text that begins with a reference in the named format; else null."""
    start = _open(text)
    found = lambda test, ref, rest: F.when(test, F.struct(F.trim(ref).alias("ref"), _open(rest).alias("rest"))).cast(REFERENCE)
    if name in ("bracketed-citation", "bracketed-number"):
        close = F.locate("]", start)
        ref = F.when(close > 2, F.substr(start, F.lit(2), close - 2))
        fits = start.startswith("[") & (close > 2)
        return found(fits if name == "bracketed-citation" else fits & (_digits(ref) == ref), ref, _from(start, close + 1))
    if name == "leading-number":
        number = _digits(start)
        rest = _without(_from(start, F.length(number) + 1), ".")
        marked = _open(rest)
        rest = F.when(marked.startswith("¶"), _without(marked, "¶")).otherwise(rest)
        return found((number != "") & _blank(rest) & (_open(rest) != ""), number, rest)
    if name == "colon-verse":
        parts = F.split(start, ":", 3)
        verse = _digits(F.get(parts, F.lit(2)))
        book, chapter = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        rest = _without(_from(F.get(parts, F.lit(2)), F.length(verse) + 1), ".")
        return found((F.size(parts) == 3) & F.length(book).between(1, BOOK + 1) & (chapter != "") & (_digits(chapter) == chapter) & (verse != ""), F.concat_ws(":", book, chapter, verse), rest)
    body = F.regexp_replace(start, r"\s+$", "")
    if name == "heading-line":
        words = F.split(body, r"\s+")
        number = _unstopped(F.get(words, F.lit(1)))
        return found((F.size(words) == 2) & F.lower(words[0]).isin(*CHAPTER_WORDS, "psalm") & (number != "") & (F.translate(F.lower(number), references.NUMERALS + "0123456789", "") == ""), body, F.lit(""))
    ref = _unstopped(body)
    return found(incipit(ref, stopped=True, told=True) != "", ref, F.lit(""))


def incipit(c: Column, stopped: bool = False, told: bool = False) -> Column:
    """The number of a psalm's heading with its first words: ``psal. 1 Beatus``, or ``Beatus psal. 1``; empty if it is none.

    ``stopped`` asks for the full stop in the second form, ``told`` for the first words.
    """
    low = F.lower(c)
    lead = _open(_without(_from(low, F.lit(5)), "."))
    number = _digits(lead)
    more = _from(lead, F.length(number) + 1)
    words = F.length(_open(_without(more, ".")))
    ends = _blank(_without(more, ".")) & words.between(1, INCIPIT) if told else (F.length(number) <= 3) & ~more.rlike(r"^[\p{L}\p{N}_]")
    leading = F.when(low.startswith("psal") & (number != "") & ends, number)
    last = F.regexp_extract(low, "[0-9]+$", 0)
    head = F.regexp_replace(F.left(low, F.length(low) - F.length(last)), r"\s+$", "")
    before = head if stopped else _unstopped(head)
    stem = F.left(before, F.length(before) - (5 if stopped else 4))
    apart = ~stem.rlike(r"[\p{L}\p{N}_]$") & (F.length(stem).between(1, INCIPIT) if told else F.length(last) <= 3)
    trailing = F.when((last != "") & before.endswith("psal." if stopped else "psal") & apart, last)
    return F.coalesce(leading, trailing, F.lit(""))


def inline_reference(text: Column, formats: Column | list[str], present: Column | None = None, english: Column | None = None) -> tuple[Column, ...]:
    """The reference by the first format that fits, and the text without it; with ``english``, also that text without its own.

    ``formats`` may differ from row to row; names that are not known are passed
    over.  A reference already ``present`` stays, the marker goes all the same.
    The English text loses a marker of the format that the text had.
    """
    named = F.array(*map(F.lit, formats)) if isinstance(formats, list) else formats
    named = F.filter(F.transform(named, lambda x: F.trim(x)), lambda f: f.isin(*FORMATS))
    each = F.create_map(*(x for f in FORMATS for x in (F.lit(f), _inline(text, f))))
    fitting = F.filter(named, lambda f: F.try_element_at(each, f).isNotNull())
    chosen = F.get(fitting, F.lit(0))
    found = F.try_element_at(each, chosen)
    ref, rest = found["ref"], F.when(found.isNotNull(), found["rest"]).otherwise(text)
    if present is not None:
        ref = F.coalesce(F.nullif(F.trim(present), F.lit("")), ref)
    if english is None:
        return ref, rest
    other = F.coalesce(*(F.when(chosen == f, _inline(english, f)) for f in FORMATS))
    return ref, rest, F.when(other.isNotNull(), other["rest"]).otherwise(english)


def stats_text(text: Column, events: Column | tuple[str, ...] = ()) -> Column:
    """The text that counts as words, without citations, ``sic`` notes and recording events; null where that is the text itself."""
    named = F.array(*map(F.lit, events)).cast("array<string>") if isinstance(events, tuple) else events
    return F.nullif(references.strip_apparatus(text, named), text)


def line_dates(lines: DataFrame, cell: str = "date_cell", note: str = "notes") -> DataFrame:
    """``date``: a line's own, its note's, or that of the line before it."""
    own = F.coalesce(dates.parse_cell(F.col(cell)), dates.parse_note(F.col(note)))
    return fill_forward(lines.withColumn("own_date", own), "own_date", "date")


def fill_forward(lines: DataFrame, source: str, target: str) -> DataFrame:
    walk = Window.partitionBy("ident").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(target, F.last(source, ignorenulls=True).over(walk))


def collection_span(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents dated by their lines where those have dates."""
    span = lines.groupBy("ident").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    joined = documents.join(span, "ident", "left")
    return joined.withColumn("date_start", F.coalesce("lo", "date_start")).withColumn("date_end", F.coalesce("hi", "date_end")).drop("lo", "hi")


def resolve_references(lines: DataFrame, seed_book: Column | None = None) -> DataFrame:
    """``canonical_reference`` from ``reference`` in line order.

    Headings set the context: a chapter heading the chapter, a psalm heading
    book and chapter.  Bare numbers are verses of it.  Verses with colons and
    free citations stand for themselves.
    """
    ref = F.trim("reference")
    parts = F.split(ref, ":")
    named_book, chapter_no, verse_no = (F.get(parts, F.lit(k)) for k in range(3))
    short = lambda c: (_digits(c) == c) & F.length(c).between(1, 3)
    is_colon = (F.size(parts) == 3) & F.length(named_book).between(1, BOOK) & short(chapter_no) & short(verse_no)
    words = F.split(ref, r"\s+")
    first, named = F.lower(F.get(words, F.lit(0))), _unstopped(F.get(words, F.lit(1)))
    is_heading = (F.size(words) == 2) & _numeral(named)
    started = incipit(ref)
    number = lambda c: F.coalesce(c.try_cast("int"), references.roman_number(c))
    kind = (
        F.when(is_colon, "colon").when(short(ref), "bare").when(is_heading & first.isin(*CHAPTER_WORDS), "chapter")
        .when(is_heading & first.isin(*PSALM_WORDS), "psalm").when(started != "", "incipit").when(ref != "", "free")
    )
    own = once(lines, "kind", kind)
    own = own.withColumn("heading", F.when(F.col("kind").isin("chapter", "psalm"), number(named)).when(F.col("kind") == "incipit", number(started)))
    walk = Window.partitionBy("ident").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # a chapter heading that is no number clears the chapter, a psalm heading that is none changes nothing
    moves = (F.col("kind") == "chapter") | (F.col("kind").isin("psalm", "incipit") & F.col("heading").isNotNull())
    context = F.last(F.when(moves, F.struct("heading")), ignorenulls=True).over(walk)["heading"]
    book = F.coalesce(F.last(F.when(F.col("kind").isin("psalm", "incipit") & F.col("heading").isNotNull(), F.lit("psalms")), ignorenulls=True).over(walk), seed_book if seed_book is not None else F.lit(None).cast("string"))
    own = own.withColumn("context", context).withColumn("book", book)
    key = lambda *parts: F.when(F.coalesce(*[F.when(p.isNull(), True) for p in parts], F.lit(False)), None).otherwise(F.concat_ws(".", *parts))
    verse = lambda c: c.try_cast("int").cast("string")
    resolved = (
        F.when(F.col("kind") == "colon", key(references.book_id(named_book), verse(chapter_no), verse(verse_no)))
        .when(F.col("kind") == "bare", key(F.col("book"), F.col("context").cast("string"), ref.try_cast("int").cast("string")))
        .when(F.col("kind") == "chapter", key(F.col("book"), F.col("context").cast("string")))
        .when(F.col("kind").isin("psalm", "incipit"), key(F.lit("psalms"), F.col("heading").cast("string")))
        .when(F.col("kind") == "free", references.citation_key(F.when(F.col("kind") == "free", ref)))
    )
    return own.withColumn("canonical_reference", resolved).drop("kind", "heading", "context", "book")


def keep_first(documents: DataFrame, order: str = "load_order") -> DataFrame:
    """The first document of each ident in load order; those without one all stay."""
    first = F.row_number().over(Window.partitionBy("ident").orderBy(order))
    named = documents.where("ident is not null").withColumn("k", first).where("k = 1").drop("k")
    return named.unionByName(documents.where("ident is null"))


def newspaper(source: Column, names: dict[str, str]) -> Column:
    """The id of the newspaper named first in a source; a longer name wins where two begin together."""
    found = [F.when(F.instr(source, name) > 0, F.struct(F.instr(source, name).alias("at"), F.lit(-len(name)).alias("n"), F.lit(id_).alias("id"))) for name, id_ in names.items()]
    return F.array_min(F.array_compact(F.array(*found)))["id"]


def year_label(start: Column, end: Column) -> Column:
    """``1800`` or ``1800-1810``; empty where undated."""
    lo, hi = F.year(F.coalesce(start, end)), F.year(F.coalesce(end, start))
    return F.when(lo.isNull(), "").when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))
