"""Dates, citations, speakers and references at the start of lines, against cases worked out by hand."""

import datetime as dt

import pytest
from concord.functions import dates, references
from concord.operators import prepare
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("note", "want"),
    [
        (None, None), ("", None), ("  ", None), ("prose only", None), ("[M.H., 03/12/1863]", dt.date(1863, 12, 3)), ("07/01//1880", dt.date(1880, 1, 7)),
        ("23/051868", dt.date(1868, 5, 23)), ("17/101877 x", dt.date(1877, 10, 17)), ("1/2/18801", None), ("a1/2/1880 x", None), ("123/2/1880", dt.date(1880, 1, 1)),
        ("Sep 21, 1901", dt.date(1901, 9, 21)), ("Sept. 21st 1901", dt.date(1901, 9, 21)), ("sep 21, 1901 no", None), ("July 03, 1872.", dt.date(1872, 7, 3)),
        ("31st October 1912", dt.date(1912, 10, 31)), ("14th of May 1904", dt.date(1904, 5, 14)), ("14 of May., 1904", dt.date(1904, 5, 14)), ("31 Sep 1901", dt.date(1901, 1, 1)),
        ("01/01/1896 and then 02/03/1897 and 31/02/1898", dt.date(1897, 3, 2)), ("London. 1794.", dt.date(1794, 1, 1)), ("Vol. XVI; 1869]", dt.date(1869, 1, 1)),
        ("In the 1904 reprint", None), ("1499", None), ("2100", None), ("x1869", None), ("no11869", None),
    ],
)
def test_note_dates(note, want):
    assert dates.note_date(note) == want


@pytest.mark.parametrize(("note", "want"), [("31/02/1880", True), ("12/3", True), ("Sep 31", True), ("31st September", True), ("3 of June", True), ("May", False), ("Maybe 3", False), ("03/12/1863", False), ("12 / 3", False)])
def test_looks_dated(note, want):
    assert (dates.has_fragment(note) and dates.full_date(note) is None) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Jud. xii. 6", "judges.12.6"), ("MS 1 Thessalonians 2.16", "1-thessalonians.2.16"), ("Isa. xlv. 24, 25", "isaiah.45.24"), ("H[a]b. iii. 5", "habakkuk.3.5"),
        ("Luke xiii, 16", "luke.13.16"), ("II Cor. 3. 4-6", "2-corinthians.3.4"), ("Rom. v. 10 – 12", "romans.5.10"), ("Gen 1 2 x", None), ("Methodist Hymn Book, lx. 5", None), ("Gen. 5", None), (None, None), ("Gen. 1000. 2", None),
    ],
)
def test_free_citations(text, want):
    assert references.parse_citation(text) == want


@pytest.mark.parametrize(
    ("text", "printed", "left"),
    [
        ("cf. Rom. v. 10. as bee eh", ["Rom. v. 10"], "cf.   as bee eh"), ("(Rom. ii. 4) shen (myr shen)", ["Rom. ii. 4"], "  shen (myr shen)"),
        ("2 Sam. xxiv. 4 as Job xxxix, 19", ["2 Sam. xxiv. 4", "Job xxxix, 19"], "  as  "), ("Ps. 45, 12; Ps. 45, 12", ["Ps. 45, 12"], " ;  "),
        ("Hymn 5. 6 is not", [], "Hymn 5. 6 is not"), ("xRom. v. 10", [], "xRom. v. 10"), ("Éx. 3. 4", [], "Éx. 3. 4"), ("", [], ""), ("III Ean 1. 2-4 t'eh", ["III Ean 1. 2-4"], "  t'eh"),
    ],
)
def test_citations_in_text(text, printed, left):
    found = [text[a:b] for a, b in references.spans(text)]
    assert [c for c in dict.fromkeys(found) if references.parse_citation(c)] == printed
    assert references.without_citations(text) == left


def answers(spark, schema, cases, columns):
    """What the columns give for each case's row, in order."""
    frame = spark.createDataFrame([(k, *case) for k, case in enumerate(cases)], "k int, " + schema)
    return [tuple(r)[1:] for r in frame.select("k", *columns).orderBy("k").collect()]


def test_speakers_by_the_codes_of_each_row(spark):
    cases = [
    ("[SATAN] ta mee", ["S", "satan"], None, ("SATAN", "ta mee")), ("q. hello", ["Q"], "", ("Q", "hello")), ("Quirk is here", ["Q"], None, (None, "Quirk is here")), ("QA: x", ["Q", "QA"], None, ("QA", "x")),
    ("Q", ["Q"], "Old", ("Old", "")), ("  Q  hi", [" Q "], None, ("Q", "hi")), (None, ["Q"], None, (None, None)), ("x", [], None, (None, "x")), ("Q.: a", ["Q"], None, ("Q", ": a")),
    ]
    columns = prepare.speaker(F.col("text"), F.col("codes"), F.col("present"))
    assert answers(spark, "text string, codes array<string>, present string", [c[:3] for c in cases], columns) == [c[3] for c in cases]


def test_inline_references_by_the_formats_of_each_row(spark):
    cases = [
    ("[MS 1 Thessalonians 2.16] Ta", ["bracketed-citation"], ("MS 1 Thessalonians 2.16", "Ta")), ("[3] Ta", ["bracketed-number"], ("3", "Ta")), ("[x3] Ta", ["bracketed-number"], (None, "[x3] Ta")),
    ("19 ¶ Then", ["leading-number"], ("19", "Then")), ("8.  Then", ["leading-number"], ("8", "Then")), ("8th of", ["leading-number"], (None, "8th of")), ("12 ", ["leading-number"], (None, "12 ")),
    ("Beatus vir qui non abiit. psal. 1.", ["incipit-psalm-heading"], ("Beatus vir qui non abiit. psal. 1", "")), ("Psal. 1. Beatus vir, qui non abiit.", ["incipit-psalm-heading"], ("Psal. 1. Beatus vir, qui non abiit", "")),
    ("psal. 1", ["incipit-psalm-heading"], (None, "psal. 1")), ("Arrane Solomon:2:3. Ta", ["colon-verse"], ("Arrane Solomon:2:3", "Ta")), (":1:1 x", ["colon-verse"], (None, ":1:1 x")),
    (" CAB. II. ", ["heading-line"], ("CAB. II.", "")), ("Psalm 23", ["heading-line"], ("Psalm 23", "")), ("Psalm one", ["heading-line"], (None, "Psalm one")),
    ("[3] Ta", ["unknown", " bracketed-number", "bracketed-citation"], ("3", "Ta")), (None, ["colon-verse"], (None, None)), ("x", [], (None, "x")),
    ]
    columns = prepare.inline_reference(F.col("text"), F.col("formats"))
    assert answers(spark, "text string, formats array<string>", [c[:2] for c in cases], columns) == [c[2] for c in cases]


def test_inline_references_leave_the_english_side_too(spark):
    columns = prepare.inline_reference(F.col("text"), ["leading-number"], F.col("own"), F.col("english"))
    cases = [("19 ¶ Eisht", " 7 ", "19 ¶ Then Joseph"), ("19 Eisht", "", "Then Joseph")]
    assert answers(spark, "text string, own string, english string", cases, columns) == [("7", "Eisht", "Then Joseph"), ("19", "Eisht", "Then Joseph")]


def test_words_that_count(spark):
    cases = [("ta [laughs] mee", ["Laughs"], "ta   mee"), ("(laughs) x", ["laughs"], None), ("ta [sic: shoh] (sic) mee", [], "ta     mee"), ("[sick man]", [], None), ("plain", [], None), (None, [], None), ("(Rom. ii. 4) x", None, "  x")]
    assert answers(spark, "text string, events array<string>", [c[:2] for c in cases], [prepare.stats_text(F.col("text"), F.col("events"))]) == [(c[2],) for c in cases]


def test_canonical_keys(spark):
    keys = ["genesis.1.2", "psalms.23", "nobook.1.2", "genesis.0.1", "genesis.1.0", "genesis", "genesis.1.2.3", "genesis.x.1", None, ""]
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(keys)], "k int, c string").select("k", references.parse_key(F.col("c")).alias("p"))
    back = frame.select("k", "p", references.format_key(F.col("p.book"), F.col("p.chapter"), F.col("p.verse")).alias("key")).orderBy("k").collect()
    assert [r.key for r in back] == ["genesis.1.2", "psalms.23"] + [None] * 8
    assert tuple(back[0].p) == ("genesis", 1, 2) and back[1].p.verse is None


def test_references_in_order(spark):
    refs = ["CAB. II.", "3", "Psalm cl", "4", "Mian:1:1", "5", "Beatus vir. psal. 7", "1", "Psal. 9. Confitebor", "2", "chapter xx", "6", "Hymn 54", "cabdil iiix.", "Rom. v. 10", "8", " ", None]
    lines = spark.createDataFrame([("d", k, r) for k, r in enumerate(refs)], "ident string, line_no int, reference string")
    got = [r.canonical_reference for r in prepare.resolve_references(lines, F.lit("genesis")).orderBy("line_no").collect()]
    assert got == ["genesis.2", "genesis.2.3", "psalms.150", "psalms.150.4", "matthew.1.1", "psalms.150.5", "psalms.7", "psalms.7.1", "psalms.9", "psalms.9.2", "psalms.20", "psalms.20.6", None, "psalms.7", "romans.5.10", "psalms.7.8", None, None]
