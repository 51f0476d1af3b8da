"""Golden cases of the query language and of line preparation."""

import datetime as dt

import pytest
from concord.functions import dates, references, similarity
from concord.operators import prepare, query, search
from pyspark.sql import functions as F


def counts(spark, texts, text, options=query.Options()):
    rows = [("d", k, t, None, None) for k, t in enumerate(texts, 1)]
    lines = spark.createDataFrame(rows, "ident string, line_no int, text string, date_start date, date_end date")
    return tuple(search.totals(search.scan(lines, text, options)).first())[:2]


FIVE = ["hi", "hi world", "world hi", "hi not world", "worl"]
WILD = ["san andreas", "saan andreas", "sn", "sa n an"]


@pytest.mark.parametrize(
    ("texts", "text", "options", "want"),
    [
        (["hello world"], "hello", {}, (1, 1)), (["hello hello hello"], "hello", {}, (3, 1)),
        (["hi", "hi world", "world hi", "hi not world", "hi world hi world"], "hi world", {}, (3, 2)),
        (FIVE, "hi or world", {}, (7, 4)), (FIVE, "hi and world", {}, (3, 3)), (FIVE, "(hi) and (world)", {}, (3, 3)),
        (["hi", "hi world", "world hi", "hi note world", "hid"], "hi not world", {}, (1, 1)),
        (["facade", "façade"], "facade", {}, (2, 2)), (["facade", "façade"], "façade", {"normalize_diacritics": False}, (1, 1)),
        (["hello", "Hello"], "Hello", {"case_sensitive": True}, (1, 1)), (["Çhengey", "çhengey"], "Chengey", {"case_sensitive": True}, (1, 1)),
        (WILD, "s*n", {}, (3, 3)), (WILD, "s_n", {}, (1, 1)), (WILD, "s+n", {}, (2, 2)),
        (["currit da jee"], "jee,", {}, (1, 1)), (["erbee", "erbee?"], "erbee", {}, (2, 2)), (["da cre-erbee"], "cre", {}, (1, 1)),
        (["lhiam-lhiat", "lhiam lhiat", "lhiamlhiat"], "lhiam-lhiat", {"ignore_hyphens": True}, (3, 3)),
        (["Ta'n ennym orrym David"], "orrym", {}, (1, 1)),
    ],
)
def test_golden_counts(spark, texts, text, options, want):
    assert counts(spark, texts, text, query.Options(**options)) == want


def test_queries_are_checked():
    for bad in ("", "  ", "x" * 101):
        with pytest.raises(ValueError):
            query.parse(bad)
    assert isinstance(query.parse("a and b or c")[0].right, query.Binary)
    assert query.parse("a and")[1].ignore_hyphens


@pytest.mark.parametrize(
    ("note", "want"),
    [("[M.H., 03/12/1863]", dt.date(1863, 12, 3)), ("23/051868", dt.date(1868, 5, 23)), ("Sep 21, 1901.", dt.date(1901, 9, 21)), ("31st October 1912", dt.date(1912, 10, 31)), ("London. 1794.", dt.date(1794, 1, 1)), ("31/02/1880", dt.date(1880, 1, 1)), ("In the 1904 reprint this changed", None), (None, None)],
)
def test_note_dates(note, want):
    assert dates.note_date(note) == want


def test_references_in_order(spark):
    refs = ["CAB. II.", "3", "Psalm cl", "4", "Mian:1:1", "5", "Hymn 54", "H[a]b. iii. 5", None]
    lines = spark.createDataFrame([("d", k, r) for k, r in enumerate(refs)], "ident string, line_no int, reference string")
    got = [r.canonical_reference for r in prepare.resolve_references(lines, F.lit("genesis")).orderBy("line_no").collect()]
    assert got == ["genesis.2", "genesis.2.3", "psalms.150", "psalms.150.4", "matthew.1.1", "psalms.150.5", None, "habakkuk.3.5", None]
    assert references.roman("mcmxc") == 1990 and references.roman("iiii") == 4 and references.roman("abc") is None


def test_swaps_are_one_edit():
    assert similarity.osa("ab", "ba", 2) == 1 and similarity.osa("kitten", "sitting", 2) == 3


def test_highlights_and_kwic(spark):
    lines = spark.createDataFrame([("d", 1, "One (two) three, Two four", None, None)], "ident string, line_no int, text string, date_start date, date_end date")
    marked = search.highlights(lines, "two")
    assert [(r.start, r.end) for r in marked.first().highlights] == [(5, 8), (17, 20)]
    assert search.kwic(marked).first().match == "two"
