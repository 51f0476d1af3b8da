import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, component string"

WORDS = "the of and reon thly ander onst bleing tion whou era nting sh reea edly".split()


def sentence(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * i * (k % 5 + 1) + i) % len(WORDS)] + ("s" * (k * i % 3)) for i in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    base = [(k, sentence(k, 30 + k % 17) + "\nShared line, see below.\n" + sentence(k + 3, 20), "en" if k % 2 else None, f"s{k % 3}") for k in range(24)]
    base += [(100 + k, sentence(5, 60 + k // 40), "en", "s0") for k in range(12)]
    base += [(None, "no id here", "en", "s1"), (None, "no id here", "en", "s1"), (200, None, "en", "s2"), (201, "", None, None), (202, " \n\t", "de", None)]
    base += [(203, "ein Wort und noch eins " * 2000, "de", "s2"), (204, "x" * 5000, "de", "s1"), (205, "?! 123\n\n", "de", "s1")]
    base += [(206, "Zwei  Räume <|endoftext|> don't we'll go é", "de", "s1"), (206, "Zwei  Räume <|endoftext|> don't we'll go é", "de", "s1"), (3, "same id, other text", "en", "s0")]
    base += [(207, "日" * 17 + ". und " + "Donaudampfschifffahrtselektrizitätenhauptbetriebswerk" * 2 + ", " + "x" * 60 + "!", "de", "s2")]
    return [(i, t, lang, s, len(t) if t else None, "a", "b", "c") for i, t, lang, s in base]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
