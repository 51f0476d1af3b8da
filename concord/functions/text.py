"""Text analysis as Column expressions: normalising, tokens, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token characters, apostrophe variants, and letters with their plain forms.
TOKEN = r"[\p{L}\p{Nd}\p{Mn}'‘’‛′?-]+"
APOSTROPHES = "‘’‛′"
PLAIN = {
    "á": "a", "â": "a", "ǎ": "a", "à": "a", "é": "e", "ê": "e", "ě": "e", "ë": "e", "è": "e", "í": "i", "ï": "i", "ì": "i", "ǐ": "i", "î": "i",
    "ó": "o", "ø": "o", "ö": "o", "ô": "o", "ò": "o", "ǒ": "o", "ú": "u", "û": "u", "ǔ": "u", "ù": "u", "ẃ": "w", "ẁ": "w", "ŵ": "w",
    "ý": "y", "ỳ": "y", "ŷ": "y", "ç": "c", "ŕ": "r", "ĵ": "j", "ğ": "g", "æ": "ae", "œ": "oe", "ﬆ": "st",
}


def normalize(c: Column, lang: str = "gv", keep_question: bool | None = None, keep_case: bool = False) -> Column:
    """Marks and line ends to spaces, quotes folded, brackets dropped, lower case, trimmed."""
    keep = lang == "gv" if keep_question is None else keep_question
    c = F.regexp_replace(c, r"[,.;!\s]" if keep else r"[,.;!?\s]", " ")
    c = F.translate(F.replace(c, F.lit("…"), F.lit("...")), "“”‘’‛′–—‑", "\"\"''''---")
    c = F.translate(c, '()":' if lang == "gv" else '()"', "")
    return F.trim(c if keep_case else F.lower(c))


def raw_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.translate(t, APOSTROPHES, "''''"))


def filtered(t: Column) -> Column:
    """A single closing question mark goes; emptied tokens stay, to keep their position."""
    return F.when(t.endswith("?") & ~t.endswith("??") & ~t.rlike(r"^\?+$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def tokens(c: Column, lang: str = "gv", keep_case: bool = False) -> Column:
    """Tokens by position, index and position being one."""
    return F.transform(raw_tokens(normalize(c, lang, True, keep_case)), filtered)


def is_word(t: Column) -> Column:
    return ~t.rlike(r"^([0-9]+|[?]*)$")


def stats_tokens(c: Column, lang: str = "gv") -> Column:
    return F.filter(tokens(c, lang), is_word)


def reference_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def form_key(c: Column) -> Column:
    """Lemma key: lower case, no accents, hyphens and spaces as one space, edges trimmed."""
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžǎǐǒǔẁẃỳ"
    plain = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzaiouwwy"
    c = F.regexp_replace(F.translate(F.lower(c), "‑’" + marked, "-'" + plain), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(c, r"[-\s]+", " "), F.lit(" .,;:'"))


def collation_key(c: Column) -> Column:
    return F.translate(F.lower(c), "ç-'’ ", "c")


def line_key(toks: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the tokens, joined by spaces."""
    return F.left(F.sha2(F.array_join(toks, " "), 256), F.lit(16))


def evidence_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    both = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.array(w, F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(both))


def html_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(c)


def is_affix(c: Column) -> Column:
    return c.rlike("^[-‑]|[-‑]$")


def affix_query(word: str) -> str:
    """``aa-`` asks for ``aa-*``, ``-ys`` for ``*-ys``."""
    if word[-1:] in ("-", "‑"):
        return word[:-1] + "-*"
    return "*-" + word[1:] if word[:1] in ("-", "‑") else word


def clitics(t: Column) -> Column:
    """The parts of a contracted form; an empty array where there are none."""
    head = F.substring(t, 3, 10_000)
    return (
        F.when(F.length(t) <= 2, F.array().cast("array<string>"))
        .when(t.startswith("t'"), F.array(F.lit("ta"), head))
        .when(t.startswith("v'"), F.array(F.lit("va"), head))
        .when(t.endswith("'n"), F.array(F.substring(t, F.lit(1), F.length(t) - 2), F.lit("yn")))
        .otherwise(F.array().cast("array<string>"))
    )


def trim_context(context: Column, selection: Column, radius: int = 2000) -> Column:
    at = F.instr(F.lower(context), F.lower(selection))
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at == 0, F.substring(context, 1, 2 * radius)).otherwise(F.substring(context, start, at + F.length(selection) + radius - start))


def gloss_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", ""))
