"""The query language, and its compilation to Columns over a line's tokens.

Tokens are words; ``and``, ``or`` and ``not`` between spaces are operators of
equal precedence, grouping from the right; brackets group.  A node compiles to
an array of spans ``(s, e)``: positions of the line's token array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.text import PLAIN

OPERATORS = ("and", "or", "not")
#: Parts beyond which only the fully split and the fully joined forms are tried.
MOST_PARTS = 5
SPANS = "array<struct<s:int,e:int>>"


@dataclass(frozen=True)
class Options:
    normalize_diacritics: bool = True
    ignore_hyphens: bool = False
    case_sensitive: bool = False
    lang: str = "gv"
    most_characters: int = 100
    #: ``near`` counts the merged starts of both sides; ``line`` counts a line once
    and_counts: str = "near"


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Parser:
    parts: list[str]
    at: int = field(default=0)

    def expression(self):
        left = self.operand()
        if self.at < len(self.parts) and self.parts[self.at] in OPERATORS:
            op = self.parts[self.at]
            self.at += 1
            return Binary(op, left, self.expression())
        return left

    def operand(self):
        if self.at < len(self.parts) and self.parts[self.at] == "(":
            self.at += 1
            inner = self.expression()
            if self.at >= len(self.parts) or self.parts[self.at] != ")":
                raise ValueError("a bracket is open")
            self.at += 1
            return inner
        words = []
        while self.at < len(self.parts) and self.parts[self.at] not in (*OPERATORS, "(", ")"):
            words.append(self.parts[self.at])
            self.at += 1
        if not words:
            raise ValueError("a word is missing")
        return Term(words[0]) if len(words) == 1 else Phrase(tuple(words))


def validate(query: str | None, options: Options) -> str:
    if not query or not query.strip():
        raise ValueError("the query is blank")
    if len(query) > options.most_characters:
        raise ValueError(f"the query has more than {options.most_characters} characters")
    return query


def parse(query: str, options: Options = Options()):
    """The query's tree; what cannot be parsed is one literal term that ignores hyphens."""
    validate(query, options)
    parser = Parser(re.findall(r"[()]|[^\s()]+", query))
    try:
        tree = parser.expression()
        if parser.at < len(parser.parts):
            raise ValueError("something follows the query")
        return tree, options
    except ValueError:
        return Phrase(tuple(re.findall(r"[\w'’*+-]+", query)) or (query,)), replace(options, ignore_hyphens=True)


def normal_word(word: str, options: Options) -> str:
    """A word of the query as the index has it."""
    word = re.sub(r"[,.;!\s]", " ", word).translate(str.maketrans("“”‘’‛′–—‑", "\"\"''''---"))
    word = re.sub(r'[()":]' if options.lang == "gv" else r'[()"]', "", word)
    word = word.strip() if options.case_sensitive else word.strip().lower()
    return word[:-1] if word.endswith("?") and not word.endswith("??") and word.strip("?") else word


def letter_class(c: str) -> str:
    """A letter, its plain form if it is marked, else all marked forms of it."""
    small = c.lower()
    if small in PLAIN:
        found = [PLAIN[small]]
    else:
        found = [k for k, v in PLAIN.items() if v == small]
    if c != small:
        found = [f.upper() for f in found]
    forms = [re.escape(f) for f in dict.fromkeys([c, *found])]
    return forms[0] if len(forms) == 1 else "(?:" + "|".join(forms) + ")"


def term_pattern(word: str, options: Options) -> str:
    """A whole token's pattern: ``*`` any, ``+`` some, ``_`` one character."""
    wild, out = {"*": ".*", "+": ".+", "_": "."}, []
    if options.ignore_hyphens:
        word = word.replace("-", "")
    for c in word:
        out.append(wild.get(c) or (letter_class(c) if options.normalize_diacritics else re.escape(c)))
    body = ("-*" if options.ignore_hyphens else "").join(out)
    tail = r"\?*(?:-.*)?" if options.normalize_diacritics else ""
    return f"^{body}{tail}$"


def is_plain(word: str, options: Options) -> bool:
    return not options.normalize_diacritics and not options.ignore_hyphens and not set(word) & set("*+_")


def groupings(parts: list[str]) -> list[tuple[str, ...]]:
    """The ways to join neighbouring parts."""
    if len(parts) > MOST_PARTS:
        return [tuple(parts), ("".join(parts),)]
    out = []
    for mask in range(1 << (len(parts) - 1)):
        words = [parts[0]]
        for k, part in enumerate(parts[1:]):
            if mask >> k & 1:
                words[-1] += part
            else:
                words.append(part)
        out.append(tuple(words))
    return out


def leaves(tree, options: Options) -> list[tuple[str, ...]]:
    """Word sequences that are searched, as the branches of the tree in order."""
    if isinstance(tree, Binary):
        return leaves(tree.left, options) + leaves(tree.right, options)
    words = [normal_word(w, options) for w in ((tree.text,) if isinstance(tree, Term) else tree.words)]
    if options.ignore_hyphens:
        parts = [p for w in words for p in re.split(r"[-\s]+", w) if p]
        return groupings(parts) if parts else []
    return [tuple(w for w in words if w)]


def _match(token: Column, word: str, options: Options) -> Column:
    return token == word if is_plain(word, options) else token.rlike(term_pattern(word, options))


def phrase_spans(toks: Column, words: tuple[str, ...], options: Options) -> Column:
    n = len(words)
    if not n:
        return F.array().cast(SPANS)

    def at(i: Column) -> Column:
        test = _match(F.get(toks, i), words[0], options)
        for k in range(1, n):
            test = test & _match(F.get(toks, i + k), words[k], options)
        return test

    starts = F.when(F.size(toks) >= n, F.filter(F.sequence(F.lit(0), F.size(toks) - n), at)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("s"), (i + n).alias("e"))).cast(SPANS)


def spans(tree, options: Options, toks: Column) -> Column:
    """All spans of the tree in a line; alternatives are not merged."""
    if not isinstance(tree, Binary):
        found = [phrase_spans(toks, words, options) for words in leaves(tree, options)]
        return found[0] if len(found) == 1 else F.concat(*found) if found else F.array().cast(SPANS)
    left, right = spans(tree.left, options, toks), spans(tree.right, options, toks)
    none = F.array().cast(SPANS)
    if tree.op == "or":
        return F.concat(left, right)
    if tree.op == "not":
        return F.when(F.size(right) == 0, left).otherwise(none)
    start = lambda x: x.s
    limit = F.least(F.array_max(F.transform(left, start)), F.array_max(F.transform(right, start)))
    both = F.array_sort(F.concat(left, right))
    met = F.when((F.size(left) > 0) & (F.size(right) > 0), F.filter(both, lambda x: x.s <= limit)).otherwise(none)
    return F.slice(met, 1, 1) if options.and_counts == "line" else met


def highlight_spans(tree, options: Options, toks: Column) -> Column:
    """Spans to mark: both sides of ``and`` and ``or``, the left side of ``not``."""
    if isinstance(tree, Binary):
        left = highlight_spans(tree.left, options, toks)
        return left if tree.op == "not" else F.concat(left, highlight_spans(tree.right, options, toks))
    return spans(tree, options, toks)


def line_filter(tree, options: Options, text: Column) -> Column | None:
    """A test on the raw text that every matching line passes, for scans to prune early."""
    if isinstance(tree, Binary):
        left, right = line_filter(tree.left, options, text), line_filter(tree.right, options, text)
        if tree.op == "not":
            return left
        if tree.op == "or":
            return left | right if left is not None and right is not None else None
        return right if left is None else left if right is None else left & right
    if options.ignore_hyphens:
        return None
    test = None
    for word in leaves(tree, options)[0]:
        runs = re.findall(r"[a-z0-9]+", word.lower()) if all(c.isascii() for c in word) else []
        for run in runs:
            body = "".join(letter_class(c) for c in run) if options.normalize_diacritics else run
            one = text.rlike(f"(?iu){body}")
            test = one if test is None else test & one
    return test
