"""Visible text of web pages, laid out as a reader sees it.

A tree builder with implied end tags makes elements of the markup; visibility
rules, as they apply on a wide screen, take out what is not shown (selectors of
tags, classes, ids and attributes, inside one another or not; states such as
``:hover`` never apply); a layout pass keeps blocks apart, indents and marks
list items, keeps preformatted text, and aligns the cells of tables, spanning
ones included.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element classes of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("head title script style template noscript datalist iframe canvas audio video".split())
#: Parts of drawings and formulas that are not shown where they stand.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav aside main address form details summary dialog legend figcaption hgroup li dt dd tr td th thead tbody tfoot caption center hr".split())
#: Open elements that a start tag ends, unless one of the last group lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("head title meta link script style base noscript template html".split())
SCOPES = frozenset("table td th caption button object".split())
#: Deeper elements become children of the element at this depth; their text stays.
DEPTH = 256

TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What a style sheet's structure does not lie in: comments, strings.
QUIET = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"\n]*\"|'[^'\n]*'|<!--|-->", re.S)
PART = re.compile(r"[^{};]*[{};]|[^{};]+")
#: The screen that media rules are held against.
SCREEN = {"width": 1280.0, "height": 800.0}
FEATURE = re.compile(r"(?:(min|max)-)?(?:device-)?(width|height)\s*(:|[<>]=?)\s*(\d*\.?\d+)\s*(px|em|rem|)")
HELD = re.compile(r"color|hover|any-hover|pointer|(?:any-)?hover\s*:\s*hover|(?:any-)?pointer\s*:\s*fine|orientation\s*:\s*landscape|prefers-color-scheme\s*:\s*light|prefers-[\w-]+\s*:\s*no-preference|scripting\s*:\s*enabled")
#: A selector's parts: what joins it to the part before, and the tests of one element.
STEP = re.compile(r"\s*([\s>])\s*")
TEST = re.compile(r"(\*|[a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")
#: Fixed value: the most blanks that move a cell to its column, about the width of the screen.
GAP = 160
#: The most columns and rows that a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
HIDES = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Element | None = None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent

    def get(self, name: str) -> str | None:
        """Value of an attribute; an attribute without a value is empty."""
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(source: str) -> tuple[Element, list[str]]:
    """The tree, and the style sheets found."""
    root = Element("html")
    stack, sheets, at = [root], [], 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        text = m[0]
        if text[0] != "<" or text == "<":
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        closing, tag = (m[1], m[2]) if m[2] else (m[4], m[5])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            # an end tag reaches up to the nearest scope only
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "html":
            continue
        ended, within = ENDS.get(tag, ({"p"} if tag in BLOCKS else set(), SCOPES))
        if tag in BLOCKS:
            _end(stack, {"p"}, SCOPES)
        _end(stack, ended, within)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        element = Element(tag, m[3] or m[6] or "", stack[-1])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            body = source[at : end.start() if end else len(source)]
            if tag == "style":
                if media_holds(element.get("media") or ""):
                    sheets.append(body)
            elif tag in ("textarea", "title"):
                element.children.append(html.unescape(body))
            at = (source.find(">", end.start()) + 1 or len(source)) if end else len(source)
        elif tag not in VOID and not (m[0].endswith("/>") and (tag in ("svg", "math") or any(e.tag in ("svg", "math") for e in stack))) and len(stack) < DEPTH:
            stack.append(element)
    return root, sheets


def _end(stack: list[Element], tags: set[str], within: set[str]) -> None:
    """Close the highest of the named open elements above the nearest boundary."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in within:
            return
        if stack[k].tag in tags:
            del stack[k:]
            if not {"tr", "td", "th"} & tags:
                return


def media_holds(queries: str) -> bool:
    """Whether a media list holds on a wide screen; features that are not known do not."""

    def feature(text: str) -> bool:
        m = FEATURE.fullmatch(text)
        if not m:
            return bool(HELD.fullmatch(text))
        value, own = float(m[4]) * (16 if m[5] in ("em", "rem") else 1), SCREEN[m[2]]
        if m[3] == ":":
            return own >= value if m[1] == "min" else own <= value if m[1] == "max" else own == value
        return {"<": own < value, "<=": own <= value, ">": own > value, ">=": own >= value}[m[3]]

    def holds(query: str) -> bool:
        negated = query.startswith("not ")
        parts = [x.strip() for x in re.split(r"\sand\s", " " + re.sub(r"^(?:not|only)\s", "", query))]
        return negated != all(feature(x.strip("() ")) if x.startswith("(") else x in ("all", "screen") for x in parts)

    each = [q.strip() for q in queries.lower().split(",") if q.strip()]
    return not each or any(map(holds, each))


def rules(sheet: str):
    """``(selectors, declarations)`` of the rules that apply on a wide screen, in order."""
    stack: list[tuple[bool, str]] = [(True, "")]
    for m in PART.finditer(QUIET.sub(lambda m: m[0] if m[0][0] in "\"'" and not set(m[0]) & set("{};,") else " ", sheet)):
        end, body = m[0][-1], m[0].rstrip("{};").strip()
        applies, selectors = stack[-1]
        if end == "{":
            name, _, what = body.partition(" ") if not body.lower().startswith("@media(") else ("@media", "", body[6:])
            if not body.startswith("@"):
                stack.append((applies and not selectors, body))  # rules within rules are not simple
            else:
                name = name.lower()
                kept = media_holds(what) if name == "@media" else name == "@layer" or (name == "@supports" and not what.lower().startswith("not"))
                stack.append((applies and kept, selectors))
            continue
        if body and applies and selectors:
            yield selectors, body
        if end == "}" and len(stack) > 1:
            stack.pop()


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def selector(text: str) -> tuple[list[tuple[str, list[tuple]]], tuple[int, int, int]] | None:
    """``(joiner, tests)`` of the elements from the last to the first, and the weight; None for what never applies or is not known."""
    parts, joiners, at = [], [], 0
    for m in [*STEP.finditer(text), None]:
        parts.append(text[at : m.start() if m else len(text)])
        if m:
            joiners.append(m[1].strip())
            at = m.end()
    steps, weight = [], [0, 0, 0]
    for part, joiner in zip(parts, [*joiners, ""], strict=True):
        tests, at = [], 0
        while at < len(part):
            m = TEST.match(part, at)
            if not m or (m[1] and at):
                return None
            at = m.end()
            kind = "tag" if m[1] else "class" if m[2] else "id" if m[3] else "attribute"
            tests.append((kind, (m[1] or "").lower() or m[2] or m[3] or m[4].lower(), m[5]))
            weight[0] += kind == "id"
            weight[1] += kind in ("class", "attribute")
            weight[2] += kind == "tag" and m[1] != "*"
        if not tests:
            return None
        steps.append((joiner, tests))
    return steps[::-1], tuple(weight)


def fits(e: Element, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.tag)
        elif kind == "class":
            ok = name in (e.get("class") or "").split()
        elif kind == "id":
            ok = e.get("id") == name
        else:
            own = e.get(name)
            ok = own is not None and (value is None or own == value)
        if not ok:
            return False
    return True


def selected(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    """Whether the steps, the last first, lead up from the element."""
    if not fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    above, direct = e.parent, steps[1][0] == ">"
    while above is not None:
        if selected(above, steps[1:]):
            return True
        above = None if direct else above.parent
    return False


def display_rules(sheets: list[str]) -> dict[tuple[str, str], list[tuple]]:
    """By a test of the element, ``(steps, property, (important, weight, order, hides))`` of the rules that show or hide it."""
    found: dict[tuple[str, str], list[tuple]] = {}
    order, hiding = 0, False
    for sheet in sheets:
        for selectors, body in rules(sheet):
            for m in DECLARED.finditer(body):
                order += 1
                name, value = m[1].lower(), m[2].lower()
                hides = value == "none" if name == "display" else value in ("hidden", "collapse")
                for known in filter(None, map(selector, map(str.strip, selectors.split(",")))):
                    steps, weight = known
                    tests = steps[0][1]
                    key = next((t[:2] for kind in ("id", "class", "tag") for t in tests if t[0] == kind), ("tag", "*"))
                    found.setdefault(key, []).append((steps, name, (bool(m[3]), weight, order, hides)))
                    hiding |= hides
    return found if hiding else {}


class Layout:
    def __init__(self, styles: dict[tuple[str, str], list[tuple]]):
        self.styles = styles

    def shown(self, e: Element) -> bool:
        if e.tag in UNSHOWN:
            return False
        if e.attributes:
            if e.get("hidden") is not None or (e.tag == "input" and e.get("type") == "hidden"):
                return False
            style = e.get("style")
            if style and HIDES.search(style):
                return False
        else:
            style = None
        won: dict[str, tuple] = {}
        if self.styles:
            keys = [("tag", "*"), ("tag", e.tag), *(("class", c) for c in dict.fromkeys((e.get("class") or "").split())), ("id", e.get("id") or "")]
            for key in keys:
                for steps, name, rule in self.styles.get(key, ()):
                    if won.get(name, (False,)) < rule and selected(e, steps):
                        won[name] = rule
        # an element's own style is stronger than rules, but for important ones
        inline = {m[1].lower() for m in DECLARED.finditer(style)} if style else set()
        if any(rule[3] and (rule[0] or k not in inline) for k, rule in won.items()):
            return False
        return e.tag != "dialog" or e.get("open") is not None or "display" in inline or "display" in won

    def lines(self, node: Element, pre: bool = False) -> list[str]:
        out: list[str] = []
        inline: list[str] = []

        def flush() -> None:
            if inline:
                text = "".join(inline)
                inline.clear()
                if pre:
                    out.extend(line.rstrip() for line in text.replace("\0", "\n").expandtabs().strip("\n").split("\n"))
                else:
                    parts = [SPACES.sub(" ", x).strip(" ") for x in text.split("\0")]
                    out.extend(parts if len(parts) > 1 and any(parts) else [x for x in parts if x])

        def gap() -> None:
            if out and out[-1]:
                out.append("")

        def foreign(parent: Element, text: bool) -> None:
            """Text of a formula, or of a drawing's text elements."""
            for child in parent.children:
                if isinstance(child, str):
                    if text:
                        inline.append(child)
                elif child.tag == "foreignobject":
                    walk(child.children)
                elif child.tag not in UNDRAWN and self.shown(child):
                    apart = " " if child.tag == "text" else ""
                    inline.append(apart)
                    foreign(child, text or child.tag == "text")
                    inline.append(apart)

        def walk(children: list) -> None:
            number = None
            for child in children:
                if isinstance(child, str):
                    inline.append(child)
                    continue
                tag = child.tag
                if not self.shown(child):
                    continue
                if tag == "br":
                    inline.append("\0")
                elif tag == "img":
                    inline.append(child.get("alt") or "")
                elif tag == "input":
                    inline.append(child.get("value") or "" if child.get("type") in ("submit", "button", "reset") else "")
                elif tag == "hr":
                    flush()
                    out.append("---")
                elif tag == "li":
                    flush()
                    ordered = node.tag == "ol"
                    start = child.get("value") or (node.get("start") if number is None else None) or ""
                    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else (number or 0) + 1
                    mark = f"{number}. " if ordered else "- "
                    own = self.lines(child) or [""]
                    out.extend((mark if not k else " " * len(mark)) + line if line or not k else "" for k, line in enumerate(own))
                elif tag == "dd":
                    flush()
                    out.extend("    " + line if line else "" for line in self.lines(child))
                elif tag == "blockquote":
                    flush()
                    gap()
                    out.extend("> " + line if line else ">" for line in self.lines(child))
                    gap()
                elif tag == "table":
                    flush()
                    gap()
                    out.extend(self.table(child))
                    gap()
                elif tag in ("svg", "math"):
                    foreign(child, tag == "math")
                elif tag == "select":
                    inline.append("\0".join(self.choices(child)))
                elif tag == "q":
                    inline.append("“")
                    walk(child.children)
                    inline.append("”")
                elif tag in BLOCKS:
                    flush()
                    nested = tag in ("ul", "ol") and node.tag == "li"
                    if tag in SPACED and not nested:
                        gap()
                    out.extend(self.lines(child, pre or tag == "pre"))
                    if tag in SPACED and not nested:
                        gap()
                else:
                    walk(child.children)

        walk(node.children)
        flush()
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        return out

    def choices(self, node: Element) -> list[str]:
        """Options that a select shows: all of a list box, otherwise the selected one or the first."""
        found: list[tuple[str, Element]] = []

        def text(e: Element) -> str:
            return "".join(x if isinstance(x, str) else "" if x.tag in ("option", "optgroup") else text(x) for x in e.children)

        def gather(e: Element) -> None:
            for x in e.children:
                if isinstance(x, str) or not self.shown(x):
                    continue
                if x.tag == "option":
                    found.append((SPACES.sub(" ", x.get("label") or text(x)).strip(" "), x))
                elif x.tag == "optgroup" and x.get("label"):
                    found.append((x.get("label") or "", x))
                gather(x)

        gather(node)
        size = node.get("size") or ""
        if node.get("multiple") is not None or (size.isdecimal() and int(size) > 1):
            return [t for t, _ in found]
        options = [(t, x) for t, x in found if x.tag == "option"]
        chosen = [t for t, x in options if x.get("selected") is not None][-1:] or [t for t, x in options if x.get("disabled") is None][:1]
        return chosen

    def table(self, node: Element) -> list[str]:
        """Rows with their cells padded to the widest of each column.

        A cell that spans columns or rows takes its place in all of them, its
        text stands in the first.  A cell more than ``GAP`` blanks away from
        the one before it is not moved to its column, it follows after a bar.
        """
        before: list[str] = []
        groups: list[list[list[tuple[list[str], int, int]]]] = []
        feet: list[list[list[tuple[list[str], int, int]]]] = []

        def span(cell: Element, name: str, most: int) -> int:
            value = cell.get(name) or ""
            return min(max(1, int(value)), most) if re.fullmatch(r"[0-9]{1,6}", value) else 1

        def gather(parent: Element, into: list) -> None:
            rows: list[list[tuple[list[str], int, int]]] = []
            into.append(rows)
            loose = None
            for child in parent.children:
                if isinstance(child, str):
                    if child.strip():
                        before.append(SPACES.sub(" ", child).strip(" "))
                elif not self.shown(child):
                    continue
                elif child.tag in ("thead", "tbody", "tfoot"):
                    gather(child, feet if child.tag == "tfoot" else into)
                    loose, rows = None, []
                    into.append(rows)
                elif child.tag in ("tr", "td", "th"):
                    if child.tag == "tr" or loose is None:
                        loose = []
                        rows.append(loose)
                    for cell in child.children if child.tag == "tr" else [child]:
                        if isinstance(cell, str):
                            if cell.strip():
                                loose.append(([SPACES.sub(" ", cell).strip(" ")], 1, 1))
                        elif self.shown(cell):
                            loose.append((self.lines(cell), span(cell, "colspan", MOST_COLUMNS), span(cell, "rowspan", MOST_ROWS)))
                    if child.tag == "tr":
                        loose = None
                else:
                    before.extend(self.lines(child))

        gather(node, groups)
        own = [g for g in groups + feet if g]
        return before + aligned(own)


def aligned(groups: list[list[list[tuple[list[str], int, int]]]]) -> list[str]:
    """Lines of the rows of ``(lines, columns, rows)`` cells; spans over rows end with their group."""
    placed: list[list[tuple[int, list[str], int]]] = []
    starts: set[int] = set()
    for group in groups:
        taken: dict[int, int] = {}  # columns that cells of earlier rows take, and for how many rows yet
        for cells in group:
            row, column, ahead = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
            for lines, columns, rows in cells:
                while column in taken:
                    column += 1
                row.append((column, lines, columns))
                starts.add(column)
                if rows > 1:
                    ahead.update((c, rows - 1) for c in range(column, column + columns))
                column += columns
            placed.append(row)
            taken = ahead
    # columns in which no cell begins are no columns of their own
    number = {c: k for k, c in enumerate(sorted(starts))}
    widths = [0] * len(number)
    for row in placed:
        for column, lines, _ in row:
            widths[number[column]] = max(widths[number[column]], max(map(display_width, lines), default=0))
    upto = [0]
    for width in widths:
        upto.append(upto[-1] + width + 3)
    height = [max((len(lines) for _, lines, _ in row), default=0) for row in placed]
    out: list[str] = []
    for row, h in zip(placed, height, strict=True):
        for y in range(h):
            line, at = "", 0
            for column, lines, _ in row:
                if y and y >= len(lines):
                    continue
                if column:
                    # empty columns lie between where a cell from above, or nothing, stands
                    gap = upto[number[column]] - 3 - at
                    gap = gap if gap <= GAP else 0
                    line += " " * gap + " | "
                    at += gap + 3
                cell = lines[y] if lines else ""
                line, at = line + cell, at + display_width(cell)
            out.append(line.rstrip())
    return out


def display_width(text: str) -> int:
    """Columns of a fixed-width screen: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def visible_text(source: str | None) -> str:
    """All visible text of a page, with its layout; empty for null or empty markup."""
    if not source:
        return ""
    root, sheets = parse(source.replace("\0", "�"))
    return "\n".join(Layout(display_rules(sheets)).lines(root))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id_col, text, n_lines)`` for every row, repeated ones and those with null ids too.

    Null or empty markup gives an empty text of 0 lines; broken markup is
    mended as browsers do, never an error.  Very long pages are read whole, and
    their text is longer by at most ``GAP`` blanks and a bar for each line of a
    cell.  Other columns, whatever their names, are neither
    read nor returned; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = [visible_text(x) for x in part.column(1).to_pylist()]
                lines = [t.count("\n") + 1 if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=[id_col, "text", "n_lines"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, n_lines long")
