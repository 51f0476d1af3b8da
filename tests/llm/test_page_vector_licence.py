"""HTML extraction, embedding near-duplicates and licence scans."""

import math
import re
import textwrap
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from concord.llm import embedding_dedup, html_text, licenses


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>z", "- x\n- y\n  3. p\n  4. q\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>Zoë<td>12<tr><td>中<td>3</table>", "Name | N\nZoë  | 12\n中   | 3"),
        ("<head><title>t</title><style>.no{display:none} p{color:red}</style></head><p class='x no'>gone</p><p>kept<span style='display: none'>h</span><i hidden>h</i>", "kept"),
        ("<script>var a='<p>x</p>';</script>a<!-- <p>no --><noscript>n</noscript>b", "ab"),
        ("<pre>a\n  b</pre>", "a\n  b"), ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"), ("a<hr>b", "a\n---\nb"),
        ("<p title='a>b'>x</p <b>y", "x\n\ny"), ("1 < 2 <3", "1 < 2 <3"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<b>" * 3000 + "deep", "deep"),
        ("<p>open <a href=\"x", "open <a href=\"x"),
    ],
)
def test_layout(source, text):
    assert html_text.visible_text(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<style>@media print {.x{display:none}} @media (max-width:600px){.side{display:none}}</style><p class=x>a</p><p class=side>b</p>", "a\n\nb"),
        ("<style>@media screen and (min-width:600px){.x{display:none}} .y{color:red}</style><p class=x>a</p><p class=y>b</p>", "b"),
        ("<style media=print>.x{display:none}</style><p class=x>a</p>", "a"),
        ("<style>.x{display:none} .x{display:block} #k{display:none!important} p{display:block}</style><p class=x>a</p><p id=k>b</p>", "a"),
        ("<style>p{display:none} .x{display:block}</style><p>a</p><p class=x>b</p><p style='display:block'>c</p>", "b\n\nc"),
        ("<svg><title>t</title><defs><text>d</text></defs><rect/><g><text>one</text><text>two</text></g></svg>", "one two"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>", "x=2"),
        ("<select><option>a<option selected>b</select>, <select><option>c<option>d</select>", "b, c"),
        ("<style>.x{display:none}</style><dialog>secret</dialog><dialog open>told</dialog>", "told"),
        ("<object data=x>fallback</object><video>no</video>", "fallback"),
        ("<style>div.a.b, ul > li.c, #k .d, [data-x=\"1\"]{display:none} .e:hover{display:none} .f .g>i{display:none}</style><div class='b a'>1</div><div class=a>2</div><ol><li class=c>3</ol><ul><li class=c>4</ul><p id=k><b class=d>5</b></p><p data-x=1>6</p><p class=e>7</p><p class=f><b class=g><i>8</i><u><i>9</i></u></b></p>", "2\n\n1. 3\n\n7\n\n9"),
        ("<table><tr><td rowspan=2>a<td>bb<td>c<tr><td>d<td>e<tr><td colspan=2>wide<td>f</table>", "a    | bb | c\n     | d  | e\nwide      | f"),
        ("<table><tr><td colspan=1000>h<tr><td>a<td>b</table>", "h\na | b"),
        ("<table><thead><tr><td rowspan=9>x<td>y</thead><tbody><tr><td>z</table>", "x | y\nz"),
    ],
)
def test_all_that_a_screen_shows(source, text):
    assert html_text.visible_text(source) == text


class Words(HTMLParser):
    """All text that no tag hides, blocks apart, read by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.text.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.text.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

    def handle_data(self, data):
        self.text.append("" if self.skip else data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_extract_keeps_all_words_in_order(spark, sf):
    """On tables without hidden parts: every word, in its place, and nothing else but marks of the layout."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        plain = Words()
        plain.feed(r.html)
        words = [w for w in "".join(plain.text).split() if w not in ("|", "---", "-", ">")]
        left = iter(words)
        ours = [line.strip().removeprefix("- ").removeprefix("> ") for line in got[r.page_id].split("\n")]
        mine = [w for line in ours for w in line.split() if w not in ("|", "---", "-", ">")]
        mine = [w for w in mine if not re.fullmatch(r"\d+\.", w) or w in words]
        assert [next(left, None) for _ in mine] == mine and next(left, None) is None, r.page_id


def test_rows_are_laid_out_alike_however_many_there_are():
    head, row = "<tr><td>" + "w" * 100 + "<td>c", "<tr><td>a<td>b"
    for n in (1, 3000):
        lines = html_text.visible_text(f"<table>{head}{row * n}</table>").split("\n")
        assert lines == ["w" * 100 + " | c"] + ["a" + " " * 99 + " | b"] * n


def test_padding_is_bounded():
    """One wide cell in a long table, and cells that span it all, give no more than some times the page."""
    wide = "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "w" * 20_000 + "<td>c</table>"
    spans = "<table><tr>" + "<td rowspan=5000>x" * 2000 + "<tr><td>y" * 2000 + "</table>"
    for page in (wide, spans):
        text = html_text.visible_text(page)
        assert len(text) <= 10 * len(page) + 30_000
        assert Counter(re.findall("[a-z]", text)) == Counter(re.findall("[a-z]", re.sub("<[^>]*>", "", page)))


def test_extract_edge_rows(spark):
    rows = [(None, "<p>a", "t"), (1, None, "t"), (1, "", "t"), (2, "<p>" + "long words " * 50_000, "t"), (2, "<p>b", "t"), (2, "<p>b", "t")]
    got = Counter((r.page_id, r.text[:20], r.n_lines) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect())
    assert got == Counter([(None, "a", 1), (1, "", 0), (1, "", 0), (2, "long words long word", 1), (2, "b", 1), (2, "b", 1)])


def brute(rows, threshold):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    link = defaultdict(set)
    for a in ok:
        for b in ok:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                link[a].add(b)
    seen, component = set(), {}
    for a in range(len(rows)):
        if a in seen:
            continue
        stack, own = [a], set()
        while stack:
            x = stack.pop()
            if x not in own:
                own.add(x)
                stack += link[x]
        seen |= own
        low = min((rows[x][0] for x in own if rows[x][0] is not None), default=None)
        component |= dict.fromkeys(own, low)
    return Counter((r[0], len(link[i]), component[i], r[0] == component[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])).tolist()) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(40)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] * 8), (404, [float("nan")] * 16), (405, [float("inf")] + [1.0] * 15)]
    rows += [(406, [2 * x for x in rows[3][1]]), (407, rows[3][1] + [0.0] * 4), (None, rows[5][1]), (408, rows[9][1]), (408, rows[9][1]), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter(tuple(r) for r in embedding_dedup.near_embeddings(frame).collect())
    assert got == brute(rows, 0.95)


def test_embeddings_empty(spark):
    assert embedding_dedup.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def model():
    return licenses.Classifier()


def plain_families(text, model):
    """Families by paragraph, with loops: lines with cues, their runs, the classifier, then the clauses."""
    cue = re.compile("(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, model.cues)) + ")(?![a-z0-9])")
    runs, open_ = [], False
    lines = (text or "").split("\n")
    hits = [bool(cue.search(x)) for x in lines]
    for k, line in enumerate(lines):
        keep = hits[k] or (line.strip(" \t\n\x0b\f\r") != "" and 0 < k < len(lines) - 1 and hits[k - 1] and hits[k + 1])
        if keep:
            runs[-1].append(line) if open_ else runs.append([line])
        open_ = keep
    out = []
    for run in runs:
        found = set()
        for unit in ["\n".join(run)] * (len(run) > 1) + run:
            p = model.probabilities(unit)
            name = model.families[int(p.argmax())]
            if name != licenses.UNKNOWN and p.max() >= 0.5 and any(f == name and plain_overlap(unit, clause.split(), slack) >= 0.7 for f, clause, slack in licenses.clauses()):
                found.add(name)
        out += sorted(found)
    return out


def plain_overlap(unit, clause, slack):
    triples = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    sentences = [licenses.words_of(x) for x in [*re.split(r"[.!?;:]+(?:\s+|\Z)", unit), unit]]
    within = any(any(s[k : k + len(clause)] == clause for k in range(len(s))) and len(s) <= len(clause) + slack for s in sentences)
    if len(clause) < licenses.SHORT:
        return float(within)
    return max(len(triples(clause) & triples(licenses.words_of(unit))) / max(1, len(triples(clause))), float(within and slack == 8))


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width, break_long_words=False))


def test_licence_scan_matches_plain_scoring(spark, model):
    """Notices whole, wrapped and cut, names, prose, and mixtures of them."""
    notices = [t for texts in licenses.NOTICES.values() for t in texts]
    texts = [*notices, *(wrapped(t, 60) for t in notices), *(wrapped(t, 30) for t in notices), *licenses.PROSE, *(t for t, _ in licenses.samples()[2])]
    texts += ["", None, "\n\n", "Erat the he the eneain ereast.", "Some prose. Released under the MIT License. More prose follows here.", "one\n" + notices[0] + "\n\ntwo\n" + wrapped(notices[3], 50) + "\nthree", "x\0y All rights reserved.\0\nz"]
    made = [*enumerate(texts), (None, notices[0]), (901, notices[0] + "\n" + notices[3]), (901, notices[0] + "\n" + notices[3])]
    got = Counter((r.doc_id, r.n_licences, r.families) for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string").repartition(4), model).collect())
    want = Counter()
    for i, text in made:
        found = plain_families(text and text.replace("\0", " "), model)
        want[i, len(found), ",".join(sorted(set(found)))] += 1
    assert got == want


def test_paragraphs_are_counted(spark, model):
    texts = [None, "", " \n\t\n", "a", "a\nb", "a\n\nb\n \n\nc\n", "\n\na"]
    got = {r.doc_id: r.n_paragraphs for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(len(texts))] == [0, 0, 0, 1, 1, 3, 1]


def test_wrapped_notices_are_found_and_prose_is_not(model):
    for family, texts in licenses.NOTICES.items():
        for text in texts:
            for width in (40, 60, 72, 1000):
                assert family in plain_families(wrapped(text, width), model), (family, width)
    assert not any(plain_families(t, model) for t in licenses.PROSE)
    for text, family in (("MIT License", "mit"), ("All rights reserved.", "proprietary"), ("Copyright 2020 Foo Inc. All rights reserved.", "proprietary"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("// SPDX: GPLv3", "gpl")):
        assert plain_families(text, model) == [family]


def test_precision_and_recall_on_held_out_wordings(model):
    """Wordings that neither the weights nor the temperature were fitted on."""
    train, calibration, test = licenses.samples()
    assert not {t for t, _ in test} & {t for t, _ in train + calibration}
    hits = wrong = missed = 0
    for text, family in test:
        found = set(plain_families(text, model))
        hits, wrong, missed = hits + (family in found), wrong + len(found - {family}), missed + (family != licenses.UNKNOWN and family not in found)
    print(f"licences held out: precision {hits / (hits + wrong):.3f}, recall {hits / (hits + missed):.3f} of {len(test)}")
    assert hits / (hits + wrong) >= 0.95 and hits / (hits + missed) >= 0.9


def test_licence_scan_edge_rows(docs, empty, rows):
    assert licenses.scan(docs).count() == len(rows)
    assert licenses.scan(empty).count() == 0


def test_embedding_recall_on_a_whole_table(spark):
    """Probes reach at least 0.9 of the links that brute force finds, and nothing else is linked."""
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").toPandas()
    unit = np.stack(rows["embedding"]).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    true = dict(zip(rows["vec_id"], ((unit @ unit.T) >= 0.95).sum(1) - 1, strict=True))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(frame).collect()}
    assert all(got[k] <= true[k] for k in true)
    assert sum(got.values()) >= 0.9 * sum(true.values())


def test_embedding_links_along_cluster_directions(spark):
    """Copies moved toward another cluster's centre end in its list; brute force finds the same links."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 64)) / 8
    home, other = rng.integers(0, 60, 2000), rng.integers(0, 60, 2000)
    x = centres[home] + (centres[other] - centres[home]) * rng.uniform(0.3, 0.6, 2000)[:, None] + rng.normal(size=(2000, 64)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies = x + (centres[other] - centres[home]) / np.linalg.norm(centres[other] - centres[home] + 1e-9, axis=1)[:, None] * 0.3
    vectors = np.concatenate([x, copies])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    true = (unit @ unit.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(frame).collect()}
    assert true.sum() > 2000
    assert sum(got.values()) == true.sum() and all(got[k] == n for k, n in enumerate(true))
