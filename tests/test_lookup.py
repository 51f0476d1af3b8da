"""Dictionary lookup and result shaping on a small lexicon worked out by hand."""

import pytest
from concord.operators import harness, history, lexicon, lookup, query, search, shaping
from pyspark.sql import functions as F

#: form, lemma_id, lemma, link_type, pos, via, note
LEMMAS = [
    ("deiney", "dooinney.n", "dooinney", "plural", "s. m.", None, ""), ("dooinney", "dooinney.n", "dooinney", "self", "s. m.", None, ""),
    ("gheiney", "deiney.n", "deiney", "lenited", "s.", None, ""), ("deiney", "deiney.n", "deiney", "self", "s. pl.", None, ""),
    ("row", "bee.v", "bee", "past", "v.", None, ""), ("bee", "bee.v", "bee", "self", "v.", None, ""), ("bee", "bee.n", "bee", "self", "s.", None, ""),
    ("ass", "ass.p", "ass", "self", "pre.", None, ""), ("ass", "fass.n", "fass", "demutated", "s.", None, "unverified"), ("fass", "fass.n", "fass", "self", "s.", None, ""),
    ("vann", "banney.v", "banney", "lenited", "v.", None, ""), ("banney", "banney.v", "banney", "self", "v.", None, ""), ("vannin", "mannin.np", "Mannin", "lenited", "np.", None, ""), ("mannin", "mannin.np", "Mannin", "self", "np.", None, ""),
]
ENTRIES = [
    ("c", "dooinney", [], "man", ["Noun"]), ("c", "bee", [], "food", ["Noun"]), ("c", "bee", [], "be thou", ["Verb"]), ("c", "vann", ["vannin"], "did bless", ["Verb"]),
    ("c", "goll", [], "going", []), ("c", "mygeayrt", [], "about", []), ("c", "Mannin", [], "the Isle", []), ("c", "fass", [], "growth", ["Noun"]), ("k", "ass", [], "out of", []),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame([(*r, 0, k) for k, r in enumerate(LEMMAS)], "form string, lemma_id string, lemma string, link_type string, pos string, via string, note string, source_order int, row_order int")
    return [x.cache() for x in lexicon.load(rows)]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "dict string, word string, words array<string>, definition string, classes array<string>").cache()


def test_candidate_phrases_longest_first(spark):
    cases = [("goll", "ta goll-mygeayrt goll dy goll,"), ("meenid,", None), ("dy'n ard", "x dy'n ard y"), ("", "x"), (None, None)]
    frame = spark.createDataFrame(cases, "selection string, context string")
    got = {}
    for r in lookup.candidate_phrases(frame).orderBy("selection", "rank").collect():
        got.setdefault(r.selection, []).append(r.candidate)
    assert got["goll"][:2] == ["ta goll-mygeayrt goll dy", "ta goll mygeayrt goll dy"] and got["goll"][-1] == "goll" and "goll dy goll" in got["goll"] and "goll-dy-goll" in got["goll"]
    assert got["meenid,"] == ["meenid", "meenid,"] and got["dy'n ard"][0] == "x dy'n ard y" and "dy’n-ard" in got["dy'n ard"]
    assert set(got) == {"goll", "meenid,", "dy'n ard"} and all(len({x.lower() for x in own}) == len(own) for own in got.values())


def test_ladder_by_tier(spark, table, entries):
    words = ["gheiney", "row", "goll-mygeayrt", "dooinnye", "vannin", "ass", "Solomon", "bee"]
    asked = spark.createDataFrame([(w,) for w in words], "selection string")
    names = spark.createDataFrame([("Solomon", "a king")], "word string, definition string")
    got = {}
    for r in lookup.ladder(asked, entries, *table, names=names).collect():
        got.setdefault(r.selection, set()).add((r.tier, r.depth, r.word, r.definition))
    assert got["gheiney"] == {("root", 2, "dooinney", "man")}
    assert got["row"] == {("root", 1, "bee", "be thou")}  # the verb, not the food
    assert got["goll-mygeayrt"] == {("part", 0, "goll", "going"), ("part", 0, "mygeayrt", "about")}
    assert got["dooinnye"] == {("near", 0, "dooinney", "man")}
    # an entry that lists the spelling stays; the table's own reading follows
    assert got["vannin"] == {("own", 0, "vann", "did bless"), ("root", 1, "Mannin", "the Isle")}
    assert got["ass"] == {("own", 0, "ass", "out of"), ("root", 1, "fass", "growth")}
    assert got["Solomon"] == {("name", 0, "Solomon", "a king")} and {x[0] for x in got["bee"]} == {"own"}
    chain = {(r.selection, r.display): (r.depth, r.unverified, r.origin) for r in lookup.root_chain(asked, *table).collect()}
    assert chain["ass", "fass"] == (1, True, "fass") and chain["gheiney", "dooinney"] == (2, False, "deiney")


def test_a_word_list_silences_near_spellings(spark, table, entries):
    asked = spark.createDataFrame([("dooinnye",)], "selection string")
    assert lookup.ladder(asked, entries, *table, listed=asked.withColumnRenamed("selection", "word")).count() == 0


def test_other_lexemes_go(spark, table):
    found = spark.createDataFrame([("vannin", "vann", []), ("vannin", "vann", ["vannin"]), ("vannin", "cha vann", []), ("vannin", "zzz", []), ("vannin", "Mannin", [])], "selection string, word string, words array<string>")
    assert sorted((r.word, len(r.words)) for r in lookup.another_lexeme(found, table[0]).collect()) == [("Mannin", 0), ("cha vann", 0), ("vann", 1), ("zzz", 0)]


def test_stamps(spark, table):
    found = spark.createDataFrame([("dooinney", "own", "deiney", []), ("dooinney", "own", "dooinney", []), ("deiney", "own", "dooinney", []), ("yn", "own", "een", ["yn"])], "selection string, tier string, word string, words array<string>")
    old = spark.createDataFrame([("yn", "yn nuy")], "spelling string, modern string")
    got = {(r.selection, r.word): (r.form_of, r.through, r.phillips) for r in lookup.stamped(found, *table[:2], old).collect()}
    # of the two lexemes that deiney can be, the shared one is headed by the selection
    assert got["dooinney", "deiney"][0] == "dooinney" and got["dooinney", "dooinney"] == (None, "dooinney", None)
    assert got["deiney", "dooinney"][1] == "dooinney" and got["yn", "een"] == (None, None, "yn nuy")


def test_sense_notes_speak_only_where_all_agree(spark):
    rows = [("a", "l1", 0, ["x.n"]), ("a", "l1", 3, ["x.n"]), ("a", "l2", 0, ["x.n"]), ("a", "l2", 1, ["x.n"]), ("a", "l3", 0, ["x.n"]), ("a", "l3", 1, ["x.n"]), ("a", "l4", 0, ["x.n", "y.n"])]
    occurrences = spark.createDataFrame(rows, "selection string, line_key string, pos int, ids array<string>")
    senses = spark.createDataFrame([("l1", 0, "x.n", "x#1"), ("l1", 3, "x.n", "x#1"), ("l2", 0, "x.n", "x#1"), ("l2", 1, "x.n", "x#2"), ("l3", 0, "x.n", "x#1"), ("l4", 0, "x.n", "x#1")], "line_key string, pos int, lemma_id string, sense_id string")
    inventory = spark.createDataFrame([("x#1", "one"), ("x#2", "two")], "sense_id string, gloss string")
    assert [tuple(r) for r in lookup.sense_notes(occurrences, senses, inventory).collect()] == [("a", "l1", "x.n", "x#1", "one")]


def test_readings_take_the_most_shared_words(spark):
    entries = spark.createDataFrame([(1, "k", ["Noun"], ["sea", "fish"]), (2, "k", [], ["none"]), (3, "k", [], ["sea"])], "entry int, key string, classes array<string>, words array<string>")
    senses = spark.createDataFrame([("a.n", "k", ["Noun"], ["sea"]), ("b.v", "k", ["Verb"], ["sea", "fish"])], "lemma_id string, key string, classes array<string>, words array<string>")
    got = sorted((r.entry, r.lemma_id, r.score, r.tied) for r in lookup.readings(entries, senses).collect())
    assert got == [(1, "a.n", 1, False), (3, "a.n", 1, True), (3, "b.v", 1, True)]


def test_senses_are_minted_or_skipped(spark):
    printed = spark.createDataFrame([("bee", "n", 1, "food"), ("bee", "n", 2, "Food."), ("bee", "n", 3, "meat"), ("bee", "x", 4, "?"), ("bee", "a", 5, "z"), ("two", "n", 6, "t")], "headword string, class string, ord int, gloss string")
    lemmas = spark.createDataFrame([("bee.n", "bee"), ("two.n", "two"), ("two-1.n", "two")], "lemma_id string, display string")
    minted, skipped = lookup.mint_senses(printed, lemmas)
    assert sorted(tuple(r) for r in minted.collect()) == [("bee.n", "bee.n#1", "food"), ("bee.n", "bee.n#2", "meat")]
    assert sorted((r.ord, r.reason) for r in skipped.collect()) == [(4, "no gloss"), (5, "no lemma"), (6, "several lemmas")]


def test_pool_leaves_out_equivalent_and_overridden_forms(spark):
    candidates = spark.createDataFrame([("a", ["a.n", "b.n"]), ("c", ["c.n", "d.v"]), ("e", ["e.n"]), ("f", ["f.n", "g.n"]), ("h", ["h.n", "i.n"])], "key string, ids array<string>")
    displays = spark.createDataFrame([(x, x[0]) for x in ("a.n", "b.n", "c.n", "e.n", "f.n", "g.n")] + [("d.v", "c"), ("h.n", "h"), ("i.n", "i")], "lemma_id string, display string")
    pool = lookup.adjudication_pool(candidates, displays, spark.createDataFrame([("a.n", "b.n")], "a string, b string"), spark.createDataFrame([("h",)], "form string"))
    assert [(r.key, r.ids, r.groups) for r in pool.collect()] == [("f", ["f.n", "g.n"], 2)]


def test_long_chains_are_one_component(spark):
    pairs = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(200)] + [("x", "x")], "a string, b string")
    got = {r.node: r.root for r in lexicon.components(pairs).collect()}
    assert len(got) == 202 and {got[f"n{k:03}"] for k in range(201)} == {"n000"} and got["x"] == "x"


def test_near_matches_of_long_words_and_junk(spark):
    probes = spark.createDataFrame([("abcdefghijklmnop",), ("thsi",), ("x" * 300,)], "probe string")
    words = ["abcdefghijklmnop", "bacdefghijklmnpo", "abcdefghijklmn", "abcdefghijklmnopqr", "abcdefghijklmnopqrs", "zbcdefghijklmnoz", "this", "thsi", "ths", "y" * 5000, "x" * 299 + "y"]
    got = {(r.probe, r.word): r.distance for r in lexicon.near_matches(probes, spark.createDataFrame([(w,) for w in words], "word string"), most=20).collect()}
    want = {("abcdefghijklmnop", w): 2 for w in ("bacdefghijklmnpo", "abcdefghijklmn", "abcdefghijklmnopqr", "zbcdefghijklmnoz")}
    assert got == want | {("thsi", "this"): 1, ("thsi", "ths"): 1, ("x" * 300, "x" * 299 + "y"): 1}


def test_suggestions_are_searched_for(spark):
    lines = spark.createDataFrame([("d", 1, "lum-lane lum lane", None, None), ("e", 1, "lum-lane", None, None)], "ident string, line_no int, text string, date_start date, date_end date")
    got = [tuple(r) for r in shaping.suggestions(lines, "lumlane").collect()]
    assert got == [("lum-lane", 2, 2, 2)]
    assert [r.suggestion for r in shaping.suggestions(lines, "lum-lan-e").collect()] == ["lum-lane"]
    assert shaping.suggestions(lines, "lum*").count() == 0 and shaping.suggestions(lines, "a or b").count() == 0 and shaping.suggestions(lines, "lumlane", query.Options(ignore_hyphens=True)).count() == 0


def test_labels_links_and_metadata(spark):
    frame = spark.createDataFrame([(1, "o/r", "a b\\c.csv", "2001-03-05", "2001-09-01"), (2, None, "x", "2001-03-05", "2003-01-02"), (3, "", "x", None, None)], "k int, repo string, path string, a string, b string").withColumns({"a": F.to_date("a"), "b": F.to_date("b")})
    got = {r.k: r for r in frame.select("k", shaping.links(F.col("repo"), F.col("path")).alias("l"), shaping.date_label(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got[1].l.page == "https://github.com/o/r/blob/master/a%20b/c.csv" and got[2].l is None and got[3].l is None
    assert [got[k].d for k in (1, 2, 3)] == ["Mon, 05 Mar 2001", "Mon, 05 Mar 2001-Thu, 02 Jan 2003", ""]
    docs = spark.createDataFrame([("d", "n", None, "s", {"Uploaded By": "me", "extra": "1", "name": "other"}), ("e", None, None, None, None)], "ident string, name string, notes string, source string, extension map<string,string>").withColumns({"created_start": F.lit("1800-01-01").cast("date"), "created_end": F.lit("1800-01-01").cast("date")})
    meta = {r.ident: r.metadata for r in shaping.metadata(docs).collect()}
    assert meta["d"] == {"extra": "1", "created": "1800-01-01", "identifier": "d", "name": "n", "source": "s"} and meta["e"] == {"created": "1800-01-01", "identifier": "e"}


def test_notes_and_orders(spark):
    notes = ["gender: feminine in the corpus [gender_check v1] yes", "x gender: m", None, "none"]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(notes)), "k int, n string").orderBy("k").select(shaping.gender_note(F.col("n"))).collect()] == ["feminine in the corpus yes", "m", None, None]
    labels = ["<i>s. m.</i> a", " <i> v. </i>", "<i>" + "x" * 31 + "</i>", "no <i>s.</i>", "<i>&lt;s.&gt;</i>", None]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(labels)), "k int, n string").orderBy("k").select(shaping.grammar_label(F.col("n"))).collect()] == ["s. m.", "v.", None, None, "<s.>", None]
    rows = spark.createDataFrame([("a", "‘Zed", 1, None), ("b", "apple", 3, None), ("c", "(Mid", 2, None)], "ident string, name string, matches int, first_date date")
    assert [r.ident for r in rows.orderBy(*shaping.resorted(rows, "title")).collect()] == ["b", "c", "a"]
    assert [r.ident for r in rows.orderBy(*shaping.resorted(rows, "count")).collect()] == ["b", "c", "a"]


def test_recordings(spark):
    hits = spark.createDataFrame([("a", "🎥 one", 1.5), ("a", "🎥 one", None), ("b", "🎥 two", None), ("c", "text", 2.0)], "ident string, name string, sub_start double")
    assert {r.ident: r.timed for r in shaping.timed(hits).collect()} == {"a": True, "b": False, "c": None}
    lines = spark.createDataFrame([("a", "🎥 one", "yn thie yn"), ("b", "book", "yn dooinney")], "ident string, name string, text string")
    defined = spark.createDataFrame([("yn",), ("dooinney",)], "term string")
    assert [tuple(r) for r in lookup.spoken_index(lines, defined).collect()] == [("yn", 1, 2)]


def test_harness_layers_and_rekeying(spark):
    tokens = spark.createDataFrame([(["a"], None, False, True), (None, ["b"], False, True), (None, None, True, True), (None, None, False, False), (None, None, False, True)], "override array<string>, settled array<string>, equivalent boolean, translated boolean")
    assert {r.layer: r.tokens for r in harness.layers(tokens).collect()} == dict.fromkeys(("override", "sidecar", "equivalence", "untranslated", "open"), 1)
    verdicts = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), ("a", ["x"]), ("b", ["x"]), ("b", ["y"]), ("b", ["x"]), ("c", ["z"])], "form string, ids array<string>")
    assert [(r.form, r.n) for r in harness.promotions(verdicts).collect()] == [("a", 3)]
    rows = spark.createDataFrame([("k", 0, "b", ["a", "b", "c"]), ("k", 1, "c", ["a", "b", "c"]), ("m", 0, "z", ["a"])], "line_key string, pos int, form string, tokens array<string>")
    assert {r.line_key: r.shift for r in harness.consistent_shift(rows).collect()} == {"k": 1, "m": None}
    proposals = spark.createDataFrame([("f", ["a"], "A", "seed", 60, 60), ("f", ["a"], "A", "llm", 60, 60), ("g", ["a"], "A", "seed", 60, 60), ("g", ["b"], "B", "llm", 60, 60)], "form string, ids array<string>, display string, origin string, upheld int, judged int")
    assert [(r.form, r.origin) for r in harness.adopt_overrides(proposals).collect()] == [("f", "llm")]
    senses = spark.createDataFrame([("x", 1, ["sea", "fish"]), ("x", 2, ["sea", "fish", "eel"]), ("x", 3, ["boat"])], "lemma_id string, ord int, words array<string>")
    assert sorted((r.sense_id, r.ord) for r in harness.folded_senses(senses).collect()) == [("x#1", 2), ("x#2", 3)]


def test_reading_groups_and_budget(spark):
    rows = spark.createDataFrame([("a.n", "A", 1, 2), ("b.n", "B", 1, 2), ("c.n", "C", 1, 3)], "lemma_id string, display string, line_no int, pos int")
    assert sorted((r.display, r.ids, r.n) for r in history.reading_groups(rows).collect()) == [("A", ["a.n", "b.n"], 1), ("C", ["c.n"], 1)]
    forms = spark.createDataFrame([("x", f"f{k}", k) for k in range(30)], "lemma string, form string, n int")
    kept = history.form_budget(forms).collect()
    assert len(kept) == 24 and {r.cut for r in kept} == {6}


def test_source_ranges_of_reveal(spark):
    lines = spark.createDataFrame([("d", k, f"t{k}") for k in range(1, 41)], "ident string, line_no int, text string")
    shown = lines.where("line_no = 20").select("ident", "line_no", "text")
    hidden = search.gaps(shown, search.bounds(lines))
    for way, count, marks in (("down", 11, [6, 26]), ("up", 11, [1, 21]), ("all", 40, [])):
        got = search.reveal(shown, hidden, lines, way=way).collect()
        assert sum(r.gap == 0 for r in got) == count and sorted(r.line_no for r in got if r.gap) == marks


def test_neighbours_of_many_words_that_begin_alike(spark):
    """Every word begins with the same letter; no frame may be gone through again for each word."""
    n = 20_000
    frame = spark.range(n).select(F.format_string("a%05d", "id").alias("word"), (F.col("id") % 1000 == 500).alias("attested"))
    found = lexicon.neighbours(frame)
    got = {r.word: (r.before, r.after, r.attested_before, r.attested_after) for r in found.collect()}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower() and len(got) == n

    def word(k):
        return f"a{k:05d}" if 0 <= k < n else None

    for k in range(0, n, 250):
        seen, next_seen = (k + 499) // 1000 * 1000 - 500, (k + 500) // 1000 * 1000 + 500
        assert got[word(k)] == (word(k - 1), word(k + 1), word(seen), word(next_seen))


def test_candidate_phrases_move_no_text(spark, tmp_path):
    """Candidates are told apart where their line lies; only documents that share an id give a row twice, and they do not."""
    from concord.plans import lexical

    rows = [(1, "Ta goll goll\nx GOLL-my goll", "gv", "s"), (1, "ta Goll as\ny", "gv", "s"), (2, "a b a b", "gv", "s"), (None, "c d", "gv", "s"), (None, "c d", "gv", "s"), (3, None, "gv", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in lexical.candidate_phrases(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[0] is None} == {(None, 1, "c d"), (None, 1, "c-d"), (None, 1, "d")}
    assert {c for i, n, c in got if i == 1 and n == 1} >= {"ta goll goll", "ta goll as", "goll-as", "goll"}
    selections = spark.createDataFrame([("Goll", "goll Goll GOLL")], "selection string, context string")
    found = lookup.candidate_phrases(selections)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.rank, r.candidate) for r in found.orderBy("rank").collect()] == [(1, "goll Goll GOLL"), (2, "goll-Goll-GOLL"), (3, "goll Goll"), (4, "goll-Goll"), (5, "Goll")]


def test_sure_uses_from_lists_of_terms(spark, monkeypatch):
    """Uses are counted from lists, a row for each term of a run; no token is moved, and none is lost between runs."""
    rows = [("has", "has.n", "has", "self"), ("has", "ha.v", "ha", "inflected"), ("ha", "ha.v", "ha", "self"), ("tree", "tree.n", "tree", "self"), ("trée", "trée.n", "trée", "self"), ("men", "man.n", "man", "self")]
    frame = spark.createDataFrame([(*r, "x", None, None, 0, k) for k, r in enumerate(rows)], "form string, lemma_id string, lemma string, link_type string, pos string, via string, note string, source_order int, row_order int")
    candidates, displays, _ = lexicon.load(frame)
    roots = spark.createDataFrame([("has.n", "r"), ("ha.v", "r")], "node string, root string")
    forms = {r.key for r in lexicon.sure_forms(candidates, displays).collect()}
    assert forms == {"ha", "men"} and {r.key for r in lexicon.sure_forms(candidates, displays, roots).collect()} == {"ha", "men", "has"}
    monkeypatch.setattr(lexicon, "LISTED", 7)
    tokens = spark.createDataFrame([(k % 5, t) for k in range(100) for t in ("men", "has", "Men", "tree", "ha")] + [(9, "tree"), (None, "ha"), (None, "ha")], "ident long, term string").coalesce(1)
    lists = lexicon.listed(tokens)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString() and lists.agg(F.sum(F.size("idents"))).first()[0] == tokens.count()
    got = {r.ident: r.n for r in lexicon.uses(lists, lexicon.sure_forms(candidates, displays)).collect()}
    assert got == {None: 2} | {k: 60 for k in range(5)}
    tagged = lexicon.tagged(spark.createDataFrame([(1, 1, 0, "men"), (1, 1, 1, "has")], "ident int, line_no int, pos int, term string"), candidates)
    assert [tuple(r) for r in lexicon.sure(tagged, displays).collect()] == [(1, 1, 0, "man.n")] and lexicon.sure(tagged, displays, roots).count() == 3
