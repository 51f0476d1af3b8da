"""Readers and writers on small files, damaged ones among them, and the stream of new files."""

import json

import pytest
from concord.sources import corpus
from concord.streaming import ingest


@pytest.fixture()
def root(tmp_path):
    for name, manifest in (("a", {"name": "A", "ident": "a", "inlineSpeakerCodes": ["Q"], "uploaded by": "me"}), ("b", {"name": "B", "ident": "b", "csvFileName": "x.csv"})):
        (tmp_path / "one" / name).mkdir(parents=True)
        (tmp_path / "one" / name / "manifest.json.txt").write_text(json.dumps(manifest))
    (tmp_path / "one" / "c").mkdir()
    (tmp_path / "one" / "c" / "manifest.json.txt").write_text("not json")
    (tmp_path / "one" / "a" / "document.csv").write_text('﻿English,Manx,Page,ManxOriginal,SubStart\nhi,"ta\nmee",0, ,1.5\nyes,ta,seven,x,\n"",,3,,nan?\n', encoding="utf-8")
    (tmp_path / "one" / "b" / "bad.csv").write_bytes(b"English,Manx\n\xff\xfe,x\n")
    return tmp_path


def test_manifests(spark, root):
    with pytest.warns(UserWarning, match="cannot be read"):
        got = {r.path.split("/")[-2]: r for r in corpus.manifests(spark, str(root / "one"), str(root / "missing")).collect()}
    assert got["a"].ident == "a" and got["a"].csvFileName == "document.csv" and got["a"].inlineSpeakerCodes == ["Q"] and got["a"].extension == {"uploaded by": "me"} and got["a"]._corrupt_record is None
    assert got["b"].csvFileName == "x.csv" and got["c"]._corrupt_record == "not json"
    assert [r.ident for r in corpus.manifests(spark, str(root / "one"), most=1).collect()] == ["a"]
    with pytest.warns(UserWarning):
        assert corpus.manifests(spark, str(root / "missing")).count() == 0


def test_csv_lines_keep_physical_lines_and_isolate_bad_files(spark, root):
    rows = corpus.csv_lines(spark, str(root / "one")).orderBy("path", "line_no").collect()
    good, bad = [r for r in rows if r.error is None], [r for r in rows if r.error is not None]
    assert [(r.line_no, r.english, r.text, r.page, r.text_original, r.sub_start) for r in good] == [(3, "hi", "ta\nmee", None, None, 1.5), (4, "yes", "ta", None, "x", None), (5, "", "", 3, None, None)]
    assert len(bad) == 1 and bad[0].path.endswith("bad.csv") and bad[0].text is None


def test_dictionaries_and_tables(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"Moddey": ["dog", "hound"], "kayt": []}))
    assert {r.word: r.glosses for r in corpus.flat_dictionary(spark, str(tmp_path / "flat.json"), "f").collect()} == {"moddey": ["dog", "hound"], "kayt": []}
    (tmp_path / "tree.json").write_text(json.dumps([{"words": ["a"], "definition": "A", "children": [{"words": ["b"], "entryHtml": "B"}, {"words": ["c"]}]}, {"words": []}]))
    got = corpus.tree_dictionary(spark, str(tmp_path / "tree.json"), "t").orderBy("entry").collect()
    assert [(r.parent, r.depth, r.words, r.definition) for r in got] == [(-1, 0, ["a"], "A"), (0, 1, ["b"], "B"), (0, 1, ["c"], None), (-1, 0, [], None)]
    (tmp_path / "spoken.json").write_text(json.dumps({"entries": [{"word": "x", "translation": "y", "audio": "z", "topic": "t"}]}))
    assert corpus.spoken_dictionary(spark, str(tmp_path / "spoken.json")).first().audio == "z"
    for name, line in (("l1", "row\tbee.v\tbee\tpast\tv.\t\t"), ("l2", "bee\tbee.v\tbee\tself\tv.\t\tn")):
        (tmp_path / f"{name}.tsv").write_text("form\tlemma_id\tlemma\tlink_type\tpos\tvia\tnote\n" + line + "\n")
    rows = corpus.lemma_table(spark, (str(tmp_path / "l1.tsv"), "one"), (str(tmp_path / "l2.tsv"), "two")).orderBy("source_order").collect()
    assert [(r.form, r.source, r.source_order) for r in rows] == [("row", "one", 0), ("bee", "two", 1)] and corpus.lemma_table(spark).count() == 0
    (tmp_path / "t.tsv").write_text("# c\na\tb\n\n1\t2\n3\n")
    assert [tuple(r) for r in corpus.tsv(spark, str(tmp_path / "t.tsv"), ["a", "b"]).collect()] == [("1", "2"), ("3", "")]


def test_word_lists_and_senses(spark):
    rows = spark.createDataFrame([("l1", "a"), ("l2", "b"), ("l2", "c")], "listId string, word string")
    sources = spark.createDataFrame([("l1", "n")], "listId string, notes string")
    assert [r.word for r in corpus.word_lists(rows, sources).collect()] == ["a"] and [tuple(r) for r in corpus.unknown_lists(rows, sources).collect()] == [("l2", 2)]
    inventory = corpus.sense_inventory(spark.createDataFrame([("x.n", "x.n#1", "d", "p", "g"), ("x.n", "x.n#1", "d", "a", "h"), ("", "y#1", "d", "p", "g"), ("x.n", "y#1", "d", "p", "g")], "lemma_id string, sense_id string, dictionary string, entry_path string, gloss string"))
    assert [tuple(r) for r in inventory.collect()] == [("x.n", "x.n#1", "d", "a", "h")]
    side = spark.createDataFrame([("k", "0", "f", "x.n", "x.n#1"), ("k", "z", "f", "x.n", "x.n#1"), ("k", "1", "f", "x.n", "x.n#1,x.n#9"), ("k", "3", "f", "x.n", "")], "line_key string, pos string, form string, lemma_id string, sense_ids string")
    assert [(r.pos, r.sense_ids) for r in corpus.sense_sidecar(side, inventory).collect()] == [(0, ["x.n#1"])]


def test_treebank_and_licences(spark, tmp_path):
    (tmp_path / "gv-test.conllu").write_text("# text_en = Hi there\n1\tTa\tbee\tAUX\n2-3\tmee'n\t_\t_\n2\t.\t.\tPUNCT\n\n1\tdooinney\tdooinney\tNOUN\n")
    got = corpus.treebank(spark, str(tmp_path / "gv-test.conllu")).orderBy("sentence").collect()
    assert [(r.form, r.lemma, r.upos, r.held_out, r.english) for r in got] == [("Ta", "bee", "AUX", True, "Hi there"), ("dooinney", "dooinney", "NOUN", True, "")]
    (tmp_path / "license.txt").write_text("# Title\n## Texts\r\nfree\n\n## Sound\nnot free\n")
    assert sorted((r.section, r.line) for r in corpus.licences(spark, str(tmp_path)).collect()) == [("Sound", "not free"), ("Texts", "free")]


def test_recent_random_and_sinks(spark, tmp_path):
    log = spark.createDataFrame([(0, "2020-01-02 03:04:05 b"), (1, "bad line"), (2, "2020-01-01 03:04:05 a")], "k int, value string")
    docs = spark.createDataFrame([("a", "A&1"), ("b", "B"), ("c", None), ("d", "B")], "path string, ident string")
    assert [r.path for r in corpus.recent(log, docs).collect()] == ["b", "a"]
    many = spark.range(50).selectExpr("id AS ident")
    first = [r.ident for r in corpus.random_recent(many, 5, 1).collect()]
    assert first == [r.ident for r in corpus.random_recent(many.repartition(7), 5, 1).collect()] and first != [r.ident for r in corpus.random_recent(many, 5, 2).collect()]
    assert [r.line for r in corpus.sitemap(docs, "https://x").collect()][2:] == ["<url><loc>https://x/</loc></url>", "<url><loc>https://x/Browse</loc></url>", "<url><loc>https://x/A%261</loc></url>", "<url><loc>https://x/B</loc></url>", "</urlset>"]
    corpus.write_csv(docs, str(tmp_path / "out"), "\t")
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 4
    corpus.write_json(docs, str(tmp_path / "json"), most=1)
    assert spark.read.json(str(tmp_path / "json")).count() == 4 and '"ident"' not in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json") if '"c"' in p.read_text())


def test_terms_are_counted_as_files_arrive(spark, tmp_path):
    folder, point = str(tmp_path / "in"), str(tmp_path / "point")
    for k, text in enumerate(("moddey as kayt", "moddey 12")):
        spark.createDataFrame([(text,)], "text string").write.mode("append").parquet(folder)
        query = ingest.start(ingest.term_stream(spark, folder, "text string"), f"terms{k}", point)
        query.awaitTermination()
        got = {r.term: r.n for r in spark.table(f"terms{k}").collect()}
    assert got == {"moddey": 2, "as": 1, "kayt": 1}
