"""Readers and writers of corpora, dictionaries, tables of lemmas and treebanks."""

from __future__ import annotations

import csv
import io
import json
import warnings

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MANIFEST = "name string, ident string, created string, createdCircaStart string, createdCircaEnd string, csvFileName string, externalPdfLink string, googleBooksId string, original string, notes string, source string, inlineSpeakerCodes array<string>, inlineReferences array<string>, referenceBook string, inlineRecordingEvents array<string>, manxColumnLanguage string, notesCitations boolean"
LINE = "path string, line_no int, english string, text string, english_original string, text_original string, page int, notes string, speaker string, source string, reference string, language string, date_cell string, sub_start double, sub_end double, error string"
#: CSV headers and the columns that they fill.
HEADERS = {"English": "english", "Manx": "text", "EnglishOriginal": "english_original", "ManxOriginal": "text_original", "Page": "page", "Notes": "notes", "Speaker": "speaker", "Source": "source", "Reference": "reference", "Language": "language", "Date": "date_cell", "SubStart": "sub_start", "SubEnd": "sub_end"}


def manifests(spark: SparkSession, *roots: str, most: int | None = None) -> DataFrame:
    """Manifests below the roots; keys that are not known go to ``extension``; bad files have ``_corrupt_record``.

    A root that cannot be read is warned of and left out; the others are read.
    ``most`` gives the first so many by root and path.
    """
    known = T.StructType.fromDDL(MANIFEST)
    out = None
    for k, root in enumerate(roots):
        try:
            files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        except AnalysisException as e:
            warnings.warn(f"{root} cannot be read: {e}", stacklevel=2)
            continue
        parsed = F.from_json("value", known)
        extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda key, _: ~key.isin(*known.names))
        own = files.select("path", F.lit(k).alias("root"), parsed.alias("m"), extra.alias("extension"), F.when(parsed.isNull() | ~F.col("value").rlike(r"^\s*\{"), F.col("value")).alias("_corrupt_record"))
        own = own.select("path", "root", "m.*", "extension", "_corrupt_record")
        out = own if out is None else out.unionByName(own)
    if out is None:
        schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("root", T.IntegerType()), *known.fields, T.StructField("extension", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType())])
        out = spark.createDataFrame([], schema)
    out = out.withColumn("csvFileName", F.coalesce("csvFileName", F.lit("document.csv")))
    return out.orderBy("root", "path").limit(most) if most else out


def csv_lines(spark: SparkSession, root: str, name: str = "*.csv", rows_each: int = 5000) -> DataFrame:
    """Rows of CSV files with the physical line on which each record ends.

    A cell that should be a number and is none is null.  A file that cannot be
    read as UTF-8 text or as CSV gives one row with its path and the ``error``;
    the others are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path", "content")
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(LINE)}

    def number(value: str, whole: bool):
        try:
            return int(float(value)) if whole else float(value)
        except (ValueError, OverflowError):
            return None

    def record(path: str, line_no: int, row: dict) -> dict:
        own = {"path": path, "line_no": line_no}
        for header, column in HEADERS.items():
            value = row.get(header)
            if column.endswith("original") and not (value or "").strip():
                value = None
            if value is not None and not isinstance(kinds[column], T.StringType):
                value = number(value, isinstance(kinds[column], T.IntegerType))
            own[column] = None if column == "page" and value == 0 else value
        return own

    schema = to_arrow_schema(T.StructType.fromDDL(LINE))

    def read(batches):
        for files in batches:
            for path, content in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                try:
                    reader = csv.DictReader(io.StringIO(content.decode("utf-8-sig")), strict=True)
                    for row in reader:
                        rows.append(record(path, reader.line_num, row))
                        if len(rows) == rows_each:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except (UnicodeDecodeError, csv.Error) as e:
                    rows.append({"path": path, "error": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(read, LINE)


def flat_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``{word: [gloss, ..]}`` as ``(dict, word, glosses)``, words in lower case."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("word", "glosses")).select(F.lit(name).alias("dict"), F.lower("word").alias("word"), "glosses")


def tree_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Entries with children, flattened depth first: ``(dict, entry, parent, depth, words, definition)``."""

    def flatten(frames):
        for frame in frames:
            for value in frame["value"]:
                rows, stack = [], [(e, -1, 0) for e in reversed(json.loads(value))]
                while stack:
                    e, parent, depth = stack.pop()
                    rows.append((name, len(rows), parent, depth, e.get("words") or [], e.get("definition") or e.get("entryHtml")))
                    stack += [(c, len(rows) - 1, depth + 1) for c in reversed(e.get("children") or [])]
                yield pd.DataFrame(rows, columns=["dict", "entry", "parent", "depth", "words", "definition"])

    return spark.read.text(path, wholetext=True).mapInPandas(flatten, "dict string, entry int, parent int, depth int, words array<string>, definition string")


def spoken_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("entries array<struct<word:string,translation:string,audio:string,topic:string>>").json(path).select(F.explode("entries").alias("e")).select("e.*")


LEMMA = "form string, lemma_id string, lemma string, link_type string, pos string, via string, note string"


def lemma_table(spark: SparkSession, *paths: tuple[str, str]) -> DataFrame:
    """Lemma rows of ``(path, source)`` tables, with their order."""
    out = None
    for k, (path, source) in enumerate(paths):
        rows = spark.read.csv(path, sep="\t", header=True, schema=LEMMA, quote="").withColumn("source", F.lit(source)).withColumn("source_order", F.lit(k)).withColumn("row_order", F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], LEMMA + ", source string, source_order int, row_order long")


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of tab-separated text; blank lines, comments and the header go, short rows are filled."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith(columns[0] + "\t"))
    return rows.select(*(F.coalesce(F.get(parts, k), F.lit("")).alias(c) for k, c in enumerate(columns)))


def word_lists(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of word lists with their source; those of a list that no source names are left out (see :func:`unknown_lists`)."""
    return rows.join(sources.withColumnsRenamed({"notes": "source_notes"}), "listId")


def unknown_lists(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``(listId, rows)`` of lists that no source names, to warn of."""
    return rows.join(sources.select("listId"), "listId", "left_anti").groupBy("listId").agg(F.count("*").alias("rows"))


def sense_inventory(rows: DataFrame) -> DataFrame:
    """``rows (lemma_id, sense_id, dictionary, entry_path, gloss)`` whose sense id is the lemma's with a mark and a number; of equal ids the first by entry and gloss stays."""
    whole = rows.where((F.col("lemma_id") != "") & F.col("sense_id").startswith(F.concat("lemma_id", F.lit("#"))))
    first = F.min(F.struct("entry_path", "gloss", "dictionary"))
    return whole.groupBy("lemma_id", "sense_id").agg(first.alias("x")).select("lemma_id", "sense_id", "x.dictionary", "x.entry_path", "x.gloss")


def sense_sidecar(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(line_key, pos, form, sense_ids)`` of ``rows`` whose place is a number and whose senses, parted by commas, the inventory all has."""
    own = rows.select("line_key", F.col("pos").try_cast("int").alias("pos"), "form", F.split("sense_ids", ",").alias("sense_ids")).where("pos is not null and size(sense_ids) > 0")
    each = own.select("line_key", "pos", "form", "sense_ids", F.explode("sense_ids").alias("sense_id")).join(inventory.select("sense_id").distinct().withColumn("known", F.lit(True)), "sense_id", "left")
    return each.groupBy("line_key", "pos", "form", "sense_ids").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all")).where("all").drop("all")


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """Words of CoNLL-U files; ranges, empty nodes, punctuation, numbers and X go."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    sentences = files.select("path", F.posexplode(F.split("value", r"\n\s*\n")).alias("sentence", "block"))
    lines = sentences.select(F.col("path").contains("-test").alias("held_out"), "path", "sentence", F.regexp_extract("block", r"(?m)^# text_en = (.*)$", 1).alias("english"), F.posexplode(F.split("block", "\n")).alias("k", "line"))
    cells = F.split("line", "\t")
    words = lines.where(~F.col("line").startswith("#") & F.col("line").contains("\t")).select("path", "held_out", "sentence", "english", cells[0].alias("id"), cells[1].alias("form"), cells[2].alias("lemma"), cells[3].alias("upos"))
    return words.where(~F.col("id").rlike("[-.]") & ~F.col("upos").isin("PUNCT", "NUM", "X"))


def licences(spark: SparkSession, root: str) -> DataFrame:
    """Lines of ``license.txt`` files with the section heading above each."""
    from pyspark.sql import Window

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "license.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
    role = F.last(F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1000))), ignorenulls=True).over(Window.partitionBy("path").orderBy("k"))
    return files.withColumn("section", role).where(~F.col("line").startswith("#") & (F.trim("line") != ""))


def recent(log: DataFrame, documents: DataFrame) -> DataFrame:
    """``yyyy-MM-dd HH:mm:ss path`` lines joined to documents, in the log's order (``k``)."""
    own = log.select("k", F.try_to_timestamp(F.substring("value", 1, 19)).alias("at"), F.trim(F.substring("value", 21, 10_000)).alias("path"))
    return own.where("at is not null").join(documents, "path").orderBy("k")


def random_recent(documents: DataFrame, count: int = 10, seed: int = 0) -> DataFrame:
    """So many documents by a hash of ident and seed: the same for a seed however the table is dealt."""
    return documents.orderBy(F.md5(F.concat_ws("|", F.col("ident").cast("string"), F.lit(str(seed)))), "ident").limit(count)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_json(df: DataFrame, path: str, most: int = 500) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", most).option("ignoreNullFields", True).json(path)


def sitemap(documents: DataFrame, base: str, pages: tuple[str, ...] = ("", "Browse")) -> DataFrame:
    """The lines of a site map, in order: its head, the static pages, a line for each ident, its end.

    Lines are sorted over all partitions, so no task holds all idents.
    """
    spark = documents.sparkSession
    url = lambda c: F.concat(F.lit("<url><loc>" + base + "/"), c, F.lit("</loc></url>"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', *(f"<url><loc>{base}/{p}</loc></url>" for p in pages)]
    fixed = spark.createDataFrame([(k, "", line) for k, line in enumerate(head)] + [(len(head) + 1, "", "</urlset>")], "part int, ident string, line string")
    ident = F.col("ident").cast("string")
    own = documents.where("ident is not null").select(F.lit(len(head)).alias("part"), ident.alias("ident"), url(F.url_encode(ident)).alias("line")).distinct()
    return fixed.unionByName(own).orderBy("part", "ident").select("line")
