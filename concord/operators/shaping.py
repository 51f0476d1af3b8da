"""What stands beside results: translations, definitions, metadata, links, labels, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators import query as Q
from concord.operators import search
from concord.operators.lookup import RECORDING

#: Metadata that is not shown, and hosts of documents' sources.
UNSHOWN = ["uploaded by"]
SOURCES, RAW_SOURCES = "https://github.com", "https://raw.githubusercontent.com"


def translations(queries: DataFrame, flat: DataFrame) -> DataFrame:
    """``(query, glosses)``: a flat dictionary's glosses of each query, none as an empty array."""
    own = flat.select(F.lower("word").alias("w"), "glosses")
    joined = queries.select("query", F.lower(F.trim("query")).alias("w")).join(own, "w", "left")
    return joined.select("query", F.coalesce("glosses", F.array().cast("array<string>")).alias("glosses"))


def defined_in(queries: DataFrame, entries: DataFrame, languages: list[str]) -> DataFrame:
    """``(query, dictionaries)``: a map from each dictionary of the languages that defines the query to its definitions.

    ``entries`` has ``dict, word, definition, language``.
    """
    own = entries.where(F.col("language").isin(languages)).select("dict", F.lower("word").alias("w"), "definition")
    hits = queries.select("query", F.lower(F.trim("query")).alias("w")).join(own, "w").groupBy("query", "dict").agg(F.array_sort(F.collect_list("definition")).alias("d"))
    return hits.groupBy("query").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dict", "d")))).alias("dictionaries"))


def timed(hits: DataFrame) -> DataFrame:
    """``(ident, timed)``: whether a recording's matched lines say when they are spoken; null for other documents."""
    spoken = F.first("name").startswith(RECORDING)
    return hits.groupBy("ident").agg(F.when(spoken, F.bool_or(F.col("sub_start").isNotNull())).alias("timed"))


def sample_highlights(lines: DataFrame, query: str, options: Q.Options = Q.Options()) -> DataFrame:
    """``(ident, line_no, ranges)``: highlights of matching lines; null where the search is not of the corpus's own language."""
    marked = search.highlights(lines, query, options)
    return marked.select("ident", "line_no", (F.col("highlights") if options.lang == "gv" else F.lit(None).cast(search.RANGES)).alias("ranges"))


def metadata(documents: DataFrame) -> DataFrame:
    """``(ident, metadata)``: a document's extension data and columns as one map.

    Documents made on one day have ``created`` instead of a first and a last
    date; null values and ``UNSHOWN`` keys do not appear.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    same = F.col("created_start").eqNullSafe(F.col("created_end"))
    dates = {"created": F.when(same, day("created_start")), "createdCircaStart": F.when(~same, day("created_start")), "createdCircaEnd": F.when(~same, day("created_end"))}
    plain = {"identifier": F.col("ident").cast("string"), "name": F.col("name"), "notes": F.col("notes"), "source": F.col("source")}
    own = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (dates | plain).items())))
    extra = F.map_filter(F.coalesce("extension", F.create_map().cast("map<string,string>")), lambda k, _: ~F.lower(k).isin(UNSHOWN) & ~k.isin(*dates, *plain))
    return documents.select("ident", F.map_filter(F.map_concat(extra, own), lambda _, v: v.isNotNull()).alias("metadata"))


def links(repo: Column, path: Column) -> Column:
    """``(page, text, manifest)``: where a document's source can be seen and had; null without a repository or a path."""
    file = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%5C"), F.lit("/"))
    page = F.concat(F.lit(SOURCES + "/"), repo, F.lit("/blob/master/"), file)
    text = F.concat(F.lit(RAW_SOURCES + "/"), repo, F.lit("/master/"), file)
    whole = (F.coalesce(repo, F.lit("")) != "") & (F.coalesce(path, F.lit("")) != "")
    return F.when(whole, F.struct(page.alias("page"), text.alias("text"), F.replace(text, F.lit("document.csv"), F.lit("manifest.json.txt")).alias("manifest")))


def date_label(start: Column, end: Column) -> Column:
    """``Tue, 05 Mar 1850``, or two such dates if their years differ; empty where undated."""
    lo, hi = F.coalesce(start, end), F.coalesce(end, start)
    day = lambda c: F.date_format(c, "EEE, dd MMM yyyy")
    return F.when(lo.isNull(), "").when(F.year(lo) == F.year(hi), day(lo)).otherwise(F.concat_ws("-", day(lo), day(hi)))


def sort_key(title: Column) -> Column:
    """A title as it is sorted: from its first letter or digit on, in lower case."""
    return F.lower(F.regexp_replace(title, r"^[^\p{L}\p{N}]+", ""))


def resorted(results: DataFrame, by: str = "year") -> list[Column]:
    """The order of results by ``year`` (undated last), ``title`` or ``count`` (most first); ties by ident."""
    keys = {"year": [F.col("first_date").asc_nulls_last()], "title": [sort_key(F.col("name"))], "count": [F.desc("matches")]}
    return [*keys[by], F.col("ident")]


def tag_order() -> list[Column]:
    """The order of a tag's documents: by date, name and ident."""
    return [F.col("date_start").asc_nulls_first(), F.lower("name"), F.col("ident")]


def tagged_documents(documents: DataFrame, prefix: str | None = None, part: str | None = None, kind: str | None = None) -> DataFrame:
    """Documents whose ident begins so, whose name holds a part, or whose ``kind`` is the named one."""
    tests = []
    if prefix:
        tests.append(F.lower(F.col("ident").cast("string")).startswith(prefix.lower()))
    if part:
        tests.append(F.lower("name").contains(part.lower()))
    if kind:
        tests.append(F.lower("kind") == kind.lower())
    hit = F.lit(False)
    for test in tests:
        hit = hit | F.coalesce(test, F.lit(False))
    return documents.where(hit)


def contributor_aliases(names: DataFrame, aliases: dict[str, str], excluded: list[str]) -> DataFrame:
    """``(ident, name)`` with other spellings of a name replaced, and names that are no contributors left out."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    return names.select("ident", F.coalesce(F.try_element_at(table, F.col("name")), F.col("name")).alias("name")).where(~F.col("name").isin(excluded)).distinct()


def suggestions(lines: DataFrame, text: str, options: Q.Options = Q.Options(), limit: int = 5) -> DataFrame:
    """``(suggestion, matches, segments, documents)``: what to ask instead of a query that found nothing.

    Terms that are the query's words joined but for hyphens, and its words apart
    if there are several; each is searched for, and given only if it is found.
    Queries with operators or wildcards, and those that ignore hyphens, get none.
    """
    spark = lines.sparkSession
    empty = spark.createDataFrame([], "suggestion string, matches long, segments long, documents long")
    tree, parsed = Q.parse(text, options)
    if options.ignore_hyphens or parsed.ignore_hyphens or isinstance(tree, Q.Binary) or set(text) & set("*+_?"):
        return empty
    words = (tree.text,) if isinstance(tree, Q.Term) else tree.words
    atoms = [a for w in words for a in Q.normal_word(w, options).replace("-", " ").split()]
    if not atoms:
        return empty
    pattern = Q.term_pattern("".join(atoms), Q.Options(normalize_diacritics=options.normalize_diacritics, ignore_hyphens=True))
    known = search.matching_terms(search.vocabulary(lines), pattern, limit).collect()
    asked = list(dict.fromkeys([r["term"] for r in known] + [" ".join(atoms)] * (len(atoms) > 1)))
    own = Q.normal_word(text, options) if len(words) == 1 else " ".join(Q.normal_word(w, options) for w in words)
    out = empty
    for suggestion in asked:
        if suggestion != own:
            found = search.totals(search.scan(lines, suggestion, options)).select(F.lit(suggestion).alias("suggestion"), "matches", "segments", "documents")
            out = out.unionByName(found.where("matches > 0"))
    return out


def gender_note(notes: Column) -> Column:
    """What a note says after ``gender:``, without the stamp of the tool that checked it; null where there is none."""
    at = F.locate("gender: ", notes)
    tail = F.substr(notes, F.greatest(at, F.lit(1)) + 8)
    stamp = F.locate("[gender_check", tail)
    after = F.when(F.substring_index(tail, "[gender_check", -1).contains("]"), F.substr(F.substring_index(tail, "[gender_check", -1), F.locate("]", F.substring_index(tail, "[gender_check", -1)) + 1)).otherwise("")
    return F.when(at > 0, F.trim(F.when(stamp > 0, F.concat(F.rtrim(F.left(tail, stamp - 1)), after)).otherwise(tail)))


def grammar_label(entry: Column) -> Column:
    """The label in italics that an entry begins with, of at most 30 characters; null where there is none."""
    start = F.ltrim(entry)
    label = F.trim(F.substring_index(F.substr(start, F.lit(4)), "</i>", 1))
    whole = start.startswith("<i>") & start.contains("</i>") & F.length(label).between(1, 30) & ~label.contains("<")
    return F.when(whole, F.replace(F.replace(F.replace(label, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))


def spelled_occurrence(text: Column, highlights: Column) -> Column:
    """The words as a line spells its first highlight; null without one."""
    first = F.get(highlights, F.lit(0))
    return F.substring(text, first["start"] + 1, first["end"] - first["start"])


def undated_uses(uses: DataFrame) -> DataFrame:
    """``(form, undated)``: uses in documents without a date, beside the walk of the dated ones."""
    return uses.groupBy("form").agg(F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("n"))), F.lit(0)).alias("undated"))
