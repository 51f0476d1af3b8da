"""Corpus scan, search in a document, and what shows around matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from concord.functions import text as T
from concord.operators import query as Q

RANGES = "array<struct<start:int,end:int>>"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row, however often it is used.

    A projection could be folded into each use, which inside a lambda would be
    once for each element; a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def matched(lines: DataFrame, query: str, options: Q.Options = Q.Options(), text_col: str = "text") -> DataFrame:
    """Lines with their spans, those with at least one; raw text is tested before it is cut into tokens."""
    tree, options = Q.parse(query, options)
    early = Q.line_filter(tree, options, F.col(text_col))
    own = lines.where(early) if early is not None else lines
    own = once(own, "tokens", T.tokens(F.col(text_col), options.lang, options.case_sensitive))
    return once(own, "spans", Q.spans(tree, options, F.col("tokens"))).where(F.size("spans") > 0)


def reference_only(lines: DataFrame, query: str, hits: DataFrame) -> DataFrame:
    """Lines matched by their reference alone."""
    tree, options = Q.parse(query, Q.Options(normalize_diacritics=False, ignore_hyphens=True))
    own = once(lines, "parts", T.reference_tokens(F.col("reference")))
    found = once(own, "spans", Q.spans(tree, options, F.col("parts"))).drop("parts").where(F.size("spans") > 0)
    return found.join(hits.select("ident", "line_no"), ["ident", "line_no"], "left_anti")


def scan(lines: DataFrame, query: str, options: Q.Options = Q.Options(), documents: DataFrame | None = None, references: bool = False) -> DataFrame:
    """Per document: matches, segments, date span, and the earliest line as a sample.

    ``lines`` has ``ident, line_no, text, date_start, date_end``.  A semi-join
    with ``documents`` comes before the scan, so whole documents are pruned.
    Undated lines come last for the sample.  Lines matched by reference only
    count as matches, not as segments.
    """
    if documents is not None:
        lines = lines.join(documents.select("ident"), "ident", "left_semi")
    hits = matched(lines, query, options).withColumn("textual", F.lit(1))
    if references:
        hits = hits.drop("tokens").unionByName(reference_only(lines, query, hits).withColumn("textual", F.lit(0)))
    order = F.struct(F.coalesce("date_start", F.lit("9999-12-31").cast("date")), "line_no")
    return hits.groupBy("ident").agg(
        F.sum(F.size("spans")).alias("matches"), F.sum("textual").alias("segments"), F.min("date_start").alias("first_date"), F.max("date_end").alias("last_date"), F.min_by("line_no", order).alias("sample_line"), F.min_by("text", order).alias("sample"),
    )


def totals(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.count("*").alias("documents"))


def result_order(name: str = "name") -> list[Column]:
    return [F.col("first_date").asc_nulls_first(), F.lower(name), F.col("ident")]


def in_document(lines: DataFrame, ident, query: str, options: Q.Options = Q.Options()) -> DataFrame:
    """Matching lines of one document; ``*`` alone gives all that are not blank, without counts."""
    own = lines.where(F.col("ident") == ident)
    if query.strip() and not query.strip().strip("*"):
        return own.where(F.trim("text") != "").select("ident", "line_no", "text", F.lit(None).cast("int").alias("matches")).orderBy("line_no")
    return matched(own, query, options).select("ident", "line_no", "text", F.size("spans").alias("matches")).orderBy("line_no")


def overlaps(start: Column, end: Column, low: int = 1600, high: int = 2100) -> Column:
    """Date ranges that meet the years; a missing bound is open."""
    return (end.isNull() | (F.year(end) >= max(1, low))) & (start.isNull() | (F.year(start) <= high))


def merge_ranges(ranges: Column) -> Column:
    """Overlapping ranges as one; ranges that only touch stay apart."""

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, r.end).alias("end"))))
        return F.when((F.size(done) > 0) & (r.start < last.end), joined).otherwise(F.concat(done, F.array(r))).cast(RANGES)

    return F.aggregate(F.array_sort(ranges.cast(RANGES)), F.array().cast(RANGES), step)


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def token_ranges(texts: pd.Series, toks: pd.Series) -> pd.Series:
    """Where each token lies in the raw text, in code points.

    Marks inside a word that normalising drops belong to the token around them.
    """
    fold = str.maketrans("‘’‛′–—‑", "'" * 4 + "-" * 3)

    def locate(text: str, own) -> list:
        folded = "".join(x.lower() if len(x.lower()) == 1 else x for x in text.translate(fold))
        chars = [(c, k) for k, c in enumerate(folded) if c not in '()":“”']
        flat, out, at = "".join(c for c, _ in chars), [], 0
        for token in own:
            start = flat.find(token.lower(), at)
            at = max(at, start + len(token))
            out.append({"start": chars[start][1], "end": chars[at - 1][1] + 1} if token and start >= 0 else {"start": -1, "end": -1})
        return out

    return pd.Series([locate(t, w) for t, w in zip(texts, toks, strict=True)])


def highlights(lines: DataFrame, query: str, options: Q.Options = Q.Options()) -> DataFrame:
    """Matching lines with merged character ranges, half open, of what matched."""
    tree, opts = Q.parse(query, options)
    own = matched(lines, query, options).withColumn("marks", Q.highlight_spans(tree, opts, F.col("tokens")))
    own = own.withColumn("ranges", token_ranges("text", "tokens"))
    found = F.transform("marks", lambda m: F.struct(F.get("ranges", m.s).start.alias("start"), F.get("ranges", m.e - 1).end.alias("end")))
    return once(once(own, "found", found), "highlights", merge_ranges(F.col("found"))).drop("found", "tokens", "spans", "marks", "ranges")


def kwic(marked: DataFrame, words: int = 5) -> DataFrame:
    """The first highlight with so many words on either side."""
    first = F.col("highlights")[0]
    before = F.substring("text", F.lit(1), first.start)
    after = F.substring("text", first.end + 1, F.length("text"))
    return marked.where(F.size("highlights") > 0).select(
        "ident", "line_no",
        F.regexp_extract(before, rf"((?:\S+\s+){{0,{words}}}\S*)$", 1).alias("pre"),
        F.substring("text", first.start + 1, first.end - first.start).alias("match"),
        F.regexp_extract(after, rf"^(\S*(?:\s+\S+){{0,{words}}})", 1).alias("post"),
    )


def bounds(lines: DataFrame) -> DataFrame:
    return lines.groupBy("ident").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def gaps(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """Hidden line ranges before, between and after the lines shown."""
    own = Window.partitionBy("ident").orderBy("line_no")
    after = hits.select("ident", "line_no", F.lead("line_no").over(own).alias("next"), F.row_number().over(own).alias("k"))
    joined = after.join(limits, "ident")
    lead = joined.where((F.col("k") == 1) & (F.col("line_no") > F.col("first_line"))).select("ident", F.col("first_line").alias("start"), (F.col("line_no") - 1).alias("end"), F.lit("leading").alias("position"))
    mid = joined.where(F.col("next") > F.col("line_no") + 1).select("ident", (F.col("line_no") + 1).alias("start"), (F.col("next") - 1).alias("end"), F.lit("middle").alias("position"))
    tail = joined.where(F.col("next").isNull() & (F.col("line_no") < F.col("last_line"))).select("ident", (F.col("line_no") + 1).alias("start"), F.col("last_line").alias("end"), F.lit("trailing").alias("position"))
    return lead.unionByName(mid).unionByName(tail)


def window_lines(lines: DataFrame, start: int, end: int, limit: int, from_end: bool = False) -> DataFrame:
    """Lines of a range that are not blank, the first or last ``limit`` of each document, with their number."""
    limit = min(max(limit, 1), 100)
    own = lines.where(F.col("line_no").between(start, end) & (F.trim("text") != ""))
    order = Window.partitionBy("ident").orderBy(F.col("line_no").desc() if from_end else F.col("line_no"))
    return own.withColumn("k", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("ident"))).where(F.col("k") <= limit).drop("k")


def reveal(shown: DataFrame, hidden: DataFrame, lines: DataFrame, chunk: int = 5, whole: int = 10, way: str = "down") -> DataFrame:
    """Open each gap by a chunk, small gaps at once, and mark what stays hidden.

    ``down`` opens a gap at its first lines, ``up`` at its last ones, ``all``
    opens it whole.  The mark of a gap stands on the first line that is still
    hidden, with ``gap`` 1 and no text; lines shown already are not doubled.
    """
    size = F.col("end") - F.col("start") + 1
    at_once = F.lit(True) if way == "all" else size <= whole
    low = F.when(at_once, F.col("start")).otherwise(F.col("start") if way != "up" else F.col("end") - chunk + 1)
    high = F.when(at_once, F.col("end")).otherwise(F.col("start") + chunk - 1 if way != "up" else F.col("end"))
    opened = hidden.select("ident", "start", "end", low.alias("low"), high.alias("high"))
    new = lines.join(opened, "ident").where(F.col("line_no").between(F.col("low"), F.col("high"))).select("ident", "line_no", "text")
    left = F.when(F.col("low") > F.col("start"), F.col("start")).when(F.col("high") < F.col("end"), F.col("high") + 1)
    rest = opened.select("ident", left.alias("line_no"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("gap")).where("line_no is not null")
    kept = shown.select("ident", "line_no", "text").unionByName(new).dropDuplicates(["ident", "line_no"]).withColumn("gap", F.lit(0))
    return kept.unionByName(rest)


def vocabulary(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode_outer(T.tokens(F.col("text"))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


def did_you_mean(lines: DataFrame, word: str, limit: int = 5) -> DataFrame:
    """Terms that are the word but for hyphens, most frequent first."""
    if set(word) & set("*+_"):
        return vocabulary(lines).where(F.lit(False))
    pattern = Q.term_pattern(Q.normal_word(word, Q.Options()), Q.Options(ignore_hyphens=True))
    return vocabulary(lines).where(F.col("term").rlike(pattern) & (F.col("term") != word)).orderBy(F.desc("n"), "term").limit(limit)


def matching_terms(terms: DataFrame, pattern: str, limit: int = 5) -> DataFrame:
    return terms.where(F.col("term").rlike(pattern)).orderBy("term").limit(limit)


def trailing_trim(lines: DataFrame) -> DataFrame:
    """Without the blank lines that end a document."""
    last = F.max(F.when(F.trim("text") != "", F.col("line_no"))).over(Window.partitionBy("ident"))
    return lines.withColumn("last", last).where(F.col("line_no") <= F.col("last")).drop("last")
