"""First attestations, decades, and walks through dated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Uses before this year are traditional, later ones revived.
REVIVAL = 1900


def history(uses: DataFrame) -> DataFrame:
    """Per form: total, documents, earliest, and uses by era; ``uses`` has ``form, ident, year, n``."""
    dated = F.col("year").isNotNull()
    return uses.groupBy("form").agg(
        F.sum("n").alias("total"), F.count("*").alias("documents"), F.min("year").alias("earliest_year"), F.min_by("ident", F.when(dated, F.struct("year", "ident"))).alias("earliest_ident"),
        F.coalesce(F.sum(F.when(F.col("year") < REVIVAL, F.col("n"))), F.lit(0)).alias("traditional"),
        F.coalesce(F.sum(F.when(F.col("year") >= REVIVAL, F.col("n"))), F.lit(0)).alias("revived"),
        F.coalesce(F.sum(F.when(~dated, F.col("n"))), F.lit(0)).alias("undated"),
    )


def decades(uses: DataFrame) -> DataFrame:
    """Distinct documents in each decade."""
    return uses.where("year is not null").groupBy((F.floor(F.col("year") / 10) * 10).alias("decade")).agg(F.count_distinct("ident").alias("documents"))


def headline(forms: DataFrame) -> DataFrame:
    """The earliest form, forms of its own before shared ones."""
    return forms.agg(F.min_by("form", F.struct("shared", "earliest_year", "form")).alias("form"))


def walk(full: DataFrame, settled: DataFrame) -> DataFrame:
    """Dated documents, oldest first, with all and sure uses."""
    joined = full.join(settled.select("ident", F.col("n").alias("sure")), "ident", "left")
    order = Window.partitionBy("form").orderBy("year", "ident")
    return joined.where("year is not null").select("form", "ident", "year", F.col("n").alias("uses"), F.coalesce("sure", F.lit(0)).alias("sure_uses"), F.row_number().over(order).alias("step"))


def form_budget(forms: DataFrame, most: int = 24) -> DataFrame:
    """The most used forms, and how many were left out."""
    ranked = forms.withColumn("k", F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("n"), "form"))).withColumn("all", F.count("*").over(Window.partitionBy("lemma")))
    return ranked.where(F.col("k") <= most).select("lemma", "form", "n", F.greatest(F.col("all") - most, F.lit(0)).alias("cut"))


def verse_alignment(lines: DataFrame, key: str) -> DataFrame:
    """Per document its best line for a verse: the exact key first, else the chapter's first line."""
    chapter = key.rsplit(".", 1)[0]
    own = lines.where((F.col("canonical_reference") == key) | (F.col("canonical_reference") == chapter) | F.col("canonical_reference").startswith(key + "-"))
    order = Window.partitionBy("ident").orderBy(F.col("canonical_reference") != key, "line_no")
    return own.withColumn("k", F.row_number().over(order)).where("k = 1").select("ident", "line_no", "canonical_reference", "text")


def book_segments(lines: DataFrame, least: int = 2000) -> DataFrame:
    """Books of long documents in reading order, front matter with the first."""
    book = F.split("canonical_reference", r"\.")[0]
    sizes = lines.groupBy("ident").agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).where(F.col("n") >= least)
    starts = lines.where("canonical_reference is not null").groupBy("ident", book.alias("book")).agg(F.min("line_no").alias("start"))
    order = Window.partitionBy("ident").orderBy("start", "book")
    joined = starts.join(sizes, "ident").withColumn("k", F.row_number().over(order))
    end = F.coalesce(F.lead("start").over(order) - 1, F.col("hi"))
    return joined.select("ident", "book", F.when(F.col("k") == 1, F.col("lo")).otherwise(F.col("start")).alias("start"), end.alias("end"))


def quotations(citations: DataFrame) -> DataFrame:
    """The entries that quote each verse, once."""
    return citations.select("key", "dict", "word").dropDuplicates()


def reading_groups(occurrences: DataFrame) -> DataFrame:
    """Readings with the same occurrences are one; ``occurrences`` has ``lemma_id, display, line_no, pos``."""
    sets = occurrences.groupBy("lemma_id", "display").agg(F.array_sort(F.collect_set(F.struct("line_no", "pos"))).alias("at"))
    merged = sets.groupBy("at").agg(F.min("display").alias("display"), F.array_sort(F.collect_set("lemma_id")).alias("ids"))
    return merged.select("display", "ids", F.size("at").alias("n"))
