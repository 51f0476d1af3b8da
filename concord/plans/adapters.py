"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import text as T
from concord.operators import lexicon
from concord.operators.search import once
from concord.operators.tables import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by the keys where its files give fewer partitions than there are cores.

    A table of one row group would otherwise be cut into words by one task.
    Tables of many files, as on a cluster, are read where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ident"), F.col("source").alias("name"), "lang", "text")
    return own.select("*", F.expr("CASE WHEN ident % 11 <> 0 THEN CAST(1600 + ident * 37 % 420 AS INT) END").alias("year")).select("*", *(F.make_date("year", F.lit(1), F.lit(1)).alias(c) for c in ("date_start", "date_end")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line, numbered from 1."""
    own = spread(documents(spark, sf_dir), "ident")
    return own.select("ident", "name", "lang", "year", "date_start", "date_end", F.posexplode(F.split("text", "\n")).alias("at", "text")).withColumn("line_no", F.col("at") + 1).drop("at")


def verse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their lines with references: a chapter heading, then verses."""
    item = table(spark, sf_dir, "lineitem")
    forms = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("CHAPTER "), (F.col("l_orderkey") % 50 + 1).cast("string"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("Gen. "), (F.col("l_orderkey") % 50 + 1).cast("string"), F.lit(". "), F.col("l_linenumber").cast("string")))
    colon = F.concat(F.lit("Genesis:"), (F.col("l_orderkey") % 50 + 1).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    ref = F.when(F.col("l_linenumber") == 3, F.col("l_linenumber").cast("string")).when(F.col("l_linenumber") > 3, colon).otherwise(forms)
    return item.select(F.col("l_orderkey").alias("ident"), F.col("l_linenumber").alias("line_no"), ref.alias("reference"), F.col("l_returnflag").alias("text"))


def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as lines whose notes cite a date, save every third."""
    orders = table(spark, sf_dir, "orders")
    note = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("[M.H., "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("]")))
    return orders.select(F.col("o_custkey").alias("ident"), F.col("o_orderkey").alias("line_no"), note.alias("notes"), F.lit(None).cast("string").alias("date_cell"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = once(lines(spark, sf_dir), "w", T.tokens(F.col("text")))
    return own.select("ident", "line_no", "year", T.line_key(F.col("w")).alias("line_key"), F.posexplode_outer("w").alias("pos", "term")).where("pos is not null")


def lemma_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each term a noun of its own; of a term that ends in s, also a verb without it."""
    return rows_of_terms(tokens(spark, sf_dir).where("term <> ''").select("term").distinct())


def rows_of_terms(terms: DataFrame) -> DataFrame:
    """The rows of :func:`lemma_rows` for different terms, which are read once."""
    noun = F.struct(F.concat("term", F.lit(".n")).alias("lemma_id"), F.col("term").alias("lemma"), F.lit("self").alias("link_type"), F.lit("n").alias("pos"), F.lit(0).alias("source_order"))
    stem = F.expr("left(term, length(term) - 1)")
    verb = F.struct(F.concat(stem, F.lit(".v")).alias("lemma_id"), stem.alias("lemma"), F.lit("inflected").alias("link_type"), F.lit("v").alias("pos"), F.lit(1).alias("source_order"))
    both = F.when(F.col("term").endswith("s") & (F.length("term") > 1), F.array(noun, verb)).otherwise(F.array(noun))
    none = F.lit(None).cast("string")
    return terms.select(F.col("term").alias("form"), F.explode(both).alias("r")).select("form", "r.lemma_id", "r.lemma", "r.link_type", "r.pos", none.alias("via"), none.alias("note"), "r.source_order", F.lit(0).alias("row_order"))


def listed_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lists of the documents that use each term, and the lemma rows of the terms; text is cut into words once."""
    lists = materialise(lexicon.listed(tokens(spark, sf_dir)), "lists")
    return lists, rows_of_terms(materialise(lists.select("term").where("term <> ''").distinct(), "terms"))


def headwords(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (2, 3, 4, 5, 8, 12, 16)) -> DataFrame:
    """The first words of each benchmark text, as many as each size."""
    own = once(table(spark, sf_dir, "benchmark"), "w", T.tokens(F.col("text"))).where(F.size("w") >= 2)
    return own.select(F.explode(F.array(*(F.array_join(F.slice("w", 1, n), " ") for n in sizes))).alias("phrase")).distinct()
