"""Corpus statistics, vocabulary, attestation and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text as T
from concord.operators.search import once


def words(lines: DataFrame, *keep: str) -> DataFrame:
    """A row for each running word.

    An outer generator: before an inner one Spark filters lines by the number
    of their words, and cuts each line a second time for it.
    """
    own = lines.select(*keep, F.explode_outer(T.tokens(F.col("text"))).alias("term"))
    return own.where(F.col("term").isNotNull() & T.is_word(F.col("term")))


def term_frequency(lines: DataFrame) -> DataFrame:
    return words(lines).groupBy("term").agg(F.count("*").alias("frequency"))


def corpus_statistics(lines: DataFrame) -> DataFrame:
    """Documents, running words and different words; terms are counted before they meet."""
    terms = term_frequency(lines).agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("running_words"), F.count("*").alias("unique_words"))
    return terms.crossJoin(lines.agg(F.count_distinct("ident").alias("documents")))  # two tables of one row


def vocabulary_fold(frequency: DataFrame) -> DataFrame:
    """Frequency by the lemma key of spellings."""
    return frequency.groupBy(T.form_key(F.col("term")).alias("fold")).agg(F.sum("frequency").alias("frequency"), F.count("*").alias("spellings"))


def phrase_attestation(lines: DataFrame, headwords: DataFrame, most: int = 16) -> DataFrame:
    """How often each headword of 2 to ``most`` words occurs; lines are cut only where a first word occurs.

    ``n`` is null for longer headwords, which are not counted.
    """
    parts = F.split("phrase", " ")
    heads = headwords.select("phrase").distinct()
    counting = heads.select("phrase", parts[0].alias("first"), F.size(parts).alias("size")).where(F.col("size").between(2, most))
    sizes = counting.groupBy("first").agg(F.collect_set("size").alias("sizes"))
    own = once(lines.select("text"), "w", T.tokens(F.col("text")))
    starts = own.select("w", F.posexplode("w").alias("pos", "first")).select("first", F.slice("w", F.col("pos") + 1, F.lit(most)).alias("run"))
    fitting = F.filter("sizes", lambda n: n <= F.size("run"))
    grams = starts.join(sizes, "first").select(F.explode(F.transform(fitting, lambda n: F.array_join(F.slice("run", F.lit(1), n), " "))).alias("phrase"))
    counted = grams.join(counting.select("phrase"), "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("n"))
    joined = heads.join(counted, "phrase", "left")
    return joined.select("phrase", F.when(F.size(parts) <= most, F.coalesce("n", F.lit(0))).alias("n"))


def affix_attestation(frequency: DataFrame, affixes: list[str]) -> DataFrame:
    """Occurrences of the terms that carry each affix; ``aa-`` leads, ``-ys`` closes."""
    tests = [F.struct(F.lit(a).alias("affix"), (F.col("term").startswith(a[:-1]) if a.endswith("-") else F.col("term").endswith(a[1:])).alias("hit")) for a in affixes]
    hit = frequency.select("term", "frequency", F.explode(F.array(*tests)).alias("a")).where("a.hit")
    return hit.groupBy(F.col("a.affix").alias("affix")).agg(F.sum("frequency").alias("frequency"), F.count("*").alias("carriers"))


def attestation(headwords: DataFrame, frequency: DataFrame, phrases: DataFrame) -> DataFrame:
    """``attested`` is true, false, or null for a phrase that was not counted."""
    single = frequency.select(T.form_key(F.col("term")).alias("key")).distinct().withColumn("hit", F.lit(True))
    joined = headwords.withColumn("key", T.form_key(F.col("word"))).join(single, "key", "left").join(phrases, F.col("phrase") == F.col("key"), "left")
    many = F.col("key").contains(" ")
    return joined.select("word", F.when(F.col("hit"), True).when(many, F.col("n") > 0).otherwise(F.lit(False)).alias("attested"))


def coverage(frequency: DataFrame, defined: DataFrame) -> DataFrame:
    """Of different and running words, how many a dictionary defines."""
    known = defined.select("term").distinct().withColumn("defined", F.lit(1))
    joined = frequency.join(known, "term", "left")
    return joined.agg(
        F.count("*").alias("distinct_words"), F.sum("frequency").alias("running_words"), F.count("defined").alias("defined_words"),
        F.coalesce(F.sum(F.when(F.col("defined") == 1, F.col("frequency"))), F.lit(0)).alias("defined_running"),
    )


def token_coverage(lines: DataFrame, heads: DataFrame, most: int = 4) -> DataFrame:
    """For each token whether a phrase, longest first, or a word covers it: ``(ident, line_no, pos, term, tier)``.

    ``tier`` is the length of the longest listed phrase around the token, 1 for
    a listed word, 0 for none.
    """
    toks = once(lines.select("ident", "line_no", "text"), "w", T.tokens(F.col("text")))
    listed = heads.select("phrase", F.size(F.split("phrase", " ")).alias("n")).distinct()
    grams = F.flatten(F.array(*(F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>")), _gram(n)) for n in range(1, most + 1))))
    hits = toks.select("ident", "line_no", F.explode(grams).alias("g")).select("ident", "line_no", "g.pos", "g.phrase").join(listed, "phrase")
    covered = hits.select("ident", "line_no", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos"), "n")
    best = covered.groupBy("ident", "line_no", "pos").agg(F.max("n").alias("tier"))
    each = toks.select("ident", "line_no", F.posexplode("w").alias("pos", "term"))
    return each.join(best, ["ident", "line_no", "pos"], "left").select("ident", "line_no", "pos", "term", F.coalesce("tier", F.lit(0)).alias("tier"))


def _gram(n: int):
    return lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i + 1, F.lit(n)), " ").alias("phrase"))
