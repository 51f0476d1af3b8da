"""Offline measures of lemma ambiguity, agreement and adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ambiguity_histogram(tokens: DataFrame, most: int = 6) -> DataFrame:
    """Tokens by number of candidates, and the postings they make."""
    n = F.coalesce(F.size("ids"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return tokens.groupBy(F.least(n, F.lit(most)).alias("candidates")).agg(F.count("*").alias("tokens"), F.sum(n).alias("postings"))


def cumulative_share(forms: DataFrame, tops: tuple[int, ...] = (10, 25, 50, 100, 200, 500, 1000)) -> DataFrame:
    """Share of all mass that the largest forms have, in thousandths."""
    # the largest thousand come by a top-k, so no partition holds all forms
    largest = forms.orderBy(F.desc("n"), "form").limit(max(tops))
    ranked = largest.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "form")))
    sums = ranked.agg(*(F.sum(F.when(F.col("k") <= t, F.col("n"))).alias(f"t{t}") for t in tops)).crossJoin(forms.agg(F.sum("n").alias("mass")))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("top"), F.floor(1000 * F.col(f"t{t}") / F.col("mass")).alias("share")) for t in tops)))
    return sums.select(each.alias("x")).select("x.top", "x.share")


def decisive(observed: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """Forms with a reading of that share of enough observations; ``observed`` has ``form, lemma, n``."""
    return observed.groupBy("form").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by("lemma", F.struct("n", "lemma")).alias("lemma")).where((F.col("total") >= least) & (F.col("top") / F.col("total") >= share))


def agreement(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Words with candidates, and of those the ones that have the gold lemma among them."""
    joined = gold.join(candidates, "form", "left")
    return joined.agg(F.count("*").alias("considered"), F.count("lemmas").alias("covered"), F.count_if(F.array_contains("lemmas", F.col("lemma"))).alias("agreed"))


def layers(tokens: DataFrame) -> DataFrame:
    """Each ambiguous token in the first layer that settles it."""
    layer = F.when(F.col("override").isNotNull(), "override").when(F.col("settled").isNotNull(), "sidecar").when(F.col("equivalent"), "equivalence").when(~F.col("translated"), "untranslated").otherwise("open")
    return tokens.groupBy(layer.alias("layer")).agg(F.count("*").alias("tokens"))


def evidence_words(lines: DataFrame, share: float = 0.05) -> DataFrame:
    """English words in at most that share of lines; ``lines`` has ``words``."""
    total = lines.agg(F.count("*").alias("lines"))
    counted = lines.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.crossJoin(total).where(F.col("n") <= share * F.col("lines")).select("word", "n")


def gloss_scores(tokens: DataFrame, glosses: DataFrame) -> DataFrame:
    """Candidates whose own gloss words the line has, where that settles some but not all.

    ``tokens`` has ``token, ids, words``; ``glosses`` ``lemma_id, gloss``.
    """
    each = tokens.select("token", "words", F.size("ids").alias("of"), F.explode("ids").alias("lemma_id")).join(glosses, "lemma_id", "left")
    scored = each.withColumn("score", F.coalesce(F.size(F.array_intersect("words", "gloss")), F.lit(0)))
    kept = scored.groupBy("token", "of").agg(F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.col("lemma_id")))).alias("ids"))
    return kept.where((F.size("ids") > 0) & (F.size("ids") < F.col("of"))).select("token", "ids")


def refusal(upheld: Column, judged: Column) -> Column:
    """Why evidence does not do; null where it is accepted."""
    return F.when(judged < 10, "too few").when(upheld == judged, None).when((judged >= 50) & (upheld >= 0.98 * judged), None).otherwise("contested")


def precision(verdicts: DataFrame) -> DataFrame:
    """Resolved of eligible and correct of resolved, by split."""
    return verdicts.groupBy("split").agg(F.count("*").alias("eligible"), F.count("answer").alias("resolved"), F.count_if(F.col("answer") == F.col("gold")).alias("correct"))


def promotions(verdicts: DataFrame, least: int = 3) -> DataFrame:
    """Forms with enough verdicts, all with the same ids."""
    return verdicts.groupBy("form").agg(F.count("*").alias("n"), F.count_distinct("ids").alias("sets"), F.first("ids").alias("ids")).where((F.col("n") >= least) & (F.col("sets") == 1)).select("form", "ids", "n")


def import_verdicts(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts on known tokens that narrow the candidates, with their tier."""
    joined = lines.join(verdicts, ["line_key", "pos"])
    valid = (F.size("chosen") > 0) & (F.size(F.array_except("chosen", "ids")) == 0) & (F.size("chosen") < F.size("ids"))
    return joined.where(valid).select("line_key", "pos", "chosen", F.when(F.col("confidence") == "high", "index").otherwise("popup").alias("tier"))


def adopt_overrides(proposals: DataFrame) -> DataFrame:
    """One proposal for each form: none where sources disagree, else the model's before the seed's."""
    order = Window.partitionBy("form").orderBy(F.col("origin") != "llm", "origin")
    agreed = proposals.groupBy("form").agg(F.count_distinct("display").alias("n")).where("n = 1").select("form")
    own = proposals.join(agreed, "form", "left_semi").withColumn("k", F.row_number().over(order)).where("k = 1")
    return own.where(refusal(F.col("upheld"), F.col("judged")).isNull()).select("form", "ids", "origin")


def uncovered(lines: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Lines and forms that still lack a sidecar row."""
    return lines.select("line_key", "form").distinct().join(sidecar.select("line_key", "form"), ["line_key", "form"], "left_anti")


def consistent_shift(rows: DataFrame) -> DataFrame:
    """The least shift, not negative, that moves every token index of a line onto its form.

    ``rows`` has ``line_key, pos, form, tokens``.
    """
    at = F.filter(F.transform("tokens", lambda t, i: F.when(t == F.col("form"), i - F.col("pos"))), lambda s: s >= 0)
    shifts = rows.select("line_key", at.alias("shifts"))
    common = F.aggregate(F.collect_list("shifts"), F.collect_list("shifts")[0], lambda a, b: F.array_intersect(a, b))
    return shifts.groupBy("line_key").agg(F.array_min(common).alias("shift"))


def rekey(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows under an exact key, else under the one line with the same fingerprint; others go."""
    exact = rows.join(lines.select("line_key"), "line_key", "left_semi").withColumn("new_key", F.col("line_key"))
    lone = lines.groupBy("fingerprint").agg(F.count("*").alias("n"), F.first("line_key").alias("new_key")).where("n = 1").drop("n")
    moved = rows.join(lines.select("line_key"), "line_key", "left_anti").join(lone, "fingerprint")
    return exact.select("line_key", "pos", "new_key").unionByName(moved.select("line_key", "pos", "new_key"))


def folded_senses(senses: DataFrame, least: float = 0.5) -> DataFrame:
    """Senses of a lemma whose content words a fuller sense of it half holds go; ordinals follow the book."""
    a, b = senses.alias("a"), senses.alias("b")
    share = F.size(F.array_intersect("a.words", "b.words")) / F.greatest(F.size("a.words"), F.lit(1))
    fuller = (F.size("b.words") > F.size("a.words")) | ((F.size("b.words") == F.size("a.words")) & (F.col("b.ord") < F.col("a.ord")))
    gone = a.join(b, (F.col("a.lemma_id") == F.col("b.lemma_id")) & fuller & (share >= least)).select(F.col("a.lemma_id").alias("lemma_id"), F.col("a.ord").alias("ord")).distinct()
    kept = senses.join(gone, ["lemma_id", "ord"], "left_anti")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("lemma_id").orderBy("ord"))).withColumn("sense_id", F.concat_ws("#", "lemma_id", "n"))
