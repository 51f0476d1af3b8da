"""Lemma tables, their resolution layers, and dictionary lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import similarity
from concord.functions import text as T
from concord.operators.graph import connected_components
from concord.operators.tables import materialise

#: Link types whose rows name no reading of their form.
NO_CANDIDATE = ("derived", "contracts")


def load(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(candidates, displays, links)`` of lemma rows in ``(source_order, row_order)``.

    The first self row of an id names its lexeme; a form's ids keep their
    order, each once; links are unverified where every row that draws them is.
    """
    rows = rows.withColumn("key", T.form_key(F.col("form"))).withColumn("o", F.struct("source_order", "row_order"))
    own = F.struct(F.col("link_type") != "self", "o")
    displays = rows.groupBy("lemma_id").agg(F.min_by("lemma", own).alias("display"), F.min_by("pos", own).alias("pos"))
    first = rows.where(~F.col("link_type").isin(*NO_CANDIDATE)).groupBy("key", "lemma_id").agg(F.min("o").alias("o"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o", "lemma_id"))), lambda x: x.lemma_id)
    candidates = first.groupBy("key").agg(ids.alias("ids"))
    real = rows.where((F.col("link_type") != "self") & ~F.coalesce(F.col("note"), F.lit("")).contains("collapsed"))
    links = real.groupBy("lemma_id", "link_type", "form").agg(F.min(F.coalesce(F.col("note"), F.lit("")).contains("unverified")).alias("unverified"), F.min_by("via", "o").alias("via"))
    return candidates, displays, links


def tagged(tokens: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None, sidecar: DataFrame | None = None) -> DataFrame:
    """``tokens (ident, line_no, pos, term, line_key)`` with ``ids``: override, else index-tier sidecar, else all.

    Layers that do not narrow the candidates to some of them are left out.  A
    form without candidates has those of its clitic parts.
    """
    out = tokens.withColumn("key", T.form_key(F.col("term"))).join(candidates, "key", "left")
    layers = []
    if overrides is not None:
        out = out.join(overrides.select(F.col("form").alias("key"), F.col("ids").alias("override")), "key", "left")
        layers.append(narrowed("override"))
    if sidecar is not None:
        rows = sidecar.where("tier = 'index'").select("line_key", "pos", F.col("form").alias("key"), F.col("ids").alias("settled"))
        out = out.join(rows, ["line_key", "pos", "key"], "left")
        layers.append(narrowed("settled"))
    return out.withColumn("ids", F.coalesce(*layers, F.col("ids"))).drop("override", "settled")


def narrowed(name: str) -> Column:
    """Ids of a layer that are a strict, filled part of the candidates."""
    some = F.col(name)
    return F.when((F.size(some) > 0) & (F.size(F.array_except(some, F.col("ids"))) == 0) & (F.size(some) < F.size("ids")), some)


def with_clitics(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids of the parts of tokens that have none of their own."""
    bare = tokens.where(F.col("ids").isNull()).select("ident", "line_no", "pos", F.explode(T.clitics(F.col("term"))).alias("part"))
    parts = bare.join(candidates.select(F.col("key").alias("part"), F.col("ids").alias("part_ids")), "part")
    found = parts.groupBy("ident", "line_no", "pos").agg(F.array_distinct(F.flatten(F.collect_list("part_ids"))).alias("clitic_ids"))
    return tokens.join(found, ["ident", "line_no", "pos"], "left").withColumn("ids", F.coalesce("ids", "clitic_ids")).drop("clitic_ids")


def postings(tagged_tokens: DataFrame) -> DataFrame:
    return tagged_tokens.select("ident", "line_no", "pos", F.explode("ids").alias("lemma_id"))


def sure_forms(candidates: DataFrame, displays: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Of ``candidates (key, ids)`` those whose ids share one display lemma, or are one lexeme by ``roots (node, root)``."""
    held = candidates.select("key", F.explode("ids").alias("lemma_id")).join(displays.select("lemma_id", "display"), "lemma_id")
    one = F.min("display") == F.max("display")
    if roots is not None:
        held = held.join(roots.select(F.col("node").alias("lemma_id"), "root"), "lemma_id", "left").withColumn("root", F.coalesce("root", "lemma_id"))
        one = F.coalesce(one, F.lit(False)) | (F.min("root") == F.max("root"))
    return held.groupBy("key").agg(one.alias("one")).where("one").select("key")


def sure(tagged_tokens: DataFrame, displays: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Postings of tokens whose ids share one display lemma, or are one lexeme; each different set of ids is looked at once."""
    some = tagged_tokens.where("ids is not null")
    sets = sure_forms(some.select("ids").distinct().select(F.col("ids").alias("key"), "ids"), displays, roots)
    return postings(some.join(sets.select(F.col("key").alias("ids")), "ids", "left_semi"))


#: Terms of so many tokens are listed at once in a task.
LISTED = 2_000_000


def listed(tokens: DataFrame) -> DataFrame:
    """``(term, idents)`` of ``tokens (ident, term)``: the terms of each run of tokens, and where they are used.

    Each term of a run has one row; a document stands in it once for each use.
    So a term that is used everywhere has a row for each run, of bounded length.
    """
    kind = tokens.schema["ident"].dataType.simpleString()

    def run(batches):
        held, n = [], 0

        def lists():
            own = pa.Table.from_batches(held).group_by("term", use_threads=False).aggregate([("ident", "list")])
            return own.select(["term", "ident_list"]).rename_columns(["term", "idents"]).to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= LISTED:
                yield from lists()
                held, n = [], 0
        if n:
            yield from lists()

    return tokens.select("ident", "term").mapInArrow(run, f"term string, idents array<{kind}>")


def uses(lists: DataFrame, forms: DataFrame) -> DataFrame:
    """``(ident, n)``: how many tokens of each document have a key among ``forms (key)``; ``lists`` are those of :func:`listed`."""
    found = lists.withColumn("key", T.form_key(F.col("term"))).join(forms.select("key").distinct(), "key", "left_semi")
    return found.select(F.explode("idents").alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))


def scan_lemma(posted: DataFrame, ids: DataFrame) -> DataFrame:
    """Uses of any of the ids by document; a position counts once."""
    return posted.join(ids.select("lemma_id").distinct(), "lemma_id", "left_semi").groupBy("ident").agg(F.count_distinct("line_no", "pos").alias("uses"))


def holding(candidates: DataFrame, ids: list[str]) -> DataFrame:
    """The forms that have any of the ids among their candidates; what layers leave of them later is a part of these."""
    return candidates.where(F.arrays_overlap("ids", F.array(*map(F.lit, ids))))


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node connected by ``(a, b)`` pairs, whatever the length of chains."""
    labels = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = pairs.select("a").union(pairs.select("b")).toDF("own").where("own is not null").distinct()
    return nodes.join(labels, F.col("own") == F.col("node"), "left").select(F.col("own").alias("node"), F.coalesce("component", "own").alias("root"))


def context_resolution(tokens: DataFrame, overrides: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Per line and form: an override, else the union of sidecar rows if each occurrence has one."""
    own = tokens.join(sidecar.select("line_key", "pos", F.col("ids").alias("settled")), ["line_key", "pos"], "left")
    each = own.groupBy("line_key", "term").agg(F.bool_and(F.col("settled").isNotNull()).alias("whole"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("settled")))).alias("union"))
    return each.join(overrides.select(F.col("form").alias("term"), F.col("ids").alias("override")), "term", "left").select("line_key", "term", F.coalesce("override", F.when(F.col("whole"), F.col("union"))).alias("ids"))


def lookup(selections: DataFrame, entries: DataFrame, candidates: DataFrame, displays: DataFrame, hops: int = 3) -> DataFrame:
    """Entries of each selection: its own, else those of its roots, up to ``hops`` away: ``(selection, word, definition, tier)``."""
    heads = entries.select(T.form_key(F.col("word")).alias("key"), "word", "definition")
    reach = selections.select("selection", T.form_key(F.col("selection")).alias("key"), F.lit(0).alias("tier"))
    every = reach
    for hop in range(1, hops + 1):
        roots = reach.join(candidates, "key").select("selection", F.explode("ids").alias("lemma_id")).join(displays, "lemma_id")
        reach = roots.select("selection", T.form_key(F.col("display")).alias("key"), F.lit(hop).alias("tier")).distinct()
        every = every.union(reach)
    found = every.groupBy("selection", "key").agg(F.min("tier").alias("tier")).join(heads, "key")
    least = F.min("tier").over(Window.partitionBy("selection"))
    return found.withColumn("least", least).where("tier = least").select("selection", "word", "definition", "tier").distinct()


def near_matches(probes: DataFrame, words: DataFrame, most: int = 4) -> DataFrame:
    """Words within one edit (two from six letters on), swaps counting one; the best ``most`` of each probe.

    Candidates come by an equi-join.  Words of at most ``SPELLED`` letters two
    edits apart share a form with at most two letters left out; longer words
    share one of five parts, two letters shifted at most, as two edits or swaps
    touch four.  So a word gives some hundred rows, however long it is.
    """
    own = probes.where((F.length("probe") >= 4) & ~F.col("probe").contains(" ")).withColumn("most", similarity.allowed(F.col("probe")))
    pool = words.where((F.length("word") >= 3) & ~F.col("word").contains(" ")).select("word").distinct()
    near = own.select(F.explode(F.sequence(F.length("probe") - 2, F.length("probe") + 2)).alias("n")).distinct()
    pool = pool.join(near, F.length("word") == F.col("n"), "left_semi")
    held = pool.select("word", F.explode(_held(F.col("word"))).alias("piece"))
    asked = own.select("probe", "most", F.explode(_asked(F.col("probe"))).alias("piece")).distinct()
    pairs = asked.join(held, "piece").where("word <> probe").select("probe", "word", "most").distinct()
    scored = pairs.withColumn("distance", similarity.osa_distance(F.col("probe"), F.col("word"), F.col("most"))).where("distance <= most")
    order = Window.partitionBy("probe").orderBy("distance", F.left("word", F.lit(1)) != F.left("probe", F.lit(1)), F.lower("word"), "word")
    return scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("probe", "word", "distance", "k")


#: Words up to this length meet by forms with letters left out, longer ones by one of so many parts.
SPELLED, PARTS = 12, 5


def _deletions(word: Column) -> Column:
    """The word with up to two letters left out."""

    def less(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))

    once = less(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, less))))


def _part(word: Column, size: Column, k: Column, shift: Column | int = 0) -> Column:
    """The letters that part ``k`` of a word of ``size`` letters has, ``shift`` letters on."""
    at = F.floor(size * k / PARTS).cast("int")
    start = at + 1 + shift
    return F.when(start >= 1, F.concat_ws("#", size, k, F.substr(word, start, F.floor(size * (k + 1) / PARTS).cast("int") - at)))


def _held(word: Column) -> Column:
    every = F.array(*map(F.lit, range(PARTS)))
    return F.when(F.length(word) <= SPELLED, _deletions(word)).otherwise(F.transform(every, lambda k: _part(word, F.length(word), k)))


def _asked(word: Column) -> Column:
    """Pieces that words of any length within two of the probe's can share with it."""
    n, every = F.length(word), F.array(*map(F.lit, range(PARTS)))
    sizes = F.filter(F.sequence(n - 2, n + 2), lambda x: x > SPELLED)
    shifts = F.array(*map(F.lit, range(-2, 3)))
    parts = F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(every, lambda k: F.transform(shifts, lambda x: _part(word, size, k, x))))))
    spelled = F.when(n <= SPELLED + 2, _deletions(word)).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(spelled, parts))


def suggest(words: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """Headwords that begin so: the exact one first, then by use."""
    key = T.form_key(F.col("word"))
    own = words.withColumn("key", key).where(F.col("key").startswith(prefix))
    best = own.groupBy("key").agg(F.min_by("word", F.struct((F.col("word") != F.lower("word")).alias("u"), "word")).alias("word"), F.max("uses").alias("uses"))
    return best.orderBy(F.col("key") != prefix, F.desc("uses"), F.lower("word"), "word").limit(most).select("word", "uses")


def fuzzy(words: DataFrame, query: str) -> DataFrame:
    """Exact, then leading, then contained: the first tier of each word."""
    low = F.lower("word")
    tier = F.when(low == query, 0).when(low.startswith(query), 1).when(low.contains(query), 2)
    return words.withColumn("tier", tier).where("tier is not null").groupBy("word").agg(F.min("tier").alias("tier"))


def browse(words: DataFrame) -> DataFrame:
    """Headwords in collation order, in chapters that begin where the leading letters change."""
    order = Window.partitionBy(F.col("letter")).orderBy("sort", "word")
    keyed = words.select("word", T.collation_key(F.col("word")).alias("sort")).where("sort <> ''").withColumn("letter", F.left("sort", F.lit(1))).withColumn("head", F.left("sort", F.lit(2)))
    new = F.when(F.lag("head").over(order).isNull() | (F.col("head") != F.lag("head").over(order)), 1).otherwise(0)
    keyed = keyed.withColumn("new", new).withColumn("twin", F.coalesce(F.lag("word").over(order) == F.col("word"), F.lit(False)))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("chapter", F.sum("new").over(running)).where(~F.col("twin")).select("letter", "chapter", "head", "word")


def ranked(words: DataFrame) -> DataFrame:
    """``(word, attested, sort, letter, rank)``: different headwords numbered from 1 in collation order.

    Ranks are counted within a letter; the letters before come as sums, a row
    for each letter, so no task orders all words.
    """
    own = words.select("word", "attested", T.collation_key(F.col("word")).alias("sort")).groupBy("word", "sort").agg(F.max("attested").alias("attested")).withColumn("letter", F.left("sort", F.lit(1)))
    counts = own.groupBy("letter").agg(F.count("*").alias("n"))
    before = Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)  # a row for each letter
    bases = counts.select(F.col("letter").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = own.withColumn("k", F.row_number().over(Window.partitionBy("letter").orderBy("sort", "word")))
    return numbered.join(bases, F.col("letter") == F.col("of")).select("word", "attested", "sort", "letter", (F.col("base") + F.col("k")).alias("rank"))


def neighbours(words: DataFrame) -> DataFrame:
    """Each headword's neighbours in collation order, and its nearest attested ones.

    The words are cut into ranges of collation order, written once, so that
    both passes see the same ranges: one finds neighbours within a range, the
    other what lies beyond its ends, a row for each range.  Every frame runs
    from the first row on; one that ends at the last row would be gone through
    again for each word.
    """
    keyed = words.select("word", "attested", T.collation_key(F.col("word")).alias("sort")).distinct()
    own = materialise(keyed.repartitionByRange("sort", "word").withColumn("part", F.spark_partition_id()), "collated")
    order, back = Window.partitionBy("part").orderBy("sort", "word"), Window.partitionBy("part").orderBy(F.desc("sort"), F.desc("word"))
    entry, seen = F.struct("sort", "word"), F.when(F.col("attested"), F.struct("sort", "word"))
    # the first and the last word of each range, and what lies beyond it
    edges = own.groupBy("part").agg(F.min(entry).alias("first"), F.max(entry).alias("last"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))
    up, down = Window.orderBy("part"), Window.orderBy(F.desc("part"))
    beyond = edges.select(
        F.col("part").alias("of"), F.lag("last").over(up)["word"].alias("edge_before"), F.lag("first").over(down)["word"].alias("edge_after"),
        _latest(F.col("last_seen"), up)["word"].alias("seen_before"), _latest(F.col("first_seen"), down)["word"].alias("seen_after"),
    )
    word = F.when(F.col("attested"), F.col("word"))
    within = own.select(
        "part", "word", F.lag("word").over(order).alias("before"), F.lead("word").over(order).alias("after"),
        _latest(word, order).alias("attested_before"), _latest(word, back).alias("attested_after"),
    )
    joined = within.join(beyond, F.col("part") == F.col("of"))
    return joined.select("word", *(F.coalesce(a, b).alias(a) for a, b in (("before", "edge_before"), ("after", "edge_after"), ("attested_before", "seen_before"), ("attested_after", "seen_after"))))


def _latest(c: Column, order: Window) -> Column:
    """The last value that is not null in the rows before."""
    return F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def around(words: DataFrame, probes: DataFrame, span: int = 5) -> DataFrame:
    """``(probe, offset, word)``: the headwords up to ``span`` places (at most 25) on either side of each probe.

    A probe that is no headword stands where it would be filed: offset -1 is
    the word before that place, 1 the word after, and 0 does not occur.
    """
    span = min(max(span, 1), 25)
    order = ranked(words)
    asked = probes.select("probe", T.collation_key(F.col("probe")).alias("key")).distinct().withColumn("initial", F.left("key", F.lit(1)))
    # where each probe lies: after the words of earlier letters and those of its own letter that sort before it
    same = asked.join(order, F.col("initial") == F.col("letter"), "left")
    before = F.struct("sort", "word") < F.struct(F.col("key").alias("sort"), F.col("probe").alias("word"))
    placed = same.groupBy("probe", "key", "initial").agg(F.max(F.when(before, F.col("rank"))).alias("under"), F.min(F.when(F.col("word") == F.col("probe"), F.col("rank"))).alias("at"), F.min("rank").alias("low"))
    # of letters that begin no word, the last rank before them: a row for each letter, so one small window
    ends = order.groupBy("letter").agg(F.max("rank").alias("end")).unionByName(asked.select(F.col("initial").alias("letter"), F.lit(None).cast("long").alias("end")).distinct())
    upto = F.last("end", ignorenulls=True).over(Window.orderBy("letter", F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    earlier = ends.select("letter", "end", F.coalesce(upto, F.lit(0)).alias("earlier")).where("end is null").select(F.col("letter").alias("initial"), "earlier")
    placed = placed.join(earlier, "initial", "left").select("probe", "at", F.coalesce("under", F.col("low") - 1, "earlier").alias("under"))
    wanted = F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset")
    place = F.when(F.col("at").isNotNull(), F.col("at") + F.col("offset")).when(F.col("offset") < 0, F.col("under") + 1 + F.col("offset")).when(F.col("offset") > 0, F.col("under") + F.col("offset"))
    return placed.select("probe", "at", "under", wanted).withColumn("rank", place).join(order.select("rank", "word"), "rank").select("probe", "offset", "word")


def homographs(displays: DataFrame) -> DataFrame:
    own = Window.partitionBy("display")
    numbered = displays.withColumn("k", F.row_number().over(own.orderBy("lemma_id"))).withColumn("n", F.count("*").over(own))
    return numbered.select("lemma_id", "display", F.when(F.col("n") > 1, F.col("k")).alias("homograph"))


def banded_sample(words: DataFrame, quota: int = 3, seed: int = 7) -> DataFrame:
    """Headwords of each band of use (none, under 10, under 100, more) by a hash: the same for a seed however the table is dealt."""
    band = F.when(F.col("uses") == 0, 0).when(F.col("uses") < 10, 1).when(F.col("uses") < 100, 2).otherwise(3)
    own = words.withColumn("band", band).withColumn("r", F.md5(F.concat("word", F.lit(f"|{seed}"))))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("band").orderBy("r", "word"))).where(F.col("k") <= quota).select("band", "word", "uses")


def tree(links: DataFrame, displays: DataFrame, most: int = 6) -> DataFrame:
    """Forms below each lemma, level by level; a path never enters a form twice: ``(root, path, link_type, depth)``."""
    edges = links.join(displays.select("lemma_id", "display"), "lemma_id").select(F.col("display").alias("parent"), F.col("form").alias("child"), "link_type").where("parent <> child").distinct()
    level = edges.select(F.col("parent").alias("root"), F.array("parent", "child").alias("path"), "link_type", F.lit(1).alias("depth"))
    every = level
    for depth in range(2, most + 1):
        below = level.withColumn("at", F.element_at("path", -1)).drop("link_type").join(edges, F.col("at") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
        level = below.select("root", F.concat("path", F.array("child")).alias("path"), "link_type", F.lit(depth).alias("depth"))
        every = every.union(level)
    return every


def cognates(c: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\(((?:Ir|S\.G|W|Gael)\. [^()]*)\)"), F.lit(1))), 1, most)


def speaker_name(code: Column, authors: Column) -> Column:
    """The one author whose capitals hold the code's letters in order; else the code."""
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(F.split(F.upper(code), ""), lambda x: F.concat(F.lit(".*"), x)), ""))
    fits = F.filter(F.transform(F.split(authors, r"\s*[&;]\s*"), lambda x: F.trim(x)), lambda a: F.regexp_replace(a, "[^A-Z]", "").rlike(pattern))
    return F.when(F.size(fits) == 1, fits[0]).otherwise(code)


def contributor_names(c: Column) -> Column:
    """Names of a credit line: cut at ``&``, without brackets and years."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)", ""), r"[,\s]*\b[0-9]{4}\b", ""))
    return F.filter(F.transform(F.split(c, "&"), clean), lambda x: x != "")


def contributors(credits: DataFrame) -> DataFrame:
    """Documents of each contributor; ``credits`` has ``ident, credit``."""
    named = credits.select("ident", F.explode(contributor_names(F.col("credit"))).alias("name"))
    return named.groupBy("name").agg(F.count_distinct("ident").alias("documents"))


def tag_tree(tags: DataFrame, child: str, parent: str) -> DataFrame:
    """Documents of a parent tag that the child does not hold."""
    return tags.where(F.col("tag") == parent).join(tags.where(F.col("tag") == child).select("ident"), "ident", "left_anti").select("ident")
