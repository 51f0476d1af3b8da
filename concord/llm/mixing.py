"""Mix sources to target weights on a low-discrepancy schedule, in DataFrame functions.

Each source's documents are shuffled into a stream of words and cut into blocks
of equal size.  Slot ``i`` of the mix draws the point ``frac(i / phi)``, which
cumulative shares of the slots needed map to a source; the source's slots are ranked, and
rank ``r`` takes block ``r`` modulo the number of blocks.  A source's last slot
is cut where its target is reached.  The slots are the mix's order: they say
where in it each document's words stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.shared import WORD, Scratch, free_names

#: Points are multiples of 2**-31; the factor is 2**31 / phi, made odd, so the products stay within 63 bits.
POINTS, GOLDEN = 1 << 31, 1327217885
#: Grid cells that points and shares are joined by.
CELLS = 4096
#: Slots a rank is counted within; ranks before them come from sums.
CHUNK = 4096
#: Slots that a source is dealt beyond its need: its points are even, but not exact.
SPARE = 128


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _shuffled(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))))
    return docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("t"), order.alias("o"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``(source, k, source_size, target)`` from ``(source, source_size)``.

    Sources in order of code points, null last, get the weights in turn.  Their
    targets add up to all sizes; none is above ``most`` times its source's
    size: sources are capped in the order in which a rising level reaches their
    caps, and the level of the rest follows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(order) - 1).alias("k"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    free = F.col("cap") / F.col("w") > F.col("level")
    leveled = capped.withColumn("level", level)
    final = F.min(F.when(free, F.struct((F.col("cap") / F.col("w")).alias("r"), "k", "level"))).over(everything)["level"]
    return leveled.withColumn("final", final).select("source", "k", "source_size", F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("w"))).alias("target"))


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """``(slot, k, rank)`` for slots 0 to ``slots`` - 1, from ``(k, target)``."""
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    shares = plan.select("k", F.floor(F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy(F.lit(0))) * POINTS).alias("hi"))
    shares = shares.select("k", "hi", F.coalesce(F.lag("hi").over(Window.orderBy("k")), F.lit(0)).alias("lo"), F.max("k").over(Window.partitionBy(F.lit(0))).alias("last"))
    shares = shares.select("k", "lo", F.when(F.col("k") == F.col("last"), F.lit(POINTS)).otherwise(F.col("hi")).alias("hi")).where("lo < hi")
    width = POINTS // CELLS
    cells = shares.select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    point = (F.col("slot") % POINTS) * GOLDEN % POINTS
    drawn = plan.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") / width))
    drawn = drawn.join(cells, "cell").where("point >= lo and point < hi").select("slot", "k", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = drawn.groupBy("k", "chunk").agg(F.count("*").alias("n")).select("k", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    return drawn.withColumn("within", within).join(bases, ["k", "chunk"]).select("slot", "k", (F.col("base") + F.col("within")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None) -> DataFrame:
    """``(id_col, size, source_size, target, taken, first_slot, slots, text_hash)`` for every row.

    ``size`` is the row's number of words (null text: 0), ``taken`` how many
    words of it the mix holds, repeats counted, at most ``most`` times its
    size; a source's taken words add up to its target, rounded.  ``slots`` are
    the mix's slots with the block that holds the row's first word, at most
    ``most``, ``first_slot`` the first of them; null where the mix has none.
    Ties in the shuffled order go by size, then by a hash of the text.  A null
    source is a source of its own, last in order.  Rows with null or equal ids,
    and long or repeated texts, each have their own row; other columns are
    neither read nor returned; an empty table gives an empty one.
    """
    scratch = Scratch()
    plan, block, ledger = plan_mix(docs, scratch, weights, most, id_col, text_col, source_col, block)
    scratch.clear(plan, ledger)
    rows = _shuffled(docs, id_col, source_col, text_col, seed).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    rows = rows.withColumn("bucket", F.substring("o", 1, 3))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("k", "bucket").agg(F.sum("size").alias("n")).select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("k", "bucket").orderBy("o", "size", "t")
    begun = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inner", begun).withColumn("n", F.row_number().over(within)).join(bases, ["k", "bucket"])
    rows = rows.withColumn("a", F.col("base") + F.col("inner"))
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block)))
    pieces = rows.select("k", "bucket", "n", "i", "t", "size", "source_size", "target", "a", F.explode_outer(touched).alias("block"))
    lo, hi = F.greatest("a", F.col("block") * block), F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block)
    some = F.greatest(F.lit(0), F.least(hi, F.col("block") * block + F.col("clip")) - lo)
    taken = F.coalesce(F.col("full") * (hi - lo) + some, F.lit(0))
    begins = F.when(F.col("block") == F.floor(F.col("a") / block), F.col("slots"))
    joined = pieces.join(ledger, ["k", "block"], "left").select("k", "bucket", "n", "i", "t", "size", "source_size", "target", taken.alias("taken"), begins.alias("slots"))
    whole = joined.groupBy("k", "bucket", "n", "i", "t", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("slots").alias("slots"))
    return whole.select(F.col("i").alias(id_col), "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"), "slots", F.col("t").alias("text_hash"))


def plan_mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str, block: int | None = None) -> tuple[DataFrame, int, DataFrame]:
    """The sources' plan, the block size, and how often each block is taken.

    Points are shared by the slots a source needs, not by its words: the last
    block of a round can be short, and then costs a slot all the same.

    The ledger is ``(k, block, full, clip, slots)``: ``full`` whole takes, the
    words of one more that is cut short at the end of a source's target, and
    the slots of all, at most ``most`` and one.  It is an error if the points
    give a source fewer slots than it needs.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(F.col(text_col))).alias("source_size"))
    plan = scratch.write(targets(sizes, weights, most).withColumnRenamed("source", "plan_source"), "plan")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    block = block or max(1, min(4096, total >> 18))
    goal, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    # blocks of whole rounds, and of the rest of the target
    need = F.floor(goal / size) * F.ceil(size / block) + F.ceil((goal % size) / block)
    needs = plan.select("k", "source_size", goal.alias("goal"), F.ceil(size / block).alias("blocks"), need.alias("need"))
    dealt = needs.where("need > 0").select("k", (F.col("need") + SPARE).alias("target"))
    slots = dealt.agg(F.sum("target")).first()[0] or 0
    drawn = schedule(dealt, slots).join(needs, "k").where("rank < need")
    begin = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("rank") % F.col("blocks") * block
    room = F.least(F.lit(block), F.col("source_size") - F.col("rank") % F.col("blocks") * block)
    words = F.least(room, F.col("goal") - begin)
    whole = words == room
    ledger = drawn.select("k", "slot", (F.col("rank") % F.col("blocks")).alias("block"), whole.alias("whole"), words.alias("words"))
    ledger = ledger.groupBy("k", "block").agg(
        F.sum(F.col("whole").cast("long")).alias("full"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("clip"), F.array_sort(F.collect_list("slot")).alias("slots")
    )
    ledger = scratch.write(ledger, "ledger")
    got, wanted = ledger.agg(F.sum(F.size("slots"))).first()[0] or 0, needs.agg(F.sum("need")).first()[0] or 0
    if got != wanted:
        raise RuntimeError(f"the schedule gives {got} of {wanted} slots that the sources need")
    return plan, block, ledger


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, each as often as the mix holds it: its taken words over its size, rounded.

    A row's copies stand at the slots of its first word, a range of slots in
    each partition.  A row without words is kept once, anywhere.  Rows equal in
    id and text share their takes and slots evenly.  Null ids and sources are
    values like others; long texts are handled whole; other columns keep their
    names and values; an empty table gives an empty one.
    """
    i, t, n, h, slot, slots = free_names(docs, "i", "t", "n", "h", "slot", "slots")
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    copies = F.when(F.max("size") == 0, F.lit(1)).otherwise(F.floor(F.sum("taken") / F.sum("size") + 0.5))
    counted = taken.groupBy(F.col(id_col).alias(i), F.col("text_hash").alias(t)).agg(copies.cast("int").alias(n), F.min("slots").alias(slots)).where(F.col(n) > 0)
    own = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))
    joined = own.join(counted, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)))
    # rows without words have no slot: a hash spreads them
    at = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.coalesce(F.get(slots, k), F.get(slots, F.lit(0)), F.pmod(F.xxhash64(i), F.lit(1 << 18))))
    placed = joined.withColumn(slot, F.explode(at))
    return placed.repartitionByRange(slot, i, h).sortWithinPartitions(slot, i, h).select(*(f"`{c}`" for c in docs.columns))
