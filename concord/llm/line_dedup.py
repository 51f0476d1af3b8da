"""Drop lines that many documents share, with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted for each hash;
the positions of frequent lines are gathered for each document, and the text is
put together again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import ascii_lower, free_names

#: What is stripped from both ends of a line's key.
BLANKS = " \t\n\x0b\x0c\r"
#: The join on a frequent line is dealt over so many partitions.
SALTS = 8


def line_keys(text: Column) -> Column:
    """The keys of a text's lines.

    Spark trims given characters, and translates them, far slower than it
    lower-cases ASCII, so only the lines that need these get them.  Each step is
    a transform of its own, as a lambda evaluates again what it names twice.
    """

    def strip(line: Column) -> Column:
        edges = [F.substring(line, at, 1).isin(*BLANKS) for at in (1, -1)]
        return F.when(edges[0] | edges[1], F.trim(line, F.lit(BLANKS))).otherwise(line)

    def lower(key: Column) -> Column:
        return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(ascii_lower(key))

    return F.transform(F.transform(F.split(text, "\n"), strip), lower)


def _hashes(text: Column) -> Column:
    """Two 64-bit hashes of each line's key; null for an empty key, which is never dropped."""
    return F.transform(line_keys(text), lambda key: F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with frequent lines taken out of ``text_col``, and ``n_lines``, ``n_dropped``.

    A line whose key (ASCII blanks stripped, A-Z lower-cased) is found in at
    least ``min_docs`` rows loses all its copies in every row; a key occurring
    twice in one row counts once, and a repeated row counts as a row.  An
    empty key stays.  A null text counts as one empty line and stays null; a
    text that loses all its lines becomes empty.  Rows with null or equal ids
    are handled each for itself, and texts of any length whole.  Columns named
    ``n_lines`` or ``n_dropped`` are replaced, all others keep their names and
    values; an empty table gives an empty one.
    """
    quoted = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    text = F.coalesce(quoted[0], F.lit(""))
    # rows with equal id and text lose the same positions, so the pair is key enough
    row = [quoted[1].alias("i"), F.xxhash64(quoted[0]).alias("t")]
    lines = docs.select(*row, _hashes(text).alias("h"))
    # outer generators: before inner ones Spark filters by size, and hashes all lines again for it
    frequent = (
        lines.select(F.explode_outer(F.array_distinct("h")).alias("h")).where("h is not null")
        .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
        .select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    )
    placed = lines.select("i", "t", F.posexplode_outer("h").alias("p", "h")).where("h is not null")
    placed = placed.withColumn("s", F.pmod(F.xxhash64("i", "t"), F.lit(SALTS)).cast("int"))
    gone, of_id, of_text, hashed = free_names(docs, "gone", "gone_id", "gone_text", "hashed")
    dropped = placed.join(frequent, ["h", "s"]).groupBy(F.col("i").alias(of_id), F.col("t").alias(of_text)).agg(F.collect_set("p").alias(gone))
    joined = docs.withColumn(hashed, F.xxhash64(quoted[0])).join(dropped, quoted[1].eqNullSafe(F.col(of_id)) & (F.col(hashed) == F.col(of_text)), "left")
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), quoted[0]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in names),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
