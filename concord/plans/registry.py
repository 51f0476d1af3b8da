"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import dates, references, similarity
from concord.functions import text as T
from concord.operators import harness, history, lexicon, prepare, query, search, statistics
from concord.operators.tables import small
from concord.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Documents, their lines, and the tokens of lines, as SQL.
DOCS = """docs AS (
  SELECT doc_id AS ident, source AS name, lang, text, CASE WHEN doc_id % 11 <> 0 THEN 1600 + doc_id * 37 % 420 END AS year FROM documents
)"""
LINES = DOCS + """, lines AS (
  SELECT ident, name, lang, year, CASE WHEN year IS NOT NULL THEN make_date(CAST(year AS BIGINT), 1, 1) END AS d, unnest(l) AS text, generate_subscripts(l, 1) AS line_no
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs)
)"""
NORMAL = r"""trim(lower(translate(translate(regexp_replace(text, '[,.;!\s]', ' ', 'g'), '“”‘’‛′–—‑', '""''''''''---'), '()":', '')))"""
TOKENS = LINES + rf""", parts AS (
  SELECT ident, line_no, name, year, d, text, regexp_extract_all({NORMAL}, '[\p{{L}}\p{{Nd}}\p{{Mn}}''?-]+') AS w FROM lines
), raw AS (
  SELECT ident, line_no, name, year, d, text, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM parts
), toks AS (
  SELECT ident, line_no, name, year, d, text, pos,
    CASE WHEN t LIKE '%?' AND t NOT LIKE '%??' AND NOT regexp_full_match(t, '\?+') THEN left(t, length(t) - 1) ELSE t END AS term FROM raw
)"""
WORDS = TOKENS + r""", words AS (SELECT * FROM toks WHERE NOT regexp_full_match(term, '[0-9]+|[?]*')), freq AS (SELECT term, count(*) AS frequency FROM words GROUP BY term)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def scan_sql(hits: str) -> str:
    """The scan's result from ``hits (ident, line_no, d, text, n)``."""
    return f"""WITH {TOKENS}, hits AS ({hits})
SELECT ident, CAST(sum(n) AS BIGINT) AS matches, count(*) AS segments, min(d) AS first_date, max(d) AS last_date,
  arg_min(line_no, (coalesce(d, DATE '9999-12-31'), line_no)) AS sample_line, arg_min(text, (coalesce(d, DATE '9999-12-31'), line_no)) AS sample
FROM hits GROUP BY ident"""


def per_line(test: str) -> str:
    return f"SELECT ident, line_no, d, text, count(*) AS n FROM toks WHERE {test} GROUP BY ident, line_no, d, text"


def full(pattern: str) -> str:
    return "regexp_full_match(term, '" + pattern + "')"


def scanner(text: str, options: query.Options = query.Options()) -> Query:
    return lambda spark, d: search.scan(A.lines(spark, d), text, options)


EXACT = query.Options(normalize_diacritics=False)
TAIL = r"\?*(-.*)?"
#: Forms that the default matching gives letters: marked forms of a plain one.
CLASS = {c: "(" + "|".join([c, *(k for k, v in T.PLAIN.items() if v == c)]) + ")" for c in "abcdefghijklmnopqrstuvwxyz"}


def spelled(word: str) -> str:
    return "".join(CLASS.get(c, c) for c in word) + TAIL


SCANS = {
    "scan_term": ("the", query.Options(), per_line(full(spelled("the")))),
    "scan_term_exact": ("der", EXACT, per_line("term = 'der'")),
    "scan_diacritic": ("etre", query.Options(), per_line(full(spelled("etre")))),
    "scan_wildcard_star": ("th*", EXACT, per_line(full("th.*"))),
    "scan_wildcard_plus": ("e+n", EXACT, per_line(full("e.+n"))),
    "scan_wildcard_single": ("o_", EXACT, per_line(full("o."))),
    "scan_or": ("of or in", EXACT, per_line("term = 'of' OR term = 'in'")),
    "scan_not": ("of not the", EXACT, "SELECT ident, line_no, d, text, count(*) FILTER (term = 'of') AS n FROM toks GROUP BY ident, line_no, d, text HAVING count(*) FILTER (term = 'of') > 0 AND count(*) FILTER (term = 'the') = 0"),
    "scan_and": ("of and the", EXACT, """SELECT ident, line_no, any_value(d) AS d, any_value(text) AS text, count(*) FILTER (pos <= m) AS n FROM (
      SELECT *, least(max(pos) FILTER (term = 'of') OVER w, max(pos) FILTER (term = 'the') OVER w) AS m, min(pos) FILTER (term = 'of') OVER w AS a, min(pos) FILTER (term = 'the') OVER w AS b
      FROM toks WHERE term IN ('of', 'the') WINDOW w AS (PARTITION BY ident, line_no)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ident, line_no"""),
    "scan_phrase": ("of the", EXACT, "SELECT a.ident, a.line_no, a.d, a.text, count(*) AS n FROM toks a JOIN toks b ON a.ident = b.ident AND a.line_no = b.line_no AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1, 2, 3, 4"),
    "scan_nested": ("(of or in) not (the or a)", EXACT, "SELECT ident, line_no, d, text, count(*) FILTER (term IN ('of', 'in')) AS n FROM toks GROUP BY ident, line_no, d, text HAVING count(*) FILTER (term IN ('of', 'in')) > 0 AND count(*) FILTER (term IN ('the', 'a')) = 0"),
    "scan_hyphen_agnostic": ("for-the", query.Options(normalize_diacritics=False, ignore_hyphens=True), """SELECT ident, line_no, d, text, count(*) AS n FROM (
      SELECT ident, line_no, d, text FROM toks WHERE regexp_full_match(term, 'f-*o-*r-*t-*h-*e')
      UNION ALL SELECT a.ident, a.line_no, a.d, a.text FROM toks a JOIN toks b ON a.ident = b.ident AND a.line_no = b.line_no AND b.pos = a.pos + 1 WHERE regexp_full_match(a.term, 'f-*o-*r') AND regexp_full_match(b.term, 't-*h-*e')) GROUP BY 1, 2, 3, 4"""),
}
for _name, (_text, _options, _hits) in SCANS.items():
    register(_name, scan_sql(_hits))(scanner(_text, _options))

register("scan_case_sensitive", scan_sql(per_line("term = 'The'")).replace("trim(lower(translate(translate(", "trim((translate(translate("))(
    scanner("The", query.Options(normalize_diacritics=False, case_sensitive=True))
)


@register("scan_date_filtered", scan_sql(per_line("term = 'the' AND (year IS NULL OR year BETWEEN 1700 AND 1799)")))
def scan_date_filtered(spark, d):
    own = A.documents(spark, d)
    return search.scan(A.lines(spark, d), "the", EXACT, own.where(search.overlaps(F.col("date_start"), F.col("date_end"), 1700, 1799)))


@register("scan_ordered", f"WITH {TOKENS}, hits AS ({per_line(full('th.*'))}), s AS (SELECT ident, any_value(name) AS name, CAST(sum(n) AS BIGINT) AS matches, min(d) AS first_date FROM hits JOIN (SELECT DISTINCT ident, name FROM docs) USING (ident) GROUP BY ident) SELECT ident, matches, row_number() OVER (ORDER BY first_date NULLS FIRST, lower(name), ident) AS k FROM s ORDER BY k LIMIT 100")
def scan_ordered(spark, d):
    from pyspark.sql import Window

    named = search.scan(A.lines(spark, d), "th*", EXACT).join(A.documents(spark, d).select("ident", "name"), "ident")
    top = named.orderBy(*search.result_order()).limit(100)
    return top.select("ident", "matches", F.row_number().over(Window.orderBy(*search.result_order())).alias("k"))


@register("scan_totals", f"WITH {TOKENS}, hits AS ({per_line(full('th.*'))}) SELECT CAST(sum(n) AS BIGINT) AS matches, count(*) AS segments, count(DISTINCT ident) AS documents FROM hits")
def scan_totals(spark, d):
    return search.totals(search.scan(A.lines(spark, d), "th*", EXACT))


@register("scan_reference_side", """WITH l AS (SELECT l_orderkey AS ident, l_linenumber AS line_no, l_orderkey % 50 + 1 AS c FROM lineitem)
SELECT ident, count(*) AS matches FROM l WHERE (line_no > 3 AND c = 7 AND line_no = 4) OR (line_no = 2 AND FALSE) GROUP BY ident""")
def scan_reference_side(spark, d):
    own = A.verse_lines(spark, d)
    none = own.where(F.lit(False))
    return search.reference_only(own, "genesis 7 4", none).groupBy("ident").agg(F.sum(F.size("spans")).alias("matches"))


@register("star_browse", f"WITH {LINES} SELECT ident, line_no, text, CAST(NULL AS INT) AS matches FROM lines WHERE ident = 7 AND trim(text) <> ''")
def star_browse(spark, d):
    return search.in_document(A.lines(spark, d), 7, "*")


@register("doc_search", f"WITH {TOKENS} SELECT ident, line_no, text, count(*) AS matches FROM toks WHERE term LIKE 'th%' AND ident = 1 GROUP BY 1, 2, 3")
def doc_search(spark, d):
    return search.in_document(A.lines(spark, d), 1, "th*", EXACT)


@register("doc_line_bounds", f"WITH {LINES} SELECT ident, min(line_no) AS first_line, max(line_no) AS last_line FROM lines GROUP BY ident")
def doc_line_bounds(spark, d):
    return search.bounds(A.lines(spark, d))


@register("context_window", f"WITH {LINES}, o AS (SELECT ident, line_no, text, count(*) OVER (PARTITION BY ident) AS total, row_number() OVER (PARTITION BY ident ORDER BY line_no DESC) AS k FROM lines WHERE line_no BETWEEN 2 AND 9 AND trim(text) <> '') SELECT ident, line_no, text, total FROM o WHERE k <= 3")
def context_window(spark, d):
    return search.window_lines(A.lines(spark, d), 2, 9, 3, from_end=True).select("ident", "line_no", "text", "total")


@register("context_gaps", f"""WITH {TOKENS}, h AS (SELECT DISTINCT ident, line_no FROM toks WHERE term = 'with'), b AS (SELECT ident, min(line_no) AS lo, max(line_no) AS hi FROM lines GROUP BY ident),
g AS (SELECT h.ident, line_no, lead(line_no) OVER (PARTITION BY h.ident ORDER BY line_no) AS nx, row_number() OVER (PARTITION BY h.ident ORDER BY line_no) AS k, lo, hi FROM h JOIN b USING (ident))
SELECT ident, lo AS start, line_no - 1 AS "end", 'leading' AS position FROM g WHERE k = 1 AND line_no > lo
UNION ALL SELECT ident, line_no + 1, nx - 1, 'middle' FROM g WHERE nx > line_no + 1
UNION ALL SELECT ident, line_no + 1, hi, 'trailing' FROM g WHERE nx IS NULL AND line_no < hi""")
def context_gaps(spark, d):
    own = A.lines(spark, d)
    return search.gaps(search.matched(own, "with", EXACT).select("ident", "line_no"), search.bounds(own))


HITS = f"""WITH {TOKENS}, h AS (SELECT ident, line_no, any_value(text) AS text FROM toks WHERE term = 'with' GROUP BY 1, 2), b AS (SELECT ident, min(line_no) AS lo, max(line_no) AS hi FROM lines GROUP BY ident),
g AS (SELECT h.ident, line_no, lead(line_no) OVER (PARTITION BY h.ident ORDER BY line_no) AS nx, row_number() OVER (PARTITION BY h.ident ORDER BY line_no) AS k, lo, hi FROM h JOIN b USING (ident)),
gaps AS (SELECT ident, lo AS a, line_no - 1 AS z FROM g WHERE k = 1 AND line_no > lo UNION ALL SELECT ident, line_no + 1, nx - 1 FROM g WHERE nx > line_no + 1 UNION ALL SELECT ident, line_no + 1, hi FROM g WHERE nx IS NULL AND line_no < hi)"""
REVEAL = """, o AS (SELECT ident, a, z, LOW AS low, HIGH AS high FROM gaps)
SELECT ident, line_no, text, 0 AS gap FROM h UNION ALL SELECT l.ident, l.line_no, l.text, 0 FROM lines l JOIN o ON o.ident = l.ident AND l.line_no BETWEEN low AND high
UNION ALL SELECT ident, CASE WHEN low > a THEN a ELSE high + 1 END, NULL, 1 FROM o WHERE low > a OR high < z"""


def revealed(spark, d, way: str):
    own = A.lines(spark, d)
    hits = search.matched(own, "with", EXACT)
    return search.reveal(hits, search.gaps(hits.select("ident", "line_no"), search.bounds(own)), own, way=way)


@register("context_reveal", HITS + REVEAL.replace("LOW", "a").replace("HIGH", "CASE WHEN z - a + 1 <= 10 THEN z ELSE a + 4 END"))
def context_reveal(spark, d):
    return revealed(spark, d, "down")


@register("context_reveal_up", HITS + REVEAL.replace("LOW", "CASE WHEN z - a + 1 <= 10 THEN a ELSE z - 4 END").replace("HIGH", "z"))
def context_reveal_up(spark, d):
    return revealed(spark, d, "up")


@register("context_reveal_all", HITS + REVEAL.replace("LOW", "a").replace("HIGH", "z"))
def context_reveal_all(spark, d):
    return revealed(spark, d, "all")


@register("highlight_ranges")
def highlight_ranges(spark, d):
    marked = search.highlights(A.lines(spark, d), "of the or in", EXACT)
    return marked.select("ident", "line_no", F.array_join(F.transform("highlights", lambda r: F.concat_ws("-", r.start.cast("string"), r.end.cast("string"))), ",").alias("ranges"))


@register("kwic")
def kwic(spark, d):
    return search.kwic(search.highlights(A.lines(spark, d), "of the", EXACT))


@register("term_frequency", f"WITH {WORDS} SELECT term, frequency FROM freq")
def term_frequency(spark, d):
    return statistics.term_frequency(A.lines(spark, d))


@register("corpus_statistics", f"WITH {WORDS} SELECT CAST(sum(frequency) AS BIGINT) AS running_words, count(*) AS unique_words, (SELECT count(DISTINCT ident) FROM lines) AS documents FROM freq")
def corpus_statistics(spark, d):
    return statistics.corpus_statistics(A.lines(spark, d))


@register("vocabulary_fold", f"WITH {WORDS} SELECT trim(regexp_replace(strip_accents(lower(term)), '[-\\s]+', ' ', 'g'), ' .,;:''') AS fold, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS spellings FROM freq GROUP BY 1")
def vocabulary_fold(spark, d):
    return statistics.vocabulary_fold(statistics.term_frequency(A.lines(spark, d)))


PHRASES = r"""parsed AS (
  SELECT item_id, pos, CASE WHEN t LIKE '%?' AND t NOT LIKE '%??' AND NOT regexp_full_match(t, '\?+') THEN left(t, length(t) - 1) ELSE t END AS term
  FROM (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, regexp_extract_all(NORMAL, '[\p{L}\p{Nd}\p{Mn}''?-]+') AS w FROM benchmark))
), heads AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS phrase FROM (SELECT list(term ORDER BY pos) AS w FROM parsed GROUP BY item_id), (SELECT unnest(SIZES) AS n) WHERE len(w) >= 2)""".replace("NORMAL", NORMAL)
#: All runs of as many words as some headword has.
GRAMS = """bags AS (SELECT ident, line_no, list(term ORDER BY pos) AS w FROM toks GROUP BY ident, line_no), lengths AS (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM heads),
grams AS (SELECT ident, line_no, p - 1 AS pos, n, array_to_string(w[p:p + n - 1], ' ') AS phrase FROM (SELECT ident, line_no, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bags, lengths WHERE len(w) >= n))"""


@register("phrase_attestation", f"WITH {TOKENS}, {PHRASES}, {GRAMS}, n AS (SELECT phrase, count(*) AS n FROM grams GROUP BY phrase) SELECT phrase, coalesce(n.n, 0) AS n FROM heads LEFT JOIN n USING (phrase)".replace("SIZES", "[2, 3, 4, 5, 8, 12, 16]"))
def phrase_attestation(spark, d):
    return statistics.phrase_attestation(A.lines(spark, d), A.headwords(spark, d))


@register("affix_attestation", f"WITH {WORDS} SELECT 'er-' AS affix, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS carriers FROM freq WHERE term LIKE 'er%' UNION ALL SELECT '-ing', CAST(sum(frequency) AS BIGINT), count(*) FROM freq WHERE term LIKE '%ing'")
def affix_attestation(spark, d):
    return statistics.affix_attestation(statistics.term_frequency(A.lines(spark, d)), ["er-", "-ing"])


@register("coverage_stats", f"WITH {WORDS} SELECT count(*) AS distinct_words, CAST(sum(frequency) AS BIGINT) AS running_words, count(*) FILTER (length(term) > 3) AS defined_words, CAST(coalesce(sum(frequency) FILTER (length(term) > 3), 0) AS BIGINT) AS defined_running FROM freq")
def coverage_stats(spark, d):
    frequency = statistics.term_frequency(A.lines(spark, d))
    return statistics.coverage(frequency, frequency.where(F.length("term") > 3))


@register("token_coverage", f"""WITH {TOKENS}, {PHRASES}, {GRAMS}, hits AS (SELECT ident, line_no, pos, n FROM grams JOIN heads USING (phrase)),
c AS (SELECT ident, line_no, unnest(range(CAST(pos AS BIGINT), CAST(pos + n AS BIGINT))) AS pos, n FROM hits), b AS (SELECT ident, line_no, pos, max(n) AS tier FROM c GROUP BY 1, 2, 3)
SELECT coalesce(tier, 0) AS tier, count(*) AS tokens FROM toks LEFT JOIN b USING (ident, line_no, pos) GROUP BY 1""".replace("SIZES", "[2, 3, 4]"))
def token_coverage(spark, d):
    return statistics.token_coverage(A.lines(spark, d), A.headwords(spark, d, (2, 3, 4)), most=4).groupBy("tier").agg(F.count("*").alias("tokens"))


@register("line_key_hash", f"WITH {TOKENS} SELECT ident, line_no, left(sha256(string_agg(term, ' ' ORDER BY pos)), 16) AS line_key FROM toks GROUP BY ident, line_no")
def line_key_hash(spark, d):
    own = search.once(A.lines(spark, d), "w", T.tokens(F.col("text"))).where(F.size("w") > 0)
    return own.select("ident", "line_no", T.line_key(F.col("w")).alias("line_key"))


@register("language_default", "SELECT doc_id AS ident, coalesce(nullif(lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN ' EN ' END)), ''), nullif(lower(trim(CASE WHEN doc_id % 2 = 0 THEN lang END)), ''), 'gv') AS language FROM documents")
def language_default(spark, d):
    own = A.documents(spark, d)
    cell = F.when(F.col("ident") % 3 == 0, " ").when(F.col("ident") % 3 == 1, " EN ")
    return own.select("ident", prepare.language(cell, F.when(F.col("ident") % 2 == 0, F.col("lang"))).alias("language"))


@register("speaker_extract", "SELECT conv_id, turn, upper(role) AS speaker, regexp_replace(text, '^\\s+', '') AS text FROM conversations WHERE role IN ('user', 'assistant')")
def speaker_extract(spark, d):
    own = A.table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    marked = own.withColumn("text", F.concat(F.lit(" ["), F.col("role"), F.lit("]  "), F.col("text")))
    who, rest = prepare.speaker(F.col("text"), ["user", "assistant"], F.lit(None).cast("string"))
    return marked.select("conv_id", "turn", who.alias("speaker"), rest.alias("text"))


@register("date_parse", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN make_date(CAST(1500 + o_orderkey % 600 AS BIGINT), 1, 1) ELSE o_orderdate END AS DATE) AS d FROM orders")
def date_parse(spark, d):
    cell = F.when(F.col("o_orderkey") % 3 == 0, "31/2/1880").when(F.col("o_orderkey") % 3 == 1, (1500 + F.col("o_orderkey") % 600).cast("string")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return A.table(spark, d, "orders").select("o_orderkey", dates.parse_cell(cell).alias("d"))


NOTED = "noted AS (SELECT o_custkey AS ident, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS own FROM orders), filled AS (SELECT ident, line_no, last_value(own IGNORE NULLS) OVER (PARTITION BY ident ORDER BY line_no) AS date FROM noted)"


@register("date_fill_forward", f"WITH {NOTED} SELECT ident, line_no, date FROM filled")
def date_fill_forward(spark, d):
    return prepare.line_dates(A.note_lines(spark, d)).select("ident", "line_no", "date")


@register("collection_span", f"WITH {NOTED} SELECT c_custkey AS ident, min(date) AS date_start, max(date) AS date_end FROM customer LEFT JOIN filled ON ident = c_custkey GROUP BY c_custkey")
def collection_span(spark, d):
    none = F.lit(None).cast("date")
    own = A.table(spark, d, "customer").select(F.col("c_custkey").alias("ident"), none.alias("date_start"), none.alias("date_end"))
    return prepare.collection_span(own, prepare.line_dates(A.note_lines(spark, d)).select("ident", "date"))


VERSES = """v AS (SELECT l_orderkey AS ident, l_linenumber AS line_no, l_returnflag AS text, l_orderkey % 50 + 1 AS c,
  max(CASE WHEN l_linenumber = 1 THEN 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS headed FROM lineitem),
r AS (SELECT ident, line_no, text, CASE WHEN line_no = 1 THEN 'genesis.' || c WHEN line_no = 3 AND headed IS NULL THEN NULL ELSE 'genesis.' || c || '.' || line_no END AS canonical_reference FROM v)"""


@register("reference_resolve", f"WITH {VERSES} SELECT ident, line_no, canonical_reference FROM r")
def reference_resolve(spark, d):
    return prepare.resolve_references(A.verse_lines(spark, d), F.lit("genesis")).select("ident", "line_no", "canonical_reference")


@register("verse_alignment", f"WITH {VERSES}, k AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY canonical_reference <> 'genesis.7.4', line_no) AS k FROM r WHERE canonical_reference IN ('genesis.7.4', 'genesis.7')) SELECT ident, line_no, canonical_reference FROM k WHERE k = 1")
def verse_alignment(spark, d):
    own = prepare.resolve_references(A.verse_lines(spark, d), F.lit("genesis"))
    return history.verse_alignment(own, "genesis.7.4").select("ident", "line_no", "canonical_reference")


BOOKS = ("genesis", "exodus", "leviticus")


@register("book_segments", """WITH n AS (SELECT doc_id % 5 AS ident, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS line_no FROM documents), b AS (
  SELECT ident, line_no, count(*) OVER (PARTITION BY ident) AS n, CASE WHEN line_no <= 3 THEN NULL WHEN line_no <= 10 THEN 'genesis' WHEN line_no <= 20 THEN 'exodus' ELSE 'leviticus' END AS book FROM n
), s AS (SELECT ident, book, min(line_no) AS start FROM b WHERE book IS NOT NULL AND n >= 30 GROUP BY 1, 2), e AS (SELECT ident, min(line_no) AS lo, max(line_no) AS hi FROM b GROUP BY 1)
SELECT ident, book, CASE WHEN row_number() OVER w = 1 THEN lo ELSE start END AS start, coalesce(lead(start) OVER w - 1, hi) AS "end" FROM s JOIN e USING (ident) WINDOW w AS (PARTITION BY ident ORDER BY start)""")
def book_segments(spark, d):
    from pyspark.sql import Window

    own = A.documents(spark, d).select((F.col("ident") % 5).alias("ident"), F.row_number().over(Window.partitionBy(F.col("ident") % 5).orderBy("ident")).alias("line_no"))
    key = F.when(F.col("line_no") <= 3, None).when(F.col("line_no") <= 10, "genesis.1").when(F.col("line_no") <= 20, "exodus.2.1").otherwise("leviticus.1.1")
    return history.book_segments(own.withColumn("canonical_reference", key), least=30)


@register("citation_extract", "SELECT l_orderkey AS ident, l_linenumber AS line_no, 'Gen. ' || (l_orderkey % 50 + 1) || '. ' || l_linenumber AS printed, 'genesis.' || (l_orderkey % 50 + 1) || '.' || l_linenumber AS key FROM lineitem")
def citation_extract(spark, d):
    item = A.table(spark, d, "lineitem")
    text = F.concat(F.lit("as it is in Gen. "), (F.col("l_orderkey") % 50 + 1).cast("string"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" written, not Hymn 5"))
    found = item.select(F.col("l_orderkey").alias("ident"), F.col("l_linenumber").alias("line_no"), F.explode(references.find_citations(text)).alias("printed"))
    return found.select("ident", "line_no", "printed", references.citation_key("printed").alias("key"))


@register("roman_numerals", "SELECT * FROM (VALUES ('xiv', 14), ('iiii', 4), ('mcmxc', 1990), ('abc', NULL)) t(numeral, value)")
def roman_numerals(spark, d):
    own = spark.createDataFrame([("xiv",), ("iiii",), ("mcmxc",), ("abc",)], "numeral string")
    return own.select("numeral", references.roman_number(F.col("numeral")).alias("value"))


LEMMAS = TOKENS + """, terms AS (SELECT DISTINCT term FROM toks WHERE term <> ''),
cand AS (SELECT term, term || '.n' AS lemma_id, term AS display FROM terms UNION ALL SELECT term, left(term, length(term) - 1) || '.v', left(term, length(term) - 1) FROM terms WHERE term LIKE '%s' AND length(term) > 1),
folded AS (SELECT term, trim(regexp_replace(strip_accents(term), '[-\\s]+', ' ', 'g'), ' .,;:''') AS key, lemma_id, display FROM cand),
ids AS (SELECT key, count(DISTINCT lemma_id) AS n FROM folded GROUP BY key),
tk AS (SELECT *, trim(regexp_replace(strip_accents(term), '[-\\s]+', ' ', 'g'), ' .,;:''') AS key FROM toks)"""


def tagged(spark, d):
    candidates, displays, links = lexicon.load(A.lemma_rows(spark, d))
    return lexicon.tagged(A.tokens(spark, d), candidates), candidates, displays, links


@register("lemma_candidates", f"WITH {LEMMAS} SELECT key, n FROM ids")
def lemma_candidates(spark, d):
    return lexicon.load(A.lemma_rows(spark, d))[0].select("key", F.size("ids").alias("n"))


@register("lemma_scan_distinct_positions", f"WITH {LEMMAS} SELECT ident, count(DISTINCT (line_no, pos)) AS uses FROM tk JOIN (SELECT DISTINCT key FROM folded WHERE lemma_id IN ('the.n', 'ha.v', 'ha.n')) USING (key) GROUP BY ident")
def lemma_scan_distinct_positions(spark, d):
    wanted = ["the.n", "ha.v", "ha.n"]
    forms = small(lexicon.holding(lexicon.load(A.lemma_rows(spark, d))[0], wanted))
    own = lexicon.tagged(A.tokens(spark, d), forms).where("ids is not null")
    return lexicon.scan_lemma(lexicon.postings(own), spark.createDataFrame([(x,) for x in wanted], "lemma_id string"))


@register("lemma_sure_scan", f"WITH {LEMMAS}, s AS (SELECT key, count(DISTINCT display) AS n FROM folded GROUP BY key) SELECT ident, count(*) AS sure FROM tk JOIN s USING (key) WHERE n = 1 GROUP BY ident")
def lemma_sure_scan(spark, d):
    lists, rows = A.listed_terms(spark, d)
    candidates, displays, _ = lexicon.load(rows)
    return lexicon.uses(lists, lexicon.sure_forms(candidates, displays)).withColumnRenamed("n", "sure")


@register("lemma_resolution_layers", f"WITH {LEMMAS} SELECT least(CASE WHEN key = 'has' THEN 1 ELSE n END, 6) AS candidates, count(*) AS tokens FROM tk LEFT JOIN ids USING (key) WHERE n IS NOT NULL GROUP BY 1")
def lemma_resolution_layers(spark, d):
    candidates = lexicon.load(A.lemma_rows(spark, d))[0]
    overrides = spark.createDataFrame([("has", ["ha.v"]), ("the", ["the.n"]), ("of", ["none.n"])], "form string, ids array<string>")
    own = lexicon.tagged(A.tokens(spark, d), candidates, overrides).where("ids is not null")
    return own.groupBy(F.least(F.size("ids"), F.lit(6)).alias("candidates")).agg(F.count("*").alias("tokens"))


@register("clitic_candidates", "SELECT * FROM (VALUES ('t''eh', 'ta eh'), ('v''ad', 'va ad'), ('dy''n', 'dy yn'), ('abc', '')) t(form, parts)")
def clitic_candidates(spark, d):
    own = spark.createDataFrame([("t'eh",), ("v'ad",), ("dy'n",), ("abc",)], "form string")
    return own.select("form", F.array_join(T.clitics(F.col("form")), " ").alias("parts"))


USES = "uses AS (SELECT term AS form, ident, year, count(*) AS n FROM toks WHERE term IN ('the', 'der', 'les') GROUP BY 1, 2, 3)"


def uses(spark, d):
    own = A.tokens(spark, d).where(F.col("term").isin("the", "der", "les"))
    return own.groupBy(F.col("term").alias("form"), "ident", "year").agg(F.count("*").alias("n"))


@register("history_by_form", f"""WITH {TOKENS}, {USES} SELECT form, CAST(sum(n) AS BIGINT) AS total, count(*) AS documents, min(year) AS earliest_year, arg_min(ident, (year, ident)) FILTER (year IS NOT NULL) AS earliest_ident,
  CAST(coalesce(sum(n) FILTER (year < 1900), 0) AS BIGINT) AS traditional, CAST(coalesce(sum(n) FILTER (year >= 1900), 0) AS BIGINT) AS revived, CAST(coalesce(sum(n) FILTER (year IS NULL), 0) AS BIGINT) AS undated FROM uses GROUP BY form""")
def history_by_form(spark, d):
    return history.history(uses(spark, d))


@register("decade_timeline", f"WITH {TOKENS}, {USES} SELECT CAST(year // 10 * 10 AS BIGINT) AS decade, count(DISTINCT ident) AS documents FROM uses WHERE year IS NOT NULL GROUP BY 1")
def decade_timeline(spark, d):
    return history.decades(uses(spark, d))


@register("earliest_attestation", f"WITH {TOKENS}, {USES}, f AS (SELECT form, min(year) AS y FROM uses GROUP BY form) SELECT arg_min(form, (form = 'der', y, form)) AS form FROM f")
def earliest_attestation(spark, d):
    forms = history.history(uses(spark, d)).withColumn("shared", F.col("form") == "der")
    return history.headline(forms)


@register("attestation_walk", f"WITH {TOKENS}, {USES} SELECT form, ident, year, n AS uses, CASE WHEN form = 'the' AND n > 1 THEN n ELSE 0 END AS sure_uses, row_number() OVER (PARTITION BY form ORDER BY year, ident) AS step FROM uses WHERE form = 'the' AND year IS NOT NULL")
def attestation_walk(spark, d):
    own = uses(spark, d).where("form = 'the'")
    return history.walk(own, own.where("n > 1"))


@register("near_match", f"""WITH {WORDS}, p AS (SELECT * FROM (VALUES ('eht'), ('thsi'), ('wtih'), ('ofthe'), ('nding'), ('benenuntionthe')) t(probe)),
s AS (SELECT probe, term AS word, damerau_levenshtein(probe, term) AS distance FROM p, freq WHERE length(probe) >= 4 AND length(term) >= 3 AND term <> probe AND abs(length(term) - length(probe)) <= 2),
r AS (SELECT probe, word, distance, row_number() OVER (PARTITION BY probe ORDER BY distance, left(word, 1) <> left(probe, 1), lower(word), word) AS k FROM s WHERE distance <= CASE WHEN length(probe) <= 5 THEN 1 ELSE 2 END)
SELECT probe, word, distance, k FROM r WHERE k <= 4""")
def near_match(spark, d):
    probes = spark.createDataFrame([("eht",), ("thsi",), ("wtih",), ("ofthe",), ("nding",), ("benenuntionthe",)], "probe string")
    return lexicon.near_matches(probes, statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("word")))


FOLD = r"trim(regexp_replace(strip_accents(lower(term)), '[-\s]+', ' ', 'g'), ' .,;:''')"
SORT = "translate(lower(term), 'ç-''’ ', 'c')"


@register("prefix_suggest", f"""WITH {WORDS}, k AS (SELECT {FOLD} AS key, arg_min(term, (term <> lower(term), term)) AS word, max(frequency) AS uses FROM freq GROUP BY 1)
SELECT word, uses FROM k WHERE starts_with(key, 'th') ORDER BY key <> 'th', uses DESC, lower(word), word LIMIT 10""")
def prefix_suggest(spark, d):
    own = statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("word"), F.col("frequency").alias("uses"))
    return lexicon.suggest(own, "th")


@register("did_you_mean", f"WITH {TOKENS} SELECT term, count(*) AS n FROM toks WHERE term <> 'o-f' AND {full('o-*f' + TAIL)} GROUP BY term ORDER BY n DESC, term LIMIT 5")
def did_you_mean(spark, d):
    return search.did_you_mean(A.lines(spark, d), "o-f").select("term", "n")


@register("fuzzy_tiers", f"WITH {WORDS} SELECT term AS word, CASE WHEN term = 'on' THEN 0 WHEN term LIKE 'on%' THEN 1 ELSE 2 END AS tier FROM freq WHERE term LIKE '%on%'")
def fuzzy_tiers(spark, d):
    return lexicon.fuzzy(statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("word")), "on")


@register("browse_chapters", f"""WITH {WORDS}, k AS (SELECT term AS word, {SORT} AS sort FROM freq)
SELECT left(sort, 1) AS letter, dense_rank() OVER (PARTITION BY left(sort, 1) ORDER BY left(sort, 2)) AS chapter, left(sort, 2) AS head, word FROM k WHERE sort <> ''""")
def browse_chapters(spark, d):
    return lexicon.browse(statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("word")))


@register("neighbours", f"""WITH {WORDS}, k AS (SELECT term AS word, frequency, {SORT} AS sort FROM freq) SELECT word, lag(word) OVER w AS before, lead(word) OVER w AS after,
  last_value(CASE WHEN frequency > 1 THEN word END IGNORE NULLS) OVER (ORDER BY sort, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attested_before,
  first_value(CASE WHEN frequency > 1 THEN word END IGNORE NULLS) OVER (ORDER BY sort, word ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS attested_after
FROM k WINDOW w AS (ORDER BY sort, word)""")
def neighbours(spark, d):
    own = statistics.term_frequency(A.lines(spark, d))
    return lexicon.neighbours(own.select(F.col("term").alias("word"), (F.col("frequency") > 1).alias("attested")))


@register("filed_position", f"""WITH {WORDS}, k AS (SELECT term AS word, {SORT} AS sort, row_number() OVER (ORDER BY {SORT}, term) AS rank FROM freq),
p AS (SELECT probe, translate(lower(probe), 'ç-''’ ', 'c') AS key FROM (VALUES ('the'), ('thez-z'), ('0'), ('~zz'), ('çhenn')) t(probe)),
q AS (SELECT probe, (SELECT rank FROM k WHERE word = probe) AS own, (SELECT count(*) FROM k WHERE (sort, word) < (key, probe)) AS under FROM p)
SELECT probe, CAST(o AS INT) AS "offset", word FROM (SELECT probe, o, CASE WHEN own IS NOT NULL THEN own + o WHEN o < 0 THEN under + 1 + o WHEN o > 0 THEN under + o END AS rank FROM q, (SELECT unnest(range(-3, 4)) AS o)) JOIN k USING (rank)""")
def filed_position(spark, d):
    own = statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("word"), F.lit(True).alias("attested"))
    return lexicon.around(own, spark.createDataFrame([("the",), ("thez-z",), ("0",), ("~zz",), ("çhenn",)], "probe string"), span=3)


@register("stratified_sample", f"""WITH {WORDS}, b AS (SELECT term AS word, frequency AS uses, CASE WHEN frequency < 10 THEN 1 WHEN frequency < 100 THEN 2 ELSE 3 END AS band FROM freq),
k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(word || '|7'), word) AS k FROM b) SELECT band, word, uses FROM k WHERE k <= 3""")
def stratified_sample(spark, d):
    return lexicon.banded_sample(statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("word"), F.col("frequency").alias("uses")))


@register("tag_tree", "SELECT doc_id AS ident FROM documents WHERE source LIKE 'src1%' AND NOT coalesce(lang = 'fr', FALSE)")
def tag_tree(spark, d):
    own = A.documents(spark, d)
    tags = F.array_compact(F.array(F.when(F.col("name").startswith("src1"), "papers"), F.when(F.col("lang") == "fr", "papers::fr")))
    return lexicon.tag_tree(own.select("ident", F.explode(tags).alias("tag")), "papers::fr", "papers")


@register("dedup_ident", "WITH o AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id // 3 END AS ident FROM documents) SELECT ident, min(doc_id) AS load_order FROM o WHERE ident IS NOT NULL GROUP BY ident UNION ALL SELECT ident, doc_id FROM o WHERE ident IS NULL")
def dedup_ident(spark, d):
    own = A.documents(spark, d).select(F.when(F.col("ident") % 10 != 0, F.floor(F.col("ident") / 3)).alias("ident"), F.col("ident").alias("load_order"))
    return prepare.keep_first(own)


@register("contributors", "SELECT p AS name, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest([source, lang]) AS p FROM documents) WHERE p IS NOT NULL GROUP BY p")
def contributors(spark, d):
    own = A.documents(spark, d)
    return lexicon.contributors(own.select("ident", F.concat_ws(" & ", F.concat("name", F.lit(" (ed.)")), F.concat("lang", F.lit(", 1901"))).alias("credit")))


@register("equivalence_components", """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey // 2 - o_custkey % 10 AS b FROM orders),
w(node, up) AS (SELECT a, b FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.up)
SELECT node, min(up) AS root FROM (SELECT node, up FROM w UNION ALL SELECT up, up FROM w) GROUP BY node""")
def equivalence_components(spark, d):
    return lexicon.components(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.expr("o_orderkey div 2 - o_custkey % 10").alias("b")))


@register("ambiguity_histogram", f"WITH {LEMMAS} SELECT least(coalesce(n, 0), 6) AS candidates, count(*) AS tokens, CAST(sum(coalesce(n, 0)) AS BIGINT) AS postings FROM tk LEFT JOIN ids USING (key) GROUP BY 1")
def ambiguity_histogram(spark, d):
    return harness.ambiguity_histogram(tagged(spark, d)[0])


@register("cumulative_share", f"WITH {WORDS}, k AS (SELECT frequency, row_number() OVER (ORDER BY frequency DESC, term) AS k FROM freq), t AS (SELECT unnest([10, 25, 50, 100, 200, 500, 1000]) AS top) SELECT top, CAST(floor(1000 * sum(frequency) FILTER (k <= top) / sum(frequency)) AS BIGINT) AS share FROM t, k GROUP BY top")
def cumulative_share(spark, d):
    return harness.cumulative_share(statistics.term_frequency(A.lines(spark, d)).select(F.col("term").alias("form"), F.col("frequency").alias("n")))


@register("decisive_majority", "WITH o AS (SELECT l_suppkey AS form, l_returnflag AS lemma, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT form, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, arg_max(lemma, (n, lemma)) AS lemma FROM o GROUP BY form HAVING sum(n) >= 3 AND max(n) / sum(n) >= 0.35")
def decisive_majority(spark, d):
    own = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("form"), F.col("l_returnflag").alias("lemma")).agg(F.count("*").alias("n"))
    return harness.decisive(own, share=0.35)


@register("adoption_gate", "WITH g AS (SELECT l_partkey AS form, count(*) FILTER (l_quantity < 50) AS upheld, count(*) AS judged FROM lineitem GROUP BY 1) SELECT form, CASE WHEN judged < 10 THEN 'too few' WHEN upheld = judged THEN NULL WHEN judged >= 50 AND upheld >= 0.98 * judged THEN NULL ELSE 'contested' END AS refusal FROM g")
def adoption_gate(spark, d):
    own = A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("form")).agg(F.count_if(F.col("l_quantity") < 50).alias("upheld"), F.count("*").alias("judged"))
    return own.select("form", harness.refusal(F.col("upheld"), F.col("judged")).alias("refusal"))


@register("precision_coverage", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'dev' END AS split, count(*) AS eligible, count(CASE WHEN quality = 1 THEN 1 END) AS resolved, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS correct FROM labels GROUP BY 1")
def precision_coverage(spark, d):
    own = A.table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "test").otherwise("dev").alias("split"), F.when(F.col("quality") == 1, F.lit(1)).alias("answer"), F.col("toxic").alias("gold"))
    return harness.precision(own)


@register("gloss_scorer", "SELECT o_orderkey AS token, CASE WHEN o_orderkey % 4 = 0 THEN 'a.n' ELSE 'b.n' END AS ids FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def gloss_scorer(spark, d):
    words = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("fish"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("boat"), F.lit("sea"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("fish"), F.lit("sea"))).otherwise(F.array().cast("array<string>"))
    own = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.array(F.lit("a.n"), F.lit("b.n")).alias("ids"), words.alias("words"))
    glosses = spark.createDataFrame([("a.n", ["fish", "eel"]), ("b.n", ["sea"])], "lemma_id string, gloss array<string>")
    return harness.gloss_scores(own, glosses).select("token", F.array_join("ids", ",").alias("ids"))


@register("html_entry_text", "SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS text FROM pages")
def html_entry_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@register("lemma_tree", f"""WITH RECURSIVE {LEMMAS}, e AS (SELECT DISTINCT display AS parent, term AS child FROM cand WHERE display <> term),
t(root, form, depth) AS (SELECT parent, child, 1 FROM e UNION ALL SELECT t.root, e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.form WHERE t.depth < 6)
SELECT root, form, depth FROM t""")
def lemma_tree(spark, d):
    _, displays, links = lexicon.load(A.lemma_rows(spark, d))
    return lexicon.tree(links, displays).select("root", F.element_at("path", -1).alias("form"), "depth")


@register("near_spelling_similarity", "SELECT n_name AS name, CAST(floor(1000 * (1 - levenshtein(n_name, 'NATION') / greatest(length(n_name), 6))) AS BIGINT) AS similarity FROM nation")
def near_spelling_similarity(spark, d):
    return A.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.floor(1000 * similarity.similarity(F.col("n_name"), F.lit("NATION"))).alias("similarity"))


def queries() -> dict[str, Query]:
    from concord.plans import lexical  # noqa: F401  (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from concord.plans import lexical  # noqa: F401

    return dict(SQL)
