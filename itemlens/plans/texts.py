"""Terms and mentions over the text tables."""

from pyspark.sql import functions as F

from itemlens.operators import mentions as M
from itemlens.operators import terms as T
from itemlens.plans.base import Suite
from itemlens.plans.cleaning import (
    SQL_TERMS, SQL_TOKENS, TEXT_STOP, TEXT_SUFFIXES, TEXT_TERMS, sql_title_words,
)
from itemlens.session import table, texts

suite = Suite()


def sql_term_counts(group: str) -> str:
    return f"""
    WITH toks AS (SELECT {group} AS g, doc_id AS o, {SQL_TOKENS} AS t FROM documents),
    pos AS (SELECT g, o, unnest(range(1, len(t) + 1)) AS p, t FROM toks),
    words AS (SELECT g, t[p] AS w, count(*) AS n, min((o, p)) AS first FROM pos GROUP BY ALL),
    pairs AS (SELECT g, t[p] || ' ' || t[p + 1] AS w, count(*) AS n FROM pos WHERE p < len(t) GROUP BY ALL HAVING count(*) >= 3),
    subs AS (SELECT g, w, first, unnest(list_distinct(flatten(list_transform(range(1, len(w) - 1),
               lambda i: list_transform(range(3, len(w) - i + 2), lambda k: substr(w, i, k)))))) AS s FROM words),
    in_pair AS (SELECT DISTINCT g, unnest(string_split(w, ' ')) AS w FROM pairs),
    ruled AS (
      SELECT s.g, s.s AS w FROM subs s JOIN words u ON u.g = s.g AND u.w = s.s WHERE s.first < u.first
      UNION SELECT s.g, s.s FROM subs s JOIN in_pair i ON i.g = s.g AND i.w = s.w)
    SELECT g, w AS term, n AS count FROM pairs
    UNION ALL SELECT g, w, n FROM words ANTI JOIN ruled USING (g, w)
    """


@suite.add(f"SELECT term, count FROM ({sql_term_counts(chr(39) + 'ALL' + chr(39))}) ORDER BY count DESC, term LIMIT 30")
def top_terms(spark, d):
    return T.top_terms(texts(spark, d, "documents"), "text", "doc_id").select("term", "count")


@suite.add(f"""
SELECT g AS source, term, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY count DESC, term) AS rank FROM ({sql_term_counts('source')})) WHERE rank <= 12
""")
def top_terms_by_group(spark, d):
    return T.top_terms_by_group(texts(spark, d, "documents"), "source", "text", "doc_id")


SQL_PAIRS = f"""
SELECT pair, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM (SELECT {SQL_TOKENS} AS t FROM documents))
GROUP BY pair HAVING count(*) >= 3
"""


@suite.add(SQL_PAIRS)
def frequent_bigrams(spark, d):
    return T.frequent_bigrams(texts(spark, d, "documents", "doc_id", "text"), "text", "doc_id")


# the first variant of a term is the one whose place (document, pattern, place) comes first
SQL_NAMED = f"""
SELECT first(term ORDER BY doc_id, pat, pos, term) AS term, count(*) AS count FROM (
  SELECT *, lower(regexp_replace(term, '(?i)\\s+(License|Public)$', '')) AS base,
         row_number() OVER (PARTITION BY doc_id, pat) AS pos FROM ({SQL_TERMS}))
GROUP BY base
"""


def named(spark, d):
    return T.named_term_counts(texts(spark, d, "documents"), "text", ["doc_id"], TEXT_TERMS, TEXT_SUFFIXES, TEXT_STOP)


@suite.add(SQL_NAMED)
def named_term_counts(spark, d):
    return named(spark, d)


SQL_FREQUENT = f"SELECT * FROM (SELECT * FROM ({SQL_NAMED}) ORDER BY count DESC, term LIMIT 80) WHERE count >= 8"


@suite.add(SQL_FREQUENT)
def frequent_named_terms(spark, d):
    return T.frequent_named_terms(named(spark, d))


# press titles: each turn of a conversation, each benchmark text, and the last line of each document
SQL_TITLES = "SELECT text AS title FROM conversations UNION ALL SELECT text FROM benchmark UNION ALL SELECT string_split(text, chr(10))[-1] FROM documents"


def press_titles(spark, d):
    last = F.element_at(F.split("text", "\n"), -1)
    return (table(spark, d, "conversations").select(F.col("text").alias("title")).union(table(spark, d, "benchmark").select("text"))
            .union(table(spark, d, "documents").select(last)))


@suite.add(f"""
WITH terms AS ({SQL_FREQUENT}), titles AS ({SQL_TITLES})
SELECT term, any_value(count) AS count, count(title) AS press_mentions
FROM terms LEFT JOIN titles ON contains(lower(title), lower(term)) GROUP BY term
""")
def count_title_mentions(spark, d):
    return M.count_title_mentions(
        press_titles(spark, d), "title", T.frequent_named_terms(named(spark, d)), "term", "press_mentions")


def sql_side(cond: str) -> str:
    return f"""
    WITH terms AS ({SQL_FREQUENT}), titles AS ({SQL_TITLES}),
    n AS (SELECT term, any_value(count) AS item_mentions, count(title) AS press_mentions
          FROM terms LEFT JOIN titles ON contains(lower(title), lower(term)) GROUP BY term)
    SELECT * FROM n WHERE press_mentions {cond}
    """


def press_comparison(spark, d):
    from itemlens.operators.comparison import scheme_press_comparison

    return scheme_press_comparison(named(spark, d), press_titles(spark, d), "title")


@suite.add(sql_side(">= 0 AND item_mentions >= 8"))
def scheme_press_comparison(spark, d):
    return press_comparison(spark, d)


@suite.add(sql_side("= 0"))
def terms_on_one_side(spark, d):
    from itemlens.operators.comparison import split_by_side

    return split_by_side(press_comparison(spark, d))[0]


@suite.add(sql_side("> 0"))
def terms_on_both_sides(spark, d):
    from itemlens.operators.comparison import split_by_side

    return split_by_side(press_comparison(spark, d))[1]


SQL_CORPUS = "SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark"


def corpus(spark, d):
    return M.build_corpus(*[texts(spark, d, t, "text") for t in ("documents", "conversations", "benchmark")])


@suite.add(f"SELECT length(text) AS n_chars, count(*) AS n FROM ({SQL_CORPUS}) GROUP BY ALL")
def build_corpus(spark, d):
    return corpus(spark, d).groupBy(F.length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


# fixed entries in the shape of the graded schemes: a name and its patterns
ENTRIES = [
    ("licence", [r"Apache.{0,20}License", r"General Public"]),
    ("person", [r"[a-z]+@[a-z]+", r"\d{3}-\d{4}"]),
    ("the of", [r"the of"]),
    ("tion end", [r"tion\."]),
    ("absent", [r"zzzz", r"qqqq"]),
]
SQL_ENTRIES = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS mentions FROM ({SQL_CORPUS}) WHERE regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in ps)}')"
    for n, ps in ENTRIES)


@suite.add(SQL_ENTRIES)
def count_pattern_mentions(spark, d):
    return M.count_pattern_mentions(corpus(spark, d), "text", ENTRIES)


@suite.add(rf"""
WITH titles AS (SELECT DISTINCT title, lower(array_to_string(words, ' ')) AS needle, array_to_string(words, '\s+') AS pattern
                FROM ({sql_title_words()}) WHERE len(words) >= 2),
flat AS (SELECT regexp_replace(lower(text), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g') AS text FROM documents)
SELECT title, any_value(pattern) AS pattern, count(text) AS mentions FROM titles LEFT JOIN flat ON contains(text, needle) GROUP BY title
""")
def count_catalogue_mentions(spark, d):
    titles = table(spark, d, "benchmark").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"))
    return M.count_catalogue_mentions(texts(spark, d, "documents"), "text", titles, "title")


@suite.add(f"""
WITH terms AS (SELECT DISTINCT p_name AS term FROM part UNION ALL SELECT DISTINCT lang FROM documents UNION ALL SELECT 'zzqx' UNION ALL SELECT NULL)
SELECT term, CASE WHEN term IS NOT NULL THEN EXISTS (SELECT 1 FROM ({SQL_TITLES}) WHERE contains(lower(title), lower(term))) END AS mentioned
FROM terms
""")
def flag_mentioned(spark, d):
    extra = spark.createDataFrame([("zzqx",), (None,)], "term STRING")
    names = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().union(
        table(spark, d, "documents").select("lang").distinct()).union(extra)
    return M.flag_mentioned(names, "term", press_titles(spark, d), "title")


# each part text names a graded scheme by one of its plain words
SQL_NAMING = """
SELECT CASE p_size % 4 WHEN 0 THEN 'about IT hardware and ' || p_name WHEN 1 THEN p_name || ' made of speciality or Specialty  steel'
  WHEN 2 THEN 'Bulk Drug park, white GOODS' ELSE p_name END AS text FROM part
"""


@suite.add(f"""
SELECT name, (SELECT count(*) FROM ({SQL_NAMING}) WHERE regexp_matches(text, '(?i)' || pattern)) AS mentions FROM (VALUES
  {', '.join("('" + n.replace("'", "''") + "', '" + '|'.join(f'(?:{p})' for p in ps).replace("'", "''") + "')" for n, ps in M.GRADED)}) v(name, pattern)
""")
def graded_mentions(spark, d):
    """The fixed table of graded schemes against texts, some of which name one."""
    way = F.col("p_size") % 4
    text = (F.when(way == 0, F.concat(F.lit("about IT hardware and "), "p_name"))
            .when(way == 1, F.concat("p_name", F.lit(" made of speciality or Specialty  steel")))
            .when(way == 2, F.lit("Bulk Drug park, white GOODS")).otherwise(F.col("p_name")))
    return M.count_pattern_mentions(table(spark, d, "part").select(text.alias("text")), "text")
