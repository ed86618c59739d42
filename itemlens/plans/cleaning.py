"""Column functions over whole tables."""

from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions import labels as L
from itemlens.functions import text as T
from itemlens.functions import values as V
from itemlens.plans.base import Suite, sql_ascii, sql_flat, sql_trim
from itemlens.session import table, texts

suite = Suite()

GROUPS = {"HOUSEHOLD": "Home", "AUTOMOBILE": "Cars"}


@suite.add(f"""
SELECT c_custkey, CASE upper({sql_trim('g')}) WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'AUTOMOBILE' THEN 'Cars'
       ELSE {sql_trim('g')} END AS party
FROM (SELECT c_custkey, '  ' || lower(c_mktsegment) || ' ' AS g FROM customer)
""")
def canonical_group(spark, d):
    raw = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", L.canonical_group(raw, GROUPS).alias("party"))


@suite.add("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Delhi' ELSE 'nct of ' || c_mktsegment END AS state
FROM customer
""")
def canonical_region(spark, d):
    raw = F.concat(F.lit(" nct   of  "), F.col("c_mktsegment"), F.lit("  "))
    return table(spark, d, "customer").select(
        "c_custkey", L.canonical_region(raw, {"NCT OF BUILDING": "Delhi"}).alias("state"))


@suite.add("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'Unknown' WHEN p_brand = 'Brand#1' THEN 'FIRST BRAND'
       ELSE upper(p_brand) || ', ' || p_type || ' AND ' || upper(p_name) END AS ministry
FROM part
""")
def canonical_target(spark, d):
    raw = F.when(F.col("p_type") != "PROMO", F.when(F.col("p_brand") == "Brand#1", F.lit(" Brand # 1")).otherwise(
        F.concat(F.lit(" "), "p_brand", F.lit(",  "), F.lower("p_type"), F.lit("&"), F.lit("  "), "p_name")))
    return table(spark, d, "part").select(
        "p_partkey", L.canonical_target(raw, {"BRAND # 1": "FIRST BRAND"}).alias("ministry"))


@suite.add(rf"""
SELECT page_id, nullif({sql_trim(sql_flat(
    "replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')"))}, '') AS plain
FROM pages
""")
def strip_html(spark, d):
    return texts(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@suite.add(rf"""
SELECT page_id, {sql_trim(sql_flat("regexp_replace(html, '<[^>]+>', ' ', 'g')"))} AS plain FROM pages
""")
def strip_html_keep_empty(spark, d):
    return texts(spark, d, "pages").select("page_id", T.strip_html(F.col("html"), False).alias("plain"))


@suite.add("""
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'justice' WHEN 'ECONOMY' THEN 'drake ' || p_name ELSE p_name END AS name
FROM part
""")
def normalize_name(spark, d):
    t, n = F.col("p_type"), F.col("p_name")
    raw = (
        F.when(t == "SMALL", F.lit("Justice")).when(t == "ECONOMY", F.concat(F.lit("Drake  "), F.initcap(n)))
        .when(t == "PROMO", F.concat(F.lit(" Smt. Dr. Prof. "), F.upper(n)))
        .when(t == "LARGE", F.concat(F.lit("SHRI  "), F.initcap(n), F.lit(" "))).otherwise(n)
    )
    return table(spark, d, "part").select("p_partkey", L.normalize_name(raw).alias("name"))


SQL_TOKENS = ("list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: NOT list_contains(["
              + ", ".join(f"'{w}'" for w in K.SUBJECT_STOPWORDS) + "], w))")


@suite.add(f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {SQL_TOKENS} AS t FROM documents)
""")
def tokenize(spark, d):
    return texts(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@suite.add(f"""
SELECT doc_id, coalesce(array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), ';'), '') AS pairs
FROM (SELECT doc_id, {SQL_TOKENS} AS t FROM documents)
""")
def bigrams(spark, d):
    return texts(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select(
        "doc_id", F.array_join(T.bigrams(F.col("t")), ";").alias("pairs"))


@suite.add("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE n_name || ' AND ' || c_mktsegment || ' GOODS' END AS label
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def normalize_label(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    raw = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(
        F.lit(" ministry of "), "n_name", F.lit(" & "), F.lower("c_mktsegment"), F.lit(",goods. - Department of "), "c_name"))
    return c.select("c_custkey", L.normalize_label(raw).alias("label"))


@suite.add("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Built Up' WHEN 'MACHINERY' THEN 'Unknown'
       ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' And O''Neil ' || upper(n_name[1]) || lower(n_name[2:]) END AS region
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def normalize_region_title(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    seg = F.col("c_mktsegment")
    raw = F.when(seg == "BUILDING", F.lit(" the building ")).when(seg == "MACHINERY", F.lit("")).otherwise(
        F.concat(F.lit(" "), seg, F.lit(" AND o'neil "), "n_name"))
    return c.select("c_custkey", L.normalize_region_title(raw, {"THE BUILDING": "Built Up"}).alias("region"))


@suite.add("""
SELECT l_returnflag, CASE l_returnflag WHEN 'N' THEN 'UNKNOWN' ELSE l_returnflag END AS type, count(*) AS n
FROM lineitem GROUP BY ALL
""")
def normalize_type(spark, d):
    raw = F.when(F.col("l_returnflag") == "N", F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_returnflag", L.normalize_type(raw).alias("type")).agg(
        F.count(F.lit(1)).alias("n"))


@suite.add("""
SELECT doc_id, len(a) AS n_askers, a[1] AS lead, array_to_string(a, '; ') AS joined
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS a
      FROM documents WHERE NOT contains(text, ';') UNION ALL
      SELECT doc_id, list_filter(list_transform(string_split(replace(text, ' ', ';'), ';'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')
      FROM documents WHERE contains(text, ';'))
""")
def split_askers(spark, d):
    askers = V.split_askers(F.replace("text", F.lit(" "), F.lit(";")))
    return texts(spark, d, "documents").select("doc_id", askers.alias("a")).select(
        "doc_id", F.size("a").cast("long").alias("n_askers"), V.lead_asker(F.col("a")).alias("lead"),
        V.join_askers(F.col("a")).alias("joined"))


@suite.add("""
SELECT ques_no, member, n_lines FROM (
  SELECT l_orderkey AS ques_no, l_suppkey AS member, count(*) OVER (PARTITION BY l_orderkey) AS n_lines,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem)
WHERE rn = 1
""")
def lead_asker(spark, d):
    first = F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ques_no")).agg(
        first.alias("member"), F.count(F.lit(1)).alias("n_lines"))


@suite.add("""
SELECT CASE p_type WHEN 'PROMO' THEN 'Unknown' WHEN 'LARGE' THEN 'Unknown' ELSE p_type END AS type, count(*) AS n
FROM part GROUP BY ALL
""")
def fill_unknown(spark, d):
    t = F.col("p_type")
    raw = F.when(t == "PROMO", F.lit("")).when(t != "LARGE", t)
    return table(spark, d, "part").groupBy(L.or_unknown(raw).alias("type")).agg(F.count(F.lit(1)).alias("n"))


# the document texts are invented prose; names in them are runs of capitalised words
TEXT_TERMS = [
    r"\b[A-Z][A-Za-z\-]*(?: [A-Z][A-Za-z\-]*){1,3}\b",
    r"\b[A-Z][A-Za-z\-]*(?: [A-Z][A-Za-z\-]*){0,3} License\b",
]
TEXT_STOP = ["general public"]
TEXT_SUFFIXES = ["License", "Public"]

SQL_TERM_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS pat, unnest(regexp_extract_all({sql_ascii('text')}, '{p}')) AS term FROM documents"
    for i, p in enumerate(TEXT_TERMS))
SQL_TERMS = f"""
SELECT doc_id, pat, {sql_trim(sql_flat('term'))} AS term FROM ({SQL_TERM_HITS})
WHERE length({sql_trim(sql_flat('term'))}) >= 6 AND lower({sql_trim(sql_flat('term'))}) <> 'general public'
"""


@suite.add(f"SELECT doc_id, term, count(*) AS n FROM ({SQL_TERMS}) GROUP BY ALL")
def extract_named_terms(spark, d):
    terms = T.extract_named_terms(F.col("text"), TEXT_TERMS, TEXT_STOP)
    return texts(spark, d, "documents").select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


@suite.add(f"SELECT DISTINCT term, lower(regexp_replace(term, '(?i)\\s+(License|Public)$', '')) AS base FROM ({SQL_TERMS})")
def collapse_suffix(spark, d):
    terms = T.extract_named_terms(F.col("text"), TEXT_TERMS, TEXT_STOP)
    return texts(spark, d, "documents").select(F.explode(terms).alias("term")).distinct().select(
        "term", T.collapse_suffix(F.col("term"), TEXT_SUFFIXES).alias("base"))


SQL_STOP = "[" + ", ".join(f"'{w}'" for w in K.CATALOGUE_STOPWORDS) + "]"


def sql_words(x: str) -> str:
    """First four significant words of a text without hyphens."""
    return (rf"list_filter(regexp_extract_all({sql_ascii(x)}, '\w+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+') "
            rf"AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({SQL_STOP}, lower(w)))[1:4]")


@suite.add(f"SELECT item_id, array_to_string({sql_words('text')}, ' ') AS words FROM benchmark")
def significant_words(spark, d):
    return table(spark, d, "benchmark").select(
        "item_id", F.array_join(T.significant_words(F.col("text")), " ").alias("words"))


# a title is a benchmark text on one line; none has a bracketed acronym
def sql_title_words() -> str:
    return f"""
    SELECT item_id, title, CASE WHEN len(tail) >= 2 THEN tail ELSE head END AS words FROM (
      SELECT item_id, title, {sql_words("regexp_extract(title, '(?i)\\s+(?:for|of)\\s+(.+)$', 1)")} AS tail,
             {sql_words('title')} AS head
      FROM (SELECT item_id, replace(text, chr(10), ' ') AS title FROM benchmark))
    """


@suite.add(f"SELECT item_id, array_to_string(words, '\\s+') AS pattern FROM ({sql_title_words()})")
def derive_pattern(spark, d):
    title = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, d, "benchmark").select("item_id", T.derive_pattern(title).alias("pattern"))


@suite.add("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS outlay FROM customer")
def extract_outlay(spark, d):
    raw = F.concat(F.lit("An outlay of rs. "), F.col("c_acctbal").cast("string"), F.lit(" CRORE over 5 years"))
    return table(spark, d, "customer").select("c_custkey", T.extract_outlay(raw).alias("outlay"))


@suite.add("""
SELECT o_orderkey, round(date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 30.44, 1)::DOUBLE AS months FROM orders
""")
def months_since(spark, d):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", V.months_since(raw, "2002-01-01").alias("months"))


# what a project is called in the proposal stand-in
def project_name():
    t = F.col("p_type")
    who = F.concat(F.upper("p_name"), F.lit(" Ltd"))
    return (
        F.when(t == "PROMO", F.concat(F.lit("Untitled plant of "), "p_brand"))
        .when(t == "SMALL", F.concat(F.lit("Unit by "), F.lower("p_name")))
        .when(t == "LARGE", F.concat(F.lit("Growth by adding stages by M/s. "), who, F.lit(".")))
        .otherwise(F.concat(F.lit("Expansion by M/s "), who, F.lit(" at "), "p_brand")))


SQL_PROJECT = """CASE p_type WHEN 'PROMO' THEN 'Untitled plant of ' || p_brand WHEN 'SMALL' THEN 'Unit by ' || lower(p_name)
  WHEN 'LARGE' THEN 'Growth by adding stages by M/s. ' || upper(p_name) || ' Ltd.'
  ELSE 'Expansion by M/s ' || upper(p_name) || ' Ltd at ' || p_brand END"""
SQL_COMPANY = "CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN upper(p_name) || ' Ltd' END"


@suite.add(f"SELECT p_partkey, {SQL_PROJECT} AS project_name, {SQL_COMPANY} AS company FROM part")
def extract_company(spark, d):
    return table(spark, d, "part").withColumn("project_name", project_name()).select(
        "p_partkey", "project_name", T.extract_company(F.col("project_name")).alias("company"))


@suite.add("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS activity FROM events")
def extract_activity(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "click", F.col("props")).when(kind == "view", F.lit("not json")).otherwise(F.concat(
        F.lit('[{"label":"Other","value":"x"},{"label":"Activity","value":"'), kind, F.lit('"}]')))
    return table(spark, d, "events").select("event_id", T.extract_activity(raw).alias("activity"))


@suite.add("SELECT o_orderkey, o_orderstatus = 'F' AS granted FROM orders")
def is_granted(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", F.lit("EC Granted")).when(
        F.col("o_orderstatus") == "O", F.lit("Under Examination"))
    return table(spark, d, "orders").select("o_orderkey", V.is_granted(status).alias("granted"))


@suite.add("""
SELECT l_orderkey, round(count(*) FILTER (WHERE l_linestatus = 'O') / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 3)::DOUBLE AS ratio
FROM lineitem GROUP BY l_orderkey
""")
def safe_ratio(spark, d):
    n = lambda s: F.count_if(F.col("l_linestatus") == s)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(V.safe_ratio(n("O"), n("F")).alias("ratio"))


@suite.add("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 0.0
       ELSE round(100.0 * c_custkey / (c_custkey + 3), 2)::DOUBLE END AS pct FROM customer
""")
def percent_paid(spark, d):
    seg = F.col("c_mktsegment")
    paid = F.when(seg != "MACHINERY", F.col("c_custkey"))
    outlay = F.when(seg == "BUILDING", F.lit(0)).otherwise(F.col("c_custkey") + 3)
    return table(spark, d, "customer").select("c_custkey", V.percent_paid(paid, outlay).alias("pct"))


@suite.add("""
SELECT p_type, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 4 WHEN 'LARGE' THEN 5 WHEN 'MEDIUM' THEN 7 ELSE 99 END AS pos,
       count(*) AS n FROM part GROUP BY ALL
""")
def grade_order(spark, d):
    t = F.col("p_type")
    grade = F.when(t == "PROMO", "A").when(t == "SMALL", "C+").when(t == "LARGE", "D+").when(t == "MEDIUM", "F").when(
        t == "ECONOMY", "E")
    return table(spark, d, "part").groupBy("p_type", V.grade_order(grade).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


@suite.add("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day_or_blank
FROM events
""")
def date_prefix(spark, d):
    raw = F.col("ts").cast("string")
    return table(spark, d, "events").select(
        "event_id", V.date_prefix(raw).alias("day"),
        V.date_prefix(F.when(F.col("event_type") != "error", raw), True).alias("day_or_blank"))


@suite.add("SELECT page_id, split_part(url, ':', 1) AS type, substr(url, instr(url, ':') + 1) AS label FROM pages")
def split_node_id(spark, d):
    return texts(spark, d, "pages").select("page_id", V.split_node_id(F.col("url")).alias("s")).select("page_id", "s.*")


@suite.add("""
SELECT l_suppkey, l_linestatus, coalesce(100.0 * s / nullif(s + u, 0), 0)::DOUBLE AS share FROM (
  SELECT l_suppkey, l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS u
  FROM lineitem GROUP BY l_suppkey, l_linestatus)
""")
def starred_share(spark, d):
    """Open lines have neither flag, so each supplier has a share of none."""
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(V.starred_share(n("A"), n("R")).alias("share"))


@suite.add("SELECT o_orderkey, round(o_totalprice * 1000 / 1e7, 0)::DOUBLE AS crore FROM orders")
def in_crore(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.in_crore(F.col("o_totalprice") * 1000).alias("crore"))
