"""Graded schemes, catalogues and proposals."""

from pyspark.sql import functions as F

from itemlens.operators import comparison as O
from itemlens.operators import counting as C
from itemlens.operators.mentions import count_pattern_mentions
from itemlens.plans.base import ITEMS, Suite, askers, items
from itemlens.plans.cleaning import SQL_COMPANY, SQL_PROJECT, project_name, sql_title_words
from itemlens.plans.counting import LAST
from itemlens.plans.people import SQL_REGISTRY, registry
from itemlens.plans.texts import ENTRIES, SQL_ENTRIES, corpus
from itemlens.session import table, texts

suite = Suite()

# --- graded schemes: the fixed text entries, graded by part type ---
SCHEME_OF = {"PROMO": "licence", "SMALL": "person", "LARGE": "the of", "MEDIUM": "tion end", "ECONOMY": "not asked", "STANDARD": "nor this"}
GRADE_OF = {"PROMO": "B-", "SMALL": "A", "LARGE": "F", "MEDIUM": "D+", "ECONOMY": "C", "STANDARD": "B"}
TARGET_OF = {"licence": "NATION_1", "person": "NATION_2", "the of": "NATION_3", "tion end": "NOWHERE", "absent": "NATION_4"}


def card(spark, d):
    pick = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("p_type")]
    paid = F.sum(F.when(F.col("p_type") != "MEDIUM", F.col("p_size") - 1))
    return (
        table(spark, d, "part").groupBy("p_type")
        .agg(F.sum("p_size").cast("double").alias("outlay_rs_cr"), paid.cast("double").alias("disbursed_rs_cr"))
        .select(pick(SCHEME_OF).alias("scheme"), "outlay_rs_cr", "disbursed_rs_cr", pick(GRADE_OF).alias("grade"),
                F.col("p_type").alias("evidence"))
    )


def schemes(spark, d):
    target = F.create_map(*[F.lit(x) for kv in TARGET_OF.items() for x in kv])[F.col("scheme")]
    return count_pattern_mentions(corpus(spark, d), "text", ENTRIES, "scheme").withColumn("ministry", target)


def sql_case(x: str, table_: dict, other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {other} END"


SQL_GRADED = f"""
WITH ent AS ({SQL_ENTRIES}), reg AS ({SQL_REGISTRY}),
card AS (SELECT {sql_case('p_type', SCHEME_OF)} AS scheme, sum(p_size)::DOUBLE AS outlay_rs_cr,
  sum(CASE WHEN p_type <> 'MEDIUM' THEN p_size - 1 END)::DOUBLE AS disbursed_rs_cr, {sql_case('p_type', GRADE_OF)} AS grade,
  p_type AS evidence FROM part GROUP BY p_type)
SELECT name AS scheme, t.ministry, coalesce(contact_name, '') AS contact_name, coalesce(total_items, 0) AS total_items, mentions,
  outlay_rs_cr, disbursed_rs_cr, coalesce(round(100 * disbursed_rs_cr / outlay_rs_cr, 2), CASE WHEN outlay_rs_cr > 0 THEN 0.0 END) AS disbursed_pct, grade, evidence,
  CASE grade WHEN 'A' THEN 0 WHEN 'B-' THEN 3 WHEN 'D+' THEN 5 WHEN 'F' THEN 7 ELSE 99 END AS grade_order
FROM (SELECT *, {sql_case('name', TARGET_OF)} AS ministry FROM ent) t LEFT JOIN card ON scheme = name
LEFT JOIN reg ON reg.ministry = t.ministry
"""


def graded(spark, d, targets=None):
    """``targets``: the registry, if it is at hand."""
    return O.join_report_card(schemes(spark, d), card(spark, d), registry(spark, d) if targets is None else targets)


@suite.add(SQL_GRADED)
def scheme_scrutiny(spark, d):
    return O.by_grade(graded(spark, d))


# --- catalogue: benchmark texts as entry titles, looked for in the documents ---
def entries(spark, d):
    i = F.col("item_id")
    size_class = F.least(F.floor(F.length("text") / 80), F.lit(4))
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("NATION_"), size_class.cast("string")).alias("target"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i * 20).cast("int")), "yyyy-MM-dd'T'00:00:00").alias("modified"),
        F.concat(F.lit("<p>Outlay of Rs. "), i.cast("string"), F.lit(",000.5 Crore</p>")).alias("intro"),
        F.concat(F.lit("page/"), i.cast("string")).alias("page"))


SQL_CATALOGUE = rf"""
WITH titles AS (SELECT item_id, title, lower(array_to_string(words, ' ')) AS needle FROM ({sql_title_words()})),
flat AS (SELECT regexp_replace(lower(text), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g') AS text FROM documents),
hits AS (SELECT item_id, count(*) AS n FROM titles JOIN flat ON contains(text, needle) GROUP BY item_id)
SELECT 'NATION_' || least(length(title) // 80, 4) AS target, title, strftime(DATE '2024-01-01' + (item_id * 20)::INT, '%Y-%m-%d') AS last_modified,
  round(date_diff('day', DATE '2024-01-01' + (item_id * 20)::INT, DATE '2025-07-01') / 30.44, 1)::DOUBLE AS months_since_update,
  item_id * 1000 + 0.5::DOUBLE AS outlay_rs_cr, coalesce(n, 0) AS mentions, 'page/' || item_id AS page
FROM titles LEFT JOIN hits USING (item_id)
"""


def scrutiny(spark, d):
    return O.catalogue_scrutiny(entries(spark, d), texts(spark, d, "documents"), "text", "2025-07-01")


@suite.add(SQL_CATALOGUE)
def catalogue_scrutiny(spark, d):
    return O.by_target_and_mentions(scrutiny(spark, d))


SQL_ROLLUP = f"""
SELECT target, count(*) AS entries, count(*) FILTER (WHERE mentions = 0) AS zero_mentions,
       count(*) FILTER (WHERE months_since_update > 12) AS stale FROM ({SQL_CATALOGUE}) GROUP BY target
"""


@suite.add(SQL_ROLLUP)
def catalogue_rollup(spark, d):
    return O.catalogue_rollup(scrutiny(spark, d))


@suite.add(f"""
SELECT target, entries, zero_mentions, stale, coalesce(total_items, 0) AS total_items, coalesce(contact_name, '') AS contact_name
FROM ({SQL_ROLLUP}) LEFT JOIN ({SQL_REGISTRY}) ON ministry = target
""")
def join_catalogue_registry(spark, d):
    return O.join_catalogue_registry(O.catalogue_rollup(scrutiny(spark, d)), registry(spark, d))


@suite.add(f"SELECT target, title, months_since_update FROM ({SQL_CATALOGUE}) WHERE months_since_update > 12")
def stale_entries(spark, d):
    return scrutiny(spark, d).filter(F.coalesce("months_since_update", F.lit(0.0)) > 12).select(
        "target", "title", "months_since_update")


# --- proposals: one per order, the last line standing for it ---
def proposals(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal_no"), "l_returnflag", *LAST)
    last = O.distinct_proposals(raw, LAST)
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_type", "p_name", "p_brand")
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    home = table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), "r_name")
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", F.lit("EC Granted")).when(flag == "N", F.lit("Under Examination"))
    activity = F.when(F.col("p_type") != "MEDIUM", F.concat(
        F.lit('[{"label":"Activity","value":"'), "p_type", F.lit('"}]'))).otherwise(F.lit("[]"))
    return last.join(part, "l_partkey").join(home, "l_suppkey").select(
        "proposal_no", F.when(F.col("r_name") != "EUROPE", F.concat(F.lit(" "), F.lower("r_name"))).alias("state_name"),
        status.alias("status"), F.when(flag != "R", F.col("l_extendedprice") * 10000).alias("investment_cost"),
        project_name().alias("project_name"), activity.alias("other_property"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm").alias("start_date"))


SQL_PROPOSALS = f"""
proposals AS (
  SELECT l_orderkey AS proposal_no, CASE WHEN r_name = 'EUROPE' THEN 'Unknown' WHEN r_name = 'MIDDLE EAST' THEN 'Middle East'
    ELSE upper(r_name[1]) || lower(r_name[2:]) END AS region,
    CASE l_returnflag WHEN 'A' THEN 'EC Granted' WHEN 'N' THEN 'Under Examination' END AS status,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * 10000 END AS investment_cost, {SQL_PROJECT} AS project_name,
    {SQL_COMPANY} AS company, CASE WHEN p_type <> 'MEDIUM' THEN p_type END AS activity, strftime(l_shipdate, '%Y-%m-%d') AS start_date
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LAST)}) AS rn FROM lineitem)
  JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE rn = 1)
"""
SQL_VOLUMES = "SELECT p_brand AS ministry, count(*) AS questions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand"


@suite.add(f"""
WITH {SQL_PROPOSALS}, v AS ({SQL_VOLUMES})
SELECT count(*) AS proposals, count(*) FILTER (WHERE status = 'EC Granted') AS granted,
  (SELECT questions FROM v WHERE ministry = 'Brand#7') AS items,
  round((SELECT questions FROM v WHERE ministry = 'Brand#7') / count(*), 3)::DOUBLE AS items_per_proposal FROM proposals
""")
def proposal_totals(spark, d):
    volumes = C.count_by(items(spark, d, who=False), "ministry", out="questions")
    return O.proposal_totals(proposals(spark, d), volumes, "Brand#7")


@suite.add(f"WITH {SQL_PROPOSALS} SELECT region, count(*) AS proposals FROM proposals GROUP BY region")
def proposals_by_region(spark, d):
    return O.proposals_by_region(proposals(spark, d))


def region_volumes(spark, d):
    # one region goes by a name that the proposals do not have
    name = F.when(F.col("state") == "ASIA", F.lit("FAR EAST")).otherwise(F.col("state"))
    # the target's lines are counted by asker, and counts added up by region
    of = table(spark, d, "part").filter(F.col("p_brand") == "Brand#7").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("member")).join(of, "l_partkey")
    rows = C.count_by(lines, "member").join(askers(spark, d), "member")
    return C.count_by(rows.select(name.alias("region"), "n"), "region", out="items", weight="n")


SQL_REGIONS = f"""
WITH {ITEMS}, {SQL_PROPOSALS},
v AS (SELECT CASE state WHEN 'ASIA' THEN 'FAR EAST' ELSE state END AS region, count(*) AS items FROM items WHERE ministry = 'Brand#7' GROUP BY ALL),
p AS (SELECT region, count(*) AS proposals FROM proposals GROUP BY region)
SELECT coalesce(v.region, p.region) AS region, coalesce(items, 0) AS items, coalesce(proposals, 0) AS proposals,
  CASE WHEN items IS NULL THEN 0.0 ELSE round(items / proposals, 3) END::DOUBLE AS items_per_proposal
FROM v FULL JOIN p ON lower(v.region) = lower(p.region)
"""


@suite.add(SQL_REGIONS)
def compare_by_region(spark, d):
    return O.by_proposals(O.compare_by_region(region_volumes(spark, d), O.proposals_by_region(proposals(spark, d))))


@suite.add(f"WITH {SQL_PROPOSALS} SELECT activity, count(*) AS proposals FROM proposals WHERE activity IS NOT NULL GROUP BY activity")
def activity_counts(spark, d):
    return O.activity_counts(proposals(spark, d))


@suite.add(f"""
WITH {SQL_PROPOSALS} SELECT proposal_no, investment_cost FROM proposals WHERE investment_cost <> 0
ORDER BY investment_cost DESC, proposal_no LIMIT 25
""")
def top_by_value(spark, d):
    return O.top_by_value(proposals(spark, d), "investment_cost", "proposal_no").select("proposal_no", "investment_cost")


# companies are looked for in the part names, written with the legal form now and then
SQL_PART_TEXTS = """SELECT CASE WHEN p_type = 'PROMO' THEN 'a text that names nobody' WHEN p_size > 20 THEN 'about ' || p_name || ' ltd sites'
  ELSE p_name END AS text FROM part"""


def part_texts(spark, d):
    text = F.when(F.col("p_type") == "PROMO", F.lit("a text that names nobody")).when(
        F.col("p_size") > 20, F.concat(F.lit("about "), "p_name", F.lit(" ltd sites"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(text.alias("text"))


SQL_SPOT = f"""
WITH {SQL_PROPOSALS}, texts AS ({SQL_PART_TEXTS}),
top AS (SELECT * FROM proposals WHERE investment_cost <> 0 ORDER BY investment_cost DESC, proposal_no LIMIT 25)
SELECT proposal_no, project_name, coalesce(company, '') AS company, region, investment_cost, status, start_date,
  CASE WHEN company IS NOT NULL THEN EXISTS (SELECT 1 FROM texts WHERE contains(lower(text), lower(company))) END AS mentioned FROM top
"""


def spotcheck(spark, d, rows=None):
    """``rows``: the proposals, if they are at hand."""
    return O.proposal_spotcheck(proposals(spark, d) if rows is None else rows, part_texts(spark, d), "text")


@suite.add(SQL_SPOT)
def proposal_spotcheck(spark, d):
    return spotcheck(spark, d)


@suite.add(f"SELECT count(*) FILTER (WHERE company <> '') AS with_company, count(*) FILTER (WHERE mentioned) AS mentioned FROM ({SQL_SPOT})")
def spotcheck_totals(spark, d):
    return O.spotcheck_totals(spotcheck(spark, d))
