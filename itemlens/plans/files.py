"""Landing files and reading them back (S1-S16). Files go below the session's checkpoint folder."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens import pipelines as P
from itemlens.operators import graph as G
from itemlens.operators import matching as M
from itemlens.operators.comparison import distinct_proposals
from itemlens.plans.base import CHAMBERS, ITEMS, Suite, item_cells, items
from itemlens.plans.network import SQL_EDGES, SQL_NODES, SQL_TOPICS, cells, topics
from itemlens.plans.counting import LAST
from itemlens.plans.outside import SQL_CATALOGUE, card, entries
from itemlens.plans.people import SQL_REGISTRY, contacts, listed_code
from itemlens.plans.results import SQL_BRIEF, brief, brief_text
from itemlens.session import checkpointed, ensure_checkpoint_dir, table
from itemlens.sources import readers as R
from itemlens.sources import writers as W

suite = Suite()


def landing(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/landing/{uuid.uuid4().hex}"


def landed_json(spark, df) -> str:
    path = landing(spark)
    df.write.json(path)
    return path


# chamber A raw items: the asker is the part's maker by name, the roster the parts
def raw_items_a(spark, d):
    rows = items(spark, d, who=False).filter("chamber = 'O'")
    return rows.select(
        F.col("ques_no").cast("int").alias("quesNo"), F.col("session_no").alias("sessionNo"),
        F.date_format("date", "yyyy-MM-dd").alias("date"), "type", F.concat("ministry", F.lit(" & co")).alias("ministry"),
        F.concat(F.lit(" "), "subject").alias("subjects"),
        F.array(F.concat(F.lit("Dr. "), "subject"), F.lit("Second Person")).alias("member"))


SQL_RAW_A = f"WITH {ITEMS} SELECT * FROM items WHERE chamber = 'O'"


@suite.add(f"""
SELECT ques_no::INT AS "quesNo", session_no AS "sessionNo", strftime(date, '%Y-%m-%d') AS date, type, ministry || ' & co' AS ministry,
  ' ' || subject AS subjects, 'Dr. ' || subject AS lead FROM ({SQL_RAW_A})
""")
def read_items_a(spark, d):
    path = landed_json(spark, raw_items_a(spark, d))
    return R.read_items_a(spark, path).withColumn("lead", F.col("member")[0]).drop("member")


def roster_a(spark, d):
    # some are listed under a name that nobody asks by
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_brand").alias("b"), F.min("p_type").alias("t")).withColumn(
        "p_name", F.when(F.length("p_name") % 7 == 0, F.reverse("p_name")).otherwise(F.col("p_name")))
    words = F.split("p_name", " ")
    return p.select(F.initcap("p_name").alias("mpFirstLastName"), F.concat_ws(" ", words[1], words[0]).alias("mpLastFirstName"),
                    F.when(F.col("t") != "ECONOMY", F.col("b")).otherwise(F.lit("")).alias("partySname"),
                    F.concat(F.lit("Full "), "b").alias("partyFname"), F.lit("NCT of  Delhi").alias("stateName"),
                    F.col("t").alias("constName"))


SQL_ENRICHED_A = f"""
SELECT 'Lok Sabha' AS chamber, ques_no::INT AS ques_no, session_no, strftime(date, '%Y-%m-%d') AS date, type, upper(ministry) || ' AND CO' AS ministry,
  subject, 'Dr. ' || subject AS member, 'Dr. ' || subject || '; Second Person' AS all_members,
  CASE WHEN b IS NULL THEN 'Unknown' WHEN t <> 'ECONOMY' THEN b ELSE 'Full ' || b END AS party, 'Full ' || b AS party_full,
  CASE WHEN b IS NULL THEN 'Unknown' ELSE 'Delhi' END AS state, b IS NOT NULL AS matched
FROM ({SQL_RAW_A}) LEFT JOIN (SELECT p_name, min(p_brand) AS b, min(p_type) AS t FROM part WHERE length(p_name) % 7 <> 0 GROUP BY p_name) ON p_name = subject
"""


def enriched_a(spark, d):
    raw = R.read_items_a(spark, landed_json(spark, raw_items_a(spark, d)))
    people = M.canonical_roster_a(R.read_roster_a(spark, landed_json(spark, roster_a(spark, d))))
    return M.enrich_items_a(raw, M.roster_index(people, ["mpFirstLastName", "mpLastFirstName"], "roster_order"))


@suite.add(SQL_ENRICHED_A)
def enrich_items_a(spark, d):
    return enriched_a(spark, d).drop("question_text", "answer_text", "answer_pdf_url")


# chamber B raw items: the code is the supplier; those under a balance are on the roster under a code nobody asks by
def raw_items_b(spark, d):
    rows = items(spark, d).filter("chamber = 'F'")
    return rows.select(
        F.col("ques_no").cast("int").alias("qno"), F.col("session_no").alias("ses_no"),
        F.date_format("date", "yyyy-MM-dd").alias("ans_date"), F.concat(F.lit(" "), "type", F.lit(" ")).alias("qtype"),
        F.col("ministry").alias("min_name"), F.concat("subject", F.lit(" ")).alias("qtitle"),
        F.concat(F.lit("Asker "), F.col("member").cast("string")).alias("name"), F.col("member").cast("int").alias("mp_code"),
        F.concat(F.lit("<p>"), "subject", F.lit("&nbsp;<b>"), "state", F.lit("</b> &amp; co</p>")).alias("qn_text"),
        F.lit("<br/>").alias("ans_text"), F.concat(F.lit("f/"), "subject").alias("files"))


SQL_ENRICHED_B = f"""
WITH {ITEMS} SELECT 'Rajya Sabha' AS chamber, ques_no::INT AS ques_no, session_no, strftime(date, '%Y-%m-%d') AS date, type, upper(ministry) AS ministry, subject,
  'Asker ' || member AS member, 'Asker ' || member AS all_members,
  CASE WHEN s_acctbal >= 1000 THEN s_name ELSE 'Unknown' END AS party, CASE WHEN s_acctbal >= 1000 THEN 'Full ' || s_name END AS party_full,
  CASE WHEN s_acctbal >= 1000 THEN 'Kerala' ELSE 'Unknown' END AS state, subject || ' ' || state || ' & co' AS question_text,
  NULL::VARCHAR AS answer_text, 'f/' || subject AS answer_pdf_url, s_acctbal >= 1000 AS matched
FROM items JOIN supplier ON s_suppkey = member WHERE chamber = 'F'
"""


@suite.add(SQL_ENRICHED_B)
def enrich_items_b(spark, d):
    raw = R.read_items_b(spark, landed_json(spark, raw_items_b(spark, d)))
    path = landed_json(spark, roster_b(spark, d))
    roster = M.canonical_roster_b(R.read_roster_b(spark, [path, path + "-absent"]))
    return M.enrich_items_b(raw, roster).drop("raw_name")


def roster_b(spark, d):
    return table(spark, d, "supplier").select(
        listed_code(1000).cast("int").alias("mpsno"), F.col("s_name").alias("partyCode"),
        F.concat(F.lit("Full "), "s_name").alias("party"), F.lit("Keralam").alias("state"), F.lit(None).cast("string").alias("name"))


@suite.add("""
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment || ', "' || c_name || '"' AS quoted FROM customer
""")
def read_table(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"')).alias("quoted"))
    path = landing(spark)
    W.write_table(rows, path, ["c_custkey", "c_name", "quoted"])
    return R.read_table(spark, path, "c_custkey STRING, c_name STRING, quoted STRING")


@suite.add("SELECT c_custkey::INT AS c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def read_table_inferred(spark, d):
    path = landing(spark)
    W.write_table(table(spark, d, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "c_nationkey"])
    return R.read_table_inferred(spark, path)


@suite.add("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'view' GROUP BY user_id")
def read_press_items(spark, d):
    path = landing(spark)
    table(spark, d, "events").select(
        "user_id", F.col("ts").cast("string").alias("date"), F.col("event_type").alias("kind")).write.parquet(path)
    return R.read_press_items(spark, path, "2024-01-10", "view").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@suite.add("""
SELECT 'Department of ' || n_name AS ministry, CASE WHEN s_acctbal < 0 THEN '--' ELSE s_name END AS contact_name
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def read_contacts(spark, d):
    path = landing(spark)
    rows = contacts(spark, d).withColumn(
        "contact_name", F.when(F.trim("contact_name") == "", F.lit("--")).otherwise(F.col("contact_name")))
    W.write_table(rows, path, ["ministry", "contact_name", "designation"])
    return R.read_contacts(spark, path).select("ministry", "contact_name")


@suite.add("""
SELECT CASE p_type WHEN 'PROMO' THEN 'licence' WHEN 'SMALL' THEN 'person' WHEN 'LARGE' THEN 'the of' WHEN 'MEDIUM' THEN 'tion end'
  WHEN 'ECONOMY' THEN 'not asked' ELSE 'nor this' END AS scheme, sum(p_size)::DOUBLE AS outlay_rs_cr FROM part GROUP BY p_type
""")
def read_report_card(spark, d):
    rows = card(spark, d).agg(F.collect_list(F.struct("scheme", "outlay_rs_cr", "grade")).alias("disbursal_report_card"))
    return R.read_report_card(spark, landed_json(spark, rows)).select("scheme", "outlay_rs_cr")


@suite.add(f"SELECT target, title, 'Outlay of Rs. ' || (page[6:]) || ',000.5 Crore' AS intro FROM ({SQL_CATALOGUE})")
def read_catalogue(spark, d):
    rows = entries(spark, d)
    acf = F.struct(F.lit("").alias("l3_introduction"), F.col("intro").alias("introduction"))
    core = rows.filter("target = 'NATION_0'").select(
        F.struct(F.col("title").alias("rendered")).alias("title"), "modified", acf.alias("acf"), F.col("page").alias("link"))
    paths = {"NATION_0": landed_json(spark, core)}
    post = {}
    for i in range(1, 5):
        one = rows.filter(F.col("target") == f"NATION_{i}").select(F.struct(
            F.col("title").alias("post_title"), F.col("modified").alias("post_modified"), acf.alias("acf_data"),
            F.col("page").alias("post_slug")).alias("p"))
        post[f"NATION_{i}"] = (landed_json(spark, one.select(F.array("p").alias("posts"))), f"n{i}.example")
    return R.read_catalogue(spark, paths, post).select("target", "title", "intro")


@suite.add(f"SELECT target, title, last_modified || 'T00:00:00' AS modified, 'Outlay of Rs. ' || (page[6:]) || ',000.5 Crore' AS intro, "
           f"CASE WHEN target = 'NATION_0' THEN page ELSE '' END AS page FROM ({SQL_CATALOGUE})")
def read_catalogue_dump(spark, d):
    """Dumps with entries of two shapes by target in one document, a document for every hundred titles or so."""
    rows = entries(spark, d).withColumn("core", F.col("target") == "NATION_0").withColumn("file", F.floor(F.substring("page", 6, 9).cast("long") / 100))
    core = F.to_json(F.struct(F.struct(F.col("title").alias("rendered")).alias("title"), "modified", F.struct(
        F.lit("").alias("l3_introduction"), F.col("intro").alias("introduction")).alias("acf"), F.col("page").alias("link")))
    post = F.to_json(F.struct(F.col("title").alias("post_title"), F.col("modified").alias("post_modified"), F.struct(
        F.col("intro").alias("l3_introduction"), F.lit("other").alias("introduction")).alias("acf_data"), F.col("page").alias("post_slug")))
    lists = rows.groupBy("file", "target").agg(F.array_join(F.collect_list(F.when(F.col("core"), core).otherwise(post)), ",\n").alias("list"))
    named = F.concat(F.lit('"'), "target", F.lit('": ['), "list", F.lit("]"))
    dumps = lists.groupBy("file").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(named), ",\n"), F.lit("}")).alias("dump"))
    path = landing(spark)
    dumps.write.partitionBy("file").text(path)
    hooks = {f"NATION_{i}": {"schema": "post_page" if i else "wp_core"} for i in range(4)}  # the last target is told by its entries
    return R.read_catalogue_dump(spark, f"{path}/*", hooks)


@suite.add(f"""
SELECT l_orderkey::VARCHAR AS proposal_no, 'project ' || l_partkey AS project_name, l_extendedprice AS investment_cost, l_returnflag AS status
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LAST)}, l_returnflag DESC) = 1
""")
def read_proposals(spark, d):
    """Pages by ship date and line number with every line of an order as a payload of its proposal; the last page and place win."""
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("proposal_no"), *LAST, F.col("l_returnflag"))
    payload = F.struct(
        *LAST, "proposal_no", F.concat(F.lit("project "), F.col("l_partkey").cast("string")).alias("project_name"),
        F.col("l_extendedprice").alias("investment_cost"), F.col("l_returnflag").alias("status"))
    # parts in millions: a page holds what a day has of these, however many parts there are
    key = ["l_shipdate", "l_linenumber", F.floor(F.col("l_partkey") / 1_000_000)]
    pages = line.groupBy(*key).agg(F.sort_array(F.collect_list(payload)).alias("rows")).orderBy(*key)
    pages = pages.select(F.lit(200).alias("status"), F.lit("ok").alias("message"), F.transform("rows", lambda r: F.struct(
        r["proposal_no"].alias("proposal_no"), r["project_name"].alias("project_name"), r["investment_cost"].alias("investment_cost"),
        r["status"].alias("status"))).alias("data"))
    raw = R.read_proposals(spark, landed_json(spark, pages), envelope=True)
    return distinct_proposals(raw, ["load_order"]).select("proposal_no", "project_name", "investment_cost", "status")


@suite.add(f"WITH {ITEMS}, {SQL_TOPICS} SELECT party, term, count::INT AS count FROM topics")
def read_topics(spark, d):
    path = landing(spark)
    rows = topics(spark, d)
    everyone = rows.select(F.lit("ALL").alias("party"), "term", "count")
    W.write_table(rows.unionByName(everyone), path, ["party", "term", "count"])
    return R.read_topics(spark, path)


@suite.add(SQL_BRIEF)
def write_payload(spark, d):
    """The briefs with their nested lists, as read back."""
    path = landing(spark)
    rows = brief(spark, d)
    W.write_payload({"briefs": rows}, path)
    return brief_text(spark.read.schema(rows.schema).json(f"{path}/briefs"))


DOCUMENT = """
    party_summary ARRAY<STRUCT<party: STRING, chamber_a: BIGINT, chamber_b: BIGINT, total: BIGINT>>, ministry_summary ARRAY<STRUCT<ministry: STRING, questions: BIGINT>>,
    state_summary ARRAY<STRUCT<state: STRING, questions: BIGINT>>,
    party_ministry_matrix STRUCT<ministries: ARRAY<STRING>, rows: ARRAY<STRUCT<party: STRING, values: ARRAY<BIGINT>>>>,
    state_party_matrix STRUCT<parties: ARRAY<STRING>, rows: ARRAY<STRUCT<state: STRING, values: ARRAY<BIGINT>>>>,
    party_topics MAP<STRING, ARRAY<STRUCT<term: STRING, count: BIGINT>>>, totals STRUCT<combined: BIGINT, open: BIGINT>"""


def sql_numbers(section: str, src: str, key: str, n: str) -> str:
    return f"SELECT '{section}' AS section, (row_number() OVER (ORDER BY {n} DESC, {key}) - 1)::INT AS position, {key} AS name, {n}::VARCHAR AS detail FROM {src}"


def sql_matrix(section: str, row: str, col: str) -> str:
    return f"""
    SELECT '{section}', (row_number() OVER (ORDER BY total DESC, name) - 1)::INT, name, detail FROM (
      SELECT r.name, r.total, string_agg(c.name || '=' || coalesce(x.n, 0), ',' ORDER BY c.total DESC, c.name) AS detail
      FROM (SELECT {row} AS name, count(*) AS total FROM items GROUP BY 1) r, (SELECT {col} AS name, count(*) AS total FROM items GROUP BY 1) c
      LEFT JOIN (SELECT {row} AS a, {col} AS b, count(*) AS n FROM items GROUP BY ALL) x ON x.a = r.name AND x.b = c.name GROUP BY ALL)"""


@suite.add(f"""
WITH {ITEMS}, {SQL_TOPICS}, g AS (SELECT party, count(*) AS total, count(*) FILTER (WHERE chamber = 'O') || '/' || count(*) FILTER (WHERE chamber = 'F') || '/' || count(*) AS x
  FROM items GROUP BY party), m AS (SELECT ministry, count(*) AS n FROM items GROUP BY 1), s AS (SELECT state, count(*) AS n FROM items GROUP BY 1)
SELECT 'party_summary' AS section, (row_number() OVER (ORDER BY total DESC, party) - 1)::INT AS position, party AS name, x AS detail FROM g
UNION ALL {sql_numbers('ministry_summary', 'm', 'ministry', 'n')} UNION ALL {sql_numbers('state_summary', 's', 'state', 'n')}
UNION ALL {sql_matrix('party_ministry_matrix', 'party', 'ministry')} UNION ALL {sql_matrix('state_party_matrix', 'state', 'party')}
UNION ALL SELECT 'party_topics', (row_number() OVER (PARTITION BY party ORDER BY count DESC, term) - 1)::INT, party, term || '=' || count FROM topics
UNION ALL SELECT 'totals', 0, 'combined', count(*)::VARCHAR FROM items UNION ALL SELECT 'totals', 0, 'open', (count(*) FILTER (WHERE chamber = 'O'))::VARCHAR FROM items
""")
def counts_document(spark, d):
    """The nested result document, written, read back as one value and laid out row by row."""
    rows = checkpointed(item_cells(spark, d))
    totals = rows.agg(F.sum("n_items").alias("combined"), F.sum(F.when(F.col("chamber") == "O", F.col("n_items"))).alias("open"))
    path = landing(spark)
    W.write_document(P.counts_document(rows, topics(spark, d), totals, chambers=CHAMBERS), path)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")
    text = lambda c: F.col(c).cast("string")

    def part(section, name, detail):
        return doc.select(F.lit(section).alias("section"), F.posexplode(section).alias("position", "r")).select("section", "position", name.alias("name"), detail.alias("detail"))

    def matrix(section, row, cols):
        each = doc.select(F.col(f"{section}.{cols}").alias("c"), F.posexplode(f"{section}.rows").alias("position", "r"))
        cells = F.array_join(F.zip_with("c", "r.values", lambda c, v: F.concat(c, F.lit("="), v.cast("string"))), ",")
        return each.select(F.lit(section).alias("section"), "position", F.col(f"r.{row}").alias("name"), cells.alias("detail"))

    by_key = doc.select(F.explode("party_topics").alias("name", "terms")).select("name", F.posexplode("terms").alias("position", "t"))
    topic_rows = by_key.select(F.lit("party_topics").alias("section"), "position", "name", F.concat(F.col("t.term"), F.lit("="), text("t.count")).alias("detail"))
    sums = doc.select(F.inline(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(0).alias("position"), F.lit(c).alias("name"), text(f"totals.{c}").alias("detail"))
                                         for c in ("combined", "open")])))
    return reduce(DataFrame.unionByName, [
        part("party_summary", F.col("r.party"), F.concat_ws("/", text("r.chamber_a"), text("r.chamber_b"), text("r.total"))),
        part("ministry_summary", F.col("r.ministry"), text("r.questions")), part("state_summary", F.col("r.state"), text("r.questions")),
        matrix("party_ministry_matrix", "party", "ministries"), matrix("state_party_matrix", "state", "parties"), topic_rows, sums])


@suite.add(f"""
WITH {ITEMS}, {SQL_TOPICS}, e AS ({SQL_EDGES}), n AS ({SQL_NODES})
SELECT id, type, label, party, state, chamber, NULL::VARCHAR AS dst, NULL::BIGINT AS weight FROM n
UNION ALL SELECT src, type, NULL, NULL, NULL, NULL, dst, weight FROM e
""")
def write_graph(spark, d):
    """Nodes and edges as read back, row by row."""
    path = landing(spark)
    rows, terms = cells(spark, d), checkpointed(topics(spark, d))
    W.write_graph(G.graph_nodes(rows, terms), G.graph_edges(rows, terms), path)
    edges = spark.read.parquet(f"{path}/edges").withColumnRenamed("src", "id")
    return spark.read.parquet(f"{path}/nodes").unionByName(edges, allowMissingColumns=True)


@suite.add(f"WITH {ITEMS} SELECT p.party, p.n AS questions, t.type, t.n AS typed FROM (SELECT party, count(*)::INT AS n FROM items GROUP BY party) p JOIN (SELECT party, type, count(*)::INT AS n FROM items GROUP BY ALL) t USING (party)")
def register_tables(spark, d):
    folder, rows = landing(spark), items(spark, d, what=False)
    W.write_table(rows.groupBy("party").agg(F.count(F.lit(1)).alias("n")), f"{folder}/party_summary.csv")
    W.write_table(rows.groupBy("party", "type").agg(F.count(F.lit(1)).alias("n")), f"{folder}/party_type_matrix.csv")
    W.register_tables(spark, folder)
    return spark.sql("SELECT party, p.n AS questions, type, t.n AS typed FROM party_summary p JOIN party_type_matrix_wide t USING (party)")


@suite.add(f"SELECT ministry, total_items, press_items, contact_name FROM ({SQL_REGISTRY})")
def registry_snapshot(spark, d):
    from itemlens.plans.people import registry

    path = landing(spark)
    registry(spark, d).write.parquet(path)
    return spark.read.parquet(path).select("ministry", "total_items", "press_items", "contact_name")


@suite.add(f"""
SELECT chamber, party, count(*) AS n FROM ({SQL_ENRICHED_A}) GROUP BY ALL
""")
def enriched_volumes(spark, d):
    fixed = M.all_items(enriched_a(spark, d))
    assert fixed.columns == K.ITEM_COLUMNS
    return fixed.groupBy("chamber", "party").agg(F.count(F.lit(1)).alias("n"))


@suite.add(f"""
WITH e AS (SELECT chamber, party, state, ministry, member, matched FROM ({SQL_ENRICHED_A})
           UNION ALL SELECT chamber, party, state, ministry, member, matched FROM ({SQL_ENRICHED_B}))
SELECT 'group' AS section, party AS name, count(*)::BIGINT AS n FROM e GROUP BY ALL UNION ALL SELECT 'target', ministry, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'region', state, count(*) FROM e GROUP BY ALL UNION ALL SELECT chamber, member, count(*) FROM e WHERE NOT matched GROUP BY ALL
""")
def results_of_landed_files(spark, d):
    """Landed items and rosters to result tables, read back as views."""
    folder = landing(spark)
    files = P.Landed(landed_json(spark, raw_items_a(spark, d)), landed_json(spark, roster_a(spark, d)),
                     landed_json(spark, raw_items_b(spark, d)), [landed_json(spark, roster_b(spark, d))])
    P.run(spark, files, folder, graph=False)
    return spark.sql("""
        SELECT 'group' AS section, party AS name, CAST(total_questions AS BIGINT) AS n FROM party_summary
        UNION ALL SELECT 'target', ministry, CAST(questions AS BIGINT) FROM ministry_summary
        UNION ALL SELECT 'region', state, CAST(questions AS BIGINT) FROM state_summary
        UNION ALL SELECT chamber, name, CAST(count AS BIGINT) FROM unmatched_members""")
