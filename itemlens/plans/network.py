"""Property graph, pairs, similarity, PageRank and communities."""

from pyspark.sql import functions as F

from itemlens.operators import counting as C
from itemlens.operators import graph as G
from itemlens.operators.communities import communities as find_communities
from itemlens.operators.communities import community_table
from itemlens.operators.pagerank import pagerank as rank_nodes
from itemlens.operators.pagerank import pagerank_report
from itemlens.operators.terms import top_terms_by_group
from itemlens.plans.base import ITEMS, Suite, askers, item_cells, items
from itemlens.plans.counting import SQL_LIFT
from itemlens.session import checkpointed, table

suite = Suite()

ORDER = ["date", "ques_no", "session_no", "part", "chamber"]
TOPIC_TOKENS = "regexp_extract_all(lower(subject), '[a-z]{3,}')"


def named_items(spark, d):
    return items(spark, d).withColumn("member", F.col("member").cast("string"))


def cells(spark, d):
    return G.graph_cells(named_items(spark, d), ORDER)


def topics(spark, d):
    """The most frequent subject words and pairs of every group."""
    same = items(spark, d).groupBy("party", "subject").agg(F.count(F.lit(1)).alias("m"), F.min("ques_no").alias("ques_no"))
    return top_terms_by_group(same, "party", "subject", "ques_no", weight="m").drop("rank")


# part names are two words, none inside another; so a word goes only where a kept pair has it
SQL_TOPICS = f"""
topics AS (
  WITH toks AS (SELECT party AS g, {TOPIC_TOKENS} AS t FROM items),
  pairs AS (SELECT g, t[1] || ' ' || t[2] AS w, count(*) AS n FROM toks WHERE len(t) = 2 GROUP BY ALL HAVING count(*) >= 3),
  words AS (SELECT g, unnest(t) AS w FROM toks),
  singles AS (SELECT g, w, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.g = words.g AND contains(p.w, words.w)) GROUP BY ALL)
  SELECT g AS party, w AS term, n AS count FROM (SELECT * FROM pairs UNION ALL SELECT * FROM singles)
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, w) <= 12)
"""
SQL_NODES = f"""
SELECT DISTINCT 'party:' || party AS id, 'Party' AS type, party AS label, NULL::VARCHAR AS party, NULL::VARCHAR AS state, NULL::VARCHAR AS chamber FROM items
UNION ALL SELECT DISTINCT 'ministry:' || ministry, 'Ministry', ministry, NULL, NULL, NULL FROM items
UNION ALL SELECT DISTINCT 'state:' || state, 'State', state, NULL, NULL, NULL FROM items
UNION ALL SELECT 'mp:' || member, 'MP', member::VARCHAR, party, state, chamber FROM items
  QUALIFY row_number() OVER (PARTITION BY member ORDER BY date, ques_no, session_no, part, chamber) = 1
UNION ALL SELECT DISTINCT 'topic:' || term, 'Topic', term, NULL, NULL, NULL FROM topics
"""
SQL_EDGES = """
SELECT DISTINCT 'mp:' || member AS src, 'party:' || party AS dst, 'MEMBER_OF' AS type, NULL::BIGINT AS weight FROM items
UNION ALL SELECT DISTINCT 'mp:' || member, 'state:' || state, 'REPRESENTS', NULL FROM items
UNION ALL SELECT 'mp:' || member, 'ministry:' || ministry, 'ASKED', count(*) FROM items GROUP BY ALL
UNION ALL SELECT 'party:' || party, 'ministry:' || ministry, 'FOCUSES_ON', count(*) FROM items GROUP BY ALL
UNION ALL SELECT 'party:' || party, 'topic:' || term, 'FOCUSES_ON_TOPIC', count FROM topics
"""


@suite.add(f"WITH {ITEMS}, {SQL_TOPICS} SELECT party, term, count FROM topics")
def group_topics(spark, d):
    return topics(spark, d)


@suite.add(f"WITH {ITEMS}, {SQL_TOPICS} {SQL_NODES}")
def graph_nodes(spark, d):
    return G.graph_nodes(cells(spark, d), topics(spark, d))


@suite.add(f"WITH {ITEMS}, {SQL_TOPICS} {SQL_EDGES}")
def graph_edges(spark, d):
    return G.graph_edges(cells(spark, d), topics(spark, d))


SQL_PAIRS = f"""
WITH {ITEMS}, m AS (SELECT DISTINCT member, ministry FROM items)
SELECT a.ministry AS target_a, b.ministry AS target_b, count(*) AS shared_askers
FROM m a JOIN m b ON a.member = b.member AND a.ministry < b.ministry GROUP BY ALL
"""


@suite.add(SQL_PAIRS)
def cooccurring_targets(spark, d):
    return G.cooccurring_targets(items(spark, d, who=False))


@suite.add(f"SELECT * FROM ({SQL_PAIRS}) ORDER BY shared_askers DESC, target_a, target_b LIMIT 200")
def top_cooccurring_targets(spark, d):
    return G.top_cooccurring_targets(items(spark, d, who=False))


SQL_JOINT = """
j AS (SELECT DISTINCT l_orderkey AS ques_no, l_suppkey AS asker FROM lineitem WHERE l_linestatus = 'O'),
joint AS (SELECT a.asker AS asker_a, b.asker AS asker_b, count(*) AS joint_items
          FROM j a JOIN j b ON a.ques_no = b.ques_no AND a.asker < b.asker GROUP BY ALL)
"""


def joint_pairs(spark, d):
    signed = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("ques_no"), F.col("l_suppkey").alias("asker"))
    return G.joint_asker_pairs(signed, ["ques_no"], "asker")


# an order is signed once a day by all suppliers of that day's lines; the last day with more than one counts
SQL_SIGNED = """
days AS (SELECT l_orderkey AS ques_no, l_shipdate AS day, list_sort(list_distinct(list(l_suppkey))) AS askers
         FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1),
signed AS (SELECT ques_no, arg_max(askers, day) AS askers FROM days GROUP BY ques_no)
"""


def last_signed(spark, d):
    days = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ques_no"), F.col("l_shipdate").alias("day")).agg(
        F.sort_array(F.collect_set("l_suppkey")).alias("askers"))
    return G.last_joint_item(days, ["ques_no"], ["day"])


@suite.add(f"WITH {SQL_SIGNED} SELECT ques_no, list_aggregate(askers, 'string_agg', ',') AS askers FROM signed")
def last_joint_item(spark, d):
    return last_signed(spark, d).select("ques_no", F.array_join(F.col("askers").cast("array<string>"), ",").alias("askers"))


@suite.add(f"""
WITH {SQL_SIGNED}, s AS (SELECT ques_no, unnest(askers) AS asker FROM signed)
SELECT a.asker AS asker_a, b.asker AS asker_b, count(*) AS joint_items FROM s a JOIN s b ON a.ques_no = b.ques_no AND a.asker < b.asker GROUP BY ALL
""")
def joint_pairs_of_last_items(spark, d):
    """Pairs of askers where of an item signed more than once only the last counts."""
    signed = last_signed(spark, d).select("ques_no", F.explode("askers").alias("asker"))
    return G.joint_asker_pairs(signed, ["ques_no"], "asker")


@suite.add(f"WITH {SQL_JOINT} SELECT * FROM joint")
def joint_asker_pairs(spark, d):
    return joint_pairs(spark, d)


# the group of an asker is known from items it led: the first supplier of an order's 'N' lines
SQL_LED = """
led AS (SELECT DISTINCT asker, n_name AS party FROM (
  SELECT l_suppkey AS asker FROM lineitem WHERE l_returnflag = 'N'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1)
  JOIN supplier ON CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END = asker JOIN nation ON n_nationkey = s_nationkey)
"""
SQL_BRIDGES = f"""
WITH {SQL_JOINT}, {SQL_LED}
SELECT asker_a, coalesce(a.party, 'Unknown') AS group_a, asker_b, coalesce(b.party, 'Unknown') AS group_b, joint_items
FROM joint LEFT JOIN led a ON a.asker = asker_a LEFT JOIN led b ON b.asker = asker_b
WHERE coalesce(a.party, 'Unknown') <> coalesce(b.party, 'Unknown')
"""


def bridges(spark, d):
    led = table(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(
        F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("asker")).select("asker").distinct()
    # suppliers without a balance are known under a code that nobody signs with
    code = F.when(F.col("s_acctbal") > 0, F.col("member")).otherwise(-F.col("member"))
    balance = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"), "s_acctbal")
    groups = askers(spark, d).join(balance, "member").select(code.alias("asker"), "party")
    return G.cross_group_bridges(joint_pairs(spark, d), groups.join(led, "asker", "left_semi"), "asker", "party")


@suite.add(SQL_BRIDGES)
def cross_group_bridges(spark, d):
    return bridges(spark, d)


@suite.add(f"SELECT * FROM ({SQL_BRIDGES}) ORDER BY joint_items DESC, asker_a, asker_b LIMIT 30")
def top_bridges(spark, d):
    return C.ranked(bridges(spark, d), "joint_items", "asker_a", "asker_b", limit=30)


@suite.add("""
WITH j AS (SELECT DISTINCT l_orderkey, l_linestatus, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
SELECT n AS n_askers, count(*) AS n_items FROM (SELECT l_orderkey, count(*) AS n FROM j GROUP BY l_orderkey) WHERE n > 1 GROUP BY ALL
""")
def joint_items(spark, d):
    j = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select("l_orderkey", "l_suppkey").distinct()
    n = j.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.groupBy(F.col("n").alias("n_askers")).agg(F.count(F.lit(1)).alias("n_items"))


@suite.add(f"""
WITH l AS (SELECT *, sqrt(sum(lift * lift) OVER (PARTITION BY party)) AS norm FROM ({SQL_LIFT}))
SELECT a.party AS a, b.party AS b, round(sum(a.lift * b.lift) / any_value(a.norm) / any_value(b.norm), 6) AS similarity
FROM l a JOIN l b ON a.ministry = b.ministry AND a.party < b.party GROUP BY a.party, b.party
HAVING sum(a.lift * b.lift) / any_value(a.norm) / any_value(b.norm) > 0.15
""")
def cosine_similarity(spark, d):
    rows = G.cosine_similarity(C.lift(item_cells(spark, d), weight="n_items"), "party", "ministry", "lift")
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


@suite.add(f"""
WITH {ITEMS}, j AS (SELECT DISTINCT party, subject FROM items)
SELECT a.party AS a, b.party AS b, count(*) AS shared FROM j a JOIN j b ON a.subject = b.subject AND a.party < b.party GROUP BY ALL
""")
def shared_targets(spark, d):
    from itemlens.operators.pairs import pair_counts

    return pair_counts(items(spark, d), "subject", "party", "shared")


SQL_RANKS = f"""
WITH RECURSIVE {ITEMS}, {SQL_TOPICS},
e AS MATERIALIZED (SELECT 'party:' || party AS u, 'ministry:' || ministry AS v, count(*)::DOUBLE AS w FROM items GROUP BY ALL
      UNION ALL SELECT 'party:' || party, 'topic:' || term, count::DOUBLE FROM topics),
both_ways AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
links AS MATERIALIZED (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS share FROM both_ways),
size AS MATERIALIZED (SELECT count(DISTINCT u) AS n FROM links),
steps(i, id, r) AS (
  SELECT DISTINCT 0, u, 1.0::DOUBLE / (SELECT n FROM size) FROM links
  UNION ALL
  SELECT i + 1, v, 0.15::DOUBLE / (SELECT n FROM size) + 0.85::DOUBLE * sum(r * share) FROM steps JOIN links ON u = id WHERE i < 160 GROUP BY i + 1, v)
SELECT id AS node, split_part(id, ':', 1) AS type, substr(id, instr(id, ':') + 1) AS label, round(r, 6) AS pagerank FROM steps WHERE i = 160
"""


@suite.add(SQL_RANKS)
def pagerank(spark, d):
    edges = G.focus_edges(items(spark, d), topics(spark, d))
    return pagerank_report(rank_nodes(edges))


@suite.add(f"""
SELECT party AS id, any_value(party_total) AS items FROM ({SQL_LIFT}) WHERE party_total >= 30 GROUP BY party
""")
def similarity_nodes(spark, d):
    return G.similarity_graph(items(spark, d))[0]


# nations ask about their own region only, so the nations of a region are alike and no others are: the blocs are forced
SQL_BLOCS = """
SELECT min(party) OVER (PARTITION BY state) AS community, party AS "group", items, count(*) OVER (PARTITION BY state) AS community_size
FROM (SELECT party, state, count(*) AS items FROM items GROUP BY ALL)
"""


def blocs(spark, d):
    """(nodes, their communities) of the nations by the regions they ask about."""
    rows = item_cells(spark, d, what=False).withColumn("ministry", F.col("state"))
    nodes, edges = G.similarity_graph(rows, weight="n_items")
    nodes = checkpointed(nodes)
    return nodes, find_communities(nodes, edges)


@suite.add(f"WITH {ITEMS} {SQL_BLOCS}")
def communities(spark, d):
    nodes, member = blocs(spark, d)
    return community_table(member, nodes)


@suite.add("""
WITH s AS (SELECT source, substr(source, 4)::INT % 4 AS bloc, count(*) AS items FROM documents GROUP BY ALL)
SELECT min(source) OVER (PARTITION BY bloc) AS community, source AS "group", items, count(*) OVER (PARTITION BY bloc) AS community_size FROM s
""")
def communities_of_sources(spark, d):
    """Sources grouped by the topics they publish on, a topic for every fourth source."""
    topic = (F.substring("source", 4, 9).cast("int") % 4).cast("string")
    docs = table(spark, d, "documents").select(F.col("source").alias("party"), topic.alias("ministry"))
    nodes, edges = G.similarity_graph(docs, least=1, threshold=0.9)
    return community_table(find_communities(nodes, edges), nodes)


@suite.add(f"SELECT * FROM ({SQL_RANKS}) ORDER BY pagerank DESC, node LIMIT 40")
def top_pagerank(spark, d):
    edges = G.focus_edges(items(spark, d), topics(spark, d))
    return C.ranked(pagerank_report(rank_nodes(edges)), "pagerank", "node", limit=40)


@suite.add(f"""
WITH {ITEMS}, {SQL_TOPICS}
SELECT (SELECT count(*) FROM ({SQL_NODES})) AS nodes, (SELECT count(*) FROM ({SQL_EDGES})) AS edges,
  (SELECT count(*) FROM (SELECT party FROM items GROUP BY party HAVING count(*) >= 30)) AS groups,
  (SELECT count(DISTINCT ministry) FROM items) AS targets, (SELECT count(DISTINCT member) FROM items) AS askers,
  (SELECT count(*) FROM ({SQL_BRIDGES})) AS bridge_pairs
""")
def graph_stats(spark, d):
    rows, terms = cells(spark, d), checkpointed(topics(spark, d))
    big = rows.groupBy("party").agg(F.sum("n").alias("n")).filter("n >= 30")
    return G.graph_stats(G.graph_nodes(rows, terms), G.graph_edges(rows, terms), bridges(spark, d), big)
