"""Nested result datasets (R1-R3), flattened to text where SQL must agree."""

from pyspark.sql import functions as F

from itemlens.operators import counting as C
from itemlens.operators import reports as R
from itemlens.operators import comparison as O
from itemlens.operators.registry import release_comparison
from itemlens.plans.base import CHAMBERS, ITEMS, Suite, item_cells
from itemlens.plans.counting import SQL_LIFT
from itemlens.plans.network import SQL_BLOCS, SQL_BRIDGES, SQL_TOPICS, blocs, bridges, topics
from itemlens.plans.outside import (
    SQL_CATALOGUE, SQL_GRADED, SQL_REGIONS, SQL_SPOT, graded, proposals, region_volumes, scrutiny, spotcheck,
)
from itemlens.plans.people import SQL_RATIO, registry
from itemlens.plans.texts import press_comparison, sql_side
from itemlens.session import checkpointed, stored

suite = Suite()


SQL_BRIEF = f"""
WITH {ITEMS}, {SQL_TOPICS},
s AS (SELECT party, count(*) FILTER (WHERE chamber = 'O') AS chamber_a, count(*) FILTER (WHERE chamber = 'F') AS chamber_b, count(*) AS total,
        count(*) FILTER (WHERE type = 'A') AS starred, count(*) FILTER (WHERE type = 'N') AS unstarred, any_value(community) AS community
      FROM items JOIN (SELECT community, "group" FROM ({SQL_BLOCS})) ON "group" = party GROUP BY party HAVING count(*) >= 50),
sig AS (SELECT party, string_agg(ministry || '=' || questions, ',' ORDER BY lift DESC, questions DESC, ministry) AS signature FROM (
  SELECT * FROM ({SQL_LIFT}) WHERE questions >= 10 QUALIFY row_number() OVER (PARTITION BY party ORDER BY lift DESC, questions DESC, ministry) <= 8)
  GROUP BY party),
top AS (SELECT party, string_agg(term || '=' || count, ',' ORDER BY count DESC, term) AS topics FROM topics GROUP BY party)
SELECT s.party, chamber_a, chamber_b, total, starred, unstarred, round((100 * starred)::DOUBLE / (starred + unstarred), 6) AS starred_share,
  community, signature, top.topics AS topics
FROM s LEFT JOIN sig USING (party) LEFT JOIN top USING (party)
"""


def brief(spark, d):
    rows, n = checkpointed(item_cells(spark, d)), "n_items"  # one pass over the items for all counts
    return R.group_brief(
        C.group_summary(rows, chambers=CHAMBERS, total="total", weight=n), C.type_cells(rows, weight=n), C.lift(rows, weight=n), topics(spark, d),
        blocs(spark, d)[1].select(F.col("id").alias("party"), "community"), total="total", starred="A", unstarred="N")


def brief_text(rows):
    """The briefs with their lists as text."""
    text = lambda c, k, v: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x[v].cast("string"))), ",")
    return rows.withColumns({
        "signature": text("signature", "ministry", "questions"), "topics": text("topics", "term", "count"),
        "starred_share": F.round("starred_share", 6)})


@suite.add(SQL_BRIEF)
def group_brief(spark, d):
    return brief_text(brief(spark, d))


def sql_top(section: str, src: str, k: int, name: str, n: str, detail: str = "NULL") -> str:
    return (f"SELECT '{section}' AS section, (row_number() OVER (ORDER BY {n} DESC, {name}))::INT AS position, {name} AS name, "
            f"{detail}::VARCHAR AS detail, {n} AS n FROM {src} QUALIFY position <= {k}")


@suite.add(f"""
WITH {ITEMS}, g AS (SELECT party AS name, count(*) AS n FROM items GROUP BY 1), t AS (SELECT ministry AS name, count(*) AS n FROM items GROUP BY 1),
r AS (SELECT state AS name, count(*) AS n FROM items GROUP BY 1),
b AS (SELECT asker_a || ' / ' || asker_b AS name, group_a || ' / ' || group_b AS detail, joint_items AS n FROM ({SQL_BRIDGES})),
c AS ({SQL_BLOCS})
{sql_top('groups', 'g', 15, 'name', 'n')} UNION ALL {sql_top('targets', 't', 15, 'name', 'n')}
UNION ALL {sql_top('regions', 'r', 15, 'name', 'n')} UNION ALL {sql_top('bridges', 'b', 10, 'name', 'n', 'detail')}
UNION ALL SELECT 'communities', NULL, community, "group", community_size FROM c
""")
def overview(spark, d):
    rows = checkpointed(item_cells(spark, d))
    by = lambda c: C.count_by(rows.select(F.col(c).alias("name"), "n_items"), "name", weight="n_items")
    pairs = bridges(spark, d).select(
        F.concat_ws(" / ", F.col("asker_a").cast("string"), F.col("asker_b").cast("string")).alias("name"),
        F.concat_ws(" / ", "group_a", "group_b").alias("detail"), F.col("joint_items").alias("n"))
    members = blocs(spark, d)[1].select("community", F.col("id").alias("group"))
    return R.overview(by("party"), by("ministry"), by("state"), pairs, members)


def sql_cut(section: str, src: str, k: int, name: str, value: str, order: str) -> str:
    return (f"SELECT '{section}' AS section, (row_number() OVER (ORDER BY {order}, {name}))::INT AS position, {name} AS name, "
            f"({value})::DOUBLE AS value FROM {src} QUALIFY position <= {k}")


@suite.add(f"""
WITH ratios AS (SELECT * FROM ({SQL_RATIO}) WHERE items_per_press_item IS NOT NULL), one AS ({sql_side('= 0')}), two AS ({sql_side('> 0')}),
graded AS (SELECT *, coalesce(disbursed_pct, 0) AS v FROM ({SQL_GRADED})), cat AS ({SQL_CATALOGUE}), reg AS ({SQL_REGIONS}), spot AS ({SQL_SPOT}),
stale AS (SELECT target, count(*) FILTER (WHERE months_since_update > 12) AS n FROM cat GROUP BY target)
{sql_cut('ratio_high', 'ratios', 8, 'ministry', 'items_per_press_item', 'items_per_press_item DESC')}
UNION ALL {sql_cut('ratio_low', 'ratios', 8, 'ministry', 'items_per_press_item', 'items_per_press_item')}
UNION ALL {sql_cut('terms_one_side', 'one', 12, 'term', 'item_mentions', 'item_mentions DESC')}
UNION ALL {sql_cut('terms_both_sides', 'two', 12, 'term', 'item_mentions', 'item_mentions DESC')}
UNION ALL SELECT 'graded', (row_number() OVER (ORDER BY grade_order, scheme))::INT, scheme, v::DOUBLE FROM graded
UNION ALL {sql_cut('catalogue', 'cat', 15, 'title', 'mentions', 'mentions DESC')}
UNION ALL SELECT 'stale', NULL, target, n::DOUBLE FROM stale
UNION ALL {sql_cut('regions', 'reg', 10, 'region', 'proposals', 'proposals DESC')}
UNION ALL SELECT 'proposals', (row_number() OVER (ORDER BY investment_cost DESC, proposal_no::VARCHAR))::INT AS position, proposal_no::VARCHAR,
  round(investment_cost / 1e7, 0) FROM spot QUALIFY position <= 10
""")
def overview_external(spark, d):
    targets = checkpointed(registry(spark, d))  # a row a target; orders and press items are read once
    rows = stored(proposals(spark, d).drop("other_property"), "proposals")  # the last line of each order, looked for once
    ratios = release_comparison(targets).select(
        F.col("ministry").alias("name"), F.col("items_per_press_item").alias("value"))
    named = press_comparison(spark, d).withColumnRenamed("term", "name")
    catalogue = scrutiny(spark, d).select(
        F.col("title").alias("name"), "target", "mentions", F.col("months_since_update").alias("months"))
    regions = O.compare_by_region(region_volumes(spark, d), O.proposals_by_region(rows)).select(
        F.col("region").alias("name"), F.col("proposals").alias("n"))
    spot = spotcheck(spark, d, rows).select(F.col("proposal_no").cast("string").alias("name"), F.col("investment_cost").alias("value"))
    marks = graded(spark, d, targets).select(
        F.col("scheme").alias("name"), F.col("grade_order").alias("order"), F.coalesce("disbursed_pct", F.lit(0.0)).alias("value"))
    return R.overview_external(ratios, named, catalogue, regions, spot, marks)
