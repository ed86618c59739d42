"""Counts, cross-tabs, shares, ranks and top-k over items."""

from pyspark.sql import functions as F

from itemlens.operators import counting as C
from itemlens.plans.base import BRANDS, CHAMBERS, ITEMS, TYPES, Suite, item_cells, items
from itemlens.session import table

suite = Suite()

SQL_GROUPS = f"""
WITH {ITEMS}
SELECT party, count(*) FILTER (WHERE chamber = 'O') AS chamber_a, count(*) FILTER (WHERE chamber = 'F') AS chamber_b,
       count(*) AS total FROM items GROUP BY party
"""


def summary(spark, d):
    return C.group_summary(item_cells(spark, d, what=False), chambers=CHAMBERS, total="total", weight="n_items")


@suite.add(f"SELECT *, rank() OVER (ORDER BY total DESC) AS rank FROM ({SQL_GROUPS})")
def group_ranking(spark, d):
    return C.global_rank(summary(spark, d), "total")


@suite.add(SQL_GROUPS)
def group_summary(spark, d):
    return summary(spark, d)


# ranking with ties: customers by number of orders
@suite.add("""
SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
""")
def asker_ranking(spark, d):
    return C.global_rank(C.count_by(table(spark, d, "orders"), "o_custkey"), "n")


@suite.add(f"WITH {ITEMS} SELECT ministry, count(*) AS questions FROM items GROUP BY ministry")
def target_summary(spark, d):
    return C.count_by(item_cells(spark, d, who=False), "ministry", out="questions", weight="n_items")


@suite.add(f"WITH {ITEMS} SELECT state, count(*) AS questions FROM items GROUP BY state")
def region_summary(spark, d):
    return C.count_by(item_cells(spark, d, what=False), "state", out="questions", weight="n_items")


def sql_cross(row: str, col: str, values: list[str]) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE {col} = '{v}') AS \"{v}\"" for v in values)
    return f"WITH {ITEMS} SELECT {row}, {cols} FROM items GROUP BY {row}"


@suite.add(sql_cross("party", "ministry", BRANDS))
def group_target_matrix(spark, d):
    return C.cross_tab(C.cell_counts(item_cells(spark, d), "party", "ministry", weight="n_items"), "party", "ministry")


@suite.add(sql_cross("state", "party", [f"NATION_{i}" for i in range(25)]))
def region_group_matrix(spark, d):
    return C.cross_tab(C.cell_counts(item_cells(spark, d, what=False), "state", "party", weight="n_items"), "state", "party")


@suite.add(sql_cross("state", "ministry", BRANDS))
def region_target_matrix(spark, d):
    return C.cross_tab(C.cell_counts(item_cells(spark, d), "state", "ministry", weight="n_items"), "state", "ministry")


@suite.add(sql_cross("party", "type", TYPES))
def group_type_matrix(spark, d):
    return C.cross_tab(C.type_cells(item_cells(spark, d, what=False), weight="n_items"), "party", "type")


@suite.add(f"WITH {ITEMS} SELECT party, ministry, count(*) AS n FROM items GROUP BY ALL")
def group_target_cells(spark, d):
    return C.cell_counts(item_cells(spark, d), "party", "ministry", weight="n_items")


# values of the cut matrix as text, so that rows compare cell by cell
def sql_top_matrix(row: str, col: str, cols: int, rows: int | None) -> str:
    cut = f"ORDER BY row_total DESC, {row} LIMIT {rows}" if rows else ""
    return f"""
    WITH {ITEMS}, cells AS (SELECT {row}, {col}, count(*) AS n FROM items GROUP BY ALL),
    heads AS (SELECT {col}, row_number() OVER (ORDER BY sum(n) DESC, {col}) AS pos FROM cells GROUP BY {col}
              QUALIFY pos <= {cols}),
    tops AS (SELECT {row}, sum(n)::BIGINT AS row_total FROM cells GROUP BY {row} {cut})
    SELECT {row}, row_total, string_agg({col}, ',' ORDER BY pos) AS cols, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY pos) AS vals
    FROM tops CROSS JOIN heads LEFT JOIN cells USING ({row}, {col}) GROUP BY {row}, row_total
    """


def as_text(df):
    return df.withColumn("vals", F.array_join(F.transform("values", lambda v: v.cast("string")), ",")).withColumn(
        "cols", F.array_join("columns", ",")).drop("values", "columns")


@suite.add(sql_top_matrix("party", "ministry", 10, None))
def top_matrix_group_target(spark, d):
    cells = C.cell_counts(item_cells(spark, d), "party", "ministry", weight="n_items")
    return as_text(C.top_matrix(cells, "party", "ministry", top_cols=10))


@suite.add(sql_top_matrix("state", "ministry", 10, 3))
def top_matrix_region_target(spark, d):
    cells = C.cell_counts(item_cells(spark, d), "state", "ministry", weight="n_items")
    return as_text(C.top_matrix(cells, "state", "ministry", top_cols=10, top_rows=3))


SQL_LIFT = f"""
WITH {ITEMS}, cells AS (SELECT party, ministry, count(*) AS questions FROM items GROUP BY ALL),
tot AS (SELECT *, sum(questions) OVER (PARTITION BY ministry) AS mt, sum(questions) OVER (PARTITION BY party) AS pt,
        sum(questions) OVER () AS al FROM cells)
SELECT party, ministry, questions, mt::BIGINT AS ministry_total, pt::BIGINT AS party_total,
       round(questions / (mt * (pt / al)), 3)::DOUBLE AS lift FROM tot
"""


@suite.add(SQL_LIFT)
def lift(spark, d):
    return C.lift(item_cells(spark, d), weight="n_items")


@suite.add(f"SELECT * FROM ({SQL_LIFT}) WHERE questions >= 15 ORDER BY lift DESC, questions DESC, party, ministry LIMIT 60")
def signature_targets(spark, d):
    rows = C.lift(item_cells(spark, d), weight="n_items").filter(F.col("questions") >= 15)
    return rows.orderBy(F.col("lift").desc(), F.col("questions").desc(), "party", "ministry").limit(60)


@suite.add(f"""
WITH {ITEMS} SELECT party, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, count(*) / sum(count(*)) OVER () AS share
FROM items GROUP BY party
""")
def group_shares(spark, d):
    return C.group_shares(item_cells(spark, d, what=False), "party", weight="n_items")


@suite.add(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY party ORDER BY lift DESC, questions DESC, ministry) AS rank FROM ({SQL_LIFT}) WHERE questions >= 10) WHERE rank <= 8")
def top_lift_per_group(spark, d):
    rows = C.lift(item_cells(spark, d), weight="n_items").filter(F.col("questions") >= 10)
    return C.top_k_per_group(rows, "party", [F.col("lift").desc(), F.col("questions").desc(), F.col("ministry")], 8)


@suite.add(f"WITH {ITEMS} SELECT member, count(*) AS n FROM items GROUP BY member ORDER BY n DESC, member LIMIT 40")
def top_askers(spark, d):
    return C.ranked(C.count_by(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("member")), "member"),
                    "n", "member", limit=40)


LAST = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@suite.add(f"""
SELECT l_orderkey, l_suppkey, l_returnflag, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LAST)}) AS rn FROM lineitem)
WHERE rn = 1
""")
def dedupe_last(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *LAST)
    return C.dedupe_last(rows, ["l_orderkey"], LAST).select("l_orderkey", "l_suppkey", "l_returnflag", "l_extendedprice")


ORDER = ["date", "ques_no", "session_no", "part"]


@suite.add(f"""
WITH {ITEMS} SELECT member, party, state, chamber FROM (
  SELECT *, row_number() OVER (PARTITION BY member ORDER BY date DESC, ques_no DESC, session_no DESC, part DESC, chamber DESC) AS rn
  FROM items) WHERE rn = 1
""")
def asker_profile(spark, d):
    return C.last_by(items(spark, d, what=False), "member", ["party", "state", "chamber"], [*ORDER, "chamber"])


@suite.add(f"""
WITH {ITEMS} SELECT member, party, state, chamber FROM (
  SELECT *, row_number() OVER (PARTITION BY member ORDER BY date, ques_no, session_no, part, chamber) AS rn
  FROM items) WHERE rn = 1
""")
def asker_first_seen(spark, d):
    return C.first_by(items(spark, d, what=False), "member", ["party", "state", "chamber"], [*ORDER, "chamber"])


# the quality of a document stands for a text that only some items have
@suite.add("SELECT count(*) AS n_rows, count(quality) AS n_with_text FROM documents LEFT JOIN labels USING (doc_id)")
def text_coverage(spark, d):
    marks = table(spark, d, "labels").select("doc_id", "quality")
    return C.text_coverage(table(spark, d, "documents").select("doc_id").join(marks, "doc_id", "left"), "quality")


# a line without discount stands for an item whose asker is not on the roster
@suite.add("""
SELECT count(*) FILTER (WHERE l_linestatus = 'O') AS chamber_a, count(*) FILTER (WHERE l_linestatus = 'F') AS chamber_b,
  count(*) AS combined, count(*) FILTER (WHERE l_linestatus = 'O' AND l_discount = 0) AS unmatched_chamber_a,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount = 0) AS unmatched_chamber_b FROM lineitem
""")
def corpus_totals(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("chamber"), (F.col("l_discount") != 0).alias("matched"))
    return C.corpus_totals(rows, chambers=CHAMBERS)


@suite.add("""
SELECT 'O' AS chamber, l_orderkey AS ques_no, l_returnflag AS type FROM lineitem WHERE l_linestatus = 'O' UNION ALL
SELECT 'F', l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F'
""")
def all_items(spark, d):
    one = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("chamber"), F.col("l_orderkey").alias("ques_no"), F.col("l_returnflag").alias("type"))
    return one.filter("chamber = 'O'").unionByName(one.filter("chamber = 'F'"))


@suite.add(f"WITH {ITEMS} SELECT DISTINCT ministry, type FROM items")
def distinct_targets(spark, d):
    return items(spark, d, who=False).select("ministry", "type").distinct()
