"""Registered queries and the stand-ins they run on.

The given tables hold orders and documents, so each query runs an operator on
stand-ins built from them: an item is a line item, its asker the supplier, its
group the supplier's nation, its region the nation's region, its target the part
brand, its subject the part name, its chamber the line status.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    """Queries by name, each with the SQL that must give the same rows, if there is one."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql.strip()
            return fn
        return register


CHAMBERS = {"O": "chamber_a", "F": "chamber_b"}
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
TYPES = ["A", "N", "R"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def items(spark: SparkSession, d: str, who: bool = True, what: bool = True) -> DataFrame:
    """Items with (who) group and region and (what) target and subject; joins only what is asked for."""
    out = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("chamber"), F.col("l_orderkey").alias("ques_no"),
        F.col("l_linenumber").alias("session_no"), F.col("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("part"))
    if who:
        out = out.join(askers(spark, d), "member")
    if what:
        part = table(spark, d, "part").select(
            F.col("p_partkey").alias("part"), F.col("p_brand").alias("ministry"), F.col("p_name").alias("subject"))
        out = out.join(part, "part")
    return out


def item_cells(spark: SparkSession, d: str, who: bool = True, what: bool = True) -> DataFrame:
    """Counts of items (n_items) by chamber, type and (who) party, state, (what) ministry.

    Lines are counted by their keys first, so only counts are joined, and named counts added up again.
    """
    keys = {"chamber": "l_linestatus", "type": "l_returnflag"} | ({"member": "l_suppkey"} if who else {}) | ({"part": "l_partkey"} if what else {})
    out = table(spark, d, "lineitem").groupBy(*[F.col(c).alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("n_items"))
    names = ["chamber", "type"]
    if who:
        out = out.join(askers(spark, d), "member")
        names += ["party", "state"]
    if what:
        out = out.join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("ministry")), "part")
        names += ["ministry"]
    return out.groupBy(*names).agg(F.sum("n_items").alias("n_items"))


def askers(spark: SparkSession, d: str) -> DataFrame:
    """(member, party, state): each supplier with nation and region."""
    nation = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("party"), F.col("r_name").alias("state"))
    return table(spark, d, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("member"), "party", "state")


ITEMS = """
items AS (
  SELECT l_linestatus AS chamber, l_orderkey AS ques_no, l_linenumber AS session_no, l_shipdate AS date,
         l_returnflag AS type, l_suppkey AS member, l_partkey AS part,
         n_name AS party, r_name AS state, p_brand AS ministry, p_name AS subject
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey
)
"""


# the blanks that count in names and labels, for the SQL side
WS = r"[\s\x0B\x{85}\p{Z}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_flat(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


# non-ASCII letters become "_", other non-ASCII signs "." so that ASCII word edges agree with Unicode ones
def sql_ascii(x: str) -> str:
    return (rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]', '.', 'g'), "
            rf"'[^\x00-\x7F]', '_', 'g')")
