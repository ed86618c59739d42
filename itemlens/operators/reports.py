"""Nested result datasets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlens import constants as K
from itemlens.functions.values import in_crore, starred_share
from itemlens.operators.counting import ranked, top_k_per_group, two_ended
from itemlens.session import checkpointed


def _listed(df: DataFrame, key: str, rank: str, fields: list[str], out: str) -> DataFrame:
    """One array of structs per key in rank order; the lists are cut to k before this."""
    rows = F.sort_array(F.collect_list(F.struct(rank, *fields)))
    return df.groupBy(key).agg(
        F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out))


def group_brief(
    summary: DataFrame, types: DataFrame, lifts: DataFrame, terms: DataFrame, members: DataFrame,
    group: str = "party", target: str = "ministry", total: str = "total_questions", n: str = "questions",
    starred: str = "STARRED", unstarred: str = "UNSTARRED",
    least: int = K.MIN_BRIEF_ITEMS, least_lift: int = K.MIN_BRIEF_LIFT_ITEMS,
    top_lift: int = 8, top_terms: int = 12, least_typed: int = 10,
) -> DataFrame:
    """One row per group with enough items, never Unknown.

    ``types`` has (group, type, n), ``members`` (group, community). Share starred
    is null below ``least_typed`` typed items.
    """
    kept = summary.filter((F.col(total) >= least) & (F.col(group) != K.UNKNOWN))
    typed = types.groupBy(group).agg(
        F.coalesce(F.sum(F.when(F.col("type") == starred, F.col("n"))), F.lit(0)).alias("starred"),
        F.coalesce(F.sum(F.when(F.col("type") == unstarred, F.col("n"))), F.lit(0)).alias("unstarred"))
    signature = top_k_per_group(
        lifts.filter(F.col(n) >= least_lift), group, [F.col("lift").desc(), F.col(n).desc(), F.col(target)], top_lift)
    topics = top_k_per_group(terms, group, [F.col("count").desc(), F.col("term")], top_terms)
    s, u = F.coalesce("starred", F.lit(0)), F.coalesce("unstarred", F.lit(0))
    return (
        kept.join(typed, group, "left").join(members, group, "left")
        .join(_listed(signature, group, "rank", [target, n, "lift"], "signature"), group, "left")
        .join(_listed(topics, group, "rank", ["term", "count"], "topics"), group, "left")
        .select(*summary.columns, s.alias("starred"), u.alias("unstarred"),
                F.when(s + u >= least_typed, starred_share(s, u)).alias("starred_share"),
                "community", "signature", "topics")
    )


def overview(groups: DataFrame, targets: DataFrame, regions: DataFrame, bridges: DataFrame,
             members: DataFrame) -> DataFrame:
    """(section, position, name, detail, n): top 15 groups, targets and regions, top 10 bridges, communities.

    Inputs are (name, n) tables; ``bridges`` (name, detail, n); ``members`` (community, group).
    """
    def top(df, section, k, detail=None):
        cut = ranked(df, "n", "name", limit=k).withColumn("section", F.lit(section))
        cut = cut.withColumn("detail", F.col(detail) if detail else F.lit(None).cast("string"))
        return top_k_per_group(cut, "section", [F.col("n").desc(), F.col("name")], k, "position").select(
            "section", "position", "name", "detail", F.col("n").cast("long").alias("n"))

    # a row per member, not a list per community: a community has no size limit
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    blocs = members.join(sizes, "community").select(
        F.lit("communities").alias("section"), F.lit(None).cast("int").alias("position"),
        F.col("community").alias("name"), F.col("group").alias("detail"), "n")
    return (
        top(groups, "groups", 15).unionByName(top(targets, "targets", 15)).unionByName(top(regions, "regions", 15))
        .unionByName(top(bridges, "bridges", 10, "detail")).unionByName(blocs)
    )


def overview_external(ratios: DataFrame, named: DataFrame, catalogue: DataFrame, regions: DataFrame,
                      spotcheck: DataFrame, graded: DataFrame) -> DataFrame:
    """(section, position, name, value): the outside-source sections of the overview in one long table.

    ``ratios`` (name, value), ``named`` (name, item_mentions, press_mentions),
    ``catalogue`` (name, target, mentions, months), ``regions`` (name, n),
    ``spotcheck`` (name, value), ``graded`` (name, order, value): all of it is listed, a row per entry of the fixed table
    of graded schemes. Proposals are ordered by cost and rounded after the cut.
    """
    def placed(df, section, order):
        at = F.row_number().over(Window.partitionBy("section").orderBy(*order))
        return df.withColumn("section", F.lit(section)).withColumn("position", at).select(
            "section", "position", "name", F.col("value").cast("double").alias("value"))

    def cut(df, section, order, k):
        return placed(df.orderBy(*order).limit(k), section, order)

    named, catalogue = checkpointed(named), checkpointed(catalogue)  # small results, each used twice
    desc = [F.col("value").desc(), F.col("name")]
    ends = two_ended(ratios, "value", "name", 8).select(
        F.concat(F.lit("ratio_"), F.col("end")).alias("section"), "position", "name", "value")
    terms = named.withColumnRenamed("item_mentions", "value")
    entries = catalogue.withColumnRenamed("mentions", "value")
    stale = catalogue.groupBy(F.col("target").alias("name")).agg(
        F.count_if(F.coalesce("months", F.lit(0.0)) > K.STALE_MONTHS).alias("value"))
    return (
        ends.unionByName(cut(terms.filter("press_mentions = 0"), "terms_one_side", desc, 12))
        .unionByName(cut(terms.filter("press_mentions > 0"), "terms_both_sides", desc, 12))
        .unionByName(placed(graded, "graded", [F.col("order"), F.col("name")]))
        .unionByName(cut(entries, "catalogue", desc, 15))
        .unionByName(stale.select(F.lit("stale").alias("section"), F.lit(None).cast("int").alias("position"),
                                  "name", F.col("value").cast("double").alias("value")))
        .unionByName(cut(regions.withColumnRenamed("n", "value"), "regions", desc, 10))
        .unionByName(cut(spotcheck, "proposals", desc, 10).withColumn("value", in_crore(F.col("value"))))
    )
