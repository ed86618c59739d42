"""Graded schemes, catalogues and proposals against item volume."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.labels import normalize_region_title
from itemlens.functions.text import extract_activity, extract_company, extract_outlay
from itemlens.functions.values import (
    date_prefix, grade_order, is_granted, months_since, percent_paid, safe_ratio,
)
from itemlens.operators.counting import dedupe_last, ranked
from itemlens.operators.mentions import count_catalogue_mentions, count_title_mentions, flag_mentioned
from itemlens.operators.terms import frequent_named_terms


def scheme_press_comparison(counts: DataFrame, titles: DataFrame, title: str,
                            top: int = K.TOP_NAMED_TERMS, least: int = K.MIN_NAMED_TERM) -> DataFrame:
    """Frequent named terms with their mentions in item text and in press titles."""
    terms = frequent_named_terms(counts, top, least)
    return count_title_mentions(titles, title, terms, "term", "press_mentions").select(
        "term", F.col("count").alias("item_mentions"), "press_mentions")


def split_by_side(comparison: DataFrame, n: str = "press_mentions") -> tuple[DataFrame, DataFrame]:
    """(mentioned on one side only, mentioned on both)."""
    return comparison.filter(F.col(n) == 0), comparison.filter(F.col(n) > 0)


def join_report_card(schemes: DataFrame, card: DataFrame, registry: DataFrame, target: str = "ministry") -> DataFrame:
    """``schemes`` (scheme, target, mentions) with grade and registry columns, defaults where absent."""
    who = registry.select(target, "contact_name", "total_items")
    grades = card.select("scheme", "outlay_rs_cr", "disbursed_rs_cr", "grade", "evidence")
    return schemes.join(grades, "scheme", "left").join(who, target, "left").select(
        "scheme", target, F.coalesce("contact_name", F.lit("")).alias("contact_name"),
        F.coalesce("total_items", F.lit(0)).alias("total_items"), "mentions", "outlay_rs_cr", "disbursed_rs_cr",
        percent_paid(F.col("disbursed_rs_cr"), F.col("outlay_rs_cr")).alias("disbursed_pct"), "grade", "evidence",
        grade_order(F.col("grade")).alias("grade_order"))


def catalogue_scrutiny(entries: DataFrame, corpus: DataFrame, text: str, as_of: str) -> DataFrame:
    """Per catalogue entry: mentions, months since update, outlay named in the introduction."""
    mentions = count_catalogue_mentions(corpus, text, entries, "title")
    return entries.join(mentions.drop("pattern"), "title").select(
        "target", "title", date_prefix(F.col("modified")).alias("last_modified"),
        months_since(F.col("modified"), as_of).alias("months_since_update"),
        extract_outlay(F.col("intro")).alias("outlay_rs_cr"), "mentions", "page")


def catalogue_rollup(scrutiny: DataFrame, stale: float = K.STALE_MONTHS) -> DataFrame:
    """Entries, entries without mentions and stale entries per target; no row for a target without entries."""
    return scrutiny.groupBy("target").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("mentions") == 0).alias("zero_mentions"),
        F.count_if(F.coalesce("months_since_update", F.lit(0.0)) > stale).alias("stale"))


def join_catalogue_registry(rollup: DataFrame, registry: DataFrame, target: str = "ministry") -> DataFrame:
    who = registry.select(F.col(target).alias("target"), "contact_name", "total_items")
    return rollup.join(who, "target", "left").select(
        *rollup.columns, F.coalesce("total_items", F.lit(0)).alias("total_items"),
        F.coalesce("contact_name", F.lit("")).alias("contact_name"))


def distinct_proposals(raw: DataFrame, order: list[str], key: str = "proposal_no") -> DataFrame:
    """The last payload of every proposal number."""
    return dedupe_last(raw, [key], order)


def proposal_totals(proposals: DataFrame, volumes: DataFrame, target_name: str,
                    target: str = "ministry", n: str = "questions") -> DataFrame:
    asked = F.coalesce(volumes.filter(F.col(target) == target_name).agg(F.sum(n)).scalar(), F.lit(0))
    return proposals.agg(
        F.count(F.lit(1)).alias("proposals"), F.count_if(is_granted(F.col("status"))).alias("granted"),
    ).select("proposals", "granted", asked.alias("items"), safe_ratio(asked, F.col("proposals")).alias("items_per_proposal"))


def proposals_by_region(proposals: DataFrame, region: str = "state_name") -> DataFrame:
    return proposals.groupBy(normalize_region_title(F.col(region)).alias("region")).agg(
        F.count(F.lit(1)).alias("proposals"))


def compare_by_region(volumes: DataFrame, proposals: DataFrame, region: str = "region", n: str = "items") -> DataFrame:
    """Item volume next to proposal counts, regions of either side kept.

    Regions meet on their lower-cased name, so two spellings of a connecting word
    do not split one region in two. No proposals: null ratio; no items: 0 and 0.0.
    """
    left = volumes.groupBy(F.lower(region).alias("k")).agg(F.min(region).alias("lr"), F.sum(n).alias(n))
    right = proposals.groupBy(F.lower("region").alias("k")).agg(
        F.min("region").alias("rr"), F.sum("proposals").alias("proposals"))
    ratio = F.when(F.col(n).isNull(), 0.0).otherwise(safe_ratio(F.col(n), F.col("proposals")))
    return left.join(right, "k", "full_outer").select(
        F.coalesce("lr", "rr").alias("region"), F.coalesce(n, F.lit(0)).alias(n),
        F.coalesce("proposals", F.lit(0)).alias("proposals"), ratio.alias("items_per_proposal"))


def activity_counts(proposals: DataFrame, column: str = "other_property") -> DataFrame:
    return (
        proposals.select(extract_activity(F.col(column)).alias("activity")).filter("activity is not null")
        .groupBy("activity").agg(F.count(F.lit(1)).alias("proposals"))
    )


def top_by_value(proposals: DataFrame, value: str, tie: str, k: int = 25) -> DataFrame:
    """The k largest rows whose value is present and not zero."""
    return proposals.filter(F.col(value).isNotNull() & (F.col(value) != 0)).orderBy(F.col(value).desc(), tie).limit(k)


def proposal_spotcheck(proposals: DataFrame, corpus: DataFrame, text: str, k: int = 25) -> DataFrame:
    """The largest proposals and whether the company each names appears in any text."""
    top = top_by_value(proposals, "investment_cost", "proposal_no", k).withColumn(
        "company", extract_company(F.col("project_name")))
    return flag_mentioned(top, "company", corpus, text).select(
        "proposal_no", F.coalesce("project_name", F.lit("")).alias("project_name"),
        F.coalesce("company", F.lit("")).alias("company"), normalize_region_title(F.col("state_name")).alias("region"),
        "investment_cost", "status", date_prefix(F.col("start_date"), True).alias("start_date"), "mentioned")


def spotcheck_totals(spotcheck: DataFrame) -> DataFrame:
    named = F.col("company") != ""
    return spotcheck.agg(F.count_if(named).alias("with_company"),
                         F.count_if(named & F.coalesce("mentioned", F.lit(False))).alias("mentioned"))


def by_grade(rows: DataFrame) -> DataFrame:
    return rows.orderBy("grade_order", "scheme")


def by_target_and_mentions(rows: DataFrame) -> DataFrame:
    return rows.orderBy("target", F.col("mentions").desc(), "title")


def by_proposals(rows: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked(rows, "proposals", "region", limit=limit)
