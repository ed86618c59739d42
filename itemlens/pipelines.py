"""From landed files to result tables: enrich, count, relate. Each step takes DataFrames; ``run`` does all and writes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.operators import counting as C
from itemlens.operators import graph as G
from itemlens.operators import matching as M
from itemlens.operators.communities import communities, community_table
from itemlens.operators.pagerank import pagerank, pagerank_report
from itemlens.operators.terms import top_terms, top_terms_by_group
from itemlens.session import checkpointed
from itemlens.sources import readers as R
from itemlens.sources import writers as W


@dataclass
class Landed:
    """Paths of landed files: items and rosters of both chambers, later rosters of chamber B after earlier ones."""

    items_a: str
    roster_a: str
    items_b: str
    rosters_b: list[str] = field(default_factory=list)


def enrich(spark: SparkSession, landed: Landed) -> DataFrame:
    """All items in the fixed shape with ``matched`` and the asker's name as landed."""
    people = M.canonical_roster_a(R.read_roster_a(spark, landed.roster_a))
    a = M.enrich_items_a(R.read_items_a(spark, landed.items_a), M.roster_index(people, ["mpFirstLastName", "mpLastFirstName"], "roster_order"))
    b = M.enrich_items_b(R.read_items_b(spark, landed.items_b), M.canonical_roster_b(R.read_roster_b(spark, landed.rosters_b)))
    return a.withColumn("raw_name", F.col("member")).unionByName(b.select(*a.columns, "raw_name"))


CELLS = ["chamber", "type", "party", "state", "ministry"]
SETS = {"cells": CELLS, "subjects": ["party", "subject"], "names": ["chamber", "matched", "raw_name"]}


def item_counts(items: DataFrame) -> dict[str, DataFrame]:
    """What all counting tables come from, by one pass over the items and one shuffle of their counts: ``cells`` (chamber, type, party, state,
    ministry, n_items), ``subjects`` (party, subject, n_items, first) and ``names`` (chamber, matched, raw_name, n_items)."""
    columns = list(dict.fromkeys(c for own in SETS.values() for c in own))
    sets = [[F.col(c) for c in own] for own in SETS.values()]
    # the bits say which columns a row's set leaves out, so a null value is not taken for one
    counted = checkpointed(items.groupingSets(sets, *columns).agg(
        F.count(F.lit(1)).alias("n_items"), F.min("ques_no").alias("first"), F.grouping_id(*columns).alias("set")))
    out = {}
    for name, own in SETS.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own)
        out[name] = counted.filter(F.col("set") == bits).select(*own, "n_items", *(["first"] if name == "subjects" else []))
    return out


def count_step(items: DataFrame, counts: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The counting tables by name, all from ``item_counts``."""
    n = "n_items"
    counts = counts or item_counts(items)
    cells, same = counts["cells"], counts["subjects"].withColumnRenamed(n, "m")
    everyone = same.select("subject", "m", "first", F.lit("ALL").alias("party"))
    return {
        "party_summary": C.group_summary(cells, weight=n),
        "ministry_summary": C.count_by(cells, "ministry", out="questions", weight=n),
        "state_summary": C.count_by(cells, "state", out="questions", weight=n),
        "party_ministry_matrix_wide": C.cross_tab(C.cell_counts(cells, "party", "ministry", weight=n), "party", "ministry"),
        "party_type_matrix_wide": C.cross_tab(C.type_cells(cells, weight=n), "party", "type"),
        "state_party_matrix_wide": C.cross_tab(C.cell_counts(cells, "state", "party", weight=n), "state", "party"),
        "state_ministry_matrix_wide": C.cross_tab(C.cell_counts(cells, "state", "ministry", weight=n), "state", "ministry"),
        "topic_keywords": top_terms_by_group(everyone, "party", "subject", "first", 30, "m").drop("rank").unionByName(
            top_terms_by_group(same, "party", "subject", "first", weight="m").drop("rank")),
        "unmatched_members": M.unmatched_askers(counts["names"], "chamber", "raw_name", [K.CHAMBER_A], weight=n),
        "kg_party_ministry_lift": C.lift(cells, weight=n).filter(F.col("questions") >= K.MIN_LIFT_ITEMS),
    }


def relate_step(items: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    """The graph tables by name; ``topics`` (party, term, count)."""
    order = ["date", "ques_no", "chamber"]
    named = R.group_topics(topics)
    nodes, edges = G.similarity_graph(items)
    nodes = checkpointed(nodes)
    lists = items.filter(F.col("chamber") == K.CHAMBER_A).withColumn("askers", F.array_distinct(F.filter(
        F.split("all_members", r"\s*;\s*"), lambda x: x != "")))
    signed = G.last_joint_item(lists, ["ques_no", "session_no"], order).select("ques_no", "session_no", F.explode("askers").alias("asker"))
    pairs = G.joint_asker_pairs(signed, ["ques_no", "session_no"], "asker")
    groups = G.asker_profile(items, order).select(F.col("member").alias("asker"), "party")
    return {
        "kg_pagerank": C.ranked(pagerank_report(pagerank(G.focus_edges(items, named))), "pagerank", "node"),
        "kg_party_communities": community_table(communities(nodes, edges), nodes),
        "kg_ministry_cooccurrence": G.top_cooccurring_targets(items.filter(F.col("member").isNotNull())),
        "kg_mp_coasking_bridges": G.cross_group_bridges(pairs, groups, "asker", "party"),
    }


def matrix_section(cells: DataFrame, row: str, col: str, cols_name: str, top_cols: int, top_rows: int | None = None, n: str = "n") -> DataFrame:
    """{columns: [..], rows: [{row, values}]}: the biggest columns, and the rows by their totals over all columns."""
    cut = checkpointed(C.top_matrix(cells, row, col, n, top_cols, top_rows))
    return W.nested({
        cols_name: cut.agg(F.coalesce(F.to_json(F.first("columns")), F.lit("[]")).alias("body")),
        "rows": W.listed(cut, [-F.col("row_total"), F.col(row)], F.struct(row, "values"))})


def counts_document(cells: DataFrame, topics: DataFrame, totals: DataFrame, n: str = "n_items", chambers: dict | None = None) -> DataFrame:
    """The result document of the counting step. ``cells`` (chamber, type, party, state, ministry, n), ``topics`` (party, term, count) with the row
    group ALL for everybody, ``totals`` one row."""
    totalled = C.group_summary(cells, chambers=chambers, total="total", weight=n)
    count = lambda key: W.listed(C.count_by(cells, key, out="questions", weight=n), [-F.col("questions"), F.col(key)])
    pair = lambda a, b: C.cell_counts(cells, a, b, weight=n)
    terms = checkpointed(topics.select("party", "term", F.col("count").cast("long").alias("count")))
    by_count = [-F.col("count"), F.col("term")]
    return W.nested({
        "party_summary": W.listed(totalled, [-F.col("total"), F.col("party")]), "ministry_summary": count("ministry"), "state_summary": count("state"),
        "party_ministry_matrix": matrix_section(pair("party", "ministry"), "party", "ministry", "ministries", K.DOCUMENT_TARGETS),
        "state_party_matrix": matrix_section(pair("state", "party"), "state", "party", "parties", K.DOCUMENT_REGIONS, K.DOCUMENT_REGIONS),
        "state_ministry_matrix": matrix_section(pair("state", "ministry"), "state", "ministry", "ministries", K.DOCUMENT_TARGETS, K.DOCUMENT_REGIONS),
        "party_type_matrix": matrix_section(C.type_cells(cells, weight=n), "party", "type", "types", K.DOCUMENT_TARGETS),
        "overall_topics": W.listed(terms.filter(F.col("party") == "ALL").select("term", "count"), by_count),
        "party_topics": W.lists_by_key(terms.filter(F.col("party") != "ALL"), "party", by_count),
        "totals": W.single(totals)})


def graph_document(stats: DataFrame, lifts: DataFrame, ranks: DataFrame, members: DataFrame, shared: DataFrame, bridges: DataFrame) -> DataFrame:
    """The result document of the graph step: totals, and the top of each ranking."""
    top = lambda df, k, order: W.listed(df.orderBy(*order).limit(k), order)
    return W.nested({
        "stats": W.single(stats),
        "signature_ministries": top(lifts, 60, [-F.col("lift"), -F.col("questions"), F.col("party"), F.col("ministry")]),
        "pagerank_top": top(ranks, 40, [-F.col("pagerank"), F.col("node")]),
        "party_communities": W.listed(members, [F.col("community"), -F.col("items"), F.col("group")]),
        "ministry_cooccurrence_top": top(shared, 40, [-F.col("shared_askers"), F.col("target_a"), F.col("target_b")]),
        "cross_party_bridges_top": top(bridges, 30, [-F.col("joint_items"), F.col("asker_a"), F.col("asker_b")])})


def run(spark: SparkSession, landed: Landed, folder: str, graph: bool = True) -> list[str]:
    """Enrich, count and relate what was landed, write every table and the result documents below ``folder`` and register the tables as views."""
    items = checkpointed(enrich(spark, landed))
    counts = item_counts(items)
    cells = counts["cells"]
    tables = count_step(items, counts)
    for name, df in tables.items():
        W.write_table(df, f"{folder}/{W.RESULT_TABLES[name]}")
    topics = R.read_table(spark, f"{folder}/{W.RESULT_TABLES['topic_keywords']}", R.TOPICS)
    W.write_document(counts_document(cells, topics, C.corpus_totals(items)), f"{folder}/data.json")
    if graph:
        related = {name: checkpointed(df) for name, df in relate_step(items, topics).items()}
        for name, df in related.items():
            W.write_table(df, f"{folder}/{W.RESULT_TABLES[name]}")
        stats = cells.agg(F.countDistinct("party").alias("parties"), F.countDistinct("ministry").alias("ministries")).select(
            "*", items.agg(F.countDistinct("member")).scalar().alias("askers"),
            related["kg_mp_coasking_bridges"].agg(F.count(F.lit(1))).scalar().alias("cross_party_pairs"))
        W.write_document(graph_document(
            stats, tables["kg_party_ministry_lift"], related["kg_pagerank"], related["kg_party_communities"],
            related["kg_ministry_cooccurrence"], related["kg_mp_coasking_bridges"]), f"{folder}/graph.json")
    return W.register_tables(spark, folder)
