"""Results as files, tables and views."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.sources.readers import read_table_inferred

# --- fixed values: result tables by name ---------------------------------------
RESULT_TABLES = {
    "ls_questions": "ls_questions_enriched.csv",
    "rs_questions": "rs_questions_enriched.csv",
    "party_summary": "party_summary.csv",
    "ministry_summary": "ministry_summary.csv",
    "state_summary": "state_summary.csv",
    "party_ministry_matrix_wide": "party_ministry_matrix.csv",
    "party_type_matrix_wide": "party_type_matrix.csv",
    "state_party_matrix_wide": "state_party_matrix.csv",
    "state_ministry_matrix_wide": "state_ministry_matrix.csv",
    "topic_keywords": "topic_keywords.csv",
    "unmatched_members": "unmatched_members.csv",
    "kg_party_ministry_lift": "kg_party_ministry_lift.csv",
    "kg_pagerank": "kg_pagerank.csv",
    "kg_party_communities": "kg_party_communities.csv",
    "kg_ministry_cooccurrence": "kg_ministry_cooccurrence.csv",
    "kg_mp_coasking_bridges": "kg_mp_coasking_bridges.csv",
    "pib_ministry_comparison": "pib_ministry_comparison.csv",
    "pib_scheme_comparison": "pib_scheme_comparison.csv",
    "pli_scheme_scrutiny": "pli_scheme_scrutiny.csv",
    "ministry_scheme_scrutiny": "ministry_scheme_scrutiny.csv",
    "parivesh_state_comparison": "parivesh_state_comparison.csv",
    "parivesh_activity_summary": "parivesh_activity_summary.csv",
    "parivesh_mega_projects": "parivesh_mega_projects.csv",
}


def write_table(df: DataFrame, path: str, cols: list[str] | None = None, fmt: str = "csv",
                partition_by: list[str] | None = None) -> None:
    """Columns in the given order; arrays become "; " text in CSV. One file per task, never one for all."""
    out = df.select(*(cols or df.columns))
    if fmt == "csv":
        out = out.select(*[
            F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in out.dtypes])
        out.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        writer = out.write.mode("overwrite").format(fmt)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_payload(sections: dict[str, DataFrame], path: str) -> None:
    """A nested result as one JSON folder per section, a row per line, structs and arrays kept."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


# A result document is one nested JSON value put together from sections, each a frame of one row with its ``body``. Sections are results: rankings,
# tables cut to their top, totals. What has a row per item belongs into a table.


def listed(df: DataFrame, order: list[Column], value: Column | None = None) -> DataFrame:
    """The rows as a list of objects, or of ``value``s, in the given order."""
    item = F.struct(*df.columns) if value is None else value
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, item.alias("item"))))
    return df.agg(F.to_json(F.transform(rows, lambda r: r["item"]), {"ignoreNullFields": "false"}).alias("body"))


def single(df: DataFrame) -> DataFrame:
    """The only row as an object; null if there is none."""
    return df.agg(F.coalesce(F.to_json(F.first(F.struct(*df.columns)), {"ignoreNullFields": "false"}), F.lit("null")).alias("body"))


def lists_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """An object with a list of objects for each key, keys in order."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*[c for c in df.columns if c != key]).alias("item"))))
    per_key = df.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r["item"]), {"ignoreNullFields": "false"}).alias("body"))
    return _object(per_key.select(F.col(key).alias("at"), F.col(key).alias("name"), "body"))


def nested(sections: dict[str, DataFrame]) -> DataFrame:
    """An object of sections, in their order."""
    named = [df.select(F.lit(i).alias("at"), F.lit(name).alias("name"), "body") for i, (name, df) in enumerate(sections.items())]
    return _object(reduce(DataFrame.unionAll, named))


def _object(members: DataFrame) -> DataFrame:
    quoted = F.regexp_extract(F.to_json(F.array("name")), r"(?s)^\[(.*)\]$", 1)
    every = F.array_sort(F.collect_list(F.struct("at", F.concat(quoted, F.lit(":"), "body").alias("text"))))
    return members.agg(F.concat(F.lit("{"), F.array_join(F.transform(every, lambda m: m["text"]), ","), F.lit("}")).alias("body"))


def write_document(document: DataFrame, path: str) -> None:
    """A document as one file below ``path``, which appears when the job commits; a failed or repeated task leaves none behind."""
    document.coalesce(1).write.mode("overwrite").text(path)


def register_views(spark: SparkSession, frames: dict[str, DataFrame | None]) -> list[str]:
    """Temp views under the given names; a missing input (None) is skipped."""
    names = [n for n, df in frames.items() if df is not None]
    for n in names:
        frames[n].createOrReplaceTempView(n)
    return names


def register_tables(spark: SparkSession, folder: str, tables: dict[str, str] = RESULT_TABLES) -> list[str]:
    """Result files of a folder as typed views; those not there are skipped."""
    return register_views(spark, {n: read_table_inferred(spark, f"{folder}/{f}") for n, f in tables.items()})


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
