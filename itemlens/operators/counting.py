"""Counts, cross-tabs, shares, ranks and top-k.

Every count is a plain ``groupBy``: Spark adds up inside each task before it
shuffles, so a key holding a third of all rows still sends one row per task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlens import constants as K
from itemlens.functions.labels import normalize_type
from itemlens.session import checkpointed


def count_by(df: DataFrame, *keys, out: str = "n", weight: str | None = None) -> DataFrame:
    """Rows per key; where a row stands for several, ``weight`` names their number."""
    return df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias(out))


def group_summary(
    items: DataFrame,
    group: str = "party",
    chamber: str = "chamber",
    chambers: dict | None = None,
    total: str = "total_questions",
    weight: str | None = None,
) -> DataFrame:
    """Items per group: one column per chamber and the total."""
    chambers = chambers or {K.CHAMBER_A: "lok_sabha_questions", K.CHAMBER_B: "rajya_sabha_questions"}
    n = F.col(weight) if weight else F.lit(1).cast("long")
    per_chamber = [F.sum(F.when(F.col(chamber) == value, n).otherwise(F.lit(0).cast("long"))).alias(out) for value, out in chambers.items()]
    return items.groupBy(group).agg(*per_chamber, F.sum(n).alias(total))


def cell_counts(df: DataFrame, row: str, col: str, out: str = "n", weight: str | None = None) -> DataFrame:
    """Long form of a cross-tab: (row, col, n)."""
    return count_by(df, row, col, out=out, weight=weight)


def cross_tab(cells: DataFrame, row: str, col: str, n: str = "n", values: list | None = None) -> DataFrame:
    """Wide form of long counts, 0-filled, columns sorted.

    Takes the aggregated cells, so the pass over the pivot handles one row per
    cell. Without ``values`` Spark reads the column headers from the data; more of them
    than ``spark.sql.pivotMaxValues`` make no columns, and the result is the long form
    (row, col, n) with every cell that is not zero.
    """
    if not values:
        cells = checkpointed(cells)  # read for the headers and again for the counts
        most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        if cells.select(col).distinct().limit(most + 1).count() > most:
            return cells.groupBy(row, col).agg(F.sum(n).alias(n))
    pivoted = cells.groupBy(row).pivot(col, values) if values else cells.groupBy(row).pivot(col)
    return pivoted.agg(F.sum(n)).na.fill(0)


def type_cells(items: DataFrame, group: str = "party", kind: str = "type", out: str = "n", weight: str | None = None) -> DataFrame:
    return cell_counts(items.withColumn(kind, normalize_type(F.col(kind))), group, kind, out, weight)


def corpus_totals(items: DataFrame, chamber: str = "chamber", chambers: dict | None = None,
                  group: str = "party", unmatched: str = "matched") -> DataFrame:
    """One row: items per chamber, all items, items without a roster hit per chamber."""
    chambers = chambers or {K.CHAMBER_A: "lok_sabha", K.CHAMBER_B: "rajya_sabha"}
    counts = [F.count_if(F.col(chamber) == v).alias(out) for v, out in chambers.items()]
    missing = [F.count_if((F.col(chamber) == v) & ~F.col(unmatched)).alias("unmatched_" + out)
               for v, out in chambers.items()]
    return items.agg(*counts, F.count(F.lit(1)).alias("combined"), *missing)


def text_coverage(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(text).alias("n_with_text"))


def global_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """RANK() by ``value`` descending over the whole table, without one task holding it.

    The rank of a value is 1 + the number of rows above it, so only the table of
    distinct values is ordered as a whole. Totals of N items have at most
    sqrt(2N) distinct values, whatever the number of ranked rows.
    """
    df = checkpointed(df)
    above = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        count_by(df, value, out="_rows")
        .select(F.col(value).alias("_value"), (F.coalesce(F.sum("_rows").over(above), F.lit(0)) + 1).alias(out))
    )
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def ranked(df: DataFrame, n: str, *tie: str, limit: int | None = None) -> DataFrame:
    """Descending by ``n``, ties by key; ``limit`` makes it a distributed top-k."""
    ordered = df.orderBy(F.col(n).desc(), *tie)
    return ordered.limit(limit) if limit else ordered


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; Spark cuts each task to k rows per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; an aggregate, so copies merge before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def last_by(df: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    """Last value of each column per key (asker profile, joint item)."""
    o = F.struct(*order)
    return df.groupBy(key).agg(*[F.max_by(c, o).alias(c) for c in cols])


def first_by(df: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    o = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, o).alias(c) for c in cols])


def lift(items: DataFrame, group: str = "party", target: str = "ministry", n: str = "questions", weight: str | None = None) -> DataFrame:
    """n / (target total x group total / all items), three decimals.

    Totals are added up from the cells and joined back, not taken over a window:
    a group with very many targets is then never held in one task.
    """
    cells = cell_counts(items, group, target, n, weight)
    return lift_of_cells(cells, group, target, n)


def lift_of_cells(cells: DataFrame, group: str, target: str, n: str) -> DataFrame:
    cells = checkpointed(cells)  # four uses, one pass over the items
    by_group = cells.groupBy(group).agg(F.sum(n).alias(f"{group}_total"))
    by_target = cells.groupBy(target).agg(F.sum(n).alias(f"{target}_total"))
    total = cells.agg(F.sum(n)).scalar()
    expected = F.col(f"{target}_total") * (F.col(f"{group}_total") / total)
    return (
        cells.join(by_group, group)
        .join(by_target, target)
        .select(group, target, n, f"{target}_total", f"{group}_total",
                F.round(F.coalesce(F.try_divide(F.col(n), expected), F.lit(0.0)), 3).alias("lift"))
    )


def group_shares(items: DataFrame, group: str, n: str = "n", weight: str | None = None) -> DataFrame:
    per_group = checkpointed(count_by(items, group, out=n, weight=weight))
    total = per_group.agg(F.sum(n)).scalar()
    return per_group.select(group, n, total.alias("total"), (F.col(n) / total).alias("share"))


def top_matrix(
    cells: DataFrame, row: str, col: str, n: str = "n",
    top_cols: int = K.TOP_MATRIX_COLS, top_rows: int | None = None,
) -> DataFrame:
    """Cross-tab cut to the biggest columns and rows: (row, row_total, columns, values), biggest rows first.

    ``columns`` are the kept ones by total descending, ties by name, and ``values`` follow them; the row total counts
    all columns, as the cut is for display only.
    """
    cells = checkpointed(cells)  # row totals, column totals, header and values all come from it
    row_totals = cells.groupBy(row).agg(F.sum(n).alias("row_total"))
    col_totals = cells.groupBy(col).agg(F.sum(n).alias("_col_total"))
    if top_rows:
        row_totals = ranked(row_totals, "row_total", row, limit=top_rows)
    kept_cols = ranked(col_totals, "_col_total", col, limit=top_cols)
    # one row: the header, at most top_cols long
    header = kept_cols.agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_col_total")).alias("o"), F.col(col).alias("c")))),
                    lambda x: x["c"]))
    kept = cells.join(kept_cols, col, "left_semi").groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(col), F.col(n)))).alias("_cells"))
    return row_totals.join(kept, row, "left").withColumn("columns", header.scalar()).select(
        row, "row_total", "columns",
        F.transform("columns", lambda c: F.coalesce(F.col("_cells")[c], F.lit(0))).alias("values"),
    ).orderBy(F.col("row_total").desc(), row)


def two_ended(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k highest and k lowest rows by ``value``, with their end and position; rows without a value are left out."""
    present = checkpointed(df.filter(F.col(value).isNotNull()))

    def end(name, order):
        top = present.orderBy(order, F.col(key)).limit(k)
        pos = F.row_number().over(Window.orderBy(order, F.col(key)))
        return top.select(F.lit(name).alias("end"), pos.alias("position"), *df.columns)

    return end("high", F.col(value).desc()).unionByName(end("low", F.col(value).asc()))
