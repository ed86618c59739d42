"""Column expressions over lists, numbers, dates and keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.labels import lookup, trim_blanks


def lead_asker(askers: Column) -> Column:
    return F.get(askers, F.lit(0))


def join_askers(askers: Column) -> Column:
    return F.coalesce(F.array_join(askers, "; "), F.lit(""))


def split_askers(col: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ";"), trim_blanks)
    return F.filter(parts, lambda p: p != "")


def months_since(col: Column, as_of: str) -> Column:
    """Whole days up to ``as_of`` in months of 30.44 days; null for a bad date."""
    stamp = F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), col).try_cast("timestamp_ntz")
    now = F.lit(as_of).cast("timestamp_ntz")
    days = F.floor(F.timestamp_diff("SECOND", stamp, now) / 86400)
    return F.round(days / F.lit(K.DAYS_PER_MONTH), 1)


def is_granted(status: Column) -> Column:
    return F.coalesce(F.contains(F.lower(status), F.lit("grant")), F.lit(False))


def safe_ratio(n: Column, d: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def percent_paid(paid: Column, outlay: Column) -> Column:
    share = F.try_divide(100 * F.coalesce(paid.cast("double"), F.lit(0.0)), outlay.cast("double"))
    return F.round(share, 2)


def grade_order(grade: Column) -> Column:
    return F.coalesce(lookup(grade, K.GRADE_ORDER).cast("int"), F.lit(K.GRADE_ORDER_OTHER))


def date_prefix(col: Column, blank_for_null: bool = False) -> Column:
    day = F.substring(col, 1, 10)
    return F.coalesce(day, F.lit("")) if blank_for_null else day


def node_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(kind + ":"), label)


def split_node_id(col: Column) -> Column:
    parts = F.split(col, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("type"), F.get(parts, F.lit(1)).alias("label"))


def starred_share(starred: Column, unstarred: Column) -> Column:
    share = F.try_divide(100.0 * starred, (starred + unstarred).cast("double"))
    return F.coalesce(share, F.lit(0.0))


def in_crore(col: Column) -> Column:
    return F.round(col / F.lit(1e7), 0)
