"""Column expressions that canonicalise labels and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlens import constants as K

# (?U): the no-break space and its kin count as blanks, which Java's plain \s misses
BLANKS = r"(?U)\s+"
EDGE_BLANKS = r"(?U)^\s+|\s+$"


def trim_blanks(col: Column) -> Column:
    return F.regexp_replace(col, EDGE_BLANKS, "")


def collapse_blanks(col: Column) -> Column:
    return F.regexp_replace(col, BLANKS, " ")


def nullif_blank(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def lookup(key: Column, table: dict) -> Column:
    """Value of a small constant table, null when the key is absent."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def or_unknown(col: Column) -> Column:
    return F.coalesce(nullif_blank(col), F.lit(K.UNKNOWN))


def canonical_group(col: Column, aliases: dict = K.GROUP_ALIASES) -> Column:
    name = trim_blanks(col)
    known = F.coalesce(lookup(F.upper(name), aliases), name)
    return F.when(nullif_blank(col).isNull(), K.UNKNOWN).otherwise(known)


def canonical_region(col: Column, aliases: dict = K.REGION_ALIASES) -> Column:
    name = collapse_blanks(trim_blanks(col))
    return or_unknown(F.coalesce(lookup(F.upper(name), aliases), name))


def canonical_target(col: Column, aliases: dict = K.TARGET_ALIASES) -> Column:
    commas = F.regexp_replace(trim_blanks(col), r"(?U),\s*", ", ")
    ands = F.regexp_replace(commas, r"(?U)\s*&\s*", " AND ")
    name = or_unknown(F.upper(collapse_blanks(ands)))
    return F.when(nullif_blank(col).isNull(), K.UNKNOWN).otherwise(F.coalesce(lookup(name, aliases), name))


def normalize_name(col: Column, honorifics: list = K.HONORIFICS) -> Column:
    # one repeated group strips any run of honorifics; each needs a blank after it
    leading = r"(?iU)^(?:(?:" + "|".join(honorifics) + r")\s+)+"
    return F.lower(collapse_blanks(F.regexp_replace(trim_blanks(col), leading, "")))


def name_tokens(name: Column) -> Column:
    """Distinct blank-separated tokens of a normalised name."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def normalize_label(col: Column) -> Column:
    body = F.regexp_replace(trim_blanks(col), r"(?iU)^(?:Ministry of|Department of)\s+", "")
    body = F.substring_index(body, " - ", 1)
    body = F.regexp_replace(F.replace(body, F.lit("&"), F.lit("AND")), "[,.]", " ")
    return F.coalesce(F.upper(trim_blanks(collapse_blanks(body))), F.lit(""))


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_region_title(col: Column, aliases: dict = K.REGION_TITLE_ALIASES) -> Column:
    name = trim_blanks(col)
    known = F.coalesce(lookup(F.upper(name), aliases), title_case(name))
    return F.when(nullif_blank(col).isNull(), K.UNKNOWN).otherwise(known)


def normalize_type(col: Column) -> Column:
    return F.coalesce(nullif_blank(F.upper(trim_blanks(col))), F.lit("UNKNOWN"))
