"""Resolving askers against rosters: exact name, fuzzy name, code.

Names are matched once per distinct name, never once per item, so a name that
asks a third of all items costs one lookup.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.labels import (
    canonical_group, canonical_region, canonical_target, name_tokens, normalize_name, nullif_blank, or_unknown,
    trim_blanks,
)
from itemlens.functions.text import strip_html
from itemlens.functions.values import join_askers, lead_asker
from itemlens.operators.counting import count_by, dedupe_last
from itemlens.session import checkpointed

# a token in more than 1/HOT_SHARE of all name tokens is hot; at most HOT_SHARE tokens can be
HOT_SHARE = 1000
# names that may share so few of their tokens that more first ones than this come into question meet on single tokens
MOST_FIRST = 8


def roster_index(roster: DataFrame, names: list[str], order: str) -> DataFrame:
    """One row per normalised name: ``name``, ``roster_order`` and the record columns.

    A person is listed under each of ``names``; where two people share a
    normalised name, the later row by ``order`` wins. ``first_order`` is the
    earliest row that used the name and settles fuzzy ties.
    """
    record = [c for c in roster.columns if c not in names and c != order]
    keyed = roster.select(
        *record, order,
        F.posexplode(F.array(*[normalize_name(nullif_blank(F.col(n))) for n in names])).alias("_pos", "name"),
    ).filter(F.col("name").isNotNull())
    at = F.struct(F.col(order), F.col("_pos"))
    return keyed.groupBy("name").agg(
        F.max_by(F.struct(*record), at).alias("_rec"), F.min(at).alias("first_order"),
    ).select("name", "first_order", "_rec.*")


def match_exact_name(names: DataFrame, index: DataFrame, name: str = "norm") -> DataFrame:
    """Left join of normalised names to the index; no hit leaves the record columns null."""
    return names.join(index.withColumnRenamed("name", name), name, "left")


def match_fuzzy_name(names: DataFrame, index: DataFrame, name: str = "norm",
                     threshold: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """Best index name per distinct ``name`` by token overlap: (name, matched_name, score).

    score = shared tokens of 3+ letters / union of the name's such tokens and all
    tokens of the index name; kept at >= threshold, ties to the earliest roster row.

    Names of the same tokens are one, however many they are. Two names of a and b tokens can only reach the threshold with
    o = ceil(threshold (a + b) / (1 + threshold)) shared tokens. In one common order, which puts hot tokens last, two such names then share
    one of the first (count - o + 1) tokens of either, and, if o is two or more, two of the first (count - o + 2): they meet on pairs of
    tokens where they can, so a word that half of all names share brings few of them together. Before lists are compared, the
    places of the tokens met and a bitmap of all tokens bound what two names can share.
    """
    asked = names.select(F.col(name).alias("q")).filter("q is not null").distinct()
    asked = asked.withColumn("q_words", F.array_sort(_long_tokens(name_tokens(F.col("q")))))
    known = index.select(F.col("name").alias("r"), "first_order").withColumn("r_all", F.array_sort(name_tokens(F.col("r"))))
    best_of = F.min(F.struct("first_order", "r"))
    known = checkpointed(known.filter(F.size("r_all") > 0).groupBy("r_all").agg(best_of.alias("r")).withColumn("r_words", _long_tokens(F.col("r_all"))))
    asked = checkpointed(asked.filter(F.size("q_words") > 0))
    hot = _hot_tokens(known, "r_words")

    def need(a: Column, b: Column) -> Column:
        # a hair below the product, so that rounding can only add candidates
        return F.greatest(F.lit(1), F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)).cast("int"))

    def side(df: DataFrame, words: str, keep: list[str], own: str, other: str) -> DataFrame:
        """A row for each partner size and each token or pair of tokens to meet on: (keep, qa, rb, key, left)."""
        sized = _rare_first(df, words, hot, [*keep, own]).withColumn("bits", _bitmap(F.col(words))).withColumn(
            other, F.explode(_sizes(F.col(own), threshold)))
        count, o = F.size(words), need(F.col("qa"), F.col("rb"))
        singles = F.transform(F.slice(words, F.lit(1), F.greatest(F.lit(0), count - o + 1)), lambda t, i: F.struct(t.alias("key"), (count - i).alias("left")))
        pairs = _pairs(F.slice(words, F.lit(1), F.greatest(F.lit(0), count - o + 2)), count)
        return sized.select(*keep, words, "bits", "qa", "rb", F.inline(
            F.when((o >= 2) & (F.greatest("qa", "rb") - o <= MOST_FIRST), pairs).otherwise(singles)))

    q = side(asked.select("q_words").distinct().withColumn("qa", F.size("q_words")), "q_words", [], "qa", "rb")
    r = side(known.withColumn("rb", F.size("r_all")), "r_words", ["r", "r_all"], "rb", "qa")
    q, r = q.withColumnsRenamed({"bits": "q_bits", "left": "q_left"}), r.withColumnsRenamed({"bits": "r_bits", "left": "r_left"})
    least = need(F.col("qa"), F.col("rb"))
    # tokens that fall on one bit may hide as many shared ones
    hidden = F.least(F.col("qa") - F.bit_count("q_bits"), F.size("r_words") - F.bit_count("r_bits"))
    bound = (F.least("q_left", "r_left") >= least) & (F.bit_count(F.col("q_bits").bitwiseAND(F.col("r_bits"))) + hidden >= least)
    met = q.join(r, ["key", "qa", "rb"]).filter(bound)
    shared = F.size(F.array_intersect("q_words", "r_all"))
    scored = met.withColumn("o", shared).select("q_words", "r", (F.col("o") / (F.col("qa") + F.col("rb") - F.col("o"))).alias("score")).filter(F.col("score") >= threshold)
    best = F.min_by(F.struct("r.r", "score"), F.struct((-F.col("score")).alias("s"), "r"))
    found = scored.groupBy(F.array_sort("q_words").alias("q_words")).agg(best.alias("m"))
    return asked.join(found, "q_words").select(F.col("q").alias(name), F.col("m.r").alias("matched_name"), F.col("m.score").alias("score"))


def _pairs(words: Column, count: Column) -> Column:
    """array<struct(key, left)>: pairs of a list's tokens, and how many of all ``count`` tokens are not before the second, plus one."""
    def after(x, i):
        return F.transform(F.slice(words, i + 2, F.size(words)), lambda y, j: F.struct(F.concat_ws(" ", x, y).alias("key"), (count - i - j).alias("left")))

    return F.flatten(F.transform(words, after))


def _bitmap(words: Column) -> Column:
    one = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(one(t)))


def _long_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: F.length(w) > 2)


def _sizes(n: Column, threshold: float) -> Column:
    """Token counts a partner of a name with n tokens can have."""
    low = F.greatest(F.lit(1), F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    high = F.floor(n / F.lit(threshold) + F.lit(1e-9)).cast("int")
    return F.sequence(low, high)


def _hot_tokens(known: DataFrame, words: str) -> DataFrame:
    """Tokens with more than 1/HOT_SHARE of all occurrences: at most HOT_SHARE rows."""
    seen = known.select(F.explode(words).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    total = seen.agg(F.sum("n")).scalar()
    return seen.filter(F.col("n") * HOT_SHARE > total)


def _rare_first(df: DataFrame, words: str, hot: DataFrame, keep: list[str]) -> DataFrame:
    """Sort each token list by (count of a hot token, else 0; token)."""
    counts = hot.agg(F.map_from_entries(F.collect_list(F.struct("t", "n")))).scalar()
    ordered = F.array_sort(F.transform(
        F.col(words), lambda w: F.struct(F.coalesce(F.col("_hot")[w], F.lit(0)).alias("n"), w.alias("w"))))
    return df.withColumn("_hot", counts).select(*keep, F.transform(ordered, lambda x: x["w"]).alias(words))


def resolve_names(names: DataFrame, index: DataFrame, name: str, threshold: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """Exact match, then fuzzy for what is left: (name, matched_name, record columns).

    ``names`` may repeat; the result has each distinct raw name once. The distinct
    names and the index are used several times over, so both are checkpointed:
    the items themselves are read once.
    """
    distinct = checkpointed(names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn(
        "norm", normalize_name(F.col(name))))
    index = checkpointed(index)
    exact = distinct.join(index.select(F.col("name").alias("norm")), "norm", "left_semi")
    rest = distinct.join(index.select(F.col("name").alias("norm")), "norm", "left_anti")
    fuzzy = rest.join(match_fuzzy_name(rest, index, "norm", threshold).drop("score"), "norm")
    matched = exact.select(name, F.col("norm").alias("matched_name")).unionByName(fuzzy.select(name, "matched_name"))
    return matched.join(index.withColumnRenamed("name", "matched_name"), "matched_name").select(
        name, "matched_name", *[c for c in index.columns if c not in ("name", "first_order")])


def match_code(items: DataFrame, roster: DataFrame, code: str, roster_code: str) -> DataFrame:
    """Left join on a code; ``matched`` tells a hit."""
    known = roster.withColumnRenamed(roster_code, code).withColumn("matched", F.lit(True))
    return items.join(known, code, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def unmatched_askers(items: DataFrame, chamber: str, name: str, need_name: list[str],
                     matched: str = "matched", out: str = "count", weight: str | None = None) -> DataFrame:
    """Items per asker without a roster hit; chambers in ``need_name`` skip items with no asker. ``weight``: how many items a row stands for."""
    missing = ~F.col(matched) & (nullif_blank(F.col(name)).isNotNull() | ~F.col(chamber).isin(need_name))
    return count_by(items.filter(missing), chamber, F.col(name).alias("name"), out=out, weight=weight)


def enrich_items_a(raw: DataFrame, index: DataFrame, chamber: str = K.CHAMBER_A) -> DataFrame:
    """Chamber A items in the fixed shape plus ``matched``; the asker is resolved by name."""
    lead = F.when(F.size(F.coalesce("member", F.array())) > 0, lead_asker(F.col("member")))
    items = raw.withColumn("_lead", lead)
    who = resolve_names(items, index, "_lead")
    out = items.join(who.withColumn("_hit", F.lit(True)), "_lead", "left")
    return out.select(
        F.lit(chamber).alias("chamber"), F.col("quesNo").alias("ques_no"), F.col("sessionNo").alias("session_no"),
        "date", "type", canonical_target(F.col("ministry")).alias("ministry"),
        trim_blanks(F.coalesce("subjects", F.lit(""))).alias("subject"),
        F.col("_lead").alias("member"), join_askers(F.col("member")).alias("all_members"),
        F.coalesce("party", F.lit(K.UNKNOWN)).alias("party"), "party_full",
        or_unknown(trim_blanks(F.col("state"))).alias("state"),
        *[F.lit(None).cast("string").alias(c) for c in ("question_text", "answer_text", "answer_pdf_url")],
        F.coalesce("_hit", F.lit(False)).alias("matched"),
    )


def enrich_items_b(raw: DataFrame, roster: DataFrame, chamber: str = K.CHAMBER_B) -> DataFrame:
    """Chamber B items in the fixed shape plus ``matched``; the asker is resolved by code."""
    known = roster.select(F.col("mpsno"), "party", "party_full", "state")
    out = match_code(raw, known, "mp_code", "mpsno")
    text = lambda c: trim_blanks(F.coalesce(F.col(c), F.lit("")))
    return out.select(
        F.lit(chamber).alias("chamber"), F.col("qno").alias("ques_no"), F.col("ses_no").alias("session_no"),
        F.col("ans_date").alias("date"), text("qtype").alias("type"),
        canonical_target(F.col("min_name")).alias("ministry"), text("qtitle").alias("subject"),
        text("name").alias("member"), text("name").alias("all_members"),
        F.coalesce("party", F.lit(K.UNKNOWN)).alias("party"), "party_full",
        or_unknown(trim_blanks(F.col("state"))).alias("state"),
        strip_html(F.col("qn_text")).alias("question_text"), strip_html(F.col("ans_text")).alias("answer_text"),
        F.col("files").alias("answer_pdf_url"), "matched", F.col("name").alias("raw_name"),
    )


def all_items(*parts: DataFrame) -> DataFrame:
    """UNION ALL in the fixed column order."""
    shaped = [p.select(*K.ITEM_COLUMNS) for p in parts]
    out = shaped[0]
    for p in shaped[1:]:
        out = out.unionByName(p)
    return out


def fill_unknown(items: DataFrame, cols: list[str]) -> DataFrame:
    return items.withColumns({c: or_unknown(F.col(c)) for c in cols})


def canonical_roster_a(roster: DataFrame) -> DataFrame:
    """Group = short name, else full name, else Unknown; canonical group and region."""
    group = F.coalesce(nullif_blank(F.col("partySname")), nullif_blank(F.col("partyFname")), F.lit(K.UNKNOWN))
    return roster.select(
        "mpFirstLastName", "mpLastFirstName", canonical_group(group).alias("party"),
        F.col("partyFname").alias("party_full"), canonical_region(F.col("stateName")).alias("state"),
        F.col("constName").alias("constituency"), F.col("mpFirstLastName").alias("canonical_name"), "roster_order",
    )


def canonical_roster_b(roster: DataFrame) -> DataFrame:
    """Current and former rosters: the last row per code by (file, row)."""
    group = F.coalesce(nullif_blank(F.col("partyCode")), F.lit(K.UNKNOWN))
    shaped = roster.select(
        "mpsno", canonical_group(group).alias("party"), F.col("party").alias("party_full"),
        canonical_region(F.col("state")).alias("state"),
        trim_blanks(F.coalesce("name", F.lit(""))).alias("canonical_name"), "file_order", "roster_order",
    )
    return dedupe_last(shaped, ["mpsno"], ["file_order", "roster_order"]).drop("file_order", "roster_order")
