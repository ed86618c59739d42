"""Matching askers to rosters (J1-J4, S2, S4) and the registry."""

from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.operators import counting as C
from itemlens.operators import matching as M
from itemlens.operators import registry as R
from itemlens.functions.labels import normalize_name
from itemlens.plans.base import Suite, sql_flat, sql_trim
from itemlens.session import table

suite = Suite()

# --- names: a part's name, type and brand; each part is on the roster, and asked for under a spelling of its own ---


def people(spark, d):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), brand))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("party"), F.col("p_brand").alias("state"), (F.col("p_size") % 5).alias("way"),
        words.alias("w"), F.array_join(words, " ").alias("name"), F.array_join(F.reverse(words), " ").alias("reversed"))


def index(spark, d):
    return M.roster_index(people(spark, d).drop("way", "w"), ["name", "reversed"], "id")


def asked_names(spark, d):
    """As listed, in reverse, with a word left out, in another order, and somebody nobody knows."""
    w, way = F.col("w"), F.col("way")
    dropped = F.array_join(F.filter(w, lambda x, i: i != 2), " ")
    turned = F.array_join(F.concat(F.slice(w, 3, 2), F.slice(w, 1, 2)), " ")
    asker = (F.when(way == 0, F.concat(F.lit("Dr. "), "name")).when(way == 1, F.concat(F.lit("Smt. "), "reversed"))
             .when(way == 2, F.concat(F.lit("Dr. "), dropped)).when(way == 3, turned)
             .otherwise(F.concat(F.lit("Somebody Unknown "), F.col("id").cast("string"))))
    return people(spark, d).select("id", asker.alias("asker"))


def sql_norm(x: str) -> str:
    return f"lower({sql_flat('regexp_replace(' + sql_trim(x) + ', ' + chr(39) + '(?i)^(?:(?:' + '|'.join(K.HONORIFICS) + ')[ ]+)+' + chr(39) + ', ' + chr(39) * 2 + ')')})"


SQL_NAMES = rf"""
words AS (SELECT p_partkey AS id, p_type AS party, p_brand AS state, p_size % 5 AS way,
                 list_concat(string_split(p_name, ' '), [lower(p_type), lower(replace(p_brand, '#', ''))]) AS w FROM part),
named AS (SELECT *, array_to_string(w, ' ') AS name, array_to_string(list_reverse(w), ' ') AS reversed FROM words),
keyed AS (SELECT n.*, 0 AS pos, {sql_norm('name')} AS norm FROM named n UNION ALL SELECT n.*, 1, {sql_norm('reversed')} FROM named n),
idx AS (SELECT norm, min((id, pos)) AS first_order, arg_max(party, (id, pos)) AS party,
               arg_max(state, (id, pos)) AS state FROM keyed GROUP BY norm),
called AS (SELECT id, CASE way WHEN 0 THEN 'Dr. ' || name WHEN 1 THEN 'Smt. ' || reversed WHEN 2 THEN 'Dr. ' || array_to_string(w[1:2] || w[4:4], ' ')
  WHEN 3 THEN array_to_string(w[3:4] || w[1:2], ' ') ELSE 'Somebody Unknown ' || id END AS asker FROM named),
asked AS (SELECT id, asker, {sql_norm("asker")} AS norm FROM called),
rest AS (SELECT DISTINCT norm FROM asked WHERE norm NOT IN (SELECT norm FROM idx)),
qw AS (SELECT norm AS q, list_distinct(list_filter(string_split(norm, ' '), lambda x: length(x) > 2)) AS qw FROM rest),
rw AS (SELECT norm AS r, first_order, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS rw FROM idx),
shared AS (SELECT q, r, count(*) AS o FROM (SELECT q, unnest(qw) AS t FROM qw) JOIN (SELECT r, unnest(rw) AS t FROM rw) USING (t) GROUP BY ALL),
scored AS (SELECT q, r, first_order, o / (len(qw) + len(rw) - o) AS score FROM shared JOIN qw USING (q) JOIN rw USING (r)),
fuzzy AS (SELECT q AS norm, r AS matched_name, score FROM scored WHERE score >= 0.5
          QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, first_order, r) = 1)
"""


@suite.add(f"WITH {SQL_NAMES} SELECT norm AS name, struct_extract(first_order, 1) AS first_row, party, state FROM idx")
def roster_index(spark, d):
    return index(spark, d).select("name", F.col("first_order.id").alias("first_row"), "party", "state")


@suite.add(f"WITH {SQL_NAMES} SELECT id, coalesce(party, 'Unknown') AS party, coalesce(state, 'Unknown') AS state FROM asked LEFT JOIN idx USING (norm)")
def match_exact_name(spark, d):
    names = asked_names(spark, d).withColumn("norm", normalize_name(F.col("asker")))
    hit = M.match_exact_name(names, index(spark, d))
    return M.fill_unknown(hit.select("id", "party", "state"), ["party", "state"])


@suite.add(f"WITH {SQL_NAMES} SELECT norm, matched_name, score FROM fuzzy")
def match_fuzzy_name(spark, d):
    idx = index(spark, d)
    names = asked_names(spark, d).select(normalize_name(F.col("asker")).alias("norm")).distinct()
    rest = names.join(idx.select(F.col("name").alias("norm")), "norm", "left_anti")
    return M.match_fuzzy_name(rest, idx)


SQL_RESOLVED = f"""
WITH {SQL_NAMES},
who AS (SELECT norm, norm AS matched_name FROM idx UNION ALL SELECT norm, matched_name FROM fuzzy)
SELECT asked.id, asker, w.matched_name, i.party, i.state
FROM asked LEFT JOIN who w ON w.norm = asked.norm LEFT JOIN idx i ON i.norm = w.matched_name
"""


def resolved(spark, d):
    names = asked_names(spark, d)
    who = M.resolve_names(names, index(spark, d), "asker")
    return names.join(who, "asker", "left")


@suite.add(f"SELECT id, matched_name, coalesce(party, 'Unknown') AS party, coalesce(state, 'Unknown') AS state FROM ({SQL_RESOLVED})")
def resolve_names(spark, d):
    rows = resolved(spark, d).select("id", "matched_name", "party", "state")
    return M.fill_unknown(rows, ["party", "state"])


@suite.add(f"SELECT 'A' AS chamber, asker AS name, count(*) AS count FROM ({SQL_RESOLVED}) WHERE matched_name IS NULL GROUP BY ALL")
def unmatched_by_name(spark, d):
    rows = resolved(spark, d).select(F.lit("A").alias("chamber"), "asker", F.col("matched_name").isNotNull().alias("matched"))
    return M.unmatched_askers(rows, "chamber", "asker", ["A"])


# --- codes: every supplier is on the roster, but those under a balance are listed under a code that nobody asks by ---
SQL_CODES = """
SELECT l_linestatus AS chamber, l_suppkey AS mp_code, s_name AS party, s_name IS NOT NULL AS matched
FROM lineitem LEFT JOIN (SELECT CASE WHEN s_acctbal >= 1000 THEN s_suppkey ELSE -s_suppkey END AS code, s_name FROM supplier) ON code = l_suppkey
"""


def listed_code(least: int):
    """The code a supplier is listed under: its own from a balance of ``least`` on, else one that nobody asks by."""
    return F.when(F.col("s_acctbal") >= least, F.col("s_suppkey")).otherwise(-F.col("s_suppkey"))


def coded(spark, d):
    listed = table(spark, d, "supplier").select(listed_code(1000).alias("s_suppkey"), F.col("s_name").alias("party"))
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("chamber"), F.col("l_suppkey").alias("mp_code"))
    return M.match_code(rows, listed, "mp_code", "s_suppkey")


@suite.add(f"SELECT chamber, coalesce(party, 'Unknown') AS party, matched, count(*) AS n FROM ({SQL_CODES}) GROUP BY ALL")
def match_code(spark, d):
    rows = M.fill_unknown(coded(spark, d), ["party"])
    return C.count_by(rows, "chamber", "party", "matched")


@suite.add(f"SELECT chamber, mp_code::VARCHAR AS name, count(*) AS count FROM ({SQL_CODES}) WHERE NOT matched GROUP BY ALL")
def unmatched_askers(spark, d):
    rows = coded(spark, d).withColumn("name", F.col("mp_code").cast("string"))
    return M.unmatched_askers(rows, "chamber", "name", ["O"])


@suite.add("""
SELECT s_nationkey AS mpsno, 'Supplier ' || max(s_suppkey) AS canonical_name,
       CASE WHEN arg_max(s_acctbal, s_suppkey) < 0 THEN 'Unknown' ELSE 'SHS(UBT)' END AS party FROM supplier GROUP BY s_nationkey
""")
def roster_by_code(spark, d):
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("mpsno"), F.when(F.col("s_acctbal") >= 0, F.lit("ss-ubt ")).alias("partyCode"),
        F.lit("full").alias("party"), F.lit("Delhi").alias("state"), F.concat(F.lit(" Supplier "), s.cast("string")).alias("name"),
        F.lit(0).alias("file_order"), s.alias("roster_order"))
    return M.canonical_roster_b(rows).select("mpsno", "canonical_name", "party")


# --- registry: targets are customer nations, items orders, press items events, contacts suppliers ---
ALIASES = {
    "NATION_1": [f"Ministry of NATION_1 - Department of {k}" for k in ("click", "view", "none")],
    "NATION_2": ["Ministry of NATION_2 - Department of none"],
}
HOOKS = {"NATION_3": {"site": "three.example", "schema": "core", "path": "items"},
         "NATION_4": {"site": "four.example", "schema": "post", "path": "items"}}
DASHBOARDS = {"NATION_4": "four/items", "NATION_5": "five/items"}
SINCE_TS = "2024-01-10 00:00:00"


def volumes(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = C.count_by(table(spark, d, "orders"), "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return C.count_by(rows.select(F.col("n_name").alias("ministry"), "n"), "ministry", out="questions", weight="n")


def press(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    kind = F.when(F.col("event_type") == "error", F.lit("factsheet")).otherwise(F.lit("release"))
    rows = table(spark, d, "events").select("ts", "event_type", "user_id", kind.alias("kind"))
    rows = R.press_items_since(rows, F.lit(SINCE_TS).cast("timestamp_ntz"), "ts")
    return rows.join(c, F.col("user_id") == F.col("c_custkey")).select(
        F.concat(F.lit("Ministry of "), "n_name", F.lit(" - Department of "), "event_type").alias("ministry"))


def contacts(spark, d):
    bal = F.col("s_acctbal")
    rank = F.when(bal > 9000, "Minister").when(bal > 7000, "Minister of State (Independent Charge)").when(
        bal > 4000, "Minister of State").otherwise("Advisor")
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.concat(F.lit("Department of "), "n_name").alias("ministry"),
        F.when(bal < 0, F.lit("  ")).otherwise(F.col("s_name")).alias("contact_name"), rank.alias("designation"), "s_suppkey")


def registry(spark, d):
    return R.build_registry(volumes(spark, d), R.press_counts(press(spark, d)), contacts(spark, d), "s_suppkey",
                            aliases=ALIASES, hooks=HOOKS, proposal_targets=["NATION_6"], dashboards=DASHBOARDS)


SQL_PRESS = f"""
press AS (SELECT 'Ministry of ' || n_name || ' - Department of ' || event_type AS label, n_name
  FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey
  WHERE ts >= TIMESTAMP '{SINCE_TS}' AND event_type <> 'error'),
counts AS (SELECT label, n_name, count(*) AS n FROM press GROUP BY ALL)
"""
SQL_ALIAS = " UNION ALL ".join(
    f"SELECT '{t}' AS ministry, '{'; '.join(ls)}' AS press_label, (SELECT coalesce(sum(n), 0) FROM counts WHERE label IN ({', '.join(chr(39) + x + chr(39) for x in ls)}))::BIGINT AS press_items"
    for t, ls in ALIASES.items())
SQL_REGISTRY = f"""
WITH {SQL_PRESS},
vol AS (SELECT n_name AS ministry, count(*) AS questions FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name),
aliased AS ({SQL_ALIAS}),
generic AS (SELECT n_name AS ministry, min(label) AS press_label, sum(n)::BIGINT AS press_items FROM counts GROUP BY n_name),
labels2 AS (SELECT * FROM aliased UNION ALL SELECT * FROM generic WHERE ministry NOT IN (SELECT ministry FROM aliased)),
people AS (SELECT n_name AS ministry, s_name AS contact_name,
    CASE WHEN s_acctbal > 9000 THEN 'Minister' WHEN s_acctbal > 7000 THEN 'Minister of State (Independent Charge)'
         WHEN s_acctbal > 4000 THEN 'Minister of State' ELSE 'Advisor' END AS designation
  FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 0
  QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY CASE WHEN s_acctbal > 9000 THEN 0 WHEN s_acctbal > 7000 THEN 1
          WHEN s_acctbal > 4000 THEN 2 ELSE 3 END, s_suppkey) = 1)
SELECT ministry, questions AS total_items, coalesce(press_label, '') AS press_label, coalesce(press_items, 0) AS press_items,
  coalesce(contact_name, '') AS contact_name, coalesce(designation, '') AS designation,
  CASE ministry WHEN 'NATION_3' THEN 'three.example' WHEN 'NATION_4' THEN 'four.example' END AS site,
  ministry = 'NATION_6' AS has_proposals,
  CASE ministry WHEN 'NATION_4' THEN 'four/items' WHEN 'NATION_5' THEN 'five/items' ELSE '' END AS dashboard_path
FROM vol LEFT JOIN labels2 USING (ministry) LEFT JOIN people USING (ministry)
"""


@suite.add(f"WITH {SQL_PRESS} SELECT label, n FROM counts")
def press_counts(spark, d):
    return R.press_counts(press(spark, d))


@suite.add(f"WITH {SQL_PRESS} {SQL_ALIAS}")
def resolve_alias_labels(spark, d):
    return R.resolve_alias_labels(volumes(spark, d), R.press_counts(press(spark, d)), "ministry", ALIASES)


@suite.add(f"WITH {SQL_PRESS} SELECT n_name AS ministry, min(label) AS press_label, sum(n)::BIGINT AS press_items FROM counts GROUP BY n_name")
def resolve_generic_labels(spark, d):
    return R.resolve_generic_labels(volumes(spark, d), R.press_counts(press(spark, d)), "ministry")


@suite.add(f"SELECT upper(ministry) AS norm, contact_name, designation FROM ({SQL_REGISTRY}) WHERE contact_name <> ''")
def best_contact(spark, d):
    return R.best_contact(contacts(spark, d), "s_suppkey")


@suite.add(SQL_REGISTRY)
def build_registry(spark, d):
    return registry(spark, d).withColumn("site", F.col("catalogue_hook.site")).drop("catalogue_hook")


@suite.add(f"""
SELECT count(*) AS targets, count(*) FILTER (WHERE press_items > 0) AS press_matched, count(*) FILTER (WHERE contact_name <> '') AS contact_matched,
  count(*) FILTER (WHERE site IS NOT NULL OR has_proposals OR dashboard_path <> '') AS hooked FROM ({SQL_REGISTRY})
""")
def registry_totals(spark, d):
    return R.registry_totals(registry(spark, d))


SQL_RATIO = f"""
SELECT ministry, contact_name, designation, total_items, press_items,
       round(total_items / nullif(press_items, 0), 3)::DOUBLE AS items_per_press_item FROM ({SQL_REGISTRY})
"""


@suite.add(SQL_RATIO)
def release_comparison(spark, d):
    return R.by_ratio(R.release_comparison(registry(spark, d)))


@suite.add(f"""
SELECT 'high' AS "end", row_number() OVER (ORDER BY items_per_press_item DESC, ministry) AS position, ministry, items_per_press_item
FROM ({SQL_RATIO}) WHERE items_per_press_item IS NOT NULL QUALIFY position <= 8 UNION ALL
SELECT 'low', row_number() OVER (ORDER BY items_per_press_item, ministry) AS position, ministry, items_per_press_item
FROM ({SQL_RATIO}) WHERE items_per_press_item IS NOT NULL QUALIFY position <= 8
""")
def two_ended_ratio(spark, d):
    rows = R.release_comparison(registry(spark, d)).select("ministry", "items_per_press_item")
    return C.two_ended(rows, "items_per_press_item", "ministry", 8)
