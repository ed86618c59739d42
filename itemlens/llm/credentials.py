"""Secrets in texts: patterns, and weak candidates whose complementary parts stand near. Column functions and SQL only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.common import documents, stored
from itemlens.session import shuffled

# fixed values: the base patterns; a match counts from so many characters of the group on. The last two are runs that no
# match can begin inside of, so the least length may stand in the pattern and short runs need no counting
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
# parts that tell nothing alone: a token of letters of both cases and digits, and where something listens
PARTS = (("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
         ("endpoint", r"[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9._~:@-]+", 0, 8))  # a longer scheme counts by its end, so a run of letters is read once
ORDER = [x[0] for x in (*BASE, *PARTS)]
SPAN = "array<struct<start:int,end:int>>"
SUMS = 256  # numbers that are added up together


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though lambdas inside name it again and again."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct(start, end)>: places (code points, end exclusive) of the leftmost non-overlapping matches whose
    group has ``least`` characters.

    The pieces between matches and the matches, laid end to end, give the text, so their lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.transform(whole, F.length).alias("sizes"),
        F.transform(part, F.length).alias("parts"))

    def added(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def summed(x: Column) -> Column:
        """Sums of each ``SUMS`` neighbours: a place adds up these and less than ``SUMS`` single numbers."""
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / SUMS).cast("int")), lambda b: added(F.slice(x, b * SUMS + 1, F.lit(SUMS))))

    def total(x: Column, sums: Column, n: Column) -> Column:
        whole = F.floor(n / SUMS).cast("int")
        return added(F.slice(sums, F.lit(1), whole)) + added(F.slice(x, whole * SUMS + 1, n - whole * SUMS))

    def place(x: Column) -> Column:
        return bound(F.struct(summed(x["gaps"]).alias("gaps"), summed(x["sizes"]).alias("sizes")), lambda sums: placed(x, sums))

    def placed(x: Column, sums: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(x["sizes"]) - 1), lambda i: F.struct(
            (total(x["gaps"], sums["gaps"], i + 1) + total(x["sizes"], sums["sizes"], i)).alias("start"), x["sizes"][i].alias("n"), x["parts"][i].alias("part")))
        return F.transform(F.filter(every, lambda m: m["part"] >= least), lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + m["n"]).alias("end")))

    return F.when(text.rlike(pattern), bound(sizes, place)).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, assign, access, hex, key, endpoint): the places of every kind in each whole text.

    ``key`` leaves out what a base match covers. ``row`` is a hash of id and text: rows alike in both share it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("#text")).select(
        id_col, "row", *[matches(F.col("#text"), p, g, n).alias(k) for k, p, g, n in (*BASE, *PARTS)])
    base = F.concat("assign", "access", "hex")
    return found.withColumn("key", F.filter("key", lambda w: ~F.exists(
        base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))


def linked(found: DataFrame, scope: int = 200) -> DataFrame:
    """(row, kind, start, end): weak candidates near which their complements stand.

    A scope is ``scope`` code points to either side of an access identifier or an endpoint. A key counts if an access identifier or an
    endpoint with it is in reach; an endpoint counts if an access identifier and a secret (base or key) are. Intervals meet on any of
    the cells of ``scope`` code points that they touch, however long they are, so no text's parts are compared all with all; the joins only ask
    whether there is a partner, and send places, no text.
    """
    def part(kind: str) -> DataFrame:
        return found.where(F.size(kind) > 0).select("row", F.inline(kind)).select("row", F.lit(kind).alias("kind"), "start", "end").distinct()

    def reach(df: DataFrame) -> DataFrame:
        first = F.greatest(F.floor((F.col("start") - scope) / scope), F.lit(0))
        return df.select("row", F.explode(F.sequence(first, F.floor((F.col("end") + scope) / scope))).alias("cell"),
                         F.col("start").alias("s"), F.col("end").alias("e")).distinct()

    def near(weak: DataFrame, strong: DataFrame) -> DataFrame:
        weak = weak.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
        strong = shuffled(reach(strong))
        return weak.join(strong, (weak["row"] == strong["row"]) & (weak["cell"] == strong["cell"])
                         & (weak["start"] <= strong["e"] + scope) & (weak["end"] >= strong["s"] - scope), "left_semi").drop("cell").distinct()

    access, key, endpoint = part("access"), part("key"), part("endpoint")
    keys = near(key, access.union(endpoint))
    endpoints = near(near(endpoint, access), part("assign").union(part("hex")).union(key))
    return keys.union(endpoints)


def scan(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row long, found array<struct(kind string, start int, end int)>, base array of the same): secrets of each text.

    ``base`` has the pattern matches, ``found`` also linked weak candidates, both by start and then kind as listed. A
    null or empty text has none; repeated rows give a row each; an empty table gives an empty one; other columns are left
    out. Texts are read once and not shuffled; what is stored and joined are places.
    """
    places = stored(candidates(docs, id_col, text_col), "secrets")
    more = linked(places, scope).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    rank = {k: i for i, k in enumerate(ORDER)}

    def sorted_(spans: Column) -> Column:
        ranked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.create_map(
            *[F.lit(y) for k, i in rank.items() for y in (k, i)])[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.transform(F.array_sort(ranked), lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*[_named(k) for k, *_ in BASE])
    out = places.join(shuffled(more), "row", "left").withColumn("#base", base)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select(F.col(id_col), "row", sorted_(F.concat("#base", F.coalesce("more", none))).alias("found"),
                      sorted_(F.col("#base")).alias("base"))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, every found span of the text replaced by ``mark``; overlapping spans are one."""
    secrets = scan(docs, scope, id_col, text_col).where(F.size("found") > 0).select(F.col("row").alias("#row"), F.col("found").alias("#found"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("#key", F.xxhash64(F.col(id_col), text))
    joined = rows.join(secrets.dropDuplicates(["#row"]), F.col("#key") == F.col("#row"), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, x: Column) -> Column:
        return F.when(x["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"), x["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))

    cleaned = F.aggregate("#found", start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.col("#found").isNotNull(), cleaned).otherwise(F.col(text_col))).select(*docs.columns)


def op6_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in all ``documents``."""
    found = scan(documents(spark, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def _sql_places(kind: str, pattern: str, group: int, least: int) -> str:
    """SQL for (doc_id, kind, s, e): pieces between matches and the matches give the places, as in ``matches``."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(hits[i]) AS e FROM (
      SELECT doc_id, hits, parts, i, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS parts FROM d
        WHERE regexp_matches(t, '{p}'))))
    WHERE length(parts[i]) >= {least}"""


SQL_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(_sql_places(*x) for x in BASE)}),
runs AS ({_sql_places('key', '[A-Za-z0-9+/_-]{20,}={0,2}', 0, 20)}),
keys AS (SELECT runs.* FROM runs JOIN d USING (doc_id)
  WHERE regexp_matches(substr(t, s + 1, e - s), '[0-9]') AND regexp_matches(substr(t, s + 1, e - s), '[A-Z]')
    AND regexp_matches(substr(t, s + 1, e - s), '[a-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = runs.doc_id AND b.s < runs.e AND runs.s < b.e)),
ends AS ({_sql_places(*PARTS[1])}),
access AS (SELECT * FROM base WHERE kind = 'access'),
near_keys AS (SELECT * FROM keys k WHERE EXISTS (SELECT 1 FROM (SELECT * FROM access UNION ALL SELECT * FROM ends) x
  WHERE x.doc_id = k.doc_id AND k.s <= x.e + 200 AND k.e >= x.s - 200)),
near_ends AS (SELECT * FROM ends k WHERE EXISTS (SELECT 1 FROM access x WHERE x.doc_id = k.doc_id AND k.s <= x.e + 200 AND k.e >= x.s - 200)
  AND EXISTS (SELECT 1 FROM (SELECT * FROM base WHERE kind <> 'access' UNION ALL SELECT * FROM keys) x
              WHERE x.doc_id = k.doc_id AND k.s <= x.e + 200 AND k.e >= x.s - 200)),
every AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM near_keys UNION ALL SELECT *, false FROM near_ends),
ranked AS (SELECT *, list_position({ORDER!r}, kind) AS rank FROM every),
found AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (WHERE is_base) AS b,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN found USING (doc_id)
"""
