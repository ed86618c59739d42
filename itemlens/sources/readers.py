"""Landed files as DataFrames (S1-S12). Every reader states its schema; nothing is inferred but S6."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.labels import nullif_blank
from itemlens.functions.text import strip_html

ITEMS_A = ("quesNo INT, sessionNo INT, date STRING, type STRING, ministry STRING, subjects STRING, "
           "member ARRAY<STRING>")
ITEMS_B = ("qno INT, ses_no INT, ans_date STRING, qtype STRING, min_name STRING, qtitle STRING, name STRING, "
           "mp_code INT, qn_text STRING, ans_text STRING, files STRING")
ROSTER_A = ("mpFirstLastName STRING, mpLastFirstName STRING, partySname STRING, partyFname STRING, "
            "stateName STRING, constName STRING")
ROSTER_B = "mpsno INT, partyCode STRING, party STRING, state STRING, name STRING"
CONTACTS = "ministry STRING, contact_name STRING, designation STRING"
TOPICS = "party STRING, term STRING, count INT"
CARD = ("retrieved STRING, method STRING, grade_criteria STRING, disbursal_report_card ARRAY<STRUCT<scheme:STRING, "
        "ministry:STRING, outlay_rs_cr:DOUBLE, disbursed_rs_cr:DOUBLE, disbursed_as_of:STRING, grade:STRING, "
        "evidence:STRING>>")
ACF = "STRUCT<l3_introduction:STRING, introduction:STRING>"
CORE = f"title STRUCT<rendered:STRING>, modified STRING, acf {ACF}, link STRING"
POST = ("posts ARRAY<STRUCT<post_title:STRING, post_modified:STRING, "
        f"acf_data:{ACF}, post_slug:STRING>>, total_pages INT")
PROPOSAL = ("proposal_no STRING, state_name STRING, status STRING, investment_cost DOUBLE, project_name STRING, "
            "other_property STRING, start_date STRING")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system of the path itself, local or shared."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """One object per line, which splits; ``multiline`` reads files that hold one JSON array each, a task a file."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def with_row_order(df: DataFrame, name: str) -> DataFrame:
    """Order of rows as they lie in the files, for the "first/last row wins" rules: by file path, block of the file, place.

    Spark packs files into tasks as it likes, so the place alone would not do; inside a block it rises with the rows.
    """
    at = F.col("_metadata")
    return df.withColumn(name, F.struct(
        at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place")))


ROW_ORDER = "STRUCT<file:STRING, block:BIGINT, place:BIGINT>"


def read_items_a(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return read_json(spark, path, ITEMS_A, multiline)


def read_items_b(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return read_json(spark, path, ITEMS_B, multiline)


def read_roster_a(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return with_row_order(read_json(spark, path, ROSTER_A, multiline), "roster_order")


def read_roster_b(spark: SparkSession, paths: list[str], multiline: bool = False) -> DataFrame:
    """Current and former rosters; absent files are skipped, ``file_order`` tells which file is later."""
    parts = [
        with_row_order(read_json(spark, p, ROSTER_B, multiline), "roster_order").withColumn("file_order", F.lit(i))
        for i, p in enumerate(paths) if path_exists(spark, p)
    ]
    if not parts:
        return spark.createDataFrame([], f"{ROSTER_B}, roster_order {ROW_ORDER}, file_order INT")
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, path: str, schema: str, missing_ok: bool = False, multiline: bool = False) -> DataFrame:
    """Header CSV with a stated schema; quotes as other tools write them. ``multiline`` lets values hold line breaks."""
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=multiline)


def read_table_inferred(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame | None:
    """Header CSV with types taken from all of its rows; None when the file is missing."""
    if not path_exists(spark, path):
        return None
    return spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=multiline)


def read_press_items(spark: SparkSession, path: str, since: str, kind: str = "release") -> DataFrame:
    """Press items of a kind since a date; both conditions reach the Parquet scan."""
    return spark.read.parquet(path).filter((F.col("date") >= since) & (F.col("kind") == kind))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{CONTACTS}, contact_order {ROW_ORDER}")
    return with_row_order(read_table(spark, path, CONTACTS), "contact_order")


def read_report_card(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return read_json(spark, path, CARD, multiline).select(
        "retrieved", "method", "grade_criteria", F.inline("disbursal_report_card"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return group_topics(read_table(spark, path, TOPICS))


def group_topics(topics: DataFrame, group: str = "party", everyone: str = "ALL") -> DataFrame:
    return topics.filter(F.col(group) != everyone)


def _intro(acf: str) -> Column:
    raw = F.coalesce(nullif_blank(F.col(f"{acf}.l3_introduction")), nullif_blank(F.col(f"{acf}.introduction")))
    return strip_html(raw, null_on_empty=False)


def catalogue_core(raw: DataFrame, target: str) -> DataFrame:
    return raw.select(F.lit(target).alias("target"), F.col("title.rendered").alias("title"), "modified",
                      _intro("acf").alias("intro"), F.coalesce("link", F.lit("")).alias("page"))


def catalogue_post(raw: DataFrame, target: str, site: str) -> DataFrame:
    page = F.concat(F.lit(f"https://www.{site}/offerings/schemes-and-services/details/"),
                    F.coalesce("post_slug", F.lit("")))
    return raw.select(F.inline("posts")).select(
        F.lit(target).alias("target"), F.col("post_title").alias("title"), F.col("post_modified").alias("modified"),
        _intro("acf_data").alias("intro"), page.alias("page"))


def read_catalogue(spark: SparkSession, core: dict[str, str], post: dict[str, tuple[str, str]],
                   multiline: bool = False) -> DataFrame:
    """Landed catalogues as one table. ``core``: {target: path}; ``post``: {target: (path, site)}."""
    parts = [catalogue_core(read_json(spark, p, CORE, multiline), t) for t, p in core.items()]
    parts += [catalogue_post(read_json(spark, p, POST, multiline), t, site) for t, (p, site) in post.items()]
    return reduce(DataFrame.unionByName, parts)


def read_catalogue_dump(spark: SparkSession, path: str, hooks: dict[str, dict] = K.CATALOGUE_HOOKS) -> DataFrame:
    """Cached dumps ``{target: [entry, ..]}``, one document a file, as the table of ``read_catalogue``.

    Entries have the shape of their target's hook, so a file has two; a target without a hook is told by its entries. Read as VARIANT, no
    schema is laid over both: a missing, null or odd field is null in its column. Entries of the second shape have no page here.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("target"), F.col("value").alias("entries"))
    each = lists.lateralJoin(spark.tvf.variant_explode(F.col("entries").outer())).select("target", F.col("value").alias("e"))
    get = lambda at: F.try_variant_get("e", f"$.{at}", "string")
    shape = F.create_map(*[F.lit(x) for t, h in hooks.items() for x in (t, h["schema"])])[F.col("target")] if hooks else F.lit(None)
    core = F.coalesce(shape, F.when(get("title").isNotNull(), F.lit("wp_core"))) == "wp_core"

    def field(in_core: str, in_post: str) -> Column:
        return F.when(core, get(in_core)).otherwise(get(in_post))

    long, short = (nullif_blank(field(f"acf.{n}", f"acf_data.{n}")) for n in ("l3_introduction", "introduction"))
    return each.select(
        "target", field("title.rendered", "post_title").alias("title"), field("modified", "post_modified").alias("modified"),
        strip_html(F.coalesce(long, short), null_on_empty=False).alias("intro"), F.when(core, F.coalesce(get("link"), F.lit(""))).otherwise("").alias("page"))


def read_proposals(spark: SparkSession, path: str, envelope: bool = False, multiline: bool = False) -> DataFrame:
    """Landed proposals, plain or in pages ``{status, data}``; ``load_order`` is that of the file, the page and the place in it."""
    if envelope:
        rows = read_json(spark, path, f"status INT, message STRING, data ARRAY<STRUCT<{PROPOSAL_FIELDS}>>",
                         multiline)
        rows = with_row_order(rows, "page").select("page", F.posexplode("data").alias("place", "p"))
        return rows.select("p.*", F.struct("page", "place").alias("load_order"))
    return with_row_order(read_json(spark, path, PROPOSAL, multiline), "load_order")


PROPOSAL_FIELDS = ", ".join(":".join(f.strip().split(" ")) for f in PROPOSAL.split(","))
