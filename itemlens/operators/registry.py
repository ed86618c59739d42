"""One record per target, resolved across outside sources."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.labels import canonical_target, lookup, normalize_label, nullif_blank, trim_blanks
from itemlens.functions.values import safe_ratio
from itemlens.session import checkpointed


def press_items_since(press: DataFrame, since, date: str = "date", kind: str = "kind",
                      wanted: str = K.PRESS_KIND) -> DataFrame:
    return press.filter((F.col(date) >= since) & (F.col(kind) == wanted))


def press_counts(press: DataFrame, label: str = "ministry", out: str = "n") -> DataFrame:
    """Press items per raw label: (label, n)."""
    return press.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias(out))


def alias_column(target: Column, aliases: dict[str, list[str]]) -> Column:
    """Array of outside labels listed for a target, null when none are."""
    out = F.lit(None).cast("array<string>")
    for name, labels in aliases.items():
        listed = F.array(*[F.lit(x) for x in labels])
        out = F.when(target == canonical_key(name), listed).otherwise(out)
    return out


def canonical_key(name: str) -> Column:
    """Hook and alias keys go through the target rules, so they meet canonical targets."""
    return canonical_target(F.lit(name))


def resolve_alias_labels(targets: DataFrame, counts: DataFrame, target: str,
                         aliases: dict[str, list[str]] = K.PRESS_LABEL_ALIASES) -> DataFrame:
    """Targets with listed labels: labels joined by "; ", their counts summed."""
    listed = targets.select(target, alias_column(F.col(target), aliases).alias("labels")).filter("labels is not null")
    per_label = listed.select(target, "labels", F.explode("labels").alias("label")).join(counts, "label", "left")
    return per_label.groupBy(target).agg(
        F.array_join(F.first("labels"), "; ").alias("press_label"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("press_items"))


def resolve_generic_labels(targets: DataFrame, counts: DataFrame, target: str) -> DataFrame:
    """All targets by normalised label; the smallest raw label is shown, "" and 0 when none fits."""
    by_norm = counts.groupBy(normalize_label(F.col("label")).alias("norm")).agg(
        F.min("label").alias("press_label"), F.sum("n").alias("press_items"))
    return (
        targets.select(target, normalize_label(F.col(target)).alias("norm")).join(by_norm, "norm", "left")
        .select(target, F.coalesce("press_label", F.lit("")).alias("press_label"),
                F.coalesce("press_items", F.lit(0)).alias("press_items"))
    )


def resolve_press_labels(targets: DataFrame, counts: DataFrame, target: str,
                         aliases: dict[str, list[str]] = K.PRESS_LABEL_ALIASES) -> DataFrame:
    counts = checkpointed(counts)  # one row per label; the press items are read once
    by_alias = resolve_alias_labels(targets, counts, target, aliases)
    rest = targets.select(target).join(by_alias, target, "left_anti")
    return by_alias.unionByName(resolve_generic_labels(rest, counts, target))


def best_contact(contacts: DataFrame, order: str, target: str = "ministry", name: str = "contact_name",
                 designation: str = "designation", ranks: dict[str, int] = K.CONTACT_RANKS,
                 other: int = K.CONTACT_RANK_OTHER) -> DataFrame:
    """(norm, contact_name, designation): the best rank per normalised target, first row on ties."""
    clean = contacts.select(
        normalize_label(F.col(target)).alias("norm"), trim_blanks(F.coalesce(name, F.lit(""))).alias("contact_name"),
        trim_blanks(F.coalesce(designation, F.lit(""))).alias("designation"), order,
    ).filter("contact_name != ''")
    rank = F.coalesce(lookup(F.col("designation"), ranks).cast("int"), F.lit(other))
    best = F.min_by(F.struct("contact_name", "designation"), F.struct(rank.alias("r"), F.col(order)))
    return clean.groupBy("norm").agg(best.alias("b")).select("norm", "b.*")


def build_registry(
    volumes: DataFrame, counts: DataFrame, contacts: DataFrame, order: str,
    target: str = "ministry", n: str = "questions",
    aliases: dict = K.PRESS_LABEL_ALIASES, hooks: dict = K.CATALOGUE_HOOKS,
    proposal_targets: list = K.PROPOSAL_TARGETS, dashboards: dict = K.DASHBOARD_PATHS, ranks: dict = K.CONTACT_RANKS,
) -> DataFrame:
    """One row per target of ``volumes`` with defaults where a source is silent."""
    volumes = checkpointed(volumes)
    press = resolve_press_labels(volumes, counts, target, aliases)
    people = best_contact(contacts, order, ranks=ranks)
    t = F.col(target)
    hook = F.lit(None).cast("struct<site:string,schema:string,path:string>")
    for name, h in hooks.items():
        value = F.struct(*[F.lit(h[k]).alias(k) for k in ("site", "schema", "path")])
        hook = F.when(t == canonical_key(name), value).otherwise(hook)
    path = F.lit("")
    for name, p in dashboards.items():
        path = F.when(t == canonical_key(name), p).otherwise(path)
    flagged = F.lit(False)
    for name in proposal_targets:
        flagged = flagged | (t == canonical_key(name))
    return (
        volumes.withColumn("norm", normalize_label(t)).join(press, target, "left").join(people, "norm", "left")
        .select(
            target, F.col(n).alias("total_items"),
            F.coalesce("press_label", F.lit("")).alias("press_label"),
            F.coalesce("press_items", F.lit(0)).cast("long").alias("press_items"),
            F.coalesce("contact_name", F.lit("")).alias("contact_name"),
            F.coalesce("designation", F.lit("")).alias("designation"),
            hook.alias("catalogue_hook"), flagged.alias("has_proposals"), path.alias("dashboard_path"))
    )


def registry_totals(registry: DataFrame) -> DataFrame:
    hooked = F.col("catalogue_hook").isNotNull() | F.col("has_proposals") | (F.col("dashboard_path") != "")
    return registry.agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("press_items") > 0).alias("press_matched"),
        F.count_if(nullif_blank(F.col("contact_name")).isNotNull()).alias("contact_matched"),
        F.count_if(hooked).alias("hooked"))


def release_comparison(registry: DataFrame, target: str = "ministry") -> DataFrame:
    """Items, press items and items per press item for every target; null ratio without press items."""
    return registry.select(
        target, "contact_name", "designation", "total_items", "press_items",
        safe_ratio(F.col("total_items"), F.col("press_items")).alias("items_per_press_item"))


def by_ratio(comparison: DataFrame, ratio: str = "items_per_press_item", tie: str = "ministry") -> DataFrame:
    return comparison.orderBy(F.coalesce(F.col(ratio), F.lit(0.0)).desc(), tie)
