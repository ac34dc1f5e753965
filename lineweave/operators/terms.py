"""Terminology as a versioned dimension. versions: id, version, canonical, aliases, scope, active, deleted, changed_at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import text

PAYLOAD = ["canonical", "aliases", "scope", "active", "deleted"]


def append_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The new versions that changes make, numbered on from those there are. changes: id, PAYLOAD, changed_at."""
    last = versions.groupBy("id").agg(F.max("version").alias("last"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("changed_at", "canonical"))
    return changes.withColumn("k", k).join(last, "id", "left").select("id", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("int").alias("version"), *PAYLOAD, "changed_at")


def current(versions: DataFrame) -> DataFrame:
    """The latest version of each relationship that isn't deleted."""
    rest = [c for c in versions.columns if c != "id"]
    return versions.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("id", "x.*").where("not deleted")


def as_of(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The version current when each run started. runs: run_id, started_at.

    A version's validity is cut at months, up to the month after it in which runs start, so that runs and versions meet in an
    equi-join by month; what comes out is a dictionary per run.
    """
    month = lambda c: F.trunc(F.col(c), "month")
    span = runs.agg(F.min(month("started_at")).alias("m0"), F.max(month("started_at")).alias("m1"))
    nxt = F.lead("changed_at").over(Window.partitionBy("id").orderBy("version"))
    valid = versions.withColumn("until", nxt).join(F.broadcast(span))  # one row
    valid = valid.withColumns({"m0": F.greatest("m0", month("changed_at")), "m1": F.least("m1", F.coalesce(month("until"), F.col("m1")))}).where("m0 <= m1 and not deleted")
    parts = valid.withColumn("m", F.explode(F.sequence("m0", "m1", F.make_interval(months=F.lit(1)))))
    on = (F.col("changed_at") <= F.col("started_at")) & (F.col("until").isNull() | (F.col("started_at") < F.col("until")))
    return runs.withColumn("m", month("started_at")).join(parts.select("m", "id", "version", "changed_at", "until"), "m").where(on).select("run_id", "id", "version")


def pinned(versions: DataFrame, used: DataFrame) -> DataFrame:
    """The dictionary as a run used it. used: run_id, id, version."""
    return used.join(versions, ["id", "version"])


def sync_defaults(defaults: DataFrame, versions: DataFrame) -> DataFrame:
    """What a new set of defaults does: add unknown ids, refresh untouched ones that differ, leave edited and deleted ones."""
    last = versions.groupBy("id").agg(F.max("version").alias("version"), F.max_by(F.struct(*PAYLOAD), "version").alias("now"))
    x = defaults.select("id", F.struct(*PAYLOAD).alias("want")).join(last, "id", "left")
    differs = F.to_json("want") != F.to_json("now")
    return x.select("id", F.when(F.col("version").isNull(), "add").when(F.col("now.deleted"), "leave deleted").when(F.col("version") > 1, "leave edited").when(differs, "refresh").otherwise("same").alias("action"))


def next_number(versions: DataFrame) -> DataFrame:
    """The number after the largest of ids REL-nnn, deleted ones included."""
    n = F.nullif(F.regexp_extract("id", r"^REL-(\d+)$", 1), F.lit("")).cast("long")
    return versions.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def snapshot(versions: DataFrame) -> DataFrame:
    """Count and an order-free digest of the current dictionary: the sum of row digests, so that no task gathers all rows."""
    rows = current(versions).select("active", F.conv(F.substring(F.sha2(F.to_json(F.struct("id", "version", *PAYLOAD)), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def usage(results: DataFrame, by: list[str]) -> DataFrame:
    """Rows that each relationship decided."""
    return results.where("relationship_id is not null").groupBy(*by, "relationship_id").agg(F.count(F.lit(1)).alias("rows"))


def history(versions: DataFrame) -> DataFrame:
    """Every version with what kind of change it was: create, update, activate, deactivate or delete."""
    before = lambda c: F.lag(c).over(Window.partitionBy("id").orderBy("version"))
    x = versions.withColumns({"_active": before("active"), "_deleted": before("deleted")})
    kind = F.when(F.col("deleted"), "delete").when(F.col("_active").isNull() | F.col("_deleted"), "create").when(F.col("active") & ~F.col("_active"), "activate").when(~F.col("active") & F.col("_active"), "deactivate").otherwise("update")
    return x.withColumn("change", kind).drop("_active", "_deleted")


def listed(terms: DataFrame, *, active_only: bool = False, scope: str | None = None, search: str | None = None) -> DataFrame:
    """Relationships by state, scope and a text in canonical, aliases, id, notes or anchors, in any case."""
    out = terms.where("active") if active_only else terms
    out = out if scope is None else out.where(F.col("scope") == scope)
    if search:
        q = F.lit(search.lower())
        lists = [F.exists(c, lambda x: F.contains(F.lower(x), q)) for c in ("aliases", "item_anchors") if c in terms.columns]
        plain = [F.contains(F.lower(c), q) for c in ("canonical", "id", "notes") if c in terms.columns]
        hit = F.lit(False)
        for h in plain + lists:
            hit = hit | F.coalesce(h, F.lit(False))
        out = out.where(hit)
    return out


def scope_counts(terms: DataFrame) -> DataFrame:
    """Active and inactive relationships per kind of scope."""
    return terms.groupBy(F.split_part("scope", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"))


DOC_TYPES = ("BOM", "LABEL", "DRAWING", "PCO")


def import_actions(rows: DataFrame, now: DataFrame) -> DataFrame:
    """What each row of an edited export does: blank, invalid, create, update or unchanged.

    rows: line, id, canonical, aliases, scope, doc_types, item_anchors, active, notes, all texts; now: the current dictionary,
    with doc_types, item_anchors and notes. Without an id, or with one that isn't there, a row creates.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    x = rows.select(
        "line", blank("id").alias("id"), blank("canonical").alias("canonical"), text.split_list(F.col("aliases"), commas=False).alias("aliases"), F.coalesce(blank("scope"), F.lit("global")).alias("scope"),
        F.transform(text.split_list(F.col("doc_types")), lambda x: F.upper(x)).alias("doc_types"), text.split_list(F.col("item_anchors")).alias("item_anchors"),
        F.when(blank("active").isNull(), True).otherwise(text.is_truthy(F.col("active"))).alias("active"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
    error = F.when(~text.scope_parts(F.col("scope"))["valid"], "scope").when(F.size(F.array_except("doc_types", F.array(*map(F.lit, DOC_TYPES)))) > 0, "document type")
    fields = ["canonical", "aliases", "scope", "doc_types", "item_anchors", "active", "notes"]
    old = now.select("id", F.struct(*fields).alias("old"))
    x = x.withColumn("error", error).join(old, "id", "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"old.{c}"))
    action = F.when(F.col("canonical").isNull(), "blank").when(F.col("error").isNotNull(), "invalid").when(F.col("old").isNull(), "create").when(same, "unchanged").otherwise("update")
    return x.withColumn("action", action).drop("old")


def exported(terms: DataFrame) -> DataFrame:
    """The dictionary as flat rows, lists parted by semicolons."""
    lists = {c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ") for c in ("aliases", "doc_types", "item_anchors") if c in terms.columns}
    return terms.withColumns(lists | {"active": F.when(F.col("active"), "Y").otherwise("N")})


def approved(suggestions: DataFrame, next_number: int, *, scope: str = "global", anchor: bool = False) -> DataFrame:
    """New relationships from suggestions: B's text is the canonical one, A's an alias. Ids go on from next_number in the order of keys."""
    k = F.row_number().over(Window.orderBy("a_key", "b_key"))  # those that a person approved at once
    anchors = F.col("item_anchors") if anchor and "item_anchors" in suggestions.columns else F.array().cast("array<string>")
    return suggestions.select(F.format_string("REL-%03d", k + next_number - 1).alias("id"), F.col("b_key").alias("canonical"), F.array("a_key").alias("aliases"), F.lit(scope).alias("scope"), anchors.alias("item_anchors"), F.lit("learned").alias("provenance"), F.lit(True).alias("active"), F.lit(False).alias("deleted"))


def rejected(suggestions: DataFrame, by: str, note: str = "") -> DataFrame:
    """Rows that keep suggestions from coming up again."""
    return suggestions.select("a_key", "b_key", F.lit(by).alias("rejected_by"), F.lit(note).alias("note"))


def from_rows(results: DataFrame) -> DataFrame:
    """Relationships that result rows, chosen by a reviewer, would make: B's description canonical, A's an alias, anchored to the item."""
    return results.where("a_description is not null and b_description is not null").select(F.col("b_description").alias("canonical"), F.array("a_description").alias("aliases"), F.lit("global").alias("scope"), F.array_compact(F.array("item_number")).alias("item_anchors"), F.lit("learned").alias("provenance"), "row_id")
