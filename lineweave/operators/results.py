"""Queries over result rows as reviewers ask them: filters, search, pages, briefs, lists of documents and lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.operators.checks import SEVERITIES, recommended_action, worst_severity
from lineweave.operators.review import queue_order


def has_type(kind: str) -> Column:
    return F.exists("discrepancies", lambda d: d["type"] == kind)


def search(said: str) -> Column:
    """Does a row's description, item number or explanation have a text, in any case?"""
    q, hit = F.lit(said.lower()), F.lit(False)
    for c in ("a_description", "b_description", "item_number", "explanation"):
        hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return hit


def filtered(rows: DataFrame, *, check: str | None = None, sku: str | None = None, classification: str | None = None, severity: str | None = None, discrepancy: str | None = None, needs_validation: bool | None = None, role: str | None = None, state: str | None = None, said: str | None = None) -> DataFrame:
    """Rows that meet all filters given. severity is a row's worst one."""
    plain = {"check": check, "sku": sku, "classification": classification, "role": role, "state": state, "requires_validation": needs_validation}
    out = rows
    for c, v in plain.items():
        out = out if v is None else out.where(F.col(c) == F.lit(v))
    out = out if severity is None else out.where(worst_severity(F.col("discrepancies")) == severity)
    out = out if discrepancy is None else out.where(has_type(discrepancy))
    return out if said is None else out.where(search(said))


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in the order of the review queue, with the number of all of them; only the page's rows are sorted out."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    own = rows.orderBy(*queue_order()).offset(offset).limit(limit)
    return own.join(F.broadcast(total))  # one row


def reviewable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("role").isin("item", "change"))


def callouts(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'callout'")


def brief(rows: DataFrame) -> DataFrame:
    """Both sides of a row in short, for lists."""
    a = F.when(F.col("a_ord").isNotNull(), F.struct(F.col("item_number").alias("item"), F.col("a_description").alias("said")))
    b = F.when(F.col("b_ord").isNotNull(), F.struct(F.col("b_description").alias("said")))
    return rows.select("row_id", "sku", "check", "classification", "level", "score", a.alias("a"), b.alias("b"), F.transform("discrepancies", lambda d: d["type"]).alias("types"), worst_severity(F.col("discrepancies")).alias("severity"))


def low_confidence(lines: DataFrame, least: float = 0.7) -> DataFrame:
    return lines.where(F.col("confidence") < least)


def document_list(documents: DataFrame, said: str | None = None) -> DataFrame:
    """Documents per set, by type and number, with counts. documents: doc, sku, doc_type, path, items, warnings."""
    own = documents if not said else documents.where(F.contains(F.lower("path"), F.lit(said.lower())) | F.coalesce(F.contains(F.lower("sku"), F.lit(said.lower())), F.lit(False)))
    order = F.array_sort(F.collect_list(F.struct("doc_type", "doc")))  # the documents of a set
    return own.groupBy("sku").agg(F.count(F.lit(1)).alias("documents"), F.sum("items").alias("items"), F.sum("warnings").alias("warnings"), F.transform(order, lambda d: F.concat_ws(":", d["doc_type"], d["doc"])).alias("listed"))


def line_search(lines: DataFrame, *, page_no: int | None = None, said: str | None = None) -> DataFrame:
    """Lines of documents by page and text, in any case. lines: doc, page, description, item_number, confidence."""
    out = lines if page_no is None else lines.where(F.col("page") == page_no)
    return out if not said else out.where(F.contains(F.lower("description"), F.lit(said.lower())) | F.coalesce(F.contains(F.lower("item_number"), F.lit(said.lower())), F.lit(False)))


# --- reports --------------------------------------------------------------------------------------


def check_table(rows: DataFrame) -> DataFrame:
    """Result rows as a flat report: types, severities and actions as texts, the worst severity first."""
    types = F.array_join(F.transform("discrepancies", lambda d: d["type"]), "; ")
    actions = F.array_join(F.array_distinct(F.transform("discrepancies", lambda d: recommended_action(d["type"]))), " ")
    return rows.withColumns({"severity": F.coalesce(worst_severity(F.col("discrepancies")), F.lit("")), "types": types, "actions": actions, "validation": F.when(F.col("requires_validation"), "YES").otherwise("NO")}).drop("discrepancies")


#: What a person looks at by hand for every set.
MANUAL = ("artwork against the approved redline", "symbols and warnings", "barcode content")


def manual_checklist(groups: DataFrame) -> DataFrame:
    """The things to look at by hand, for every set. groups: sku."""
    return groups.select("sku", F.posexplode(F.array(*map(F.lit, MANUAL))).alias("place", "what"))


def audit_rows(results: DataFrame, run_id: str) -> DataFrame:
    """An event per check and set of a run: how many rows, and how many need validation."""
    n = results.groupBy("check", "sku").agg(F.count(F.lit(1)).alias("rows"), F.count_if("requires_validation").alias("needs"))
    detail = F.concat(F.lit("rows="), "rows", F.lit(" needs_validation="), "needs")
    return n.select(F.lit(run_id).alias("run_id"), F.concat(F.lit("check."), F.lower("check")).alias("action"), "sku", detail.alias("detail"))


def assembled(*checks: DataFrame) -> DataFrame:
    """The rows of several checks as one table; columns that some lack are null there."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines, whole in place of what was there."""
    metrics.write.mode("overwrite").json(path)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
