"""Reconciliation checks: from assigned lines to classified rows with typed discrepancies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import matching
from lineweave.operators.matching import Thresholds
from lineweave.sources.scratch import cut

#: Severities from worst to least.
SEVERITIES = ("BLOCKER", "MAJOR", "MINOR", "INFO")
CLASS_BY_LEVEL = {"EXACT": "EXACT", "RELATIONSHIP": "EQUIVALENT", "FUZZY": "POTENTIAL", "SEMANTIC": "POTENTIAL", "SUGGESTION": "POTENTIAL"}


@dataclass(frozen=True)
class Policy:
    """What a pairing check compares and what it calls what is missing."""

    check: str
    letter: str
    quantity: bool
    missing_a: str
    missing_b: str
    soft_a: tuple[str, ...] = ()  # categories of A that may be missing
    exempt_b: tuple[str, ...] = ()  # categories of B's text that may be missing
    conditional_b: bool = False  # lines marked conditional may be missing
    severity: str = "MAJOR"


BOM_LABEL = Policy("BOM_LABEL", "R", True, "MISSING_IN_LABEL", "MISSING_IN_BOM")
BOM_DRAWING = Policy("BOM_DRAWING", "D", False, "MISSING_IN_DRAWING", "EXTRA_ON_DRAWING", soft_a=("PACKAGING",), exempt_b=("LABEL", "DOCUMENT"), conditional_b=True)
LABEL_DRAWING = Policy("LABEL_DRAWING", "L", False, "MISSING_IN_DRAWING", "EXTRA_ON_DRAWING", exempt_b=("PACKAGING", "LABEL", "DOCUMENT"), conditional_b=True)

#: What a reviewer is told to do, by type of discrepancy.
ACTIONS = {
    "QTY_MISMATCH": "Confirm the correct quantity against the approved redline; correct the BOM or the label.",
    "DESC_MISMATCH": "Confirm the two descriptions refer to the same component; add a relationship if they do.",
    "MISSING_IN_LABEL": "Confirm whether this BOM component must appear on the label; if it does under another wording, add a relationship.",
    "MISSING_IN_BOM": "Confirm whether this label line corresponds to a BOM component under a different description.",
    "REF_PARENT_MISMATCH": "Verify the label belongs to this SKU before reviewing any other row.",
    "AMBIGUOUS_MATCH": "Select the correct label line; consider an item-anchored relationship to remove the ambiguity.",
    "LOW_EXTRACTION_CONFIDENCE": "Verify the extracted values against the source page.",
    "PCO_CHANGE_NOT_APPLIED": "Apply the PCO change to the BOM (or redline it) before release, or reject the PCO row.",
    "PCO_QTY_SEQ_MISMATCH": "Align the BOM quantity / operation sequence with the PCO proposal, or correct the PCO.",
    "BOM_MISSING_FOR_AFFECTED_CODE": "Download the BOM for this affected code from JDE and add it to the set before reviewing.",
    "MISSING_IN_DRAWING": "Confirm whether the component must be shown on the packaging drawing; update the drawing or the BOM.",
    "EXTRA_ON_DRAWING": "Confirm whether the drawing callout refers to a BOM component under another description or an obsolete item.",
    "DRAWING_REV_MISMATCH": "Confirm the drawing number / revision referenced by the BOM against the released drawing.",
    "UNEXPECTED_LABEL_CHANGE": "Confirm the change against the approved redline; it is not covered by the PCO.",
    "EXPECTED_CHANGE_ABSENT": "Apply the approved change to the new label revision or update the PCO.",
}
#: Fixed value: the confidence below which a missing line says so, whatever the threshold of paired lines.
MISSING_CONFIDENCE = 0.7
FINDING = "struct<type:string,severity:string>"


def finding(when: Column, kind: str | Column, severity: str) -> Column:
    """A discrepancy where the condition holds, else null."""
    return F.when(when, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.lit(severity).alias("severity")))


def findings(*each: Column) -> Column:
    return F.array_compact(F.array(*each))


def recommended_action(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), kind), F.lit(""))


def worst_severity(found: Column) -> Column:
    """The worst severity of an array of discrepancies; null where there is none."""
    out = F.when(F.size(found) == 0, F.lit(None).cast("string"))
    has = lambda name: F.exists(found, lambda d: d["severity"] == name)
    for name in SEVERITIES:
        out = out.when(has(name), name)
    return out


def comparable(category: Column, quantity: Column, active: Column) -> Column:
    """struct(ok, reason): whether a line takes part in comparisons."""
    ok = lambda v, why: F.struct(F.lit(v).alias("ok"), F.lit(why).alias("reason"))
    return F.when(category != text.PHYSICAL, ok(False, "category")).when(quantity.isNull(), ok(True, "quantity unreadable")).when(quantity <= 0, ok(False, "zero quantity")).when(~active, ok(False, "inactive")).otherwise(ok(True, "physical"))


def merge_duplicates(lines: DataFrame) -> DataFrame:
    """Lines of a set with one item number become one: quantities added (null if any is), the first line's texts, the least confidence."""
    key = F.coalesce("item_number", F.concat(F.lit("#"), F.col("item_ord").cast("string")))
    first = [c for c in lines.columns if c not in ("pair", "quantity", "confidence", "item_ord")]
    out = lines.groupBy("pair", key.alias("_key")).agg(
        F.min("item_ord").alias("item_ord"),
        F.when(F.count("quantity") == F.count(F.lit(1)), F.sum("quantity").cast("decimal(18,6)")).alias("quantity"),
        *([F.min("confidence").alias("confidence")] if "confidence" in lines.columns else []),
        F.count(F.lit(1)).alias("merged_rows"),
        *[F.min_by(c, "item_ord").alias(c) for c in first],
    )
    return out.drop("_key")


def _exactly(an: DataFrame, bn: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines paired by their words alone, and those of A and of B that are left, with what a row of each needs."""
    of_a = ["item_ord", "item_number", "description", "quantity", "category", "confidence"]
    of_b = ["item_ord", "description", "quantity", "uom", "sub_value", "sub_kind", "conditional", "confidence"]
    met = cut(matching.exact_lines(an, bn, of_a, of_b), "met")
    a, b = F.col("a.item_ord").isNotNull(), F.col("b.item_ord").isNotNull()
    side = lambda s, cols: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in cols]
    both = met.where(a & b).select(
        "pair", F.col("a.item_ord").alias("a_ord"), F.col("b.item_ord").alias("b_ord"), "a.item_number", *side("a", ("description", "quantity", "confidence")), *side("b", ("description", "quantity", "confidence")),
        "b.uom", "b.sub_value", "b.sub_kind", F.lit("EXACT").alias("level"), F.lit(1.0).alias("score"), F.lit(False).alias("confirm"), F.lit(None).cast("string").alias("relationship_id"), (F.col("n_b") - 1).alias("alternatives"),
    )
    free_a = met.where(a & ~b).select("pair", "a.*", F.when(F.col("n_b") > 0, 1.0).alias("hint_score"), F.when(F.col("n_b") > 0, 1).alias("alternatives"))
    free_b = met.where(b & ~a).select("pair", "b.*", F.when(F.col("n_a") > 0, 1.0).alias("hint_score"))
    return both, free_a, free_b


def _by_ladder(a: DataFrame, b: DataFrame, an: DataFrame, bn: DataFrame, terms: DataFrame | None, vectors: DataFrame | None, suggestions: DataFrame | None, t: Thresholds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same by all rungs of the ladder."""
    candidates = cut(matching.ladder(an, bn, terms=terms, vectors=vectors, suggestions=suggestions, t=t), "candidates")
    pairs = cut(matching.greedy_pairs(candidates), "pairs")
    a, b = an.select(*a.columns), bn.select(*b.columns)
    unsure = matching.ambiguities(candidates, pairs, t).groupBy("pair", "a_ord").agg(F.count(F.lit(1)).alias("alternatives"))
    both = pairs.join(a.select("pair", F.col("item_ord").alias("a_ord"), "item_number", F.col("description").alias("a_description"), F.col("quantity").alias("a_quantity"), F.col("confidence").alias("a_confidence")), ["pair", "a_ord"])
    both = both.join(b.select("pair", F.col("item_ord").alias("b_ord"), F.col("description").alias("b_description"), F.col("quantity").alias("b_quantity"), "uom", "sub_value", "sub_kind", F.col("confidence").alias("b_confidence")), ["pair", "b_ord"])
    both = both.join(unsure, ["pair", "a_ord"], "left")
    free_a = a.join(pairs.select("pair", F.col("a_ord").alias("item_ord")), ["pair", "item_ord"], "left_anti").join(matching.hints(candidates, pairs, "a"), ["pair", "item_ord"], "left").join(unsure.withColumnRenamed("a_ord", "item_ord"), ["pair", "item_ord"], "left")
    free_b = b.join(pairs.select("pair", F.col("b_ord").alias("item_ord")), ["pair", "item_ord"], "left_anti").join(matching.hints(candidates, pairs, "b"), ["pair", "item_ord"], "left")
    return both, free_a, free_b


def pairing_check(a: DataFrame, b: DataFrame, policy: Policy, *, terms: DataFrame | None = None, vectors: DataFrame | None = None, suggestions: DataFrame | None = None, rungs: str = "all", t: Thresholds = Thresholds()) -> DataFrame:
    """A row per A line and per unmatched B line of every pair of documents.

    a: pair, item_ord, item_number, sku, description, quantity, uom, category, confidence; b: pair, item_ord, description,
    quantity, uom, sub_value, sub_kind, conditional, confidence. rungs: `all`, or `exact` to leave out similarity.
    """
    an, bn = matching.normalized_lines(a), matching.normalized_lines(b)
    both, free_a, free_b = _exactly(an, bn) if rungs == "exact" else _by_ladder(a, b, an, bn, terms, vectors, suggestions, t)
    none = F.lit(None)

    both = both.withColumn("q", text.compare_quantities(F.col("a_quantity"), F.col("b_quantity"), F.col("sub_value"), F.col("sub_kind"), F.col("uom")))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_BY_LEVEL.items() for x in kv]), F.col("level"))
    base = F.when(F.col("confirm"), "POTENTIAL").otherwise(level)
    differs = F.lit(policy.quantity) & ~F.col("q.equal")
    hard = differs & base.isin("EXACT", "EQUIVALENT") & ~F.col("q.idiom")
    many = F.coalesce(F.col("alternatives") > 0, F.lit(False))
    kind = F.when(hard, "MISMATCH").when(differs & F.col("q.idiom"), "POTENTIAL").when(many, "POTENTIAL").otherwise(base)
    low = (F.col("a_confidence") < t.low_confidence) | (F.col("b_confidence") < t.low_confidence)
    found = findings(finding(hard, "QTY_MISMATCH", "MAJOR"), finding(differs & ~hard, "QTY_MISMATCH", "MINOR"), finding(many, "AMBIGUOUS_MATCH", "MAJOR"), finding(low, "LOW_EXTRACTION_CONFIDENCE", "INFO"))
    paired = both.select("pair", F.lit("item").alias("role"), "a_ord", "b_ord", "item_number", "a_description", "b_description", kind.alias("classification"), "level", "score", "relationship_id", found.alias("discrepancies"))

    soft = F.col("category").isin(*policy.soft_a) if policy.soft_a else F.lit(False)
    lone = findings(finding(~soft, policy.missing_a, policy.severity), finding(~soft & F.coalesce(F.col("alternatives") > 0, F.lit(False)), "AMBIGUOUS_MATCH", "MAJOR"), finding(~soft & (F.col("confidence") < MISSING_CONFIDENCE), "LOW_EXTRACTION_CONFIDENCE", "INFO"))
    missing_a = free_a.select("pair", F.when(soft, "exempt").otherwise("item").alias("role"), F.col("item_ord").alias("a_ord"), none.cast("int").alias("b_ord"), "item_number", F.col("description").alias("a_description"), none.cast("string").alias("b_description"), F.when(soft, "EXACT").otherwise("MISSING").alias("classification"), F.lit("NONE").alias("level"), F.when(soft, 0.0).otherwise(F.coalesce("hint_score", F.lit(0.0))).alias("score"), none.cast("string").alias("relationship_id"), lone.alias("discrepancies"))

    own = text.categorize(none.cast("string"), F.col("description"), none.cast("decimal(18,6)"))["category"]
    exempt = (F.lit(policy.conditional_b) & F.coalesce("conditional", F.lit(False))) | (own.isin(*policy.exempt_b) if policy.exempt_b else F.lit(False))
    extra = findings(finding(~exempt, policy.missing_b, policy.severity), finding(~exempt & (F.col("confidence") < MISSING_CONFIDENCE), "LOW_EXTRACTION_CONFIDENCE", "INFO"))
    missing_b = free_b.select("pair", F.when(exempt, "exempt").otherwise("item").alias("role"), none.cast("int").alias("a_ord"), F.col("item_ord").alias("b_ord"), none.cast("string").alias("item_number"), none.cast("string").alias("a_description"), F.col("description").alias("b_description"), F.when(exempt, "EXACT").otherwise("MISSING").alias("classification"), F.lit("NONE").alias("level"), F.when(exempt, 0.0).otherwise(F.coalesce("hint_score", F.lit(0.0))).alias("score"), none.cast("string").alias("relationship_id"), extra.alias("discrepancies"))
    rows = paired.unionByName(missing_a).unionByName(missing_b).withColumn("check", F.lit(policy.check))
    needs = (F.col("role") != "exempt") & (F.col("classification").isin("POTENTIAL", "MISMATCH", "MISSING") | (F.size("discrepancies") > 0))
    return rows.withColumn("requires_validation", needs)


def exempt_rows(lines: DataFrame) -> DataFrame:
    """The lines that comparisons leave out, with the reason; lines has category, quantity, active."""
    own = lines.withColumn("c", comparable(F.col("category"), F.col("quantity"), F.col("active"))).where("not c.ok")
    return own.select("pair", "item_ord", "item_number", F.col("c.reason").alias("reason"))


def header_rows(sets: DataFrame) -> DataFrame:
    """Does a label's reference belong to the family of its set? sets: pair, parent, ref."""
    known = F.col("parent").isNotNull() & F.col("ref").isNotNull()
    same = known & (text.family_of(F.col("parent")) == text.family_of(F.col("ref")))
    return sets.select("pair", "parent", "ref", F.when(same, "EXACT").when(known, "MISMATCH").otherwise("MISSING").alias("classification"), findings(finding(~same, "REF_PARENT_MISMATCH", "BLOCKER")).alias("discrepancies"))


def drawing_references(lines: DataFrame, drawings: DataFrame) -> DataFrame:
    """Is a drawing's number and revision named on a line of its set? lines: pair, item_ord, description; drawings: pair, number, revision."""
    hit = lines.join(drawings, "pair").where(F.contains(F.upper("description"), F.upper("number"))).groupBy("pair").agg(F.min_by("description", "item_ord").alias("line"))
    told = F.nullif(F.regexp_extract(F.upper("line"), r"\bREV\.?\s*([A-Z0-9]+)", 1), F.lit(""))
    out = drawings.join(hit, "pair", "left").withColumn("told", told)
    kind = F.when(F.col("number").isNull() | F.col("line").isNull(), "MISSING").when(F.col("told").isNotNull() & (F.col("told") != F.upper("revision")), "MISMATCH").otherwise("EXACT")
    return out.select("pair", "number", "revision", "told", kind.alias("classification"))


# --- change forms ---------------------------------------------------------------------------------


def coverage(codes: DataFrame, boms: DataFrame) -> DataFrame:
    """How many bills of materials each affected code has. codes: form, code; boms: document, parent."""
    n = boms.groupBy(F.col("parent").alias("code")).agg(F.count(F.lit(1)).alias("boms"))
    out = codes.join(n, "code", "left").withColumn("boms", F.coalesce("boms", F.lit(0)))
    kind = F.when(F.col("boms") == 0, "MISSING").when(F.col("boms") > 1, "POTENTIAL").otherwise("EXACT")
    return out.select("form", "code", "boms", kind.alias("classification"))


def change_applied(changes: DataFrame, lines: DataFrame, *, terms: DataFrame | None = None, skipped: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Is each change of a form applied on each affected set?

    changes: form, code, change_ord, kind, actual, proposed, qty_proposed, seq_proposed and, if descriptions count,
    description; lines: code, item_ord, item_number, quantity, oper_seq, active, redlines (texts) and, likewise, description.
    With descriptions, a deleted item that stands under another number with the same or a similar text is POTENTIAL, and an
    added one whose text differs has a MINOR DESC_MISMATCH. skipped (code) names sets of which pages weren't read: there, a
    deletion can't be confirmed. line_ord is the active line that a change was judged by.
    """
    key = ["form", "code", "change_ord"]
    seq = lambda c: text.parse_number(c)
    wanted = seq(F.col("seq_proposed"))
    # the lines of an item of a set as one list, so that changes are joined to them and not listed once per line and counted again
    line = F.struct("active", "item_ord", "quantity", "oper_seq", seq(F.col("oper_seq")).alias("seq"), "redlines")
    held = lines.groupBy("code", "item_number").agg(F.collect_list(line).alias("of")).hint("merge")
    of = lambda side, name: held.select("code", F.col("item_number").alias(side), F.col("of").alias(name))
    on = lambda name: F.filter(name, lambda x: x["active"])
    count = lambda listed: F.coalesce(F.when(listed.isNotNull(), F.size(listed)), F.lit(0)).cast("long")
    first = lambda name: F.array_min(F.transform(on(name), lambda x: F.struct(~F.coalesce(x["seq"] == wanted, F.lit(False)), x["item_ord"].alias("item_ord"), x["quantity"].alias("quantity"), x["oper_seq"].alias("oper_seq"), x["redlines"].alias("redlines"))))
    marked = held.select("code", F.explode(on("of")).alias("x")).select("code", F.explode("x.redlines").alias("proposed")).distinct().withColumn("p_redlined", F.lit(True))
    x = changes.join(of("actual", "a_of"), ["code", "actual"], "left").join(of("proposed", "p_of"), ["code", "proposed"], "left").join(marked, ["code", "proposed"], "left").na.fill(False, ["p_redlined"])
    x = x.withColumns({"a_rows": count(on("a_of")), "a_inactive": count(F.filter("a_of", lambda x: ~x["active"])), "a": first("a_of"), "p_rows": count(on("p_of")), "p": first("p_of")})
    row = F.when(F.col("kind") == "MODIFY", F.struct(F.col("a.quantity"), F.col("a.oper_seq"))).otherwise(F.struct(F.col("p.quantity"), F.col("p.oper_seq")))
    judged = F.when(F.col("kind").isin("MODIFY", "DELETE"), F.col("a.item_ord")).when(F.col("kind") == "ADD", F.col("p.item_ord")).otherwise(F.coalesce("p.item_ord", "a.item_ord"))
    rows = F.when(F.col("kind") == "MODIFY", F.col("a_rows")).otherwise(F.col("p_rows"))
    qty = text.parse_decimal(F.col("qty_proposed"))
    x = x.withColumns({"row": row, "rows": rows}).withColumn("differs", F.coalesce(qty != F.col("row.quantity"), qty.isNotNull()) | F.coalesce(wanted != seq(F.col("row.oper_seq")), wanted.isNotNull()))
    lines_said = F.coalesce(F.col("a.redlines"), F.array().cast("array<string>"))
    deleted = F.exists(lines_said, lambda r: F.upper(r).isin("DELETE", "DELETED", "REMOVE"))
    undecided = (F.col("rows") > 1) & wanted.isNull()
    absent, wrong = F.lit("PCO_CHANGE_NOT_APPLIED"), F.lit("PCO_QTY_SEQ_MISMATCH")
    out = lambda kind, why=None: F.struct(F.lit(kind).alias("classification"), (F.lit(None).cast("string") if why is None else why).alias("discrepancy"))
    alike, unlike = _alike(changes, lines, terms, t) if {"description"} <= set(changes.columns) & set(lines.columns) else (None, None)
    none = F.lit(None).cast("boolean")
    x = x.join(alike, key, "left").join(unlike, key, "left") if alike is not None else x.withColumns({"look_alike": none, "desc_differs": none})
    x = x.join(skipped.select("code", F.lit(True).alias("unread")).distinct(), "code", "left") if skipped is not None else x.withColumn("unread", none)
    true = lambda c: F.coalesce(c, F.lit(False))
    delete = F.when((F.col("a_rows") > 0) & deleted, out("POTENTIAL")).when(F.col("a_rows") > 0, out("MISMATCH", absent)).when(F.col("a_inactive") > 0, out("EXACT")).when(true("look_alike") | true("unread"), out("POTENTIAL")).otherwise(out("EXACT"))
    add = F.when((F.col("rows") == 0) & F.col("p_redlined"), out("POTENTIAL")).when(F.col("rows") == 0, out("MISMATCH", absent)).when(undecided, out("POTENTIAL")).when(F.col("differs"), out("MISMATCH", wrong)).otherwise(out("EXACT"))
    redlined = (F.col("a_rows") > 0) & (F.col("p_rows") == 0) & F.array_contains(lines_said, F.col("proposed"))
    substitute = F.when(redlined, out("POTENTIAL")).when((F.col("a_rows") > 0) | (F.col("p_rows") == 0), out("MISMATCH", absent)).when(F.col("differs"), out("MISMATCH", wrong)).otherwise(out("EXACT"))
    modify = F.when(F.col("rows") == 0, out("MISMATCH", absent)).when(undecided, out("POTENTIAL")).when(F.col("differs") & F.array_contains(lines_said, F.col("qty_proposed")), out("POTENTIAL")).when(F.col("differs"), out("MISMATCH", wrong)).otherwise(out("EXACT"))
    verdict = F.when(F.col("kind") == "DELETE", delete).when(F.col("kind") == "ADD", add).when(F.col("kind") == "SUBSTITUTE", substitute).otherwise(modify)
    minor = true("desc_differs") & (F.col("p_rows") > 0) & (((F.col("kind") == "ADD") & ~undecided) | ((F.col("kind") == "SUBSTITUTE") & (F.col("a_rows") == 0)))
    return x.withColumn("v", verdict).select("form", "code", "change_ord", "kind", "actual", "proposed", "v.classification", "v.discrepancy", F.when(minor, "DESC_MISMATCH").alias("minor"), judged.alias("line_ord"))


def _alike(changes: DataFrame, lines: DataFrame, terms: DataFrame | None, t: Thresholds) -> tuple[DataFrame, DataFrame]:
    """Per change: does an active line under another number say the same (look_alike), and does the line chosen for what is proposed say something else (desc_differs)?"""
    key = ["form", "code", "change_ord"]
    texts = changes.where("description is not null and description <> ''").select(*key, "description", "actual", "proposed", "seq_proposed", "kind")
    a = text.normalize_column(texts.select(F.col("code").alias("pair"), "description", F.lit(None).cast("string").alias("item_number"), F.col("code").alias("sku")).distinct().withColumn("item_ord", F.xxhash64("pair", "description")), "description")
    b = text.normalize_column(lines.where("active").select(F.col("code").alias("pair"), "item_ord", "item_number", "description"), "description")
    same = cut(matching.assignable(matching.ladder(a, b, terms=terms, t=t, prune=False)).select("pair", "a_ord", "b_ord"), "alike")
    said = same.join(a.select("pair", F.col("item_ord").alias("a_ord"), "description"), ["pair", "a_ord"]).join(b.select("pair", F.col("item_ord").alias("b_ord"), F.col("item_number").alias("number")), ["pair", "b_ord"]).withColumnRenamed("pair", "code")
    look = texts.where("kind = 'DELETE'").join(said, ["code", "description"]).where(F.col("number") != F.col("actual")).select(*key).distinct().withColumn("look_alike", F.lit(True))
    wanted = text.parse_number(F.col("seq_proposed"))
    on = lines.where("active").select("code", F.col("item_number").alias("proposed"), "item_ord", "oper_seq")
    first = texts.where("kind in ('ADD', 'SUBSTITUTE')").join(on, ["code", "proposed"]).groupBy(*key, "description").agg(F.min_by("item_ord", F.struct(~F.coalesce(text.parse_number(F.col("oper_seq")) == wanted, F.lit(False)), "item_ord")).alias("b_ord"))
    unlike = first.join(said, ["code", "description", "b_ord"], "left_anti").select(*key, F.lit(True).alias("desc_differs"))
    return look, unlike


# --- label revisions ------------------------------------------------------------------------------


def header_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row per set: is the reference or the product's name another one? Each: pair, ref, product."""
    a, b = (df.select("pair", F.coalesce("ref", F.lit("")).alias(f"{s}_ref"), F.coalesce("product", F.lit("")).alias(f"{s}_product")) for df, s in ((old, "a"), (new, "b")))
    x = a.join(b, "pair")
    same = (F.col("a_ref") == F.col("b_ref")) & (F.col("a_product") == F.col("b_product"))
    return x.select("pair", "a_ref", "b_ref", F.when(same, "EXACT").otherwise("MISMATCH").alias("classification"), findings(finding(~same, "UNEXPECTED_LABEL_CHANGE", "MAJOR")).alias("discrepancies"))


def _allotted(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th row of a key with its k-th expectation. rows: keys, place; expected: keys, exp_ord."""
    k = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("k", k("place")).join(expected.withColumn("k", k("exp_ord")), [*keys, "k"], "left").drop("k")


def revision_check(old: DataFrame, new: DataFrame, expected: DataFrame, *, rungs: str = "exact", terms: DataFrame | None = None) -> DataFrame:
    """Old against new lines of each set; each difference is explained by an expected change or flagged.

    old, new: as side A and B of pairing_check(); expected: pair, exp_ord, kind (ADD, REMOVE, SUBSTITUTE, QTY), exp_key,
    quantity, old_key (of a SUBSTITUTE, may be null). Keys are normalised texts in any order; the k-th difference of a kind
    and text takes the k-th expectation of it. A pair of lines is UNCHANGED only if text, quantity, sub-quantity and unit
    are the same. Expectations left over are satisfied if the new revision shows what they ask for: an ADD that is there, a
    REMOVE that isn't, a QTY with that quantity, a SUBSTITUTE that is there while the outgoing text isn't; others are absent.
    """
    rows = cut(pairing_check(old, new, Policy("LABEL_REVISION", "V", True, "UNEXPECTED_LABEL_CHANGE", "UNEXPECTED_LABEL_CHANGE"), rungs=rungs, terms=terms), "rows")
    told = lambda df, s: df.select("pair", F.col("item_ord").alias(f"{s}_ord"), F.col("quantity").alias(f"{s}_quantity"), F.upper(F.coalesce("uom", F.lit("EACH"))).alias(f"{s}_uom"), *[F.col(c).alias(f"{s}_{c}") if c in df.columns else F.lit(None).cast(t).alias(f"{s}_{c}") for c, t in (("sub_value", "int"), ("sub_kind", "string"))])
    x = rows.select("pair", "a_ord", "b_ord", "level", "a_description", "b_description").join(told(old, "a"), ["pair", "a_ord"], "left").join(told(new, "b"), ["pair", "b_ord"], "left")
    x = text.normalize_column(text.normalize_column(x, "a_description", "a"), "b_description", "b")
    one = {"EA": "EACH"}
    unit = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in one.items() for v in kv]), F.col(c)), F.col(c))
    same = {
        "DESC": F.col("level") == "EXACT",
        "QTY": F.coalesce(F.col("a_quantity") == F.col("b_quantity"), F.lit(False)),
        "SUB": F.col("a_sub_value").eqNullSafe(F.col("b_sub_value")) & F.col("a_sub_kind").eqNullSafe(F.col("b_sub_kind")),
        "UOM": unit("a_uom") == unit("b_uom"),
    }
    both = F.col("a_ord").isNotNull() & F.col("b_ord").isNotNull()
    changes = F.when(F.col("b_ord").isNull(), F.array(F.lit("REMOVED"))).when(F.col("a_ord").isNull(), F.array(F.lit("ADDED"))).otherwise(F.array_compact(F.array(*[F.when(~ok, F.lit(c)) for c, ok in same.items()])))
    x = cut(x.withColumns({"changes": changes, "place": F.coalesce("a_ord", "b_ord")}), "changes")
    unchanged = x.where(both & (F.size("changes") == 0)).select("pair", F.lit("UNCHANGED").alias("change"), F.col("b_key").alias("norm_key"), "a_ord", "b_ord", F.lit(None).cast("int").alias("exp_ord"), F.lit("EXACT").alias("classification"))

    each = x.select("pair", "a_ord", "b_ord", "a_key", "b_key", "b_quantity", "place", F.explode("changes").alias("change"))
    asks = F.when(F.col("change") == "REMOVED", "REMOVE").when(F.col("change") == "ADDED", "ADD").when(F.col("change") == "DESC", "SUBSTITUTE").when(F.col("change") == "QTY", "QTY")
    each = each.select("pair", "a_ord", "b_ord", "place", "change", asks.alias("kind"), F.when(F.col("change") == "REMOVED", F.col("a_key")).otherwise(F.col("b_key")).alias("exp_key"), "b_quantity", "a_key")
    want = expected.select("pair", "exp_ord", "kind", "exp_key", *[F.col(c) if c in expected.columns else F.lit(None).cast(t).alias(c) for c, t in (("quantity", "decimal(18,6)"), ("old_key", "string"))])
    keys = ["pair", "kind", "exp_key"]
    # a QTY is met at its quantity only, and a SUBSTITUTE of a given text by a line that had it
    by_quantity = _allotted(each.where("kind = 'QTY'").withColumn("quantity", F.col("b_quantity")), want.where("kind = 'QTY'").select(*keys, "quantity", "exp_ord"), [*keys, "quantity"]).drop("quantity")
    by_old = _allotted(each.where("kind = 'SUBSTITUTE'").withColumn("old_key", F.col("a_key")), want.where("kind = 'SUBSTITUTE' and old_key is not null").select(*keys, "old_key", "exp_ord"), [*keys, "old_key"]).drop("old_key")
    by_new = _allotted(by_old.where("exp_ord is null").drop("exp_ord"), want.where("kind = 'SUBSTITUTE' and old_key is null").select(*keys, "exp_ord"), keys)
    first = by_quantity.unionByName(by_old.where("exp_ord is not null")).unionByName(by_new)
    first = first.unionByName(_allotted(each.where("kind in ('ADD', 'REMOVE')"), want.where("kind in ('ADD', 'REMOVE')").select(*keys, "exp_ord"), keys))
    # a line that is new may be a substitution that names it
    first = cut(first, "met")
    rest = want.where("kind = 'SUBSTITUTE'").join(first.where("exp_ord is not null").select("pair", "exp_ord"), ["pair", "exp_ord"], "left_anti")
    late = _allotted(first.where("kind = 'ADD' and exp_ord is null").drop("exp_ord").withColumn("kind", F.lit("SUBSTITUTE")), rest.select(*keys, "exp_ord"), keys)
    met = first.where("not (kind = 'ADD' and exp_ord is null)").unionByName(late).unionByName(each.where("kind is null").withColumn("exp_ord", F.lit(None).cast(want.schema["exp_ord"].dataType)))
    qty_off = want.select("pair", "exp_ord", F.col("quantity").alias("asked"))
    met = cut(met.join(qty_off, ["pair", "exp_ord"], "left"), "met")
    off = (F.col("change") == "ADDED") & F.col("asked").isNotNull() & ~F.coalesce(F.col("asked") == F.col("b_quantity"), F.lit(False))
    found = met.select("pair", "change", F.col("exp_key").alias("norm_key"), "a_ord", "b_ord", "exp_ord", F.when(F.col("exp_ord").isNull(), "MISMATCH").when(off, "POTENTIAL").otherwise("EXACT").alias("classification"))

    there = text.normalize_column(new.select("pair", "description", "quantity"), "description").groupBy("pair", "norm_key").agg(F.collect_set("quantity").alias("shown"))  # the quantities one text has in one set
    left = want.join(met.where("exp_ord is not null").select("pair", "exp_ord"), ["pair", "exp_ord"], "left_anti")
    left = left.join(there.select("pair", F.col("norm_key").alias("exp_key"), "shown"), ["pair", "exp_key"], "left").join(there.select("pair", F.col("norm_key").alias("old_key"), F.lit(True).alias("old_there")), ["pair", "old_key"], "left")
    present = F.col("shown").isNotNull()
    ok = F.when(F.col("kind") == "ADD", present).when(F.col("kind") == "REMOVE", ~present).when(F.col("kind") == "QTY", present & F.coalesce(F.array_contains("shown", F.col("quantity")), F.lit(False))).otherwise(present & (F.col("old_key").isNull() | F.col("old_there").isNull()))
    none = F.lit(None).cast("int")
    absent = left.select("pair", F.when(ok, "SATISFIED").otherwise("ABSENT").alias("change"), F.col("exp_key").alias("norm_key"), none.alias("a_ord"), none.alias("b_ord"), "exp_ord", F.when(ok, "EXACT").otherwise("MISSING").alias("classification"))
    return unchanged.unionByName(found).unionByName(absent)


def _physical() -> Column:
    """Is a change of a physical component?"""
    return text.categorize(F.coalesce(F.nullif("proposed", F.lit("")), F.col("actual")), F.col("description"), F.lit(None).cast("decimal(18,6)"))["category"] == text.PHYSICAL


def _asked() -> Column:
    return F.when(F.col("kind") == "DELETE", "REMOVE").when(F.col("kind") == "MODIFY", "QTY").otherwise(F.col("kind"))


def expected_changes(changes: DataFrame, codes: DataFrame, boms: DataFrame) -> DataFrame:
    """What change forms let a label's next revision show, per affected set.

    changes: form, change_ord, kind, actual, proposed, description, qty_proposed; codes: form, sku; boms: sku, item_number,
    item_ord, description. Only physical components count; a SUBSTITUTE names the outgoing text, from the set's own bill of
    materials if it has it, else from the first one that does; a MODIFY asks for a quantity.
    """
    own, codes, boms = cut(changes.where(_physical()), "expected"), cut(codes.select("form", "sku"), "expected-codes"), cut(boms.select("sku", "item_number", "item_ord", "description"), "expected-boms")
    here = boms.groupBy("sku", F.col("item_number").alias("actual")).agg(F.min_by("description", "item_ord").alias("here"))
    anywhere = boms.groupBy(F.col("item_number").alias("actual")).agg(F.min_by("description", F.struct("sku", "item_ord")).alias("anywhere"))
    # the texts of a form's sets go to its changes, so that what is shuffled are the changes and not each of them for each set
    of_sets = codes.distinct().join(here, "sku").groupBy("form", "actual").agg(F.map_from_entries(F.collect_list(F.struct("sku", "here"))).alias("here"))
    own = cut(own.join(of_sets.hint("merge"), ["form", "actual"], "left").join(anywhere.hint("merge"), "actual", "left"), "expected-texts")
    x = own.join(codes.hint("merge"), "form").withColumn("out", F.coalesce(F.try_element_at("here", F.col("sku")), F.col("anywhere")))
    return x.select("sku", "form", "change_ord", _asked().alias("kind"), F.coalesce(F.when(F.col("kind") == "DELETE", F.col("out")), F.col("description")).alias("description"), text.parse_decimal(F.col("qty_proposed")).alias("quantity"), F.when(F.col("kind") == "SUBSTITUTE", F.col("out")).alias("old_description"))


def expected_change_counts(changes: DataFrame, codes: DataFrame, boms: DataFrame) -> DataFrame:
    """How many rows of each kind expected_changes() has, of how many sets, and how many name an outgoing text: kind, n, sets, named.

    Each of a form's changes holds for each of its sets, so they are counted as products and not listed. A SUBSTITUTE's outgoing
    text is there for all sets of its form if the first text that its item has anywhere is; only items that lack that one,
    some text of theirs being null, are looked for set by set.
    """
    own = changes.where(_physical()).select("form", "kind", "actual").groupBy("form", "kind", "actual").agg(F.count(F.lit(1)).alias("n"))
    own = cut(own.where("form is not null"), "expected-kinds")
    codes = cut(codes.where("form is not null").select("form", "sku"), "expected-codes")
    held = codes.groupBy("form").agg(F.count(F.lit(1)).alias("held"))
    texts = boms.groupBy(F.col("item_number").alias("actual")).agg(F.bool_and(F.col("description").isNotNull()).alias("told"))
    some = cut(texts.where("actual is not null and not told").select("actual"), "expected-unsure")
    subs = own.where("kind = 'SUBSTITUTE'")
    sure = subs.join(texts.where("told"), "actual").select("form", "n")
    named = sure.join(held, "form").select((F.col("n") * F.col("held")).alias("named"))
    if not some.isEmpty():
        of = cut(boms.join(some, F.col("item_number") == F.col("actual"), "left_semi").select("sku", F.col("item_number").alias("actual"), "item_ord", "description"), "expected-boms")
        anywhere = of.groupBy("actual").agg(F.min_by(F.col("description").isNotNull(), F.struct("sku", "item_ord")).alias("anywhere"))
        here = of.groupBy("sku", "actual").agg(F.min_by(F.col("description").isNotNull(), "item_ord").alias("here")).where("here")
        all_sets = subs.join(anywhere.where("anywhere"), "actual").join(held, "form").select((F.col("n") * F.col("held")).alias("named"))
        one_set = subs.join(anywhere.where("not coalesce(anywhere, false)"), "actual").join(codes, "form").join(here, ["sku", "actual"]).select(F.col("n").alias("named"))
        named = named.unionByName(all_sets).unionByName(one_set)
    total = named.agg(F.coalesce(F.sum("named"), F.lit(0)).alias("total"))  # one row
    n = own.join(held, "form").groupBy(_asked().alias("kind")).agg(F.sum(F.col("n") * F.col("held")).alias("n"))
    # a set's kinds as one list, so that it is shuffled once
    kinds = own.groupBy("form").agg(F.collect_set(F.struct(_asked().alias("_kind"))).alias("kinds"))
    sets = codes.where("sku is not null").join(kinds, "form").groupBy("sku").agg(F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    sets = sets.select(F.inline("kinds")).groupBy("_kind").agg(F.count(F.lit(1)).alias("sets"))
    out = n.join(sets, F.col("kind").eqNullSafe(F.col("_kind")), "left").crossJoin(F.broadcast(total))
    return out.select("kind", "n", F.coalesce("sets", F.lit(0)).alias("sets"), F.when(F.col("kind") == "SUBSTITUTE", F.col("total")).otherwise(0).alias("named"))


def mark_kind(state: Column, classification: Column, discrepancies: Column, requires_validation: Column) -> Column:
    """How a line is marked on the annotated print: clear, discrepancy or review. state: what reviewers said (clear or discrepancy), or null."""
    real = F.exists(discrepancies, lambda d: d["severity"] != "INFO") | classification.isin("MISMATCH", "MISSING")
    return F.when(state.isin("clear", "discrepancy"), state).when(real, "discrepancy").when(requires_validation, "review").otherwise("clear")


def drawing_relevant(lines: DataFrame) -> DataFrame:
    """Lines that a packaging drawing must show: comparable ones, and packaging that is active; merged rows come first by item_ord."""
    ok = comparable(F.col("category"), F.col("quantity"), F.col("active"))["ok"]
    return lines.where(ok | ((F.col("category") == "PACKAGING") & F.col("active")))


def header_items(documents: DataFrame) -> DataFrame:
    """A line per document that stands for its header. documents: doc, doc_type, sku, header (a map)."""
    h = lambda k: F.coalesce(F.try_element_at("header", F.lit(k)), F.lit(""))
    sku = F.coalesce("sku", F.lit(""))
    kind = F.col("doc_type")
    code = F.when(kind.isin("BOM", "LABEL"), sku).when(kind == "PCO", h("pco_number")).otherwise(F.coalesce(F.nullif(h("drawing_number"), F.lit("")), sku))
    revision = F.coalesce(F.try_element_at("header", F.lit("revision")), F.lit("?"))
    said = F.when(kind == "BOM", h("parent_description")).when(kind == "LABEL", h("product_name")).when(kind == "PCO", F.concat(F.lit("PCO "), h("pco_number"), F.lit(" rev "), revision)).otherwise(h("title"))
    raw = F.when(kind == "BOM", F.concat(F.lit("Parent Item "), sku)).when(kind == "LABEL", F.concat(F.lit("REF "), sku)).when(kind == "PCO", F.concat(F.lit("PCO "), h("pco_number"))).otherwise(F.concat(F.lit("Drawing "), h("drawing_number")))
    return documents.select("doc", "doc_type", F.nullif(code, F.lit("")).alias("item_number"), F.coalesce(F.nullif(said, F.lit("")), F.lower("doc_type")).alias("description"), raw.alias("raw_text"))


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """A row per broken rule; a rule holds where it is true or null."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))
