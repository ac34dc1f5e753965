"""Operators on hand-made rows: forms, layout, terminology, review, evaluation, revisions."""

import datetime

import pytest
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import checks, evaluation, layout, results, review, terms
from lineweave.sources import tables

AT = lambda d, m=1: datetime.datetime(2024, m, d)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_keys_and_cells(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    assert value(spark, text.row_id(lit("R"), lit("10NS"), lit("ab12"), lit(7))) == "R-10NS-ab12-007"
    assert value(spark, text.row_id(lit("V"), lit("10NS"), none, lit(1234))) == "V-10NS-1234"
    key = lambda role, item, a, b, change: value(spark, text.comparison_key(lit("C"), lit("S"), lit(role), item, a, b, change))
    assert key("header", lit("1"), none, none, none) == "C|S|header" and key("item", lit("1"), lit("X"), none, none) == "C|S|A:1"
    assert key("item", none, lit("X"), lit("Y"), none) == "C|S|A:X" and key("item", none, none, lit("Y"), none) == "C|S|B:Y" and key("change", none, none, none, lit("ADD:9")) == "C|S|A:ADD:9"
    assert value(spark, text.change_key(lit("SUBSTITUTE"), lit(" 1 "), lit("2"))) == "SUBSTITUTE:1->2"
    assert value(spark, text.revision_key(lit("REMOVED"), lit("old"), none)) == "REMOVED:old" and value(spark, text.revision_key(lit("DESC"), lit("old"), lit("new"))) == "DESC:new"
    assert value(spark, text.split_list(lit("TAPE, SURGICAL; x\n y ;"), commas=False)) == ["TAPE, SURGICAL", "x", "y"] and value(spark, text.split_list(none)) == []
    assert [value(spark, text.is_truthy(lit(x))) for x in ("y", " Yes", "active", "N", "")] == [True, True, True, False, False]
    assert tuple(value(spark, text.scope_parts(lit("family:313")))) == (True, "family", "313") and not value(spark, text.scope_parts(lit("nowhere"))).valid
    assert value(spark, text.relative_path(lit("/in/a/b.pdf"), lit("/in/"))) == "a/b.pdf" and value(spark, text.relative_path(lit("/x/b.pdf"), lit("/in"))) == "/x/b.pdf"
    d, n = F.lit(None).cast("date"), F.lit(None).cast("double")
    assert [value(spark, text.cell_text(lit(4.0), d, none)), value(spark, text.cell_text(lit(0.25), d, none)), value(spark, text.cell_text(n, lit(AT(3).date()), none)), value(spark, text.cell_text(n, d, lit(" x ")))] == ["4", "0.25", "01/03/24", "x"]


def test_types_and_dispatch(spark):
    lines = [(1, "a.pdf", 1, "Bill of Material Print"), (2, "b.pdf", 1, "DO NOT SCALE"), (3, "c.pdf", 1, "Contents"), (3, "c.pdf", 2, "REF 12"), (4, "my-bill.pdf", 1, "x"), (5, "e.csv", 1, "Component Item"), (6, "f.csv", 1, "other"), (6, "f.csv", 50, "Component Item"), (7, "label.csv", 1, "z")]
    typed = tables.detect_type(spark.createDataFrame(lines, "doc long, path string, ord int, text string"))
    assert rows(typed, "doc", "doc_type") == [(1, "BOM"), (2, "DRAWING"), (3, "LABEL"), (4, "BOM"), (5, "BOM"), (6, None), (7, "LABEL")]
    assert rows(tables.dispatch(typed), "doc", "outcome")[5:] == [(6, "unrecognised"), (7, "unsupported")]


def test_form_rows_and_fields(spark):
    cells = [("f", 2, 0, "3131910FNS"), ("f", 2, 1, "100"), ("f", 2, 2, "DELETE"), ("f", 3, 0, "bad code!"), ("f", 3, 1, ""), ("f", 3, 2, "200"), ("f", 4, 1, "1"), ("f", 4, 2, "2")]
    header = spark.createDataFrame([("f", 1, n, k) for k, n in enumerate(("affected_code", "item_actual", "item_proposed"))], "file string, header_row int, name string, col int")
    codes, changes, bad = tables.form_rows(spark.createDataFrame(cells, "file string, row int, col int, text string"), header)
    assert rows(codes, "code") == [("3131910FNS",)] and rows(bad, "warning") == [("not a code: BAD CODE!",)]
    assert rows(changes, "kind", "change_key") == [("ADD", "ADD:200"), ("DELETE", "DELETE:100"), ("SUBSTITUTE", "SUBSTITUTE:1->2")]
    lines = spark.createDataFrame([(1, 1, "PCO 34590, 2"), (1, 2, "PCO 99, 1"), (1, 3, "Start"), (1, 4, "one"), (1, 5, "two"), (1, 6, "End"), (1, 7, "three")], "doc int, ord int, text string")
    assert rows(tables.header_fields(lines, {"pco": r"PCO\s*(\d+)", "none": "(zzz)"}), "name", "value") == [("pco", "34590")]
    assert rows(tables.between(lines, F.col("text") == "Start", F.col("text") == "End"), "text") == [("one two",)]
    boxes = ("New", "Change", "Substitute")
    assert [value(spark, tables.checked_box(F.lit(x), boxes)) for x in ("[ ] New [X] Change", "[x] New [x] Change", "[ ] New")] == ["Change", None, None]
    printed = spark.createDataFrame([("RM-1", "1"), ("rm1", "1"), ("RM1", "x")], "item_number string, level string")
    assert rows(tables.item_rows(printed), "item_number") == [("RM-1",)]
    docs = spark.createDataFrame([(1, "LABEL", {"ref": "1"}), (2, "LABEL", {})], "doc int, doc_type string, header map<string,string>")
    assert rows(tables.parser_warnings(docs, lines, {"LABEL": "ref"}), "doc", "warning") == [(2, "no lines were read"), (2, "no ref")]


def test_sets_and_runs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "F", "BOM", "10NS", "current"), (2, "F", "LABEL", "11X", "old"), (3, "F", "LABEL", "10L", "new"), (4, "G", "LABEL", None, "current")], "doc int, folder string, doc_type string, sku string, role string")
    grouped = tables.set_key(docs)
    facts = tables.set_facts(grouped)
    assert rows(tables.set_members(grouped), "set", "members") == [("doc:4", [4]), ("folder:F", [1, 2, 3])]
    assert rows(tables.foreign_references(grouped, facts), "doc", "ref") == [(2, "11X")]
    assert rows(tables.revision_pairs(grouped), "a_doc", "b_doc") == [(2, 3)] and rows(tables.unpairable(facts), "set") == [("doc:4",)]
    for n in (2, 3):  # a run that is written again takes its own place
        tables.write_run({"rows": spark.range(n)}, str(tmp_path), "r1")
    tables.write_run({"rows": spark.range(5)}, str(tmp_path), "r2")
    assert tables.load_run(spark, str(tmp_path), "rows", "r1").count() == 3 and tables.load_run(spark, str(tmp_path), "rows").count() == 8
    shas = spark.createDataFrame([("ab12" * 16,), ("cd34" * 16,)], "sha string")
    assert tables.run_id(shas, "d", "s").first() == tables.run_id(shas.orderBy("sha"), "d", "s").first() != tables.run_id(shas, "e", "s").first()


def test_layout_of_callouts_and_labels(spark):
    said = {"TUBO CON AGUJA": True, "NEEDLE WITH TUBE": False, "CINTA MÉTRICA": True, "12345": False, "LABEL DE": False}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.s for r in df.select("t", layout.is_spanish(F.col("t")).alias("s")).collect()} == said
    lines = spark.createDataFrame([(1, 1, 0, "NEEDLE 22G"), (1, 1, 1, "SCALE 1:1"), (1, 1, 1, "x")], "doc_id int, page int, callout int, text string")
    assert rows(layout.without_noise(lines), "text") == [("NEEDLE 22G",)]
    assert tuple(value(spark, layout.cleaned_callout(F.lit("MASK (IF APPLICABLE PER BOM) (PLACE IN TRAY)")))) == ("MASK", True, "PLACE IN TRAY")
    words = spark.createDataFrame([(1, 1, 1, t, 10.0 * k) for k, t in enumerate(["Item", "Number", "Quantity", "Item"])], "doc_id int, page int, line int, text string, x0 double")
    assert rows(layout.header_labels(words, {"item": ("item", "number"), "qty": ("quantity",)}), "name", "x0") == [("item", 0.0), ("qty", 20.0)]
    assert value(spark, layout.starts_entry(F.lit("2"), F.lit("Each"))) and not value(spark, layout.starts_entry(F.lit("2"), F.lit("towels")))
    entry = spark.createDataFrame([(1, 1, 1, 1, 1, 5.0, "2", 0.0), (1, 1, 1, 1, 1, 9.0, "Each", 0.0), (1, 1, 1, 1, 2, 5.0, "gauze", 12.0)], "doc_id int, page int, col int, entry int, line int, x0 double, text string, y0 double")
    assert rows(layout.entry_texts(entry), "text") == [("2 Each gauze",)]
    bands = layout.bands_from_header(spark.createDataFrame([(1, 1, "item", 0.0), (1, 1, "qty", 100.0)], "doc_id int, page int, name string, x0 double"))
    notes = spark.createDataFrame([(1, 1, "5", 101.0, 20.0, 110.0, 28.0), (1, 1, "far", 0.0, 300.0, 9.0, 310.0)], "doc_id int, page int, content string, x0 double, y0 double, x1 double, y1 double")
    printed = spark.createDataFrame([(1, 1, 4, 18.0, 26.0)], "doc_id int, page int, row int, y0 double, y1 double")
    assert [[tuple(x) for x in r.redlines] for r in layout.redline_fields(printed, notes, bands).collect()] == [[("qty", "5")]]
    tall = spark.createDataFrame([(1, 1, 0.0, 8.0), (1, 1, 10.0, 20.0), (1, 1, 30.0, 42.0)], "doc_id int, page int, y0 double, y1 double")
    assert {r.gap for r in layout.gap_of(tall).collect()} == {25.0}
    ref = spark.createDataFrame([(1, 1, k, float(k), t) for k, t in enumerate(["REF", "A1", "x", "REF", "B2", "REF", "B2"])], "doc_id int, page int, line int, x0 double, text string")
    assert layout.most_named(ref).first().ref == "B2"


@pytest.fixture
def versions(spark):
    v = [("REL-001", 1, "TOWEL", ["CLOTH, BLUE"], "global", True, False, AT(1)), ("REL-001", 2, "TOWEL", ["CLOTH, BLUE"], "global", False, False, AT(5)), ("REL-002", 1, "MASK", [], "sku:1", True, False, AT(2)), ("REL-002", 2, "MASK", [], "sku:1", True, True, AT(20, 3))]
    return spark.createDataFrame(v, "id string, version int, canonical string, aliases array<string>, scope string, active boolean, deleted boolean, changed_at timestamp")


def test_terminology(spark, versions):
    assert rows(terms.history(versions), "id", "version", "change") == [("REL-001", 1, "create"), ("REL-001", 2, "deactivate"), ("REL-002", 1, "create"), ("REL-002", 2, "delete")]
    runs = spark.createDataFrame([("a", AT(3)), ("b", AT(10, 2)), ("c", AT(25, 3)), ("early", AT(1, 1) - datetime.timedelta(days=90))], "run_id string, started_at timestamp")
    assert rows(terms.as_of(versions, runs), "run_id", "id", "version") == [("a", "REL-001", 1), ("a", "REL-002", 1), ("b", "REL-001", 2), ("b", "REL-002", 1), ("c", "REL-001", 2)]
    now = terms.current(versions).withColumns({"doc_types": F.array().cast("array<string>"), "item_anchors": F.array().cast("array<string>"), "notes": F.lit("")})
    edited = [(2, "REL-001", "TOWEL", "CLOTH, BLUE", "global", "", "", "N", ""), (3, "REL-001", "TOWELS", "", "", "bom", "", "", ""), (4, "", "NEW", "", "family:1", "", "7;8", "Y", ""), (5, "REL-009", " ", "", "", "", "", "", ""), (6, "", "X", "", "planet:1", "", "", "", ""), (7, "", "X", "", "", "MAP", "", "", "")]
    acts = terms.import_actions(spark.createDataFrame(edited, "line int, id string, canonical string, aliases string, scope string, doc_types string, item_anchors string, active string, notes string"), now)
    assert [a for _, a in rows(acts, "line", "action")] == ["unchanged", "update", "create", "blank", "invalid", "invalid"]
    assert rows(terms.exported(now), "id", "aliases", "active") == [("REL-001", "CLOTH, BLUE", "N")]
    assert rows(terms.listed(versions.where("version = 1"), search="cloth"), "id") == [("REL-001",)] and rows(terms.scope_counts(versions.where("version = 1")), "kind", "active") == [("global", 1), ("sku", 1)]
    found = spark.createDataFrame([("A", "B", ["1"]), ("C", "D", [])], "a_key string, b_key string, item_anchors array<string>")
    assert rows(terms.approved(found, 12, anchor=True), "id", "canonical", "item_anchors") == [("REL-012", "B", ["1"]), ("REL-013", "D", [])] and terms.rejected(found, "me").count() == 2


def test_dictionary_by_document_types(spark):
    from lineweave.operators import matching

    term = spark.createDataFrame([("REL-1", "CLOTH", ["TOWEL"], "global", ["BOM", "LABEL"], [], True), ("REL-2", "WIPE", [], "global", [], ["77"], True)], "id string, canonical string, aliases array<string>, scope string, doc_types array<string>, item_anchors array<string>, active boolean")
    side = lambda said, types: text.normalize_column(spark.createDataFrame([(1, 1, "77", "1NS", said, types)], "pair int, item_ord int, item_number string, sku string, description string, doc_types array<string>"), "description")
    b = text.normalize_column(spark.createDataFrame([(1, 1, "CLOTH"), (1, 2, "WIPE")], "pair int, item_ord int, description string"), "description")
    found = lambda types: rows(matching.dictionary_candidates(side("TOWEL", types), b, term), "b_ord", "relationship_id", "confirm")
    assert found(["BOM", "LABEL"]) == [(1, "REL-1", False), (2, "REL-2", True)] and found(["BOM", "DRAWING"]) == [(2, "REL-2", True)]


LINE = "pair int, item_ord int, item_number string, sku string, description string, quantity decimal(18,6), uom string, category string, confidence double"


def test_revisions(spark):
    from decimal import Decimal

    line = lambda k, said, q, uom="EACH": (1, k, str(k), "1NS", said, Decimal(q), uom, "PHYSICAL_COMPONENT", 1.0)
    old = spark.createDataFrame([line(1, "TOWEL", 1), line(2, "GLOVE LATEX", 2), line(3, "MASK", 1), line(4, "TAPE", 1)], LINE)
    new = [(1, 1, "TOWELS", Decimal(1), "EACH", None, None, False, 1.0), (1, 2, "GLOVE LATEX", Decimal(3), "EACH", None, None, False, 1.0), (1, 3, "GAUZE", Decimal(2), "EACH", None, None, False, 1.0), (1, 4, "TAPE", Decimal(1), "PACK", None, None, False, 1.0)]
    new = spark.createDataFrame(new, "pair int, item_ord int, description string, quantity decimal(18,6), uom string, sub_value int, sub_kind string, conditional boolean, confidence double")
    want = [(1, 1, "QTY", "GLOVE LATEX", Decimal(3), None), (1, 2, "REMOVE", "MASK", None, None), (1, 3, "SUBSTITUTE", "GAUZE", None, "MASK"), (1, 4, "ADD", "TOWEL", None, None), (1, 5, "QTY", "TOWEL", Decimal(9), None), (1, 6, "SUBSTITUTE", "TAPE", None, "SWAB"), (1, 7, "REMOVE", "TAPE", None, None)]
    got = checks.revision_check(old, new, spark.createDataFrame(want, "pair int, exp_ord int, kind string, exp_key string, quantity decimal(18,6), old_key string"))
    assert rows(got, "change", "norm_key", "exp_ord", "classification") == sorted(
        [("UNCHANGED", "TOWEL", None, "EXACT"), ("QTY", "GLOVE LATEX", 1, "EXACT"), ("REMOVED", "MASK", 2, "EXACT"), ("ADDED", "GAUZE", 3, "EXACT"), ("UOM", "TAPE", None, "MISMATCH")]
        + [("SATISFIED", "TOWEL", 4, "EXACT"), ("ABSENT", "TOWEL", 5, "MISSING"), ("SATISFIED", "TAPE", 6, "EXACT"), ("ABSENT", "TAPE", 7, "MISSING")],
        key=repr,
    )
    heads = spark.createDataFrame([(1, "R1", "P"), (2, "R2", "P")], "pair int, ref string, product string")
    assert rows(checks.header_change(heads, heads.withColumn("product", F.when(F.col("pair") == 2, "Q").otherwise("P"))), "pair", "classification") == [(1, "EXACT"), (2, "MISMATCH")]


def test_change_forms_by_description(spark):
    lines = [("1NS", 1, "500", "TOWEL BLUE LARGE", 1.0, "10", True, []), ("1NS", 2, "600", "GLOVE", 1.0, "10", True, []), ("1NS", 3, "700", "MASK", 1.0, "10", False, []), ("2NS", 1, "1", "x", 1.0, "1", True, [])]
    lines = spark.createDataFrame(lines, "code string, item_ord int, item_number string, description string, quantity double, oper_seq string, active boolean, redlines array<string>").withColumn("quantity", F.col("quantity").cast("decimal(18,6)"))
    forms = [("F", "1NS", 1, "DELETE", "499", "DELETE", "", "", "BLUE TOWEL LARGE"), ("F", "1NS", 2, "DELETE", "498", "DELETE", "", "", "SCALPEL"), ("F", "1NS", 3, "DELETE", "700", "DELETE", "", "", "MASK"), ("F", "1NS", 4, "ADD", "", "600", "1", "10", "SYRINGE"), ("F", "2NS", 5, "DELETE", "9", "DELETE", "", "", "ZZZ")]
    forms = spark.createDataFrame(forms, "form string, code string, change_ord int, kind string, actual string, proposed string, qty_proposed string, seq_proposed string, description string")
    got = checks.change_applied(forms, lines, skipped=spark.createDataFrame([("2NS",)], "code string"))
    assert rows(got, "change_ord", "classification", "minor") == [(1, "POTENTIAL", None), (2, "EXACT", None), (3, "EXACT", None), (4, "EXACT", "DESC_MISMATCH"), (5, "POTENTIAL", None)]
    want = checks.expected_changes(forms.drop("code"), spark.createDataFrame([("F", "1NS")], "form string, sku string"), lines.select(F.col("code").alias("sku"), "item_number", "item_ord", "description"))
    assert ("REMOVE", "MASK") in rows(want, "kind", "description")


def test_review_events(spark):
    d = spark.createDataFrame([("r", 1, 1, "ACCEPT", "x"), ("r", 1, 3, "ACCEPT", None), ("r", 1, 2, "OVERRIDE", None), ("r", 1, 2, "OVERRIDE", "EXACT"), ("r", 1, 2, "MAYBE", None)], "run_id string, row_id int, slot int, decision string, override string")
    assert [r.error for r in review.checked_decisions(d).collect()] == [None, "reviewer slot must be 1 or 2", "OVERRIDE requires a classification", None, "unknown decision"]
    assert review.checked_decisions(d).first().override is None
    finals = spark.createDataFrame([("r", 1, "ACCEPT", AT(1)), ("r", 1, "OVERRIDE", AT(2)), ("r", 1, "nonsense", AT(3))], "run_id string, row_id int, final string, finalized_at timestamp")
    assert rows(review.latest_finals(finals), "final") == [("OVERRIDE",)]
    items = spark.createDataFrame([("i", AT(1), "OPEN", "a"), ("i", AT(3), "RESOLVED", "b")], "item_id string, at timestamp, status string, owner string")
    assert rows(review.item_states(items), "status", "owner") == [("RESOLVED", "b")]
    tries = spark.createDataFrame([("a", AT(1) + datetime.timedelta(minutes=k), k == 2) for k in range(9)] + [("b", AT(1), False)], "actor string, at timestamp, ok boolean")
    assert rows(review.locked_until(tries), "actor", "locked_until") == [("a", AT(1) + datetime.timedelta(minutes=23))]
    blind = review.blind_view(spark.createDataFrame([(1, "AGREED", "ACCEPT", None, None, None, None, "EXACT", "EXACT")], "row_id int, state string, d1 string, o1 string, d2 string, o2 string, final string, classification string, effective string"), 2, True)
    assert blind.first().state == "ENGINE_RECOMMENDED" and blind.first().d1 is None
    assert value(spark, review.blind_for(F.lit(2), F.lit(False), F.lit(None).cast("boolean"))) and not value(spark, review.blind_for(F.lit(1), F.lit(True), F.lit(True)))


FOUND = "array<struct<type:string,severity:string>>"


def test_run_comparison_and_mining(spark):
    row = lambda key, found, cls="EXACT", need=False, sku="s", role="item": (key, sku, "C", role, key, found, cls, need)
    schema = f"comparison_key string, sku string, check string, role string, row_id string, discrepancies {FOUND}, classification string, requires_validation boolean"
    info, qty = [("LOW_EXTRACTION_CONFIDENCE", "INFO")], [("QTY_MISMATCH", "MAJOR")]
    before = spark.createDataFrame([row("a", info), row("b", qty), row("c", []), row("d", qty), row("e", []), row("x", [], sku="gone"), row("h", qty)], schema)
    after = spark.createDataFrame([row("a", []), row("b", info), row("c", info), row("e", [], "POTENTIAL", True), row("f", []), row("g", info), row("h", qty)], schema)
    got = review.run_diff(before, after)
    assert rows(got, "comparison_key", "status") == [("a", "resolved"), ("b", "still_open"), ("c", "new"), ("d", "gone"), ("e", "changed"), ("f", "changed"), ("g", "new"), ("h", "still_open"), ("x", "not_covered")]
    assert {r.comparison_key: r.note for r in got.collect()}["b"].endswith("(different discrepancy type)")
    assert [r.status for r in review.diff_order(got).collect()][:2] == ["resolved", "new"]
    mined = spark.createDataFrame([("r", k, f"s{k % 2}", "C", "FUZZY", "A", "B", str(k), info if k == 2 else []) for k in range(3)], f"run_id string, row_id int, sku string, check string, level string, a_key string, b_key string, item_number string, discrepancies {FOUND}")
    said = spark.createDataFrame([("r", 0, 1, "ACCEPT", None, AT(1)), ("r", 1, 1, "OVERRIDE", "MISSING", AT(1))], "run_id string, row_id int, slot int, decision string, override string, decided_at timestamp")
    m = review.mining(mined, decisions=said).first()
    assert (m.sets, m.rows, m.would_clear, m.still_review, m.confirmed, m.contradicted, m.item_anchors, m.checks) == (2, 3, 2, 1, 1, 1, ["0", "1", "2"], ["C"])
    assert review.mining(mined, rejected=spark.createDataFrame([("A", "B")], "a_key string, b_key string")).count() == 0
    work = review.worklist(review.mining(mined))
    assert tuple(review.top_share(work, 5, 4).first()) == (1, 2, 50.0)


def test_harness(spark):
    got = [("s", "C", "1", "a1", None, "EXACT", []), ("s", "C", "2", "a2", "K", "MISMATCH", [("QTY", "MAJOR"), ("LOW", "INFO")]), ("s", "C", "3", None, "LONE", "MISSING", [("MISSING_IN_BOM", "MAJOR")]), ("s", "C", "4", "a9", "Z", "MISSING", [("EXTRA", "MAJOR"), ("LOW", "INFO")])]
    got = spark.createDataFrame(got, f"sku string, check string, row_id string, a_key string, b_key string, classification string, discrepancies {FOUND}")
    want = [("1", "s", "C", "a1", ["K"], "EXACT", []), ("2", "s", "C", "a2", ["J", "K"], "MISMATCH", ["QTY", "LOW"]), ("3", "s", "C", None, ["OTHER", "LONE"], "MISSING", ["MISSING_IN_BOM"]), ("5", "s", "C", "a7", [], "MISSING", ["GONE"])]
    want = evaluation.expectation_keys(spark.createDataFrame(want, "exp_id string, sku string, check string, a_key string, b_any array<string>, classification string, discrepancies array<string>"))
    scored = evaluation.scored_rows(got, want)
    flags = evaluation.finding_flags(scored)
    assert rows(flags, "type", "outcome") == [("EXTRA", "fp"), ("GONE", "fn"), ("LOW", "tp"), ("MISSING_IN_BOM", "tp"), ("QTY", "tp")]
    total = evaluation.metrics(flags).where("type is null and check is null and sku is null").first()
    assert (total.tp, total.fp, total.fn, total.precision, total.recall) == (3, 1, 1, 0.75, 0.75) and evaluation.gate(evaluation.metrics(flags)).count() > 0
    n = evaluation.accuracy_counts(scored).where("check is null").first()
    assert (n.scored, n.n_produced, n.n_paired, n.n_classified) == (4, 3, 2, 3)
    assert evaluation.disagreements(scored).count() == 4
    assert rows(evaluation.false_missing(spark.createDataFrame([("s", "1", "MISSING")], "sku string, item_number string, classification string"), spark.createDataFrame([("s", "1"), ("s", "2")], "sku string, item_number string")), "item_number") == [("1",)]
    assert evaluation.phase_metrics(spark.createDataFrame([("match", 2.0, 100, 4)], "phase string, seconds double, rows int, sets int")).first().rows_per_s == 50.0


def test_result_lists(spark, tmp_path):
    schema = f"row_id string, sku string, check string, role string, classification string, requires_validation boolean, a_description string, b_description string, item_number string, explanation string, a_ord int, b_ord int, level string, score double, discrepancies {FOUND}"
    x = [("1", "s", "C", "item", "MISMATCH", True, "Blue towel", None, "77", "", 1, None, "NONE", 0.0, [("QTY_MISMATCH", "MAJOR")]), ("2", "s", "C", "item", "EXACT", False, "Mask", "Mask", "78", "same TOWEL", 2, 2, "EXACT", 1.0, []), ("3", "t", "C", "exempt", "EXACT", False, None, None, None, None, 3, None, "NONE", 0.0, [])]
    df = spark.createDataFrame(x, schema)
    find = lambda **k: [r[0] for r in rows(results.filtered(df, **k), "row_id")]
    assert find(said="towel") == ["1", "2"] and find(severity="MAJOR") == ["1"] and find(discrepancy="QTY_MISMATCH", sku="s") == ["1"] and find(needs_validation=False, role="item") == ["2"] and find(said="none of it") == []
    assert [(r.row_id, r.total) for r in results.page(df, 1, 1).collect()] == [("2", 3)]
    assert rows(results.reviewable(df), "row_id") == [("1",), ("2",)]
    assert rows(results.check_table(df), "row_id", "severity", "types")[:2] == [("1", "MAJOR", "QTY_MISMATCH"), ("2", "", "")]
    assert results.assembled(df, df.drop("score")).where("score is null").count() == 3
    marks = df.select("row_id", checks.mark_kind(F.lit(None).cast("string"), F.col("classification"), F.col("discrepancies"), F.col("requires_validation")).alias("mark"))
    assert rows(marks, "row_id", "mark") == [("1", "discrepancy"), ("2", "clear"), ("3", "clear")]
    lines = spark.createDataFrame([(1, 1, "Blue towel", "77", 0.5), (1, 2, "Mask", None, 1.0)], "doc int, page int, description string, item_number string, confidence double")
    assert results.line_search(lines, page_no=1, said="TOWEL").count() == 1 and results.low_confidence(lines).count() == 1
    assert results.callouts(spark.createDataFrame([("callout",), ("title",)], "kind string")).count() == 1
    results.write_metrics(spark.range(2), f"{tmp_path}/m")
    results.write_metrics(spark.range(3), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 3
    heads = spark.createDataFrame([(1, "BOM", "10NS", {"parent_description": "KIT"}), (2, "DRAWING", None, {"drawing_number": "DWG1", "title": ""}), (3, "PCO", None, {"pco_number": "PCO9"})], "doc int, doc_type string, sku string, header map<string,string>")
    assert rows(checks.header_items(heads), "doc", "item_number", "description") == [(1, "10NS", "KIT"), (2, "DWG1", "drawing"), (3, "PCO9", "PCO PCO9 rev ?")]


def test_semantic_and_suggested_rungs(spark):
    from lineweave.operators import matching

    a = text.normalize_column(spark.createDataFrame([(1, 1, "1", "1NS", "XQZ"), (1, 2, "2", "1NS", "GLOVE")], "pair int, item_ord int, item_number string, sku string, description string"), "description")
    b = text.normalize_column(spark.createDataFrame([(1, 1, "WVK"), (1, 2, "UPO")], "pair int, item_ord int, description string"), "description")
    vectors = spark.createDataFrame([("XQZ", [1.0, 0.0]), ("WVK", [1.0, 0.1]), ("GLOVE", [0.0, 1.0]), ("UPO", [1.0, -1.0])], "norm_text string, vector array<double>")
    said = spark.createDataFrame([("GLOVE", "UPO", "SAME_ITEM", 0.9), ("XQZ", "UPO", "UNSURE", 0.9)], "a_text string, b_text string, verdict string, confidence double")
    got = matching.ladder(a, b, vectors=vectors, suggestions=said)
    assert rows(got, "a_ord", "b_ord", "level", "weak") == [(1, 1, "SEMANTIC", False), (2, 2, "SUGGESTION", True)]
    assert rows(matching.greedy_pairs(got), "a_ord", "b_ord") == [(1, 1)]


def test_many_equal_lines_are_assigned_in_order(spark):
    from lineweave.operators import matching

    c = spark.createDataFrame([(1, i, j, "FUZZY", 1, 0.9, False, False, False, None) for i in range(20) for j in range(20)], "pair int, a_ord int, b_ord int, level string, level_rank int, score double, weak boolean, conflict boolean, confirm boolean, relationship_id string")
    assert sorted((r.a_ord, r.b_ord) for r in matching.greedy_pairs(c).collect()) == [(k, k) for k in range(20)]


def test_normalised_either_way(spark):
    from lineweave.operators import matching

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["Tape™ Strips", "ＦＵＬＬ width", None, "", "Tape™ Strips", "towels 5 mL"])], "item_ord int, description string")
    want = rows(text.normalize_column(df, "description"), "item_ord", "norm_key", "norm_tokens")
    few = rows(matching.normalized_lines(df), "item_ord", "norm_key", "norm_tokens")
    limit, matching.BROADCAST_BYTES = matching.BROADCAST_BYTES, 0
    many = rows(matching.normalized_lines(df), "item_ord", "norm_key", "norm_tokens")
    matching.BROADCAST_BYTES = limit
    assert few == many == want and len(want) == 6


def test_first_json(spark):
    said = {'a {"x": "} {", "y": {"z": 1}} b {"x": 2}': '{"x": "} {", "y": {"z": 1}}', '{"q": "a \\" } b"} }': '{"q": "a \\" } b"}', "none": None, "{ open": None, "": None, "é {} x": "{}"}
    for whole, want in said.items():
        assert value(spark, text.first_json(F.lit(whole))) == want
    assert value(spark, text.first_json(F.lit(None).cast("string"))) is None


def test_open_sessions(spark):
    minute = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    spans = [(0, 30), (10, 70), (29, 30), (30, 31), (65, None), (60 * 24 + 5, 60 * 24 + 6), (10, 10)]
    s = spark.createDataFrame([(minute(a), None if b is None else minute(b)) for a, b in spans], "started_at timestamp, ended_at timestamp")
    got = {r.hour: r.peak for r in review.open_sessions(s).collect()}
    assert got == {minute(0): 3, minute(60): 2, minute(60 * 24): 2}
    assert review.open_at(s, F.lit(minute(30)).cast("timestamp")).count() == 2
    assert review.open_sessions(s.limit(0)).count() == 0


def test_expected_changes_shuffle_changes_and_not_each_for_each_set(spark):
    forms = [("F", 1, "DELETE", "7", "DELETE", "a part", ""), ("F", 2, "SUBSTITUTE", "8", "9", "a part", "1"), ("F", 3, "ADD", "", "9", "a part", "2"), ("G", 4, "DELETE", "8", "DELETE", "a part", "")]
    forms = spark.createDataFrame(forms, "form string, change_ord int, kind string, actual string, proposed string, description string, qty_proposed string")
    codes = spark.createDataFrame([("F", "1NS"), ("F", "2NS"), ("F", "2NS"), ("G", "3NS"), ("H", "4NS")], "form string, sku string")
    boms = spark.createDataFrame([("1NS", "7", 2, "SECOND"), ("1NS", "7", 1, "CUP"), ("2NS", "8", 1, "LID"), ("0NS", "8", 1, "FIRST LID")], "sku string, item_number string, item_ord int, description string")
    got = checks.expected_changes(forms, codes, boms)
    # a set named twice has its rows twice, as it has in the join
    assert rows(got, "sku", "change_ord", "kind", "description", "old_description") == sorted([("1NS", 1, "REMOVE", "CUP", None), *[("2NS", 1, "REMOVE", "CUP", None)] * 2, ("1NS", 2, "SUBSTITUTE", "a part", "FIRST LID"), *[("2NS", 2, "SUBSTITUTE", "a part", "LID")] * 2, ("1NS", 3, "ADD", "a part", None), *[("2NS", 3, "ADD", "a part", None)] * 2, ("3NS", 4, "REMOVE", "FIRST LID", None)], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_changes_are_joined_to_lists_of_lines(spark):
    lines = [("1NS", 1, "500", 1.0, "10", True, ["-"]), ("1NS", 2, "500", 2.0, "20", True, ["DELETE"]), ("1NS", 3, "500", 3.0, "30", False, ["-"]), ("1NS", 4, "600", 4.0, " 40 ", True, ["700"]), ("1NS", 5, None, 5.0, "50", True, None)]
    lines = spark.createDataFrame(lines, "code string, item_ord int, item_number string, quantity double, oper_seq string, active boolean, redlines array<string>").withColumn("quantity", F.col("quantity").cast("decimal(18,6)"))
    forms = [("F", "1NS", 1, "MODIFY", "500", "500", "2", "20"), ("F", "1NS", 2, "MODIFY", "500", "500", "2", ""), ("F", "1NS", 3, "DELETE", "500", "DELETE", "", "20"), ("F", "1NS", 4, "DELETE", "500", "DELETE", "", ""), ("F", "1NS", 5, "ADD", "", "600", "4", "40"), ("F", "1NS", 6, "ADD", "", "700", "4", ""), ("F", "1NS", 7, "SUBSTITUTE", "600", "700", "4", ""), ("F", "9NS", 8, "ADD", None, "600", "1", "")]
    forms = spark.createDataFrame(forms, "form string, code string, change_ord int, kind string, actual string, proposed string, qty_proposed string, seq_proposed string")
    got = checks.change_applied(forms, lines)
    absent = "PCO_CHANGE_NOT_APPLIED"
    assert rows(got, "change_ord", "classification", "discrepancy", "line_ord") == [(1, "EXACT", None, 2), (2, "POTENTIAL", None, 1), (3, "POTENTIAL", None, 2), (4, "MISMATCH", absent, 1), (5, "EXACT", None, 4), (6, "POTENTIAL", None, None), (7, "POTENTIAL", None, 4), (8, "MISMATCH", absent, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3 and "form" not in " ".join(x for x in plan.splitlines() if "Aggregate" in x)
