"""Steps whose work must grow no faster than their tables, by what their plans and inputs are."""

import json
import random
import time

from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import checks, layout, matching
from lineweave.plans import catalog, fixtures, flows
from lineweave.sources import pages

SF = "/root/testdata/sf0.001"


def plan_of(df, stage="executedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString().split("== Initial Plan ==")[-1]


def test_words_meet_bands_once(spark):
    words = spark.createDataFrame([(1, 1, k, x, x + 10.0) for k, x in enumerate((0.0, 45.0, 95.0, 500.0))] + [(2, 1, 0, 0.0, 1.0)], "doc_id long, page int, word_id long, x0 double, x1 double")
    bands = spark.createDataFrame([(1, 1, "b", 60.0, 100.0, 2), (1, 1, "a", 0.0, 40.0, 1)], "doc_id long, page int, name string, b0 double, b1 double, band int")
    named = layout.nearest_band(words, bands)
    assert {r.word_id: r.name for r in named.collect()} == {0: "a", 1: "a", 2: "b", 3: "b"}  # the first of equals; a page without bands has no words
    plan = plan_of(named)
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_words_meet_lines_unsorted(spark):
    words = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 1, 2.0, 12.0), (1, 1, 20.0, 30.0)], "doc_id long, page int, y0 double, y1 double")
    lined = layout.group_lines(words)
    assert sorted(r.line for r in lined.collect()) == [1, 1, 2]
    assert "ShuffledHashJoin" in plan_of(lined)


def test_find_anywhere_is_given_texts(spark, monkeypatch):
    given = []
    monkeypatch.setattr(matching, "find_anywhere", lambda a, b: given.extend((a, b)))
    catalog.find_anywhere(spark, SF)
    for x in given:
        assert x.count() == x.select("description").distinct().count() > 0


def _first_object(s):
    depth, said, escaped, first = 0, False, False, None
    for i, ch in enumerate(s):
        if depth == 0:
            if ch == "{":
                depth, first = 1, i
        elif escaped:
            escaped = False
        elif said:
            said, escaped = ch != '"', ch == "\\"
        elif ch == '"':
            said = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return s[first : i + 1]
    return None


def test_json_is_folded_once_over_pieces(spark):
    rng = random.Random(7)
    said = ["".join(rng.choice('{}"\\a😀\n ') for _ in range(rng.randrange(24))) for _ in range(3000)] + ["", "x", '😀 {"a": "}"} y']
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert all(r.x == _first_object(r.s) for r in df.select("s", text.first_json(F.col("s")).alias("x")).collect())
    assert sum(_first_object(s) is not None for s in said) > 100
    whole = json.dumps({"verdict": "same_item", "confidence": 0.5, "note": 'a } "'})
    assert tuple(spark.range(1).select(text.parse_suggestion(F.lit("so " + whole)).alias("x")).first().x) == ("SAME_ITEM", 0.5)
    plan = plan_of(df.select(text.parse_suggestion(F.col("s")).alias("x")), "optimizedPlan")
    assert plan.count("aggregate(") == 1


def test_contested_lines_give_all_ambiguities(spark):
    rng = random.Random(3)
    lines = lambda: spark.createDataFrame([(p, k, rng.choice("xyz") + rng.choice("12") if k % 5 else "") for p in range(20) for k in range(1, 8)], "pair long, item_ord int, norm_key string")
    one = spark.createDataFrame([(99, 1, "q")], "pair long, item_ord int, norm_key string")
    a, b = lines().unionByName(one), lines().unionByName(one)
    found = lambda x, y: sorted(map(str, matching.ambiguities(matching.first_rung(matching.exact_candidates(x, y)), matching.exact_pairs(x, y)).collect()))
    own = matching.contested(a, b)
    assert found(*own) == found(a, b) != []
    assert own[0].where("pair = 99").isEmpty() and own[1].where("pair = 99 or norm_key = ''").isEmpty()  # no choice there


def test_residue_is_narrow_and_whole(spark):
    a, b = catalog._residue(spark, SF)
    assert not {"sku", "oper_seq", "uom", "raw_line"} & {*a.columns, *b.columns}  # no later step reads these
    x, y = catalog._sides(spark, SF, "label_fuzzy")
    taken = {(r.pair, r.a_ord, r.b_ord) for r in matching.exact_pairs(x, y).collect()}
    for rest, whole, used in ((a, x, {t[:2] for t in taken}), (b, y, {t[::2] for t in taken})):
        said = lambda df: {(r.pair, r.item_ord): (r.norm_text, r.norm_key, tuple(r.norm_numbers)) for r in df.collect()}
        assert said(rest) == {k: v for k, v in said(whole).items() if k not in used} and taken


def test_words_of_a_page_are_shuffled_once(spark):
    words = [(1, 1, "b", 50.0, 2.0, 60.0, 12.0), (1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, "c", 0.0, 20.0, 10.0, 30.0), (2, 1, "d", 5.0, 7.0, 9.0, 11.0), (2, 1, "lost", 5.0, None, 9.0, None)]
    lines = pages.page_lines(spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double"))
    plan = plan_of(lines)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted((r.doc_id, r.line, r.text, r.x0, r.y0, r.x1, r.y1) for r in lines.where("line > 0").collect()) == [(1, 1, "a b", 0.0, 0.0, 60.0, 12.0), (1, 2, "c", 0.0, 20.0, 10.0, 30.0), (2, 1, "d", 5.0, 7.0, 9.0, 11.0)]
    assert [(r.text, r.y0) for r in lines.where("line = 0").collect()] == [("lost", None)]  # a word without a place is no line's


def test_slices_of_a_stream_are_parted_in_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x

    rows = spark.range(4000).select(F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 60).alias("ts"), seen.asNondeterministic()("id").alias("event_id"))
    for repeated in (False, True):
        read.value, ran = 0, []
        flows._in_batches(spark, rows, "ts", lambda folder, schema, where, files, most: ran.append((files, spark.read.schema(schema).parquet(folder))), repeated)
        assert read.value <= 2 * 4000  # for the bounds and for the slices, not once per slice
        assert [files for files, _ in ran] == [1, 1]
        got = [r.event_id for r in ran[-1][1].where("event_id is not null").collect()]
        assert set(got) == set(range(4000)) and (len(got) > 4000) == repeated


def test_a_slice_has_as_many_files_as_said(spark, tmp_path):
    for k, n in enumerate((30_000, 5, 0)):
        flows._write_slice(spark.range(n), n, 3, f"{tmp_path}/{k}")
        assert len([*(tmp_path / str(k)).glob("*.parquet")]) == 3 and spark.read.parquet(f"{tmp_path}/{k}").count() == n


def test_state_has_no_more_partitions_than_rows_fill(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        for rows, parts in ((1000, spark.sparkContext.defaultParallelism), (20 * flows.STATE_ROWS, 20), (10_000 * flows.STATE_ROWS, 600)):
            with flows._state_parts(spark, rows):
                assert int(spark.conf.get("spark.sql.shuffle.partitions")) == parts
            assert spark.conf.get("spark.sql.shuffle.partitions") == "600"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_of_the_ladder_need_no_candidates(spark, monkeypatch):
    rng = random.Random(5)
    said = lambda: rng.choice(["BOLT STEEL", "STEEL BOLT", "BOLTS STEEL", "BOLT STEELY", "CLAMP", "CLAMPS RED", "NUT", "THE OF", "-"]) + rng.choice(["", " 5MM", " 6 MM"])
    lines = lambda: spark.createDataFrame([(p, k, f"I{rng.randrange(4)}", f"{p}NS", said() if k % 6 else None) for p in range(30) for k in range(1, 9)], "pair long, item_ord int, item_number string, sku string, description string")
    a, b = (text.normalize_column(x, "description").localCheckpoint() for x in (lines(), lines().drop("item_number", "sku")))
    rel = [("R1", "CLAMP", ["NUT 5MM"], "global", ["I1"], True), ("R2", "BOLT STEEL", ["NUT", "CLAMP RED"], "sku:3NS", [], True), ("R3", "NUT 6MM", ["BOLT STEEL"], "global", [], False)]
    schema = "id string, canonical string, aliases array<string>, scope string, item_anchors array<string>, active boolean"
    found = lambda df: sorted((r.pair, r.a_ord, r.b_ord, r.level, r.score, r.confirm, str(r.relationship_id)) for r in df.collect())
    for terms in (None, spark.createDataFrame(rel, schema), spark.createDataFrame([(*r[:4], [], r[5]) for r in rel], schema)):
        want = found(matching.greedy_pairs(matching.ladder(a, b, terms=terms)))
        assert found(matching.ladder_pairs(a, b, terms=terms)) == want and {w[3] for w in want} >= {"EXACT", "FUZZY"}
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 0)  # keys are many
    assert found(matching.ladder_pairs(a, b, terms=terms)) == want


def test_ladder_levels_joins_parts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fixtures, "table", lambda s, d, name, own=fixtures.table: seen.append(name) or own(s, d, name))
    monkeypatch.setattr(matching, "ladder_pairs", lambda a, b, terms: b.withColumns({"a_ord": F.lit(1), "b_ord": F.lit(1), "level": F.lit(""), "score": F.lit(1.0)}))
    catalog.ladder_levels(spark, SF)
    assert seen.count("lineitem") == 1


def test_callouts_are_placed_once_per_fragment(spark):
    n = 300  # fragments side by side on a page, each a callout of its own: what is bound per page or fragment must not be computed per callout
    words = spark.createDataFrame([(d, 1, f"W{k}", k * 100.0, float(k % 7), k * 100.0 + 4.0, k % 7 + 8.0) for d in range(2) for k in range(n)], "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    own = pages.clusters(pages.fragments_of(words))
    plan = plan_of(own)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    began = time.time()
    assert own.groupBy("doc_id").agg(F.count_distinct("callout").alias("n")).orderBy("doc_id").collect() == [(0, n), (1, n)]
    assert time.time() - began < 30  # computed per callout, as before, it takes many minutes


def test_headers_are_read_in_the_row_of_their_page(spark):
    words = [(d, p, t, x, y, x + 9.0, y + 8.0) for d in (1, 2) for p in (1, 2) for t, x, y in (("Level", 0.0, 0.0), ("Component", 20.0, 0.0), ("Item", 40.0, 0.0), ("Component", 60.0, 0.0), ("Description", 80.0, 0.0), ("1", 0.0, 20.0), ("A1", 22.0, 20.0), ("RING", 60.0, 20.0), ("RED", 85.0, 20.0), ("x", 30.0, 40.0))]
    ruled = pages.print_pages(spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double"))
    plan = plan_of(ruled)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    rows = pages.print_rows(ruled)
    assert sorted((r.doc_id, r.page, r.row, r.level, r.component_item, r.component_description) for r in rows.collect()) == [(d, p, p, "1", "A1", "RING RED") for d in (1, 2) for p in (1, 2)]


def test_forms_are_not_parted_into_cells_and_put_together(spark):
    words = [(1, 1, t, x, y, x + 9.0, y + 8.0) for t, x, y in (("Affected", 0.0, 0.0), ("Item", 50.0, 0.0), ("Item", 100.0, 0.0), ("Description", 150.0, 0.0), ("CODE1", 0.0, 20.0), ("a", 50.0, 20.0), ("b", 100.0, 20.0))]
    _, changes, _ = pages.change_form(spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert "Aggregate" not in plan_of(changes) and [(r.row, r.item_actual, r.item_proposed, r.kind) for r in changes.collect()] == [(1, "a", "b", "SUBSTITUTE")]


def test_expected_changes_are_counted_unlisted(spark):
    rng = random.Random(11)
    kinds = ("DELETE", "ADD", "SUBSTITUTE", "MODIFY", None)
    changes = spark.createDataFrame([(f, k, rng.choice(kinds), rng.choice(["1", "2", "3", "PK9", "", None]), rng.choice(["4", "DELETE", "", None]), "a part", "1") for f in (1, 2, 3, 4, None) for k in range(12)], "form int, change_ord int, kind string, actual string, proposed string, description string, qty_proposed string")
    codes = spark.createDataFrame([(f, f"S{rng.randrange(5)}") for f in (1, 2, 3, 5, None) for _ in range(6)] + [(1, None)], "form int, sku string")
    boms = spark.createDataFrame([(f"S{rng.randrange(6)}", rng.choice(["1", "2", "3", "4", None]), k, rng.choice(["bolt", None])) for k in range(25)] + [("S0", "PK9", 1, "z")], "sku string, item_number string, item_ord int, description string")
    for b in (boms, boms.where("description is not null")):
        x = checks.expected_changes(changes, codes, b)
        want = x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sku").alias("sets"), F.count("old_description").alias("named"))
        got = checks.expected_change_counts(changes, codes, b)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns


def test_parts_alone_are_read_by_several_tasks(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("b").alias("p_brand"), F.lit(3).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    own = fixtures.fixture(spark, str(tmp_path), "callouts_fx")
    assert own.rdd.getNumPartitions() == 3 and own.count() == 50_000
