import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import checks, layout, matching, terms
from lineweave.sources import tables
from lineweave.streaming import events as streams

NORMAL = {
    "Tape™ Strips, 3/4 in.": "TAPE STRIP 3 4IN",
    "GAUZE 4X4": "GAUZE 4 X 4",
    "Needle 22G x 1.50 in": "NEEDLE 22G X 1.50IN",
    "Syringe 5.0 mL": "SYRINGE 5ML",
    "ALCOHOL 70 %": "ALCOHOL 70%",
    "BANDAGE W/ CLIPS": "BANDAGE WITH CLIP",
    "BANDAGE W/O CLIPS": "BANDAGE WITHOUT CLIP",
    "Tubing ASSY.": "TUBING ASSEMBLY",
    "Boxes, Dishes, Glasses": "BOX DISH GLASS",
    "Batteries": "BATTERY",
    "LENS STATUS BUS": "LENS STATUS BUS",
    "ＦＵＬＬ Ｗｉｄｔｈ": "FULL WIDTH",
    "towel – blue": "TOWEL BLUE",
    "": "",
}


def test_normalisation(spark):
    df = spark.createDataFrame([(k,) for k in NORMAL] + [(None,)], "description string")
    got = {r.description: r.norm_text for r in text.normalize_column(df, "description").collect()}
    assert got == {**NORMAL, None: None}


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd ", max_size=30), st.text(alphabet="abcd ", max_size=30))
def test_lcs(a, b):
    assert text.lcs(a, b) == brute_lcs(a, b)


def test_lcs_in_catalyst(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(9))), "".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for _ in range(40)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.lcs_column(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [brute_lcs(r.a, r.b) for r in got]


def test_similarity():
    assert text.similarity(["TOWEL"], ["TOWEL", "BLUE"]) < 1
    assert text.similarity(["TOWEL", "BLUE"], ["BLUE", "TOWEL", "LARGE"]) == 1.0
    assert text.similarity([], ["A"]) == 0.0
    assert text.similarity(["KITTEN"], ["SITTING"]) == round(2 * 4 / 13, 4)


LINES = {
    "2 Each - Tape Strips (3 per)": ("2.000000", "EACH", "Tape Strips", 3, "per"),
    "1 Each - Gloves (1 pair)": ("1.000000", "EACH", "Gloves", 1, "pair"),
    "1 Each - ECG Electrodes, 3 per pouch": ("1.000000", "EACH", "ECG Electrodes", 3, "per"),
    "1,000 pcs: Swabs": ("1000.000000", "EACH", "Swabs", None, None),
    "4 – Gauze": ("4.000000", "EACH", "Gauze", None, None),
    "2 pairs - Socks (0 per)": ("2.000000", "PAIR", "Socks", None, None),
    "no quantity here": (None, None, "no quantity here", None, None),
}


def test_quantity_lines(spark):
    df = spark.createDataFrame([(k,) for k in LINES], "s string").withColumn("p", text.parse_label_line(F.col("s")))
    got = {r.s: (None if r.p.quantity is None else str(r.p.quantity), r.p.uom, r.p.description, r.p.sub_value, r.p.sub_kind) for r in df.collect()}
    assert got == LINES


def test_scalars(spark):
    one = spark.range(1)
    dates = {"1/2/09": datetime.date(2009, 1, 2), "12/31/69": datetime.date(1969, 12, 31), "12/31/2040": datetime.date(2040, 12, 31), "2020-02-30": None, "x": None}
    for s, want in dates.items():
        assert one.select(text.parse_date(F.lit(s))).first()[0] == want
    for s, want in {"1,000.50": "1000.5", "2.0000": "2", "x": "?", "100": "100"}.items():
        assert one.select(text.format_quantity(text.parse_decimal(F.lit(s)))).first()[0] == want
    for s, want in {"accept": ("ACCEPT", None, None), "OVERRIDE→EQUIVALENT": ("OVERRIDE", "EQUIVALENT", None), "override": (None, None, "override without class"), "maybe": (None, None, "unknown decision")}.items():
        assert tuple(one.select(text.parse_decision(F.lit(s)).alias("x")).first().x) == want
    for s, want in {'so {"verdict": "same_item", "confidence": 1.7}': ("SAME_ITEM", 1.0), "nothing": ("UNSURE", 0.0)}.items():
        assert tuple(one.select(text.parse_suggestion(F.lit(s)).alias("x")).first().x) == want
    for s, want in {"Ab1234NS": "Ab1234NS", " 3131910FNS": "3131910"}.items():
        assert one.select(text.family_of(F.lit(s))).first()[0] == want
    cat = lambda i, d, q: one.select(text.categorize(F.lit(i), F.lit(d), F.lit(q).cast("decimal(18,6)")).alias("x")).first().x.category
    assert [cat("1", "IFU LEAFLET", 1), cat("PK1", "wrap", 1), cat("1", "towel", None), cat("1", "towel", 0), cat("1", "LID, TRAY", 1)] == ["DOCUMENT", "PACKAGING", "PHYSICAL_COMPONENT", "UNKNOWN", "PACKAGING"]


def brute_greedy(cands):
    pairs, a_used, b_used = set(), set(), set()
    for c in sorted(cands, key=lambda c: (c["pair"], -c["level_rank"], -c["score"], c["a_ord"], c["b_ord"])):
        if c["weak"] or c["conflict"] or (c["pair"], c["a_ord"]) in a_used or (c["pair"], c["b_ord"]) in b_used:
            continue
        a_used.add((c["pair"], c["a_ord"]))
        b_used.add((c["pair"], c["b_ord"]))
        pairs.add((c["pair"], c["a_ord"], c["b_ord"]))
    return pairs


def test_greedy_equals_sequential(spark):
    rng = random.Random(7)
    cands = [{"pair": p, "a_ord": a, "b_ord": b, "level": "FUZZY", "level_rank": rng.choice([1, 2, 3]), "score": rng.choice([0.9, 0.95, 1.0]), "weak": rng.random() < 0.1, "conflict": rng.random() < 0.1, "confirm": False, "relationship_id": "r"} for p in range(40) for a in range(6) for b in range(6) if rng.random() < 0.6]
    got = {(r.pair, r.a_ord, r.b_ord) for r in matching.greedy_pairs(spark.createDataFrame(cands)).collect()}
    assert got == brute_greedy(cands)


WORDS = ["TOWEL", "GLOVE", "TAPE", "BLUE", "LARGE", "SMALL", "5ML", "10ML", "STERILE"]


@pytest.fixture
def sides(spark):
    rng = random.Random(3)
    line = lambda p, i: (p, i, str(rng.randrange(50)), f"{p}NS", " ".join(rng.sample(WORDS, rng.randrange(1, 4))), 1.0)
    schema = "pair long, item_ord int, item_number string, sku string, description string, confidence double"
    return [text.normalize_column(spark.createDataFrame([line(p, i) for p in range(8) for i in range(6)], schema), "description") for _ in "ab"]


def test_pruned_ladder_reports_the_same(sides):
    a, b = sides
    for_all, pruned = matching.ladder(a, b, prune=False), matching.ladder(a, b)
    seen = []
    for c in (for_all, pruned):
        pairs = matching.greedy_pairs(c)
        seen.append([sorted(map(tuple, x.collect()), key=repr) for x in (pairs.select("pair", "a_ord", "b_ord", "level"), matching.hints(c, pairs, "a"), matching.hints(c, pairs, "b"), matching.ambiguities(c, pairs))])
    assert seen[0] == seen[1]


def test_find_anywhere_is_whole(sides):
    """All pairs, also those that share no word, against brute force."""
    a, b = sides
    found = [(r.a_text, r.b_text) for r in matching.find_anywhere(a, b).collect()]
    words = lambda df: {r.norm_text: [t for t in r.norm_tokens if t not in text.STOPWORDS] for r in df.collect()}
    x, y = words(a), words(b)
    assert sorted(found) == sorted((p, q) for p in x for q in y if text.similarity(x[p], y[q]) >= 0.85)


def _texts(spark, said):
    rows = [(1, k, t) for k, t in enumerate(said)]
    return matching.normalized_lines(spark.createDataFrame(rows, "pair long, item_ord int, description string"))


def test_find_anywhere_without_a_common_word(spark):
    rng = random.Random(11)
    nouns = ["".join(rng.choices("ABCDEINORST", k=rng.randint(2, 14))) for _ in range(60)]
    change = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "X", "AB"]) + w[k + rng.randint(0, 1) :] or "Q"
    one = [*nouns, *(" ".join(rng.sample(nouns, rng.randint(2, 4))) for _ in range(120)), "AA AA AA", "A", "AB", "ABC"]
    two = [" ".join(change(w) for w in t.split()) for t in one for _ in range(2)] + ["A", "AC", "ABD", "AAAA AAA"]
    a, b = _texts(spark, one), _texts(spark, two)
    words = lambda df: {r.norm_text: [t for t in r.norm_tokens if t not in text.STOPWORDS] for r in df.collect() if r.norm_text}
    x, y = words(a), words(b)
    want = sorted((p, q) for p in x for q in y if text.similarity(x[p], y[q]) >= 0.85)
    assert sorted((r.a_text, r.b_text) for r in matching.find_anywhere(a, b).collect()) == want
    assert sum(not set(x[p]) & set(y[q]) for p, q in want) > 50


def test_blocks_of_a_large_pair(sides, monkeypatch):
    a, b = sides
    whole = sorted((r.pair, r.a_ord, r.b_ord, r.score) for r in matching.fuzzy_candidates(a, b).collect())
    monkeypatch.setattr(matching, "BLOCK", 2)
    assert whole and sorted((r.pair, r.a_ord, r.b_ord, r.score) for r in matching.fuzzy_candidates(a, b).collect()) == whole


def _candidates(spark, rows):
    return spark.createDataFrame([(p, i, j, r, float(s)) for p, i, j, r, s in rows], "pair long, a_ord int, b_ord int, level_rank int, score double").select("*", F.lit("FUZZY").alias("level"), F.lit(False).alias("confirm"), F.lit(None).cast("string").alias("relationship_id"), F.lit(False).alias("weak"), F.lit(False).alias("conflict"))


def _in_order(rows):
    """The ordered choice, one candidate after the other."""
    used, out = set(), []
    for p, i, j, r, s in sorted(rows, key=lambda c: (c[0], -c[3], -c[4], c[1], c[2])):
        if ("a", p, i) not in used and ("b", p, j) not in used:
            used |= {("a", p, i), ("b", p, j)}
            out.append((p, i, j))
    return sorted(out)


def test_classes_of_alike_lines(spark):
    """Classes of equal lines, of which some share a score, against the ordered choice."""
    rng = random.Random(4)
    rows = set()
    for p in range(25):
        kinds_a, kinds_b = [rng.randint(0, 3) for _ in range(rng.randint(1, 14))], [rng.randint(0, 3) for _ in range(rng.randint(1, 14))]
        score = {(x, y): rng.choice([0, 0, 0.9, 0.9, 0.95, 1]) for x in range(4) for y in range(4)}
        rows |= {(p, i, j, 1, score[x, y]) for i, x in enumerate(kinds_a) for j, y in enumerate(kinds_b) if score[x, y]}
    got = matching.greedy_pairs(_candidates(spark, sorted(rows))).collect()
    assert sorted((r.pair, r.a_ord, r.b_ord) for r in got) == _in_order(rows)


def test_many_equal_lines_in_few_rounds(spark, monkeypatch):
    """300 equal lines against 200, and 120 near-equal ones that would take the same: paired off without the fold."""
    from lineweave.operators import matching as m

    cuts = []
    plain = m.cut
    monkeypatch.setattr(m, "cut", lambda df, label: cuts.append(label) or plain(df, label))
    rows = [(1, i, j, 1, 0.95 if i < 300 else 0.9) for i in range(420) for j in range(350 if i >= 300 else 200)]
    got = m.greedy_pairs(_candidates(spark, rows)).collect()
    assert sorted((r.pair, r.a_ord, r.b_ord) for r in got) == _in_order(rows)
    assert cuts.count("mutual") < m.ROUNDS


def test_terms(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("REL-001", 1, "A", ["x"], "global", True, False, at(1)), ("REL-001", 2, "A2", ["x"], "global", True, False, at(5)), ("REL-002", 1, "B", [], "global", True, True, at(2)), ("REL-003", 1, "C", [], "global", False, False, at(3))]
    v = spark.createDataFrame(rows, "id string, version int, canonical string, aliases array<string>, scope string, active boolean, deleted boolean, changed_at timestamp")
    assert sorted((r.id, r.version) for r in terms.current(v).collect()) == [("REL-001", 2), ("REL-003", 1)]
    runs = spark.createDataFrame([("r", at(4))], "run_id string, started_at timestamp")
    assert sorted((r.id, r.version) for r in terms.as_of(v, runs).collect()) == [("REL-001", 1), ("REL-003", 1)]
    new = terms.append_versions(v, v.where("id = 'REL-001' and version = 1").drop("version"))
    assert new.first().version == 3
    want = v.where("version = 1").drop("version", "changed_at").unionByName(v.where("id = 'REL-003'").drop("version", "changed_at").withColumn("id", F.lit("REL-009")))
    assert {r.id: r.action for r in terms.sync_defaults(want, v).collect()} == {"REL-001": "leave edited", "REL-002": "leave deleted", "REL-003": "same", "REL-009": "add"}
    assert terms.next_number(v).first().next == 4 and terms.snapshot(v).first().n == 2


def test_policies(spark):
    a = spark.createDataFrame([(1, 1, "1", "1NS", "FOAM WRAP", None, "EA", "PACKAGING", 1.0), (1, 2, "2", "1NS", "TOWEL", 2.0, "EA", "PHYSICAL_COMPONENT", 0.5)], "pair long, item_ord int, item_number string, sku string, description string, quantity double, uom string, category string, confidence double")
    b = spark.createDataFrame([(1, 1, "TOWELS", 2.0, "EACH", None, None, False, 1.0), (1, 2, "POUCH", None, None, None, None, True, 1.0)], "pair long, item_ord int, description string, quantity double, uom string, sub_value int, sub_kind string, conditional boolean, confidence double")
    rows = {(r.a_ord, r.b_ord): r for r in checks.pairing_check(a, b, checks.BOM_DRAWING).collect()}
    assert rows[1, None].role == "exempt" and rows[None, 2].role == "exempt"
    assert rows[2, 1].classification == "EXACT" and [d.type for d in rows[2, 1].discrepancies] == ["LOW_EXTRACTION_CONFIDENCE"]
    assert checks.recommended_action(F.lit("QTY_MISMATCH")) is not None


def test_layout(spark):
    w = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, "b", 50.0, 2.0, 60.0, 12.0), (1, 1, "c", 0.0, 20.0, 10.0, 30.0), (1, 1, "note", 0.0, 40.0, 10.0, 50.0)], "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([(1, 1, -1.0, 39.0, 20.0, 60.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    lined = layout.group_lines(layout.outside_boxes(w, box))
    assert {r.line: r.text for r in layout.line_texts(lined).collect()} == {1: "a b", 2: "c"}
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 10.0, "x"), (1, 1, 3.0, 12.0, 50.0, 22.0, "y"), (1, 1, 200.0, 12.0, 250.0, 22.0, "z"), (1, 1, 0.0, 60.0, 50.0, 70.0, "w")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r.text: r.callout for r in layout.callout_clusters(lines).collect()}
    assert got["x"] == got["y"] and len(set(got.values())) == 3
    reg = spark.createDataFrame([(1, 1, k, t, 12.0 * k + (100 if k > 4 else 0), 12.0 * k + 10 + (100 if k > 4 else 0)) for k, t in enumerate(["REF", "Contents", "a", "b", "c", "far"])], "doc_id long, page int, line int, text string, y0 double, y1 double")
    assert [r.text for r in layout.region(reg, F.col("text") == "Contents", F.col("text") == "END").orderBy("line").collect()] == ["a", "b", "c"]


def test_sources(spark, tmp_path):
    for name in ("a_old.pdf", "sub/b_new.csv", "~$x.xlsx", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.path.split("/")[-1]: r.role for r in tables.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a_old.pdf": "old", "b_new.csv": "new"}
    lines = spark.createDataFrame([(1, "x.csv", 1, "Component Item"), (2, "my-label.pdf", 1, "zz"), (3, "q.pdf", 1, "zz"), (4, "x.csv", 1, "Affected Codes"), (4, "x.csv", 2, "item number")], "doc long, path string, ord int, text string")
    assert {r.doc: r.doc_type for r in tables.detect_type(lines).collect()} == {1: "BOM", 2: "LABEL", 3: None, 4: "PCO"}
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    assert tables.fingerprint(df, ["k"]).orderBy("k").collect() == tables.fingerprint(df.orderBy(F.desc("id")), ["k"]).orderBy("k").collect()


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(400).coalesce(1)
    src = str(tmp_path / "in")
    events.where("event_id % 2 = 0").write.parquet(src)
    events.where("event_id % 2 = 1").write.mode("append").parquet(src)
    stream = lambda: streams.read_events(spark, src, events.schema, 10)
    both = [("w", streams.window_counts), ("s", lambda e: streams.sessions(e, "30 minutes"))]
    for name, f in both:
        got = streams.run_available(f(stream()), str(tmp_path / name), str(tmp_path / f"{name}-c"))
        late = {tuple(map(str, r)) for r in f(events).collect()} - {tuple(map(str, r)) for r in got.collect()}
        assert got.count() > 0 and not {tuple(map(str, r)) for r in got.collect()} - {tuple(map(str, r)) for r in f(events).collect()} and len(late) < 0.5 * f(events).count()
    streams.upsert_latest(streams.read_events(spark, src, events.schema), str(tmp_path / "up"), str(tmp_path / "up-c"), ["user_id"]).awaitTermination()
    last = streams.latest_table(spark, str(tmp_path / "up"), events.schema)
    assert {r.user_id: r.event_id for r in last.collect()} == {r.user_id: r.x for r in events.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("x")).collect()}
