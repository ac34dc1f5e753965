"""Review state, masking, timing, action items, run comparison and review queues over result tables.

results: run_id, row_id, sku, check, role, classification, level, score, discrepancies, requires_validation, comparison_key;
decisions: run_id, row_id, slot, reviewer, decision, override, decided_at, blind; finals: run_id, row_id, final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.checks import SEVERITIES, worst_severity

ROW = ["run_id", "row_id"]
#: Seconds between opening a row and deciding on it that count as work on it.
LEAST_S, MOST_S = 5, 900


def latest(events: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The last event of each key; ties go to the largest of the other columns named."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("x")).select(*keys, "x.*")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return latest(decisions, [*ROW, "slot"], "decided_at", "decision")


def decision_pivot(decisions: DataFrame) -> DataFrame:
    """One row per result row: what each of the two reviewers decided last."""
    own = latest_decisions(decisions)
    side = lambda k: F.max_by(F.struct("decision", "override"), F.when(F.col("slot") == k, F.col("decided_at")))
    return own.groupBy(*ROW).agg(side(1).alias("x"), side(2).alias("y")).select(*ROW, F.col("x.decision").alias("d1"), F.col("x.override").alias("o1"), F.col("y.decision").alias("d2"), F.col("y.override").alias("o2"))


def row_state(results: DataFrame, decisions: DataFrame, finals: DataFrame) -> DataFrame:
    """FINALIZED, AGREED, DISAGREEMENT, REVIEWER_1_COMPLETE, REVIEWER_2_COMPLETE or ENGINE_RECOMMENDED, and the classification that counts."""
    x = results.join(decision_pivot(decisions), ROW, "left").join(finals, ROW, "left")
    same = (F.col("d1") == F.col("d2")) & F.col("o1").eqNullSafe(F.col("o2"))
    both = F.col("d1").isNotNull() & F.col("d2").isNotNull()
    state = F.when(F.col("final").isNotNull(), "FINALIZED").when(both & same, "AGREED").when(both, "DISAGREEMENT").when(F.col("d1").isNotNull(), "REVIEWER_1_COMPLETE").when(F.col("d2").isNotNull(), "REVIEWER_2_COMPLETE").otherwise("ENGINE_RECOMMENDED")
    own = lambda k: F.when(F.col(f"d{k}") == "OVERRIDE", F.col(f"o{k}"))
    return x.withColumns({"state": state, "effective": F.coalesce(own(2), own(1), F.col("classification"))})


def blind_for(slot: Column, required: Column, asked: Column) -> Column:
    """Reviewer 1 is never blind; reviewer 2 is if required, else as asked, by default yes."""
    return F.when(slot == 1, F.lit(False)).when(required, F.lit(True)).otherwise(F.coalesce(asked, F.lit(True)))


def blind_view(states: DataFrame, slot: int, blind: bool) -> DataFrame:
    """row_state() as a reviewer may see it: a blind second reviewer sees nothing of a row before deciding on it.

    The mask is part of the view, so filters and counts on it can't tell what is hidden.
    """
    hidden = F.lit(blind and slot == 2) & F.col("d2").isNull()
    show = lambda c, otherwise=None: F.when(hidden, F.lit(otherwise)).otherwise(F.col(c)).alias(c)
    masked = {"d1", "o1", "final"}
    return states.select(*[show(c) if c in masked else show(c, "ENGINE_RECOMMENDED") if c == "state" else F.when(hidden, F.col("classification")).otherwise(F.col(c)).alias(c) if c == "effective" else F.col(c) for c in states.columns])


def review_seconds(opened: DataFrame, decided: DataFrame, keys: list[str], most: int = MOST_S) -> DataFrame:
    """Seconds from the last opening of a row by a reviewer to each decision, where plausible. opened: keys, ts; decided: keys, ts, decision."""
    events = opened.select(*keys, "ts", F.lit(None).cast("string").alias("decision")).unionByName(decided.select(*keys, "ts", "decision"))
    before = Window.partitionBy(*keys).orderBy("ts", F.col("decision").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("opened_at", F.last(F.when(F.col("decision").isNull(), F.col("ts")), ignorenulls=True).over(before)).where("decision is not null")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / 1_000_000
    return x.select(*keys, F.col("ts").alias("decided_at"), "decision", F.when(seconds.between(LEAST_S, most), F.round(seconds, 3)).alias("seconds"))


def timing(seconds: DataFrame, by: list[str]) -> DataFrame:
    """Samples, exact median and mean of plausible times."""
    out = seconds.where("seconds is not null").groupBy(*by)
    return out.agg(F.count(F.lit(1)).alias("samples"), F.round(F.percentile("seconds", 0.5), 1).alias("median_s"), F.round(F.avg("seconds"), 1).alias("mean_s"))


def bulk_accept(results: DataFrame, decisions: DataFrame, slot: int) -> DataFrame:
    """Rows that need no validation and on which the reviewer hasn't decided."""
    return results.where("not requires_validation").join(decisions.where(F.col("slot") == slot).select(*ROW), ROW, "left_anti").select(*ROW)


def import_decisions(rows: DataFrame, results: DataFrame, decisions: DataFrame, finals: DataFrame, slot: int, force: bool = False) -> DataFrame:
    """What each row of an edited export would do. rows: run_id, row_id, decision, override, error, exported_at."""
    now = latest_decisions(decisions).where(F.col("slot") == slot).select(*ROW, F.col("decision").alias("now"), F.col("override").alias("now_override"), "decided_at")
    known = results.select(*ROW).distinct().withColumn("known", F.lit(True))
    x = rows.join(known, ROW, "left").join(now, ROW, "left").join(finals.select(*ROW, F.lit(True).alias("done")), ROW, "left")
    same = (F.col("decision") == F.col("now")) & F.col("override").eqNullSafe(F.col("now_override"))
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("error").isNotNull(), "invalid").when(F.col("done"), "finalized").when(same, "unchanged").when((F.col("decided_at") > F.col("exported_at")) & ~F.lit(force), "conflict").otherwise("applied")
    return x.select(*ROW, status.alias("status"))


def open_discrepancies(results: DataFrame) -> DataFrame:
    """Per type of discrepancy how many, and the worst severity; the worst first."""
    d = results.select(F.explode("discrepancies").alias("d"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("d.severity"))
    return d.groupBy(F.col("d.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min(rank).cast("int").alias("rank")).withColumn("worst", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank")))


def queue_order() -> list[Column]:
    """Severity, ambiguous, potential, low confidence, set, row."""
    has = lambda kind: ~F.exists("discrepancies", lambda d: d["type"] == kind)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), worst_severity(F.col("discrepancies"))), F.lit(9))
    return [rank, has("AMBIGUOUS_MATCH"), F.col("classification") != "POTENTIAL", has("LOW_EXTRACTION_CONFIDENCE"), F.col("sku"), F.col("row_id")]


def queue(results: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the review queue."""
    return results.orderBy(*queue_order()).offset(offset).limit(limit)


def _findings(results: DataFrame) -> DataFrame:
    by = Window.partitionBy("comparison_key").orderBy("row_id")
    kinds = F.array_join(F.transform("discrepancies", lambda d: d["type"]), ",")
    return results.where("role <> 'exempt'").select("comparison_key", "sku", "check", F.row_number().over(by).alias("k"), kinds.alias("kinds"), "classification", "requires_validation")


#: What may have become of a comparison, in the order of a report.
STATUSES = ("resolved", "new", "still_open", "changed", "unchanged", "gone", "not_covered")


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every comparison of two runs, aligned by key and occurrence, with what became of it; a finding of any severity counts."""
    sets = before.select("sku").intersect(after.select("sku")).withColumn("covered", F.lit(True))
    side = lambda df, s: _findings(df).select("comparison_key", "k", *[F.col(c).alias(f"{s}_{c}") for c in ("sku", "check", "kinds", "classification", "requires_validation")], F.lit(True).alias(f"{s}_in"))
    x = side(before, "b").join(side(after, "a"), ["comparison_key", "k"], "full_outer").withColumns({"sku": F.coalesce("b_sku", "a_sku"), "check": F.coalesce("b_check", "a_check")})
    x = x.join(sets, "sku", "left")
    had, has = F.coalesce(F.col("b_kinds") != "", F.lit(False)), F.coalesce(F.col("a_kinds") != "", F.lit(False))
    there, here = F.col("b_in").isNotNull(), F.col("a_in").isNotNull()
    differs = ~(F.col("b_classification").eqNullSafe(F.col("a_classification")) & F.col("b_requires_validation").eqNullSafe(F.col("a_requires_validation")))
    status = F.when(F.col("covered").isNull(), "not_covered").when(there & ~here, "gone").when(~there & has, "new").when(~there, "changed").when(had & ~has, "resolved").when(~had & has, "new").when(had & has, "still_open").when(differs, "changed").otherwise("unchanged")
    x = x.withColumn("status", status)
    arrow = F.concat("b_classification", F.lit(" to "), "a_classification")
    note = (
        F.when((F.col("status") == "gone") & had, "the comparison no longer exists; it was not verified as fixed")
        .when(F.col("status") == "gone", "the comparison no longer exists")
        .when((F.col("status") == "changed") & ~there, "a new comparison with no discrepancy")
        .when(F.col("status") == "changed", arrow)
        .when((F.col("status") == "still_open") & (F.col("b_kinds") != F.col("a_kinds")), "still reported (different discrepancy type)")
        .when(F.col("status") == "still_open", "still reported")
        .otherwise("")
    )
    return x.select("sku", "check", "comparison_key", "k", "b_kinds", "a_kinds", "status", note.alias("note"))


def diff_order(diff: DataFrame) -> DataFrame:
    """In the order of a report: status, set, check, comparison."""
    return diff.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), "sku", "check", "comparison_key", "k")


def first_of_status(diff: DataFrame, n: int) -> DataFrame:
    """The first n rows of each status."""
    return diff.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy("sku", "check", "comparison_key", "k"))).where(F.col("place") <= n)


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sets of two runs: added, removed or common."""
    x = before.select("sku").distinct().withColumn("b", F.lit(True)).join(after.select("sku").distinct().withColumn("a", F.lit(True)), "sku", "full_outer")
    return x.select("sku", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("common").alias("status"))


def document_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents by path: added, removed, changed or same. Each: path, sha."""
    x = before.select("path", F.col("sha").alias("b")).join(after.select("path", F.col("sha").alias("a")), "path", "full_outer")
    return x.select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("status"))


def verify_and_close(items: DataFrame, run: DataFrame) -> DataFrame:
    """Open action items against a new run: resolved where their set is covered and their comparison has no finding."""
    real = run.select("comparison_key", F.exists("discrepancies", lambda d: d["severity"] != "INFO").alias("bad")).groupBy("comparison_key").agg(F.bool_or("bad").alias("bad"))
    covered = run.select("sku").distinct().withColumn("covered", F.lit(True))
    x = items.where("status = 'OPEN'").join(covered, "sku", "left").join(real, "comparison_key", "left")
    status = F.when(F.col("covered").isNull(), "NOT_COVERED").when(F.coalesce("bad", F.lit(False)), "STILL_OPEN").otherwise("RESOLVED")
    return x.select("item_id", "sku", "comparison_key", status.alias("outcome"))


def action_items(results: DataFrame) -> DataFrame:
    """The finding that an action item of a row is about: the first that isn't INFO, else the first."""
    real = F.filter("discrepancies", lambda d: d["severity"] != "INFO")
    pick = F.coalesce(F.try_element_at(real, F.lit(1)), F.try_element_at(F.col("discrepancies"), F.lit(1)))
    return results.where(F.size("discrepancies") > 0).select("row_id", "sku", "comparison_key", pick["type"].alias("type"), pick["severity"].alias("severity"))


# --- summaries ------------------------------------------------------------------------------------


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group of rows; blockers count findings."""
    item = F.col("role") != "exempt"
    cls = lambda c: F.count_if(item & (F.col("classification") == c)).alias(c.lower())
    blockers = F.sum(F.size(F.filter("discrepancies", lambda d: d["severity"] == "BLOCKER"))).cast("long")
    return results.groupBy(*by).agg(*map(cls, ("EXACT", "EQUIVALENT", "POTENTIAL", "MISMATCH", "MISSING")), F.count_if("requires_validation").alias("needs_validation"), F.count_if(item & ~F.col("requires_validation")).alias("cleared"), F.count_if(~item).alias("exempt"), blockers.alias("blockers"))


def set_rollup(results: DataFrame) -> DataFrame:
    """A row per set and one for all (sku null), with its status."""
    item = F.col("role") != "exempt"
    blockers = F.sum(F.size(F.filter("discrepancies", lambda d: d["severity"] == "BLOCKER"))).cast("long")
    x = results.rollup("sku").agg(F.count_if(item).alias("rows"), F.count_if("requires_validation").alias("needs_validation"), blockers.alias("blockers"), F.grouping("sku").alias("total"))
    status = F.when(F.col("blockers") > 0, "BLOCKED").when(F.col("needs_validation") > 0, "NEEDS REVIEW").when(F.col("rows") > 0, "AUTO-CLEARED").otherwise("NOT CHECKED")
    return x.withColumn("status", status)


def mining(results: DataFrame, known: DataFrame | None = None, rejected: DataFrame | None = None, least_sets: int = 2, decisions: DataFrame | None = None) -> DataFrame:
    """Repeated similar pairings that a synonym would clear. results: also a_key, b_key; known, rejected: a_key, b_key.

    A row with any finding would still need review. decisions (run_id, row_id, slot, decision, override) tell how often
    reviewers confirmed or contradicted a pairing. Item numbers of A are listed as anchors, checks by name; a pairing's
    lists are of distinct values.
    """
    x = results.where("level = 'FUZZY' and a_key is not null and b_key is not null")
    for no in (known, rejected):
        x = x if no is None else x.join(no.select("a_key", "b_key").distinct(), ["a_key", "b_key"], "left_anti")
    clear = F.size("discrepancies") == 0
    lists = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (("check", "checks"), ("item_number", "item_anchors")) if c in x.columns]
    if decisions is not None:
        yes = (F.col("decision") == "ACCEPT") | ((F.col("decision") == "OVERRIDE") & F.col("override").isin("EQUIVALENT", "EXACT"))
        no = (F.col("decision") == "CONFIRM_DISCREPANCY") | ((F.col("decision") == "OVERRIDE") & F.col("override").isin("MISMATCH", "MISSING"))
        n = latest_decisions(decisions).groupBy(*ROW).agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no"))
        x = x.join(n, ROW, "left")
        lists += [F.coalesce(F.sum("yes"), F.lit(0)).alias("confirmed"), F.coalesce(F.sum("no"), F.lit(0)).alias("contradicted")]
    out = x.groupBy("a_key", "b_key").agg(F.count_distinct("sku").alias("sets"), F.count(F.lit(1)).alias("rows"), F.count_if(clear).alias("would_clear"), F.count_if(~clear).alias("still_review"), *lists)
    return out.where(F.col("sets") >= least_sets)


def suggestion_order(suggestions: DataFrame) -> DataFrame:
    return suggestions.orderBy(F.desc("sets"), F.desc("confirmed"), "contradicted", "a_key", "b_key")


def top_share(work: DataFrame, n: int, needs: int) -> DataFrame:
    """How many rows the first n of a worklist clear, and their share, in per cent, of the rows that need validation."""
    rows = F.coalesce(F.sum(F.when(F.col("rank") <= n, F.col("would_clear"))), F.lit(0))
    return work.agg(F.count_if(F.col("rank") <= n).alias("n"), rows.alias("rows"), F.round(100.0 * rows / needs, 1).alias("pct") if needs else F.lit(0.0).alias("pct"))


def worklist(suggestions: DataFrame) -> DataFrame:
    """Suggestions by how many rows they clear, with the running share of all that could be cleared.

    Suggestions are aggregates of distinct text pairs; ranks within ranges of would_clear are summed from totals per value,
    so that the running total passes a row per distinct count, not all of them, through one task.
    """
    totals = suggestions.groupBy("would_clear").agg(F.sum("would_clear").alias("s"), F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("would_clear").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    base = totals.select("would_clear", F.coalesce(F.sum("s").over(above), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("first"), F.sum("s").over(every).alias("all"))
    inside = F.row_number().over(Window.partitionBy("would_clear").orderBy(F.col("sets").desc(), "a_key", "b_key"))
    x = suggestions.withColumn("k", inside).join(base, "would_clear")
    running = F.col("base") + F.col("k") * F.col("would_clear")
    return x.select((F.col("first") + F.col("k")).alias("rank"), "a_key", "b_key", "sets", "would_clear", running.alias("running"), F.round(running / F.col("all"), 4).alias("share"))


def business_case(results: DataFrame, *, per_check: float = 3.0, per_cleared: float = 0.25, baseline_per_row: float = 1.0, rate: float = 60.0, sets_per_project: int = 20, reviewers: int = 2, projects: int = 12, measured: DataFrame | None = None) -> DataFrame:
    """Minutes per set with and without the checks, saving, reduction, hours per project and yearly value, from row counts.

    Rows that a confirmation would clear (POTENTIAL, no finding, score of .95 or more) give the projection. measured: one row
    of timing(); its median, from ten samples on, replaces the assumed minutes per check.
    """
    item = F.col("role") != "exempt"
    confirmable = F.col("requires_validation") & (F.col("classification") == "POTENTIAL") & (F.size("discrepancies") == 0) & (F.col("score") >= 0.95)
    n = results.agg(F.count_distinct("sku").alias("sets"), F.count_if("requires_validation").alias("needs"), F.count_if(item & ~F.col("requires_validation")).alias("cleared"), F.count_if(confirmable).alias("confirmable"))
    each, basis = F.lit(per_check), F.lit("assumed")
    if measured is not None:
        n = n.join(measured.select("samples", "median_s").limit(1), how="left")  # one row with one row
        enough = F.coalesce(F.col("samples") >= 10, F.lit(False))
        each, basis = F.when(enough, F.round(F.col("median_s") / 60, 2)).otherwise(per_check), F.when(enough, "measured").otherwise("assumed")
    spent = lambda needs, cleared: (needs * each + cleared * per_cleared) / F.col("sets")
    minutes = spent(F.col("needs"), F.col("cleared"))
    later = spent(F.col("needs") - F.col("confirmable"), F.col("cleared") + F.col("confirmable"))
    baseline = (F.col("needs") + F.col("cleared")) * baseline_per_row / F.col("sets")
    hours = F.round((baseline - minutes) * sets_per_project * reviewers / 60, 1)
    reduction = lambda m: F.when(baseline > 0, F.round(100 * (baseline - m) / baseline, 1)).otherwise(0.0)
    return n.select("sets", "needs", "cleared", "confirmable", basis.alias("basis"), F.round(minutes, 2).alias("minutes"), F.round(baseline, 2).alias("baseline"), reduction(minutes).alias("reduction"), F.round(later, 2).alias("projected"), reduction(later).alias("projected_reduction"), hours.alias("hours"), F.round(hours * rate * projects, 0).alias("yearly"))


# --- decisions, finals, items, audit ----------------------------------------------------------------

#: Decisions and classifications.
DECISIONS = ("ACCEPT", "CONFIRM_DISCREPANCY", "NEEDS_MORE_INFORMATION", "OVERRIDE")
CLASSES = ("EXACT", "EQUIVALENT", "POTENTIAL", "MISMATCH", "MISSING")


def checked_decisions(decisions: DataFrame) -> DataFrame:
    """Adds error: null where a decision may be recorded. An override names a class; others' classes are dropped."""
    error = (
        F.when(~F.coalesce(F.col("slot").isin(1, 2), F.lit(False)), "reviewer slot must be 1 or 2")
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
        .when((F.col("decision") == "OVERRIDE") & ~F.coalesce(F.col("override").isin(*CLASSES), F.lit(False)), "OVERRIDE requires a classification")
    )
    return decisions.withColumns({"error": error, "override": F.when(F.col("decision") == "OVERRIDE", F.col("override"))})


def latest_finals(finals: DataFrame) -> DataFrame:
    """The last final decision of each row, of those with a known decision. finals: run_id, row_id, final, finalized_by, finalized_at."""
    return latest(finals.where(F.col("final").isin(*DECISIONS)), ROW, "finalized_at", "final")


def history(results: DataFrame, decisions: DataFrame, finals: DataFrame) -> DataFrame:
    """What happened to each row, in order: the engine, reviewer 1, reviewer 2, the final decision."""
    last = latest_decisions(decisions)
    engine = results.select(*ROW, F.lit(0).alias("step"), F.lit("engine").alias("event"), F.col("classification").alias("said"))
    said = F.concat_ws(":", "decision", "override")
    seen = last.select(*ROW, F.col("slot").cast("int").alias("step"), F.concat(F.lit("reviewer_"), "slot").alias("event"), said.alias("said"))
    return engine.unionByName(seen).unionByName(finals.select(*ROW, F.lit(3).alias("step"), F.lit("final").alias("event"), F.col("final").alias("said")))


def state_counts(view: DataFrame) -> DataFrame:
    """Rows per state, of a view as a reviewer may see it."""
    return view.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def certificate(results: DataFrame, states: DataFrame, decisions: DataFrame, items: DataFrame, first: int = 8) -> DataFrame:
    """Facts of a set's certificate: rows, decided, finalised and disputed ones, reviewers, decisions by kind, blind ones, the
    last decision, and open action items, the first `first` of them by id."""
    own = latest_decisions(decisions).join(results.select(*ROW, "sku"), ROW)
    kinds = [F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS]
    d = own.groupBy("sku").agg(F.array_sort(F.collect_set("reviewer")).alias("reviewers"), F.count(F.lit(1)).alias("decisions"), *kinds, F.count_if("blind").alias("blind"), F.max("decided_at").alias("last_decision"))
    s = states.groupBy("sku").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("state") == "FINALIZED").alias("finalized"), F.count_if(F.col("state") == "DISAGREEMENT").alias("disagreements"))
    open_ = items.where("status = 'OPEN'").withColumn("place", F.row_number().over(Window.partitionBy("sku").orderBy("item_id")))
    i = open_.groupBy("sku").agg(F.count(F.lit(1)).alias("open_items"), F.array_sort(F.collect_list(F.when(F.col("place") <= first, F.col("item_id")))).alias("first_items"))  # `first` ids of a set
    return s.join(d, "sku", "left").join(i, "sku", "left").na.fill(0, ["decisions", *[x.lower() for x in DECISIONS], "blind", "open_items"])


def item_states(events: DataFrame) -> DataFrame:
    """The state of each action item after its last update. events: item_id, at, status, owner."""
    return latest(events, ["item_id"], "at", "status")


def audit_counts(audit: DataFrame) -> DataFrame:
    """Events per actor and action. audit: at, actor, action."""
    return audit.groupBy("actor", "action").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))


def newest(events: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The n newest events."""
    return events.orderBy(F.desc(at), *map(F.desc, ties)).limit(n)


def locked_until(failures: DataFrame, most: int = 5, minutes: int = 15) -> DataFrame:
    """Until when an actor is locked out: `most` failures in a row lock for so many minutes from the last one. failures: actor, at, ok."""
    order = Window.partitionBy("actor").orderBy("at")
    runs = failures.withColumn("run", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = runs.where("not ok").groupBy("actor", "run").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    return n.where(F.col("n") >= most).groupBy("actor").agg(F.max(F.col("last") + F.make_interval(mins=F.lit(minutes))).alias("locked_until"))


def open_sessions(sessions: DataFrame) -> DataFrame:
    """The most sessions open at once in each hour in which one starts or ends. sessions: started_at, ended_at (null: still open).

    A session counts from its start to before its end. Starts and ends are added up per instant, then per minute, so sums run
    over a minute's instants and over minutes, never over all events.
    """
    starts = sessions.select(F.col("started_at").cast("timestamp").alias("at"), F.lit(1).alias("d"))
    ends = sessions.where("ended_at is not null").select(F.col("ended_at").cast("timestamp").alias("at"), F.lit(-1).alias("d"))
    each = starts.unionByName(ends).groupBy("at").agg(F.sum("d").alias("d")).withColumn("minute", F.date_trunc("minute", "at"))
    running = F.sum("d").over(Window.partitionBy("minute").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    minutes = each.withColumn("running", running).groupBy("minute").agg(F.sum("d").alias("d"), F.max("running").alias("most"))
    # two more steps of sums: of a day's minutes, and of days, of which there are few
    day = F.date_trunc("day", "minute")
    in_day = F.coalesce(F.sum("d").over(Window.partitionBy(day).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = minutes.groupBy(day.alias("day")).agg(F.sum("d").alias("d")).select("day", F.coalesce(F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = minutes.withColumns({"in_day": in_day, "day": day}).join(F.broadcast(days), "day").withColumn("open", F.col("before") + F.col("in_day"))
    peak = F.max(F.greatest(F.col("open"), F.col("open") + F.col("most"))).alias("peak")
    return placed.groupBy(F.date_trunc("hour", "minute").alias("hour")).agg(peak)


def open_at(sessions: DataFrame, at: Column) -> DataFrame:
    """The sessions that are open at an instant."""
    return sessions.where((F.col("started_at") <= at) & (F.col("ended_at").isNull() | (F.col("ended_at") > at)))
