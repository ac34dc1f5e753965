"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: emails, IP addresses, card and phone numbers by their forms. Each text is scanned once; matches and what stands
   between them come from splitting the text, so positions are sums of lengths.
2. Candidates: other runs of identifier characters with DIGITS digits or more that touch no seed.
3. Patterns: two words to the left of a seed or candidate, the word on either side, two words to the right. Each distinct
   value in each distinct pattern is one edge of a graph, however many copies of the passage there are.
4. Rounds: a pattern's confidence for a kind is the sum of its values' scores over their number plus PRIOR; a value's score is
   1 for a seed, else one minus the product of what its patterns of PATTERN confidence or more leave open. Patterns found in
   one round score values for the next.
5. Candidates whose score for one kind is ACCEPT or more are spans of kind `context_<kind>`, wherever they stand.

Patterns and scores are few beside the texts; they are sent to all tasks up to SENT rows, and joined beyond. All tables that
are read twice are written to the shared folder.

Edge cases: a null or empty text has no spans; a very long text is scanned whole, by expressions that look at each character
a bounded number of times; repeated rows, also without doc_id, each have their row, but a value in a pattern counts once; of
two kinds with one score the first listed is taken; without seeds, or with an empty table, nothing is added; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The kinds' forms, each so written that no character is looked at from many starts: a match may begin only where its run does,
#: or where the last one ended. Of cards, those with 12 to 19 digits.
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OTHER = "A-Za-z@._+-"
#: What goes from both ends of a candidate.
_MARKS = "._@-"
DIGITS, LEAST_CHARS = 4, 6
CANDIDATE = rf"(?<![0-9{_OTHER}])(?=(?:[{_OTHER}]*+[0-9]){{{DIGITS}}})[0-9{_OTHER}]++"
#: Characters next to a match in which its words are looked for.
NEAR = 80
ROUNDS = 3
PRIOR = 2.0
PATTERN, ACCEPT = 0.7, 0.7
#: Rows up to which patterns or scores are sent to all tasks; a row has 300 bytes at most.
SENT = 100_000

_N = len(KINDS)


def _pieces(text: Column, form: str) -> Column:
    """Of each match: characters before it since the last one, what stands there, and itself; at the end a row without a match."""
    parts = F.arrays_zip(F.split(text, form, -1).alias("a"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("m"))
    near = lambda x: F.struct(F.length(x["a"]).cast("long").alias("gap"), F.substring(x["a"], -NEAR, NEAR).alias("tail"), F.substring(x["a"], 1, NEAR).alias("head"), x["m"].alias("m"))
    return F.when(text.rlike(form), F.transform(parts, near))


def scanned(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document, numbered `nth`, with the pieces of each kind's matches and of candidates."""
    t = F.col("text")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("nth", F.monotonically_increasing_id())
    return rows.select("nth", "doc_id", *[_pieces(t, f).alias(f"k{k}") for k, f in enumerate((*FORMS.values(), CANDIDATE))])


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a form is what it looks like."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    figures = F.transform(F.split(F.reverse(digits), ""), lambda x, i: _doubled(x.try_cast("int"), i))
    luhn = F.aggregate(figures, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0
    small = F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(256)) <= 255)
    return F.when(kind == 1, small).when(kind == 2, luhn).when(kind == 3, F.length(digits).between(9, 15)).otherwise(True)


def _doubled(x: Column, i: Column) -> Column:
    twice = x * 2
    return F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def _words(text: Column) -> Column:
    """Lower-case words with figures as 0, none for an empty text."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"\s+"), lambda x: x != "")


def occurrences(found: DataFrame) -> DataFrame:
    """nth, kind (a place in KINDS, or their number for a candidate), first and last character + 1, value and contexts of valid matches."""
    each = reduce(DataFrame.unionByName, [found.where(F.col(f"k{k}").isNotNull()).select("nth", F.lit(k).alias("kind"), F.posexplode(f"k{k}").alias("at", "x")) for k in range(_N + 1)])
    by = Window.partitionBy("nth", "kind").orderBy("at")
    size = F.coalesce(F.length("x.m"), F.lit(0)).cast("long")
    placed = each.select("nth", "kind", "x", (F.sum(F.col("x.gap") + size).over(by)).alias("end"), F.lead("x.head").over(by).alias("right")).where("x.m is not null")
    m, candidate = F.col("x.m"), F.col("kind") == _N
    bare = F.when(candidate, F.rtrim(m, F.lit(_MARKS))).otherwise(m)
    value = F.when(candidate, F.ltrim(bare, F.lit(_MARKS))).otherwise(m)
    start = F.col("end") - F.length(m) + F.length(bare) - F.length(value)
    rows = placed.where(_valid(F.col("kind"), m)).select("nth", "kind", start.alias("start"), (F.col("end") - F.length(m) + F.length(bare)).alias("end"), value.alias("value"), F.col("x.tail").alias("left"), "right")
    # a candidate that touches a seed is none
    order = Window.partitionBy("nth").orderBy("start", "kind")
    seed_end, seed_start = F.when(F.col("kind") < _N, F.col("end")), F.when(F.col("kind") < _N, F.col("start"))
    before = F.max(seed_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(seed_start).over(Window.partitionBy("nth").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))
    alone = (F.length("value") >= LEAST_CHARS) & (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = rows.withColumn("kept", (F.col("kind") < _N) | alone).where("kept")
    return kept.select("nth", "kind", "start", "end", F.xxhash64("value").alias("v"), F.xxhash64(F.lit(1), "value").alias("w"), F.slice(F.reverse(_words(F.col("left"))), 1, 2).alias("left"), F.slice(_words(F.col("right")), 1, 2).alias("right"))


def edges(seen: DataFrame) -> DataFrame:
    """The distinct (pattern, value): pattern, v, w (the value's hashes) and kind."""
    l1, l2, r1, r2 = F.get("left", 0), F.get("left", 1), F.get("right", 0), F.get("right", 1)
    said = [F.concat(F.lit("L "), l2, F.lit(" "), l1), F.concat(F.lit("B "), l1, F.lit(" "), r1), F.concat(F.lit("R "), r1, F.lit(" "), r2)]  # null if a word is missing
    each = seen.select("v", "w", "kind", F.explode(F.array_compact(F.array(*said))).alias("pattern"))
    # a value that is a seed somewhere is one everywhere, of the kind listed first
    return each.groupBy("pattern", "v", "w").agg(F.min("kind").alias("kind"))


def _sent(table: DataFrame, label: str, most: int) -> DataFrame:
    kept = common.cut(table, label)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def _score(name: str, k: int) -> Column:
    return F.col(f"{name}{k}")


def scored(graph: DataFrame, *, rounds: int = ROUNDS, prior: float = PRIOR, pattern: float = PATTERN, sent: int = SENT) -> DataFrame:
    """v, w and s0, s1, ... of the candidates that a confident pattern of some kind has: their score for each kind."""
    known: DataFrame | None = None
    for turn in range(rounds):
        rows = graph if known is None else graph.join(known, ["v", "w"], "left")
        own = [F.when(F.col("kind") == k, 1.0).when(F.col("kind") < _N, 0.0).otherwise(F.lit(0.0) if known is None else F.coalesce(_score("s", k), F.lit(0.0))) for k in range(_N)]
        sums = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"c{k}") for k, x in enumerate(own)])
        sure = [F.when(F.col(f"c{k}") / (F.col("n") + prior) >= pattern, F.col(f"c{k}") / (F.col("n") + prior)).otherwise(0.0).alias(f"c{k}") for k in range(_N)]
        confident = sums.select("pattern", *sure).where(F.greatest(*[_score("c", k) for k in range(_N)]) > 0)
        confident = _sent(confident, f"pii-patterns-{turn}", sent)
        left_open = graph.where(F.col("kind") == _N).join(confident, "pattern").groupBy("v", "w")
        known = left_open.agg(*[(1 - F.exp(F.sum(F.log(1 - _score("c", k))))).alias(f"s{k}") for k in range(_N)])
        known = _sent(known, f"pii-values-{turn}", sent)
    return known


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, prior: float = PRIOR, pattern: float = PATTERN, accept: float = ACCEPT, sent: int = SENT) -> tuple[DataFrame, DataFrame]:
    """The documents, numbered `nth`, and the spans of each: nth, kind, start, end; kinds from len(KINDS) on are those found by context."""
    found = common.cut(scanned(docs, key=key, text=text), "pii-scan")
    seen = common.cut(occurrences(found), "pii-seen")
    graph = common.cut(edges(seen), "pii-graph")
    known = scored(graph, rounds=rounds, prior=prior, pattern=pattern, sent=sent)
    best = F.greatest(*[_score("s", k) for k in range(_N)])
    first = reduce(lambda rest, k: F.when(_score("s", k) == best, F.lit(k)).otherwise(rest), reversed(range(_N)), F.lit(None).cast("int"))
    taken = known.where(best >= accept).select("v", "w", (first + _N).alias("found"))
    added = seen.where(F.col("kind") == _N).join(_sent(taken, "pii-found", sent), ["v", "w"]).select("nth", F.col("found").alias("kind"), "start", "end")
    return found.select("nth", "doc_id"), seen.where(F.col("kind") < _N).select("nth", "kind", "start", "end").unionByName(added)


def digests(docs: DataFrame, **settings: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document, and how many were found by context."""
    rows, found = spans(docs, **settings)
    names = F.array(*[F.lit(x) for x in (*KINDS, *(f"context_{x}" for x in KINDS))])
    of = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    by_doc = found.groupBy("nth").agg(of.alias("found"))
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    own = rows.join(by_doc, "nth", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:long,kind:int,end:long>>")))
    return own.select(
        "doc_id", *[count(k).alias(f"n_{x}") for k, x in enumerate(KINDS)], F.sha2(written(F.filter("found", lambda s: s["kind"] < _N)), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"] >= _N)).cast("long").alias("n_context"),
    )
