"""Candidates, the match ladder and one-to-one assignment, for all pairs of documents in one plan.

Tables of lines have pair (the pair of documents compared), item_ord (a line's place in its document, unique there),
description and the columns that normalize_column() adds; side A's table may also have item_number, sku and doc_types.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.sources.scratch import SMALL_ROWS, cut


@dataclass(frozen=True)
class Thresholds:
    potential: float = 0.85
    floor: float = 0.60
    ambiguity_delta: float = 0.05
    low_confidence: float = 0.70
    semantic: float = 0.85


LEVELS = {"EXACT": 3, "RELATIONSHIP": 2, "FUZZY": 1, "SEMANTIC": 1, "SUGGESTION": 1}
CANDIDATE = ("pair", "a_ord", "b_ord", "level", "level_rank", "score", "weak", "conflict", "confirm", "relationship_id")


#: Bytes of a table of distinct texts up to which it is sent to all tasks.
BROADCAST_BYTES = 16 << 20


def normalized_lines(lines: DataFrame, said: str = "description", written: bool = False) -> DataFrame:
    """The lines, written as a table unless they come from one, with the columns of normalize_column().

    Texts repeat, so each distinct one is normalised once and sent to the lines, which aren't shuffled, if those texts are
    few; many are normalised in place.
    """
    own = lines if written else cut(lines, "lines")
    kinds = cut(text.normalize_column(own.select(said).distinct().where(F.col(said).isNotNull()), said), "texts")
    if (kinds.agg(F.sum(4 * F.octet_length(said) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        return own.join(F.broadcast(kinds), said, "left").select(*own.columns, *[c for c in kinds.columns if c != said])
    return cut(text.normalize_column(own, said), "lines")


def _sides(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    left = a.select(*[F.col(c).alias(f"a_{c}" if c not in on else c) for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}" if c not in on else c) for c in b.columns])
    return left, right


def _outcome(df: DataFrame, level: str, score: Column, weak=None, conflict=None, confirm=None, relationship=None) -> DataFrame:
    no = F.lit(False)
    return df.select(
        "pair", F.col("a_item_ord").alias("a_ord"), F.col("b_item_ord").alias("b_ord"), F.lit(level).alias("level"), F.lit(LEVELS[level]).alias("level_rank"), score.alias("score"),
        (no if weak is None else weak).alias("weak"), (no if conflict is None else conflict).alias("conflict"), (no if confirm is None else confirm).alias("confirm"),
        (F.lit(None).cast("string") if relationship is None else relationship).alias("relationship_id"),
    )


def exact_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of a pair with the same words in any order."""
    left, right = _sides(a, b, ["pair", "norm_key"])
    return _outcome(left.where("norm_key <> ''").join(right, ["pair", "norm_key"]), "EXACT", F.lit(1.0))


def exact_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the assignment makes of exact candidates alone: of each key the k-th line of A with the k-th of B."""
    k = F.row_number().over(Window.partitionBy("pair", "norm_key").orderBy("item_ord"))
    side = lambda df, s: df.where("norm_key <> ''").select("pair", "norm_key", F.col("item_ord").alias(f"{s}_ord"), k.alias("k"))
    both = side(a, "a").join(side(b, "b"), ["pair", "norm_key", "k"])
    return both.select("pair", "a_ord", "b_ord", F.lit(LEVELS["EXACT"]).alias("level_rank"), F.lit(1.0).alias("score"), F.lit("EXACT").alias("level"), F.lit(False).alias("confirm"), F.lit(None).cast("string").alias("relationship_id"))


def exact_lines(a: DataFrame, b: DataFrame, of_a: list[str], of_b: list[str]) -> DataFrame:
    """What exact candidates alone make of all lines, by one shuffle: pair, a, b (structs of the columns named, null where a line has no partner), n_a, n_b.

    Of each key the k-th line of A goes with the k-th of B, as in exact_pairs(); every line of a key is a candidate of all n_a or
    n_b of the other side's, so no candidate need be listed. Lines without words are alone.
    """
    own = lambda s: F.when(F.col("norm_key") != "", F.col("norm_key")).otherwise(F.concat(F.lit(f"\0{s}"), F.col("item_ord").cast("string"))).alias("key")
    side = lambda df, s, cols: df.select("pair", own(s), "item_ord", F.struct(*cols).alias(s))
    key = Window.partitionBy("pair", "key")
    x = side(a, "a", of_a).unionByName(side(b, "b", of_b), allowMissingColumns=True).withColumns({"n_a": F.count("a").over(key), "n_b": F.count("b").over(key)})
    place = F.row_number().over(key.orderBy(F.col("a").isNull(), "item_ord"))  # those of A come first
    x = x.withColumn("k", F.when(F.col("a").isNull(), place - F.col("n_a")).otherwise(place))
    one = lambda s: F.first(s, ignorenulls=True).alias(s)  # noqa: E731  there is one at most
    return x.groupBy("pair", "key", "k").agg(one("a"), one("b"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")).drop("key", "k")


def contested(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (pair, norm_key, item_ord) of A and of B that exact candidates leave a choice: those of keys of both sides of which one has several."""
    side = lambda df, s: df.where("norm_key <> ''").select("pair", "norm_key", "item_ord", F.lit(s).alias("side"))
    key = Window.partitionBy("pair", "norm_key")
    x = side(a, "a").unionByName(side(b, "b")).withColumns({f"n_{s}": F.count_if(F.col("side") == s).over(key) for s in "ab"})
    x = cut(x.where("n_a > 0 and n_b > 0 and n_a + n_b > 2").drop("n_a", "n_b"), "contested")
    return x.where("side = 'a'").drop("side"), x.where("side = 'b'").drop("side")


def term_keys(terms: DataFrame) -> DataFrame:
    """A row per active relationship and normalised term. terms: id, canonical, aliases, scope, item_anchors, doc_types, active."""
    words = terms.where("active").select("id", "scope", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array())))).alias("term"))
    return text.normalize_column(words, "term").select("id", "scope", F.col("norm_key").alias("term_key")).where("term_key <> ''").distinct()


def specificity(scope: Column, sku: Column) -> Column:
    """2 for the set itself, 1 for its family, 0 for all; null where the scope doesn't hold."""
    return F.when(scope == "global", 0).when(scope == F.concat(F.lit("family:"), text.family_of(sku)), 1).when(scope == F.concat(F.lit("sku:"), sku), 2)


def dictionary_candidates(a: DataFrame, b: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs whose both texts are terms of one relationship, or whose A number is anchored and B text a term; the most specific scope, then the smallest id.

    A relationship with doc_types holds only if these have the types of both sides; a column doc_types of A's lines (the two
    types of their pair, as an array) says which they are, and without it all hold.
    """
    keys = term_keys(terms)
    left, right = _sides(a, b, ["pair"])
    b_terms = right.join(keys, right["b_norm_key"] == keys["term_key"]).drop("term_key")
    by_term = left.join(keys.select(F.col("id").alias("a_id"), F.col("term_key").alias("a_key")), F.col("a_norm_key") == F.col("a_key")).join(b_terms, ["pair"]).where("a_id = id").withColumn("kind", F.lit(0))
    anchors = terms.where("active").select(F.col("id").alias("a_id"), F.explode("item_anchors").alias("a_key"))
    by_anchor = left.join(anchors, F.col("a_item_number") == F.col("a_key")).join(b_terms, ["pair"]).where("a_id = id").withColumn("kind", F.lit(1))
    spec = specificity(F.col("scope"), F.col("a_sku"))
    found = by_term.unionByName(by_anchor).withColumn("spec", spec).where("spec is not null")
    if "doc_types" in terms.columns and "doc_types" in a.columns:
        told = terms.select("id", F.coalesce("doc_types", F.array().cast("array<string>")).alias("_types"))
        found = found.join(told, "id").where((F.size("_types") == 0) | (F.size(F.array_except("a_doc_types", "_types")) == 0))
    best = found.groupBy("pair", "a_item_ord", "b_item_ord").agg(F.min(F.struct((-F.col("spec")).alias("s"), "id", "kind")).alias("x"))
    return _outcome(best, "RELATIONSHIP", F.lit(1.0), confirm=F.col("x.kind") == 1, relationship=F.col("x.id"))


def _bag(words: Column) -> Column:
    """Of the content words of a text, laid end to end: how many there are of each character of BAG and of others."""
    said = F.array_join(words, " ")
    each = [F.length(said) - F.length(F.replace(said, F.lit(c))) for c in BAG]
    return F.array(*each, F.length(said) - sum(each[1:], each[0]))


def _may_reach(least: float) -> Column:
    """Can texts a and b, by the characters that both have, be similar enough? Lengths are of distinct words, which the ratio takes at least."""
    common = F.aggregate(F.zip_with("a_bag", "b_bag", lambda p, q: F.least(p, q)), F.lit(0), lambda acc, v: acc + v)
    return 2.0 * common >= (least - 1e-4) * (F.col("a_chars") + F.col("b_chars"))


def _chars(words: Column) -> Column:
    return F.length(F.array_join(F.array_distinct(words), " "))


#: Characters counted one by one in the bound below; the others are one class.
BAG = " ETAIONSRLDC0123456789"


#: Texts of one side of a pair that a block has, about; a pair with more is compared block by block.
BLOCK = 2000


def _in_blocks(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the block of a pair in which a text of A meets one of B: A's parts times B's parts, each meeting once."""
    parts = lambda df, s: df.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias(f"{s}_parts"))
    both = cut(parts(x, "a").join(parts(y, "b"), "pair").where("a_parts > 1 or b_parts > 1"), "large-pairs")  # those alone need blocks
    both = F.broadcast(both) if both.count() <= SMALL_ROWS else both
    one = F.coalesce("a_parts", F.lit(1)), F.coalesce("b_parts", F.lit(1))
    own = lambda s, n: F.pmod(F.xxhash64(f"{s}_norm_text"), n).cast("int")
    left = x.join(both, "pair", "left").withColumn("a_block", F.explode(F.transform(F.sequence(F.lit(0), one[1] - 1), lambda k: own("a", one[0]) * one[1] + k)))
    right = y.join(both, "pair", "left").withColumn("b_block", F.explode(F.transform(F.sequence(F.lit(0), one[0] - 1), lambda k: k * one[1] + own("b", one[1]))))
    return left.drop("a_parts", "b_parts"), right.drop("a_parts", "b_parts")


def fuzzy_candidates(a: DataFrame, b: DataFrame, t: Thresholds = Thresholds(), sure: bool = False) -> DataFrame:
    """Similar pairs of a set; each distinct pair of texts is scored once. Below the floor none, below `potential` weak.

    Texts are compared once per set. Those that share no word are similar by characters alone, at most by those that both
    have: such pairs, if that bound is below the floor, are dropped in the join and never scored. sure: only those that can be
    assigned, neither weak nor of conflicting numbers, which the join drops too.
    """
    least = max(t.floor, t.potential) if sure else t.floor
    words = lambda side: text.content_tokens(text.split_tokens(F.col(f"{side}_norm_text")))
    left, right = _sides(a, b, ["pair"])
    left, right = left.where("a_norm_text <> ''"), right.where("b_norm_text <> ''")
    numbers = lambda s: {f"{s}_numbers": text.numbers(text.split_tokens(F.col(f"{s}_norm_text")))} if sure else {}
    kinds = lambda df, s: df.select("pair", f"{s}_norm_text").distinct().withColumns({f"{s}_words": words(s), f"{s}_bag": _bag(words(s)), f"{s}_chars": _chars(words(s))} | numbers(s))  # noqa: E731  only texts are shuffled
    x, y = kinds(left, "a"), kinds(right, "b")
    may = F.arrays_overlap("a_words", "b_words") | _may_reach(least)
    may = may & ~text.numeric_conflict(F.col("a_numbers"), F.col("b_numbers")) if sure else may
    x, y = _in_blocks(cut(x, "kinds"), cut(y, "kinds"))
    near = cut(x.join(y.withColumnRenamed("pair", "_p"), (F.col("pair") == F.col("_p")) & (F.col("a_block") == F.col("b_block")) & may).select("pair", "a_norm_text", "b_norm_text", "a_words", "b_words"), "near")
    distinct = near.dropDuplicates(["a_norm_text", "b_norm_text"])
    scored = distinct.select("a_norm_text", "b_norm_text", text.similarity_udf("a_words", "b_words").alias("score")).where(F.col("score") >= least)
    kept = near.select("pair", "a_norm_text", "b_norm_text").join(scored, ["a_norm_text", "b_norm_text"])
    found = left.join(kept, ["pair", "a_norm_text"]).join(right, ["pair", "b_norm_text"])
    return _outcome(found, "FUZZY", F.col("score"), weak=F.col("score") < t.potential, conflict=None if sure else text.numeric_conflict(F.col("a_norm_numbers"), F.col("b_norm_numbers")))


def semantic_candidates(a: DataFrame, b: DataFrame, vectors: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Pairs with close embeddings. vectors: norm_text, vector."""
    left, right = _sides(a, b, ["pair"])
    va, vb = (vectors.select(F.col("norm_text").alias(f"{s}_norm_text"), F.col("vector").alias(f"{s}_vector")) for s in "ab")
    found = left.join(va, "a_norm_text").join(right.join(vb, "b_norm_text"), "pair").withColumn("score", F.round(text.cosine(F.col("a_vector"), F.col("b_vector")), 4))
    return _outcome(found.where(F.col("score") >= t.semantic), "SEMANTIC", F.col("score"))


def suggested_candidates(a: DataFrame, b: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Pairs that an outside source called the same item; always weak. suggestions: a_text, b_text, verdict, confidence."""
    left, right = _sides(a, b, ["pair"])
    said = suggestions.where("verdict = 'SAME_ITEM'").select(F.col("a_text").alias("a_norm_text"), F.col("b_text").alias("b_norm_text"), F.round("confidence", 4).alias("score"))
    return _outcome(left.join(right, "pair").join(said, ["a_norm_text", "b_norm_text"]), "SUGGESTION", F.col("score"), weak=F.lit(True))


LADDER = ("EXACT", "RELATIONSHIP", "FUZZY", "SEMANTIC", "SUGGESTION")


def first_rung(*rungs: DataFrame) -> DataFrame:
    """Of each pair of lines the outcome of the first rung that answers; a weak fuzzy score stops later rungs too."""
    found = rungs[0]
    for r in rungs[1:]:
        found = found.unionByName(r)
    order = F.array_position(F.array(*map(F.lit, LADDER)), F.col("level"))
    rest = [c for c in CANDIDATE if c not in ("pair", "a_ord", "b_ord")]
    best = found.groupBy("pair", "a_ord", "b_ord").agg(F.min_by(F.struct(*rest), order).alias("x"))
    return best.select("pair", "a_ord", "b_ord", "x.*")


def ladder(a: DataFrame, b: DataFrame, *, terms: DataFrame | None = None, vectors: DataFrame | None = None, suggestions: DataFrame | None = None, t: Thresholds = Thresholds(), prune: bool = True) -> DataFrame:
    """All candidates of all pairs.

    prune: lines that exact and dictionary matches pair off are left out of fuzzy scoring where both sides of a pair of
    lines are taken; alternatives and hints never look below the level of a pair, so nothing that is reported changes.
    """
    sure = cut(first_rung(exact_candidates(a, b), *([dictionary_candidates(a, b, terms)] if terms is not None else [])), "sure")
    free_a, free_b = a, b
    if prune:
        taken = cut(greedy_pairs(sure), "taken")
        free_a = cut(a.join(taken.select("pair", F.col("a_ord").alias("item_ord")), ["pair", "item_ord"], "left_anti"), "free")
        free_b = b.join(taken.select("pair", F.col("b_ord").alias("item_ord")), ["pair", "item_ord"], "left_anti")
        held_a = a.join(taken.select("pair", F.col("a_ord").alias("item_ord")), ["pair", "item_ord"], "left_semi")
        near = fuzzy_candidates(free_a, b, t).unionByName(fuzzy_candidates(held_a, free_b, t))
    else:
        near = fuzzy_candidates(a, b, t)
    more = [semantic_candidates(a, b, vectors, t)] if vectors is not None else []
    more += [suggested_candidates(a, b, suggestions)] if suggestions is not None else []
    return first_rung(sure, near, *more)


def assignable(c: DataFrame) -> DataFrame:
    return c.where("not weak and not conflict")


#: Rounds of mutual best candidates before what is left, lines that are alike, is folded in order.
ROUNDS = 12


def _alike(rest: DataFrame) -> DataFrame:
    """What the ordered choice takes among lines that are alike: pair, a_ord, b_ord.

    Of a line's candidates those of its best (level, score) are looked at. A lines with the same set of them are a class; if
    those B lines have no others as their best than the class, the choice pairs the k-th with the k-th. Sets are told apart
    by their size and two hashes, so none is gathered.
    """
    x = rest.select("pair", "a_ord", "b_ord", F.struct((-F.col("level_rank")).alias("r"), (-F.col("score")).alias("s")).alias("tier"))
    best_a, best_b = (x.groupBy("pair", c).agg(F.min("tier").alias(n)) for c, n in (("a_ord", "of_a"), ("b_ord", "of_b")))
    top = cut(x.join(best_a, ["pair", "a_ord"]).join(best_b, ["pair", "b_ord"]).where("tier = of_a or tier = of_b"), "top")
    mine = top.where("tier = of_a")
    hashed = F.struct("of_a", F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("b_ord")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "b_ord")).alias("g"))
    told = cut(mine.groupBy("pair", "a_ord", "of_a").agg(hashed.alias("class")).select("pair", "a_ord", "class"), "classes")
    sizes = told.groupBy("pair", "class").agg(F.count(F.lit(1)).alias("lines"))
    degree = top.where("tier = of_b").groupBy("pair", "b_ord").agg(F.count(F.lit(1)).alias("degree"))
    each = mine.join(told, ["pair", "a_ord"]).join(degree, ["pair", "b_ord"], "left").groupBy("pair", "class", "b_ord").agg(F.bool_and(F.col("tier") == F.col("of_b")).alias("both"), F.max("degree").alias("degree"))
    each = cut(each.join(sizes, ["pair", "class"]), "class-lines")
    whole = each.groupBy("pair", "class").agg(F.bool_and(F.col("both") & (F.col("degree") == F.col("lines"))).alias("ok")).where("ok").select("pair", "class")
    k = lambda c: F.row_number().over(Window.partitionBy("pair", "class").orderBy(c)).alias("k")
    a = told.join(whole, ["pair", "class"]).select("pair", "class", "a_ord", k("a_ord"))
    b = each.select("pair", "class", "b_ord").join(whole, ["pair", "class"]).select("pair", "class", "b_ord", k("b_ord"))
    return a.join(b, ["pair", "class", "k"]).select("pair", "a_ord", "b_ord")


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs, the best (level, score, a, b) first.

    A candidate that is the best of both its lines is what the ordered choice would take, so rounds of these, each without
    the lines that are taken, end with the same pairs; every shuffle is by line, never by pair of documents. Rounds end when
    nothing is left. Lines that are alike are paired off together (_alike) in every third round, the k-th with the k-th; only
    what is left after ROUNDS of them is folded in order.
    """
    kept = ["pair", "a_ord", "b_ord", "level_rank", "score", "level", "confirm", "relationship_id"]
    rest = cut(assignable(candidates).select(*kept), "rest")
    key = F.struct((-F.col("level_rank")).alias("r"), (-F.col("score")).alias("s"), "a_ord", "b_ord")
    found = None
    for turn in range(ROUNDS):
        if rest.isEmpty():
            break
        of_a = rest.groupBy("pair", "a_ord").agg(F.min(key).alias("x")).select("pair", "a_ord", F.col("x.b_ord").alias("b_ord"))
        of_b = rest.groupBy("pair", "b_ord").agg(F.min(key).alias("y")).select("pair", F.col("y.a_ord").alias("a_ord"), "b_ord")
        taken = of_a.join(of_b, ["pair", "a_ord", "b_ord"])
        if turn % 3 == 2:
            taken = taken.unionByName(_alike(rest)).distinct()
        mutual = cut(rest.join(taken, ["pair", "a_ord", "b_ord"], "left_semi"), "mutual")
        found = mutual if found is None else found.unionByName(mutual)
        rest = cut(rest.join(mutual.select("pair", "a_ord"), ["pair", "a_ord"], "left_anti").join(mutual.select("pair", "b_ord"), ["pair", "b_ord"], "left_anti"), "rest")
    else:
        each = F.struct((-F.col("level_rank")).alias("r"), (-F.col("score")).alias("s"), *kept[1:])
        listed = rest.groupBy("pair").agg(F.array_sort(F.collect_list(each)).alias("c"))
        used = lambda taken, c: F.exists(taken, lambda x: (x["a_ord"] == c["a_ord"]) | (x["b_ord"] == c["b_ord"]))
        folded = listed.select("pair", F.explode(F.aggregate("c", F.filter("c", lambda x: F.lit(False)), lambda taken, c: F.when(used(taken, c), taken).otherwise(F.concat(taken, F.array(c))))).alias("x"))
        found = found.unionByName(folded.select("pair", *[f"x.{c}" for c in kept[1:]]))
    return rest if found is None else found


def _numbered(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The lines with a short number, as text, for each key, and the table of key_no and norm_key, if keys are few; else the lines as they are and none."""
    keys = cut(a.select("norm_key").unionByName(b.select("norm_key")).where("norm_key <> ''").distinct(), "keys")
    if (keys.agg(F.sum(4 * F.octet_length("norm_key") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        return a, b, None
    keys = cut(keys.select("norm_key", F.row_number().over(Window.orderBy("norm_key")).cast("string").alias("key_no")), "numbers")  # few, as checked
    own = lambda df: df.join(F.broadcast(keys), "norm_key", "left").withColumn("norm_key", F.coalesce("key_no", "norm_key")).drop("key_no")
    return own(a), own(b), keys


def ladder_pairs(a: DataFrame, b: DataFrame, *, terms: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """What greedy_pairs() makes of the candidates of ladder(), which aren't listed; where no alternatives or hints are asked for.

    Better levels are taken first, so each rung is asked only about the lines that those above leave: words alone pair most off
    in one shuffle, and similar lines are only looked for where they can be assigned. Of a text only its words count, so lines
    travel with their keys, numbered if they are few, and are told their words again after each shuffle.
    """
    anchored = terms is not None and not terms.where("active and size(item_anchors) > 0").isEmpty()
    of_a = ["item_ord", "norm_key", *[c for c in (*(["sku", "doc_types"] if terms is not None else []), *(["item_number"] if anchored else [])) if c in a.columns]]
    x, y, keys = _numbered(a, b)
    met = exact_lines(x, y, of_a, ["item_ord", "norm_key"])
    lone = lambda s, other: F.when(F.col(f"{other}.item_ord").isNull(), F.col(s)).alias(s)
    met = cut(met.select("pair", F.col("a.item_ord").alias("a_ord"), F.col("b.item_ord").alias("b_ord"), lone("a", "b"), lone("b", "a")), "met")
    found = met.where("a_ord is not null and b_ord is not null").select("pair", "a_ord", "b_ord", F.lit(LEVELS["EXACT"]).alias("level_rank"), F.lit(1.0).alias("score"), F.lit("EXACT").alias("level"), F.lit(False).alias("confirm"), F.lit(None).cast("string").alias("relationship_id"))
    free = {s: met.where(f"{s}_ord is not null and {o}_ord is null").select("pair", f"{s}.*") for s, o in ("ab", "ba")}

    def said(df: DataFrame) -> DataFrame:
        df = df if keys is None else df.withColumnRenamed("norm_key", "key_no").join(F.broadcast(keys), "key_no", "left").drop("key_no")
        return df.withColumns({"norm_text": F.col("norm_key"), "norm_numbers": text.numbers(text.split_tokens(F.col("norm_key")))})

    if terms is not None:
        own = said(free["a"]) if anchored else said(free["a"]).withColumn("item_number", F.lit(None).cast("string"))
        taken = greedy_pairs(dictionary_candidates(own, said(free["b"]), terms))
        found = found.unionByName(taken)
        free = {s: cut(df.select("pair", "item_ord", "norm_key").join(taken.select("pair", F.col(f"{s}_ord").alias("item_ord")), ["pair", "item_ord"], "left_anti"), "free") for s, df in free.items()}
    return found.unionByName(greedy_pairs(fuzzy_candidates(said(free["a"]), said(free["b"]), t, sure=True)))


def ambiguities(candidates: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """For a paired A line its other candidates of the level within the delta; for an unpaired one its best candidate and who holds it."""
    own = assignable(candidates).select("pair", "a_ord", "b_ord", "level_rank", "score")
    held = pairs.select("pair", "a_ord", F.col("b_ord").alias("own_b"), F.col("level_rank").alias("own_rank"), F.col("score").alias("own_score"))
    alternatives = own.join(held, ["pair", "a_ord"]).where((F.col("b_ord") != F.col("own_b")) & (F.col("level_rank") == F.col("own_rank")) & (F.col("score") >= F.col("own_score") - t.ambiguity_delta))
    alternatives = alternatives.select("pair", "a_ord", "b_ord", "score", F.lit("alternative").alias("kind"), F.lit(None).cast("long").alias("holder"))
    free = own.join(pairs.select("pair", "a_ord"), ["pair", "a_ord"], "left_anti")
    best = free.groupBy("pair", "a_ord").agg(F.max_by(F.struct("b_ord", "score"), F.struct("level_rank", "score", -F.col("b_ord"))).alias("x")).select("pair", "a_ord", "x.b_ord", "x.score")
    holders = pairs.select("pair", "b_ord", F.col("a_ord").cast("long").alias("holder"))
    return alternatives.unionByName(best.join(holders, ["pair", "b_ord"], "left").select("pair", "a_ord", "b_ord", "score", F.lit("best is taken").alias("kind"), "holder"))


def hints(candidates: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The nearest candidate, weak or conflicting ones too, of each line of a side that isn't paired; the first of equals."""
    own, other = f"{side}_ord", "b_ord" if side == "a" else "a_ord"
    free = candidates.join(pairs.select("pair", own), ["pair", own], "left_anti")
    best = free.groupBy("pair", own).agg(F.max_by(F.struct(other, "score", "weak", "conflict"), F.struct("level_rank", "score", -F.col(other))).alias("x"))
    return best.select("pair", F.col(own).alias("item_ord"), F.col(f"x.{other}").alias("hint_ord"), F.col("x.score").alias("hint_score"), F.col("x.weak").alias("hint_weak"), F.col("x.conflict").alias("hint_conflict"))


def find_anywhere(a: DataFrame, b: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Similar lines in any document: all pairs of distinct texts that score `potential` or more.

    Pairs that share a word: each text is filed under its words, and a pair is met once, at the first word in alphabetical
    order that both have; words that many texts have are parted, both sides dealt into square blocks, so no word is capped and
    none makes one large task. Before scoring, the bound by characters must reach `potential`. Equal word sets score 1, and so
    do two other texts of which one's words contain the other's.

    Pairs without a common word, which are similar by characters alone, are found by their rarest pairs of characters
    (gram_candidates).
    """
    kinds = lambda df: df.where("norm_text <> ''").select("norm_text", F.array_sort(F.array_distinct(text.content_tokens(F.col("norm_tokens")))).alias("w"), text.content_tokens(F.col("norm_tokens")).alias("words")).dropDuplicates(["norm_text"])
    x, y = (cut(kinds(df).withColumns({"bag": _bag(F.col("words")), "chars": _chars(F.col("words"))}), "kinds") for df in (a, b))
    many = cut(y.select(F.explode("w").alias("v")).groupBy("v").count(), "words")
    many = F.broadcast(many) if many.count() <= SMALL_ROWS else many
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("count") / 5000.0))).cast("int")
    filed = lambda df: df.withColumn("v", F.explode("w")).join(many, "v").withColumns({"k": F.pmod(F.xxhash64("norm_text"), side).cast("int"), "all": F.sequence(F.lit(0), side - 1)})
    left = filed(x).withColumns({"i": F.col("k"), "j": F.explode("all")}).select("v", "i", "j", F.col("norm_text").alias("a_text"), F.col("w").alias("aw"), F.col("words").alias("a_words"), F.col("bag").alias("a_bag"), F.col("chars").alias("a_chars"))
    right = filed(y).withColumns({"j": F.col("k"), "i": F.explode("all")}).select("v", "i", "j", F.col("norm_text").alias("b_text"), F.col("w").alias("bw"), F.col("words").alias("b_words"), F.col("bag").alias("b_bag"), F.col("chars").alias("b_chars"))
    own = F.array_intersect("aw", "bw")
    inside = (F.size(own) == F.size("aw")) | (F.size(own) == F.size("bw"))
    both = F.length(F.array_join(own, " "))
    most = 2.0 * both >= (t.potential - 1e-4) * (both + F.least("a_chars", "b_chars"))  # the shared words against one side
    may = (F.element_at(own, 1) == F.col("v")) & (inside | most | _may_reach(t.potential))
    met = left.join(right, ["v", "i", "j"]).where(may).select("a_text", "b_text", "a_words", "b_words")
    met = met.unionByName(gram_candidates(x, y, t.potential))
    scored = met.select("a_text", "b_text", text.similarity_udf("a_words", "b_words").alias("score"))
    return scored.where(F.col("score") >= t.potential)


def _gram_share(least: float) -> float:
    """Of an indel ratio `least` of texts of n and m characters follow so many common pairs of characters, per character of both, less one.

    Of n + m characters at most (1 - least)(n + m) are left out by the longest common subsequence; a character of one text
    that is left out breaks at most two of its pairs of neighbours and one of the other text's.
    """
    return 0.5 - 1.5 * (1 - least)


def _filed_grams(kinds: DataFrame, side: str, least: float) -> DataFrame:
    """The numbered character pairs (`ab#2` is the second `ab`) of a text's sorted words, once each and with repeats."""
    said = F.array_distinct(F.array(F.array_join("w", " "), F.array_join(F.array_sort("words"), " ")))
    x = kinds.select("norm_text", "w", "words", "bag", "chars", F.explode(said).alias("said")).withColumn("n", F.length("said")).where("n > 2")
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.substring("said", k, 2))
    x = x.withColumn("g", F.array_sort(pairs))
    numbered = F.transform("g", lambda g, k: F.concat(g, F.lit("#"), (k - F.array_position("g", g) + 2).cast("string")))
    return x.select(F.col("norm_text").alias(f"{side}_text"), F.col("w").alias(f"{side}w"), F.col("words").alias(f"{side}_words"), F.col("bag").alias(f"{side}_bag"), F.col("chars").alias(f"{side}_chars"), F.col("n").alias(f"{side}_n"), numbered.alias("g"))


def gram_candidates(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Pairs of texts without a common word that may be similar by characters: a_text, b_text, a_words, b_words, once each.

    A text of n characters has at least c(n) pairs of characters in common with any that is similar, so if both sort theirs
    from the rarest on, the first n - c(n) of either share one. Texts are filed under these and a class of lengths; the first
    that two share has to leave enough behind it on both sides. Common ones are parted into square blocks. Texts of one or
    two characters are similar only to equal ones. x, y: norm_text, w, words, bag, chars.
    """
    least -= 1e-4  # scores are rounded
    share, ratio = _gram_share(least), least / (2 - least)
    if 3 * (1 + ratio) * share <= 1:
        raise ValueError("short texts this far apart need not share a pair of characters")
    sides = [cut(_filed_grams(df, s, least), "grams") for df, s in ((x, "a"), (y, "b"))]
    each = [df.select(F.explode("g").alias("gram")) for df in sides]
    counts = cut(each[0].unionByName(each[1]).groupBy("gram").count(), "gram-counts")
    part = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("count") / 10_000.0))).cast("int")
    step = -math.log(ratio)

    def prefix(df: DataFrame, s: str) -> DataFrame:
        n = F.col(f"{s}_n")
        need = F.ceil(n * (1 + ratio) * share - 1 - 1e-9).cast("int")  # one at least, as checked above
        rows = df.withColumn("id", F.xxhash64(f"{s}_text", f"{s}_n", F.col("g"))).withColumn("gram", F.explode("g")).drop("g").join(F.broadcast(counts) if counts.count() <= SMALL_ROWS else counts, "gram")
        place = F.row_number().over(Window.partitionBy(f"{s}_text", "id").orderBy("count", "gram"))
        rows = rows.withColumn(f"{s}_place", place).where(F.col(f"{s}_place") <= n - 1 - need + 1)
        kind = F.floor(F.log(n.cast("double")) / step).cast("int")
        deal = F.pmod(F.xxhash64(f"{s}_text"), part).cast("int")
        if s == "a":
            return rows.withColumn("kind", F.explode(F.array(kind - 1, kind, kind + 1))).withColumn("i", deal).withColumn("j", F.explode(F.sequence(F.lit(0), part - 1))).drop("count", "id")
        return rows.withColumn("kind", kind).withColumn("j", deal).withColumn("i", F.explode(F.sequence(F.lit(0), part - 1))).drop("count", "id")

    both = F.col("a_n") + F.col("b_n")
    window = F.least("a_n", "b_n") >= ratio * F.greatest("a_n", "b_n") - 1e-9
    left_behind = 1 + F.least(F.col("a_n") - 1 - F.col("a_place"), F.col("b_n") - 1 - F.col("b_place"))
    enough = left_behind >= both * share - 1 - 1e-9
    met = prefix(sides[0], "a").join(prefix(sides[1], "b"), ["gram", "kind", "i", "j"]).where(window & enough & ~F.arrays_overlap("aw", "bw") & _may_reach(least))
    return met.dropDuplicates(["a_text", "b_text"]).select("a_text", "b_text", "a_words", "b_words")
