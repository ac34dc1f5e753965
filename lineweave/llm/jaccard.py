"""Similarity join of documents on word n-grams: rare-first prefix filtering with length, positional and suffix filters.

1. One pass counts n-grams in a sketch of SKETCH cells (of a size that doesn't grow). Cell count, then hash, orders n-grams
   from rare to frequent; any order shared by all texts is exact, a better one only makes smaller buckets.
2. A text's signature is the digest of its set, so equal sets are one class. Each class gives the first
   n - ceil(0.8 n) + 1 of its n-grams with their positions; two sets that link share one of them.
3. Classes that meet in a bucket (an n-gram) are candidates. First each class is verified against the leader of one of its
   buckets, the class with the fewest rarer n-grams, then against the leaders of its other buckets that are in other
   components by then and pass the filters. Then every pair of a bucket whose classes
   are in different components and pass the length, positional and suffix filters is verified once. The suffix filter
   parts the hashes into ranges: wherever one set has an odd and the other an even number of n-grams, they differ by one
   at least, and the number of such ranges bounds the symmetric difference from below, whatever the sets' sizes. Pairs inside a component can't change it and
   are not listed, so a group of near copies costs about a pair per member and not their square; no link that joins two
   components is lost.
4. A bucket with many pairs left is split by a second n-gram: prefixes one longer share two n-grams if sets link, so classes
   of such a bucket meet only where they also share a later one. What is still large is cut into square blocks of pairs
   (both sides dealt), so that no task has more than about BLOCK_PAIRS of them.
5. Verification compares the sets themselves, from the texts.

Edge cases: a null or empty text or one without words has an empty set and is a component of its own; a text of fewer than
five words is one shingle, its word sequence; repeated rows of one doc_id, and rows of one doc_id with different texts, each
have their row; a row without doc_id links like any other and gets the smallest doc_id of its component, null where none has
one; a very long text is one set like any other; an empty table gives no rows; other columns are ignored or, in
one_of_each(), kept. Sets are told apart by two 64-bit digests, n-grams inside them by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import common
from lineweave.llm.components import components

WORDS = 5
PERCENT = 80
SKETCH = 1 << 18
#: Cells in a row of the sketch, as it is summed.
SKETCH_ROW = 1 << 12
#: Hash ranges of a set whose counts, odd or even, are kept for the suffix filter: 64 to a word.
PARITY_WORDS = 4
#: An n-gram is hot if its cell has so many sets more than twice the cells' mean; its rows are then looked at in SALTS parts,
#: numbered from 1, while part 0 is a whole bucket.
HOT, SALTS = 1 << 16, 64
#: Pairs of a bucket from which it is split by a second n-gram, and pairs of a block.
SPLIT_PAIRS, BLOCK_PAIRS = 1 << 14, 1 << 22


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, one row after the other, and len(rows) + 1 offsets."""
    rows = len(offs) - 1
    data = common.lowered(data)
    starts, ends, row = common.words(data, offs, common.NON_SPACE)
    word_hash = common.run_hashes(data, starts, ends)
    h = common.window_hashes(word_hash, k)
    whole = row[: len(h)] == row[k - 1 :] if len(h) else np.zeros(0, bool)
    h, of = h[whole], row[: len(h)][whole]
    n = np.bincount(row, minlength=rows)
    begin = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([_sequence(word_hash[begin[r] : begin[r] + n[r]]) for r in short], np.uint64)
        h, of = np.concatenate([h, own]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))])


def _sequence(word_hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(word_hashes.tobytes(), digest_size=8).digest(), "little")


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(SKETCH, np.int64)
    for batch in batches:
        data, offs = common.buffers(batch.column("text"))
        for a, b in common.chunks(offs):
            h, _ = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            cells += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    used = [(k, x) for k, x in enumerate(cells.reshape(-1, SKETCH_ROW)) if x.any()]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in used], pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for _, x in used])], names=["k", "cells"])


def frequencies(docs: DataFrame) -> np.ndarray:
    """The sketch: how many sets have an n-gram of each cell. Its size is fixed, so it may go to the driver and to every task."""
    return common.sum_vectors(common.texts(docs).mapInArrow(_counted, "k int, cells binary"), SKETCH)


SIGNED = "doc_id long, own long, n_shingles long, sig long, proof long, prefix array<long>, hot array<boolean>, parity array<long>"


def signed(docs: DataFrame, percent: int = PERCENT, *, hot: int = HOT) -> DataFrame:
    """Each document's set size, the signature of its set with a second one, its proof, and, from the first copy that a task meets, its prefix and the n-gram after it."""
    counts = frequencies(docs)
    sketch, hot_from = docs.sparkSession.sparkContext.broadcast(counts), 2 * counts.mean() + hot

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = sketch.value, set()
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                h, at = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                df = count[(h % np.uint64(SKETCH)).astype(np.int64)]
                n, sigs, proofs, prefixes, hots, parities = np.diff(at), [], [], [], [], []
                for r in range(b - a):
                    own = h[at[r] : at[r + 1]]
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                    sigs.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                    proofs.append(int.from_bytes(digest[8:], "little", signed=True) if digest else None)
                    if digest is None or digest in seen:
                        prefixes.append(None)
                        hots.append(None)
                        parities.append(None)
                        continue
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(digest)
                    d = df[at[r] : at[r + 1]]
                    p = _prefix_length(len(own), percent) + 1  # with one n-gram more, for the second level
                    if p < len(own):
                        near = np.flatnonzero(d <= np.partition(d, p - 1)[p - 1])  # ties at the p-th stay until hashes part them
                        first = near[np.lexsort((own[near], d[near]))][:p]
                    else:
                        first = np.lexsort((own, d))
                    prefixes.append(own[first].view(np.int64))
                    hots.append(d[first] >= hot_from)
                    odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                    parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                cols = [batch.column("doc_id")[a:b], batch.column("own")[a:b], pa.array(n.astype(np.int64)), pa.array(sigs, pa.int64()), pa.array(proofs, pa.int64())]
                cols += [pa.array(prefixes, pa.list_(pa.int64())), pa.array(hots, pa.list_(pa.bool_())), pa.array(parities, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "own", "n_shingles", "sig", "proof", "prefix", "hot", "parity"])

    return _own(docs).mapInArrow(made, SIGNED)


def told_apart(signs: DataFrame) -> DataFrame:
    """The rows with a new sig wherever sets of one sig have different proofs; commonly there are none, and nothing is joined."""
    while True:
        both = signs.where("sig is not null").groupBy("sig").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi")
        both = common.cut(both.select("sig", "lo"), "jaccard-collisions")
        if both.isEmpty():
            return signs
        new = F.when(F.col("lo").isNotNull() & (F.col("proof") != F.col("lo")), F.xxhash64("sig", "proof")).otherwise(F.col("sig"))
        signs = common.cut(signs.join(both, "sig", "left").select(*[new.alias(c) if c == "sig" else c for c in signs.columns]), "jaccard-signed")


def _own(docs: DataFrame) -> DataFrame:
    """own tells rows of one doc_id apart by their texts."""
    return common.texts(docs).withColumn("own", F.xxhash64("text"))


def _verified(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of signatures that link. kept: sig and z, a packed text of the class."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            step = 256
            for k in range(0, size, step):
                part = batch.slice(k, step)
                sets = []
                for side in ("za", "zb"):
                    raw = [zlib.decompress(x) for x in part.column(side).to_pylist()]
                    offs = np.cumsum([0, *map(len, raw)])
                    sets.append(shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offs))
                (ha, pa_), (hb, pb_) = sets
                links = []
                for r in range(len(part)):
                    x, y = ha[pa_[r] : pa_[r + 1]], hb[pb_[r] : pb_[r + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    links.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    left = pairs.join(kept.select(F.col("sig").alias("a"), F.col("z").alias("za")), "a")
    both = left.join(kept.select(F.col("sig").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(tested, "a long, b long")


#: Stands for a missing doc_id where a class is tied to one of its texts; sorts last.
NO_ID = 2**63 - 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            need = []
            for at, own in zip(part.column("doc_id").to_pylist(), part.column("own").to_pylist(), strict=True):
                need.append(at != NO_ID or own not in seen)  # of rows without doc_id, one per text and task
                if at == NO_ID:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(own)
            part = part.filter(pa.array(need, pa.bool_()))
            z = [zlib.compress((t or "").encode(), 1) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), pa.array(z, pa.binary())], names=["at", "own", "z"])


def _linked(docs: DataFrame, percent: int, hot: int, split: int, block: int) -> tuple[DataFrame, DataFrame]:
    """A row per document with its set's sig, and the component of each sig, named by a sig of it."""
    signs = told_apart(common.cut(signed(docs, percent, hot=hot), "jaccard-signed"))
    classes = signs.where("sig is not null").groupBy("sig").agg(F.min(F.struct(_known_id().alias("at"), "own")).alias("x")).select("sig", "x.at", "x.own")
    # a set of one n-gram links with its copies only, which are of its class; so does any set with one row
    one = signs.where("prefix is not null and n_shingles > 1").select("sig", "n_shingles", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "x"))
    rows = one.where(F.col("pos") < F.col("n_shingles") - F.ceil(percent * F.col("n_shingles") / 100 - 1e-9) + 1)
    salt = F.when(F.col("x.hot"), F.pmod("sig", F.lit(SALTS)) + 1).otherwise(0)
    rows = rows.select(F.col("x.prefix").alias("gram"), salt.cast("short").alias("salt"), "sig", (F.col("n_shingles") * 2**31 + F.col("pos")).alias("place"))

    # a bucket's rows stand together in one sorted run, which Spark spills when it is long; only those with two classes go on,
    # and all of a hot one, as a class that is alone in its part may meet those of other parts
    bucket = Window.partitionBy("gram", "salt")
    shared = rows.withColumns({"lo": F.min("sig").over(bucket), "hi": F.max("sig").over(bucket)}).where((F.col("lo") != F.col("hi")) | F.col("salt").cast("boolean"))
    pos = F.pmod("place", F.lit(2**31))
    shared = shared.groupBy("gram", "salt", "sig").agg(F.min("place").alias("place")).select("gram", "salt", "sig", F.shiftright("place", 31).alias("n"), pos.alias("pos"))
    shared = common.cut(shared, "jaccard-shared")

    met = shared.select("sig").distinct().join(classes, "sig")
    packed = _own(docs).withColumn("doc_id", _known_id()).mapInArrow(_packed, "at long, own long, z binary")
    kept = common.cut(met.join(packed, ["at", "own"]).groupBy("sig").agg(F.first("z").alias("z")), "jaccard-texts")

    lead = shared.groupBy("gram", "salt").agg(F.min(F.struct("pos", "n", "sig")).alias("lead"))
    near = _lengths_fit(F.col("n"), F.col("lead.n"), percent)
    first = shared.join(lead, ["gram", "salt"]).where((F.col("sig") != F.col("lead.sig")) & near)
    first = first.groupBy("sig").agg(F.min(F.struct((F.col("pos") + F.col("lead.pos")).alias("d"), F.col("lead.sig").alias("other"))).alias("x"))
    pairs = first.select(F.least("sig", "x.other").alias("a"), F.greatest("sig", "x.other").alias("b")).distinct()
    comps = common.cut(components(common.cut(_verified(pairs, kept, percent), "jaccard-links"), "a", "b"), "jaccard-components")
    comps = _widened(comps, _verified(_to_leaders(shared, lead, comps, signs, percent), kept, percent))
    comps = _widened(comps, _verified(_between(shared, comps, signs, percent, split, block), kept, percent))
    return signs.select("doc_id", "own", "n_shingles", "sig"), comps


def _widened(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links, followed between the components that there are."""
    found = common.cut(links, "jaccard-links")
    if found.isEmpty():
        return comps
    end = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    over = found.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    tops = common.cut(components(over, "x", "y"), "jaccard-tops")
    old = comps.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # a node that was in no component until now is among the tops
    return common.cut(old.unionByName(tops).groupBy("node").agg(F.min("component").alias("component")), "jaccard-components")


def joined(docs: DataFrame, percent: int = PERCENT, *, hot: int = HOT, split: int = SPLIT_PAIRS, block: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, comps = _linked(docs, percent, hot, split, block)
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    named = classes.join(comps, classes["sig"] == comps["node"], "left").select("sig", "rep", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "component").select("sig", "component_id")
    return rows.select("doc_id", "n_shingles", "sig").join(final, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _known_id():
    return F.coalesce("doc_id", F.lit(NO_ID))


def _lengths_fit(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _overlap(n, m, percent: int):
    """The least intersection of sets of n and m that link."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def _apart(x: str, y: str):
    """The suffix filter's lower bound on the symmetric difference of two sets."""
    return reduce(lambda s, t: s + t, [F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(PARITY_WORDS)])


def _parities(signs: DataFrame, name: str, prefix: str) -> DataFrame:
    words = [F.element_at("parity", k + 1).alias(f"{prefix}{k}") for k in range(PARITY_WORDS)]
    return signs.where("parity is not null").select(F.col("sig").alias(name), *words).dropDuplicates([name])


def _to_leaders(shared: DataFrame, lead: DataFrame, comps: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class and the leader of a bucket of it in another component that pass all filters, each once."""
    told = lead.join(comps.select(F.col("node").alias("x"), F.col("component").alias("lead_component")), F.col("lead.sig") == F.col("x"), "left")
    own = shared.join(comps.select(F.col("node").alias("sig"), "component"), "sig", "left").join(told, ["gram", "salt"]).where(F.col("sig") != F.col("lead.sig"))
    own = own.where(~F.coalesce(F.col("component") == F.col("lead_component"), F.lit(False)))
    need = _overlap(F.col("n"), F.col("lead.n"), percent)
    fits = _lengths_fit(F.col("n"), F.col("lead.n"), percent) & (F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos")) >= need)
    pairs = own.where(fits).select(F.least("sig", "lead.sig").alias("a"), F.greatest("sig", "lead.sig").alias("b"), (F.col("n") + F.col("lead.n") - 2 * need).alias("most")).distinct()
    return pairs.join(_parities(signs, "a", "p"), "a").join(_parities(signs, "b", "q"), "b").where(_apart("p", "q") <= F.col("most")).select("a", "b")


def _open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of buckets with classes of two components or more: whether each is of the bucket's largest, and the pairs across."""
    sizes = rows.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy(*keys).agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    many = ((F.col("all") - F.col("main.size")) * F.col("all")).alias("pairs")
    return rows.join(main, keys).select(*rows.columns, (F.col("component") == F.col("main.component")).alias("in_main"), many)


def _between(shared: DataFrame, comps: DataFrame, signs: DataFrame, percent: int, split: int, block: int) -> DataFrame:
    """Pairs of a bucket whose classes are in different components, by the length, positional and suffix filters, each once."""
    own = shared.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("gram", "sig", "n", "pos", F.coalesce("component", "sig").alias("component"))
    own = common.cut(_open(own.dropDuplicates(["gram", "sig"]), ["gram"]), "jaccard-open")
    few = own.where(F.col("pairs") <= split).withColumns({"then": F.lit(0).cast("long"), "pos2": F.col("pos")})
    prefixes = signs.where("prefix is not null").select("sig", "prefix").dropDuplicates(["sig"])
    many = own.where(F.col("pairs") > split).drop("in_main", "pairs").join(prefixes, "sig").select("gram", "sig", "n", "pos", "component", F.posexplode("prefix").alias("pos2", "then"))
    many = _open(many.where(F.col("pos2") > F.col("pos")).select("gram", "then", "sig", "n", "pos", F.col("pos2").cast("long").alias("pos2"), "component"), ["gram", "then"])
    both = few.select(many.columns).unionByName(many).join(_parities(signs, "sig", "p"), "sig")
    # square blocks of pairs: each row has a place on its own side and stands once for each place of the other side
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("pairs") / block))).cast("int")
    both = common.cut(both.withColumns({"place": F.pmod(F.xxhash64("sig"), side).cast("int"), "places": F.sequence(F.lit(0), side - 1)}), "jaccard-open")
    x = both.where("not in_main").withColumns({"i": F.col("place"), "j": F.explode("places")}).drop("places").alias("x")
    y = both.withColumns({"j": F.col("place"), "i": F.explode("places")}).drop("places").alias("y")
    need = _overlap(F.col("x.n"), F.col("y.n"), percent)
    after = lambda at: F.least(F.col("x.n") - F.col(f"x.{at}"), F.col("y.n") - F.col(f"y.{at}"))
    on = reduce(lambda s, t: s & t, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("gram", "then", "i", "j")])
    on = on & (F.col("x.component") != F.col("y.component")) & (F.col("y.in_main") | (F.col("x.sig") < F.col("y.sig")))
    # the two n-grams are the first that the sets share wherever they link, or the only one looked at
    fits = _lengths_fit(F.col("x.n"), F.col("y.n"), percent) & (after("pos") >= need) & (after("pos2") + F.when(F.col("x.pos2") == F.col("x.pos"), 0).otherwise(1) >= need)
    fits = fits & (_apart("x.p", "y.p") <= F.col("x.n") + F.col("y.n") - 2 * need)
    return x.join(y, on & fits).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _free(names: list[str], name: str) -> str:
    while name in names:
        name += "_"
    return name


def one_of_each(docs: DataFrame, percent: int = PERCENT, **limits: int) -> DataFrame:
    """One document, all columns, of each component: the one with the smallest doc_id (of several texts of that id, the one
    with the smallest hash; of repeated rows, one; of rows without doc_id only, one). Documents without words all stay."""
    rows, comps = _linked(docs, percent, *(limits.get(k, v) for k, v in (("hot", HOT), ("split", SPLIT_PAIRS), ("block", BLOCK_PAIRS))))
    ends = rows.where("sig is not null").select("sig", _known_id().alias("at"), "own").join(comps.withColumnRenamed("node", "sig"), "sig", "left")
    first = ends.groupBy(F.coalesce("component", "sig").alias("c")).agg(F.min(F.struct("at", "own")).alias("x"))
    at, own = _free(docs.columns, "_at"), _free(docs.columns, "_own")
    keep = first.select(F.col("x.at").alias(at), F.col("x.own").alias(own)).distinct()
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    told = docs.where(~wordless).withColumns({at: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), own: F.xxhash64(F.col("text").cast("string"))})
    return told.join(keep, [at, own], "left_semi").dropDuplicates([at, own]).select(*docs.columns).unionByName(docs.where(wordless))
