"""Chat formatting with cumulative-snapshot collapse.

A log that keeps a conversation anew after every turn holds it many times, each a prefix of the next. Each turn gets a
hash of its place, role and text; their running combination is the hash of the conversation up to there. A conversation
whose whole hash is a prefix hash of a longer one is a snapshot and goes; of equal ones the smallest conv_id stays. The
conversations that are left are rendered, a row per turn with its place in the rendered text, so that no conversation,
however long, is gathered in one place. Runs inside a conversation go by blocks of BLOCK turns, and prefixes are reduced
to their longest conversation before they are joined, so that neither a long conversation nor a common first turn is hot.

Edge cases: a null role or text is a value of its own and is rendered empty; turns are ordered by turn (nulls first), then
role and text hash, so turns of one number have a fixed order, and stand in one block however many they are; a very long
text is a turn like any other; repeated rows count once; a turn without conv_id belongs to no conversation and is left out; an empty
table gives no rows; other columns are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import common

BLOCK = 1024
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(END))


def _keyed(conversations: DataFrame) -> DataFrame:
    """Turns with two hashes of their role and text."""
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = [F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    return c.withColumns({"th": F.xxhash64(*whole), "tg": F.xxhash64(F.lit(7), *whole)})


def placed(conversations: DataFrame) -> DataFrame:
    """Of each turn its position, its start in the rendered text, and two hashes of the conversation up to it, without texts."""
    size = F.length(rendered(F.col("role"), F.col("text"))).cast("long")
    t = _keyed(conversations).select("conv_id", "turn", "role", "th", "tg", size.alias("size")).dropDuplicates(["conv_id", "turn", "th", "tg"])
    t = common.cut(t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**40)))), "turns")
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "th", "tg")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    blocks = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.sum("n").over(every).alias("turns"))
    x = t.join(blocks, ["conv_id", "block"]).withColumns({"position": F.col("n0") + F.row_number().over(inside), "start": F.col("s0") + F.sum("size").over(upto) - F.col("size")})
    x = x.withColumns({"h": F.xxhash64("position", "th", "tg"), "g": F.xxhash64(F.lit(3), "position", "tg", "th")})
    mixed = x.groupBy("conv_id", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    mixed = mixed.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in "hg"])
    x = x.join(mixed, ["conv_id", "block"])
    rolled = [F.col(f"{c}0").bitwiseXOR(F.bit_xor(c).over(upto)).alias(f"prefix_{c}") for c in "hg"]
    return x.select("conv_id", "block", "turn", "th", "tg", "position", "start", "turns", *rolled)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that aren't a prefix of a longer one, one of equal ones. turns: placed()."""
    key = ["position", "prefix_h", "prefix_g"]
    longest = turns.groupBy(*key).agg(F.max("turns").alias("longest")).where(F.col("longest") > F.col("position"))
    whole = turns.where("position = turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(longest.select(*key), key, "left_anti").select("conv_id")


def formatted(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, position (from 1), turns, role, start (in characters) and rendered of each turn."""
    turns = common.cut(placed(conversations), "placed")
    blocks = turns.select("conv_id", "block").distinct().join(maximal(turns), "conv_id")  # a row per block, so that a long conversation is many keys
    kept = turns.join(blocks, ["conv_id", "block"], "left_semi").select("conv_id", "turn", "th", "tg", "position", "turns", "start")
    texts = _keyed(conversations).dropDuplicates(["conv_id", "turn", "th", "tg"]).withColumnRenamed("turn", "_turn")
    same = (texts["conv_id"] == kept["conv_id"]) & texts["_turn"].eqNullSafe(kept["turn"]) & (texts["th"] == kept["th"]) & (texts["tg"] == kept["tg"])
    return texts.join(kept, same).select(kept["conv_id"], "position", "turns", "role", "start", rendered(F.col("role"), F.col("text")).alias("rendered"))


ORACLE_SQL = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
    c as (select conv_id, list(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) order by turn nulls first, role) as l from t group by conv_id),
    p as (select conv_id, len(l) as n, k, array_to_string(l[1:k], chr(3)) as s from c, unnest(range(1, len(l) + 1)) u(k)),
    whole as (select s, n, min(conv_id) as conv_id from p where k = n group by s, n),
    kept as (select conv_id from whole where not exists (select 1 from p where p.s = whole.s and p.k = whole.n and p.n > p.k)),
    r as (select t.conv_id, t.role, row_number() over w as position, count(*) over (partition by t.conv_id) as turns, '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10) as rendered from t join kept on kept.conv_id = t.conv_id window w as (partition by t.conv_id order by t.turn nulls first, t.role))
select conv_id, position, turns, role, cast(coalesce(sum(length(rendered)) over (partition by conv_id order by position rows between unbounded preceding and 1 preceding), 0) as bigint) as start, rendered from r
"""
