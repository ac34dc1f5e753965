"""Scalar functions on descriptions, quantities, codes and dates, as Spark columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# What normalisation removes, joins, expands and leaves in the singular.
TRADEMARKS = "™®©℠"
DASHES = "–—‐‑‒"
UNITS = ("ML", "CM", "MM", "IN", "FT", "MG", "KG", "GA", "FR", "CC", "OZ", "G", "F", "L", "M")
ABBREVIATIONS = {"ASSY": "ASSEMBLY", "PKG": "PACKAGE"}
SINGULAR = ("LENS", "PLUS", "STATUS", "VERSUS", "GAS", "BUS", "BOLUS", "ATLAS", "CANVAS", "IRIS", "PELVIS")
STOPWORDS = ("THE", "OF", "AND", "A", "AN", "FOR", "WITH", "PER")
NUMERIC_TOKEN = r"^(\d+(?:\.\d+)?)([A-Z]{1,2}|%)?$"

#: Regular expression, replacement; in this order.
STEPS = (
    (r"\bW/O\b", "WITHOUT"),
    (r"\bW/", "WITH "),
    (r"(\d)\s+%", "$1%"),
    (r"(\d+(?:\.\d+)?)\s*(" + "|".join(UNITS) + r")\b\.?", "$1$2"),
    (r"(\d+)\.0+(?=[A-Z%]|\s|$)", "$1"),
    (r"(\d)X(\d)", "$1 X $2"),
    (r"[^A-Z0-9.%\s]", " "),
    (r"(?<!\d)\.|\.(?!\d)", " "),
)


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts if texts.isna().all() else texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _singular(t: Column) -> Column:
    stays = ~t.rlike("^[A-Z]+$") | (F.length(t) <= 3) | t.isin(*SINGULAR) | t.endswith("SS") | ~t.endswith("S")
    less = lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    return F.when(stays, t).when(t.endswith("IES"), F.concat(less(3), F.lit("Y"))).when(t.rlike("(X|CH|SH|SS)ES$"), less(2)).otherwise(less(1))


def tokens(c: Column) -> Column:
    """Normalised tokens of a text whose compatibility characters are folded already; null stays null."""
    s = F.upper(F.translate(F.translate(c, TRADEMARKS, ""), DASHES, "-" * len(DASHES)))
    s = reduce(lambda s, step: F.regexp_replace(s, *step), STEPS, s)
    words = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    expand = lambda t: reduce(lambda out, kv: F.when(t == kv[0], F.lit(kv[1])).otherwise(out), ABBREVIATIONS.items(), t)
    return F.transform(F.transform(words, expand), _singular)


def normalized(t: Column) -> Column:
    return F.array_join(t, " ")


def sorted_key(t: Column) -> Column:
    return F.array_join(F.array_sort(t), " ")


def split_tokens(c: Column) -> Column:
    """The tokens that normalized() or sorted_key() joined; none has white space in it."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def numeric_tokens(t: Column) -> Column:
    return F.filter(t, lambda x: x.rlike(NUMERIC_TOKEN))


def numbers(t: Column) -> Column:
    return F.array_distinct(F.transform(numeric_tokens(t), lambda x: F.regexp_extract(x, NUMERIC_TOKEN, 1)))


def content_tokens(t: Column) -> Column:
    return F.filter(t, lambda x: ~x.isin(*STOPWORDS))


def normalize_column(df: DataFrame, text: str, prefix: str = "norm") -> DataFrame:
    """Adds `prefix`_tokens, _text, _key, _numbers in place, without a shuffle. Only texts beyond ASCII go to Python, others as nulls."""
    beyond = F.col(text).rlike(r"[^\x00-\x7F]")
    folded = nfkc(F.when(beyond, F.translate(text, TRADEMARKS, "")))
    own = df.withColumn("_n", folded).withColumn(f"{prefix}_tokens", tokens(F.coalesce("_n", text))).drop("_n")
    t = F.col(f"{prefix}_tokens")
    return own.withColumns({f"{prefix}_text": normalized(t), f"{prefix}_key": sorted_key(t), f"{prefix}_numbers": numbers(t)})


def numeric_conflict(a: Column, b: Column) -> Column:
    """Both sides have numbers and neither side's contain the other's; numbers are compared as written."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


# --- similarity -----------------------------------------------------------------------------------


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits for a row of the table."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for k, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << k
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(x: list[str], y: list[str]) -> float:
    """Set ratio where both sides have two content tokens or more, else sort ratio; four digits."""
    if not len(x) or not len(y):
        return 0.0
    if min(len(x), len(y)) < 2:
        return round(indel(" ".join(sorted(x)), " ".join(sorted(y))), 4)
    own, other = set(x), set(y)
    both, left, right = sorted(own & other), sorted(own - other), sorted(other - own)
    if both and (not left or not right):
        return 1.0
    whole = " ".join(both)
    first, second = " ".join([*both, *left]), " ".join([*both, *right])
    best = indel(first, second)
    if both:
        best = max(best, indel(whole, first), indel(whole, second))
    return round(best, 4)


@pandas_udf(DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def lcs_column(a: Column, b: Column) -> Column:
    """The same LCS inside Catalyst, a table row for each character of a."""
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)
    chars = F.split(b, "")

    def row(prev: Column, ch: Column) -> Column:
        step = F.transform(F.sequence(F.lit(1), F.length(b)), lambda j: F.when(F.element_at(chars, j) == ch, F.element_at(prev, j) + 1).otherwise(F.element_at(prev, j + 1)))
        return F.aggregate(step, F.array(F.lit(0)), lambda out, v: F.concat(out, F.array(F.greatest(F.element_at(out, -1), v))))

    last = F.aggregate(F.split(a, ""), zero, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(last, -1))


# --- quantities, dates, codes ---------------------------------------------------------------------

#: Unit spellings of label lines.
UOM = {"EACH": "EACH", "EA": "EACH", "PC": "EACH", "PCS": "EACH", "PAIR": "PAIR", "PAIRS": "PAIR", "PACK": "PACK", "PACKS": "PACK", "PKG": "PACK", "ROLL": "ROLL", "ROLLS": "ROLL", "SET": "SET", "SETS": "SET"}
LINE = r"(?i)^\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(" + "|".join(UOM) + r")?\s*[-–—:]\s*(.+?)\s*$"
SUB_KINDS = {"PER": "per", "PAIR": "pair", "PAIRS": "pair", "PACK": "pack", "PK": "pack", "EACH": "each", "EA": "each"}
SUB_PAREN = r"(?i)\(\s*(\d+)\s*(per|pairs?|pack|pk|each|ea)(?:\s+[a-z]+)?\s*\)"
SUB_TRAIL = r"(?i),?\s*(\d+)\s*(per)\s+[a-z]+\s*$"


def _lookup(c: Column, table: dict[str, str], default: str | None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def parse_decimal(c: Column) -> Column:
    return F.regexp_replace(c, "[, ]", "").try_cast("decimal(18,6)")


def parse_number(c: Column) -> Column:
    return F.trim(c).try_cast("decimal(18,6)")


def parse_label_line(c: Column) -> Column:
    """struct(matched, quantity, uom, description, sub_value, sub_kind, sub_raw) of `2 Each - Tape Strips (3 per)`."""
    hit = c.rlike(LINE)
    desc = F.regexp_extract(c, LINE, 3)
    pattern = F.when(desc.rlike(SUB_PAREN), F.lit(SUB_PAREN)).when(desc.rlike(SUB_TRAIL), F.lit(SUB_TRAIL))
    part = lambda k: F.when(desc.rlike(SUB_PAREN), F.regexp_extract(desc, SUB_PAREN, k)).when(desc.rlike(SUB_TRAIL), F.regexp_extract(desc, SUB_TRAIL, k))
    value = part(1).try_cast("int")
    rest = lambda p: F.regexp_replace(desc, f"^(.*?){p.replace('(?i)', '(?i:', 1)})(.*)$", "$1$4")
    cleaned = F.when(desc.rlike(SUB_PAREN), rest(SUB_PAREN)).when(desc.rlike(SUB_TRAIL), rest(SUB_TRAIL)).otherwise(desc)
    cleaned = F.when(pattern.isNull(), desc).otherwise(F.trim(F.regexp_replace(F.trim(cleaned), ",+$", "")))
    uom = F.regexp_extract(c, LINE, 2)
    return F.struct(
        F.coalesce(hit, F.lit(False)).alias("matched"),
        F.when(hit, parse_decimal(F.regexp_extract(c, LINE, 1))).alias("quantity"),
        F.when(hit, F.when(uom == "", F.lit("EACH")).otherwise(_lookup(F.upper(uom), UOM, None))).alias("uom"),
        F.when(hit, cleaned).otherwise(F.trim(c)).alias("description"),
        F.when(hit & (value >= 1), value).alias("sub_value"),
        F.when(hit & (value >= 1), _lookup(F.upper(part(2)), SUB_KINDS, None)).alias("sub_kind"),
        F.when(hit & (value >= 1), F.trim(part(0))).alias("sub_raw"),
    )


def format_quantity(q: Column) -> Column:
    """Without trailing zeros; `?` for an unreadable one."""
    s = q.cast("decimal(18,6)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("?"))


def compare_quantities(bom: Column, label: Column, sub_value: Column, sub_kind: Column, label_uom: Column) -> Column:
    """struct(equal, idiom): equal, or reconciled by `(3 per)`, `(1 pair)` or a unit of pairs."""
    times = F.when(sub_kind == "pair", F.lit(2)).otherwise(sub_value)
    idiom = F.coalesce(label * times == bom, F.lit(False)) | F.coalesce((F.upper(label_uom) == "PAIR") & (label * 2 == bom), F.lit(False))
    equal = F.coalesce(bom == label, F.lit(False))
    return F.struct(equal.alias("equal"), (~equal & idiom).alias("idiom"))


def parse_date(c: Column) -> Column:
    """M/d/yy, M/d/yyyy or ISO; two-digit years from 69 on are of the last century."""
    s = F.trim(c)
    short = F.try_to_date(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), s), "M/d/yy")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(short, F.try_to_date(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s), "M/d/yyyy"), F.try_to_date(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s), "yyyy-MM-dd"))


def is_active(effective_from: Column, effective_thru: Column, as_of: Column) -> Column:
    return ~F.coalesce(effective_thru < as_of, F.lit(False)) & ~F.coalesce(effective_from > as_of, F.lit(False))


def family_of(code: Column) -> Column:
    """Leading digits of a code, else the code."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(code), r"^(\d+)", 1), F.lit("")), F.trim(code))


def pair_token(*ids: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *ids), 256), 1, 4)


def document_id(prefix: Column, sha: Column, path: Column) -> Column:
    return F.concat_ws(":", prefix, F.substring(sha, 1, 12), F.substring(F.sha2(path, 256), 1, 6))


def revision_role(path: Column) -> Column:
    """old, new or current, by words of the file name."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")), "[^a-z0-9]+")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    return F.when(has("old", "prev", "previous", "superseded", "before"), "old").when(has("new", "proposed", "unreleased", "revised", "after", "draft"), "new").otherwise("current")


#: Ordered rules that say what a line is: pattern, category; item-number prefix, category.
KEYWORD_RULES = (
    (r"\bQUALITY\b|\bINSPECTION\b|\bRECORD\b|FIRST/LAST|FIRST LAST", "QUALITY"),
    (r"\bPRODUCING\b|\bSTERILI[SZ]", "PROCESS"),
    (r"TRANSFER RIBBON|PRINT(?:ER)? RIBBON|\bRIBBON, (?:THERMAL|PRINT)|\bTONER\b|\bINK, PRINT|\bPRINTER INK\b", "PROCESS"),
    (r"\bIFU\b|INSTRUCTIONS? FOR USE|\bLEAFLET\b|\bBOOKLET\b|PACKAGE INSERT|\bINSERT, (?:IFU|INSTRUCTION|LEAFLET|PRODUCT|PACKAGE)", "DOCUMENT"),
    (r"\bLABELS?\b|\bLBL\b", "LABEL"),
    (r"\bCARTON\b|\bSHIPPER\b|\bBLISTER\b|^LID\b|\bLID,|\bTRAY\b|\bPOUCH, (?:STERIL|PEEL|TYVEK)|\bBOX, (?:SHIP|INNER|OUTER|UNIT|CORRUGATED)|\bFOAM INSERT\b", "PACKAGING"),
)
PREFIX_RULES = (("MPS", "PROCESS"), ("FM", "QUALITY"), ("BAW", "LABEL"), ("PK", "PACKAGING"))
PHYSICAL, UNKNOWN = "PHYSICAL_COMPONENT", "UNKNOWN"


def categorize(item_number: Column, description: Column, quantity: Column, keywords=KEYWORD_RULES, prefixes=PREFIX_RULES) -> Column:
    """struct(category, rule): the first keyword rule, then the first prefix rule, then the quantity."""
    desc, item = F.upper(description), F.upper(item_number)
    out = F
    for pattern, category in keywords:
        out = out.when(desc.rlike(pattern), F.struct(F.lit(category).alias("category"), F.regexp_extract(desc, pattern, 0).alias("rule")))
    for prefix, category in prefixes:
        out = out.when(item.startswith(prefix), F.struct(F.lit(category).alias("category"), F.lit(f"prefix {prefix}").alias("rule")))
    said = lambda category, rule: F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"))
    plain = F.when(quantity.isNull(), said(PHYSICAL, "quantity unreadable")).when(quantity > 0, said(PHYSICAL, "quantity")).otherwise(said(UNKNOWN, "no quantity"))
    return out.otherwise(plain)


def change_kind(actual: Column, proposed: Column) -> Column:
    """DELETE, ADD, SUBSTITUTE or MODIFY, by the item a form has now and the one it proposes."""
    a, p = F.nullif(F.trim(actual), F.lit("")), F.nullif(F.trim(proposed), F.lit(""))
    gone = F.upper(p).isin("DELETE", "DEL", "REMOVE", "REMOVED", "DELETED")
    return F.when(gone & a.isNotNull(), "DELETE").when(a.isNull() & p.isNull(), "UNKNOWN").when(a.isNull(), "ADD").when(p.isNotNull() & (p != a), "SUBSTITUTE").otherwise("MODIFY")


def parse_decision(cell: Column) -> Column:
    """struct(decision, override, error) of `ACCEPT` or `OVERRIDE->EQUIVALENT`."""
    s = F.upper(F.trim(cell))
    form = r"^(ACCEPT|CONFIRM_DISCREPANCY|NEEDS_MORE_INFORMATION|OVERRIDE)(?:\s*(?:→|->|:)\s*(EXACT|EQUIVALENT|POTENTIAL|MISMATCH|MISSING))?$"
    decision, override = F.nullif(F.regexp_extract(s, form, 1), F.lit("")), F.nullif(F.regexp_extract(s, form, 2), F.lit(""))
    error = F.when(decision.isNull() & (s != ""), "unknown decision").when((decision == "OVERRIDE") & override.isNull(), "override without class").when((decision != "OVERRIDE") & override.isNotNull(), "class without override")
    return F.struct(F.when(error.isNull(), decision).alias("decision"), F.when(error.isNull(), override).alias("override"), error.alias("error"))


def first_json(c: Column) -> Column:
    """The first JSON object inside free text: from the first brace to the one that closes it, braces and quotes in strings aside; null if none does.

    Folded over pieces that begin at a brace, a quote or a backslash, as nothing between two of them changes the state.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("said"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, piece: Column) -> Column:
        ch, at, n = F.substring(piece, 1, 1), s["at"] + 1, F.length(piece)
        state = lambda depth, said, escaped, first=s["first"], last=s["last"]: F.struct(depth.alias("depth"), said.alias("said"), escaped.alias("escaped"), (s["at"] + n).alias("at"), first.alias("first"), last.alias("last"))
        no, yes = F.lit(False), F.lit(True)
        return (
            F.when(s["last"] > 0, s)
            .when(s["depth"] == 0, F.when(ch == "{", state(F.lit(1), no, no, at)).otherwise(state(s["depth"], no, no)))
            .when(s["escaped"], state(s["depth"], yes, no))
            .when(s["said"], state(s["depth"], ch != '"', (ch == "\\") & (n == 1)))  # in a longer piece the next character is an ordinary one
            .when(ch == '"', state(s["depth"], yes, no))
            .when(ch == "{", state(s["depth"] + 1, no, no))
            .when(ch == "}", state(s["depth"] - 1, no, no, last=F.when(s["depth"] == 1, at).otherwise(0)))
            .otherwise(state(s["depth"], no, no))
        )

    own = lambda s: F.when(s["last"] > 0, F.substring(c, s["first"], s["last"] - s["first"] + 1))
    return F.aggregate(F.split(c, r'(?=[{}"\\])'), start, step, own)


def parse_suggestion(c: Column) -> Column:
    """struct(verdict, confidence) of the first JSON object inside free text; what can't be read is UNSURE 0."""

    def said(own: Column) -> Column:
        known = F.upper(own["verdict"]).isin("SAME_ITEM", "DIFFERENT_ITEM", "UNSURE")
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(own["confidence"], F.lit(0.0))))
        return F.struct(F.when(known, F.upper(own["verdict"])).otherwise("UNSURE").alias("verdict"), F.when(known, sure).otherwise(0.0).alias("confidence"))

    return F.get(F.transform(F.array(F.from_json(first_json(c), "verdict string, confidence double")), said), F.lit(0))  # read once for both


# --- keys and cells -------------------------------------------------------------------------------


def row_id(letter: Column, sku: Column, pair: Column, seq: Column) -> Column:
    """`R-<sku>-<pair>-<seq>`, the sequence with three digits at least; without a pair token, `R-<sku>-<seq>`."""
    return F.when(pair.isNull(), F.format_string("%s-%s-%03d", letter, sku, seq)).otherwise(F.format_string("%s-%s-%s-%03d", letter, sku, pair, seq))


def comparison_key(check: Column, sku: Column, role: Column, item_number: Column, a_key: Column, b_key: Column, change_key: Column) -> Column:
    """What a row compares, whatever its id: header or reference by role, a change by its key, else A's item number or text, or B's text."""
    what = (
        F.when(role.isin("header", "reference", "coverage"), role)
        .when(change_key.isNotNull(), F.concat(F.lit("A:"), change_key))
        .when(F.coalesce(item_number, a_key).isNotNull(), F.concat(F.lit("A:"), F.coalesce(item_number, a_key)))
        .otherwise(F.concat(F.lit("B:"), b_key))
    )
    return F.concat_ws("|", check, sku, what)


def change_key(kind: Column, actual: Column, proposed: Column) -> Column:
    """`KIND:actual->proposed` of a change form's row, with what it has."""
    a, p = F.nullif(F.trim(actual), F.lit("")), F.nullif(F.trim(proposed), F.lit(""))
    return F.concat(kind, F.lit(":"), F.when(kind == "DELETE", a).when(kind == "ADD", p).when(kind == "SUBSTITUTE", F.concat(a, F.lit("->"), p)).otherwise(F.coalesce(a, p)))


def revision_key(change: Column, a_key: Column, b_key: Column) -> Column:
    """What changed between two revisions and on which text: ADDED and DESC by the new text, REMOVED by the old one."""
    old, new = F.coalesce(a_key, b_key), F.coalesce(b_key, a_key)
    return F.when(change == "HEADER", "HEADER").otherwise(F.concat(change, F.lit(":"), F.when(change.isin("REMOVED", "ABSENT", "SATISFIED"), old).otherwise(new)))


def split_list(cell: Column, commas: bool = True) -> Column:
    """Parts of a cell, trimmed, empty ones left out; aliases (commas=False) part at semicolons and line ends only."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[;\n,]" if commas else r"[;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def is_truthy(cell: Column) -> Column:
    return F.coalesce(F.upper(F.trim(cell)).isin("Y", "YES", "TRUE", "1", "ACTIVE"), F.lit(False))


#: Fixed value: the scopes of a relationship.
SCOPE = r"^(global|family:\S+|sku:\S+)$"


def scope_parts(scope: Column) -> Column:
    """struct(valid, kind, code) of `global`, `family:<code>` or `sku:<code>`."""
    kind = F.split_part(scope, F.lit(":"), F.lit(1))
    return F.struct(F.coalesce(scope.rlike(SCOPE), F.lit(False)).alias("valid"), kind.alias("kind"), F.nullif(F.split_part(scope, F.lit(":"), F.lit(2)), F.lit("")).alias("code"))


def relative_path(path: Column, root: Column) -> Column:
    """The path below a root, as it is where it lies elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def cell_text(number: Column, day: Column, said: Column) -> Column:
    """A typed cell as text: dates MM/dd/yy, whole numbers without a point, texts trimmed; the first that is given."""
    whole = F.when(number == F.floor(number), F.format_string("%d", F.floor(number))).otherwise(number.cast("string"))
    return F.coalesce(F.date_format(day, "MM/dd/yy"), whole, F.trim(said), F.lit(""))
