"""The registered query of each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import alignment, chat, common, decontaminate, jaccard, langid, packing, pii, repetition, search, secrets, token_counts, token_output, wrappers


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_digests(common.table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(common.table(spark, sf_dir, "conversations"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(common.table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(common.table(spark, sf_dir, "documents"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.digests(common.table(spark, sf_dir, "documents"))


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(common.table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(common.table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(common.table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(common.table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(common.table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_best_fit_packing, op3_decontamination, op4_chat_formatting, op5_token_counts, op6_language_id, op7_repetition_rules, op8_wrapper_induction, op9_jaccard_join, op10_secret_scan, op11_pii, op12_cross_tokenizer_alignment, op13_ranked_search)}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
with d as (select doc_id, case when text is null then [] else regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') end as l from documents),
    b as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l from benchmark where text is not null and item_id is not null),
    bk as (select item_id, l, least(13, len(l)) as k from b where len(l) > 0),
    bw as (select distinct item_id, k, array_to_string(l[i : i + k - 1], ' ') as s from (select item_id, l, k, unnest(range(1, len(l) - k + 2)) as i from bk) x),
    dw as (select doc_id, k, i, array_to_string(l[i : i + k - 1], ' ') as s from (select doc_id, l, k, unnest(range(1, len(l) - k + 2)) as i from d cross join (select distinct k from bk) z) x),
    hit as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on bw.k = dw.k and bw.s = dw.s),
    n as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i + k)) as w from hit) x group by doc_id),
    t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) x group by doc_id)
select d.doc_id, cast(len(d.l) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.items, '')) as items_sha256, coalesce(n.n_hit, 0) > 0 and 20 * coalesce(n.n_hit, 0) >= len(d.l) as contaminated
from d left join n on n.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""

OP9_SQL = f"""
with recursive d as (select doc_id, case when text is null then [] else regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') end as l from documents),
    s as (select distinct doc_id, hash(array_to_string(l[i : i + 4], ' ')) as h from (select doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) as i from d where len(l) > 0) x),
    n as (select doc_id, count(*) as n from s group by doc_id),
    own as (select doc_id, min(doc_id) over (partition by e) as rep from (select doc_id, md5(string_agg(cast(h as varchar), ',' order by h)) as e from s group by doc_id) x),
    r as (select s.* from s join own on own.doc_id = s.doc_id and own.rep = s.doc_id),
    pair as (select x.doc_id as a, y.doc_id as b, count(*) as c from r x join r y on x.h = y.h and x.doc_id < y.doc_id group by 1, 2),
    link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
    both_ways as (select a, b from link union select b, a from link),
    reach as (select a as root, a as node from both_ways union select reach.root, e.b from reach join both_ways e on e.a = reach.node),
    comp as (select node, min(root) as c from reach group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.c, own.rep, d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id left join own on own.doc_id = d.doc_id left join comp on comp.node = own.rep
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_chat_formatting": chat.ORACLE_SQL, "op9_jaccard_join": OP9_SQL, "op13_ranked_search": search.ORACLE_SQL}
