"""SQL for the registered queries, for an engine that has the tables as views; it is written apart from the Spark plans."""

from __future__ import annotations

from lineweave.plans.fixtures import portable


def fx(name: str) -> str:
    return f"({portable('{' + name + '}')})"


def tokens(e: str) -> str:
    s = f"upper({e})"
    for pattern, to in ((r"\bW/O\b", "WITHOUT"), (r"\bW/", "WITH "), (r"(\d)\s+%", r"\1%"), (r"(\d+(?:\.\d+)?)\s*(ML|CM|MM|IN|FT|MG|KG|GA|FR|CC|OZ|G|F|L|M)\b\.?", r"\1\2"), (r"(\d+)\.0+([A-Z%]|\s|$)", r"\1\2"), (r"(\d)X(\d)", r"\1 X \2"), (r"[^A-Z0-9.%\s]", " "), (r"(^|[^0-9])\.", r"\1 "), (r"\.([^0-9]|$)", r" \1")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    words = f"list_filter(string_split_regex({s}, '\\s+'), lambda t: t <> '')"
    singular = """case when not regexp_full_match(t, '[A-Z]+') or length(t) <= 3 or t in ('LENS','PLUS','STATUS','VERSUS','GAS','BUS','BOLUS','ATLAS','CANVAS','IRIS','PELVIS') or t like '%SS' or t not like '%S' then t
        when t like '%IES' then left(t, length(t) - 3) || 'Y' when regexp_matches(t, '(X|CH|SH|SS)ES$') then left(t, length(t) - 2) else left(t, length(t) - 1) end"""
    return f"list_transform(list_transform({words}, lambda t: case t when 'ASSY' then 'ASSEMBLY' when 'PKG' then 'PACKAGE' else t end), lambda t: {singular})"


NUMERIC = r"^(\d+(?:\.\d+)?)([A-Z]{1,2}|%)?$"


def numbers(t: str) -> str:
    return f"list_distinct(list_transform(list_filter({t}, lambda x: regexp_matches(x, '{NUMERIC}')), lambda x: regexp_extract(x, '{NUMERIC}', 1)))"


def sides(label: str = "label") -> str:
    """CTEs a and b: lines with their tokens, keys and numbers; p: exact pairs, the k-th of a key with the k-th."""
    side = lambda f: f"(select *, array_to_string(list_sort(t), ' ') as key from (select *, {tokens('description')} as t from {fx(f)} x) y)"
    return f"""a as {side('pieces')}, b as {side(label)},
        ka as (select *, row_number() over (partition by pair, key order by item_ord) as k from a), kb as (select *, row_number() over (partition by pair, key order by item_ord) as k from b),
        p as (select ka.pair, ka.item_ord as a_ord, kb.item_ord as b_ord, ka.key from ka join kb on ka.pair = kb.pair and ka.key = kb.key and ka.k = kb.k where ka.key <> '')"""


def results(prefix: str = "", a_where: str = "true", b_where: str = "true", a: str = "", b: str = "") -> str:
    """CTEs of the exact pairing check's rows, as `res` with a prefix; a, b: SQL of the lines, by default the fixtures."""
    side = lambda f, w: f"(select *, array_to_string(list_sort(t), ' ') as key from (select *, {tokens('description')} as t from {f} x where {w}) y)"
    a, b = a or fx("pieces"), b or fx("label")
    q = prefix
    return f"""{q}a as {side(a, a_where)}, {q}b as {side(b, b_where)},
        {q}ka as (select *, row_number() over (partition by pair, key order by item_ord) as k from {q}a), {q}kb as (select *, row_number() over (partition by pair, key order by item_ord) as k from {q}b),
        {q}na as (select pair, key, count(*) as n from {q}a group by pair, key), {q}nb as (select pair, key, count(*) as n from {q}b group by pair, key),
        {q}raw as (
            select ka.pair, ka.item_ord as a_ord, kb.item_ord as b_ord, ka.item_number, kb.description as b_description, 'EXACT' as level, 1.0 as score, ka.quantity <> kb.quantity as hard, nb.n > 1 as many, ka.confidence < 0.7 as low, 'pair' as what
            from {q}ka ka join {q}kb kb on ka.pair = kb.pair and ka.key = kb.key and ka.k = kb.k join {q}nb nb on nb.pair = ka.pair and nb.key = ka.key
            union all
            select ka.pair, ka.item_ord, null, ka.item_number, null, 'NONE', case when nb.n is null then 0.0 else 1.0 end, false, nb.n is not null, ka.confidence < 0.7, 'a'
            from {q}ka ka left join {q}nb nb on nb.pair = ka.pair and nb.key = ka.key where ka.k > coalesce(nb.n, 0)
            union all
            select kb.pair, null, kb.item_ord, null, kb.description, 'NONE', case when na.n is null then 0.0 else 1.0 end, false, false, kb.confidence < 0.7, 'b'
            from {q}kb kb left join {q}na na on na.pair = kb.pair and na.key = kb.key where kb.k > coalesce(na.n, 0)),
        {q}res as (select pair, 'item' as role, a_ord, b_ord, item_number, b_description, case when what <> 'pair' then 'MISSING' when hard then 'MISMATCH' when many then 'POTENTIAL' else 'EXACT' end as classification, level, cast(score as double) as score,
            list_filter([case when many then 'AMBIGUOUS_MATCH:MAJOR' end, case when low then 'LOW_EXTRACTION_CONFIDENCE:INFO' end, case when what = 'b' then 'MISSING_IN_BOM:MAJOR' end, case when what = 'a' then 'MISSING_IN_LABEL:MAJOR' end, case when hard then 'QTY_MISMATCH:MAJOR' end], lambda x: x is not null) as d,
            concat_ws('|', cast(pair as varchar), 'BOM_LABEL', coalesce(item_number, 'b:' || b_description)) as comparison_key, concat_ws('-', cast(pair as varchar), cast(coalesce(a_ord, 0) as varchar), cast(coalesce(b_ord, 0) as varchar)) as row_id from {q}raw),
        {q}out as (select *, array_to_string(d, ';') as discrepancies, classification <> 'EXACT' or len(d) > 0 as requires_validation, cast(pair as varchar) || 'NS' as sku from {q}res)"""


FUZZY = f"""with recursive {sides('label_fuzzy')},
    fa as (select a.* from a anti join p on p.pair = a.pair and p.a_ord = a.item_ord), fb as (select b.* from b anti join p on p.pair = b.pair and p.b_ord = b.item_ord),
    cand as (select fa.pair, fa.item_ord as a_ord, fb.item_ord as b_ord, list_filter(fa.t, lambda x: x not in ('THE','OF','AND','A','AN','FOR','WITH','PER')) as x, list_filter(fb.t, lambda x: x not in ('THE','OF','AND','A','AN','FOR','WITH','PER')) as y, {numbers('fa.t')} as nx, {numbers('fb.t')} as ny from fa join fb on fa.pair = fb.pair),
    s as (select *, list_sort(list_distinct(list_intersect(x, y))) as i, list_sort(list_distinct(list_filter(x, lambda v: not list_contains(y, v)))) as d1, list_sort(list_distinct(list_filter(y, lambda v: not list_contains(x, v)))) as d2 from cand),
    u as (select distinct array_to_string(d1, ' ') as p, array_to_string(d2, ' ') as q from s),
    l as (select p, q, 0 as k, list_transform(range(0, length(q) + 1), lambda z: 0) as r from u
        union all
        select p, q, k + 1, list_prepend(0, list_transform(range(1, length(q) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m: case when p[k + 1] = q[m] then r[m] + 1 else r[m + 1] end)))) from l where k < length(p)),
    lcs as (select p, q, list_max(r) as n from l where k = length(p)),
    w as (select s.*, length(array_to_string(i, ' ')) as li, length(lcs.p) as l1, length(lcs.q) as l2, lcs.n as n from s join lcs on lcs.p = array_to_string(d1, ' ') and lcs.q = array_to_string(d2, ' ')),
    scored as (select pair, a_ord, b_ord, nx, ny, case when li > 0 and (l1 = 0 or l2 = 0) then 1.0 when li > 0 then greatest(2.0 * (li + 1 + n) / (2 * li + 2 + l1 + l2), 2.0 * li / (2 * li + 1 + l1), 2.0 * li / (2 * li + 1 + l2)) else 2.0 * n / (l1 + l2) end as score from w)"""

CELLS = """cells as (
    select cast(floor(o_orderkey / 100) as bigint) as file, o_orderkey % 100 + 10 as row, c.col, c.text from orders, lateral (values (0, cast(o_orderkey as varchar)), (1, ''), (2, o_orderpriority), (3, o_orderstatus)) c(col, text)
    union all select file, 5, c.col, c.text from (select distinct cast(floor(o_orderkey / 100) as bigint) as file from orders) f, lateral (values (0, case when file % 2 = 0 then 'Component Item' else 'Item Number' end), (1, case when file % 2 = 0 then ' Qty ' else 'Notes' end), (2, case when file % 2 = 0 then 'Description' else ' description' end), (3, case when file % 2 = 0 then 'item number' else 'UM' end)) c(col, text)
    union all select file, 1, c.col, c.text from (select distinct cast(floor(o_orderkey / 100) as bigint) as file from orders) f, lateral (values (0, 'Parent Item'), (1, ''), (2, 'P' || cast(file as varchar)), (3, 'x')) c(col, text)),
    alias(alias, name) as (values ('component item', 'component_item'), ('item number', 'component_item'), ('description', 'description'), ('qty', 'quantity'), ('quantity per', 'quantity'), ('um', 'uom')),
    named as (select file, row, name, min(col) as col_no from cells join alias on lower(trim(text)) = alias group by file, row, name),
    head as (select named.* from named join (select file, min(row) as row from (select file, row from named group by file, row having bool_or(name = 'component_item') and bool_or(name in ('description', 'quantity'))) z group by file) h on h.file = named.file and h.row = named.row)"""

WORDS = """lns as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ln from documents where text is not null),
    wds as (select doc_id, ln, unnest(string_split(t, ' ')) as text, generate_subscripts(string_split(t, ' '), 1) - 1 as k from lns),
    words as (select doc_id, ln, k, text, k * 40.0 as x0, k * 40.0 + length(text) * 5.0 as x1, cast(ln as double) * 12.0 + (k * 7 % 3) * cast(0.8 as double) as y0 from wds where text <> '')"""

STATES = f"""d as (select * from {fx('decisions')} x), lastd as (select row_id, slot, max_by(struct_pack(decision := decision, override := override), struct_pack(a := decided_at, b := decision)) as x, max(decided_at) as at from d group by row_id, slot),
    piv as (select row_id, max(case when slot = 1 then x.decision end) as d1, max(case when slot = 1 then x.override end) as o1, max(case when slot = 2 then x.decision end) as d2, max(case when slot = 2 then x.override end) as o2 from lastd group by row_id),
    st as (select r.row_id, r.classification, piv.d1, piv.o1, piv.d2, piv.o2, case when f.final is not null then 'FINALIZED' when d1 is not null and d2 is not null and d1 = d2 and o1 is not distinct from o2 then 'AGREED' when d1 is not null and d2 is not null then 'DISAGREEMENT' when d1 is not null then 'REVIEWER_1_COMPLETE' when d2 is not null then 'REVIEWER_2_COMPLETE' else 'ENGINE_RECOMMENDED' end as state
        from {fx('rows')} r left join piv on piv.row_id = r.row_id left join {fx('finals')} f on f.row_id = r.row_id)"""

VERSIONS = """v as (select * from (select 'REL-' || case when l_partkey < 100 then lpad(cast(l_partkey as varchar), 3, '0') else cast(l_partkey as varchar) end as id, cast(row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as int) as version,
    'TERM ' || cast(l_suppkey as varchar) as canonical, l_linenumber <> 3 as active, l_suppkey % 10 = 0 as deleted from lineitem) x)"""

DOCS = f"docs as (select *, case when count(*) over (partition by folder) >= 2 and sum(case when doc_type = 'BOM' then 1 else 0 end) over (partition by folder) = 1 then 'folder:' || folder when sku is not null then 'family:' || coalesce(nullif(regexp_extract(sku, '^(\\d+)', 1), ''), sku) else 'doc:' || cast(doc as varchar) end as set_key from {fx('documents_fx')} x)"
DOCS_KEPT = DOCS.replace("docs as (", "alld as (") + ", docs as (select * from alld where doc_type <> 'PCO')"

_STERILE = tokens("noun || ', ' || adj || ', ' || cast(p_size as varchar) || ' MM STERILE'")
_PLAIN = tokens("adj || ' ' || noun || ' ' || cast(p_size as varchar) || 'MM'")

ORACLE_SQL: dict[str, str] = {
    "normalize_parts": f"select description, array_to_string(t, ' ') as normalized, array_to_string(list_sort(t), ' ') as sorted_key, array_to_string(list_sort({numbers('t')}), ',') as numbers from (select distinct description, {tokens('description')} as t from {fx('label_fuzzy')} x) y",
    "sorted_key_groups": f"select array_to_string(list_sort(t), ' ') as norm_key, count(*) as n, count(distinct pair) as sets from (select pair, {tokens('description')} as t from {fx('bom')} x) y group by 1",
    "normalize_documents": f"select doc_id, cast(len(list_filter(list_filter(string_split_regex(regexp_replace(upper(translate(text, '–—‐‑‒', '-----')), '[^A-Z0-9.%\\s]', ' ', 'g'), '\\s+'), lambda t: t <> ''), lambda t: regexp_matches(t, '{NUMERIC}'))) as bigint) as numeric_tokens from documents",
    "quantity_parse": f"""select pair, item_ord, cast(regexp_extract(raw_line, '^(\\d+)', 1) as decimal(18,6)) as quantity, 'EACH' as uom, trim(regexp_replace(regexp_replace(substr(raw_line, instr(raw_line, ' - ') + 3), ' \\(3 per\\)$', ''), ', 2 per pouch$', '')) as said,
        case when raw_line like '%(3 per)' then 3 when raw_line like '%2 per pouch' then 2 end as sub_value, case when raw_line like '% per%' then 'per' end as sub_kind from {fx('label')} x""",
    "quantity_verdict": f"""select equal, idiom, count(*) as n from (select b.quantity = l.quantity as equal, b.quantity <> l.quantity and (case when l.l_partkey % 3 = 0 then l.quantity * 2 = b.quantity else false end or (l.l_partkey % 10 = 0 and l.quantity * 2 = b.quantity)) as idiom
        from {fx('bom')} b join {fx('label')} l on b.pair = l.pair and b.item_ord = l.item_ord) x group by 1, 2""",
    "categorize_lines": f"select category, count(*) as n, cast(sum(quantity) as decimal(18,6)) as quantity from (select quantity, case when regexp_matches(description, '\\bANVIL\\b|\\bGIZMO\\b') then 'PACKAGING' when regexp_matches(description, '\\bRING\\b') then 'DOCUMENT' when item_number like '7%' then 'PROCESS' when quantity > 0 then 'PHYSICAL_COMPONENT' else 'UNKNOWN' end as category from {fx('bom')} x) y group by 1",
    "codes_and_ids": f"select sku, count(*) as lines, regexp_extract(sku, '^(\\d+)', 1) as family, substr(sha256(sku || '|label'), 1, 4) as token, 'bom:' || substr(sha256(sku), 1, 12) || ':' || substr(sha256('/in/' || sku), 1, 6) as doc_id from {fx('bom')} x group by sku",
    "effectivity": f"select cast(year(effective_thru) as bigint) as year, effective_thru >= date '1998-01-01' as active, count(*) as n, count(*) as same from {fx('bom')} x group by 1, 2",
    "cosine_pairs": "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(head as double[])), 5) as cosine from embeddings join (select label, min_by(embedding, vec_id) as head from embeddings group by label) h using (label)",
    "change_kinds": f"select kind, case when upper(proposed) = 'DELETE' and actual <> '' then 'DELETE' when actual = '' then 'ADD' when proposed <> actual then 'SUBSTITUTE' else 'MODIFY' end as derived, count(*) as n from {fx('changes')} x group by 1, 2",
    "exact_pairs": f"with {sides()} select a.pair, a.item_ord as a_ord, b.item_ord as b_ord from a join b on a.pair = b.pair and a.key = b.key where a.key <> ''",
    "greedy_assignment": f"with {sides()} select pair, a_ord, b_ord from p",
    "dictionary_pairs": f"""with {sides('label_fuzzy')}, n as (select distinct upper(split_part(p_name, ' ', 2)) as noun, upper(split_part(p_name, ' ', 1)) as adj, p_size from part), r as (select concat_ws('-', 'REL', noun, adj, cast(p_size as varchar)) as id, length(noun) + length(adj) as k, {_PLAIN} as c, {_STERILE} as s from n where p_size % 4 <> 0),
        keys as (select distinct id, k, array_to_string(list_sort(x), ' ') as key from (select id, k, c as x from r union all select id, k, s from r) z)
        select a.pair, a.item_ord as a_ord, b.item_ord as b_ord, min_by(ka.id, (case when ka.k % 3 = 0 then 0 else 1 end, ka.id)) as relationship_id, false as confirm from a join b on a.pair = b.pair join keys ka on ka.key = a.key join keys kb on kb.key = b.key and kb.id = ka.id where ka.k % 3 <> 0 or regexp_extract(a.sku, '^(\\d+)', 1) = '5' group by 1, 2, 3""",
    "numeric_guard": f"with {sides('label_fuzzy')}, na as (select pair, {numbers('t')} as x from a), nb as (select pair, {numbers('t')} as y from b) select len(x) > 0 and len(y) > 0 and not list_has_all(x, y) and not list_has_all(y, x) as conflict, count(*) as n from na join nb using (pair) group by 1",
    "fuzzy_scores": FUZZY + " select pair, a_ord, b_ord, round(score, 4) as score, round(score, 4) < 0.85 as weak, len(nx) > 0 and len(ny) > 0 and not list_has_all(nx, ny) and not list_has_all(ny, nx) as conflict from scored where round(score, 4) >= 0.6",
    "ambiguous_lines": f"""with {sides()}, own as (select a.pair, a.item_ord as a_ord, b.item_ord as b_ord from a join b on a.pair = b.pair and a.key = b.key)
        select own.pair, own.a_ord, own.b_ord, 'alternative' as kind, cast(null as bigint) as holder from own join p on p.pair = own.pair and p.a_ord = own.a_ord where p.b_ord <> own.b_ord
        union all select f.pair, f.a_ord, f.b_ord, 'best is taken', cast(p.a_ord as bigint) from (select own.pair, own.a_ord, min(own.b_ord) as b_ord from own anti join p on p.pair = own.pair and p.a_ord = own.a_ord group by 1, 2) f left join p on p.pair = f.pair and p.b_ord = f.b_ord""",
    "pairing_check": f"with {results()} select pair, role, a_ord, b_ord, item_number, classification, level, score, discrepancies, requires_validation from out",
    "merge_duplicates": f"select pair, item_number, min(item_ord) as item_ord, case when count(q) = count(*) then cast(sum(q) as decimal(18,6)) end as quantity, min(confidence) as confidence, count(*) as merged_rows from (select *, case when cast(item_number as bigint) % 37 <> 0 then quantity end as q from {fx('pieces')} x) y group by pair, item_number",
    "comparable_lines": f"select pair, item_ord, item_number, case when cast(item_number as bigint) % 9 = 0 then 'category' when quantity <= 0 then 'zero quantity' else 'inactive' end as reason from {fx('pieces')} x where cast(item_number as bigint) % 9 = 0 or quantity <= 0 or effective_thru < date '1998-01-01'",
    "header_references": f"select pair, case when ref is null then 'MISSING' when regexp_extract(ref, '^(\\d+)', 1) = regexp_extract(parent, '^(\\d+)', 1) then 'EXACT' else 'MISMATCH' end as classification, case when ref is not null and regexp_extract(ref, '^(\\d+)', 1) = regexp_extract(parent, '^(\\d+)', 1) then '' else 'REF_PARENT_MISMATCH:BLOCKER' end as discrepancies from {fx('sets')} x",
    "drawing_reference": f"select d.pair, d.number, d.revision, nullif(regexp_extract(upper(l.line), '\\bREV\\.?\\s*([A-Z0-9]+)', 1), '') as told, case when l.line is null then 'MISSING' when nullif(regexp_extract(upper(l.line), '\\bREV\\.?\\s*([A-Z0-9]+)', 1), '') <> d.revision then 'MISMATCH' else 'EXACT' end as classification from {fx('drawings')} d left join (select l.pair, min_by(l.description, l.item_ord) as line from {fx('drawing_lines')} l join {fx('drawings')} d on l.pair = d.pair and contains(upper(l.description), d.number) group by l.pair) l on l.pair = d.pair",
    "coverage_anti": f"select c.form, c.code, coalesce(b.n, 0) as boms, case when b.n is null then 'MISSING' when b.n > 1 then 'POTENTIAL' else 'EXACT' end as classification from {fx('codes')} c left join (select parent, count(*) as n from {fx('bom_docs')} x group by parent) b on b.parent = c.code",
    "change_applied": f"""with l as (select * from {fx('change_lines')} x), c as (select *, cast(nullif(seq_proposed, '') as decimal(18,6)) as wanted, cast(qty_proposed as decimal(18,6)) as qty from {fx('changes')} x),
        r as (select c.*, (select count(*) from l where l.code = c.code and l.item_number = c.actual and l.active) as a_rows, (select count(*) from l where l.code = c.code and l.item_number = c.proposed and l.active) as p_rows,
            (select min_by(struct_pack(q := l.quantity, s := l.oper_seq, m := l.redline), case when coalesce(cast(l.oper_seq as decimal(18,6)) = c.wanted, false) then 0 else 1000 end + l.item_ord) from l where l.code = c.code and l.item_number = c.actual and l.active) as a,
            (select min_by(struct_pack(q := l.quantity, s := l.oper_seq, m := l.redline), case when coalesce(cast(l.oper_seq as decimal(18,6)) = c.wanted, false) then 0 else 1000 end + l.item_ord) from l where l.code = c.code and l.item_number = c.proposed and l.active) as p,
            (select count(*) from l where l.code = c.code and l.redline = c.proposed and l.active) > 0 as marked from c),
        z as (select *, case when kind = 'MODIFY' then a_rows else p_rows end as n, case when kind = 'MODIFY' then a else p end as row from r),
        f as (select *, coalesce(qty <> row.q, true) or coalesce(wanted <> cast(row.s as decimal(18,6)), wanted is not null) as differs from z),
        v as (select *, case when kind = 'DELETE' then case when a_rows > 0 and a.m = 'DELETE' then 'POTENTIAL' when a_rows > 0 then 'MISMATCH|PCO_CHANGE_NOT_APPLIED' else 'EXACT' end
            when kind = 'SUBSTITUTE' then case when a_rows > 0 and p_rows = 0 and a.m = proposed then 'POTENTIAL' when a_rows > 0 or p_rows = 0 then 'MISMATCH|PCO_CHANGE_NOT_APPLIED' when differs then 'MISMATCH|PCO_QTY_SEQ_MISMATCH' else 'EXACT' end
            when kind = 'ADD' then case when n = 0 and marked then 'POTENTIAL' when n = 0 then 'MISMATCH|PCO_CHANGE_NOT_APPLIED' when n > 1 and wanted is null then 'POTENTIAL' when differs then 'MISMATCH|PCO_QTY_SEQ_MISMATCH' else 'EXACT' end
            else case when n = 0 then 'MISMATCH|PCO_CHANGE_NOT_APPLIED' when n > 1 and wanted is null then 'POTENTIAL' when differs and a.m = qty_proposed then 'POTENTIAL' when differs then 'MISMATCH|PCO_QTY_SEQ_MISMATCH' else 'EXACT' end end as w from f)
        select form, code, change_ord, kind, split_part(w, '|', 1) as classification, nullif(split_part(w, '|', 2), '') as discrepancy from v""",
    "violations": "select rule, count(*) as n, count(distinct key) as keys from (select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar)) as key, unnest(list_filter([case when not l_quantity < 50 then 'quantity' end, case when not l_discount between 0 and 0.09 then 'discount' end, case when l_returnflag not in ('A', 'N') then 'flag' end], lambda x: x is not null)) as rule from lineitem) x group by 1",
    "run_summary": f"with {results()} select 'BOM_LABEL' as \"check\", count(*) filter (classification = 'EXACT') as exact, count(*) filter (classification = 'EQUIVALENT') as equivalent, count(*) filter (classification = 'POTENTIAL') as potential, count(*) filter (classification = 'MISMATCH') as mismatch, count(*) filter (classification = 'MISSING') as missing, count(*) filter (requires_validation) as needs_validation, count(*) filter (not requires_validation) as cleared, cast(0 as bigint) as exempt, cast(0 as bigint) as blockers from out",
    "set_rollup": f"with {results()} select sku, count(*) as n_rows, count(*) filter (requires_validation) as needs_validation, cast(0 as bigint) as blockers, case when count(*) filter (requires_validation) > 0 then 'NEEDS REVIEW' else 'AUTO-CLEARED' end as status from out group by rollup (sku)",
    "discrepancy_by_type": f"with {results()} select split_part(x, ':', 1) as type, count(*) as n, case when max(case when x like '%:MAJOR' then 1 else 0 end) = 1 then 'MAJOR' else 'INFO' end as worst from (select unnest(d) as x from res) y group by 1",
    "queue_page": f"with {results()} select row_id, classification from out order by case when len(list_filter(d, lambda x: x like '%:MAJOR')) > 0 then 2 when len(d) > 0 then 4 else 9 end, not discrepancies like '%AMBIGUOUS%', classification <> 'POTENTIAL', not discrepancies like '%LOW_EX%', sku, row_id limit 200 offset 100",
    "run_diff": f"""with {results()}, {results('z', 'pair % 9 <> 0', 'l_partkey % 10 <> 3 and pair % 9 <> 0')},
        f as (select *, row_number() over (partition by comparison_key order by row_id) as k, array_to_string(d, ',') as kinds from out), g as (select *, row_number() over (partition by comparison_key order by row_id) as k, array_to_string(d, ',') as kinds from zout),
        c as (select sku from out intersect select sku from zout),
        x as (select coalesce(f.sku, g.sku) as sku, f.row_id is not null as there, g.row_id is not null as here, coalesce(f.kinds <> '', false) as had, coalesce(g.kinds <> '', false) as has, f.classification is distinct from g.classification or f.requires_validation is distinct from g.requires_validation as differs from f full outer join g on f.comparison_key = g.comparison_key and f.k = g.k)
        select status, count(*) as n, count(distinct sku) as sets from (select x.sku, case when c.sku is null then 'not_covered' when there and not here then 'gone' when not there and has then 'new' when not there then 'changed' when had and not has then 'resolved' when not had and has then 'new' when had then 'still_open' when differs then 'changed' else 'unchanged' end as status from x left join c on c.sku = x.sku) y group by 1""",
    "verify_close": f"""with {results()}, {results('z', 'pair % 9 <> 0', 'l_partkey % 10 <> 3 and pair % 9 <> 0')}, bad as (select comparison_key, bool_or(len(list_filter(d, lambda x: x not like '%:INFO')) > 0) as bad from zout group by 1), cov as (select distinct sku from zout)
        select case when cov.sku is null then 'NOT_COVERED' when coalesce(bad.bad, false) then 'STILL_OPEN' else 'RESOLVED' end as outcome, count(*) as n from out left join cov on cov.sku = out.sku left join bad on bad.comparison_key = out.comparison_key where len(d) > 0 group by 1""",
    "business_case": f"""with {results()}, n as (select count(distinct sku) as sets, count(*) filter (requires_validation) as needs, count(*) filter (not requires_validation) as cleared, count(*) filter (requires_validation and classification = 'POTENTIAL' and len(d) = 0 and score >= 0.95) as confirmable from out),
        m as (select *, (needs * 3.0 + cleared * 0.25) / sets as minutes, ((needs - confirmable) * 3.0 + (cleared + confirmable) * 0.25) / sets as later, (needs + cleared) * 1.0 / sets as base from n)
        select sets, needs, cleared, confirmable, 'assumed' as basis, round(cast(minutes as double), 2) as minutes, round(cast(base as double), 2) as baseline, round(cast(100 * (base - minutes) / base as double), 1) as reduction, round(cast(later as double), 2) as projected, round(cast(100 * (base - later) / base as double), 1) as projected_reduction,
        round(cast((base - minutes) * 20 * 2 / 60 as double), 1) as hours, round(round(cast((base - minutes) * 20 * 2 / 60 as double), 1) * 60 * 12, 0) as yearly from m""",
    "prf_metrics": f"""with {results()}, got as (select distinct pair % 7 as part, pair, item_number, split_part(x, ':', 1) as type from (select pair, item_number, unnest(d) as x from res where item_number is not null) y),
        want as (select distinct pair % 7 as part, pair, item_number, case when l_partkey % 11 = 0 then 'MISSING_IN_LABEL' else 'QTY_MISMATCH' end as type from {fx('bom')} b where l_partkey % 11 = 0 or l_partkey % 13 = 0),
        x as (select coalesce(got.type, want.type) as type, coalesce(got.part, want.part) as part, got.pair is not null as p, want.pair is not null as e from got full outer join want on got.pair = want.pair and got.item_number = want.item_number and got.type = want.type),
        g as (select type, part, count(*) filter (p and e) as tp, count(*) filter (p and not e) as fp, count(*) filter (e and not p) as fn from x group by grouping sets ((), (type), (part))),
        m as (select *, case when tp + fp > 0 then tp / cast(tp + fp as double) when fn = 0 then 1.0 else 0.0 end as pr, case when tp + fn > 0 then tp / cast(tp + fn as double) else 1.0 end as re from g)
        select type, part, tp, fp, fn, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end, 6) as f1 from m""",
    "latest_decision": f"select row_id, slot, decision, override, event_id from (select *, row_number() over (partition by row_id, slot order by decided_at desc, event_id desc) as k from {fx('decisions')} x) y where k = 1",
    "row_state": f"with {STATES} select row_id, state, coalesce(case when d2 = 'OVERRIDE' then o2 end, case when d1 = 'OVERRIDE' then o1 end, classification) as effective, d1, d2 from st",
    "blind_view": f"with {STATES} select case when d2 is null then 'ENGINE_RECOMMENDED' else state end as state, count(*) as n, count(case when d2 is not null then d1 end) as seen from st group by 1",
    "bulk_accept": "select 'run' as run_id, event_id as row_id from events where user_id % 5 < 2 and not (event_type in ('purchase', 'click', 'error') and event_id % 2 = 0)",
    "review_timing": """with s as (select p.user_id, p.ts, epoch_us(p.ts) - epoch_us(max(v.ts)) as us from (select user_id, ts from events where event_type = 'purchase') p join (select user_id, ts from events where event_type = 'view') v on v.user_id = p.user_id and v.ts <= p.ts group by p.user_id, p.ts)
        select user_id, count(*) as samples, round(median(round(us / 1e6, 3)), 1) as median_s, round(avg(round(us / 1e6, 3)), 1) as mean_s from s where us / 1e6 between 5 and 86400 group by 1""",
    "term_current": f"with {VERSIONS} select id, version, canonical, active from (select *, row_number() over (partition by id order by version desc) as k from v) x where k = 1 and not deleted",
    "term_pinned": f"with {VERSIONS} select 'run' || cast(p_partkey % 7 as varchar) as run_id, v.id, v.version, v.canonical, v.deleted from part join v on v.id = 'REL-' || case when p_partkey < 100 then lpad(cast(p_partkey as varchar), 3, '0') else cast(p_partkey as varchar) end and v.version = 1 + p_partkey % 2",
    "term_next_id": f"with {VERSIONS} select coalesce(max(cast(regexp_extract(id, '^REL-(\\d+)$', 1) as bigint)), 0) + 1 as next from v",
    "document_sets": f"""with {DOCS_KEPT} select set_key as set, coalesce(min_by(sku, doc) filter (doc_type = 'BOM' and sku is not null), min_by(sku, doc) filter (doc_type = 'LABEL' and sku is not null), set_key) as sku, count(*) as documents,
        case when count(*) filter (doc_type = 'BOM') = 0 then 'MISSING_BOM' when count(*) filter (doc_type = 'LABEL') = 0 then 'MISSING_LABEL' else 'OK' end as coverage,
        array_to_string(list_filter([case when count(*) filter (doc_type = 'BOM') = 0 then 'no bill of materials' end, case when count(*) filter (doc_type = 'LABEL') = 0 then 'no label' end, case when count(*) filter (doc_type = 'BOM') > 1 then 'several bills of materials' end, case when count(*) filter (doc_type = 'LABEL') > 1 then 'several labels' end], lambda x: x is not null), ';') as warnings from docs group by set_key""",
    "document_pairs": f"""with {DOCS_KEPT}, k as materialized (select set_key, doc, doc_type from docs)
        select x.set_key as set, 'BOM_LABEL' as "check", x.doc as a_doc, y.doc as b_doc from k x join k y on y.set_key = x.set_key where x.doc_type = 'BOM' and y.doc_type = 'LABEL'
        union all select x.set_key, 'BOM_DRAWING', x.doc, y.doc from k x join k y on y.set_key = x.set_key where x.doc_type = 'BOM' and y.doc_type = 'DRAWING'
        union all select x.set_key, 'LABEL_DRAWING', x.doc, y.doc from k x join k y on y.set_key = x.set_key where x.doc_type = 'LABEL' and y.doc_type = 'DRAWING'""",
    "header_discovery": f"with {CELLS} select file, row as header_row, name, cast(col_no as bigint) as col_no from head",
    "header_values": f"with {CELLS} select distinct file, 'parent' as name, 'P' || cast(file as varchar) as value from head",
    "table_lines": f"with {CELLS} select i.file, x.text as description, count(*) as n, min(i.text) as least from cells i join head h on h.file = i.file and h.name = 'component_item' and i.col = h.col_no and i.row > h.row join head g on g.file = i.file and g.name = 'description' join (select file, row, col, nullif(trim(text), '') as text from cells) x on x.file = i.file and x.row = i.row and x.col = g.col_no where i.text <> '' group by 1, 2",
    "line_grouping": f"""with recursive {WORDS}, c as (select distinct doc_id, y0 + 5 as cy from (select doc_id, (y0 + (y0 + cast(10.0 as double))) / 2 - 5 as y0 from words) q), r as (select doc_id, min(cy) as a, 1 as line from c group by doc_id union all select r.doc_id, (select min(c.cy) from c where c.doc_id = r.doc_id and c.cy - r.a > 3.0) as a, r.line + 1 from r where exists (select 1 from c where c.doc_id = r.doc_id and c.cy - r.a > 3.0)),
        e as (select *, lead(a) over (partition by doc_id order by line) as nxt from r)
        select w.doc_id, cast(e.line as bigint) as line, count(*) as n, max(w.x1) as x1 from (select *, (y0 + (y0 + cast(10.0 as double))) / 2 as cy from words) w join e on e.doc_id = w.doc_id and w.cy >= e.a - 1e-9 and (e.nxt is null or w.cy < e.nxt - 1e-9) group by 1, 2""",
    "gap_split": f"with {WORDS}, g as (select doc_id, ln, coalesce(x0 - lag(x1) over (partition by doc_id, ln order by x0, x1, text) > 20, false) as wide from words) select doc_id, cast(ln as bigint) as line, 1 + count(*) filter (wide) as parts, count(*) as n from g group by 1, 2",
    "nearest_band": f"""with {WORDS}, m as (select *, (x0 + x1) / 2 as cx, doc_id % 10 as o from words),
        f as (select doc_id, greatest(o - 2 - cx, cx - (148 + o), 0) as d0, greatest(148 + o - cx, cx - (698 + o), 0) as d1, greatest(698 + o - cx, 0) as d2 from m)
        select doc_id, case when d0 <= d1 and d0 <= d2 then 'item' when d1 <= d2 then 'desc' else 'qty' end as name, count(*) as n from f group by 1, 2""",
    "spread_words": "with t as (select item_id, replace(text, chr(10), ' ') as text from benchmark) select item_id as doc_id, cast(len(string_split(text, ' ')) as bigint) as n, 1000.0::double as \"right\", round(1000.0::double / length(text) * length(replace(text, ' ', '')), 3) as width from t where length(text) > 0",
    "stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2",
    "stream_sessions": "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k",
    "stream_timing": "select v.user_id, count(*) as n from (select * from events where event_type = 'view') v join (select * from events where event_type = 'purchase') p on p.user_id = v.user_id and p.ts >= v.ts + interval 5 seconds and p.ts <= v.ts + interval 86400 seconds group by 1",
    "stream_latest_decision": f"select row_id, event_id, decision from (select *, row_number() over (partition by row_id order by decided_at desc, event_id desc) as k from {fx('decisions')} x) y where k = 1",
}


# --- assignment over similarity -------------------------------------------------------------------

_SCORED = "select pair, a_ord, b_ord, cast(round(score, 4) as double) as score, round(score, 4) < 0.85 as weak, len(nx) > 0 and len(ny) > 0 and not list_has_all(nx, ny) and not list_has_all(ny, nx) as conflict from scored where round(score, 4) >= 0.6"


def folded(candidates: str) -> str:
    """The ordered one-to-one choice among candidates (pair, a_ord, b_ord, level_rank, score, level), pair by pair, as a fold over a sorted list."""
    return f"""select pair, x.a as a_ord, x.b as b_ord, x.v as level, x.s as score from (select pair, unnest(list_reduce(list_transform(l, lambda c: [c]), lambda acc, x: case when len(list_filter(acc, lambda y: y.a = x[1].a or y.b = x[1].b)) > 0 then acc else list_concat(acc, x) end)) as x
        from (select pair, list(struct_pack(a := a_ord, b := b_ord, v := level, s := score) order by level_rank desc, score desc, a_ord, b_ord) as l from ({candidates}) c group by pair) g)"""


_TERMS = ORACLE_SQL["dictionary_pairs"].split(", n as (", 1)[1]
_TERM_CTES, _TERM_SELECT = "n as (" + _TERMS.rsplit("select a.pair", 1)[0].rstrip(), "select a.pair" + _TERMS.rsplit("select a.pair", 1)[1]
_TERM_FREE = _TERM_SELECT.replace("from a join b", "from fa a join fb b")

ORACLE_SQL["ladder_levels"] = f"""{FUZZY}, {_TERM_CTES}, dic as ({_TERM_FREE}), fz as ({_SCORED}),
    every as (select pair, a_ord, b_ord, 2 as level_rank, cast(1 as double) as score, 'RELATIONSHIP' as level from dic union all select fz.pair, fz.a_ord, fz.b_ord, 1, fz.score, 'FUZZY' from fz anti join dic on dic.pair = fz.pair and dic.a_ord = fz.a_ord and dic.b_ord = fz.b_ord where not weak and not conflict)
    select pair, a_ord, b_ord, 'EXACT' as level, cast(1.0 as double) as score from p union all select pair, a_ord, b_ord, level, cast(score as double) from ({folded('select * from every')})"""
_MATCHED = f"fz as ({_SCORED}), chosen as ({folded("select pair, a_ord, b_ord, 1 as level_rank, score, 'FUZZY' as level from fz where not weak and not conflict")})"
ORACLE_SQL["hint_lines"] = f"""{FUZZY}, {_MATCHED}
    select pair, a_ord as item_ord, b_ord as hint_ord, cast(score as double) as hint_score from (select fz.*, row_number() over (partition by fz.pair, fz.a_ord order by score desc, b_ord) as k from fz anti join chosen on chosen.pair = fz.pair and chosen.a_ord = fz.a_ord) h where k = 1"""
_MINED = f"""{FUZZY}, {_MATCHED}, mined as (select fa.key as a_key, fb.key as b_key, count(distinct c.pair) as sets, count(*) as rows, count(*) filter (c.a_ord % 2 <> 0) as would_clear, count(*) filter (c.a_ord % 2 = 0) as still_review, array_to_string(list_sort(list(distinct fa.item_number)), ',') as item_anchors
    from chosen c join fa on fa.pair = c.pair and fa.item_ord = c.a_ord join fb on fb.pair = c.pair and fb.item_ord = c.b_ord group by 1, 2)"""
ORACLE_SQL["mining"] = _MINED + " select a_key, b_key, sets, rows, would_clear, still_review, item_anchors from mined"
ORACLE_SQL["worklist_cumulative"] = _MINED + """ select row_number() over w as rank, a_key, b_key, would_clear, cast(sum(would_clear) over w as bigint) as running, round(cast(sum(would_clear) over w as double) / sum(would_clear) over (), 4) as share from mined
    window w as (order by would_clear desc, sets desc, a_key, b_key rows unbounded preceding)"""
ORACLE_SQL["revision_check"] = f"""with {sides()}, own as (select p.pair, p.a_ord, p.b_ord, p.key, a.quantity = b.quantity as same from p join a on a.pair = p.pair and a.item_ord = p.a_ord join b on b.pair = p.pair and b.item_ord = p.b_ord),
    gone as (select a.pair, a.item_ord, a.key, row_number() over (partition by a.pair, a.key order by a.item_ord) as k from a anti join p on p.pair = a.pair and p.a_ord = a.item_ord),
    fresh as (select b.pair, b.item_ord, b.key from b anti join p on p.pair = b.pair and p.b_ord = b.item_ord),
    want as (select x.pair, x.item_ord as exp_ord, a.key, row_number() over (partition by x.pair, a.key order by x.item_ord) as k from {fx('bom')} x join a on a.pair = x.pair and a.item_ord = x.item_ord where x.l_partkey % 22 = 0)
    select pair, case when same then 'UNCHANGED' else 'QTY' end as change, key as norm_key, a_ord, b_ord, cast(null as int) as exp_ord, case when same then 'EXACT' else 'MISMATCH' end as classification from own
    union all select g.pair, 'REMOVED', g.key, g.item_ord, null, w.exp_ord, case when w.exp_ord is null then 'MISMATCH' else 'EXACT' end from gone g left join want w on w.pair = g.pair and w.key = g.key and w.k = g.k
    union all select pair, 'ADDED', key, null, item_ord, null, 'MISMATCH' from fresh
    union all select w.pair, case when b.key is null then 'SATISFIED' else 'ABSENT' end, w.key, null, null, w.exp_ord, case when b.key is null then 'EXACT' else 'MISSING' end from want w anti join gone g on g.pair = w.pair and g.key = w.key and g.k = w.k left join (select distinct pair, key from b) b on b.pair = w.pair and b.key = w.key"""
ORACLE_SQL["stream_unrepeated"] = "select event_type, count(distinct event_id) as n from events group by 1"

# --- queries of plans/more.py ---------------------------------------------------------------------

_TYPE = "list_filter(list_transform(d, lambda x: split_part(x, ':', 1)), lambda x: x is not null)"
_WORST = "case when len(list_filter(d, lambda x: x like '%:MAJOR')) > 0 then 'MAJOR' when len(list_filter(d, lambda x: x like '%:MINOR')) > 0 then 'MINOR' when len(d) > 0 then 'INFO' end"
_QUEUE = f"case {_WORST.replace('case ', 'case ', 1)} when 'MAJOR' then 2 when 'MINOR' then 3 when 'INFO' then 4 else 9 end, not list_contains({_TYPE}, 'AMBIGUOUS_MATCH'), classification <> 'POTENTIAL', not list_contains({_TYPE}, 'LOW_EXTRACTION_CONFIDENCE'), sku, row_id"
_EXPECTED = f"""want as (select pair, sku, item_number, case when min(l_partkey) % 11 = 0 then 'MISSING' when min(l_partkey) % 13 = 0 then 'MISMATCH' else 'EXACT' end as want, case when min(l_partkey) % 11 = 0 then ['MISSING_IN_LABEL'] when min(l_partkey) % 13 = 0 then ['QTY_MISMATCH'] else [] end as e from {fx('bom')} b group by pair, sku, item_number),
    last as (select sku, item_number, max_by(classification, row_id) as got, max_by(d, row_id) as d, max(row_id) as row_id from out where item_number is not null group by 1, 2),
    sc as (select w.sku, w.item_number as a_key, w.want, l.got, w.e, coalesce(l.d, []) as d, l.row_id, true as expected, l.row_id is not null as produced from want w left join last l on l.sku = w.sku and l.item_number = w.item_number
        union all select o.sku, o.item_number, null, o.classification, [], o.d, o.row_id, false, true from out o anti join last l on l.row_id = o.row_id),
    fl as (select sku, a_key, list_distinct(list_filter(list_transform(list_filter(d, lambda x: x not like '%:INFO' or list_contains(e, split_part(x, ':', 1))), lambda x: split_part(x, ':', 1)), lambda x: x is not null)) as g, e from sc),
    flags as (select sku, a_key, unnest(list_intersect(g, e)) as type, 'tp' as outcome from fl union all select sku, a_key, unnest(list_filter(g, lambda x: not list_contains(e, x))), 'fp' from fl union all select sku, a_key, unnest(list_filter(e, lambda x: not list_contains(g, x))), 'fn' from fl)"""

ORACLE_SQL |= {
    "evaluation_flags": f"with {results()}, {_EXPECTED} select type, outcome, count(*) as n, count(distinct sku) as sets from flags group by 1, 2",
    "evaluation_metrics": f"""with {results()}, {_EXPECTED}, g as (select type, sku, count(*) filter (outcome = 'tp') as tp, count(*) filter (outcome = 'fp') as fp, count(*) filter (outcome = 'fn') as fn from flags group by grouping sets ((), (type), (sku))),
        m as (select *, case when tp + fp > 0 then tp / cast(tp + fp as double) when fn = 0 then 1.0 else 0.0 end as pr, case when tp + fn > 0 then tp / cast(tp + fn as double) else 1.0 end as re from g)
        select type, sku, tp, fp, fn, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end, 6) as f1 from m""",
    "evaluation_accuracy": f"""with {results()}, {_EXPECTED}, n as (select count(*) as scored, count(*) filter (produced) as n_produced, count(*) filter (produced and want = got) as n_classified from sc where expected)
        select "check", scored, n_produced, n_classified, round(n_classified / cast(scored as double), 4) as classification from n, (values ('BOM_LABEL'), (null)) c("check")""",
    "evaluation_disagreements": f"""with {results()}, {_EXPECTED} select sku, sku || ' BOM_LABEL' || coalesce(' ' || a_key, '') || case when outcome = 'fp' then ': unexpected discrepancy ' else ': expected discrepancy not reported ' end || type as said from flags where outcome <> 'tp'
        union all select sku, sku || ' BOM_LABEL ' || a_key || ': classified ' || got || ', expected ' || want from sc where expected and produced and want <> got union all select sku, sku || ' BOM_LABEL ' || a_key || ': no result row produced' from sc where expected and not produced""",
    "coverage_scoring": f"""with got as (select c.form, c.code from {fx('codes')} c anti join {fx('bom_docs')} b on b.parent = c.code), want as (select distinct form, 'X' || cast(form as varchar) as code from {fx('codes')} c where form % 3 <> 0)
        select case when g.code is null then 'fn' when w.code is null then 'fp' else 'tp' end as outcome, count(*) as n from (select distinct form, code from got) g full outer join want w on w.form = g.form and w.code = g.code group by 1""",
    "reference_scoring": f"select case when ref is null then 'MISSING' when coalesce(nullif(regexp_extract(parent, '^(\\d+)', 1), ''), parent) = coalesce(nullif(regexp_extract(ref, '^(\\d+)', 1), ''), ref) then 'EXACT' else 'MISMATCH' end as got, pair % 2 = 0 as wants_exact, count(*) as n, count(*) filter (case when pair % 2 = 0 then ref is not null and coalesce(nullif(regexp_extract(parent, '^(\\d+)', 1), ''), parent) = coalesce(nullif(regexp_extract(ref, '^(\\d+)', 1), ''), ref) else ref is null or coalesce(nullif(regexp_extract(parent, '^(\\d+)', 1), ''), parent) <> coalesce(nullif(regexp_extract(ref, '^(\\d+)', 1), ''), ref) end) as correct from {fx('sets')} s group by 1, 2",
    "result_filter": f"with {results()} select row_id, classification from out where requires_validation and list_contains({_TYPE}, 'QTY_MISMATCH') and {_WORST} = 'MAJOR'",
    "result_search": f"with {results()}, dsc as (select out.*, a.description as a_description from out left join a on a.pair = out.pair and a.item_ord = out.a_ord) select row_id from dsc where contains(lower(coalesce(a_description, '')), 'red') or contains(lower(coalesce(b_description, '')), 'red') or contains(lower(coalesce(item_number, '')), 'red')",
    "result_page": f"with {results()} select row_id, classification, (select count(*) from out where classification <> 'EXACT') as total from out where classification <> 'EXACT' order by {_QUEUE} limit 50 offset 25",
    "result_brief": f"with {results()} select row_id, level, array_to_string({_TYPE}, ',') as types, {_WORST} as severity, item_number as item, b_ord is not null as has_b from out",
    "check_report": f"with {results()} select row_id, coalesce({_WORST}, '') as severity, array_to_string({_TYPE}, '; ') as types, case when requires_validation then 'YES' else 'NO' end as validation from out",
    "audit_of_run": f"with {results()} select sku, 'check.bom_label' as action, 'rows=' || count(*) || ' needs_validation=' || count(*) filter (requires_validation) as detail from out group by sku",
    "manual_checks": f"with {results()} select what, count(distinct sku) as sets from out, (values ('artwork against the approved redline'), ('symbols and warnings'), ('barcode content')) m(what) group by 1",
    "diff_rows": ORACLE_SQL["run_diff"].split("select status, count(*) as n")[0] + """, y as (select x.sku, x.key, x.k, case when c.sku is null then 'not_covered' when there and not here then 'gone' when not there and has then 'new' when not there then 'changed' when had and not has then 'resolved' when not had and has then 'new' when had then 'still_open' when differs then 'changed' else 'unchanged' end as status from (select coalesce(f.comparison_key, g.comparison_key) as key, coalesce(f.k, g.k) as k, coalesce(f.sku, g.sku) as sku, f.row_id is not null as there, g.row_id is not null as here, coalesce(f.kinds <> '', false) as had, coalesce(g.kinds <> '', false) as has, f.classification is distinct from g.classification or f.requires_validation is distinct from g.requires_validation as differs from f full outer join g on f.comparison_key = g.comparison_key and f.k = g.k) x left join c on c.sku = x.sku)
        select status, sku, comparison_key, place from (select status, sku, key as comparison_key, row_number() over (partition by status order by sku, key, k) as place from y) z where place <= 20""",
    "set_changes": f"with {results()}, {results('z', 'pair % 9 <> 0', 'l_partkey % 10 <> 3 and pair % 9 <> 0')} select case when z.sku is null then 'removed' when o.sku is null then 'added' else 'common' end as status, count(*) as n from (select distinct sku from out) o full outer join (select distinct sku from zout) z on z.sku = o.sku group by 1",
    "row_ids": f"select pair, item_ord, 'R-' || sku || '-' || left(sha256(cast(pair as varchar) || '|label'), 4) || '-' || case when n < 100 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as row_id from (select *, row_number() over (partition by pair order by item_ord) as n from {fx('pieces')} p) x",
    "comparison_keys": f"with {sides()} select 'BOM_LABEL|' || sku || '|A:' || item_number as key, count(*) as n from a group by 1 union all select 'BOM_LABEL|' || cast(pair as varchar) || 'NS|B:' || key, count(*) from b group by 1",
    "change_key_counts": f"select kind || ':' || case kind when 'DELETE' then actual when 'ADD' then proposed when 'SUBSTITUTE' then actual || '->' || proposed else actual end as key, count(*) as n from {fx('changes')} c group by 1",
    "list_cells": "select event_id, array_to_string(list_filter(list_transform(regexp_split_to_array(event_type || '; ' || cast(user_id as varchar) || ', x', '[;\\n,]'), lambda x: trim(x)), lambda x: x <> ''), '|') as parts, array_to_string(list_filter(list_transform(regexp_split_to_array(event_type || '; ' || cast(user_id as varchar) || ', x', '[;\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') as aliases from events",
    "relative_paths": "select url, case when starts_with(url, 'https:/') then substr(url, 8) else url end as path from pages",
    "term_history": f"with {VERSIONS}, h as (select *, lag(active) over (partition by id order by version) as was, lag(deleted) over (partition by id order by version) as gone from v) select case when deleted then 'delete' when was is null or gone then 'create' when active and not was then 'activate' when not active and was then 'deactivate' else 'update' end as change, count(*) as n from h group by 1",
    "term_search": f"with {VERSIONS} select id, canonical from (select *, row_number() over (partition by id order by version desc) as k from v) x where k = 1 and not deleted and active and (contains(lower(canonical), '7') or contains(lower(id), '7'))",
    "term_import": f"with {VERSIONS}, cur as (select * from (select *, row_number() over (partition by id order by version desc) as k from v) x where k = 1 and not deleted) select case when p_partkey % 10 = 0 then 'blank' when p_partkey % 10 = 1 then 'invalid' when cur.id is null then 'create' when p_partkey % 10 = 2 and cur.active then 'unchanged' else 'update' end as action, count(*) as n from part left join cur on cur.id = 'REL-' || case when p_partkey < 100 then lpad(cast(p_partkey as varchar), 3, '0') else cast(p_partkey as varchar) end group by 1",
    "state_counts": f"with {STATES} select state, count(*) as n from st group by 1",
    "row_history": f"with {STATES} select 'engine' as event, classification as said, count(*) as n from st group by 1, 2 union all select 'reviewer_' || slot, concat_ws(':', x.decision, x.override), count(*) from lastd group by 1, 2 union all select 'final', final, count(*) from {fx('finals')} f group by 1, 2",
    "decision_errors": "select case when event_type not in ('purchase', 'click', 'error') then 'unknown decision' when event_type = 'error' and event_id % 3 = 1 then 'OVERRIDE requires a classification' when event_id % 5 = 4 then 'x' end as e, count(*) as n from events where event_id % 5 <> 4 group by 1 union all select 'reviewer slot must be 1 or 2', count(*) from events where event_id % 5 = 4",
    "audit_log": "select user_id as actor, event_type as action, count(*) as n, max(ts) as last from events group by 1, 2",
    "newest_events": "select event_id, ts from events order by ts desc, event_id desc limit 100",
    "header_fields": "with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as o from documents where text is not null) select doc_id, 'first_number' as name, min_by(regexp_extract(t, '(\\d+)', 1), o) as value from l where regexp_matches(t, '\\d+') group by 1",
    "form_rows": f"with c as (select file, row, col, text from (select form as file, row_number() over (partition by form order by code) + 1 as row, 0 as col, code as text from {fx('codes')} x) y) select file, regexp_full_match(upper(text), '[A-Z0-9]{{5,14}}') as ok, count(*) as n from c group by 1, 2",
    "set_members": f"with {DOCS_KEPT} select set_key as set, array_to_string(list(cast(doc as varchar) order by doc_type, doc), ',') as members from docs group by 1",
    "drawing_relevant": f"select count(*) filter (category = 'PHYSICAL_COMPONENT') as physical, count(*) filter (category = 'PACKAGING') as packaging from (select *, case when cast(item_number as bigint) % 9 = 0 then 'LABEL' when cast(item_number as bigint) % 9 = 1 then 'PACKAGING' else 'PHYSICAL_COMPONENT' end as category, effective_thru >= date '1998-01-01' as active from {fx('pieces').replace("'PHYSICAL_COMPONENT' as category, true as active", '1 as one')} p) x where active and ((category = 'PHYSICAL_COMPONENT' and quantity > 0) or category = 'PACKAGING')",
    "expected_from_forms": f"""with own as (select c.*, x.sku from (select *, coalesce(nullif(proposed, ''), actual) as item from {fx('changes')} y) c join (select distinct form, code as sku from {fx('changes')} z) x on x.form = c.form where not (upper(item) like 'PK%' or upper(item) like 'MPS%')),
        h as (select sku, item_number, min_by(description, item_ord) as d from {fx('bom')} b group by 1, 2), w as (select item_number, min_by(description, (sku, item_ord)) as d from {fx('bom')} b group by 1)
        select case kind when 'DELETE' then 'REMOVE' when 'MODIFY' then 'QTY' else kind end as kind, count(*) as n, count(distinct own.sku) as sets, count(*) filter (kind = 'SUBSTITUTE' and coalesce(h.d, w.d) is not null) as named from own left join h on h.sku = own.sku and h.item_number = own.actual left join w on w.item_number = own.actual group by 1""",
    "document_list": f"with d as (select * from {fx('documents_fx')} x) select sku, count(*) as documents, array_to_string(list(doc_type || ':' || cast(doc as varchar) order by doc_type, doc), ',') as listed from d group by sku",
    "certificates": f"""with {STATES}, r as (select * from {fx('rows')} x), s as (select r.sku, count(*) as rows, count(*) filter (st.state = 'FINALIZED') as finalized, count(*) filter (st.state = 'DISAGREEMENT') as disagreements from r join st on st.row_id = r.row_id group by 1),
        l as (select r.sku, count(*) as decisions, count(*) filter (x.decision = 'ACCEPT') as accept, count(*) filter (x.decision = 'OVERRIDE') as override from lastd join r on r.row_id = lastd.row_id group by 1)
        select s.sku, rows, finalized, disagreements, coalesce(decisions, 0) as decisions, coalesce(accept, 0) as accept, coalesce(override, 0) as override from s left join l on l.sku = s.sku""",
}

_FUZZY_ALL = FUZZY.replace("from fa join fb on fa.pair = fb.pair", "from fa join b fb on fa.pair = fb.pair")
_TERM_ALL = _TERM_SELECT.replace("from a join b", "from fa a join b")
ORACLE_SQL["pairing_fuzzy"] = f"""{_FUZZY_ALL}, {_TERM_CTES}, exa as (select a.pair, a.item_ord as a_ord, b.item_ord as b_ord from a join b on a.pair = b.pair and a.key = b.key where a.key <> ''),
    dic as (select d.* from ({_TERM_ALL}) d anti join exa using (pair, a_ord, b_ord)), fz as (select s.* from ({_SCORED}) s anti join exa using (pair, a_ord, b_ord) anti join dic using (pair, a_ord, b_ord)),
    ok as (select pair, a_ord, b_ord, 3 as r, cast(1 as double) as score from exa union all select pair, a_ord, b_ord, 2, cast(1 as double) from dic union all select pair, a_ord, b_ord, 1, score from fz where not weak and not conflict),
    every as (select ok.pair, ok.a_ord, ok.b_ord, r as level_rank, score, case r when 2 then 'RELATIONSHIP' else 'FUZZY' end as level from ok semi join fa on fa.pair = ok.pair and fa.item_ord = ok.a_ord semi join fb on fb.pair = ok.pair and fb.item_ord = ok.b_ord where r < 3),
    own as (select pair, a_ord, b_ord, 'EXACT' as level, cast(1 as double) as score, 3 as r from p union all select pair, a_ord, b_ord, level, score, case level when 'RELATIONSHIP' then 2 else 1 end from ({folded('select * from every')})),
    alt as (select distinct o.pair, o.a_ord from own o join ok on ok.pair = o.pair and ok.a_ord = o.a_ord where ok.b_ord <> o.b_ord and ok.r = o.r and ok.score >= o.score - 0.05),
    x as (select case o.level when 'EXACT' then 'EXACT' when 'RELATIONSHIP' then 'EQUIVALENT' else 'POTENTIAL' end as base, o.level, a.quantity <> b.quantity as differs, alt.pair is not null as many, a.confidence < 0.7 as low, 'pair' as what
            from own o join a on a.pair = o.pair and a.item_ord = o.a_ord join b on b.pair = o.pair and b.item_ord = o.b_ord left join alt on alt.pair = o.pair and alt.a_ord = o.a_ord
        union all select 'MISSING', 'NONE', false, k.pair is not null, a.confidence < 0.7, 'a' from a anti join own on own.pair = a.pair and own.a_ord = a.item_ord left join (select distinct pair, a_ord from ok) k on k.pair = a.pair and k.a_ord = a.item_ord
        union all select 'MISSING', 'NONE', false, false, b.confidence < 0.7, 'b' from b anti join own on own.pair = b.pair and own.b_ord = b.item_ord)
    select case when differs and base in ('EXACT', 'EQUIVALENT') then 'MISMATCH' when what = 'pair' and many then 'POTENTIAL' else base end as classification, level,
        array_to_string(list_filter([case when many then 'AMBIGUOUS_MATCH:MAJOR' end, case when low then 'LOW_EXTRACTION_CONFIDENCE:INFO' end, case when what = 'b' then 'MISSING_IN_BOM:MAJOR' end, case when what = 'a' then 'MISSING_IN_LABEL:MAJOR' end,
            case when differs and base in ('EXACT', 'EQUIVALENT') then 'QTY_MISMATCH:MAJOR' when differs then 'QTY_MISMATCH:MINOR' end], lambda v: v is not null), ';') as discrepancies, count(*) as n from x group by 1, 2, 3"""
