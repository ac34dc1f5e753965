"""Tables of lines, documents, forms, words and reviews derived from the given tables, for the registered queries.

Each is one SQL text that Spark and other engines read alike; `{name}` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.scratch import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "bom": """select l_orderkey as pair, cast(l_orderkey as string) || 'NS' as sku, cast(l_partkey as string) as item_number,
        upper(p_name) || ' ' || cast(p_size as string) || 'MM' as description, cast(l_quantity as decimal(18,6)) as quantity, 'EA' as uom,
        cast(l_linenumber as string) as oper_seq, cast(l_shipdate as date) as effective_thru, p_name, p_size, l_partkey, p_brand,
        case when l_partkey % 19 = 0 then 0.5 else 1.0 end as confidence,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as item_ord
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "label": """select pair, description, quantity, uom, item_ord, confidence, false as conditional, cast(null as int) as sub_value, cast(null as string) as sub_kind, l_partkey, raw_line from (
        select pair, upper(split_part(p_name, ' ', 2)) || ', ' || upper(split_part(p_name, ' ', 1)) || ', ' || cast(p_size as string) || ' MM' as description,
        cast(quantity + case when l_partkey % 13 = 0 then 1 else 0 end as decimal(18,6)) as quantity, 'EACH' as uom, item_ord, cast(1.0 as double) as confidence, l_partkey,
        cast(cast(quantity as int) as string) || ' Each - ' || p_name || case when l_partkey % 3 = 0 then ' (3 per)' when l_partkey % 3 = 1 then ', 2 per pouch' else '' end as raw_line
        from ({bom}) b where l_partkey % 11 <> 0) t
        union all
        select distinct pair, 'BONUS STICKER' as description, cast(1 as decimal(18,6)) as quantity, 'EACH' as uom, 1000 as item_ord, cast(1.0 as double) as confidence, false as conditional, cast(null as int) as sub_value, cast(null as string) as sub_kind, cast(0 as bigint) as l_partkey, '1 Each - bonus sticker' as raw_line
        from ({bom}) b where pair % 17 = 0""",
    "label_fuzzy": """select pair, upper(split_part(p_name, ' ', 2)) || ', ' || upper(split_part(p_name, ' ', 1)) || ', ' || cast(case when l_partkey % 7 = 0 then p_size + 1 else p_size end as string) || ' MM' || case when l_partkey % 5 = 0 then ' STERILE' else '' end as description,
        quantity, 'EACH' as uom, item_ord, cast(1.0 as double) as confidence, false as conditional, cast(null as int) as sub_value, cast(null as string) as sub_kind, l_partkey from ({bom}) b where l_partkey % 11 <> 0""",
    "pieces": """select pair, sku, item_number, description, quantity, uom, oper_seq, effective_thru, confidence, item_ord, 'PHYSICAL_COMPONENT' as category, true as active from ({bom}) b""",
    "kit_lines": """select pair, sku, item_number, description, case when l_partkey % 23 = 0 then cast(0 as decimal(18,6)) else quantity end as quantity, uom, oper_seq, effective_thru, confidence, item_ord,
        case when l_partkey % 17 = 0 then 'LABEL' when l_partkey % 18 = 0 then 'PACKAGING' else 'PHYSICAL_COMPONENT' end as category, l_partkey % 29 <> 0 as active,
        'bom' || cast(pair as string) || '.csv' as file, cast(1 + item_ord % 3 as int) as page, 'row ' || cast(item_ord as string) as locator, 'DWG' || cast(pair % 50 as string) || case when l_partkey % 4 = 0 then '' else ' rev ' || cast(l_partkey % 4 as string) end as named
        from ({bom}) b""",
    "kit_labels": """select * from ({label}) b where pair % 31 <> 0""",
    "sets": """select o_orderkey as pair, cast(o_orderkey as string) || 'NS' as parent, case when o_orderkey % 23 = 0 then null when o_orderkey % 29 = 0 then cast(o_orderkey + 1 as string) || 'X' else cast(o_orderkey as string) || 'LBL' end as ref from {orders}""",
    "drawings": """select o_orderkey as pair, 'DWG' || cast(o_orderkey % 50 as string) as number, cast(o_orderkey % 4 as string) as revision from {orders}""",
    "drawing_lines": """select l_orderkey as pair, l_linenumber as item_ord, case when (l_orderkey + l_linenumber) % 3 = 0 then 'Pack per dwg' || cast(l_orderkey % 50 as string) || ' rev. ' || cast(l_partkey % 3 as string) else 'Part ' || cast(l_partkey as string) end as description from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from {lineitem} group by l_orderkey, l_linenumber) t""",
    "documents_fx": """select o_orderkey * 10 + k as doc, cast(case when o_orderkey % 10 < 7 then 'F' || cast(o_orderkey as string) else 'shared' || cast(o_orderkey % 100 as string) end as string) as folder,
        case when k = 0 and o_orderkey % 13 <> 0 then 'BOM' when k = 1 then 'LABEL' when k = 2 and o_orderkey % 2 = 0 then 'DRAWING' when k = 3 then 'PCO' else 'LABEL' end as doc_type,
        case when o_orderkey % 31 = 0 and k = 1 then null else cast(o_orderkey as string) || 'NS' end as sku
        from {orders} cross join (values (0), (1), (2), (3)) t(k)""",
    "codes": """select cast(o_orderkey as bigint) % 1000 as form, cast(o_orderkey as string) || 'NS' as code from {orders} union all select distinct cast(o_orderkey as bigint) % 1000 as form, 'X' || cast(o_orderkey % 1000 as string) as code from {orders}""",
    "bom_docs": """select l_orderkey as document, cast(l_orderkey as string) || 'NS' as parent from {lineitem} group by l_orderkey union all select l_orderkey + 1000000000 as document, cast(l_orderkey as string) || 'NS' as parent from {lineitem} where l_orderkey % 41 = 0 group by l_orderkey""",
    "changes": """select pair % 1000 as form, sku as code, pair * 100 + item_ord as change_ord,
        case l_partkey % 4 when 0 then 'DELETE' when 1 then 'ADD' when 2 then 'SUBSTITUTE' else 'MODIFY' end as kind,
        case l_partkey % 4 when 1 then '' when 2 then cast(l_partkey + 1 as string) else item_number end as actual,
        case l_partkey % 4 when 0 then 'DELETE' when 3 then item_number else cast(l_partkey + l_partkey % 3 as string) end as proposed,
        cast(quantity + l_partkey % 2 as string) as qty_proposed, case when l_partkey % 5 = 0 then '' else oper_seq end as seq_proposed
        from ({bom}) b""",
    "change_lines": """select sku as code, item_ord, item_number, quantity, oper_seq, l_partkey % 6 <> 0 as active, case when l_partkey % 8 = 0 then 'DELETE' when l_partkey % 9 = 0 then cast(l_partkey + 1 as string) else '-' end as redline from ({bom}) b""",
    "decisions": """select 'run' as run_id, user_id as row_id, cast(1 + event_id % 2 as int) as slot, case event_type when 'purchase' then 'ACCEPT' when 'click' then 'CONFIRM_DISCREPANCY' else 'OVERRIDE' end as decision,
        case when event_type = 'error' then case when event_id % 3 = 0 then 'EXACT' else 'MISSING' end end as override, ts as decided_at, event_id from {events} where event_type in ('purchase', 'click', 'error')""",
    "finals": """select 'run' as run_id, user_id as row_id, max(event_type) as final from {events} where event_type = 'signup' and user_id % 4 = 0 group by user_id""",
    "rows": """select distinct 'run' as run_id, user_id as row_id, cast(user_id % 10 as string) as sku, case user_id % 5 when 0 then 'EXACT' when 1 then 'EQUIVALENT' when 2 then 'POTENTIAL' when 3 then 'MISMATCH' else 'MISSING' end as classification, user_id % 5 >= 2 as requires_validation from {events}""",
}


def text_of(name: str, but: tuple[str, ...] = ()) -> str:
    """The SQL of a fixture with the fixtures inside it written out, but for some; only placeholders of those and of tables are left."""
    sql = SQL[name]
    while True:
        inner = next((m for m in re.findall(r"\{(\w+)\}", sql) if m in SQL and m not in but), None)
        if inner is None:
            return sql
        sql = sql.replace("{" + inner + "}", SQL[inner])


def portable(sql: str) -> str:
    """An SQL text as an engine takes it that has the tables as views."""
    for m in set(re.findall(r"\{(\w+)\}", sql)):
        sql = sql.replace("{" + m + "}", f"({portable(SQL[m])})" if m in SQL else m)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of parts up to which the join with them may broadcast them; their files are small in bytes for far more.
HELD_ROWS = 200_000
#: Rows of parts that a task of a fixture of parts alone takes: their one small file is far more rows, and each is many words.
TASK_ROWS = 20_000


def fixture(spark: SparkSession, sf_dir: str, name: str, bom: DataFrame | None = None) -> DataFrame:
    """bom: the lines of bills from written_bom(), where several fixtures of a query are made of them."""
    sql, given = text_of(name, () if bom is None else ("bom",)), {} if bom is None else {"bom": bom}
    own = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql)) - {*given}} | given
    parts = own["part"].count() if "part" in own else 0
    if "lineitem" not in own and parts > TASK_ROWS:
        own["part"] = own["part"].repartition(-(-parts // TASK_ROWS), "p_partkey")
    elif parts > HELD_ROWS:
        own["part"] = own["part"].hint("merge")
    return spark.sql(sql, **own)


def written_bom(spark: SparkSession, sf_dir: str, *used: str) -> DataFrame:
    """The lines of bills as a written table, joined and numbered once for all fixtures of a query; columns that it has no use for are null."""
    bom = fixture(spark, sf_dir, "bom")
    return cut(bom.select(*used), "bom").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in bom.schema if f.name not in used])
