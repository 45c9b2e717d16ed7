"""A catalog derived from the order tables, so that catalog queries grow with the data.

An order stands for a table, its customer for the schema, its line items for the columns. The same
SQL text defines each frame in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsight.sources.staging import columnar
from suite.tables import load

_LINES = """select l.*, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as int) as ord
    from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey"""
_NAMES = "concat('schema_', cast({c} as varchar(20))) as table_schema, concat('table_', cast({o} as varchar(20))) as table_name"
_LINE_NAMES = _NAMES.format(c="o_custkey", o="l_orderkey")
_COLUMN_NAME = "concat('c', cast(ord as varchar(20)), '_', lower(l_returnflag))"

DERIVED = {
    "schemata": "select concat('schema_', cast(c_custkey as varchar(20))) as schema_name, c_mktsegment as schema_owner from {customer}",
    "owners": "select cast(n_nationkey as bigint) as owner_id, lower(n_name) as owner from {nation} where n_nationkey < 20",
    "tables": f"""select {_NAMES.format(c='o_custkey', o='o_orderkey')}, o_orderkey as table_id,
        case when o_orderstatus = 'P' then 'VIEW' else 'BASE TABLE' end as table_type, o_custkey % 25 as owner_id,
        cast(floor(o_totalprice) as bigint) as data_length, cast(floor(o_totalprice / 10) as bigint) as index_length,
        case when o_orderkey % 5 <> 0 then o_orderpriority end as description,
        case when o_orderkey % 7 = 0 then -1 when o_orderkey % 11 <> 0 then cast(floor(o_totalprice / 100) as bigint) end as row_estimate,
        o_orderdate as created, o_orderdate as last_altered, o_orderdate as last_ddl, o_orderdate as check_time, o_orderdate as update_time
        from {{orders}}""",
    "columns": f"""select {_LINE_NAMES}, {_COLUMN_NAME} as column_name, ord as ordinal_position, l_orderkey as table_id, ord as attribute_number,
        case l_partkey % 6 when 0 then 'integer' when 1 then 'varchar(20)' when 2 then 'decimal(10,2)' when 3 then 'timestamp'
            when 4 then 'boolean' else concat('enum(''', l_returnflag, ''',''', l_linestatus, ''','''')') end as data_type,
        case when l_linestatus = 'O' then 'YES' else 'NO' end as is_nullable,
        case when l_discount > 0.05 then cast(l_linenumber as varchar(20)) end as column_default,
        case when l_partkey % 6 = 1 then 20 end as character_maximum_length,
        case when l_partkey % 6 = 2 then 10 end as numeric_precision, case when l_partkey % 6 = 2 then 2 end as numeric_scale,
        case when l_suppkey % 3 = 0 then concat('supplied by ', cast(l_suppkey as varchar(20))) end as description,
        l_returnflag, l_linestatus, l_partkey, l_suppkey, l_quantity
        from ({_LINES})""",
    "constraints": f"""select {_NAMES.format(c='o_custkey', o='o_orderkey')}, concat('pk_', cast(o_orderkey as varchar(20))) as constraint_name, 'PRIMARY KEY' as constraint_type
        from {{orders}} where o_orderkey % 4 <> 0
        union all select {_NAMES.format(c='o_custkey', o='o_orderkey')}, concat('fk_', cast(o_orderkey as varchar(20))), 'FOREIGN KEY'
        from {{orders}} where o_orderkey % 3 = 0""",
    "key_usage": f"""select {_LINE_NAMES}, concat('pk_', cast(l_orderkey as varchar(20))) as constraint_name, {_COLUMN_NAME} as column_name, ord as ordinal_position
        from ({_LINES}) where l_orderkey % 4 <> 0 and ord <= 1 + l_orderkey % 2
        union all select {_LINE_NAMES}, concat('fk_', cast(l_orderkey as varchar(20))), {_COLUMN_NAME}, ord - 1
        from ({_LINES}) where l_orderkey % 3 = 0 and ord in (2, 3)""",
    "referential": """select concat('schema_', cast(c.o_custkey as varchar(20))) as constraint_schema, concat('fk_', cast(c.o_orderkey as varchar(20))) as constraint_name,
        concat('schema_', cast(p.o_custkey as varchar(20))) as unique_constraint_schema, concat('pk_', cast(c.o_orderkey - c.o_orderkey % 4 + 1 as varchar(20))) as unique_constraint_name,
        case when c.o_orderstatus = 'F' then 'CASCADE' else 'NO ACTION' end as update_rule, case when c.o_orderpriority = '5-LOW' then 'SET NULL' else 'NO ACTION' end as delete_rule
        from {orders} c left join {orders} p on p.o_orderkey = c.o_orderkey - c.o_orderkey % 4 + 1 where c.o_orderkey % 3 = 0""",
    "statistics": f"""select {_LINE_NAMES}, case when l_returnflag = 'N' then 'PRIMARY' else concat('ix_', lower(l_returnflag)) end as index_name,
        case when l_returnflag = 'A' then 1 else 0 end as non_unique, case when l_orderkey % 2 = 0 then 'BTREE' else 'HASH' end as index_type,
        cast(row_number() over (partition by l_orderkey, l_returnflag order by ord desc) as int) as seq_in_index, {_COLUMN_NAME} as column_name
        from ({_LINES})""",
    "views": f"""select {_NAMES.format(c='o_custkey', o='o_orderkey')}, o_orderkey as table_id, o_custkey % 25 as owner_id,
        concat('select * from t where priority = ''', o_orderpriority, '''') as definition from {{orders}} where o_orderstatus = 'P'""",
    "extension_views": "select o_orderkey as table_id from {orders} where o_orderpriority = '1-URGENT'",
    "blocks": "select l_orderkey as table_id from {lineitem} where l_quantity > 10",
    "options": f"""select {_NAMES.format(c='o_custkey', o='o_orderkey')}, case when o_orderkey % 2 = 0 then 'description' else 'labels' end as option_name,
        o_orderpriority as option_value from {{orders}}""",
    "runs": """select user_id as table_id, case when event_type = 'error' then 1 else 0 end as status, ts as run_start_time from {events}""",
    "checks": f"""select {_LINE_NAMES}, {_COLUMN_NAME} as column_name, concat('ck_', cast(l_orderkey as varchar(20)), '_', cast(ord as varchar(20))) as constraint_name,
        case when l_tax > 0.04 then concat('CHECK ((', {_COLUMN_NAME}, ' = ANY (ARRAY[''', l_returnflag, '''::text, ''', l_linestatus, '''::text])))')
            else concat('CHECK ((', {_COLUMN_NAME}, ' > 0))') end as definition
        from ({_LINES})""",
    "clauses": f"""select {_LINE_NAMES}, concat('ck_', cast(l_orderkey as varchar(20)), '_', cast(ord as varchar(20))) as constraint_name,
        case when l_tax > 0.04 then concat('(`', {_COLUMN_NAME}, '` in (''', l_returnflag, ''',''', l_linestatus, '''))') else '(1 = 1)' end as definition
        from ({_LINES})""",
}

_SOURCES = ("customer", "orders", "lineitem", "nation", "events")
_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "o_custkey", "ord",
)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _derived(spark, sf_dir, name, None)


def derived_frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Several derived frames; the numbered line items behind them are joined, sorted and stored once."""
    if sum(_LINES in DERIVED[n] for n in names) + ("key_usage" in names) < 2:  # key usage takes them twice
        return [derived(spark, sf_dir, n) for n in names]
    tables = {t: load(spark, sf_dir, t) for t in ("lineitem", "orders")}
    lines = columnar(spark.sql(_LINES, **tables).select(*_LINE_COLUMNS))
    return [_derived(spark, sf_dir, n, lines) for n in names]


def _derived(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None) -> DataFrame:
    text = DERIVED[name] if lines is None else DERIVED[name].replace(f"({_LINES})", "{lines}")
    frames = {t: load(spark, sf_dir, t) for t in _SOURCES if "{" + t + "}" in text}
    return spark.sql(text, **frames, **({"lines": lines} if "{lines}" in text else {}))


def ctes(*names: str) -> str:
    """WITH clause that defines the derived frames under the names ``d_<name>``."""
    bodies = {n: DERIVED[n].format(**{t: t for t in _SOURCES}) for n in names}
    return "with " + ",\n".join(f"d_{n} as materialized ({body})" for n, body in bodies.items()) + "\n"
