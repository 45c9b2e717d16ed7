"""Profiling runs over several schemas, and profiles kept up to date file by file."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.operators import catalog
from colsight.plans.incremental import ProfileLedger
from colsight.plans.run import profile_run, table_facts, union_readers
from colsight.sources.staging import shared_folder
from suite.derived import ctes, derived_frames
from suite.profiles import SCHEMAS, _profile_sql
from suite.statistics import flat_profile
from suite.tables import load

ARCHIVED = "o_orderstatus = 'F'"
RUN = ProfileConfig(
    include_schemas=("sales", "archive", "information_schema"),
    include_tables=("orders", "customer", "lineitem", "part", "slow", "no_file", "draft"),
    exclude_tables=("draft",),
    include_sample_data=False,
    columns_per_job=12,
)


def _asleep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    time.sleep(3600)
    yield from batches


def run_readers(spark: SparkSession, sf_dir: str) -> dict:
    """Two schemas with a table ``orders`` each, a table that takes an hour, one that is not there, and some that the lists leave out."""

    def of(name: str) -> DataFrame:
        return load(spark, sf_dir, name)

    frames = union_readers(
        ("sales", {"orders": of("orders"), "customer": of("customer"), "lineitem": of("lineitem"), "draft": of("part"), "nation": of("nation")}),
        ("archive", {"orders": of("orders").where(ARCHIVED), "part": of("part")}),
        ("information_schema", {"orders": of("orders")}),
        ("private", {"orders": of("orders")}),
    )
    slow = of("supplier")
    return frames | {
        ("sales", "slow"): lambda: slow.mapInArrow(_asleep, slow.schema),
        ("archive", "no_file"): lambda: of("no_such_table"),
    }


def prf_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over what the lists choose; the slow table is cancelled after its own limit, the missing one is a row without a column."""
    run = profile_run(spark, run_readers(spark, sf_dir), RUN, {("sales", "slow"): 2.0})
    reason = F.when(F.col("reason") == "deadline", "deadline").when(F.col("failed"), "cannot be read").alias("reason")
    return flat_profile(run).select("schema_name", *[c for c in flat_profile(run).columns if c not in ("schema_name", "sample_values", "reason")], reason)


def prf_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog facts beside the profile of two schemas: every customer's schema of the derived catalog that the run chose."""
    config = ProfileConfig(include_sample_data=False, include_data_freshness=False)
    tables, columns, statistics, *linked = derived_frames(spark, sf_dir, "tables", "columns", "statistics", "referential", "key_usage", "constraints")
    run = columns.select(F.col("table_schema").alias("schema_name"), "table_name", "column_name", F.col("l_quantity").alias("total_count"))
    indexes = catalog.indexes_from_statistics(statistics)
    links = catalog.foreign_keys(*linked)
    sized = tables.select("table_schema", "table_name", "description", F.col("data_length").alias("size_bytes"), (F.col("data_length") + F.col("index_length")).alias("total_size_bytes"))
    facts = table_facts(run, config, sized, None, indexes, links, catalog.freshness(tables, "mysql"))
    listed = {name: F.array_join(F.transform(name, lambda e: e[field]), ",").alias(name) for name, field in (("indexes", "index_name"), ("relationships", "from_column"))}
    assert "data_freshness" not in facts.columns
    return facts.select("schema_name", "table_name", "row_count", "description", "size_bytes", "total_size_bytes", *listed.values())


def prf_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` in two parts, profiled; a third part comes, and only its files are read. Estimates are compared with exact ranks and counts."""
    path, lines = shared_folder(spark), load(spark, sf_dir, "lineitem")
    ledger = ProfileLedger(spark, shared_folder(spark))

    def write(part: int) -> None:
        lines.where(F.pmod("l_orderkey", F.lit(3)) == part).write.parquet(f"{path}/part-{part}")

    def parts_read() -> int:
        """How many parts the update that follows finds new files in; it reads these files, all of them and no others."""
        waiting = ledger.unread(path)
        found = waiting.agg(F.countDistinct(F.regexp_extract("file", r"/part-(\d+)/[^/]*$", 1)).alias("parts"), F.count(F.lit(1)).alias("files")).first()
        if ledger.update(path) != found.files:
            raise RuntimeError("an update read other files than those that were new")
        return found.parts

    write(0)
    write(1)
    first = parts_read()
    write(2)
    second = parts_read()
    profile = ledger.profile(path).withColumns({"first_read": F.lit(first), "second_read": F.lit(second)})
    numbers = [c for c, kind in SCHEMAS["lineitem"].items() if kind == "numeric"]
    found = {r.column_name: r for r in profile.where("category = 'numeric'").collect()}  # one row per column
    within = []
    for c in numbers:
        for p, name in ((0.05, "p5"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95")):
            below, upto = (F.avg(test.cast("double")) for test in (F.col(c) < found[c][name], F.col(c) <= found[c][name]))
            within.append(((below <= p + 0.02) & (upto >= p - 0.02)).alias(f"{c}_{name}"))
    ranks = lines.agg(*within)
    fields = [F.struct(F.lit(c).alias("column_name"), F.forall(F.array(*[f"{c}_{p}" for p in ("p5", "p25", "median", "p75", "p95")]), lambda x: x).alias("ranks_within_bound")) for c in numbers]
    exact = lines.agg(*[F.countDistinct(c).alias(c) for c in lines.columns])
    counts = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in lines.columns]
    judged = profile.join(F.broadcast(exact.select(F.inline(F.array(*counts)))), "column_name").join(F.broadcast(ranks.select(F.inline(F.array(*fields)))), "column_name", "left")
    near = (F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1), 0.04 * F.col("exact"))).alias("distinct_within_bound")
    rounded = [F.round(c, d).alias(c) for c, d in (("mean", 4), ("stddev", 4), ("variance", 0), ("sum", 0), ("avg_length", 4))]
    plain = ("column_name", "category", "total_count", "non_null_count", "null_count", "null_percentage", "min", "max", "zero_count", "negative_count", "min_length", "max_length", "empty_count", "min_text", "max_text", "first_read", "second_read")
    return judged.select(*plain, *rounded, near, "ranks_within_bound")


QUERIES = {f.__name__: f for f in (prf_schemas, prf_table_facts, prf_incremental)}


def _run_sql() -> str:
    names = "'{s}' as schema_name, "
    chosen = (("sales", "orders", "orders"), ("sales", "customer", "customer"), ("sales", "lineitem", "lineitem"), ("archive", "orders", "archived"), ("archive", "part", "part"))
    parts = []
    for schema, table, source in chosen:
        body = _profile_sql((table,)).replace(f"from {table}", f"from {source}")
        parts.append(f"select {names.format(s=schema)}*, false as failed, null::varchar as reason from ({body})")
    lost = ["('sales', 'slow', 's_suppkey')", "('sales', 'slow', 's_name')", "('sales', 'slow', 's_nationkey')", "('sales', 'slow', 's_acctbal')", "('archive', 'no_file', null)"]
    failed = f"""select schema_name, table_name, column_name, true as failed, case table_name when 'slow' then 'deadline' else 'cannot be read' end as reason
        from (values {', '.join(lost)}) t(schema_name, table_name, column_name) where exists (select * from supplier)"""
    return f"with archived as (select * from orders where {ARCHIVED})\n" + "\nunion all by name\n".join([*parts, failed])


ORACLE = {
    "prf_schemas": _run_sql(),
    "prf_table_facts": ctes("columns", "tables", "statistics", "referential", "key_usage", "constraints").rstrip()
    + """,
    i as (select table_schema, table_name, string_agg(distinct index_name, ',' order by index_name) as indexes from d_statistics group by all),
    u as (select *, constraint_name || '#' || ordinal_position as place from d_key_usage),
    f as (select rc.constraint_schema as table_schema, tc.table_name, string_agg(k.column_name, ',' order by rc.constraint_name, k.column_name) as relationships
        from d_referential rc join u k on k.constraint_name = rc.constraint_name and k.table_schema = rc.constraint_schema
        join d_constraints tc on tc.constraint_name = rc.constraint_name and tc.table_schema = rc.constraint_schema
        join u p on p.place = rc.unique_constraint_name || '#' || k.ordinal_position group by all),
    c as (select table_schema, table_name, max(l_quantity) as row_count from d_columns group by all)
    select c.table_schema as schema_name, c.table_name, row_count, description, data_length as size_bytes, data_length + index_length as total_size_bytes,
        coalesce(indexes, '') as indexes, coalesce(relationships, '') as relationships
    from c join d_tables using (table_schema, table_name) left join i using (table_schema, table_name) left join f using (table_schema, table_name)""",
    "prf_incremental": "select column_name, category, total_count, non_null_count, null_count, null_percentage, min, max, zero_count, negative_count,"
    " min_length, max_length, empty_count, min_text, max_text, 2 as first_read, 1 as second_read, mean, stddev, variance, sum, avg_length,"
    f" true as distinct_within_bound, case when category = 'numeric' then true end as ranks_within_bound from ({_profile_sql(('lineitem',))})",
}
