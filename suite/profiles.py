"""Sources, sinks, samples and whole-dataset profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.operators import sampling
from colsight.plans import document
from colsight.plans.column_profile import column_profile
from colsight.plans.files import file_profile, file_run
from colsight.plans.tables import table_profile
from colsight.sources import readers, records, sinks
from colsight.sources.readers import FileSource
from colsight.sources.staging import columnar, shared_folder
from suite.statistics import flat_profile
from suite.tables import NAMES, load

SCHEMAS = {
    "region": dict(r_regionkey="numeric", r_name="string"),
    "nation": dict(n_nationkey="numeric", n_name="string", n_regionkey="numeric"),
    "customer": dict(c_custkey="numeric", c_name="string", c_nationkey="numeric", c_acctbal="numeric", c_mktsegment="string"),
    "supplier": dict(s_suppkey="numeric", s_name="string", s_nationkey="numeric", s_acctbal="numeric"),
    "part": dict(
        p_partkey="numeric", p_name="string", p_brand="string", p_type="string", p_size="numeric", p_retailprice="numeric"
    ),
    "orders": dict(
        o_orderkey="numeric", o_custkey="numeric", o_orderstatus="string", o_totalprice="numeric", o_orderdate="temporal",
        o_orderpriority="string",
    ),
    "lineitem": dict(
        l_orderkey="numeric", l_partkey="numeric", l_suppkey="numeric", l_linenumber="numeric", l_quantity="numeric",
        l_extendedprice="numeric", l_discount="numeric", l_tax="numeric", l_returnflag="string", l_linestatus="string",
        l_shipdate="temporal",
    ),
    "events": dict(
        event_id="numeric", ts="temporal", user_id="numeric", event_type="string", value="numeric", props="string"
    ),
    "documents": dict(doc_id="numeric", text="string", lang="string", source="string", n_chars="numeric"),
    "embeddings": dict(vec_id="numeric", embedding="other", label="numeric"),
    "pages": dict(page_id="numeric", url="string", html="string"),
    "benchmark": dict(item_id="numeric", text="string"),
    "labels": dict(doc_id="numeric", quality="numeric", toxic="numeric"),
    "conversations": dict(conv_id="numeric", turn="numeric", role="string", text="string"),
}


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, name) for name in NAMES}


def _as_csv(spark: SparkSession, sf_dir: str, name: str, separator: str = ",") -> str:
    path = f"{shared_folder(spark)}/{name}.csv"
    load(spark, sf_dir, name).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, sep=separator, header=True)
    return path


def _as_json(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}.jsonl"
    load(spark, sf_dir, name).write.json(path)
    return path


def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read(spark, FileSource(f"{sf_dir}/customer.parquet"))


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with ``|`` and quotes, so with line breaks inside fields, and read back; the separator is found."""
    path = shared_folder(spark)
    # A file that may hold line breaks in its fields is read in one piece, so that files stay small.
    _write_documents(spark, sf_dir, path, rows_per_file=5_000)
    return readers.read(spark, FileSource(path))


def _write_documents(spark: SparkSession, sf_dir: str, path: str, rows_per_file: int) -> None:
    written = load(spark, sf_dir, "documents").write.option("escape", '"').option("quoteAll", True).option("maxRecordsPerFile", rows_per_file)
    written.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, sep="|", header=True)


def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One glob over a folder of line files and a folder of array files, each with up to 200 suppliers."""
    path, suppliers = shared_folder(spark), load(spark, sf_dir, "supplier")
    suppliers.where("s_suppkey % 2 = 0").write.json(f"{path}/lines")
    grouped = suppliers.where("s_suppkey % 2 = 1").groupBy(F.floor(F.col("s_suppkey") / 400).alias("part"))
    arrays = grouped.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    arrays.write.partitionBy("part").text(f"{path}/arrays")
    return readers.read(spark, FileSource(f"{path}/**/part-*", file_format="json"))


def _large_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as CSV files of many blocks each, with line breaks and quotes inside fields; no task writes more than it reads."""
    path = shared_folder(spark)
    _write_documents(spark, sf_dir, path, rows_per_file=50_000)
    return path


def src_csv_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large files, each read once by several tasks: records are joined from lines, separator and types found on the copy."""
    # Small blocks spread a file as a larger one would be.
    found = records.read_records(spark, FileSource(_large_files(spark, sf_dir), block_bytes=1 << 18))
    return found.rows.unionByName(found.rejected.selectExpr("line as doc_id", "reason as text", "file as lang"), allowMissingColumns=True)


def src_json_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretty-printed arrays and line files, each read once; every 50th supplier is cut short and comes back as a rejected line."""
    path, suppliers = shared_folder(spark), load(spark, sf_dir, "supplier")
    text = F.to_json(F.struct("*"))
    broken = F.when(F.col("s_suppkey") % 50 == 0, F.substring(text, 1, 20)).otherwise(text)
    suppliers.where("s_suppkey % 2 = 0").select(broken.alias("value")).write.text(f"{path}/lines")
    grouped = suppliers.where("s_suppkey % 2 = 1").groupBy(F.floor(F.col("s_suppkey") / 400).alias("part"))
    pretty = F.concat(F.lit("[\n  "), F.array_join(F.collect_list(F.regexp_replace(text, ",", ",\n    ")), ",\n  "), F.lit("\n]\n"))
    grouped.agg(pretty.alias("value")).write.partitionBy("part").text(f"{path}/arrays")
    found = records.read_records(spark, FileSource(f"{path}/**/part-*", file_format="json"))
    lost = found.rejected.select(F.regexp_extract("record", r'"s_suppkey":(\d+)', 1).cast("bigint").alias("s_suppkey"), F.col("reason").alias("s_name"))
    return found.rows.unionByName(lost, allowMissingColumns=True)


def _cut_short(spark: SparkSession, folder: str) -> None:
    """Half of the first Parquet file of a folder, as another file beside it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first = min((s for s in system.listStatus(path) if s.getPath().getName().endswith(".parquet")), key=lambda s: s.getPath().getName())
    jvm = spark.sparkContext._jvm
    half = jvm.org.apache.commons.io.input.BoundedInputStream(system.open(first.getPath()), first.getLen() // 2)
    written = system.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-99999-cut.parquet"))
    jvm.org.apache.commons.io.IOUtils.copy(half, written)
    written.close()


def src_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truncated Parquet file, a CSV line with too many fields and broken JSON lines beside good ones: what is listed, and what is profiled."""
    path, suppliers = shared_folder(spark), load(spark, sf_dir, "supplier")
    load(spark, sf_dir, "events").write.parquet(f"{path}/events.parquet")
    _cut_short(spark, f"{path}/events.parquet")
    text = F.to_json(F.struct("*"))
    suppliers.select(F.when(F.col("s_suppkey") % 50 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(f"{path}/supplier.jsonl")
    line = F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey", F.when(F.col("n_nationkey") == 7, "too many"))
    lines = load(spark, sf_dir, "nation").select(line.alias("value")).unionAll(spark.sql("select 'n_nationkey,n_name,n_regionkey'"))
    lines.coalesce(1).sortWithinPartitions(~F.col("value").startswith("n_"), "value").write.text(f"{path}/nation.csv")
    run = file_run(spark, [FileSource(f"{path}/{name}") for name in ("events.parquet", "supplier.jsonl", "nation.csv", "no_such_file.parquet")])
    lost = run.rejected.groupBy("table_name", "reason").agg(F.count("*").alias("total_count"), F.countDistinct("line").alias("distinct_count"))
    profiled = run.profile.select("table_name", "column_name", "total_count", "distinct_count", F.when(F.col("failed"), "cannot be read").alias("reason"))
    return profiled.unionByName(lost, allowMissingColumns=True)


def src_auto_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table through all three formats, each chosen from the path."""
    sources = [
        FileSource(f"{sf_dir}/part.parquet"),
        FileSource(_as_json(spark, sf_dir, "part")),
        FileSource(_as_csv(spark, sf_dir, "part")),
    ]
    frames = [
        readers.read(spark, s)
        .agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes"), F.countDistinct("p_name").alias("names"))
        .select(F.lit(readers.file_format(s)).alias("format"), "*")
        for s in sources
    ]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


def src_multi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several paths, a glob, and a glob over nested folders, each one table; its row count under the derived name."""
    path, events = shared_folder(spark), load(spark, sf_dir, "events")
    for number, folder in enumerate(("a/in", "b/c/in", "b/out")):
        events.where(f"event_id % 3 = {number}").write.parquet(f"{path}/{folder}")
    paths = ("orders.parquet", "lineitem.parquet", "custom*.parquet")
    sources = [*[FileSource(f"{sf_dir}/{p}") for p in paths], FileSource(f"{path}/**/in/*.parquet", name="nested")]
    tables = readers.read_all(spark, sources)
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def src_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naming rule over every page URL, read as a path."""
    return load(spark, sf_dir, "pages").select("page_id", readers.table_name_of(F.col("url")).alias("table_name"))


def src_isolated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing path is skipped; the others are profiled, with all their statistics."""
    sources = [FileSource(f"{sf_dir}/{name}.parquet") for name in ("nation", "no_such_table", "supplier")]
    return flat_profile(file_profile(spark, sources))


def src_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the probed row is a row of the table, and the schema it shows, column by column."""
    orders = load(spark, sf_dir, "orders")
    row = readers.probe(spark, FileSource(f"{sf_dir}/orders.parquet"))
    found = row.join(orders, row.columns, "left_semi").agg(F.count("*").alias("rows"))
    schema = [F.struct(F.lit(at).alias("place"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for at, f in enumerate(row.schema)]
    return found.select("rows", F.inline(F.array(*schema)))


def snk_profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents written as JSON text and read back."""
    profile = column_profile({name: load(spark, sf_dir, name) for name in ("orders", "customer")})
    path = shared_folder(spark)
    sinks.write_documents(document.table_documents(document.table_structs(profile)), path)
    written = spark.read.json(path)
    column = F.explode("columns").alias("c")
    return written.select(F.col("name").alias("table_name"), column).select(
        "table_name",
        F.col("c.name").alias("column_name"),
        F.col("c.statistics.distinct_count").alias("distinct_count"),
        F.col("c.statistics.total_count").alias("total_count"),
    )


def _membership(drawn: DataFrame, table: DataFrame) -> DataFrame:
    """Size of a sample, how many different rows it has, and how many of them are rows of the table."""
    drawn = columnar(drawn)
    rows = drawn.agg(F.count("*").alias("rows"), F.countDistinct(F.struct("*")).alias("distinct_rows"))
    return rows.select("*", F.lit(table.join(drawn.distinct(), drawn.columns, "left_semi").distinct().count()).alias("members"))


def smp_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return _membership(sampling.random_rows(lines, 10, 42), lines)


def smp_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return _membership(sampling.random_file_rows(lines, 10, 42).drop("_draw"), lines)


def smp_column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each column the number of values and of rows of the table that the values, side by side, make up."""
    orders = load(spark, sf_dir, "orders")
    values = columnar(sampling.column_values(orders, 10, 42))
    cells = values.select("column_name", F.posexplode("sample_values").alias("place", "value"))
    rows = cells.groupBy("place").pivot("column_name", orders.columns).agg(F.first("value"))
    known = sampling.json_safe_rows(orders).join(rows, orders.columns, "left_semi").distinct().count()
    return values.select("ordinal", "column_name", F.size("sample_values").alias("size"), F.lit(known).alias("members"))


def smp_json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(
        F.col("event_id"), "ts", F.to_date("ts").alias("day"), F.encode("event_type", "UTF-8").alias("raw"),
        F.round("value", 1).cast("decimal(12,1)").alias("price"), F.array("user_id", "event_id").alias("pair"),
    )
    return sampling.json_safe_rows(events)


def prf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ProfileConfig(include_sample_data=False)
    return flat_profile(table_profile({"lineitem": load(spark, sf_dir, "lineitem")}, config)).drop("sample_values")


def prf_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table in one plan."""
    return flat_profile(column_profile(all_tables(spark, sf_dir)))


def prf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet and a CSV source profiled together, with the bucket of a path as schema and the path as description."""
    sources = [FileSource(f"{sf_dir}/events.parquet"), FileSource(_as_csv(spark, sf_dir, "customer"), name="customer")]
    run = file_run(spark, sources, ProfileConfig(include_sample_data=False))
    ending = F.regexp_extract("description", r"[^/]+$", 0).alias("description")
    described = run.profile.join(run.tables.select("schema_name", "table_name", ending), ["schema_name", "table_name"])
    return flat_profile(described.drop("sample_values", "failed", "reason"))


QUERIES = {
    f.__name__: f
    for f in (
        src_parquet, src_csv, src_csv_one_pass, src_json, src_json_one_pass, src_quarantine, src_auto_format, src_multi_path,
        src_table_name, src_isolated_paths, src_probe, snk_profile_json, smp_random, smp_reservoir, smp_column_values, smp_json_safe,
        prf_table, prf_dataset, prf_files,
    )
}


def _profile_sql(tables: tuple[str, ...]) -> str:
    """The profile as one SQL row per column: one aggregate per column, top values and outliers below it."""
    parts = []
    for table in tables:
        for name, category in SCHEMAS[table].items():
            numeric, text = category == "numeric", category == "string"

            def pick(on: bool, sql: str, kind: str, alias: str) -> str:
                return f"{sql}::{kind} as {alias}" if on else f"null::{kind} as {alias}"

            top = (
                f"case when count(distinct {name}) <= 100 then (select coalesce(string_agg(value || '=' || n, ';' order by n desc, value), '')"
                f" from (select {name}::varchar as value, count(*) as n from {table} where {name} is not null group by {name}"
                " order by n desc, value limit 10)) end"
            )
            quartiles = f"(select quantile_cont({name}::double, 0.25) as q1, quantile_cont({name}::double, 0.75) as q3 from {table})"
            outliers = f"(select count(*) from {table}, {quartiles} where {name} < q1 - 1.5 * (q3 - q1) or {name} > q3 + 1.5 * (q3 - q1))"
            fields = [
                f"'{table}' as table_name, '{name}' as column_name, '{category}' as category",
                f"count(*) as total_count, count({name}) as non_null_count, count(*) - count({name}) as null_count",
                f"round((count(*) - count({name})) * 100.0::double / count(*), 2) as null_percentage",
                f"count(distinct {name}) as distinct_count",
                f"round(count(distinct {name}) * 100.0::double / count(*), 2) as distinct_percentage",
                pick(numeric, f"min({name})", "double", "min"),
                pick(numeric, f"max({name})", "double", "max"),
                pick(numeric, f"round(avg({name}), 4)", "double", "mean"),
                pick(numeric, f"round(stddev_samp({name}), 4)", "double", "stddev"),
                pick(numeric, f"round(var_samp({name}), 0)", "double", "variance"),
                pick(numeric, f"round(sum({name}::double), 0)", "double", "sum"),
                *[
                    pick(numeric, f"round(quantile_cont({name}::double, {p}), 4)", "double", alias)
                    for alias, p in {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}.items()
                ],
                pick(numeric, f"count(*) filter ({name} = 0)", "bigint", "zero_count"),
                pick(numeric, f"count(*) filter ({name} < 0)", "bigint", "negative_count"),
                pick(numeric, outliers, "bigint", "outlier_count"),
                pick(text, f"min(length({name}))", "int", "min_length"),
                pick(text, f"max(length({name}))", "int", "max_length"),
                pick(text, f"round(avg(length({name})), 4)", "double", "avg_length"),
                pick(text, f"count(*) filter ({name} = '')", "bigint", "empty_count"),
                "null::bigint as true_count, null::bigint as false_count, null::double as true_percentage",
                pick(category == "temporal", f"min({name})::varchar", "varchar", "min_text"),
                pick(category == "temporal", f"max({name})::varchar", "varchar", "max_text"),
                pick(numeric or text, top, "varchar", "top_values"),
            ]
            parts.append(f"select {', '.join(fields)} from {table}")
    return "\nunion all\n".join(parts)


def _counts_sql(*tables: str) -> str:
    return " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count(distinct {c}) as distinct_count from {t}"
        for t in tables
        for c in SCHEMAS[t]
    )


_ENDINGS = ["csv", "parquet", "parq", "json", "jsonl", "ndjson", "gz", "zst", "bz2", "lz4"]


def _table_name_sql() -> str:
    segment = "list_last(string_split(regexp_replace(url, '/+$', ''), '/'))"
    for ending in _ENDINGS:
        segment = f"regexp_replace({segment}, '\\.{ending}$', '', 'i')"
    name = f"regexp_replace(regexp_replace({segment}, '[^a-zA-Z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"select page_id, case when {name} = '' then 's3_file' else {name} end as table_name from pages"


_PART = "count(*) as parts, sum(p_size)::bigint as sizes, count(distinct p_name) as names from part"

ORACLE = {
    "src_parquet": "select * from customer",
    "src_csv": "select * from documents",
    "smp_random": "select 10 as rows, 10 as distinct_rows, 10 as members from (select 1 from lineitem having count(*) >= 10)",
    "smp_reservoir": "select 10 as rows, 10 as distinct_rows, 10 as members from (select 1 from lineitem having count(*) >= 10)",
    "smp_column_values": """select ordinal, column_name, 10 as size, 10 as members from (values (1, 'o_orderkey'), (2, 'o_custkey'),
        (3, 'o_orderstatus'), (4, 'o_totalprice'), (5, 'o_orderdate'), (6, 'o_orderpriority')) t(ordinal, column_name)
        where (select count(*) from orders) >= 10""",
    "src_json": "select * from supplier",
    "src_csv_one_pass": "select * from documents",
    "src_json_one_pass": """select case when s_suppkey % 50 = 0 then null else s_acctbal end as s_acctbal, case when s_suppkey % 50 = 0 then 'not valid JSON' else s_name end as s_name,
        case when s_suppkey % 50 = 0 then null else s_nationkey end as s_nationkey, s_suppkey from supplier""",
    "src_quarantine": "with s as (select * from supplier where s_suppkey % 50 <> 0), n as (select * from nation where n_nationkey <> 7)\n"
    + " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count(distinct {c}) as distinct_count, null::varchar as reason from {view}"
        for t, view in (("events", "events"), ("supplier", "s"), ("nation", "n"))
        for c in SCHEMAS[t]
    )
    + """ union all select 'supplier', null, count(*), count(*), 'not valid JSON' from supplier where s_suppkey % 50 = 0 having count(*) > 0
        union all select 'nation', null, count(*), count(*), 'not the fields that the header names' from nation where n_nationkey = 7
        union all select 'events', null, 1, 0, 'no valid footer' from (select 1 from events limit 1)
        union all select 'no_such_file', null, null, null, 'cannot be read'""",
    "src_probe": """select 1 as rows, place, column_name, data_type from (values (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'),
        (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'))
        t(place, column_name, data_type) where exists (select * from orders)""",
    "src_auto_format": " union all ".join(f"select '{f}' as format, {_PART}" for f in ("parquet", "json", "csv")),
    "src_multi_path": " union all ".join(
        f"select '{name}' as table_name, count(*) as row_count from {table}"
        for name, table in {"orders": "orders", "lineitem": "lineitem", "custom": "customer", "nested": "events where event_id % 3 < 2"}.items()
    ),
    "src_table_name": _table_name_sql(),
    "src_isolated_paths": _profile_sql(("nation", "supplier")),
    "snk_profile_json": _counts_sql("orders", "customer"),
    "smp_json_safe": """select event_id::varchar as event_id,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end as ts,
        ts::date::varchar as day, lower(hex(event_type)) as raw,
        round(value, 1)::decimal(12,1)::double::varchar as price, '[' || user_id || ',' || event_id || ']' as pair from events""",
    "prf_table": _profile_sql(("lineitem",)),
    "prf_dataset": _profile_sql(NAMES),
    "prf_files": "select 'files' as schema_name, case table_name when 'events' then 'events.parquet' else 'customer.csv' end as description, *"
    f" from ({_profile_sql(('events', 'customer'))})",
}
