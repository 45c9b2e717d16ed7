"""Column statistics against numpy and plain Python on small fixtures."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsight.config import ProfileConfig, dialect
from colsight.functions import types as kinds
from colsight.functions.rows import constant_rows
from colsight.operators import topvalues
from colsight.operators.cells import Dataset
from colsight.operators.distinct import dense_columns, distinct_counts_of
from colsight.operators.ranks import MEDIAN, PERCENTILES, percentiles, rank_intervals, upper_medians
from colsight.operators.summary import summaries
from colsight.plans.column_profile import column_profile, column_statistics

PERCENTS = (5, 25, 50, 75, 95)


def frequency(spark, values, partitions=4):
    rows = [(0, float(v)) for v in values]
    df = spark.createDataFrame(rows, "cid int, d double").repartition(partitions)
    return df.groupBy("cid", "d").agg(F.count("*").alias("n"))


def profile_of(df, config=None, **kw):
    return {r.column_name: r for r in column_profile({"t": df}, config, **kw).collect()}


CASES = {
    "one value": [7.0],
    "two values": [1.0, 2.0],
    "known quartiles": [1, 2, 3, 10],
    "one value fills a third": [5.0] * 400 + list(range(800)),
    "all equal": [3.0] * 100,
    "heavy tail": list(np.random.default_rng(1).lognormal(0, 6, 3000)),
    "negative and zero": list(np.random.default_rng(2).normal(0, 1, 2001)) + [0.0, -0.0],
    "many duplicates": list(np.random.default_rng(3).integers(0, 20, 5000)),
    "wide range": [-1e300, -1.0, 0.0, 1e-300, 1.0, 1e300],
}


def intervals(spark, values, how, shares=PERCENTILES):
    """One row of interval ends: of the sketch, none at all, or ends that hold no rank."""
    if how == "sketch":
        df = spark.createDataFrame([(float(v),) for v in values], "d double").repartition(3)
        return rank_intervals(Dataset.of({"t": df}), shares, 64)
    ends = {"none": [None, None], "below": [-1e301, -1e301], "turned": [float(max(values)), float(min(values))]}[how] * len(shares)
    return constant_rows(spark, [(0, *ends)], "cid int, " + ", ".join(f"{name}_{end} double" for name in shares for end in ("from", "to")))


@pytest.mark.parametrize(("name", "how"), [*[(name, "sketch") for name in CASES], *[("heavy tail", how) for how in ("none", "below", "turned")], ("many duplicates", "turned")])
def test_percentiles_equal_linear_interpolation(spark, name, how):
    values = CASES[name]
    row = percentiles(frequency(spark, values), intervals(spark, values, how)).first()
    expected = np.percentile(values, PERCENTS)
    assert [row.p5, row.p25, row.median, row.p75, row.p95] == pytest.approx(list(expected), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("values", [[1, 2, 3, 10], [1, 2, 3], [4], [2, 2, 2, 9, 9, 9]])
def test_upper_median_is_the_element_at_half(spark, values):
    assert upper_medians(frequency(spark, values), intervals(spark, values, "sketch", MEDIAN)).first().median == sorted(values)[len(values) // 2]


def test_percentiles_do_not_depend_on_partitions(spark):
    values = CASES["heavy tail"]
    one, many = (percentiles(frequency(spark, values, p), intervals(spark, values, "sketch")).first() for p in (1, 8))
    assert one == many


def test_a_sketch_leaves_little_to_sort(spark):
    """The broadcast is two numbers for each rank, and few of the values lie in the segments that are sorted."""
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) as d")
    ends = rank_intervals(Dataset.of({"t": df}), PERCENTILES, 4096)
    assert len(ends.columns) == 1 + 2 * len(PERCENTILES)
    row = ends.first()
    inside = sum(df.where(F.col("d").between(row[f"{name}_from"], row[f"{name}_to"])).count() for name in PERCENTILES)
    assert inside < 0.05 * 20_000


def test_distinct_counts_by_bits(spark):
    df = spark.range(3000).selectExpr(
        "id % 700 - 300 as small", "id * 1000003 as wide", "if(id % 3 = 0, null, id) as gaps", "date_add(date '1969-06-01', cast(id % 500 as int)) as day",
        "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(cast(id % 90 as int)) as midnight", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 7) as moment",
        "cast(null as int) as nothing", "9223372036854775807 - id % 5 as high", "-9223372036854775807 + id % 5 as low", "if(id = 0, -9223372036854775808, 9223372036854775807) as ends", "cast(id % 11 as string) as text",
    )
    data = Dataset.of({"t": df, "none": df.where("small > 1000")})
    dense = {r.name for r in dense_columns(data, data.columns) if r.table == "t"}
    assert dense == {"small", "gaps", "day", "midnight", "high", "low"}
    got = {r.cid: r.distinct_count for r in distinct_counts_of(data).collect()}
    want = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first().asDict()
    assert {r.name: got.get(r.cid, 0) for r in data.columns if r.table == "t"} == want
    assert not any(got.get(r.cid) for r in data.columns if r.table == "none")


def test_a_sketch_rules_out_text(spark):
    df = spark.range(2000).selectExpr("concat('text ', id) as long_text", "concat('k', id % 90) as few", "concat('k', id % 150) as close")
    data = Dataset.of({"t": df})
    sketched = {r.cid: r.approx_distinct for r in summaries(data, ProfileConfig(), ["approx_distinct"]).collect()}
    assert [r.name for r in topvalues.text_candidates(data, sketched, ProfileConfig())] == ["few", "close"]
    assert [r.name for r in topvalues.text_candidates(data, sketched, ProfileConfig(), [("t", "long_text")])] == ["long_text", "few", "close"]
    rows = profile_of(df)
    assert rows["long_text"].top_values is None and len(rows["few"].top_values) == 10 and rows["close"].top_values is None


def test_mixed_types(spark):
    df = spark.sql(
        """select * from values
        (1, 1.5D, 2.50BD, 'a', true, date '2020-01-02', timestamp_ntz '2020-01-01 10:00:00', X'FF', array(1, 2), map('k', 1)),
        (2, -0.5D, 2.50BD, '', false, date '2021-01-02', timestamp_ntz '2020-01-01 10:00:01', X'FF', array(1, 2), map('k', 2)),
        (null, 0.0D, null, 'a', null, null, null, null, array(2), null)
        as t(i, d, dec, s, b, day, ts, bin, arr, m)"""
    )
    rows = profile_of(df)
    assert (rows["i"].total_count, rows["i"].null_count, rows["i"].null_percentage) == (3, 1, 33.33)
    assert (rows["i"].distinct_count, rows["i"].distinct_percentage, rows["i"].min, rows["i"].max) == (2, 66.67, 1, 2)
    assert (rows["d"].zero_count, rows["d"].negative_count, rows["d"].median) == (1, 1, 0.0)
    assert (rows["dec"].distinct_count, rows["dec"].mean) == (1, 2.5)
    assert (rows["s"].empty_count, rows["s"].min_length, rows["s"].max_length) == (1, 0, 1)
    assert (rows["b"].true_count, rows["b"].false_count, rows["b"].true_percentage) == (1, 1, 50.0)
    assert [(e.value, e["count"]) for e in rows["b"].top_values] == [("false", 1), ("true", 1)]
    assert (rows["day"].min_text, rows["day"].max_text, rows["day"].top_values) == ("2020-01-02", "2021-01-02", None)
    assert rows["ts"].max_text == "2020-01-01 10:00:01"
    assert [rows[c].distinct_count for c in ("bin", "arr", "m")] == [1, 2, 2]
    assert rows["arr"].category == kinds.OTHER and rows["arr"].min is None
    assert [(e.value, e["count"], e.percentage) for e in rows["s"].top_values] == [("a", 2, 66.67), ("", 1, 33.33)]


def test_empty_table_and_engine_conventions(spark):
    df = spark.sql("select 1 as i, 'a' as s, true as b where 1 = 0")
    rows = profile_of(df)
    assert (rows["i"].total_count, rows["i"].null_percentage, rows["i"].distinct_percentage) == (0, 0.0, 0.0)
    assert (rows["i"].zero_count, rows["i"].mean, rows["i"].median, rows["i"].outlier_count) == (0, None, None, None)
    assert (rows["s"].empty_count, rows["b"].true_percentage) == (0, 0.0)
    assert rows["s"].top_values == [] and rows["b"].top_values == []
    assert profile_of(df, ProfileConfig(dialect=dialect("redshift")))["i"].zero_count is None


def test_single_row_has_no_sample_deviation(spark):
    df = spark.sql("select 5 as i")
    assert profile_of(df)["i"].stddev is None
    mysql = profile_of(df, ProfileConfig(dialect=dialect("mysql")))["i"]
    assert (mysql.stddev, mysql.median, mysql.p5, mysql.outlier_count) == (0.0, 5.0, None, None)


def test_all_null_columns(spark):
    df = spark.range(3).selectExpr("cast(null as int) as i", "cast(null as string) as s")
    rows = profile_of(df)
    assert (rows["i"].null_percentage, rows["i"].distinct_count, rows["i"].median) == (100.0, 0, None)
    assert rows["s"].top_values == [] and rows["s"].max_length is None


def test_odd_column_names(spark):
    df = spark.range(4).toDF("a b").selectExpr("`a b`", "`a b` as `x.y`", "`a b` as `back``tick`", "`a b` as `it's`")
    rows = profile_of(df)
    assert {n: (r.distinct_count, r.max) for n, r in rows.items()} == dict.fromkeys(("a b", "x.y", "back`tick", "it's"), (4, 3.0))


def test_large_integers_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "n bigint")
    assert profile_of(df)["n"].distinct_count == 2


def test_long_text_is_counted_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",)], "s string")
    row = profile_of(df)["s"]
    assert row.distinct_count == 2
    assert [(e.value, e["count"]) for e in row.top_values] == [(long + "a", 2), (long + "b", 1)]


def test_top_values_gate_limit_and_ties(spark):
    df = spark.range(300).selectExpr("id", "id % 3 as three", "cast(id % 101 as string) as many")
    rows = profile_of(df, ProfileConfig(top_values_limit=2))
    assert rows["id"].top_values is None and rows["many"].top_values is None
    assert [(e.value, e["count"]) for e in rows["three"].top_values] == [("0", 100), ("1", 100)]
    forced = profile_of(df, ProfileConfig(top_values_limit=2), enum_columns=[("t", "many")])
    assert [e.value for e in forced["many"].top_values] == ["0", "1"]


def test_outliers_lie_strictly_outside_the_fences(spark):
    # Quartiles 1 and 3 give the fences -2 and 6.
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 6)], "n int")
    assert profile_of(df)["n"].outlier_count == 0
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 7)], "n int")
    assert profile_of(df)["n"].outlier_count == 1


def test_approximate_percentiles(spark):
    df = spark.range(1001).toDF("n")
    row = profile_of(df, ProfileConfig(dialect=dialect("bigquery")))["n"]
    assert (row.p5, row.median, row.p95, row.outlier_count) == (50.0, 500.0, 950.0, 0)


def test_decimals_and_floats_keep_their_type(spark):
    df = spark.createDataFrame([(Decimal("1.10"), 0.1), (Decimal("1.20"), 0.1)], "a decimal(10,2), f float")
    rows = profile_of(df)
    assert [e.value for e in rows["f"].top_values] == ["0.1"]
    assert [e.value for e in rows["a"].top_values] == ["1.10", "1.20"]


def test_each_category_has_exactly_its_struct(spark):
    df = spark.sql("select 1 as i, 'a' as s, true as b, date '2020-01-01' as d, array(1) as o")
    nested = column_statistics(column_profile({"t": df}))
    filled = {
        r.column_name: [k for k in ("numeric", "string", "boolean", "temporal") if r.statistics[k] is not None]
        for r in nested.collect()
    }
    assert filled == {"i": ["numeric"], "s": ["string"], "b": ["boolean"], "d": ["temporal"], "o": []}


def test_type_names(spark):
    expected = {
        "decimal(10,2)": "numeric", " BIGINT ": "numeric", "Character Varying(20)": "string", "bool": "boolean",
        "timestamp with time zone": "temporal", "jsonb": "other", "uuid": "other",
    }
    df = spark.createDataFrame([(n,) for n in expected], "name string")
    found = {r.name: r.c for r in df.select("name", kinds.category_of_name(F.col("name")).alias("c")).collect()}
    assert found == expected


def test_frequencies_are_shuffled_once(spark, tmp_path):
    spark.range(1000).selectExpr("id as a", "id * 0.5D as b").write.parquet(str(tmp_path / "t"))
    df = column_profile({"t": spark.read.parquet(str(tmp_path / "t"))})
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Expand" not in plan


def test_nan_counts_as_the_largest_value(spark):
    df = spark.sql("select explode(array(3.0D, double('NaN'), 1.0D, 2.0D, double('NaN'), 0.0D, 5.0D, 4.0D, 6.0D)) as d")
    row = profile_of(df)["d"]
    assert (row.distinct_count, row.p25, row.median) == (8, 2.0, 4.0)
    assert np.isnan(row.max) and np.isnan(row.p95)
