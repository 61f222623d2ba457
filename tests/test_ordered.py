from pyspark.sql import Window, functions as F

from millrace.operators.ordered import SLOT, first_rows, in_ranges, ordered_scan
from millrace.operators.responses import cap_to_target, progress
from millrace.operators.skew import spread_join
from millrace.operators.telemetry import elapsed


def hot(spark, n=3000):
    """A third of the rows have key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("seq"),
        (F.col("id") * 7 % 11).alias("v"), F.when(F.col("id") % 4 != 0, F.col("id") * 2).alias("p"),
    )


def test_ordered_scan_equals_plain_windows(spark):
    rows = hot(spark)
    start = rows.groupBy("k").agg((F.min("seq") - 5).alias("start"))
    got = ordered_scan(
        rows, ["k"], ["seq"], parts=12,
        totals={"n": F.lit(1), "sum": F.col("v")}, previous={"before": F.col("p")}, least={"low": F.col("v")}, attach=start,
    )
    w = Window.partitionBy("k").orderBy("seq")
    want = rows.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w).alias("sum"),
        F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("v").over(Window.partitionBy("k")).alias("low"),
    ).join(start, "k")
    columns = got.columns
    assert got.count() == rows.count()
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def test_ranges_bound_windows_and_carry_for_sparse_numbers(spark):
    """Order numbers far apart, and one key with 90 % of the rows."""
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") * 1_000_003).alias("seq"))
    sizes = in_ranges(rows, ["k"], ["seq"], parts=20).groupBy(SLOT).count()
    assert sizes.agg(F.max("count")).first()[0] <= 4000 / 20 * 2
    per_key = sizes.groupBy(F.col(SLOT)["k"]).agg(F.count(F.lit(1)).alias("n"))
    assert per_key.agg(F.max("n")).first()[0] <= 20
    got = ordered_scan(rows, ["k"], ["seq"], totals={"n": F.lit(1)}, parts=20)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("seq")).cast("long"))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 4000


def test_cap_is_the_same_with_and_without_ranges(spark):
    rows = hot(spark).select("k", F.expr("seq div 10").alias("batch_idx"), (F.col("seq") % 10).alias("line_idx"))
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("batch_idx", "line_idx"))).filter("r <= 37").drop("r")
    for got in (cap_to_target(rows, ["k"], 37), cap_to_target(rows, ["k"], F.lit(37), parts=7)):
        assert got.count() == want.count()
        assert got.select(want.columns).exceptAll(want).count() == 0


def test_small_cap_is_limited_before_the_shuffle(spark):
    rows = hot(spark).select("k", F.col("seq").alias("batch_idx"), F.lit(0).alias("line_idx"))
    plan = cap_to_target(rows, ["k"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_spread_join_equals_plain_join(spark):
    big = hot(spark).withColumnRenamed("v", "x")
    small = spark.range(60).select(F.col("id").alias("k"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("c"))
    got = spread_join(big, small, ["k"], ["seq"], rows_per_task=50)
    want = small.join(big, "k")
    assert got.count() == want.count()
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_null_keys_are_a_group_of_their_own(spark):
    rows = hot(spark, 300).withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    got = ordered_scan(rows, ["k"], ["seq"], totals={"n": F.lit(1)}, parts=5)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("seq")).cast("long"))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 300


def test_progress_computes_the_batches_once(spark):
    parsed = hot(spark).select("k", F.expr("seq div 10").alias("batch_idx"), F.lit("valid").alias("status"))
    df = progress(parsed, ["k"], 100)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and "FileScan" in plan  # the counts were written; the input is not read again


def test_elapsed_over_a_hot_run(spark):
    trace = spark.range(1000).selectExpr(
        "IF(id < 990, 1, id) AS run_id", "id * 1000000 AS seq", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts"
    )
    runs = spark.createDataFrame([(1, 1704067200_000_000), (995, None)], "run_id long, started_us long")
    got = {r.seq // 1000000: r.elapsed_s for r in elapsed(trace, runs, rows_per_task=100).collect()}
    assert got == {i: float(i) if i < 990 else None for i in range(1000)}


def test_hot_keys_go_through_ranges_and_others_through_one_window(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 50}", i * 7 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    attach = spark.createDataFrame([("hot", 1), (None, 2)], "k string, a long")
    options = dict(totals={"total": F.col("v")}, previous={"before": F.when(F.col("v") % 2 == 0, F.col("v"))}, least={"low": F.col("v")}, attach=attach)
    want = ordered_scan(df, ["k"], ["seq"], parts=7, **options)
    for limit in (10, 100, 10_000):
        got = ordered_scan(df, ["k"], ["seq"], rows_per_task=limit, **options)
        assert got.columns == want.columns and got.count() == 1000
        assert got.exceptAll(want).count() == 0
    plan = ordered_scan(df, ["k"], ["seq"], totals=options["totals"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan


def test_first_rows_read_only_the_ranges_that_hold_them(spark):
    rows = [("a" if i % 4 else None, i * 37 % 2000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    for target in (0, 1, 700, 5000):
        got = sorted(((r.k or "", r.seq) for r in first_rows(df, ["k"], ["seq"], F.lit(target), 9).collect()))
        want = [(k or "", s) for k in (None, "a") for s in sorted(s for name, s, _ in rows if name == k)[:target]]
        assert got == sorted(want)
