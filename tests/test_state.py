"""Event folds, patches with explicit NULL, selection set algebra, distributed running totals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitelore.operators import state
from sitelore.operators.ordering import prefix_over


def test_job_summary_and_patches(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        (1, 7, "c", t0, "discovered"), (2, 7, "c", t0 + dt.timedelta(minutes=1), "failed"),
        (3, 7, "c", t0 + dt.timedelta(minutes=2), "scraped"), (4, 8, "c", t0, "generated")],
        "event_id bigint, job_id bigint, course_id string, ts timestamp_ntz, event string")
    js = {r["job_id"]: r for r in state.job_summary(ev).collect()}
    assert (js[7]["current_stage"], js[7]["error"]) == ("complete", "1 pages failed")
    assert (js[8]["current_stage"], js[8]["error"]) == ("failed", "No pages found for the given IDs")
    patches = spark.createDataFrame([(7, t0, 1, {"error": "boom"}), (7, t0 + dt.timedelta(minutes=5), 2, {"error": None})],
                                    "job_id bigint, ts timestamp_ntz, event_id bigint, patch map<string,string>")
    base = state.job_summary(ev).select("job_id", "course_id", "error", "current_stage")
    out = {r["job_id"]: r for r in state.apply_job_patches(base, patches, {"error": "string"}).collect()}
    assert out[7]["error"] is None  # explicit NULL patch clears the field
    assert out[8]["error"] == "No pages found for the given IDs"  # untouched


def test_toggles(spark):
    sel = spark.createDataFrame([("c", 1), ("c", 2)], "course_id string, page_id bigint")
    ids = spark.createDataFrame([("c", 2), ("c", 3)], "course_id string, page_id bigint")
    assert sorted(r[1] for r in state.toggle_pages(sel, ids).collect()) == [1, 3]
    mp = spark.createDataFrame([("c", "m1", 1), ("c", "m1", 2), ("c", "m2", 2), ("c", "m2", 4)],
                               "course_id string, module_id string, page_id bigint")
    # m1 fully selected → removed; m2 partly → all added (add wins for page 2)
    assert sorted(r[1] for r in state.toggle_modules(sel, mp).collect()) == [2, 4]


def test_prefix_over_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    out = prefix_over(df.repartition(7), ["k"], ["o"], "idx", sums={"run": F.col("v")})
    rows = sorted((r["k"], r["o"], r["idx"], r["run"]) for r in out.collect())
    exp, acc = [], {}
    for k, o, v in sorted((i % 3, i, i % 5) for i in range(5000)):
        n, s = acc.get(k, (0, 0))
        exp.append((k, o, n, s + v))
        acc[k] = (n + 1, s + v)
    assert rows == sorted(exp)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_prefix_over_with_payload_equals_window(spark, adaptive):
    from pyspark.sql import Window
    from sitelore.operators.ordering import prefix_over
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        # 40 % of the rows in one key, NULL keys, a payload, many partitions
        df = spark.range(60_000).select(
            F.when(F.col("id") % 10 < 4, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
            F.xxhash64("id").alias("o"), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("payload"),
            (F.col("id") % 7).alias("v")).repartition(9)
        out = prefix_over(df, ["k"], ["o", "id"], "idx", sums={"run": F.col("v")})
        w = Window.partitionBy("k").orderBy("o", "id")
        want = df.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint")).withColumn(
            "run", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        assert out.columns == want.columns and out.count() == 60_000
        assert out.exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
