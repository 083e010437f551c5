"""Values of polygons that every vertex needs are worked out once a polygon."""

import math

from pyspark.sql import functions as F

from fieldtrace.functions import geometry

SHAPE = ((0.0, 0.0), (4.0, 0.0), (5.0, 3.0), (1.0, 2.0), (0.5, 1.0))


def test_the_centroid_is_worked_out_once(spark):
    df = spark.range(1).select(F.array(*[F.struct((x + F.col("id")).alias("x"), F.lit(y).alias("y")) for x, y in SHAPE]).alias("v"))
    out = df.select(geometry.axes(F.col("v")).alias("a"), geometry.area(geometry.scale(F.col("v"), 2.0)).alias("s"), geometry.area(geometry.by_angle(F.col("v"))).alias("b"))
    assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 10
    pairs = list(zip(SHAPE, SHAPE[1:] + SHAPE[:1], strict=True))
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)
    c = [sum((a[i] + b[i]) * (a[0] * b[1] - b[0] * a[1]) for a, b in pairs) / (3 * twice) for i in (0, 1)]
    far = [math.dist(p, c) for p in SHAPE]
    row = out.first()
    assert abs(row.a.major - max(far)) < 1e-9 and abs(row.a.minor - min(far)) < 1e-9 and abs(row.s - 2 * abs(twice)) < 1e-9


def test_percentiles_of_a_category_share_one_table_of_counted_values(spark):
    from fieldtrace.operators import groups

    rows = spark.createDataFrame([("a", None, v) for v in (1.0, 2.0, 2.0, 5.0, None)] + [("b", 1, 7.0), ("c", 1, None)], "g string, h int, v double")
    out = groups.category_summary(rows, ["g", "h"], "v")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
    got = {r.g: r for r in out.collect()}
    assert (got["a"].p25, got["a"].p50, got["a"].n, got["a"].mean) == (1.75, 2.0, 4, 2.5)
    assert (got["b"].p25, got["b"].p50, got["b"].std) == (None, 7.0, None) and (got["c"].p50, got["c"].n) == (None, 0)


def test_only_the_pairs_asked_for_are_made(spark):
    from fieldtrace.operators import inference

    rows = spark.createDataFrame([(c, float((i * 7 + k) % 5)) for k, c in enumerate("abcd") for i in range(9)], "c string, v double")
    every = {(r.level1, r.level2): r for r in inference.rank_tests(rows, "c", "v").collect()}
    some = {(r.level1, r.level2): r for r in inference.rank_tests(rows, "c", "v", lambda a, b: a == "a").collect()}
    assert some == {k: v for k, v in every.items() if k[0] == "a"} and len(some) == 3
    assert inference.rank_tests(rows, "c", "v", lambda a, b: False).count() == 0
