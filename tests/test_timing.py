"""Measured steps of a run."""

from pyspark.sql import functions as F

from eddyline.config import Settings
from eddyline.operators import graph
from eddyline.plans import analysis
from eddyline.plans.timing import Steps, peak_bytes


def test_steps_of_a_run(spark):
    steps = Steps(spark)
    with steps("shuffle"):
        spark.range(10_000).repartition(3, F.col("id") % 7).write.format("noop").mode("overwrite").save()
    with steps("search"):
        edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert graph.connected_components(edges, small=0).select("root").distinct().count() == 1
    mask = spark.createDataFrame([(t, 0, x) for t in range(8) for x in range(6)], "t int, yi int, xi int")
    s = Settings(height=2, width=8, min_area_frame=100, min_area_time=100, min_days=3)
    assert analysis.analyse(mask, s, 7, steps).found.count() == 1
    got = {r.step: r for r in steps.frame().collect()}
    assert set(got) == {"shuffle", "search", "label", "track", "events"}
    assert got["shuffle"].shuffle_bytes > 10_000 and got["shuffle"].rounds == 0 and got["shuffle"].tasks > 0
    assert got["search"].rounds > 1 and got["track"].tasks > got["events"].tasks
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9 and peak_bytes(spark) > 10 << 20
