"""Precision and recall over thresholds, and percentiles by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_sweep(scored: DataFrame, *, step: int = 5, last: int = 95) -> DataFrame:
    """scored: (positive boolean, score 0 to 100 or null) of each labelled query. (threshold, found, missed, false_alerts, precision,
    recall, f1) at 0, step, ... last."""
    # Scores fall into the band of the greatest threshold that they reach; sums over bands replace a join with every threshold.
    band = F.when(F.col("score").isNotNull(), F.least(F.floor(F.col("score") / step) * step, F.lit(last)).cast("int"))  # least() passes over nulls
    bands = scored.select(F.col("positive"), F.coalesce(band, F.lit(-1)).alias("band")).groupBy("band").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("n"))
    steps = scored.sparkSession.range(0, last + 1, step).select(F.col("id").cast("int").alias("threshold"))
    sums = steps.join(F.broadcast(bands), F.lit(True), "left").groupBy("threshold").agg(
        F.sum(F.when(F.col("band") >= F.col("threshold"), F.col("p")).otherwise(0)).alias("found"), F.sum("p").alias("positives"),
        F.sum(F.when(F.col("band") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("false_alerts"),
    )
    sums = sums.na.fill(0).withColumn("precision", F.try_divide(F.col("found"), F.col("found") + F.col("false_alerts"))).withColumn("recall", F.try_divide(F.col("found"), F.col("positives")))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return sums.select("threshold", "found", (F.col("positives") - F.col("found")).alias("missed"), "false_alerts", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def percentile_by_rank(values: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """(share, value): the value at place floor(share * n) of the sorted values (the last at most)."""
    from pyspark.sql import Window

    counted = values.select(value.alias("value")).where(F.col("value").isNotNull())
    n = counted.agg(F.count("*").alias("n"))
    by = counted.groupBy("value").agg(F.count("*").alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(Window.orderBy("value")))
    wanted = values.sparkSession.createDataFrame([(float(s),) for s in shares], "share double").crossJoin(n)
    at = F.least(F.floor(F.col("share") * F.col("n")), F.col("n") - 1)
    return wanted.join(upto, (at >= F.col("upto") - F.col("c")) & (at < F.col("upto"))).select("share", "value")
