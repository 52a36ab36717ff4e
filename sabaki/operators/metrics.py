"""Counters, gauges and latency histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_SAMPLES = 10_000
SALTS = 64


def counters(samples: DataFrame, by: str = "by") -> DataFrame:
    """Sum of the increments (metric, ``by``) of each metric."""
    return samples.groupBy("metric").agg(F.sum(by).alias("total"))


def gauges(samples: DataFrame, order: list[str]) -> DataFrame:
    """Last value (metric, value) of each metric by ``order``."""
    return samples.groupBy("metric").agg(F.max_by("value", F.struct(*order)).alias("value"))


def last_samples(samples: DataFrame, order: list[str], keep: int = KEPT_SAMPLES, salts: int = SALTS) -> DataFrame:
    """The last ``keep`` samples of each metric.

    There may be few metrics and many samples, so each metric is cut in ``salts`` parts first and
    the last of every part compete.
    """
    latest = [F.col(c).desc() for c in order]
    parts = samples.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    parts = parts.withColumn("nth", F.row_number().over(Window.partitionBy("metric", "salt").orderBy(*latest))).filter(F.col("nth") <= keep)
    whole = parts.drop("salt", "nth").withColumn("nth", F.row_number().over(Window.partitionBy("metric").orderBy(*latest)))
    return whole.filter(F.col("nth") <= keep).drop("nth")


def histogram(samples: DataFrame) -> DataFrame:
    """count, min, max, mean (2 places), p50, p95, p99 of each metric (metric, value) of ``last_samples``.

    A percentile is the sorted sample at position floor(n * p), from 0; arrays hold at most the samples
    that are kept.
    """
    grouped = samples.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.array_sort(F.collect_list("value")).alias("sorted"))
    at = lambda p: F.get("sorted", F.floor(F.col("n") * F.lit(p)).cast("int"))
    return grouped.filter("n > 0").select(
        "metric",
        "n",
        F.get("sorted", F.lit(0)).alias("min"),
        F.element_at("sorted", -1).alias("max"),
        F.round("mean", 2).alias("mean"),
        *(at(p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)),
    )


def timed_metric(metric: str, failed: str) -> Column:
    """Name under which an operation's latency is kept."""
    return F.when(F.col(failed), F.concat(F.col(metric), F.lit(".error"))).otherwise(F.col(metric))


def hit_ratio(lookups: DataFrame) -> DataFrame:
    """hits, misses and their ratio (3 places, 0 without lookups) of lookups (hit)."""
    counts = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return counts.withColumn("hit_ratio", F.round(F.coalesce(F.col("hits") / F.nullif(total, F.lit(0)), F.lit(0.0)), 3))
