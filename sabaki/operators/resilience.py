"""Circuit breakers, caches with expiry, and retries, over event tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
TTL_SECONDS = {"extraction": 86_400, "translation": 604_800, "segmentation": 86_400}


@dataclass
class Breaker:
    """State of one circuit; times in milliseconds."""

    threshold: int = 5
    recovery_ms: int = 30_000
    timeout_ms: int = 30_000
    state: str = CLOSED
    failures: int = 0
    failed_at: int = 0

    def observe(self, at: int, ok: bool, took_ms: float | None = None) -> tuple[str, bool]:
        """A call at ``at``: the state it met, and whether it was let through.  A call over the timeout fails."""
        if self.state == OPEN and at - self.failed_at >= self.recovery_ms:
            self.state = HALF_OPEN
        met = self.state
        if met == OPEN:
            return met, False
        if ok and (took_ms is None or took_ms <= self.timeout_ms):
            self.state, self.failures = CLOSED, 0
        else:
            self.failures += 1
            self.failed_at = at
            if met == HALF_OPEN or self.failures >= self.threshold:
                self.state = OPEN
        return met, True


def succeeded(calls: DataFrame, timeout_ms: int) -> Column:
    """Whether a call did what it should in time; ``took_ms`` may be missing or null, which is in time."""
    in_time = F.coalesce(F.col("took_ms") <= timeout_ms, F.lit(True)) if "took_ms" in calls.columns else F.lit(True)
    return F.coalesce(F.col("ok") & in_time, F.lit(False))


def circuit_breaker(calls: DataFrame, threshold: int = 5, recovery_ms: int = 30_000, timeout_ms: int = 30_000) -> DataFrame:
    """Each call (key, at_ms, call_id, ok, and took_ms if there is one) with the state it met, whether it was let through, and the state and failures after it.

    A call that took longer than ``timeout_ms`` fails, whatever it gave.  A circuit is a chain of calls, so the
    calls of a key pass through one task; they stream through it in order and only the circuit's state
    is held, however many there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, circuit = object(), Breaker(threshold, recovery_ms)
        for b in batches:
            out = []
            for k, at, good in zip(b["key"], b["at_ms"], b.pop("good"), strict=True):
                if k != key:
                    key, circuit = k, Breaker(threshold, recovery_ms)
                out.append((*circuit.observe(int(at), bool(good)), circuit.state, circuit.failures))
            yield b.assign(**{c: [o[i] for o in out] for i, c in enumerate(("met", "allowed", "state", "failures"))})

    ship(calls.sparkSession)
    rows = calls.select("key", "at_ms", "call_id", "ok", succeeded(calls, timeout_ms).alias("good")).repartition("key").sortWithinPartitions("key", "at_ms", "call_id")
    kind = calls.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, at_ms long, call_id long, ok boolean, met string, allowed boolean, state string, failures int")


def cache_key(kind: str, prefix: str, *parts: Column) -> Column:
    """Key of a cache entry; the version comes first."""
    version, *rest = parts
    return F.concat_ws(":", F.lit(prefix), F.lit(kind), F.concat(F.lit("v"), version), *rest)


def cache_lookups(operations: DataFrame, ttl_seconds: int) -> DataFrame:
    """Each get of ``operations`` (key, at, op_id, op: get or set) with the last set before it and whether it hits.

    A key's operations are taken hour by hour, so a hot key is as many groups; what was set before an
    hour comes from one row an hour and key.
    """
    wrote = F.when(F.col("op") == "set", F.col("at"))
    df = operations.withColumn("hour", F.date_trunc("hour", "at"))
    before = lambda *keys: Window.partitionBy(*keys)
    hours = df.groupBy("key", "hour").agg(F.max(wrote).alias("last"))
    earlier = F.max("last").over(before("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select(F.col("key").alias("own_key"), F.col("hour").alias("own_hour"), earlier.alias("earlier"))
    within = F.max(wrote).over(before("key", "hour").orderBy("at", "op_id").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("within", within).filter("op = 'get'")
    df = df.join(hours, df["key"].eqNullSafe(hours["own_key"]) & df["hour"].eqNullSafe(hours["own_hour"]))
    df = df.withColumn("written_at", F.coalesce("within", "earlier")).drop("hour", "own_key", "own_hour", "within", "earlier")
    age = F.timestamp_diff("SECOND", "written_at", "at")
    return df.withColumn("hit", F.coalesce(age < ttl_seconds, F.lit(False)))


def cache_writes(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """``cache`` (cache_key, written_at, ttl_s and a payload) after ``writes`` of the same columns: the last write of each key replaces its entry."""
    columns = cache.columns
    last = writes.groupBy("cache_key").agg(F.max_by(F.struct(*columns), "written_at").alias("v")).select("v.*")
    return cache.join(last, "cache_key", "left_anti").select(*columns).unionByName(last)


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Entries (cache_key, written_at, ttl_s) that haven't expired at ``now``, the last written of each key."""
    live = cache.filter(F.timestamp_diff("SECOND", "written_at", now) < F.col("ttl_s"))
    return live.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "cache_key"]), "written_at").alias("v")).select("cache_key", "v.*")


def retry_schedule(jobs: DataFrame, attempts: int = 3, backoff_s: int = 5) -> DataFrame:
    """For each failed job (job_id) the attempts after the first, and how long each waits: 5 s, doubled every time."""
    nth = jobs.select("job_id", F.explode(F.sequence(F.lit(2), F.lit(attempts))).alias("attempt"))
    return nth.withColumn("delay_s", (F.lit(backoff_s) * F.pow(F.lit(2), F.col("attempt") - 2)).cast("long"))
