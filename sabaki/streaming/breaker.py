"""Circuit breakers over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shipping import ship
from ..operators.resilience import Breaker, succeeded

OUTPUT = "key string, at_ms long, call_id long, ok boolean, met string, allowed boolean, state string, failures int"
STATE = "state string, failures int, failed_at long"


def stream_circuit_breaker(calls: DataFrame, threshold: int = 5, recovery_ms: int = 30_000, timeout_ms: int = 30_000) -> DataFrame:
    """As ``operators.resilience.circuit_breaker`` for a stream (key, at_ms, call_id, ok, perhaps took_ms): circuits live on between batches.

    Calls of a batch are taken in order of time and id.
    """

    def run(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        circuit = Breaker(threshold, recovery_ms)
        if state.exists:
            circuit.state, circuit.failures, circuit.failed_at = state.get
        rows = pd.concat(list(batches)).sort_values(["at_ms", "call_id"], kind="stable")
        out = []
        for at, good in zip(rows["at_ms"], rows["good"], strict=True):
            out.append((*circuit.observe(int(at), bool(good)), circuit.state, circuit.failures))
        state.update((circuit.state, circuit.failures, circuit.failed_at))
        yield rows[["at_ms", "call_id", "ok"]].assign(key=key[0], **{c: [o[i] for o in out] for i, c in enumerate(("met", "allowed", "state", "failures"))})[["key", "at_ms", "call_id", "ok", "met", "allowed", "state", "failures"]]

    ship(calls.sparkSession)
    calls = calls.select("key", "at_ms", "call_id", "ok", succeeded(calls, timeout_ms).alias("good"))
    return calls.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
