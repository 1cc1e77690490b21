"""Session profiles as a stateful stream: same step as the batch fold, state in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from jobatlas.functions.turns import turn_signals
from jobatlas.operators.sessions import EVENT_COLUMNS, SNAPSHOT, apply_event, as_event, snapshot

STATE = StructType([StructField("body", StringType())])
DAY_MS = 24 * 60 * 60 * 1000


class SessionProfile(StatefulProcessor):
    """Profile state of one session; erased on request and, with a TTL, expired without events."""

    def __init__(self, ttl_ms: int | None = DAY_MS) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ttl_ms is None:
            self.state = handle.getValueState("profile", STATE)
        else:
            self.state = handle.getValueState("profile", STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for row in batch.to_dict("records"):
            event = as_event(row)
            if event["erase"]:
                state = None
                continue
            state, changed = apply_event(state, event)
            out.append(snapshot(key[0], event["seq"], state, event, changed))
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state, ensure_ascii=False),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def session_profiles(events: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """Streaming snapshots of ``session_id, seq, journey_mode, text, patch, erase`` events.

    One micro-batch of one session is ordered by ``seq``; its size is bounded by the
    source's trigger limits.  Needs the RocksDB state store provider.  A TTL keeps
    processing time running, so catch-up runs that should end pass ``ttl_ms=None``.
    """
    signals = turn_signals(events).select(*EVENT_COLUMNS, F.coalesce("erase", F.lit(False)).alias("erase"))
    return signals.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionProfile(ttl_ms), outputStructType=SNAPSHOT, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
