"""Session memory as keyed streaming state.

A session's last messages lie in a ring of a state map, a message a slot, and the number of messages with the
summary of older ones in a state value. A message writes one slot and the value, never the rest of the
session. State lives in RocksDB, so that sessions need not fit in memory, and may be given a time to live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Settings
from ..operators.memory import compact

OUTPUT = "session_id long, n_messages long, n_kept long, summary string, last_turn long"
#: The role of an event that clears its session.
CLEAR = "clear"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which keyed state needs; the session's setting stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class SessionMemory(StatefulProcessor):
    """After each batch the state of its sessions; messages of a batch are taken in order of turn."""

    def __init__(self, settings: Settings, summarizer: Callable[[str], str] | None, ttl_ms: int | None):
        self.window, self.chars, self.summarizer, self.ttl = 2 * settings.window_rounds, settings.summary_chars, summarizer, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "slot int", "role string, text string", self.ttl)
        self.past = handle.getValueState("past", "seen long, summary string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = sorted((r for f in rows for r in f[["turn", "role", "text"]].itertuples(index=False, name=None)), key=lambda r: (r[0], r[1]))
        seen, summary = self.past.get() if self.past.exists() else (0, "")
        for _, role, text in new:
            if role == CLEAR:
                self.ring.clear()
                seen, summary = 0, ""
                continue
            slot = seen % self.window
            if seen >= self.window and self.ring.containsKey((slot,)):
                summary = compact(summary, [tuple(self.ring.getValue((slot,)))], self.summarizer, self.chars)
            self.ring.updateValue((slot,), (role, text or ""))
            seen += 1
        if seen:
            self.past.update((seen, summary))
        else:
            self.past.clear()
        yield pd.DataFrame({"session_id": [key[0]], "n_messages": [seen], "n_kept": [min(seen, self.window)], "summary": [summary], "last_turn": [new[-1][0]]})

    def close(self) -> None:
        pass


def session_memory(messages: DataFrame, settings: Settings = DEFAULTS, summarizer: Callable[[str], str] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """messages(session_id, turn, role, text) as a stream, to be started within `state_store`: after each batch the state of its sessions.

    A session keeps the window's messages and a bounded summary of older ones. Batches are expected in order of turns. A row of the
    role `clear` empties its session, which starts anew with the next message; a session without messages for ttl_ms is forgotten.
    """
    processor = SessionMemory(settings, summarizer, ttl_ms)
    return messages.groupBy("session_id").transformWithStateInPandas(processor, OUTPUT, "update", "none" if ttl_ms is None else "processingTime")
