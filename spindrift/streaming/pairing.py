"""Stateful pairing of two kinds of events with a time limit, in event time.

Opening rows wait in keyed state; a closing row takes the latest that is young enough, once. A timer drops what has
waited too long and reports it. Batch and stream share their rule: operators.link.consume_once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.link import micros

PAIR = "user_id long, open_id long, close_id long, gap double, expired boolean"


class PairProcessor(StatefulProcessor):
    """Map state of open rows by id with their time; rows of a batch are taken in time order."""

    def __init__(self, opens: str, closes: str, seconds: int) -> None:
        self.opens, self.closes, self.limit = opens, closes, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, value = StructType([StructField("id", LongType())]), StructType([StructField("t", LongType())])
        self.open = handle.getMapState("open", key, value)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        every = pd.concat(frames).sort_values(["t", "event_id"]) if frames else pd.DataFrame(columns=["t", "event_id", "event_type"])
        waiting = sorted(((v[0], k[0]) for k, v in self.open.iterator()))
        before = {k for _, k in waiting}
        out = []
        for t, event, kind in every[["t", "event_id", "event_type"]].itertuples(index=False, name=None):
            while waiting and t - waiting[0][0] > self.limit:
                out.append((key[0], waiting.pop(0)[1], None, None, True))
            if kind == self.opens:
                waiting.append((int(t), int(event)))
            elif waiting:
                s, o = waiting.pop()
                out.append((key[0], o, int(event), (t - s) / 1e6, False))
        after = {k: t for t, k in waiting}
        for k in before - after.keys():
            self.open.removeKey((k,))
        for k, t in after.items():
            if k not in before:
                self.open.updateValue((k,), (t,))
        yield pd.DataFrame({"user_id": pd.Series([r[0] for r in out], dtype="int64"), "open_id": pd.Series([r[1] for r in out], dtype="int64"), "close_id": pd.Series([r[2] for r in out], dtype="Int64"), "gap": pd.Series([r[3] for r in out], dtype="float64"), "expired": pd.Series([r[4] for r in out], dtype="bool")})

    def close(self) -> None:
        pass


def paired(events: DataFrame, opens: str = "view", closes: str = "purchase", seconds: int = 3600) -> DataFrame:
    """PAIR rows of a stream of (event_id, ts, user_id, event_type)."""
    lean = events.filter(F.col("event_type").isin(opens, closes)).select("user_id", "event_id", micros("ts").alias("t"), "event_type")
    return lean.groupBy("user_id").transformWithStateInPandas(statefulProcessor=PairProcessor(opens, closes, seconds), outputStructType=PAIR, outputMode="Append", timeMode="None")
