"""The failure breaker as a stateful streaming operator.

Each source's last outcomes are a ring in the state store. Rows of a
micro-batch are taken in discovery order, frame by frame, and judged together on
running sums; from the row that trips it on, the breaker stays open.
"""

from __future__ import annotations

import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels to the executors by value: they need no copy of this
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


FRAME = 10_000               # rows handed on at once


class Breaker(StatefulProcessor):
    def __init__(self, rate: float = 0.4, window: int = 20, min_sample: int = 10):
        self.rate, self.window, self.min_sample = rate, window, min_sample

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "recent string, tripped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        recent, tripped = self.ring.get() if self.ring.exists() else ("", False)
        # of each frame only order and outcome are held, nine bytes a row; a trigger caps the rows of a batch
        parts = [(f["ord"].to_numpy(np.int64), f["failed"].to_numpy(bool)) for f in rows]
        order, failed = (np.concatenate(c) for c in zip(*parts))
        at = np.argsort(order, kind="stable")
        order, failed = order[at], failed[at]
        before = np.array([c == "1" for c in recent], bool)
        upto = np.concatenate([[0], np.cumsum(np.concatenate([before, failed]))])
        end = np.arange(len(before) + 1, len(before) + len(failed) + 1)
        start = np.maximum(end - self.window, 0)
        seen = end - start
        over = (seen >= self.min_sample) & ((upto[end] - upto[start]) / seen >= self.rate)
        trip = -1 if tripped else int(np.argmax(over)) if over.any() else len(failed)
        last = np.concatenate([before, failed])[-self.window:]
        self.ring.update(("".join("1" if x else "0" for x in last), bool(tripped or trip < len(failed))))
        place = np.arange(len(failed))
        for a in range(0, len(failed), FRAME):
            b = slice(a, a + FRAME)
            yield pd.DataFrame({"source": key[0], "ord": order[b], "failed": failed[b], "trips": place[b] == trip,
                                "reached": place[b] <= trip})

    def close(self) -> None:
        pass


def breaker_stream(measured: DataFrame, rate: float = 0.4, window: int = 20, min_sample: int = 10) -> DataFrame:
    """``measured(source, ord, failed)`` with ``trips`` and ``reached``."""
    return measured.groupBy("source").transformWithStateInPandas(
        Breaker(rate, window, min_sample), "source string, ord long, failed boolean, trips boolean, reached boolean",
        "Append", "None")
