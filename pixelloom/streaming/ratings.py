"""Running measurements of folders as a stream: state that outlives micro-batches, with reset and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Streams with this state need a store that keeps it beside the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunningMedian(StatefulProcessor):
    """For each folder the positive values seen so far: by path, as a value measured again replaces the older one, and in order.

    A folder's values in order are one packed column, so its state is 8 bytes a value and a batch adds to it in one merge; values by path are a
    map that only touched paths are read from.
    """

    def __init__(self, path: str, value: str, order: str, reset: str | None, columns: list[str], expire_ms: int | None):
        self.path, self.value, self.order, self.reset, self.columns, self.expire_ms = path, value, order, reset, columns, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by_path = handle.getMapState("by_path", "path string", "value double", self.expire_ms)
        self.ordered = handle.getValueState("ordered", "packed binary", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A path that Spark has let expire counts no more, so the packed values are those of one life of the state.
        held = self.ordered.get()
        seen = np.frombuffer(held[0], np.float64).tolist() if held else []
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        out = []
        touched: dict[str, float] = {}  # 0: no positive value
        for i in range(len(batch)):
            if self.reset is not None and bool(batch[self.reset].iat[i]):
                seen, touched = [], {}
                self.by_path.clear()
            name, value = batch[self.path].iat[i], batch[self.value].iat[i]
            name = "" if pd.isna(name) else str(name)
            value = 0.0 if pd.isna(value) or not value > 0 else float(value)
            if name in touched:
                before = touched[name]
            else:
                before = self.by_path.getValue((name,))[0] if self.by_path.containsKey((name,)) else 0.0
            if before:
                seen.pop(int(np.searchsorted(seen, before)))
            if value:
                seen.insert(int(np.searchsorted(seen, value)), value)
            touched[name] = value
            out.append(seen[len(seen) // 2] if seen else None)
        for name, value in touched.items():
            self.by_path.updateValue((name,), (value,))
        self.ordered.update((np.array(seen, np.float64).tobytes(),))
        batch["running_median"] = pd.array(out, "Float64")
        yield batch[[*self.columns, "running_median"]]


def running_medians(stream: DataFrame, folder: str, path: str, value: str, order: str, reset: str | None = None, expire: str | None = None) -> DataFrame:
    """Adds the upper median of the positive values of a folder seen so far, however the stream is cut into batches.

    A path that comes again replaces its value. A true `reset` empties the folder before the row is taken. With `expire`, such as
    "1 hour", a state that no batch has touched for so long is given up. Rows of one batch are taken by `order`; a stream should not deliver an earlier row in a later batch. Rows without a
    folder are one folder. The session's state store must be STATE_STORE, which is set here if it is not.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)
    ms = None if expire is None else int(pd.Timedelta(expire).total_seconds() * 1000)
    schema = T.StructType([*stream.schema.fields, T.StructField("running_median", T.DoubleType())])
    return stream.groupBy(folder).transformWithStateInPandas(statefulProcessor=RunningMedian(path, value, order, reset, stream.columns, ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ms else "None")
