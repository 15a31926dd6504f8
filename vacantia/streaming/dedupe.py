"""Duplicate removal on a stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_sightings(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of the keys that arrive within the watermark delay; state stays bounded by it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


class _Sightings(StatefulProcessor):
    """Remembers each key's first event time until the watermark has left it behind by ``keep`` milliseconds."""

    def __init__(self, event_time: str, keep: int):
        self.event_time, self.keep = event_time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        late = found[self.event_time].astype("datetime64[us]").astype("int64") // 1000 < timerValues.getCurrentWatermarkInMs()
        found = found[~late]
        if found.empty or self.seen.exists():
            return
        first = found.loc[[found[self.event_time].idxmin()]] if found.index.is_unique else found.sort_values(
            self.event_time, kind="stable").iloc[[0]]
        moment = first[self.event_time].iloc[0]
        self.seen.update((moment.to_pydatetime(),))
        self.handle.registerTimer(int(moment.value // 1_000_000) + self.keep)
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_sightings_kept(stream: DataFrame, keys: list[str], event_time: str, delay: str, keep_hours: float) -> DataFrame:
    """The first row of each key, remembered for ``keep_hours`` of event time after it; rows behind the watermark are dropped.

    The first to arrive wins over all that come in later micro-batches, whatever their time; within one the earliest. A key
    that comes again after that time is a first sighting again. Needs the RocksDB state store, which keeps state on disk.
    """
    marked = stream.withWatermark(event_time, delay)
    return marked.groupBy(*keys).transformWithStateInPandas(
        _Sightings(event_time, int(keep_hours * 3_600_000)), stream.schema, "Append", "EventTime")
