"""Messages whose id has not been seen lately: keyed state of its own, bounded in time and in number.

Ids are dealt into buckets by hash. A bucket's state is one value, the ids it has
passed on and when, oldest first; a timer forgets ids once the watermark has
gone ``keep`` beyond their time, and a bucket that holds more than ``limit``
forgets the oldest, or all of them, after each micro-batch. Of several messages
of one id in a micro-batch the earliest passes. Messages behind the watermark are
dropped, since their ids may be forgotten already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that states of one's own need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATE = "ids array<string>, times array<bigint>"


def _processor(names: list[str], id_column: str, keep_ms: int, limit: int, clear: bool) -> StatefulProcessor:
    # a class of the function, so that it travels with the query and executors need no module
    class Seen(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", STATE)

        def held(self, watermark: int) -> list[tuple[int, str]]:
            """Time and id of what is remembered, oldest first."""
            if not self.seen.exists():
                return []
            ids, times = self.seen.get()
            return [(t, i) for t, i in zip(times, ids) if t + keep_ms > watermark]

        def keep(self, held: list[tuple[int, str]]) -> None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not held:
                self.seen.clear()
                return
            self.seen.update(([i for _, i in held], [t for t, _ in held]))
            self.handle.registerTimer(held[0][0] + keep_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs()
            held = self.held(watermark)
            known = {i for _, i in held}
            first = None
            for df in rows:
                df = df.set_axis(names, axis=1)  # names with an underscore in front come numbered
                df = df[(df["_at"] > watermark) & df[id_column].notna() & ~df[id_column].isin(known)]
                df = df if first is None else pd.concat([first, df], ignore_index=True)
                again = df[id_column].duplicated(keep=False)
                # of messages of one id and time the first in order of their columns' texts
                tie = df[again].drop(columns="_tie", errors="ignore").astype(str).agg("|".join, axis=1) if again.any() else ""
                df = df.assign(_tie="")
                df.loc[again, "_tie"] = tie
                first = df.sort_values(["_at", "_tie"], kind="stable").drop_duplicates(id_column)
            if first is not None and len(first):
                held = sorted([*held, *zip(first["_at"].tolist(), first[id_column].tolist())])
                yield first.drop(columns="_tie")
            if len(held) > limit:
                held = [] if clear else held[-limit:]
            self.keep(held)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.keep(self.held(timerValues.getCurrentWatermarkInMs()))
            return iter(())

        def close(self) -> None:
            pass

    return Seen()


def milliseconds(spark: SparkSession, interval: str) -> int:
    seconds = spark.range(1).select(F.unix_micros(F.expr(f"timestamp '2000-01-01 00:00:00' + interval {interval}")) - F.unix_micros(F.expr("timestamp '2000-01-01 00:00:00'"))).first()[0]
    return seconds // 1000


def unseen(stream: DataFrame, id_column: str, delay: str, ts: str = "ts", keep: str | None = None, limit: int = 1000, clear: bool = False, buckets: int = 64) -> DataFrame:
    """The first message of each id: flat rows with an id (text) and an event time.

    ``delay`` is how late messages may be, ``keep`` (the delay, if not given)
    how long an id is remembered after its message, ``limit`` the most ids that
    each of the buckets remembers between micro-batches; beyond it the oldest go,
    or with ``clear`` all. The session needs ``ROCKSDB`` when the query starts.
    """
    keep_ms = milliseconds(stream.sparkSession, keep or delay)
    dealt = stream.withWatermark(ts, delay).withColumn("_at", F.unix_millis(ts)).withColumn("_bucket", F.pmod(F.xxhash64(id_column), F.lit(buckets)).cast("int"))
    schema = dealt.schema
    out = dealt.groupBy("_bucket").transformWithStateInPandas(_processor(schema.names, id_column, keep_ms, limit, clear), schema, "Append", "EventTime")
    return out.drop("_bucket", "_at")
