"""Event-time logic over taps: trailing debounce, and the stateful double-tap detector, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GAP_MS = 180
DOUBLE_S = 0.45


def debounced(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Events that no event of the same user follows within the gap."""
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(later.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) > gap_ms * 1000
    return events.where("ts is not null").withColumn("_quiet", F.coalesce(gap, F.lit(True))).where("_quiet").drop("_quiet")


TAPS = "user_id bigint, event_id bigint, action string"


def _step(last: tuple | None, band, at: float, within: float) -> tuple[str, tuple | None]:
    """What a tap does, and what is remembered: the same band again in time acts and forgets."""
    if last is not None and last[0] == band and at - last[1] <= within:
        return ("reset" if band == "" else "focus"), None
    return "inspect", (band, at)


def double_taps(taps: DataFrame, within: float = DOUBLE_S) -> DataFrame:
    """Action of every tap (user_id, event_id, ts, band): inspect, or focus / reset on the second of a pair.

    Taps of one band in time of each other are a chain, in which every second tap acts, as ``_step`` does tap by tap. Windows sort a
    user's taps outside Python and spill.
    """
    taps = _keyed(taps)
    w = Window.partitionBy("user_id").orderBy(F.col("at"), F.col("event_id").asc_nulls_last())
    linked = (F.lag("band").over(w) == F.col("band")) & (F.col("at") - F.lag("at").over(w) <= within)
    placed = taps.withColumns({"_n": F.row_number().over(w), "_linked": F.coalesce(linked, F.lit(False))})
    first = F.max(F.when(~F.col("_linked"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    acts = (F.col("_n") - first) % 2 == 1
    action = F.when(acts & (F.col("band") == ""), "reset").when(acts, "focus").otherwise("inspect")
    return placed.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), action.alias("action"))


def _keyed(taps: DataFrame) -> DataFrame:
    band = F.coalesce(F.col("band").cast("string"), F.lit(""))
    return taps.where("user_id is not null and ts is not null").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), band.alias("band"))


def double_tap_stream(taps: DataFrame, within: float = DOUBLE_S) -> DataFrame:
    """The same detector over a stream: state per user is the last unmatched tap. Taps of one batch are taken in event order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        if state.exists:
            band, at = state.get
            last = None if at is None or at < 0 else (band, at)
        group = pd.concat(list(batches)).sort_values(["at", "event_id"])  # one user's taps of a batch
        actions = []
        for band, at in zip(group["band"], group["at"], strict=True):
            action, last = _step(last, band, at, within)
            actions.append(action)
        state.update(last if last else ("", -1.0))
        yield pd.DataFrame({"user_id": group["user_id"], "event_id": group["event_id"], "action": actions})

    return _keyed(taps).groupBy("user_id").applyInPandasWithState(run, TAPS, "band string, at double", "append", GroupStateTimeout.NoTimeout)


QUIET = "user_id bigint, event_id bigint, ts timestamp"


class Quiet(StatefulProcessor):
    """Per user, events that still wait for their quiet time to end; a timer at that end tells which were followed."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(us), int(i)) for batch in rows for us, i in zip(batch["us"], batch["event_id"], strict=True)]
        self.waiting.appendList(new)
        for due in {us // 1000 + 1 + self.gap_ms for us, _ in new}:
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        gap = self.gap_ms * 1000
        due = [k for k, (us, _) in enumerate(waiting) if us + gap < now]  # all that may follow these has come
        quiet = [waiting[k] for k in due if k + 1 == len(waiting) or waiting[k + 1][0] - waiting[k][0] > gap]
        left = waiting[len(due) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if quiet:
            yield pd.DataFrame({"user_id": key[0], "event_id": [i for _, i in quiet], "ts": pd.to_datetime([us for us, _ in quiet], unit="us")})

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, gap_ms: int = GAP_MS, late: str = "10 seconds") -> DataFrame:
    """``debounced`` over a stream: an event comes out once the watermark has passed the end of its quiet time, if none of its user came in it.

    Events may come in any order within ``late``; later ones are left out. State holds a user's events of the last ``late`` and gap only. Rows
    without a user, id or time are left out.
    """
    seen = events.where("user_id is not null and event_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    keyed = seen.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return keyed.groupBy("user_id").transformWithStateInPandas(Quiet(gap_ms), QUIET, "Append", "eventTime")
