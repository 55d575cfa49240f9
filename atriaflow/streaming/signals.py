"""Structured Streaming: commit once, force links and running channel statistics (T3-T5); `ingest` has T1 and T2."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def commit_once(stream: DataFrame, keys: list[str], at: str, watermark: str) -> DataFrame:
    """Each key once within the watermark, however often a rescan brings it."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def stream_force_link(points: DataFrame, windows: DataFrame, watermark: str = "10 minutes", longest: str = "1 hour", unmatched: bool = False) -> DataFrame:
    """T4: points(study_id, point_id, at) with the windows(study_id, data_uri, starts, ends) that hold them, as both arrive.

    The state of a side ends with the watermark and the longest window; points that come later are dropped, and counted in the query's progress
    (`late_rows`). With `unmatched`, points without a window follow once none can come any more. `stream_one_force` keeps the one window of a point.
    """
    return _timed_links(points.withWatermark("at", watermark), windows.withWatermark("starts", watermark), longest, unmatched)


def _timed_links(points: DataFrame, windows: DataFrame, longest: str, unmatched: bool) -> DataFrame:
    p = points.select(F.col("study_id").alias("p_study"), "point_id", "at")
    return p.join(windows, F.expr(f"p_study = study_id AND at >= starts AND at <= ends AND at <= starts + INTERVAL {longest}"), "left" if unmatched else "inner")


_ROWS = ["t", "until", "id", "of_point"]
_LINK = "study_id long, point_id string, t long, n long, data_uri string"


def _one_window(rows: pd.DataFrame, longest: int) -> pd.DataFrame:
    """The points of rows with the number of their windows, and the window if it is one.

    Windows by time are counted, not met: those that have begun until a point, less those that have ended before it; the same with their places added up gives the place
    of the one that is left.
    """
    point, named = rows["until"].isna(), rows["of_point"].notna()
    points, timed, named = rows[point], rows[~point & ~named], rows[named]
    t, place = points["t"].to_numpy(np.int64), np.arange(len(timed))
    n = total = np.zeros(len(t), np.int64)
    for sign, c, side in ((1, "t", "right"), (-1, "until", "left")):
        edge = timed[c].to_numpy(np.int64)
        order = np.argsort(edge, kind="stable")
        before = np.searchsorted(edge[order], t, side)
        n, total = n + sign * before, total + sign * np.r_[0, np.cumsum(place[order])][before]
    uri = np.full(len(t), None, object)
    uri[n == 1] = timed["id"].to_numpy(object)[total[n == 1]]
    own = pd.DataFrame({"of_point": points["id"].to_numpy(object), "p": t, "row": np.arange(len(t))}).dropna(subset=["of_point"]).merge(named[["of_point", "t", "id"]], on="of_point")
    own = own[(own["p"] - own["t"]).abs() <= longest]
    more = np.bincount(own["row"], minlength=len(t))
    uri[own["row"]] = own["id"]
    n = n + more
    return pd.DataFrame({"point_id": points["id"].to_numpy(object), "t": t, "n": n, "data_uri": np.where(n == 1, uri, None)})


class _OneWindow(StatefulProcessor):
    """Points and windows of a stretch of time of a study. When no more windows can come, the points go out with the one that they have, or with none."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("rows", "t array<long>, until array<long>, id array<string>, of_point array<string>")

    def _out(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return _one_window(rows, self.longest).assign(study_id=key[0])[["study_id", "point_id", "t", "n", "data_uri"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] is None or pd.isna(key[1]):  # points without a time: no window is theirs
            for part in rows:
                yield pd.DataFrame({"study_id": key[0], "point_id": part["id"], "t": None, "n": 0, "data_uri": None})
            return
        for part in rows:
            self.state.appendValue(tuple([None if pd.isna(x) else kind(x) for x in part[c]] for c, kind in zip(_ROWS, (int, int, str, str))))
        # a window that names a point begins at most so long after the stretch
        self.handle.registerTimer((int(key[1]) + 2) * self.longest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame(dict(zip(_ROWS, map(list, x))), dtype=object) for x in self.state.get()]
        self.state.clear()
        if parts:
            yield self._out(key, pd.concat(parts, ignore_index=True))

    def close(self) -> None:
        pass


def stream_one_force(points: DataFrame, windows: DataFrame, watermark: str = "10 minutes", longest: timedelta = timedelta(hours=1)) -> DataFrame:
    """T4 with J7's rule: every point with its one window; those with none or several have no data_uri, and ``n`` says how many there were.

    windows(study_id, data_uri, starts, ends[, of_point]): a window that names a point is its, if it starts within `longest` of it. Points and windows of a study meet
    in a state for each stretch of time as long as `longest` (a window goes to the two or three that it can reach); it ends, and lets its points go, once the watermark has
    passed it by the longest window. No rows for pairs: time and state grow with points and windows. Needs the keyed state of `ingest.keyed_state`.
    """
    if "of_point" not in windows.columns:
        windows = windows.withColumn("of_point", F.lit(None).cast("string"))
    span = max(longest // timedelta(microseconds=1), 1)
    slot = lambda m: ((m - F.pmod(m, F.lit(span))) / span).cast("long")
    # the time of each side moves on its own; the earlier one counts
    p, w = points.withWatermark("at", watermark), windows.withWatermark("starts", watermark)
    none = lambda kind: F.lit(None).cast(kind)
    t = F.unix_micros("at")
    p = p.select(F.col("study_id").cast("long").alias("study_id"), slot(t).alias("slot"), "at", t.alias("t"), none("long").alias("until"), F.col("point_id").cast("string").alias("id"), none("string").alias("of_point"))
    t, named = F.unix_micros("starts"), F.col("of_point").isNotNull()
    until = F.least(F.unix_micros("ends"), t + span)
    w = w.filter(F.col("study_id").isNotNull() & F.col("data_uri").isNotNull() & F.col("starts").isNotNull() & (named | (F.col("ends") >= F.col("starts"))))
    slots = F.when(named, F.sequence(slot(t - span), slot(t + span))).otherwise(F.sequence(slot(t), slot(until)))
    w = w.select(F.col("study_id").cast("long").alias("study_id"), F.explode(slots).alias("slot"), F.col("starts").alias("at"), t.alias("t"), F.when(named, t).otherwise(until).alias("until"), F.col("data_uri").cast("string").alias("id"), F.col("of_point").cast("string").alias("of_point"))
    out = p.unionByName(w).groupBy("study_id", "slot").transformWithStateInPandas(_OneWindow(span), _LINK, "Append", "EventTime")
    return out.select("study_id", "point_id", F.timestamp_micros("t").alias("at"), "n", "data_uri")


def late_rows(query) -> int:
    """Rows that a query dropped so far as later than its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_channel_stats(samples: DataFrame, window: str | None = None, slide: str | None = None, gap: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """T5: least, largest, mean and number per channel in tumbling, sliding or session windows of samples(data_uri, channel, ts, value)."""
    over = F.session_window("ts", gap) if gap else F.window("ts", window, slide) if slide else F.window("ts", window)
    out = samples.withWatermark("ts", watermark).groupBy(over.alias("w"), "data_uri", "channel")
    return out.agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.count("*").alias("n")).select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "data_uri", "channel", "min_value", "max_value", "mean_value", "n")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table at path: appended, or (complete, update) as its last result."""
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = sink.format("parquet").start(path)
    else:
        query = sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
