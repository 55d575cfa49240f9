"""Structured Streaming over a drop folder: bundles that are ready, and the jobs that import them (T1, T2), as keyed state.

Both keep a value per key in Spark's state store (``transformWithState``), so a batch reads and writes what it holds, however many
bundles and jobs are known. State, offsets and results share the query's checkpoint: a run that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state with timers needs, for a query that starts inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


# ---- bundles of a drop folder --------------------------------------------------------------------------


def bundle_state(files: DataFrame, quiescence: float = 5.0, require_marker: bool = False) -> DataFrame:
    """Of files(path, modified timestamp, length, seen timestamp), the bundles of a drop folder and whether they are ready.

    path is relative to the folder. Bundles are its folders and its ``.zip`` files; loose files, hidden entries and markers are none. A
    marker is an entry ``<bundle>.done`` beside the bundle. With `require_marker` a bundle is ready when it has one; without, markers mean nothing, and a
    bundle is ready when its newest file is `quiescence` seconds old. A path that ends in a slash is a folder itself: its time counts if it holds no file.
    """
    parts = F.split("path", "/")
    entry = F.get(parts, F.lit(0))
    done = entry.endswith(".done")
    own = files.select(
        F.when(done, F.substring(entry, F.lit(1), F.length(entry) - 5)).otherwise(entry).alias("bundle"), done.alias("done"), (F.size(parts) > 1).alias("inside"),
        (F.element_at(parts, -1) == "").alias("folder"), "modified", "length", "seen",
    )
    file = ~F.col("done") & ~F.col("folder")
    state = own.groupBy("bundle").agg(
        F.max("done").alias("marked"), F.max(~F.col("done") & F.col("inside")).alias("folder"), F.count_if(~F.col("done")).alias("n"), F.count_if(file).alias("n_files"),
        F.coalesce(F.sum(F.when(file, F.col("length"))), F.lit(0)).alias("n_bytes"), F.max(F.when(file, F.col("modified"))).alias("newest"),
        F.max(F.when(~F.col("done"), F.col("modified"))).alias("own"), F.max("seen").alias("seen"),
    )
    bundle = F.col("bundle")
    state = state.filter((F.col("n") > 0) & (F.col("folder") | F.lower(bundle).endswith(".zip")) & ~bundle.startswith(".") & ~bundle.endswith(".done"))
    modified = F.coalesce("newest", "own")
    quiet = (F.unix_micros("seen") - F.unix_micros(modified)) / 1e6 >= quiescence
    return state.select("bundle", "marked", "n_files", "n_bytes", modified.alias("modified"), "seen", (F.col("marked") if require_marker else F.coalesce(quiet, F.lit(False))).alias("ready"))


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), modified, length, seen of what a folder holds now.

    Spark lists the files below (all but those whose names begin with a dot or an underscore, which its sources pass over); the file system names the
    folder's own entries, so that empty folders, and markers that are folders or such files, are seen too.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(path).toString().rstrip("/")
    own = [(f.getPath().getName() + "/" * f.isDirectory(), f.getModificationTime(), f.getLen()) for f in (system.listStatus(path) if system.exists(path) else [])]
    top = spark.createDataFrame(own, "path string, ms long, length long").select("path", F.timestamp_millis("ms").alias("modified"), "length")
    if any(name.endswith("/") for name, _, _ in own):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        # relative to the whole root, whatever its names are made of
        below = files.filter(F.col("path").startswith(root + "/")).select(F.substring("path", len(root) + 2, 2**31 - 1).alias("path"), F.col("modificationTime").alias("modified"), "length")
        top = top.unionByName(below.filter(F.col("path").contains("/")))
    return top.withColumn("seen", F.current_timestamp())


_SEEN = "bundle string, marked boolean, n_files long, n_bytes long, modified timestamp, seen timestamp"
_READY = "bundle string, n_files long, n_bytes long, modified timestamp, ready_at timestamp"


class _Readiness(StatefulProcessor):
    """One bundle: what was last seen of it, and whether it was taken. A timer waits for the end of its quiet time."""

    def __init__(self, quiescence: float, require_marker: bool):
        self.quiet, self.require_marker = timedelta(seconds=quiescence), require_marker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bundle", "n_files long, n_bytes long, modified timestamp, taken boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.state.exists() and self.state.get()[3]:
            return
        last = max(rows, key=lambda r: r["seen"])
        ready = last["marked"] if self.require_marker else last["seen"] - last["modified"] >= self.quiet
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((last["n_files"], last["n_bytes"], last["modified"], ready))
        if ready:
            yield Row(bundle=key[0], n_files=last["n_files"], n_bytes=last["n_bytes"], modified=last["modified"], ready_at=last["seen"])
        elif not self.require_marker:
            self.handle.registerTimer(int((last["modified"] + self.quiet).timestamp() * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n_files, n_bytes, modified, taken = self.state.get()
        if not taken:
            self.state.update((n_files, n_bytes, modified, True))
            yield Row(bundle=key[0], n_files=n_files, n_bytes=n_bytes, modified=modified, ready_at=modified + self.quiet)

    def close(self) -> None:
        pass


def ready_bundles(seen: DataFrame, quiescence: float = 5.0, require_marker: bool = False) -> DataFrame:
    """A stream of what was seen of bundles (the columns of `bundle_state`) -> each bundle once, when it is ready.

    A bundle that is reported again with newer files starts its quiet time anew; one that is not reported again is ready when the time of the
    reports (``seen``) has passed its quiet time.
    """
    keyed = seen.select(*[c.split()[0] for c in _SEEN.split(", ")]).withWatermark("seen", "0 seconds").groupBy("bundle")
    return keyed.transformWithState(_Readiness(quiescence, require_marker), _READY, "Append", "EventTime")


def watch_bundles(spark: SparkSession, drop_dir: str, table_path: str, checkpoint: str, quiescence: float = 5.0, require_marker: bool = False) -> DataFrame:
    """Looks into the drop folder once, and takes what is ready into a table of bundles, each once; run it again and again.

    What is seen goes as one small file to an inbox below table_path, which the stream reads (and cleans): a file source would show a file once, and never
    its later changes.
    """
    inbox, out = f"{table_path}/inbox", f"{table_path}/bundles"
    bundle_state(list_folder(spark, drop_dir), quiescence, require_marker).select(*[c.split()[0] for c in _SEEN.split(", ")]).write.mode("append").parquet(inbox)
    seen = spark.readStream.schema(_SEEN).option("cleanSource", "delete").parquet(inbox)
    with keyed_state(spark):
        query = ready_bundles(seen, quiescence, require_marker).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return spark.read.schema(_READY).parquet(out)


# ---- jobs ----------------------------------------------------------------------------------------------

#: States of an import job, in order.
STATES = ["detected", "needs_review", "importing", "done", "error"]
#: Batches whose changes are put together into one folder, and so many of these again.
MERGE = 8


def _order(state: str = "state") -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), F.col(state))


def advance(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """jobs(path, state, message) after events(path, state, message): a job only moves forward; an error is final; new paths start."""
    both = jobs.select("path", "state", "message").unionByName(events.select("path", "state", "message"))
    return both.groupBy("path").agg(F.max(F.struct(_order().alias("n"), "state", "message")).alias("s")).select("path", "s.state", "s.message")


def require_store(events: DataFrame, store: str | None) -> DataFrame:
    """events(path, state, message, with_signals): an import that wants signals, but has no store for them, is an error before anything is written."""
    lacks = F.coalesce("with_signals", F.lit(False)) & (F.col("state") == "importing") & F.lit(store is None)
    return events.withColumn("message", F.when(lacks, "signals were asked for, but there is no store for them").otherwise(F.col("message"))).withColumn("state", F.when(lacks, "error").otherwise(F.col("state"))).drop("with_signals")


_JOB = "path string, state string, message string"


class _Job(StatefulProcessor):
    """One path: its state and message. Gives a row when they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "state string, message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.state.get()) if self.state.exists() else None
        order = lambda s: (STATES.index(s[0]) if s[0] in STATES else -1, s[1] is not None, s[1] or "")
        best = max(([now] if now else []) + [(r["state"], r["message"]) for r in rows], key=order)
        if best != now:
            self.state.update(best)
            yield Row(path=key[0], state=best[0], message=best[1])

    def close(self) -> None:
        pass


def job_changes(events: DataFrame) -> DataFrame:
    """A stream of events(path, state, message) -> the jobs that each batch changes."""
    return events.select("path", "state", "message").groupBy("path").transformWithState(_Job(), _JOB, "Update", "None")


def _merge(spark: SparkSession, table_path: str, epoch: int) -> None:
    """Puts the changes of MERGE batches together, and MERGE such folders again: a change is written once per level, and what was put together goes.

    A job's state only grows, so a change that is read twice (after a stop between writing and removing) does no harm.
    """
    level, span = 0, MERGE
    while (epoch + 1) % span == 0:
        parts = [f"{table_path}/level={level}/upto={e}" for e in range(epoch + 1 - span + span // MERGE - 1, epoch + 1, span // MERGE)]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        there = [p for p in parts if path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))]
        if there:
            changes = spark.read.schema(_JOB).parquet(*there)
            advance(changes.limit(0), changes).write.mode("overwrite").parquet(f"{table_path}/level={level + 1}/upto={epoch}")
        for p in there:
            path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(p), True)
        level, span = level + 1, span * MERGE


def run_jobs(events: DataFrame, table_path: str, checkpoint: str):
    """A query that keeps the jobs as keyed state and writes what a batch changes; `job_table` reads them."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/level=0/upto={epoch}")
        _merge(batch.sparkSession, table_path, epoch)

    with keyed_state(events.sparkSession):
        return job_changes(events).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The jobs as they stand: the furthest of the states that were written for each path."""
    changes = spark.read.schema(f"{_JOB}, level int, upto long").parquet(table_path)
    return advance(changes.limit(0), changes)

