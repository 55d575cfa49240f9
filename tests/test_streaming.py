"""Streams that run: drop folders, jobs, rescans, late points and windows, each with a restart from its checkpoint."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from atriaflow.plans import registry
from atriaflow.streaming import ingest
from atriaflow.streaming import signals as streams

T0 = datetime(2024, 5, 1, 12)


def put(spark, folder, rows, schema):
    """One more file in a folder that a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def file_in(folder, *parts):
    path = os.path.join(folder, *parts)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("x")
    return path


def aged(path, seconds):
    """A file as if it had last changed so many seconds ago."""
    then = time.time() - seconds
    os.utime(path, (then, then))


@pytest.fixture(params=["drop", "x.drop+1/a b/drop"])
def folder(request, tmp_path):
    drop = str(tmp_path / request.param)
    os.makedirs(drop)
    return drop


def watched(spark, drop, tmp_path, **rules):
    out = ingest.watch_bundles(spark, drop, str(tmp_path / "table"), str(tmp_path / "checkpoint"), **rules).collect()
    assert len(out) == len({r["bundle"] for r in out})
    return {r["bundle"]: r["n_files"] for r in out}


def test_markers_stand_beside_bundles(spark, folder, tmp_path):
    rules = {"require_marker": True}
    aged(file_in(folder, "a", "deep", "m.mesh"), 9000)
    file_in(folder, "a", ".done")  # inside is no marker
    file_in(folder, "b", "drop", "m.mesh")
    file_in(folder, "b.done")
    file_in(folder, "c.zip")
    file_in(folder, "c.zip.done")
    file_in(folder, "loose.txt")
    file_in(folder, "loose.txt.done")
    file_in(folder, ".hidden", "m.mesh")
    os.makedirs(os.path.join(folder, "empty"))
    os.makedirs(os.path.join(folder, "empty.done"))  # whatever the marker is
    assert watched(spark, folder, tmp_path, **rules) == {"b": 1, "c.zip": 1, "empty": 0}
    file_in(folder, "a.done")
    file_in(folder, "b", "later.txt")  # a taken bundle is not taken again
    assert watched(spark, folder, tmp_path, **rules) == {"a": 1, "b": 1, "c.zip": 1, "empty": 0}
    assert watched(spark, folder, tmp_path, **rules) == {"a": 1, "b": 1, "c.zip": 1, "empty": 0}


def test_a_bundle_that_grows_waits(spark, tmp_path):
    """Quiet bundles are taken; one whose file is appended to starts its quiet time anew, over restarts of the query."""
    drop, rules = str(tmp_path / "drop"), {"quiescence": 600.0}
    aged(file_in(drop, "old", "f.xml"), 700)
    aged(file_in(drop, "export.ZIP"), 700)
    growing = file_in(drop, "new", "f.xml")
    aged(growing, 590)
    file_in(drop, "new.done")  # means nothing without require_marker
    assert watched(spark, drop, tmp_path, **rules) == {"old": 1, "export.ZIP": 1}
    with open(growing, "a") as f:
        f.write("more")
    aged(growing, 100)
    assert watched(spark, drop, tmp_path, **rules) == {"old": 1, "export.ZIP": 1}
    aged(growing, 601)
    aged(file_in(drop, "new", "g.xml"), 650)
    assert watched(spark, drop, tmp_path, **rules) == {"old": 1, "export.ZIP": 1, "new": 2}


def test_timers_end_quiet_times(spark, tmp_path):
    """Reports of other bundles move the time on: a bundle that is not reported again is ready when its quiet time is over."""
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))

    def report(*rows):
        put(spark, inbox, [(b, False, 1, 1, T0 + timedelta(seconds=m), T0 + timedelta(seconds=s)) for b, m, s in rows], ingest._SEEN)
        with ingest.keyed_state(spark):
            ingest.ready_bundles(spark.readStream.schema(ingest._SEEN).parquet(inbox), 10.0).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return {(r["bundle"], (r["ready_at"] - T0).total_seconds()) for r in spark.read.schema(ingest._READY).parquet(out).collect()}

    assert report(("a", 0, 2), ("b", 0, 2)) == set()
    assert report(("b", 8, 9)) == set()
    assert report(("c", 14, 15)) == {("a", 10.0)}  # b was changed at 8
    assert report(("b", 8, 19)) == {("a", 10.0), ("b", 19.0)}
    assert report(("c", 14, 30)) == {("a", 10.0), ("b", 19.0), ("c", 30.0)}


def test_jobs_move_forward_over_restarts(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("events", "jobs", "checkpoint"))
    kind = "path string, state string, message string, with_signals boolean"

    def run():
        stream = spark.readStream.schema(kind).parquet(folder)
        ingest.run_jobs(ingest.require_store(stream, None), table, checkpoint).awaitTermination()
        return {r["path"]: r["state"] for r in ingest.job_table(spark, table).collect()}

    put(spark, folder, [("a", "detected", "", False), ("b", "detected", "", True), ("c", "importing", "", None)], kind)
    assert run() == {"a": "detected", "b": "detected", "c": "importing"}
    put(spark, folder, [("a", "done", "", False), ("b", "importing", "", True), ("c", "error", "broken", False)], kind)
    assert run() == {"a": "done", "b": "error", "c": "error"}
    put(spark, folder, [("a", "detected", "", False), ("c", "done", "", False)], kind)
    assert run() == {"a": "done", "b": "error", "c": "error"}
    assert run() == {"a": "done", "b": "error", "c": "error"}


def test_a_batch_writes_what_it_changes(spark, tmp_path, monkeypatch):
    """Bytes of a batch do not grow with the jobs that are known, and folders that were put together go."""
    monkeypatch.setattr(ingest, "MERGE", 2)
    folder, table, checkpoint = (str(tmp_path / n) for n in ("events", "jobs", "checkpoint"))
    for batch in range(5):
        put(spark, folder, [(f"p{batch}-{i}", "detected", "m" * 50) for i in range(400 if batch == 0 else 3)], "path string, state string, message string")
        ingest.run_jobs(spark.readStream.schema("path string, state string, message string").parquet(folder), table, checkpoint).awaitTermination()
        assert ingest.job_table(spark, table).count() == 400 + 3 * batch
    last = [n for n in os.listdir(f"{table}/level=0") if n.startswith("upto")]
    assert last == ["upto=4"] and spark.read.parquet(f"{table}/level=0/upto=4").count() == 3
    assert [n for n in os.listdir(f"{table}/level=2") if n.startswith("upto")] == ["upto=3"] and not [n for n in os.listdir(f"{table}/level=1") if n.startswith("upto")]


def test_rescans_commit_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    kind = "window string, at timestamp"

    def run():
        stream = streams.commit_once(spark.readStream.schema(kind).parquet(folder), ["window"], "at", "1 hour")
        return sorted(r["window"] for r in streams.drained(stream, out, checkpoint).collect())

    put(spark, folder, [("w1", T0), ("w2", T0), ("w1", T0 + timedelta(minutes=1))], kind)
    assert run() == ["w1", "w2"]
    put(spark, folder, [("w2", T0), ("w3", T0 + timedelta(minutes=2))], kind)
    assert run() == ["w1", "w2", "w3"]


def test_force_links_wait_for_late_points(spark, tmp_path):
    """Points within the watermark still match; later ones are dropped and counted; points without a window follow at last."""
    points, windows, out, checkpoint = (str(tmp_path / n) for n in ("points", "windows", "out", "checkpoint"))
    at = lambda m: T0 + timedelta(minutes=m)
    p, w = "study_id long, point_id long, at timestamp", "study_id long, data_uri string, starts timestamp, ends timestamp"

    def run():
        stream = streams.stream_force_link(spark.readStream.schema(p).parquet(points), spark.readStream.schema(w).parquet(windows), "10 minutes", "1 hour", unmatched=True)
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return {(r["point_id"], r["data_uri"]) for r in spark.read.schema(stream.schema).parquet(out).collect()}, streams.late_rows(query)

    put(spark, points, [(1, 1, at(3)), (1, 2, at(50)), (2, 3, at(3))], p)
    put(spark, windows, [(1, "f1", at(0), at(5)), (2, "f2", at(10), at(20))], w)
    assert run() == ({(1, "f1")}, 0)
    put(spark, points, [(1, 4, at(4)), (1, 5, at(600))], p)  # point 4 comes late, yet within what the state holds
    put(spark, windows, [(1, "f9", at(600), at(605))], w)
    got, _ = run()
    assert (5, "f9") in got
    put(spark, points, [(1, 6, at(2))], p)  # ten hours behind the watermark
    put(spark, windows, [(1, "f10", at(700), at(701))], w)
    got, late = run()
    assert late == 1 and {(1, "f1"), (2, None), (3, None), (5, "f9")} <= got and not any(i == 6 for i, _ in got)


def test_each_point_has_one_force_window(spark, tmp_path):
    """By time or by name, counted in state over restarts; points with none or several go out without one."""
    points, windows, out, checkpoint = (str(tmp_path / n) for n in ("points", "windows", "out", "checkpoint"))
    at = lambda m: T0 + timedelta(minutes=m)
    p, w = "study_id long, point_id long, at timestamp", "study_id long, data_uri string, starts timestamp, ends timestamp, of_point string"

    def run():
        stream = streams.stream_one_force(spark.readStream.schema(p).parquet(points), spark.readStream.schema(w).parquet(windows), "10 minutes", timedelta(hours=1))
        with ingest.keyed_state(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["point_id"], r["n"], r["data_uri"]) for r in spark.read.schema(stream.schema).parquet(out).collect())

    put(spark, points, [(1, 1, at(3)), (1, 2, at(50)), (2, 3, at(3)), (2, 4, at(4)), (1, 5, at(30))], p)
    put(spark, windows, [(1, "f1", at(0), at(5), None), (1, "f5", at(25), at(35), None), (2, "named", at(9), at(9), "3")], w)
    assert run() == []
    put(spark, windows, [(1, "f2", at(28), at(31), None)], w)  # a second one for point 5
    put(spark, points, [(9, 90, at(20))], p)
    assert run() == []
    put(spark, points, [(9, 99, at(900))], p)
    put(spark, windows, [(9, "late", at(900), at(901), None)], w)
    run()
    put(spark, points, [(9, 98, at(905))], p)
    put(spark, windows, [(9, "later", at(906), at(907), None)], w)
    assert run() == [("1", 1, "f1"), ("2", 0, None), ("3", 1, "named"), ("4", 0, None), ("5", 2, None), ("90", 0, None)]


def test_windows_of_crowded_studies_are_counted_without_pairs(spark, tmp_path):
    """2,000 points and as many windows within hours of one study: no join, the counts of all pairs; points without a time have no window."""
    points, windows, out, checkpoint = (str(tmp_path / n) for n in ("points", "windows", "out", "checkpoint"))
    at = lambda m: T0 + timedelta(minutes=m)
    own = [(1, i, at(i * 7919 % 300)) for i in range(2000)]
    held = [(1, f"f{i}", at(i * 104729 % 290), at(i * 104729 % 290 + i % 90 - 1), f"{i * 31}" if i % 3 == 0 else None) for i in range(2000)]
    put(spark, points, [*own, (1, 9000, None), (2, 9999, at(5000))], "study_id long, point_id long, at timestamp")
    put(spark, windows, [*held, (2, "last", at(5000), at(5001), None)], "study_id long, data_uri string, starts timestamp, ends timestamp, of_point string")
    stream = streams.stream_one_force(spark.readStream.schema("study_id long, point_id long, at timestamp").parquet(points), spark.readStream.schema("study_id long, data_uri string, starts timestamp, ends timestamp, of_point string").parquet(windows), "10 minutes", timedelta(hours=1))
    assert "Join" not in stream._jdf.queryExecution().analyzed().toString()
    with ingest.keyed_state(spark):
        got = {int(r["point_id"]): (r["n"], r["data_uri"]) for r in streams.drained(stream, out, checkpoint).collect()}
    hour, want = timedelta(hours=1), {9000: (0, None)}
    for _, i, t in own:
        met = [uri for _, uri, lo, hi, name in held if (lo <= t <= min(hi, lo + hour) if name is None else name == str(i) and abs(lo - t) <= hour)]
        want[i] = (len(met), met[0] if len(met) == 1 else None)
    assert got == want and len({n for n, _ in want.values()}) > 3


def test_repeated_points_count_as_in_sql(spark, tmp_path):
    """Two rows of one point: every row counts the windows of both, as the SQL of the query has it."""
    at = lambda m: T0.replace(hour=0) + timedelta(minutes=m)
    rows = [(1, at(30), 20, "click", 0.0, ""), (1, at(30), 20, "click", 0.0, ""), (2, at(30), 40, "click", 0.0, ""), (3, at(10), 20, "signup", 0.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["t4_one_force_window"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(0, "1", 4, None), (0, "2", 1, "3")]


@pytest.mark.parametrize("over", [{"window": "1 hour"}, {"window": "1 hour", "slide": "30 minutes"}, {"gap": "20 minutes"}])
def test_channel_windows_stream_as_they_batch(spark, tmp_path, over):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("samples", "out", "checkpoint"))
    kind = "data_uri string, channel string, ts timestamp, value double"
    rows = [(f"u{i % 2}", f"c{i % 3}", T0 + timedelta(minutes=(i * 7) % 300), float(i)) for i in range(120)]
    put(spark, folder, rows[:70], kind)
    stream = streams.stream_channel_stats(spark.readStream.schema(kind).parquet(folder), watermark="10 hours", **over)
    streams.drained(stream, out, checkpoint, "complete")
    put(spark, folder, rows[70:], kind)
    got = {tuple(r) for r in streams.drained(stream, out, checkpoint, "complete").collect()}
    assert got == {tuple(r) for r in streams.stream_channel_stats(spark.createDataFrame(rows, kind), **over).collect()}


def test_append_mode_gives_closed_windows_only(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("samples", "out", "checkpoint"))
    kind = "data_uri string, channel string, ts timestamp, value double"
    put(spark, folder, [("u", "c", T0, 1.0), ("u", "c", T0 + timedelta(hours=3), 2.0)], kind)
    stream = streams.stream_channel_stats(spark.readStream.schema(kind).parquet(folder), "1 hour", watermark="10 minutes")
    assert [r["n"] for r in streams.drained(stream, out, checkpoint).collect()] == [1]
    put(spark, folder, [("u", "c", T0, 5.0), ("u", "c", T0 + timedelta(hours=9), 2.0)], kind)
    assert sorted((r["from_ts"], r["mean_value"]) for r in streams.drained(stream, out, checkpoint).collect()) == [(T0, 1.0), (T0 + timedelta(hours=3), 2.0)]
