import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from posevidence.operators import shapes, tracks
from posevidence.params import ExportParams
from posevidence.streaming import streams

T0 = datetime(2026, 1, 1, 10, 0, 0)
SCHEMA = "id long, uid string, servertime timestamp, latitude double, longitude double, cot_type string, groups string"
PARAMS = ExportParams("2026-01-01 00:00:00", "2026-01-02 00:00:00", 10, 9, 21, 20)


def write(spark, rows, path, mode="append"):
    full = [(i, u, T0 + timedelta(seconds=s), 9.5, 20.5, "a-f-G", "1") for i, (u, s) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def test_sessions_equal_segments(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    steps = [0, 300, 301, 10, 299, 5000, 300, 300]
    rows, at = [], 0
    for s in steps:
        at += s
        rows.append(("A", at))
    rows += [("B", 5), ("B", 306)]
    write(spark, rows, path)
    batch = tracks.segment_summary(tracks.split_segments(spark.read.parquet(path)))
    expected = {(r.uid, r.begin, r.end, r.points) for r in batch.collect()}
    stream = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    found, dropped = streams.drained(stream, streams.session_tracks, "test-sessions")
    assert {(r.uid, r.begin, r.end, r.points) for r in found.collect()} == expected
    assert dropped == 0


def test_a_stream_without_rows_ends(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    write(spark, [], path)
    stream = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    found, dropped = streams.drained(stream, streams.session_tracks, "test-nothing")
    assert (found.count(), dropped) == (0, 0)


def in_files(spark, path, batches, schema):
    """A stream that takes one file, in this order, in each batch."""
    for k, rows in enumerate(batches):
        folder = f"{path}/{k:04}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        for name in os.listdir(folder):
            os.utime(f"{folder}/{name}", (1.7e9 + k, 1.7e9 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_late_rows_of_all_batches_are_counted(spark, tmp_path):
    def row(uid, seconds):
        return (1, uid, T0 + timedelta(seconds=seconds), 9.5, 20.5, "a-f-G", "1")

    # Rows are judged late by the watermark of the batch before.
    batches = [[row("A", 0), row("A", 90), row("A", 7200)], [row("B", 7300)]]
    batches += [[row("A", 30 + k)] for k in range(12)]
    stream = in_files(spark, str(tmp_path), batches, SCHEMA)
    reports = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(reports)
    spark.conf.set(reports, "3")
    try:
        found, dropped = streams.drained(stream, lambda e: streams.window_counts(e, PARAMS), "test-windows")
    finally:
        spark.conf.set(reports, before)
    counted = {(r.uid, r.window_start, r.total_events) for r in found.collect()}
    assert counted == {
        ("A", T0, 1), ("A", T0 + timedelta(minutes=1), 1), ("A", T0 + timedelta(hours=2), 1),
        ("B", T0 + timedelta(seconds=7260), 1),
    }
    assert dropped == 12


VERSIONS = "id long, uid string, servertime timestamp, cot_type string"
DELETIONS = "id long, uid string, ts timestamp, mission_id long"


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_latest_shapes_in_any_order(spark, tmp_path):
    rows = [(1, "S", T0, "u-d-f"), (2, "S", minutes(1), "u-d-c-c"), (3, "S", minutes(1), "u-d-f"), (4, "R", T0, "u-d-f")]
    gone = [[(9, "S", minutes(120), 1), (8, "S", minutes(60), 2)]]
    for name, order in (("a", [0, 1, 2, 3]), ("b", [3, 1, 0, 2])):
        v = in_files(spark, f"{tmp_path}/{name}/v", [[rows[i]] for i in order], VERSIONS)
        d = in_files(spark, f"{tmp_path}/{name}/d", gone, DELETIONS)
        updates = streams.shape_updates(v, d, lateness="3 hours")
        found = streams.latest_shapes(streams.run_updating(updates, f"{tmp_path}/{name}/out")).collect()
        found = {r.uid: tuple(r)[1:] for r in found}
        assert found == {"S": (3, minutes(1), "u-d-f", minutes(60), 2), "R": (4, T0, "u-d-f", None, None)}


def test_state_ends_with_the_deletion_and_goes_on_from_its_checkpoint(spark, tmp_path):
    versions, out = f"{tmp_path}/v", f"{tmp_path}/out"
    deletions = in_files(spark, f"{tmp_path}/d", [[(7, "S", minutes(10), 5)]], DELETIONS)

    def run(rows, k):
        spark.createDataFrame(rows, VERSIONS).coalesce(1).write.parquet(f"{versions}/{k}")
        stream = spark.readStream.schema(VERSIONS).parquet(f"{versions}/*")
        updates = streams.shape_updates(stream, deletions, kept=timedelta(hours=1))
        changes = streams.run_updating(updates, out)
        state = spark.read.format("statestore").options(stateVarName="version").load(f"{out}/progress")
        return changes, {r.key["uid"] for r in state.collect()}

    changes, held = run([(1, "S", T0, "u-d-f"), (2, "R", T0, "u-d-r")], 0)
    assert held == {"S", "R"}
    # The watermark passes the deletion and what late versions may still take.
    changes, held = run([(3, "Q", minutes(600), "u-d-f")], 1)
    assert held == {"R", "Q"}
    # Drawn again after that: new state, the same answer as from all rows at once.
    changes, held = run([(4, "S", minutes(700), "u-d-p"), (5, "R", minutes(701), "u-d-r")], 2)
    assert held == {"S", "R", "Q"}
    found = {r.uid: (r.id, r.deleted_at, r.deleted_in) for r in streams.latest_shapes(changes).collect()}
    newest = shapes.latest_versions(spark.read.parquet(f"{versions}/*"))
    gone = shapes.first_deletions(spark.read.parquet(f"{tmp_path}/d/*").withColumn("creatoruid", F.lit("c")))
    batch = newest.join(gone, "uid", "left").select("uid", "id", "deleted_at", "deleted_in")
    assert found == {r.uid: (r.id, r.deleted_at, r.deleted_in) for r in batch.collect()}
    assert found["S"] == (4, minutes(10), 5)
    # Only what changed is written, batch by batch.
    assert changes.filter("uid = 'Q'").count() == 1
