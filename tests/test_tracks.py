import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from posevidence.operators import sequences, tracks
from posevidence.params import ExportParams

T0 = datetime(2026, 1, 1, 10, 0, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, uid string, servertime timestamp, latitude double, longitude double")


def numbered(points, gap):
    """Segment numbers by walking a device's points."""
    out, seg, before = {}, 1, None
    for i, t in points:
        if before is not None and t is not None and t - before > timedelta(seconds=gap):
            seg += 1
        out[i] = seg
        before = t
    return out


@pytest.mark.parametrize("slice_seconds, gap", [(3600, 300), (60, 300), (7, 30), (100000, 300)])
def test_segments_against_a_walk(spark, slice_seconds, gap):
    rng = random.Random(slice_seconds)
    rows, expected = [], {}
    for d in range(4):
        t, points = T0, []
        for _ in range(150):
            t += timedelta(seconds=rng.choice([0, 1, 20, 29, 30, 31, 299, 300, 301, 4000]))
            i = len(rows)
            rows.append((i, f"D{d}", t, 1.0, 2.0))
            points.append((i, t))
        expected.update(numbered(points, gap))
    for parts in (1, 7):
        found = tracks.split_segments(frame(spark, rows).repartition(parts), gap, slice_seconds=slice_seconds)
        assert {r.id: r.seg_no for r in found.collect()} == expected


def test_exact_gap_goes_on_and_missing_times_do_not_break(spark):
    rows = [(0, "A", None, 1.0, 1.0), (1, "A", T0, 1.0, 1.0), (2, "A", T0 + timedelta(seconds=300), 1.0, 1.0),
            (3, "A", T0 + timedelta(seconds=601), 1.0, 1.0), (4, None, T0, 1.0, 1.0)]
    found = {r.id: r.seg_no for r in tracks.split_segments(frame(spark, rows)).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1}


def test_paths_are_whole_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(tracks, "PIECE_POINTS", 4)
    rows = [(i, "A", T0 + timedelta(minutes=i), 10 + i / 100, 20.0) for i in range(150)]
    rows += [(900, "A", T0 + timedelta(days=1), 9.0, 9.0)]
    lines = tracks.track_features(frame(spark, rows)).collect()
    assert {(r.seg_no, r.segments, r.points, r.name) for r in lines} == {(1, 2, 150, "Track segment 1 of 2")}
    assert max(r.piece_points for r in lines) <= 4
    whole = ", ".join(r.path for r in sorted(lines, key=lambda r: r.piece_no))
    assert whole == ", ".join(f"20.000000 {10 + i / 100:.6f}" for i in range(150))


def test_trails_drop_devices_that_never_moved(spark):
    params = ExportParams("2026-01-01 00:00:00", "2026-01-03 00:00:00", 90, -90, 180, -180)
    still = [(i, "still", T0 + timedelta(seconds=i), 5.0, 5.0) for i in range(4)]
    moved = [(10 + i, "moved", T0 + timedelta(seconds=i), 5.0 + i, 5.0) for i in range(3)]
    lone = [(20, "moved", T0 + timedelta(hours=5), 9.0, 9.0)]
    cot = frame(spark, still + moved + lone).withColumn("cot_type", F.lit("a-f-G"))
    found = tracks.trails(cot, params).collect()
    assert [r.points for r in found] == [3] and "uid" not in found[0].asDict()


def test_neighbours_and_numbers_against_plain_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("AB"), T0 + timedelta(seconds=rng.randrange(50000)), float(i), 0.0) for i in range(200)]
    df = frame(spark, rows).withColumn("s", tracks.time_slice("servertime", 600))
    order = ["servertime", "id"]
    back = tracks.neighbour_in_slices(df, ["uid"], "s", order, ["latitude"])
    ahead = tracks.neighbour_in_slices(df, ["uid"], "s", order, ["latitude"], prefix="next_", ahead=True)
    placed = sequences.placed(df, ["uid"], "s", order, ["latitude"])
    from pyspark.sql.window import Window

    w = Window.partitionBy("uid").orderBy(*order)
    plain = {r.id: r for r in df.select(
        "id", F.lag("latitude").over(w).alias("b"), F.lead("latitude").over(w).alias("a"), F.row_number().over(w).alias("n"),
        F.count("*").over(Window.partitionBy("uid")).alias("of")).collect()}
    assert {r.id: r.prev_latitude for r in back.collect()} == {i: r.b for i, r in plain.items()}
    assert {r.id: r.next_latitude for r in ahead.collect()} == {i: r.a for i, r in plain.items()}
    placed = {r.id: r for r in placed.collect()}
    assert {i: r.next_latitude for i, r in placed.items()} == {i: r.a for i, r in plain.items()}
    assert {i: (r.place, r.total) for i, r in placed.items()} == {i: (r.n, r.of) for i, r in plain.items()}


def fact_exchanges(df):
    """Exchanges of rows that no aggregate has summed up before."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:+\-]*", line).group()) for line in plan]
    found = 0
    for k, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            end = next((j for j in range(k + 1, len(plan)) if depth[j] <= depth[k]), len(plan))
            found += not any("Aggregate" in x for x in plan[k + 1 : end])
    return found


def test_rows_are_exchanged_once(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    frame(spark, [(i, "A", T0 + timedelta(seconds=i), 1.0 * i, 2.0) for i in range(50)]).write.parquet(path)
    points = spark.read.parquet(path)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        assert fact_exchanges(tracks.track_features(points)) == 1
        assert fact_exchanges(tracks.split_segments(points)) == 1
        assert fact_exchanges(tracks.stationary_repeats(points)) == 1
    finally:
        spark.conf.unset(threshold)


def test_one_device_with_all_rows_is_many_tasks(spark):
    n = 200_000
    points = spark.range(n).selectExpr(
        "id", "'A' AS uid", "IF(id % 2 = 0, timestamp_micros(1700000000000000 + id * 1000000), NULL) AS servertime",
        "1.0D * id AS latitude", "2.0D AS longitude",
    )
    sliced = tracks._sliced(points, 300, "uid", "servertime", "id", 3600)
    sizes = sorted(r["count"] for r in sliced.groupBy("__key", "__named", "__slice").count().collect())
    assert sizes[-1] <= tracks.UNTIMED_ROWS // 2 + 1 and len(sizes) > 50
    found = tracks.split_segments(points)
    assert found.count() == n and found.filter("seg_no <> 1").count() == 0


def test_missing_times_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(tracks, "UNTIMED_ROWS", 3)
    monkeypatch.setattr(tracks, "PIECE_POINTS", 2)
    rows = [(i, "A", None, float(i), 1.0) for i in range(10)] + [(50 + i, "A", T0 + timedelta(hours=i), 60.0 + i, 1.0) for i in range(3)]
    found = {r.id: r.seg_no for r in tracks.split_segments(frame(spark, rows)).collect()}
    assert found == {i: 1 for i in range(10)} | {50: 1, 51: 2, 52: 3}
    lines = sorted((r.piece_no, r.path) for r in tracks.track_features(frame(spark, rows)).collect())
    assert ", ".join(p for _, p in lines) == ", ".join(f"1.000000 {float(i):.6f}" for i in [*range(10), 60])
    assert [k for k, _ in lines] == list(range(1, len(lines) + 1))
    repeats = {r.id: r.stationary_repeat for r in tracks.stationary_repeats(frame(spark, [(i, "A", None, i // 2 / 1.0, 1.0) for i in range(8)])).collect()}
    assert repeats == {i: i % 2 == 1 for i in range(8)}
