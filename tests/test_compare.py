import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from posevidence.operators import compare

T0 = datetime(2026, 1, 1, 10, 0, 0)
SCHEMA = "device string, servertime timestamp, latitude double, longitude double, channel string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, a, o, c) for d, t, a, o, *rest in rows for c in [rest[0] if rest else "c"]], SCHEMA)


def at(minutes, lat, lon, device="ALPHA"):
    return (device, T0 + timedelta(minutes=minutes), lat, lon)


REPEAT = [at(0, 39.801, -98.498), at(2, 39.801, -98.498), at(20, 39.806, -98.488), at(45, 39.811, -98.481)]


def reasons(spark, left, right, channel=None):
    lf, rf = frame(spark, left), frame(spark, right)
    _, remaining = compare.match_positions(lf, rf)
    return Counter({r.reason: r.n for r in compare.explain_unmatched(lf, rf, remaining, channel).groupBy("reason").agg(F.sum("n").alias("n")).collect()})


def table(spark, left, right):
    return {r.device: r for r in compare.compare_positions(*compare.match_positions(frame(spark, left), frame(spark, right))).collect()}


def test_same_file_matches_and_extra_devices_are_coverage(spark):
    extra = [at(5, 40.0, -98.9, "FAR"), at(6, 40.0, -98.89, "FAR")]
    found = table(spark, REPEAT, REPEAT + extra)
    assert (found["ALPHA"].matched, found["ALPHA"].only_left, found["ALPHA"].max_distance_m) == (4, 0, 0.0)
    assert (found["FAR"].matched, found["FAR"].only_right) == (0, 2)
    notes = compare.coverage_note(compare.compare_positions(*compare.match_positions(frame(spark, REPEAT), frame(spark, REPEAT + extra))))
    assert {r.device: r.note for r in notes.collect()} == {"ALPHA": "complete", "FAR": "coverage"}


def test_a_moved_position_is_not_matched(spark):
    moved = [REPEAT[0], REPEAT[2], at(45, 39.811 + 0.00045, -98.481)]
    found = table(spark, [REPEAT[0], REPEAT[2], REPEAT[3]], moved)["ALPHA"]
    assert (found.matched, found.only_left, found.only_right) == (2, 1, 1)
    assert reasons(spark, [REPEAT[0], REPEAT[2], REPEAT[3]], moved) == {"same time, some metres away": 1}


def test_reasons(spark):
    thinned = [REPEAT[0], REPEAT[2], REPEAT[3]]
    assert reasons(spark, REPEAT, thinned) == {"repeats the device's previous report": 1}
    assert reasons(spark, REPEAT, REPEAT[:3]) == {"outside the time range of the other file": 1}
    shifted = [REPEAT[0], at(20 + 60, 39.806, -98.488), at(90, 1.0, 1.0)]
    assert reasons(spark, [REPEAT[0], REPEAT[2]], shifted) == {"same place at another time": 1}
    renamed = [("DEV-1", *r[1:]) for r in REPEAT]
    assert reasons(spark, REPEAT, renamed) == {"device is called DEV-1 in the other file": 3, "repeats the device's previous report": 1}
    with_channel = [(*REPEAT[0], "used"), (*REPEAT[2], "ticked not"), (*REPEAT[3], "used")]
    assert reasons(spark, with_channel, [REPEAT[0], REPEAT[3]], "channel") == {"on a channel no matched report uses": 1}
    assert reasons(spark, [REPEAT[0], REPEAT[2], REPEAT[3]], [REPEAT[0], REPEAT[3]]) == {"unexplained": 1}
    assert reasons(spark, REPEAT[:1], []) == {"outside the time range of the other file": 1}


def metres(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def greedy(spark, left, right):
    """All pairs, nearest first by steps and then by digest, each report once."""
    pairs = []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            gap = abs((a[1] - b[1]) // timedelta(microseconds=1))
            if a[0] == b[0] and gap <= 1_000_000 and metres(a, b) <= 1:
                pairs.append((i, j, gap, metres(a, b), a[:4], b[:4]))
    spot = "struct<device:string,servertime:timestamp,latitude:double,longitude:double>"
    digests = {
        (r.i, r.j): r.digest
        for r in spark.createDataFrame([(i, j, a, b) for i, j, _, _, a, b in pairs], f"i int, j int, l {spot}, r {spot}")
        .select("i", "j", F.xxhash64("l", "r").alias("digest")).collect()
    }
    # Equal spots come before all others.
    order = sorted(pairs, key=lambda p: (p[4] != p[5], p[2] // 10_000, int(p[3] * 100), digests[p[0], p[1]], p[4], p[5]))
    used_l, used_r, out = set(), set(), Counter()
    for i, j, gap, d, a, _ in order:
        if i not in used_l and j not in used_r:
            used_l.add(i), used_r.add(j)
            out[(a[0], round(gap / 1e6, 6), round(d, 6))] += 1
    return out


@pytest.mark.parametrize("seed, lat, seconds", [(1, 40.0, 600), (2, 0.0, 1), (3, -89.5, 2), (4, 70.0, 1)])
def test_matching_equals_greedy_over_all_pairs(spark, seed, lat, seconds):
    rng = random.Random(seed)
    wide = 1 / max(math.cos(math.radians(lat)), 1e-3)

    def cloud(n):
        rows = []
        for _ in range(n):
            rows.append((rng.choice("AB"), T0 + timedelta(milliseconds=rng.choice([0, 250, 500, 900, 1000, 1400, 2000])),
                         lat + rng.choice([0, 2, 4, 6, 8]) * 1e-6, 10 + rng.choice([0, 2, 4, 8]) * 1e-6 * wide))
        return rows

    left, right = cloud(40), cloud(35)
    left += left[:5] * 3
    pairs, remaining = compare.match_positions(frame(spark, left), frame(spark, right), seconds)
    found = Counter()
    for r in pairs.collect():
        found[(r.device, round(r.gap_s, 6), round(r.distance_m, 6))] += r.n
    assert found == greedy(spark, left, right)
    by_side = {(r.side, r.s) for r in remaining.groupBy("side").agg(F.sum("n").alias("s")).collect()}
    assert by_side == {("left", len(left)), ("right", len(right))}
    assert remaining.filter("unmatched < 0 or unmatched > n").count() == 0


def test_compare_by_id_names_the_row_and_field(spark):
    schema = "id long, uid string, callsign string, servertime timestamp, latitude double, longitude double"
    rows = [(i, "DEV-1", "ALPHA", T0 + timedelta(minutes=i), 39.8 + i / 1000, -98.5) for i in range(3)]
    bad = [rows[0], (*rows[1][:4], rows[1][4] + 0.00045, rows[1][5]), rows[2], (99, "FAR", None, T0, 40.0, -98.9)]
    compared = compare.compare_by_id(spark.createDataFrame(rows, schema), spark.createDataFrame(bad, schema))
    assert {r.id: r.state for r in compared.collect()} == {0: "identical", 1: "differs", 2: "identical", 99: "only right"}
    assert [(r.id, r.field) for r in compare.field_differences(compared).collect()] == [(1, "latitude")]
    s = compare.id_summary(compared).first()
    assert (s.identical, s.differ, s.only_left, s.only_right, s.verdict) == (2, 1, 0, 1, "differs")
    same = compare.compare_by_id(spark.createDataFrame(rows, schema), spark.createDataFrame(rows + bad[3:], schema))
    assert compare.id_summary(same).first().verdict == "match"


def test_recheck_verdicts(spark):
    import hashlib

    sql = "SELECT 1;"
    sha = hashlib.sha256(sql.encode()).hexdigest()
    scripts = spark.createDataFrame([(p, "t", sql, raw) for p, raw in (("m", "r"), ("x", "r"), ("u", None), ("n", "r"))],
                                    "package_sha256 string, case_prefix string, queries_sql string, raw_sha256 string")
    sums = spark.createDataFrame([
        ("m", 0, "t-recheck-cot_router-raw.csv", "old"), ("m", 1, "t-recheck-cot_router-raw.csv", "r"), ("m", 2, "t-queries.sql", sha), ("m", 3, "t-a.csv", "z"),
        ("x", 0, "t-recheck-cot_router-raw.csv", "q"), ("x", 1, "t-queries.sql", "q"),
        ("u", 0, "t-recheck-cot_router-raw.csv", "q"), ("n", 0, "t-a.csv", "q")],
        "package_sha256 string, line_no int, name string, sha256 string")
    got = {r.package_sha256: r for r in compare.recheck_verdict(scripts, sums).collect()}
    assert (got["m"].raw_verdict, got["m"].outcome, got["m"].script_verdict, got["m"].compared, got["m"].files) == ("yes", "raw match", "yes", 2, 3)
    assert (got["x"].outcome, got["x"].script_verdict) == ("raw MISMATCH", "NO - a different script was run")
    assert got["u"].outcome == "raw unverified" and got["u"].script_verdict == "MISSING"
    assert got["n"].raw_verdict.startswith("MISSING") and got["n"].compared == 0


def test_table_hash_ignores_layout_and_sees_changes(spark):
    rows = [(i, T0 + timedelta(seconds=i * 37), f'a,"{i}', None if i % 3 else "x\ny") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, servertime timestamp, a string, b string")
    one = compare.table_hash(df.repartition(1), "servertime", "id").first()
    many = compare.table_hash(df.repartition(9), "servertime", "id").first()
    other = compare.table_hash(df.withColumn("a", F.when(F.col("id") == 77, "z").otherwise(F.col("a"))), "servertime", "id").first()
    assert one == many and one.lines == 200 and other.sha256 != one.sha256


def test_delimited_line(spark):
    df = spark.createDataFrame([("a,b", 'q"q', "\\.", None, "", " x", 1.5)], "a string, b string, c string, d string, e string, f string, g double")
    assert df.select(compare.delimited_line(df)).first()[0] == '"a,b","q""q","\\.",,, x,1.5'


def test_a_standing_device_half_a_second_late(spark, monkeypatch):
    """Every report has two partners at the same gap and place; two passes do."""
    written = []
    settle = compare.settle
    monkeypatch.setattr(compare, "settle", lambda df: written.append(1) or settle(df))
    n = 250
    left = frame(spark, [("S", T0 + timedelta(seconds=k), 10.0, 20.0) for k in range(n)])
    right = frame(spark, [("S", T0 + timedelta(seconds=k + 0.5), 10.0, 20.0) for k in range(n)])
    pairs, remaining = compare.match_positions(left, right, 60)
    open_ = sorted((r.servertime, r.side) for r in remaining.collect() for _ in range(r.unmatched))
    # No two reports left over could have been matched.
    assert all((b[0] - a[0]).total_seconds() > 1 or a[1] == b[1] for a, b in zip(open_, open_[1:]))
    assert pairs.agg(F.sum("n")).first()[0] * 2 + len(open_) == 2 * n
    assert {(r.gap_s, r.distance_m) for r in pairs.collect()} == {(0.5, 0.0)}
    assert len(written) == 3


@pytest.mark.parametrize("seconds", [600, 7])
def test_chains_of_strictly_falling_gaps(spark, seconds):
    """Each pair is better than the one before it, over many slices and for two
    devices; only the last one of a chain can be taken at once."""
    left, right = [], []
    for device, first in (("A", 0), ("B", 40)):
        at, gap = T0 + timedelta(seconds=first), 990_000
        for k in range(90):
            (left if k % 2 == 0 else right).append((device, at, 10.0, 20.0))
            at += timedelta(microseconds=gap)
            gap -= 10_000
    left.append(left[-1])
    pairs, remaining = compare.match_positions(frame(spark, left), frame(spark, right), seconds)
    found = Counter()
    for r in pairs.collect():
        found[(r.device, round(r.gap_s, 6), round(r.distance_m, 6))] += r.n
    assert found == greedy(spark, left, right)


def test_both_sides_of_the_meridian_and_the_pole(spark):
    east = [("M", T0, 5.0, 179.999999), ("P", T0, 89.999999, 10.0), ("E", T0, -89.5, -180.0)]
    west = [("M", T0, 5.0, -179.999999), ("P", T0, 89.999999, -150.0), ("E", T0, -89.5, 180.0)]
    found = table(spark, east, west)
    assert {d: r.matched for d, r in found.items()} == {"M": 1, "P": 1, "E": 1}


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    left = [(f"D{k}", T0 + timedelta(seconds=rng.uniform(0, 100)), rng.choice([0, 60, -88.9]) + rng.uniform(0, 4e-4), rng.uniform(0, 1e-3)) for k in range(300)]
    right = [(d, t + timedelta(seconds=rng.uniform(-1.3, 1.3)), a + rng.uniform(-8e-6, 8e-6), o + rng.uniform(-2e-5, 2e-5)) for d, t, a, o in left]

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    expected = {a[0] for a, b in zip(left, right) if abs((a[1] - b[1]).total_seconds()) <= 1 and metres(a, b) <= 1}
    assert {d for d, r in table(spark, left, right).items() if r.matched} == expected


def test_reports_without_a_callsign(spark):
    rows = spark.createDataFrame([(None, "u-1", T0, 1.0, 2.0), ("N", "u-2", T0, 1.0, 2.0)], "callsign string, uid string, servertime timestamp, latitude double, longitude double")
    own = compare.labelled(rows)
    found = {r.device: r.matched for r in compare.compare_positions(*compare.match_positions(own, own)).collect()}
    assert found == {"u-1": 1, "N": 1}
