import pytest
from pyspark.sql import functions as F

from posevidence.functions import predicates as p
from posevidence.operators import aggregates
from posevidence.operators.channels import ChannelDecoder, excluded_channels
from posevidence.params import Box, ExportParams

PARAMS = ExportParams("2026-01-01 00:00:00", "2026-01-02 00:00:00", 10, 9, 21, 20)


def keep(spark, condition, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).filter(condition).orderBy("id").collect()]


def test_window_is_half_open(spark):
    rows = [(1, "2025-12-31 23:59:59"), (2, "2026-01-01 00:00:00"), (3, "2026-01-01 23:59:59"), (4, "2026-01-02 00:00:00"), (5, None)]
    df = spark.createDataFrame(rows, "id int, s string").withColumn("servertime", F.col("s").cast("timestamp"))
    assert [r.id for r in df.filter(p.in_window("servertime", PARAMS)).orderBy("id").collect()] == [2, 3]


def test_real_position_and_box_edges(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 20.0), (3, None, None), (4, 9.0, 20.0), (5, 10.0, 21.0), (6, 10.0000001, 21.0)]
    schema = "id int, latitude double, longitude double"
    assert keep(spark, p.real_position(), rows, schema) == [2, 4, 5, 6]
    assert keep(spark, p.in_box(PARAMS.box), rows, schema) == [4, 5]
    assert keep(spark, p.at_null_island(), rows, schema) == [1]


def test_a_null_type_is_not_kept(spark):
    assert keep(spark, p.not_bulk_transfer(), [(1, "b-t-f"), (2, "a-f-G"), (3, None)], "id int, cot_type string") == [2]


@pytest.mark.parametrize("channels, expected", [(None, [1, 2, 3, 4]), ((), []), ((0,), [1]), ((2,), [2]), ((0, 2), [1, 2]), ((3,), []), ((4,), [])])
def test_channel_filter_reads_from_the_right(spark, channels, expected):
    rows = [(1, "0001"), (2, "100"), (3, ""), (4, None)]
    assert keep(spark, p.on_channels(channels), rows, "id int, groups string") == expected


def test_filter_matrix_matches_what_results_take():
    assert p.FILTER_MATRIX["positions"] == {"time", "area", "channel"}
    assert p.FILTER_MATRIX["shape_versions"] == {"time", "channel"}
    unfiltered = {"mission_subscriptions", "mission_contents", "attachments", "federation"}
    assert {k for k, v in p.FILTER_MATRIX.items() if not v} == unfiltered
    assert {k for k, v in p.FILTER_MATRIX.items() if v == {"channel"}} == {"missions", "files", "video", "data_feeds"}


def wide_masks(spark, width=32768):
    def mask(*bits):
        chars = ["0"] * width
        for b in bits:
            chars[width - 1 - b] = "1"
        return "".join(chars)

    rows = [(1, mask(0, 5, 300)), (2, mask()), (3, mask(32767)), (4, None), (5, "1")]
    dim = [(0, "zero"), (5, "five"), (300, "three hundred"), (32767, "last"), (7, "seven")]
    return spark.createDataFrame(rows, "id int, groups string"), spark.createDataFrame(dim, "bitpos int, name string")


def test_decoding_wide_masks(spark):
    rows, dim = wide_masks(spark)
    decoder = ChannelDecoder(dim)
    found = {r.id: (r.channels, r.channel_numbers) for r in decoder.add(rows).collect()}
    assert found == {
        1: ("zero, five, three hundred", "0,5,300"), 2: (None, None), 3: ("last", "32767"),
        4: (None, None), 5: ("zero", "0"),
    }
    present = sorted(tuple(r) for r in decoder.present(rows).select("bitpos", "name").collect())
    assert present == [(0, "zero"), (5, "five"), (300, "three hundred"), (32767, "last")]


def test_decoding_three_hundred_channels(spark):
    """Two of them share a bit, of which one has no name."""
    dim = spark.createDataFrame([(b, f"c{b:03}") for b in range(300)] + [(9, None), (9, "a nine")], "bitpos int, name string")
    mask = "".join("1" if b in (9, 150, 299) else "0" for b in range(299, -1, -1))
    rows = spark.createDataFrame([(1, mask), (2, "0" * 300)], "id int, groups string")
    found = {r.id: r.channels for r in ChannelDecoder(dim).add(rows).collect()}
    assert found == {1: "a nine, c009, c150, c299", 2: None}


def test_excluded_channels_keeps_its_states_apart(spark):
    present = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "bitpos int, name string")
    assert tuple(excluded_channels(present, None).first()) == ("no filter", None)
    assert tuple(excluded_channels(present, (1,)).first()) == ("verified", ["a", "c"])
    assert tuple(excluded_channels(present, (1, 2, 3)).first()) == ("verified", [])


def test_exact_percentiles_against_brute_force(spark):
    import random

    rng = random.Random(7)
    lat = [rng.uniform(-90, 90) for _ in range(500)] + [12.25] * 300 + [1e-9 * i for i in range(100)]
    lon = [rng.uniform(-180, 180) for _ in range(401)]
    rows = [("lat", v) for v in lat] + [("lon", v) for v in lon] + [("one", 5.5), ("lat", None)]
    values = spark.createDataFrame(rows, "series string, v double")
    found = {(r.series, r.p): r.value for r in aggregates.exact_percentiles(values, (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}

    def percentile(data, p):
        data, at = sorted(data), (len(data) - 1) * p
        lo = int(at)
        hi = min(lo + (at > lo), len(data) - 1)
        return data[lo] + (data[hi] - data[lo]) * (at - lo)

    for series, data in (("lat", lat), ("lon", lon), ("one", [5.5])):
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert found[(series, q)] == pytest.approx(percentile(data, q), rel=1e-12)


def test_extent_takes_the_first_window_with_rows_and_narrows(spark):
    rows = [("2026-01-01", 10.0, 20.0), ("2026-01-01", 14.0, 21.0), ("2026-01-01", 10.5, 20.5)]
    cot = spark.createDataFrame(rows, "s string, latitude double, longitude double").withColumn("servertime", F.col("s").cast("timestamp"))
    wide = aggregates.extent(cot, "2026-02-20 00:00:00").first()
    assert wide.basis.startswith("90 days, further narrowed")
    assert (wide.south, wide.north) == (10.5 - 0.15, 10.5 + 0.15)
    assert aggregates.extent(cot, "2027-02-20 00:00:00").first().basis.startswith("all data")
    assert aggregates.extent(cot.filter("latitude > 50"), "2026-02-20 00:00:00").count() == 0


def test_census_tells_unexamined_from_empty(spark):
    empty = spark.createDataFrame([], "id int")
    states = {r.label: (r.n, r.state) for r in aggregates.census({"cot_image": empty}).collect()}
    assert states["attached images"] == (0, "counted")
    assert states["event links"] == (None, "unavailable")
    assert len(states) == 15


def test_redactions_are_unknown_without_the_result(spark):
    assert aggregates.redaction_count(None, spark).first().redactions is None


def test_manifest_reasons_and_bulk_transfer(spark):
    from posevidence.operators.results import manifest, matching_positions

    def row(i, uid, lat, lon, kind="a-f-G-U-C", groups="01"):
        return (i, uid, lat, lon, kind, groups, '<detail><contact callsign="X"/></detail>')

    rows = [
        row(1, "in", 9.5, 20.5), row(2, "zero", 0.0, 0.0), row(3, "none", None, None),
        row(4, "out", 50.0, 50.0), row(5, "chan", 9.5, 20.5, groups="10"), row(6, "file", 9.5, 20.5, kind="b-t-f"),
        row(7, "in", 9.6, 20.5, kind=None),
    ]
    cot = spark.createDataFrame(
        rows, "id long, uid string, latitude double, longitude double, cot_type string, groups string, detail string"
    ).withColumn("servertime", F.lit("2026-01-01 10:00:00").cast("timestamp"))
    from dataclasses import replace

    chosen = replace(PARAMS, channels=(0,))
    found = {r.uid: r for r in manifest(cot, chosen).collect()}
    assert found["in"].exclusion_reason == "included" and found["in"].events_exported == 2
    assert found["zero"].exclusion_reason == "no valid GPS fix (0,0)"
    assert found["none"].exclusion_reason == "no position data in these events"
    assert found["out"].exclusion_reason == "had positions, none inside the bounding box"
    assert found["chan"].exclusion_reason == "inside the bounding box, but not on a selected channel"
    # A file transfer counts as exported here and is not among the positions.
    assert found["file"].events_exported == 1
    assert sorted(r.id for r in matching_positions(cot, chosen).collect()) == [1]
    assert found["in"].cot_types_seen == "a-f-G-U-C" and found["in"].uid_kind == "device/entity"


def test_box_is_a_plain_value():
    assert PARAMS.box == Box(10, 9, 21, 20)
