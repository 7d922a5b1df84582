import pytest

from posevidence.operators import drift

BASE = [("t", 1, "a", "bigint"), ("t", 2, "b", "string"), ("t", 3, "c", "double"), ("u", 1, "x", "int")]


def columns(spark, rows):
    return spark.createDataFrame(rows, drift.COLUMNS_SCHEMA)


@pytest.mark.parametrize("rows, expected", [
    (BASE, set()),
    (BASE[:1] + [("t", 2, "c", "double")] + BASE[3:], {("fail", "t.b was removed")}),
    (BASE[:3] + [("t", 4, "d", "int")] + BASE[3:], {("warn", "t.d was added at column 4 of 4")}),
    ([("t", 1, "a", "int")] + BASE[1:], {("fail", "t.a: type was bigint, now int")}),
    ([("t", 1, "b", "string"), ("t", 2, "a", "bigint")] + BASE[2:], {("fail", "t: the column order changed")}),
    (BASE[:3], {("fail", "table u is gone")}),
    (BASE + [("v", 1, "x;\ny", "int")], {("warn", "table v is new")}),
    # A column put in front moves every ordinal but not the order of the kept ones.
    ([("t", 1, "z", "int"), ("t", 2, "a", "bigint"), ("t", 3, "b", "string"), ("t", 4, "c", "double"), BASE[3]], {("warn", "t.z was added at column 1 of 4")}),
])
def test_schema_diff(spark, rows, expected):
    found = drift.schema_diff(columns(spark, BASE), columns(spark, rows))
    assert {(r.status, r.detail) for r in found.collect()} == expected


def test_fingerprint_follows_structure_only(spark):
    a = drift.schema_fingerprint(columns(spark, BASE)).first()
    b = drift.schema_fingerprint(columns(spark, list(reversed(BASE))).repartition(3)).first()
    c = drift.schema_fingerprint(columns(spark, BASE[:3] + [("u", 1, "x", "bigint")])).first()
    widths = spark.createDataFrame([(32768,)], "mask_bits int")
    assert a == b and a.fingerprint_sha256 != c.fingerprint_sha256
    assert drift.schema_fingerprint(columns(spark, BASE), widths).first().fingerprint_sha256 != a.fingerprint_sha256


@pytest.mark.parametrize("previous, checked, status", [
    (None, None, "ok"),
    ("2026-01-01 09:00:00", "2026-01-01 09:30:00Z", "ok"),
    ("2026-01-01 10:00:00", "2026-01-01 11:45:00Z", "ok"),
    ("2026-01-01 10:00:00", "2026-01-01 11:00:00Z", "warn"),
    ("2026-01-01 10:00:00", "nonsense", "warn"),
    ("2026-01-01 10:00:00", None, "warn"),
])
def test_liveness(spark, previous, checked, status):
    cot = spark.sql("SELECT TIMESTAMP '2026-01-01 10:00:00' AS servertime")
    assert drift.liveness(cot, "2026-01-01 12:00:00", previous, checked).first().status == status


def test_liveness_of_an_empty_table_warns(spark):
    cot = spark.sql("SELECT TIMESTAMP '2026-01-01 10:00:00' AS servertime").limit(0)
    assert drift.liveness(cot, "2026-01-01 12:00:00").first().status == "warn"


def test_decode_health_without_channels_warns(spark):
    from posevidence.operators.channels import ChannelDecoder

    cot = spark.sql("SELECT 1L AS id, current_timestamp() AS servertime, '01' AS groups, CAST(NULL AS STRING) AS detail")
    dims = spark.createDataFrame([(0, "zero")], "bitpos int, name string")
    none = dims.limit(0)
    got = drift.decode_health(cot, dims, ChannelDecoder(dims)).first()
    assert (got.channels_status, got.callsigns_status) == ("ok", "warn")
    got = drift.decode_health(cot, none, ChannelDecoder(none)).first()
    assert (got.channels_status, got.callsigns_status) == ("warn", "skip")
    got = drift.decode_health(cot.limit(0), dims, ChannelDecoder(dims)).first()
    assert got.channels_status == "skip"


def test_worst_status(spark):
    def verdict(*statuses):
        return drift.check_summary(spark.createDataFrame([(s,) for s in statuses], "status string")).first().verdict

    assert verdict("skip") == "skip" and verdict("ok", "skip") == "ok" and verdict("warn", "ok") == "warn" and verdict("fail", "warn") == "fail"
