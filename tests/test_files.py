import csv
import hashlib
import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from posevidence.operators import compare
from posevidence.sources import files, sinks

FERRIES = """<?xml version="1.0"?>
<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><Folder>
<Placemark id="harbour"><name>Harbour limits</name><Polygon><outerBoundaryIs><LinearRing>
 <coordinates>10.70,59.88,0 10.74,59.88,0 10.72,59.91,0 10.70,59.88,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark id="ferry-7"><gx:Track>
 <gx:coord>10.7250 59.9050 1.5</gx:coord><when>2025-06-11T05:30:00.250Z</when>
 <gx:coord>10.7010 59.8980 1.5</gx:coord><when>2025-06-11T07:34:00.250+02:00</when>
 <gx:coord>10.6805 59.8901 1.5</gx:coord><when>not yet known</when>
</gx:Track></Placemark>
<Placemark><name>Night boat</name><gx:Track><when>2025-06-10T23:59:59Z</when><when>2025-06-11T00:00:29Z</when>
 <when>2025-06-11T00:00:59Z</when><gx:coord>10.61 59.80 0</gx:coord><gx:coord>10.62 59.81 0</gx:coord></gx:Track></Placemark>
<Placemark id="buoy"><TimeStamp><when>2025-06-11T04:00:00</when></TimeStamp><name>Buoy 3</name>
 <Point><coordinates> 10.6550,59.8420 </coordinates></Point></Placemark>
</Folder></Document></kml>"""


def test_track_files(spark, tmp_path):
    """Tracks with fractions, zones, an unreadable time and a missing place; a
    stamped point; an area without times."""
    (tmp_path / "ferries.kml").write_text(FERRIES)
    with zipfile.ZipFile(tmp_path / "packed.kmz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("icons/boat.png", b"\x89PNG")
        z.writestr("files/ferries.KML", FERRIES)
    (tmp_path / "cut.kml").write_text(FERRIES[: len(FERRIES) // 2])
    (tmp_path / "cut.kmz").write_bytes(b"PK no archive")
    points, notes = files.read_track_kml(spark, str(tmp_path / "*.km*"))
    placed = sorted(
        (r.device, r.label, r.servertime, r.latitude, r.longitude)
        for r in points.filter(F.col("file").endswith("ferries.kml")).collect()
    )
    assert placed == [
        ("Night boat", "Night boat", datetime(2025, 6, 10, 23, 59, 59), 59.80, 10.61),
        ("Night boat", "Night boat", datetime(2025, 6, 11, 0, 0, 29), 59.81, 10.62),
        ("buoy", "Buoy 3", datetime(2025, 6, 11, 4, 0), 59.8420, 10.6550),
        ("ferry-7", "ferry-7", datetime(2025, 6, 11, 5, 30, 0, 250000), 59.9050, 10.7250),
        ("ferry-7", "ferry-7", datetime(2025, 6, 11, 5, 34, 0, 250000), 59.8980, 10.7010),
    ]
    assert points.filter(F.col("file").endswith("packed.kmz")).count() == len(placed)
    by_file = {r.file.rsplit("/", 1)[1]: (r.untimed, r.error) for r in notes.collect()}
    assert by_file == {
        "ferries.kml": (1, None), "packed.kmz": (1, None), "cut.kml": (None, "ParseError"), "cut.kmz": (None, "BadZipFile"),
    }


def sums_of(members):
    return "".join(f"{hashlib.sha256(data).hexdigest()} *{name}\n" for name, data in members.items())


def test_hash_lists(spark, tmp_path):
    """Folders are dropped, of equal names the later line counts, one line that
    is none rejects its list, and a list may be long."""
    ones, twos = "1" * 64, "2" * 64
    (tmp_path / "mixed.lst").write_text(f"  \n{ones}  ./deep/er/ledger.bin\r{twos} *notes.md\r\n{twos}  ledger.bin")
    (tmp_path / "prose.lst").write_text(f"{ones}  ledger.bin\nsee the other list\n")
    (tmp_path / "upper.lst").write_text(f"{'A' * 64}  ledger.bin\n")
    (tmp_path / "blank.lst").write_text("\r\n \n")
    (tmp_path / "long.lst").write_text("".join(f"{k:064x}  part-{k}\n" for k in range(3000)) + f"{twos}  part-7\n")
    rows, states = files.read_hash_list(spark, str(tmp_path / "*.lst"))
    found = {}
    for r in rows.collect():
        found.setdefault(r.file.rsplit("/", 1)[1], {})[r.name] = r.sha256
    assert found["mixed.lst"] == {"ledger.bin": twos, "notes.md": twos}
    assert len(found["long.lst"]) == 3000 and found["long.lst"]["part-7"] == twos
    assert set(found) == {"mixed.lst", "long.lst"}
    assert {r.file.rsplit("/", 1)[1]: r.state for r in states.collect()} == {
        "mixed.lst": "read", "long.lst": "read", "prose.lst": "not a checksum list", "upper.lst": "not a checksum list",
        "blank.lst": "empty",
    }


def test_members_of_two_packages(spark, tmp_path):
    """One package is whole; of the other a member changed, one is gone, and
    one is there that no list names."""
    whole = {"index.html": b"<p>", "data.bin": b"\0" * 5000, "note": b"?"}
    other = {"a.txt": b"first", "b.txt": b"second", "c.txt": b"third"}
    for name, members in (("whole", whole), ("other", other)):
        (tmp_path / "in" / name).mkdir(parents=True)
        for member, data in members.items():
            (tmp_path / "in" / name / member).write_bytes(data)
        (tmp_path / f"{name}.lst").write_text(sums_of(members))
    (tmp_path / "in" / "other" / "b.txt").write_bytes(b"2nd")
    (tmp_path / "in" / "other" / "c.txt").rename(tmp_path / "in" / "other" / "d.txt")
    listed = None
    for name in ("whole", "other"):
        own, _ = files.read_hash_list(spark, str(tmp_path / f"{name}.lst"))
        own = own.withColumn("package", F.lit(name))
        listed = own if listed is None else listed.unionByName(own)
    read = files.read_package_members(spark, str(tmp_path / "in"))
    found = {(r.package, r.name): r.state for r in compare.package_integrity(read, listed).collect()}
    assert {n: found["whole", n] for n in whole} == {n: "match" for n in whole}
    assert len(set(found[k] for k in (("other", "a.txt"), ("other", "b.txt"), ("other", "c.txt"), ("other", "d.txt")))) == 4
    assert found["other", "a.txt"] == "match" and found["other", "b.txt"] == "differs"
    sizes = {r.name: r["size"] for r in read.collect()}
    assert sizes["data.bin"] == 5000 and sizes["note"] == 1


def test_guarded_csv_reads_back_like_the_csv_module_writes(spark, tmp_path):
    rows = [('=1+1', 'q"q', "a,b", " lead", "two\nlines", 1.5, ["x", None, "y"]), ("-1.0", "", None, "\\.", "z", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f double, g array<string>")
    sinks.write_guarded_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    got = list(csv.reader(io.StringIO(text)))
    assert got == [list("abcdefg"), ["'=1+1", 'q"q', "a,b", " lead", "two\nlines", "1.5", "x y"], ["-1.0", "", "", "\\.", "z", "", ""]]


def test_delimited_and_hash_list(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ("c", "d")], "x string, y string")
    sinks.write_delimited(df.coalesce(1), str(tmp_path / "pkg"))
    rows = "".join(p.read_text() for p in sorted((tmp_path / "pkg" / "rows").glob("*.txt")))
    head = "".join(p.read_text() for p in sorted((tmp_path / "pkg" / "header").glob("*.txt")))
    assert head + rows == 'x,y\n"a,b",\nc,d\n'
    sinks.write_hash_list(spark, str(tmp_path / "pkg"), str(tmp_path / "sums"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "sums").glob("*.txt"))).splitlines()
    assert len(lines) == 2 and lines[0].split("  ")[1].startswith("header/") and lines[1].startswith(hashlib.sha256(rows.encode()).hexdigest())


def test_a_whole_extract(spark, tmp_path):
    from dataclasses import replace

    from posevidence.plans.run import OPTIONAL_RESULTS, plan_extract, write_extract
    from posevidence.sources.adapter import CHECK_PARAMS, CheckTables

    t = CheckTables(spark, "/root/testdata/sf0.001")
    names = {"cot_router": "cot", "groups": "channels", "cot_router_chat": "chat"}
    wanted = ["cot_router", "groups", "cot_router_chat", "mission_change", "data_feed_cot", "data_feed", "cot_image", "cot_link", "mission",
              "data_feed_type_pl", "video_connections", "resource", "client_endpoint", "client_endpoint_event", "connection_event_type",
              "mission_uid", "mission_resource", "mission_external_data", "mission_subscription", "fed_event", "fed_event_kind_pl"]
    tables = {w: t[names.get(w, w)] for w in wanted}
    assert set(plan_extract(tables, CHECK_PARAMS)) == {*OPTIONAL_RESULTS, "manifest"}
    params = replace(CHECK_PARAMS, channels=(3, 7))
    done = write_extract(tables, params, str(tmp_path / "x"), ["positions", "shapes", "federation"]).first()
    assert done.failures == {} and set(done.counts) == {"positions", "shapes", "federation", "manifest"}
    assert done.counts["federation"] == 1500 and done.channels_state == "verified" and "NATION_3" not in done.channels_excluded
    assert "video" in done.files_excluded
    broken = {**tables, "fed_event": tables["fed_event"].withColumn("event_kind_id", F.expr("raise_error('no such table')"))}
    failed = write_extract(broken, params, str(tmp_path / "y"), ["federation"]).first()
    assert set(failed.failures) == {"federation"} and "manifest" in failed.counts


def test_a_failure_while_shapes_are_planned_stops_nothing_else(spark, tmp_path, monkeypatch):
    from posevidence.operators import shapes
    from posevidence.plans.run import PACKAGE_RESULTS, write_package
    from posevidence.sources.adapter import AS_OF, CHECK_PARAMS, CheckTables
    from posevidence.sources.files import read_hash_list, read_package_members

    t = CheckTables(spark, "/root/testdata/sf0.001")
    names = {"cot_router": "cot", "groups": "channels"}
    tables = {w: t[names.get(w, w)] for w in ("cot_router", "groups", "mission_change", "video_connections", "fed_event", "fed_event_kind_pl")}
    whole = write_package(tables, CHECK_PARAMS, str(tmp_path / "p"), ["shapes", "video", "federation"], AS_OF).first()
    # Census tables that are not there are counted as unavailable, not as a failure.
    assert whole.failures == {} and set(whole.counts) == {"shapes", "video", "federation", "manifest", *PACKAGE_RESULTS}
    listed = {r.name: r.sha256 for r in read_hash_list(spark, str(tmp_path / "p/hashes"))[0].select("name", "sha256").collect()}
    members = read_package_members(spark, str(tmp_path / "p/package")).select("name", "sha256").collect()
    assert {r.sha256 for r in members if not r.name.startswith(("_", "."))} == set(listed.values())

    def broken(versions):
        raise ValueError("no shape today")

    monkeypatch.setattr(shapes, "parse_shapes", broken)
    failed = write_package(tables, CHECK_PARAMS, str(tmp_path / "q"), ["shapes", "federation"]).first()
    assert failed.failures == {"shapes": "ValueError: no shape today"} and {"federation", "manifest", "raw_rows"} <= set(failed.counts)
