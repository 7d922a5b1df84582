import hashlib
import re

import pytest
from pyspark.sql import functions as F

from posevidence.operators import audit

FIELDS = "id long, ts_utc string, ts_local string, actor string, case_id string, export_kind string, record_count long, package_sha256 string, outcome string, detail string, requested_for string"


def log(spark, rows):
    """Rows of (case, kind, outcome, detail); ids ascend."""
    return spark.createDataFrame(
        [(i, f"t{i:03}", f"t{i:03}", "authenticated: admin", c, k, 1, "aa" * 32, o, d, None) for i, (c, k, o, d) in enumerate(rows, 1)],
        FIELDS,
    )


def chained(spark, n=12):
    rows = [("C", "package", "generated", f"row {i}; é") for i in range(n)]
    return audit.chain_append(log(spark, rows))


def verdict(df):
    return audit.verify_chain(df).first()


@pytest.mark.parametrize("slice_size", [100_000, 3])
def test_chain_holds_and_breaks(spark, monkeypatch, slice_size):
    monkeypatch.setattr(audit, "ID_SLICE", slice_size)
    df = chained(spark).cache()
    good = verdict(df)
    assert good.ok and (good.total, good.checked, good.unchained, good.first_chained_id, good.last_id) == (12, 12, 0, 1, 12)
    # A delivery note may be added; anything else may not.
    assert verdict(df.withColumn("outcome", F.concat("outcome", F.lit(" / delivered")))).ok
    edited = verdict(df.withColumn("detail", F.when(F.col("id") == 7, "changed").otherwise(F.col("detail"))))
    assert (edited.broken_id, edited.reason, edited.checked, edited.total) == (7, audit.BROKEN_CONTENT, 6, 12)
    removed = verdict(df.filter("id <> 5"))
    assert (removed.broken_id, removed.reason, removed.checked, removed.total) == (6, audit.BROKEN_LINK, 4, 11)
    both = verdict(df.filter("id <> 5").withColumn("detail", F.when(F.col("id") == 6, "x").otherwise(F.col("detail"))))
    assert both.reason == audit.BROKEN_LINK
    early = df.withColumn("row_hash", F.when(F.col("id") > 2, F.col("row_hash"))).withColumn("prev_hash", F.when(F.col("id") > 3, F.col("prev_hash")))
    assert verdict(early).broken_id == 3  # its content was hashed onto a previous row


def test_rows_before_the_chain_are_not_broken(spark):
    old = log(spark, [("C", "package", "ok", None)] * 3).withColumn("prev_hash", F.lit(None).cast("string")).withColumn("row_hash", F.lit(None).cast("string")).withColumn("id", F.col("id") - 10)
    new = chained(spark, 4).drop("log_id")
    got = verdict(old.unionByName(new))
    assert got.ok and (got.total, got.checked, got.unchained, got.first_chained_id) == (7, 4, 3, 1)


def test_appending_in_two_steps_equals_one(spark):
    whole = {r.id: r.row_hash for r in chained(spark, 9).collect()}
    rows = log(spark, [("C", "package", "generated", f"row {i}; é") for i in range(9)])
    first = audit.chain_append(rows.filter("id <= 4"))
    tails = first.groupBy("log_id").agg(F.max_by("row_hash", "id").alias("tail"))
    second = audit.chain_append(rows.filter("id > 4"), tails)
    assert {r.id: r.row_hash for r in first.unionByName(second).collect()} == whole


CASES = [
    ("TestingExprot", "package", "generated", None),
    ("TestingExprot", "recheck-fetch", "ok", None),
    ("TestingExprot", "recheck", "raw match", None),
    ("SomeoneElse", "package", "generated", None),
    ("TestingExport", "case-correction", "recorded", 'corrects case "TestingExprot" -> "TestingExport" (3 entries); reason: typed wrong'),
    ("TestingExport", "case-correction", "recorded", 'corrects entry 4: case "SomeoneElse" -> "TestingExport"'),
    ("CASE-14", "case-correction", "recorded", 'corrects case "TestingExport" -> "CASE-14" (6 entries)'),
    ("A", "package", "generated", None),
    ("B", "case-correction", "recorded", 'corrects case "A" -> "B" -> "RealTarget" (1 entries)'),
    (None, "user-add", "ok", None),
]


def test_corrections_chain_and_ambiguous_ones_are_ignored(spark):
    df = log(spark, CASES)
    resolved = audit.resolve_corrections(audit.parse_corrections(df))
    assert {(r.entry_id, r.case, r.effective) for r in resolved.collect()} == {
        (4, None, "CASE-14"), (None, "TestingExprot", "CASE-14"), (None, "TestingExport", "CASE-14")}
    effective = audit.with_effective_case(df, resolved)
    assert {r.id: r.effective_case_id for r in effective.collect()} == {
        1: "CASE-14", 2: "CASE-14", 3: "CASE-14", 4: "CASE-14", 5: "CASE-14", 6: "CASE-14", 7: "CASE-14", 8: "A", 9: "B", 10: ""}
    # The old name still finds the rows recorded under it.
    assert audit.audit_search(effective, "testingexprot").count() == 3
    found = {r.effective_case_id: r for r in audit.cases(effective).collect()}
    assert found["CASE-14"].entry_count == 7 and found["CASE-14"].last_kind == "case-correction" and "" not in found
    assert [r.id for r in audit.caseless_entries(effective).collect()] == [10]


def test_random_renames_against_a_fold(spark):
    import random

    rng = random.Random(11)
    rows = []
    for _ in range(60):
        if rng.random() < 0.3:
            rows.append(("x", "case-correction", "r", f'corrects entry {rng.randrange(5)}: case "q" -> "n{rng.randrange(8)}"'))
        else:
            rows.append(("x", "case-correction", "r", f'corrects case "n{rng.randrange(8)}" -> "n{rng.randrange(8)}"'))
    corrections = audit.parse_corrections(log(spark, rows))
    entries, cases = {}, {}
    for row in corrections.orderBy("id").collect():
        if row.entry_id is not None:
            entries[row.entry_id] = row.new
            continue
        for names in (entries, cases):
            for key, name in names.items():
                if name == row.old:
                    names[key] = row.new
        cases[row.old] = row.new
    found = {(r.entry_id, r.case): r.effective for r in audit.resolve_corrections(corrections).collect()}
    assert found == {(k, None): v for k, v in entries.items()} | {(None, k): v for k, v in cases.items()}


def test_pages(spark):
    df = log(spark, [(f"C{i % 30}", "package", "o", None) for i in range(60)])
    effective = audit.effective_log(df)
    assert [r.id for r in audit.audit_page(effective, 3).collect()] == list(range(10, 0, -1))
    assert tuple(audit.page_count(effective).first()) == (60, 3)
    assert tuple(audit.page_count(effective.filter("id < 0")).first()) == (0, 1)
    assert [r.effective_case_id for r in audit.case_page(effective, 2).collect()] == ["C4", "C3", "C2", "C1", "C0"]
    assert audit.case_page_entries(effective, 2).count() == 10
    assert audit.audit_page(effective, 1, "no such column", "asc").first().id == 1


def test_clauses_need_a_boundary(spark):
    h, g = "ab" * 32, "cd" * 32
    df = log(spark, [("C", "package", "o", f"note package files: {g} x; package files: {h} a.csv, zz b.csv; k: v: w; tail")])
    assert [(r.sha256, r.name) for r in audit.package_files(df).collect()] == [(h, "a.csv")]
    pieces = [(r.position, r.key, r.value) for r in audit.explode_clauses(df).orderBy("position").collect()]
    assert pieces[2] == (2, "k", "v: w") and pieces[3] == (3, None, "tail")


def test_window_containment_has_three_answers(spark):
    rows = [
        (1, "aa" * 32, "2026-07-01T00:00", "2026-07-01T12:00", "America/Chicago"),
        (2, "aa" * 32, "2026-07-01T00:00", "2026-07-01T12:00", None),
        (3, "aa" * 32, "2026-07-01T00:00", "2026-07-01T12:00", "Not/AZone"),
        (4, "aa" * 32, "2026-07-01T00:00", "2026-07-01T12:00", "UTC"),
        (5, "aa" * 32, "not a time", "2026-07-01T12:00", "UTC"),
    ]
    df = spark.createDataFrame(rows, "id long, package_sha256 string, window_start string, window_end string, window_timezone string")
    files = spark.createDataFrame([(" " + "AA" * 32, "2026-07-01 05:00:00", "2026-07-01 17:00:00"), ("nothex", "2026-07-01 05:00:00", "2026-07-01 17:00:00")], "file_hash string, a string, b string").select(
        "file_hash", F.col("a").cast("timestamp_ntz").alias("file_min_utc"), F.col("b").cast("timestamp_ntz").alias("file_max_utc"))
    got = {r.id: r.contained for r in audit.window_containment(files, df).collect()}
    assert got == {1: True, 2: None, 3: None, 4: False, 5: None}


def test_lookup_withholds(spark):
    df = chained(spark, 2).withColumn("client_ip", F.lit("10.0.0.1"))
    files = spark.createDataFrame([("AA" * 32,), ("bb" * 32,)], "file_hash string")
    found = audit.lookup_hashes(files, df)
    assert found.count() == 2 and not set(audit.WITHHELD) & set(found.columns)


def test_delivery_mark_goes_to_the_newest_open_row(spark):
    df = log(spark, [("C", "package", "generated", None), ("C", "package", "generated", None), ("C", "package", "generated / delivered", None)])
    confirmed = spark.createDataFrame([("aa" * 32,)], "package_sha256 string")
    got = {r.id: r.outcome for r in audit.confirm_deliveries(df, confirmed).collect()}
    assert got == {1: "generated", 2: "generated / delivered", 3: "generated / delivered"}


def test_identity_check(spark):
    df = log(spark, [("C", "package", "o", "x; source database: cluster 7"), ("C", "locations", "o", "source database: cluster 8; y"), ("C", "recheck", "o", "source database: cluster 9")])
    recent = audit.recent_source_identities(df)
    assert {r.identity: r.last_id for r in recent.collect()} == {"cluster 7": 1, "cluster 8": 2}
    assert audit.identity_check("cluster 7", recent).first().status == "ok"
    assert audit.identity_check("catalog 7", recent).first().status == "warn"
    assert audit.identity_check("anything", recent.filter("last_id < 0")).first().status == "ok"


def renamed(spark, links):
    """Corrections as (id, entry_id, old, new)."""
    return spark.createDataFrame(links, "id long, entry_id long, old string, new string")


def test_a_long_chain_of_renames_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settle = audit.settle
    monkeypatch.setattr(audit, "settle", lambda df: rounds.append(1) or settle(df))
    n = 20_000
    links = [(k, None, f"n{k}", f"n{k + 1}") for k in range(1, n + 1)] + [(n + 1, 7, "x", "n5"), (n + 2, 8, "x", "other")]
    found = audit.resolve_corrections(renamed(spark, links), id_slice=10).collect()
    assert {(r.entry_id, r.case): r.effective for r in found} == {(None, f"n{k}"): f"n{n + 1}" for k in range(1, n + 1)} | {(7, None): "n5", (8, None): "other"}
    assert len(rounds) <= 2 + 16


@pytest.mark.parametrize("id_slice", [1000, 3])
def test_one_name_renamed_again_and_again(spark, id_slice):
    """Every second rename leaves one hot name, which many others lead to."""
    links, names = [], {}
    for k in range(1, 301):
        old, new = ("hot", f"c{k}") if k % 10 == 0 else (f"a{k % 23}", "hot") if k % 2 else (f"c{k - 8}", "hot")
        links.append((k, None, old, new))
        names = {case: new if name == old else name for case, name in names.items()} | {old: new}
    found = audit.resolve_corrections(renamed(spark, links), id_slice=id_slice).collect()
    assert {r.case: r.effective for r in found} == names


def test_a_page_is_read_from_its_range(spark):
    rows = spark.range(40_000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("record_count"), F.lit("x").alias("pad")
    )
    for sort, direction in (("records", "asc"), ("records", "desc"), ("", "desc")):
        order = audit.page_order(sort, direction)
        index = audit.PageIndex(rows, order, ranges=16)
        assert index.total == 40_000
        everything = [r.id for r in rows.orderBy(*order).collect()]
        for page in (1, 2, 777, 1599, 1600, 1601):
            assert [r.id for r in index.page(page).collect()] == everything[(page - 1) * 25 : page * 25]
            assert len(index.ranges_of(page)[0]) <= 2
        plan = index.page(1234)._jdf.queryExecution().executedPlan().toString()
        # Only the page's range is read, and no other is put in order.
        assert re.search(r"PartitionFilters: \[[^\]]*__range#\d+ (IN|=)", plan), plan
    assert audit.PageIndex(rows.limit(0), audit.page_order()).page(1).count() == 0


def test_the_first_of_equal_names_counts(spark):
    import hashlib

    script = "SELECT 1;"
    own, other = hashlib.sha256(script.encode()).hexdigest(), "0" * 64
    rows = [
        ("C", "package", "o", f"package files: {own} P-queries.sql, {other} P-queries.sql"),
        ("C", "package", "o", f"package files: {other} P-queries.sql, {own} P-queries.sql"),
        ("C", "package", "o", f"package files: ffff P-queries.sql, {own} P-queries.sql"),
    ]
    df = log(spark, rows).withColumn("package_sha256", F.concat(F.lit("p"), F.col("id").cast("string")))
    scripts = spark.createDataFrame([(f"p{k}", "P", script) for k in (1, 2, 3, 4)], "package_sha256 string, case_prefix string, queries_sql string")
    found = {r.package_sha256: (r.state, r.recorded_sha256) for r in audit.script_hash_check(scripts, df).collect()}
    assert found == {"p1": ("match", own), "p2": ("mismatch", other), "p3": ("mismatch", "ffff"), "p4": ("not recorded", None)}


def test_long_logs_are_chained_through_packs_of_slices(spark):
    rows = [(f"C{i % 2}" if i % 9 else "", "package", "generated", f"row {i}; é" * (i % 5)) for i in range(700)]
    new = log(spark, rows).withColumn("log_id", F.col("case_id"))
    # Packs end within a slice, with a slice, and with a log.
    got = {r.id: (r.prev_hash, r.row_hash) for r in audit.chain_append(new.repartition(5), id_slice=300).collect()}
    content = {r.id: (r.log_id, r.c) for r in new.select("id", "log_id", audit.chained_content(new).alias("c")).collect()}
    last, expected = {}, {}
    for i, (log_id, text) in sorted(content.items()):
        before = last.get(log_id, "")
        last[log_id] = hashlib.sha256((before + text).encode("utf-8")).hexdigest()
        expected[i] = before, last[log_id]
    assert got == expected


def test_tampering_writes_the_log_once_and_moves_places_only(spark, monkeypatch):
    """The rows that change are found among rows of a key and an id."""
    from posevidence.functions.canon import CHAIN_FIELDS
    from posevidence.plans import audit_queries

    written = []

    def settled(df):
        written.append(df.columns)
        return settle(df)

    settle = audit_queries.settle
    monkeypatch.setattr(audit_queries, "settle", settled)
    texts = [c for c in CHAIN_FIELDS if c not in ("north", "south", "west", "east", "record_count")]
    rows = [
        (100 * (k // 20) + 7 * (k % 20), *[f"CASE-{k // 20}" if c == "case_id" else f"{c} {k}" for c in texts], k, None, None)
        for k in range(80)
    ]
    schema = "id long, " + ", ".join(f"{c} string" for c in texts) + ", record_count int, prev_hash string, row_hash string"
    log = spark.createDataFrame([*rows, (1, *rows[0][1:5], "OTHER", *rows[0][6:])], schema)
    found = {r["log_id"]: (r["ok"], r["broken_id"], r["reason"]) for r in audit_queries.tampered_chain({"export_log": log}).collect()}
    link, content = audit_queries.audit.BROKEN_LINK, audit_queries.audit.BROKEN_CONTENT
    assert found == {
        "CASE-0": (False, 49, link), "CASE-1": (False, 170, link), "CASE-2": (False, 229, link), "CASE-3": (False, 356, content),
    }
    assert sum("detail" in columns for columns in written) == 1
    assert sorted(written[-1]) == ["edited", "forged", "new_id", "removed", "row"]
