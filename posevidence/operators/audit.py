"""Analytics over the export log: chain, corrections, clauses, pages."""

from __future__ import annotations

import hashlib
import string
import sys
import zoneinfo
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from posevidence.functions.canon import DELIVERED, chained_content, row_hash
from posevidence.functions.text import guard_row
from posevidence.materialize import new_folder, settle
from posevidence.operators.sequences import carried
from posevidence.operators.tracks import neighbour_in_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Ids per slice when rows are put in id order.
ID_SLICE = 100_000
# Ids per slice, and most rows of a pack, when contents are packed for chaining.
CHAIN_SLICE = 10_000
PACK_ROWS = 100
CODEC = "zstd"
PAGE_SIZE = 25
# Ranges of a page index; a page puts one of them in order.
PAGE_RANGES = 64
RECENT_IDENTITY_ROWS = 50

# What is withheld from a hash lookup, the sortable columns, the
# kinds that are exports, and the texts of corrections and chain failures.
WITHHELD = ("client_ip", "prev_hash", "row_hash")
SORT_COLUMNS = {
    "when": "ts_utc", "who": "actor", "case": "case_id", "kind": "export_kind",
    "records": "record_count", "outcome": "outcome", "for": "requested_for",
}
EXPORT_KINDS = ("package", "locations")
CORRECTS_ENTRY = r'^corrects entry (\d+): case "(.*?)" -> "(.*?)"'
CORRECTS_CASE = r'^corrects case "(.*?)" -> "(.*?)"'
BROKEN_LINK = (
    "prev_hash does not match the previous chained row (a row was "
    "removed, inserted or reordered before this one)"
)
BROKEN_CONTENT = "row content does not match its recorded hash (the row was edited)"
SHA256_TEXT = r"^[0-9a-f]{64}$"


# ---------------------------------------------------------------------------
# The hash chain
# ---------------------------------------------------------------------------

def _with_log(log: DataFrame) -> DataFrame:
    return log if "log_id" in log.columns else log.withColumn("log_id", F.lit(""))


def verify_chain(log: DataFrame, id_slice: int = ID_SLICE) -> DataFrame:
    """One row per log: whether its chain holds, and where it first breaks.

    Row hashes are recomputed where the rows are. The link test compares each
    chained row with the one before it through id slices, so a single log of any
    length is verified in parallel. Counts stop at the first broken row; the
    total does not.
    """
    log = _with_log(log)
    # Whether a row was edited is told where the row is; only that is moved.
    hashed = log.select(
        "log_id", "id", "prev_hash", "row_hash",
        (row_hash(log, F.col("prev_hash")) != F.col("row_hash")).alias("__edited"),
    )
    chained = hashed.filter(F.col("row_hash").isNotNull()).withColumn(
        "__slice", F.floor(F.col("id") / F.lit(id_slice))
    )
    linked = neighbour_in_slices(chained, ["log_id"], "__slice", ["id"], ["row_hash"])
    expected = F.coalesce("prev_row_hash", F.lit(""))
    reason = F.when(F.coalesce("prev_hash", F.lit("")) != expected, F.lit(BROKEN_LINK)).when(
        F.col("__edited"), F.lit(BROKEN_CONTENT)
    )
    first_failure = (
        linked.select("log_id", "id", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
        .groupBy("log_id")
        .agg(F.min(F.struct("id", "reason")).alias("f"))
        .select("log_id", F.col("f.id").alias("broken_id"), F.col("f.reason").alias("reason"))
    )
    is_chained = F.col("row_hash").isNotNull()
    before = F.col("broken_id").isNull() | (F.col("id") < F.col("broken_id"))
    # One failure per log at most; the counting side is narrow.
    return (
        log.select("log_id", "id", "row_hash")
        .join(first_failure, "log_id", "left")
        .groupBy("log_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_chained & before).alias("checked"),
            F.count_if(~is_chained & before).alias("unchained"),
            F.min(F.when(is_chained, F.col("id"))).alias("first_chained_id"),
            F.max("id").alias("last_id"),
            F.min("broken_id").alias("broken_id"),
            F.min("reason").alias("reason"),
        )
        .withColumn("ok", F.col("broken_id").isNull())
    )


_PACKED = "log_id string, slice long, piece long, ids array<bigint>, sizes array<int>, contents binary"
_HASHED = "log_id string, slice long, ids array<bigint>, tail string, hashes binary"


def _pack_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a slice's rows as one compressed row each; rows arrive by log,
    slice and id, and pieces are numbered in that order."""
    codec, piece = pa.Codec(CODEC), 0
    for batch in batches:
        logs, slices, ids, contents = (batch.column(c).to_pylist() for c in ("log_id", "slice", "id", "content"))
        raw = [c.encode("utf-8") for c in contents]
        rows, start = [], 0
        for end in range(1, len(raw) + 1):
            if end < len(raw) and end - start < PACK_ROWS and logs[end] == logs[start] and slices[end] == slices[start]:
                continue
            sizes = [len(r) for r in raw[start:end]]
            packed = codec.compress(b"".join(raw[start:end]), asbytes=True)
            rows.append((logs[start], slices[start], piece, ids[start:end], sizes, packed))
            start, piece = end, piece + 1
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            names = ["log_id", "slice", "piece", "ids", "sizes", "contents"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _extend_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row hashed onto the one before it; packs arrive by log and id.

    Only the last hash is kept between packs, so a log of any length passes
    through in constant memory.
    """
    codec, log, last = pa.Codec(CODEC), None, b""
    for batch in batches:
        tails, hashes = [], []
        for log_id, tail, sizes, packed in zip(
            *(batch.column(c).to_pylist() for c in ("log_id", "tail", "sizes", "contents"))
        ):
            if log_id != log:
                log, last = log_id, (tail or "").encode("utf-8")
            contents = codec.decompress(packed, decompressed_size=sum(sizes), asbytes=True)
            tails.append(last.decode("utf-8"))
            own, at = [], 0
            for size in sizes:
                digest = hashlib.sha256(last + contents[at : at + size])
                own.append(digest.digest())
                last, at = digest.hexdigest().encode("ascii"), at + size
            hashes.append(b"".join(own))
        yield pa.record_batch(
            [batch.column("log_id"), batch.column("slice"), batch.column("ids"), pa.array(tails, pa.string()),
             pa.array(hashes, pa.binary())],
            ["log_id", "slice", "ids", "tail", "hashes"],
        )


def _unpack_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of hashes as rows, each with the hash before its own."""
    for batch in batches:
        for k in range(batch.num_rows):
            hashes = batch.column("hashes")[k].as_py().hex()
            own = [hashes[a : a + 64] for a in range(0, len(hashes), 64)]
            ids = batch.column("ids")[k].as_py()
            yield pa.record_batch(
                [pa.array([batch.column("log_id")[k].as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64()),
                 pa.array([batch.column("tail")[k].as_py(), *own[:-1]], pa.string()), pa.array(own, pa.string())],
                ["log_id", "id", "prev_hash", "row_hash"],
            )


def chain_append(new_rows: DataFrame, tails: DataFrame | None = None, id_slice: int = CHAIN_SLICE) -> DataFrame:
    """New rows with ``prev_hash`` and ``row_hash``, chained on in id order.

    ``tails`` holds (log_id, tail), each log's last hash so far. A chain is
    sequential by definition, so one log's hashing is one task's work; logs run
    in parallel and nothing is gathered. Everything else is done in id slices:
    rows are put in order and packed there, so that the one task sorts a few
    compressed packs and streams their contents, and hashes leave it packed.
    """
    new_rows = _with_log(new_rows).drop("prev_hash", "row_hash")
    packed = (
        new_rows.select(
            "log_id", F.floor(F.col("id") / F.lit(id_slice)).alias("slice"), F.col("id").cast("long").alias("id"),
            chained_content(new_rows).alias("content"),
        )
        .repartition("log_id", "slice")
        .sortWithinPartitions("log_id", "slice", "id")
        .mapInArrow(_pack_contents, _PACKED)
    )
    if tails is None:
        packed = packed.withColumn("tail", F.lit(""))
    else:
        packed = packed.join(tails, "log_id", "left")
    hashes = (
        packed.repartition("log_id")
        .sortWithinPartitions("log_id", "slice", "piece")
        .mapInArrow(_extend_chains, _HASHED)
        .repartition("log_id", "slice")
        .mapInArrow(_unpack_hashes, "log_id string, id bigint, prev_hash string, row_hash string")
    )
    # Written first, so that the packs are gone before the rows themselves are moved.
    return new_rows.join(settle(hashes), ["log_id", "id"])


# ---------------------------------------------------------------------------
# Case corrections
# ---------------------------------------------------------------------------

def parse_corrections(log: DataFrame) -> DataFrame:
    """(id, entry_id, old, new) of the correction rows that mean one thing.

    A text whose remainder is not the expected continuation could be read two
    ways, and is left unapplied.
    """
    detail = F.coalesce("detail", F.lit(""))
    parsed = log.filter(F.col("export_kind") == "case-correction").select(
        "id", detail.alias("d"), detail.rlike(CORRECTS_ENTRY).alias("by_entry"), detail.rlike(CORRECTS_CASE).alias("by_case")
    )
    d = F.col("d")
    pick = lambda e, c: F.when(
        F.col("by_entry"), F.regexp_extract(d, CORRECTS_ENTRY, e)
    ).otherwise(F.regexp_extract(d, CORRECTS_CASE, c))
    rest = F.when(F.col("by_entry"), F.regexp_replace(d, CORRECTS_ENTRY, "")).otherwise(
        F.regexp_replace(d, CORRECTS_CASE, "")
    )
    plain = (rest == "") | rest.startswith(" (") | rest.startswith(";")
    return parsed.filter((F.col("by_entry") | F.col("by_case")) & plain).select(
        "id",
        F.when(F.col("by_entry"), F.regexp_extract(d, CORRECTS_ENTRY, 1).try_cast("bigint")).alias("entry_id"),
        pick(2, 1).alias("old"),
        pick(3, 2).alias("new"),
    )


def resolve_corrections(corrections: DataFrame, id_slice: int = ID_SLICE) -> DataFrame:
    """(entry_id, case, effective): where each corrected entry or case now reads.

    Later renames carry along what already points at the old name, so a rename
    is followed by the next rename of its new name. Successors are found by an
    as-of merge in id slices. A slice follows its chains until they leave it;
    what is left goes from slice to slice by pointer doubling, in as many rounds
    as the number of slices that a chain meets has binary digits.
    """
    corrections = settle(corrections)
    renames = corrections.filter(F.col("entry_id").isNull()).select("id", "old", "new")
    entries = (
        corrections.filter(F.col("entry_id").isNotNull())
        .groupBy("entry_id")
        .agg(F.max(F.struct("id", "new")).alias("n"))
        .select("entry_id", "n.id", "n.new")
    )
    # A rename stands before what asks at its own id, so it does not follow itself.
    marks = renames.select(
        F.col("old").alias("name"), "id", F.lit(0).alias("asks"), F.col("id").alias("target")
    ).unionByName(
        renames.select(F.lit(None).cast("bigint").alias("entry_id"), "id", "new")
        .unionByName(entries)
        .select("entry_id", F.col("new").alias("name"), "id", F.lit(1).alias("asks")),
        allowMissingColumns=True,
    ).withColumn("slice", F.floor(F.col("id") / F.lit(id_slice)))
    followed = carried(marks, ["name"], "slice", ["id", "asks"], "target", "next", ahead=True)
    followed = settle(
        followed.filter("asks = 1")
        .select("entry_id", "id", "name", "next", "slice")
        .groupBy("slice")
        .applyInArrow(_ends_in_slice, "entry_id long, id long, name string, next long")
    )
    ends = _chain_ends(followed.filter(F.col("entry_id").isNull()).select("id", "name", "next"))
    ends = ends.select(F.col("id").alias("at"), F.col("name").alias("end"))
    by_entry = (
        followed.filter(F.col("entry_id").isNotNull())
        .join(ends, F.col("next") == F.col("at"), "left")
        .select("entry_id", F.lit(None).cast("string").alias("case"), F.coalesce("end", "name").alias("effective"))
    )
    newest = renames.groupBy(F.col("old").alias("case")).agg(F.max("id").alias("id"))
    by_case = newest.join(ends, F.col("id") == F.col("at")).select(
        F.lit(None).cast("bigint").alias("entry_id"), "case", F.col("end").alias("effective")
    )
    return by_entry.unionByName(by_case)


def _ends_in_slice(table: pa.Table) -> pa.Table:
    """Each row with the name and next rename where its chain leaves the slice;
    a next one always has a larger id."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["id"], r["entry_id"] is None), reverse=True)
    reached = {}
    for row in rows:
        row["name"], row["next"] = reached.get(row["next"], (row["name"], row["next"]))
        if row["entry_id"] is None:
            reached[row["id"]] = row["name"], row["next"]
    schema = pa.schema([("entry_id", pa.int64()), ("id", pa.int64()), ("name", pa.string()), ("next", pa.int64())])
    return pa.Table.from_pylist(rows, schema=schema)


def _chain_ends(links: DataFrame) -> DataFrame:
    """(id, name, next) with the name at the end of each link's chain; every
    round doubles how far a link has come, until none has a next one."""
    while not links.filter(F.col("next").isNotNull()).isEmpty():
        ahead = links.select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("next").alias("__next"))
        moved = links.join(ahead, F.col("next") == F.col("__id"), "left")
        links = settle(moved.select("id", F.coalesce("__name", "name").alias("name"), F.col("__next").alias("next")))
    return links


def with_effective_case(log: DataFrame, resolved: DataFrame) -> DataFrame:
    """``effective_case_id``: the entry's correction, else the case's, else as recorded."""
    recorded = F.coalesce("case_id", F.lit(""))
    entries = resolved.filter(F.col("entry_id").isNotNull()).select(
        F.col("entry_id").alias("id"), F.col("effective").alias("__by_entry")
    )
    cases = resolved.filter(F.col("case").isNotNull()).select(
        F.col("case").alias("__case"), F.col("effective").alias("__by_case")
    )
    return (
        log.join(entries, "id", "left")
        .join(cases, recorded == F.col("__case"), "left")
        .withColumn("effective_case_id", F.coalesce("__by_entry", "__by_case", recorded))
        .drop("__by_entry", "__case", "__by_case")
    )


def effective_log(log: DataFrame) -> DataFrame:
    return with_effective_case(log, resolve_corrections(parse_corrections(log)))


# ---------------------------------------------------------------------------
# Search and pages
# ---------------------------------------------------------------------------

def audit_search(effective: DataFrame, text: str) -> DataFrame:
    """Rows whose effective case, recorded case, actor or requester contains the text."""
    text = text.strip()
    if not text:
        return effective
    # Letters A to Z match in either case, all others as they are written.
    folded = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    sought = folded(F.lit(text))
    fields = ("effective_case_id", "case_id", "actor", "requested_for")
    return effective.filter(
        reduce(or_, (F.coalesce(folded(F.col(f)).contains(sought), F.lit(False)) for f in fields))
    )


class PageIndex:
    """Rows dealt into ranges of their order, and how many each range holds.

    A page is found by the counts and read from the range or two it lies in;
    only that range is put in order, whichever page it is. The index is a
    written table and serves all pages.
    """

    def __init__(self, rows: DataFrame, order: list[Column], ranges: int = PAGE_RANGES, size: int = PAGE_SIZE):
        self._order, self._size, self._columns = order, size, rows.columns
        spark = rows.sparkSession
        folder = new_folder(spark, "page-index")
        dealt = rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
        dealt.write.partitionBy("__range").parquet(folder)
        schema = T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType())])
        self._rows = spark.read.schema(schema).parquet(folder)
        # One count for each range.
        counts = dict(self._rows.groupBy("__range").count().collect())
        self._counts = [counts.get(k, 0) for k in range(ranges)]
        self.total = sum(self._counts)

    def ranges_of(self, page: int) -> tuple[list[int], int]:
        """The ranges that a page lies in, and its offset in the first of them."""
        first = (max(page, 1) - 1) * self._size
        before, found, offset = 0, [], 0
        for k, n in enumerate(self._counts):
            if n and before < first + self._size and before + n > first:
                if not found:
                    offset = first - before
                found.append(k)
            before += n
        return found, offset

    def page(self, page: int) -> DataFrame:
        found, offset = self.ranges_of(page)
        rows = self._rows.filter(F.col("__range").isin(found)).drop("__range")
        return rows.orderBy(*self._order).offset(offset).limit(self._size)


def page_order(sort: str = "", direction: str = "desc") -> list[Column]:
    """The order of a listing; an unknown sort key falls back to the id."""
    column = F.col(SORT_COLUMNS.get(sort, "id"))
    return [column.asc() if direction == "asc" else column.desc(), F.desc("id")]


def audit_page(rows: DataFrame, page: int = 1, sort: str = "", direction: str = "desc") -> DataFrame:
    """One page of the log. To turn pages keep a ``PageIndex``."""
    return PageIndex(rows, page_order(sort, direction)).page(page)


def page_count(rows: DataFrame) -> DataFrame:
    total = F.count("*")
    return rows.agg(
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / F.lit(PAGE_SIZE))).cast("bigint").alias("pages"),
    )


def cases(effective: DataFrame) -> DataFrame:
    """One row per case with its newest entry; rows without a case are not one."""
    newest = F.max_by(F.struct("ts_local", "ts_utc", "outcome", "export_kind"), "id")
    return (
        effective.filter(F.col("effective_case_id") != "")
        .groupBy("effective_case_id")
        .agg(F.count("*").alias("entry_count"), F.max("id").alias("last_id"), newest.alias("n"))
        .select(
            "effective_case_id",
            "entry_count",
            "last_id",
            F.col("n.ts_local").alias("last_ts_local"),
            F.col("n.ts_utc").alias("last_ts_utc"),
            F.col("n.outcome").alias("last_outcome"),
            F.col("n.export_kind").alias("last_kind"),
        )
    )


def case_page(effective: DataFrame, page: int = 1) -> DataFrame:
    """A page of cases, newest activity first."""
    return PageIndex(cases(effective), [F.desc("last_id"), F.asc("effective_case_id")]).page(page)


def case_page_entries(effective: DataFrame, page: int = 1) -> DataFrame:
    """Every entry of the cases on a page, one row each; order by id to read."""
    shown = case_page(effective, page).select("effective_case_id", F.col("last_id").alias("case_last_id"))
    return effective.join(F.broadcast(shown), "effective_case_id")


def caseless_entries(effective: DataFrame) -> DataFrame:
    return effective.filter(F.col("effective_case_id") == "").orderBy(F.desc("id")).limit(PAGE_SIZE)


def audit_extract(log: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The chosen rows with guarded cells; all rows when none are named."""
    rows = log if ids is None else log.join(ids.select("id").distinct(), "id", "left_semi")
    return guard_row(rows.select(*log.columns))


# ---------------------------------------------------------------------------
# Clauses of the detail text
# ---------------------------------------------------------------------------

def clause(detail: Column, key: str) -> Column:
    """The first "key: value" clause's value; a key counts only at a clause start."""
    pattern = "(?:^|; )" + key + ": ([^;]+)"
    return F.when(detail.rlike(pattern), F.trim(F.regexp_extract(detail, pattern, 1)))


def recheck_place(detail: Column) -> Column:
    """The "re-check at host:path" of a re-check row, '' for any other."""
    return F.when(
        detail.startswith("re-check at "), F.regexp_extract(detail, "^re-check at ([^;]*)", 1)
    ).otherwise("")


def explode_clauses(log: DataFrame) -> DataFrame:
    """(id, position, key, value) per clause; repeated keys all stay."""
    pieces = log.filter(F.col("detail").isNotNull()).select(
        "id", F.posexplode(F.split("detail", "; ")).alias("position", "text")
    )
    keyed = F.col("text").rlike(r"^[^:]+: ")
    return pieces.select(
        "id",
        "position",
        F.when(keyed, F.regexp_extract("text", r"^([^:]+): ", 1)).alias("key"),
        F.when(keyed, F.regexp_extract("text", r"(?s)^[^:]+: (.*)$", 1)).otherwise(F.col("text")).alias("value"),
    )


def _listed_files(log: DataFrame) -> DataFrame:
    """(id, package_sha256, position, sha256, name) as a row lists them."""
    listed = log.select(
        "id", "package_sha256", F.posexplode(F.split(clause(F.col("detail"), "package files"), ", ")).alias("position", "item")
    )
    parts = F.split(F.trim("item"), " ", 2)
    return listed.select(
        "id", "package_sha256", "position", F.get(parts, 0).alias("sha256"), F.get(parts, 1).alias("name")
    ).filter(F.col("name").isNotNull())


def package_files(log: DataFrame) -> DataFrame:
    """(id, package_sha256, sha256, name) of each file a row lists; bad hashes go."""
    return _listed_files(log).filter(F.col("sha256").rlike(SHA256_TEXT)).drop("position")


def script_hash_check(scripts: DataFrame, log: DataFrame) -> DataFrame:
    """Each kept script's hash against the one its newest export row recorded."""
    exports = newest_per_package(log, EXPORT_KINDS)
    # The first of equal names in a row's list counts, whatever it gives as hash.
    recorded = (
        _listed_files(exports)
        .groupBy("package_sha256", F.col("name").alias("__name"))
        .agg(F.min_by("sha256", "position").alias("recorded_sha256"))
    )
    kept = scripts.select(
        "package_sha256",
        "case_prefix",
        F.concat("case_prefix", F.lit("-queries.sql")).alias("__name"),
        F.sha2("queries_sql", 256).alias("actual_sha256"),
    )
    same = F.col("recorded_sha256") == F.col("actual_sha256")
    return kept.join(recorded, ["package_sha256", "__name"], "left").select(
        "package_sha256",
        "case_prefix",
        "actual_sha256",
        "recorded_sha256",
        F.when(same, "match").when(F.col("recorded_sha256").isNull(), "not recorded").otherwise("mismatch").alias("state"),
    )


# ---------------------------------------------------------------------------
# Newest rows, deliveries, identities
# ---------------------------------------------------------------------------

def newest_per_package(log: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The newest row of the given kinds for each package.

    A package exported very many times is reduced map-side to one row.
    """
    rest = [c for c in log.columns if c != "package_sha256"]
    return (
        log.filter(F.col("export_kind").isin(*kinds) & F.col("package_sha256").isNotNull())
        .groupBy("package_sha256")
        .agg(F.max_by(F.struct(*rest), "id").alias("r"))
        .select("package_sha256", "r.*")
    )


def certification_facts(log: DataFrame) -> DataFrame:
    """Per package: its newest export and, where there is one, newest re-check."""
    export = newest_per_package(log, EXPORT_KINDS)
    recheck = newest_per_package(log, ("recheck",)).select(
        "package_sha256",
        F.col("id").alias("recheck_id"),
        F.col("outcome").alias("recheck_outcome"),
        recheck_place(F.coalesce("detail", F.lit(""))).alias("recheck_where"),
        clause(F.col("detail"), "raw table rows match").alias("raw_rows_match"),
    )
    return export.join(recheck, "package_sha256", "left").select(
        "package_sha256",
        F.col("id").alias("export_id"),
        "case_id",
        "tool_version",
        F.coalesce("ts_local", "ts_utc").alias("exported"),
        F.col("actor").alias("exported_by"),
        "requested_for",
        "outcome",
        "window_start",
        "window_end",
        "window_timezone",
        F.size(F.split(clause(F.col("detail"), "package files"), ", ")).alias("files_listed"),
        "recheck_id",
        "recheck_outcome",
        "recheck_where",
        "raw_rows_match",
    )


def latest_recheck(log: DataFrame) -> DataFrame:
    """The newest re-check of each package."""
    return newest_per_package(log, ("recheck",)).select(
        "package_sha256",
        "id",
        "actor",
        "outcome",
        F.coalesce("ts_local", "ts_utc").alias("when"),
        recheck_place(F.coalesce("detail", F.lit(""))).alias("where"),
    )


def confirm_deliveries(log: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The log with the delivered mark on each confirmed package's newest row
    that does not carry one yet."""
    open_rows = (
        log.filter(~F.col("outcome").contains("delivered"))
        .join(confirmed.select("package_sha256").distinct(), "package_sha256", "left_semi")
        .groupBy("package_sha256")
        .agg(F.max("id").alias("id"))
        .select("id", F.lit(True).alias("__mark"))
    )
    return (
        log.join(open_rows, "id", "left")
        .withColumn(
            "outcome", F.when(F.col("__mark"), F.concat("outcome", F.lit(DELIVERED))).otherwise(F.col("outcome"))
        )
        .select(*log.columns)
    )


def recent_source_identities(log: DataFrame, limit: int = RECENT_IDENTITY_ROWS) -> DataFrame:
    """The distinct sources of the most recent exports that recorded one."""
    recent = (
        log.filter(F.col("export_kind").isin(*EXPORT_KINDS) & F.col("detail").contains("source database: "))
        .orderBy(F.desc("id"))
        .limit(limit)
        .select("id", "ts_local", "case_id", clause(F.col("detail"), "source database").alias("identity"))
        .filter(F.col("identity").isNotNull())
    )
    newest = F.max_by(F.struct("ts_local", "case_id"), "id").alias("n")
    return recent.groupBy("identity").agg(F.max("id").alias("last_id"), newest).select(
        "identity", "last_id", F.col("n.ts_local").alias("when"), F.col("n.case_id").alias("case_id")
    )


def identity_check(current: str, recent: DataFrame) -> DataFrame:
    """Whether a source's identity is among the recent ones; no record is fine."""
    known = F.count("*")
    found = F.count_if(F.col("identity") == current)
    return recent.agg(
        F.lit(current).alias("identity"),
        known.alias("known"),
        F.when((known == 0) | (found > 0), "ok").otherwise("warn").alias("status"),
    )


# ---------------------------------------------------------------------------
# Windows and hash lookups
# ---------------------------------------------------------------------------

def known_zones(spark) -> list[str]:
    """Zone names both runtimes know; any other name has no conversion."""
    here = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    listed = zoneinfo.available_timezones()
    return sorted(here & listed if listed else here)


def window_in_utc(naive: str, zone: str, zones: list[str]) -> Column:
    """Wall-clock text of a zone as UTC; NULL without a zone that is known."""
    names = ", ".join(f"'{z}'" for z in zones)
    usable = F.expr(f"CASE WHEN `{zone}` IN ({names}) THEN `{zone}` END")
    return F.convert_timezone(usable, F.lit("UTC"), F.col(naive).try_cast("timestamp_ntz"))


def _asked_hashes(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.lower(F.trim("file_hash"))).filter(
        F.col("file_hash").rlike(SHA256_TEXT)
    )


def lookup_hashes(files: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows for each asked-for hash, without what a verifier has no use for."""
    shown = [c for c in log.columns if c not in WITHHELD]
    asked = _asked_hashes(files).select("file_hash").distinct()
    return asked.join(log.select(*shown), F.col("file_hash") == F.col("package_sha256"))


def window_containment(files: DataFrame, log: DataFrame) -> DataFrame:
    """Per file and matching log row: does the recorded window contain the
    file's own time range? NULL when the row cannot tell.

    ``files`` holds (file_hash, file_min_utc, file_max_utc) as UTC wall clock.
    """
    zones = known_zones(log.sparkSession)
    windows = log.select(
        "id",
        "package_sha256",
        window_in_utc("window_start", "window_timezone", zones).alias("start_utc"),
        window_in_utc("window_end", "window_timezone", zones).alias("end_utc"),
    )
    asked = _asked_hashes(files)
    inside = (F.col("start_utc") <= F.col("file_min_utc")) & (
        F.col("file_max_utc") <= F.col("end_utc")
    )
    readable = F.col("start_utc").isNotNull() & F.col("end_utc").isNotNull()
    return asked.join(windows, F.col("file_hash") == F.col("package_sha256")).select(
        *asked.columns, "id", "start_utc", "end_utc", F.when(readable, inside).alias("contained")
    )
