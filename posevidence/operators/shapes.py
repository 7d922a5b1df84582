"""Drawn shapes: parsing, versions, fate, outlines and features."""

from __future__ import annotations

import sys
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from posevidence.functions import classify, geometry
from posevidence.operators.sequences import carried, placed
from posevidence.operators.tracks import time_slice
from posevidence.params import NOT_RECORDED, Box

# The blob reader travels inside the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The type of a drawn circle, and elements only software writes.
CIRCLE_TYPE = "u-d-c-c"
AUTOMATED_FEED_MARKS = ("__nodered",)

# The columns of the shapes result and the outcomes in the manifest.
SHAPE_COLUMNS = (
    "record", "uid", "shape_kind", "cot_type", "servertime", "event_time",
    "callsign", "creator_uid", "creator_callsign", "creator_time",
    "vertices", "closed", "center_lat", "center_lon",
    "radius_m", "minor_radius_m", "angle_deg",
    "stroke_argb", "fill_argb", "stroke_weight",
    "channels", "channel_numbers", "mission_id", "record_id",
)
FATE_NOT_A_SHAPE = "n/a - not a drawn map object"
FATE_NOT_SELECTED = "n/a - shapes.csv not selected"
FATE_YES = "yes"
FATE_OUTSIDE = "no - no part of the shape touched the bounding box"
FATE_NO_GEOMETRY = "no - no drawable geometry in any version"
FATE_CHANNEL = "no - not on a selected channel"

_VERTEX = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
DETAIL_SCHEMA = T.StructType(
    [
        T.StructField("vertices", T.ArrayType(_VERTEX)),
        T.StructField("vertices_text", T.StringType()),
        T.StructField("radius_m", T.DoubleType()),
        T.StructField("minor_m", T.DoubleType()),
        T.StructField("angle_deg", T.DoubleType()),
        T.StructField("stroke_argb", T.LongType()),
        T.StructField("fill_argb", T.LongType()),
        T.StructField("stroke_weight", T.DoubleType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("creator_uid", T.StringType()),
        T.StructField("creator_callsign", T.StringType()),
        T.StructField("creator_time", T.StringType()),
        T.StructField("feed_mark", T.StringType()),
    ]
)

_EMPTY_TEXTS = ("vertices_text", "callsign", "creator_uid", "creator_callsign", "creator_time")
_ARROW_DETAIL = to_arrow_type(DETAIL_SCHEMA)


def _number(text, convert=float):
    try:
        return convert(text)
    except (TypeError, ValueError):
        return None


def _argb(text) -> int | None:
    value = _number(text, int)
    # Wider than 64 bits only the low 32 count, as they do for the hex form.
    return value if value is None or -(2**63) <= value < 2**63 else value & 0xFFFFFFFF


def _vertex(text: str | None) -> tuple[float, float] | None:
    parts = (text or "").split(",")
    pair = tuple(_number(p) for p in parts[:2])
    return pair if len(pair) == 2 and None not in pair else None


def read_detail(text: str | None) -> dict:
    """Drawing facts of one detail blob; a blob that will not parse has none."""
    facts = dict.fromkeys(DETAIL_SCHEMA.names)
    facts.update(vertices=[], **dict.fromkeys(_EMPTY_TEXTS, ""))
    try:
        root = ET.fromstring(text) if text else None
    except ET.ParseError:
        root = None
    if root is None:
        return facts

    def attribute(path: str, name: str) -> str | None:
        found = root.find(path)
        return None if found is None else found.get(name)

    # A link without point= is a style reference; links count at any depth.
    placed = [_vertex(link.get("point")) for link in root.iter("link")]
    vertices = [v for v in placed if v is not None]
    facts["vertices"] = [{"lat": lat, "lon": lon} for lat, lon in vertices]
    facts["vertices_text"] = " ".join(f"{lat!r},{lon!r}" for lat, lon in vertices)
    for key, name in (("radius_m", "major"), ("minor_m", "minor"), ("angle_deg", "angle")):
        facts[key] = _number(attribute("./shape/ellipse", name))
    facts["stroke_argb"] = _argb(attribute("strokeColor", "value"))
    if facts["stroke_argb"] is None:
        # A dropped point carries its colour in an element of its own.
        facts["stroke_argb"] = _argb(attribute("color", "argb") or attribute("color", "value"))
    facts["fill_argb"] = _argb(attribute("fillColor", "value"))
    facts["stroke_weight"] = _number(attribute("strokeWeight", "value"))
    facts["callsign"] = attribute("contact", "callsign") or ""
    for key, name in (("creator_uid", "uid"), ("creator_callsign", "callsign"), ("creator_time", "time")):
        facts[key] = attribute("creator", name) or ""
    facts["feed_mark"] = next((m for m in AUTOMATED_FEED_MARKS if root.find(m) is not None), None)
    return facts


def _detail_udf():
    @F.arrow_udf(DETAIL_SCHEMA)
    def parse(texts: pa.Array) -> pa.Array:
        # What was read natively comes as NULL and costs nothing here.
        return pa.array([None if t is None else read_detail(t) for t in texts.to_pylist()], _ARROW_DETAIL)

    return parse


# ---------------------------------------------------------------------------
# Blobs that Spark's own XML reader can read
# ---------------------------------------------------------------------------

# Attributes are told from elements by a prefix that no blob uses.
_AT = "at__"


def _elements(*attributes: str, **inner: str) -> str:
    fields = [f"{_AT}{a}:string" for a in attributes] + [f"{k}:{v}" for k, v in inner.items()]
    return f"array<struct<{','.join(fields)}>>"


_LINKS = _elements("point")
_READ = {
    "link": _LINKS,
    "shape": _elements(ellipse=_elements("major", "minor", "angle"), link=_LINKS),
    "strokeColor": _elements("value"),
    "color": _elements("argb", "value"),
    "fillColor": _elements("value"),
    "strokeWeight": _elements("value"),
    "contact": _elements("callsign"),
    "creator": _elements("uid", "callsign", "time"),
    **{mark: _elements("present") for mark in AUTOMATED_FEED_MARKS},
}
_UNREADABLE = "__unreadable"
_XML_SCHEMA = f"struct<{','.join(f'{k}:{v}' for k, v in _READ.items())},{_UNREADABLE}:string>"
_XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _UNREADABLE,
    "attributePrefix": _AT,
    "ignoreSurroundingSpaces": "false",
}

# What the two readers see differently: declarations, comments and sections,
# namespaces and prefixes, two characters that are none, and names in another
# case, which Spark does not tell apart. One pattern each, as each begins with a
# character that is quickly looked for.
_NAMES = "|".join([*_READ, "ellipse"])
_ATTRIBUTES = "point|major|minor|angle|value|argb|callsign|uid|time"
_SPECIAL_TEXTS = ("<!", "<?", "xmlns", "<" + _AT, "\ufffe", "\uffff")
_SPECIAL_PATTERNS = (
    r"""</?[^\s>"'=]*:""",
    r"""\s[^\s="'<>]*:[^\s="'<>]*\s*=\s*["']""",
    rf"<(?!(?:{_NAMES})[\s/>])(?iu:{_NAMES})[\s/>]",
    rf"\s(?!(?:{_ATTRIBUTES})\s*=)(?iu:{_ATTRIBUTES})\s*=",
)
_OPENED, _CLOSED, _NOTHING = "<detail>", "</detail>", "<detail/>"
# Numbers both runtimes read alike, and degrees that are shown as they are written,
# but for zeros at their end.
_PLAIN_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_PLAIN_INTEGER = r"^-?[0-9]{1,18}$"
_DEGREES = r"-?(?!0\.0000)(?:0|[1-9][0-9]{0,2})\.[0-9]{1,11}"
_CLOSING_ZEROS = r"(\.[0-9]+?)0+(?=,|$)"
_PLAIN_POINT = rf"^{_DEGREES},{_DEGREES}(?:,.*)?$"


def _readable_blob(text: Column) -> Column:
    """Whether the blob is one root from end to end, with nothing special in it."""
    good = (
        text.startswith(_OPENED)
        & text.endswith(_CLOSED)
        & (F.instr(text, _CLOSED) == F.length(text) - (len(_CLOSED) - 1))
    )
    for special in _SPECIAL_TEXTS:
        good &= ~text.contains(special)
    for special in _SPECIAL_PATTERNS:
        good &= ~text.rlike(special)
    return good


def _facts(xml: Column, text: Column) -> tuple[Column, Column]:
    """(whether every value is plain, the drawing facts) of a blob read as XML."""
    first = lambda elements, name: F.get(elements, F.lit(0))[_AT + name]
    absent = lambda value: F.coalesce(value, F.lit("")) == ""
    points = F.filter(F.transform(xml["link"], lambda e: e[_AT + "point"]), lambda p: p.isNotNull())
    points = F.coalesce(points, F.array().cast("array<string>"))
    no_shapes = F.array().cast(_READ["shape"])
    drawn = F.coalesce(xml["shape"], no_shapes)
    ellipses = F.flatten(F.filter(F.transform(drawn, lambda e: e["ellipse"]), lambda e: e.isNotNull()))
    inner = F.flatten(F.filter(F.transform(drawn, lambda e: e["link"]), lambda e: e.isNotNull()))
    numbers = {
        "radius_m": first(ellipses, "major"),
        "minor_m": first(ellipses, "minor"),
        "angle_deg": first(ellipses, "angle"),
        "stroke_weight": first(xml["strokeWeight"], "value"),
    }
    own = first(xml["strokeColor"], "value")
    dropped = F.coalesce(F.nullif(first(xml["color"], "argb"), F.lit("")), first(xml["color"], "value"))
    stroke = F.when(absent(own), dropped).otherwise(own)
    fill = first(xml["fillColor"], "value")
    plain = (
        # Every link is one of those read, and those in shapes only name styles.
        (F.regexp_count(text, F.lit(r"<link[\s/>]")) == F.size(F.coalesce(xml["link"], F.array().cast(_LINKS))) + F.size(inner))
        & F.forall(inner, lambda e: e[_AT + "point"].isNull())
        & F.forall(points, lambda p: p.rlike(_PLAIN_POINT))
    )
    for value in numbers.values():
        plain &= absent(value) | value.rlike(_PLAIN_NUMBER)
    for value in (stroke, fill):
        plain &= absent(value) | value.rlike(_PLAIN_INTEGER)
    degree = lambda p, k: F.get(F.split(p, ","), F.lit(k)).try_cast("double")
    vertices = F.transform(points, lambda p: F.struct(degree(p, 0).alias("lat"), degree(p, 1).alias("lon")))
    marks = [F.when(xml[m].isNotNull(), F.lit(m)) for m in AUTOMATED_FEED_MARKS]
    values = {
        "vertices": vertices,
        "vertices_text": F.array_join(
            F.transform(points, lambda p: F.regexp_replace(F.substring_index(p, ",", 2), _CLOSING_ZEROS, "$1")), " "
        ),
        **{name: value.try_cast("double") for name, value in numbers.items()},
        "stroke_argb": stroke.try_cast("bigint"),
        "fill_argb": fill.try_cast("bigint"),
        "callsign": F.coalesce(first(xml["contact"], "callsign"), F.lit("")),
        "creator_uid": F.coalesce(first(xml["creator"], "uid"), F.lit("")),
        "creator_callsign": F.coalesce(first(xml["creator"], "callsign"), F.lit("")),
        "creator_time": F.coalesce(first(xml["creator"], "time"), F.lit("")),
        "feed_mark": marks[0] if len(marks) == 1 else F.coalesce(*marks),
    }
    return plain, F.struct(*[values[name].alias(name) for name in DETAIL_SCHEMA.names]).cast(DETAIL_SCHEMA)


def with_facts(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the facts of each blob as ``name``: read by Spark's XML functions
    where they surely agree with the parser, by the parser for the rest; a blob
    that is NULL, empty or an empty element has none."""
    blob = F.col(text)

    def native(xml: Column) -> Column:
        plain, facts = _facts(xml, blob)
        return F.when(xml.isNotNull() & xml[_UNREADABLE].isNull() & plain, facts)

    xml = F.when(_readable_blob(blob), F.from_xml(blob, _XML_SCHEMA, _XML_OPTIONS))
    read = rows.withColumn("__native", geometry.bound(xml, native))
    empty = F.struct(
        *[
            (F.lit("") if n in _EMPTY_TEXTS else F.array() if n == "vertices" else F.lit(None)).alias(n)
            for n in DETAIL_SCHEMA.names
        ]
    ).cast(DETAIL_SCHEMA)
    rest = F.when(F.col("__native").isNull() & ~blob.isin("", _NOTHING), blob)
    parsed = read.withColumn("__parsed", _detail_udf()(rest))
    return parsed.withColumn(name, F.coalesce("__native", "__parsed", empty)).drop("__native", "__parsed")


def geometry_of(detail: Column, cot_type: Column, lat: Column, lon: Column) -> Column:
    """Kind and extent from the parsed facts; NULL kind when nothing is drawable."""
    v = detail["vertices"]
    first, last = F.try_element_at(v, F.lit(1)), F.try_element_at(v, F.lit(-1))
    same = (first["lat"] == last["lat"]) & (first["lon"] == last["lon"])
    chain = F.size(v) >= 2
    closed = chain & (F.size(v) >= 4) & F.coalesce(same & ~F.isnan(first["lat"]) & ~F.isnan(first["lon"]), F.lit(False))
    anchored = lat.isNotNull() & lon.isNotNull()
    round_ = F.coalesce(cot_type.startswith(CIRCLE_TYPE), F.lit(False)) | detail["minor_m"].isNull() | (
        F.abs(detail["radius_m"] - detail["minor_m"]) < 1e-6
    )
    oval = ~chain & detail["radius_m"].isNotNull() & anchored
    kind = (
        F.when(closed, "polygon")
        .when(chain, "line")
        .when(oval & round_, "circle")
        .when(oval, "ellipse")
        .when(anchored, "point")
    )
    center = lambda c: F.when(~chain & anchored, c)
    return F.struct(
        kind.alias("kind"),
        F.when(chain, v).otherwise(F.array().cast(v_type())).alias("vertices"),
        F.when(chain, detail["vertices_text"]).otherwise(F.lit("")).alias("vertices_text"),
        closed.alias("closed"),
        center(lat).alias("center_lat"),
        center(lon).alias("center_lon"),
        *[detail[c].alias(c) for c in DETAIL_SCHEMA.names if c not in ("vertices", "vertices_text")],
    )


def v_type() -> str:
    return "array<struct<lat:double,lon:double>>"


def parse_shapes(versions: DataFrame) -> DataFrame:
    """Adds ``geom`` to shape versions. Only blobs that Spark's XML reader might
    see otherwise cross to Python."""
    parsed = with_facts(versions, "raw_detail", "__facts")
    # Facts are bound, so that a filter on ``geom`` takes them into its condition
    # once and not at every mention.
    geom = geometry.bound(
        F.col("__facts"), lambda d: geometry_of(d, F.col("cot_type"), F.col("latitude"), F.col("longitude"))
    )
    return parsed.withColumn("geom", geom).drop("__facts", "raw_detail")


def object_fates(parsed: DataFrame, box: Box, include_feed_shapes: bool = False) -> DataFrame:
    """One row per object: what became of it, and what it holds.

    The rules in order: nothing drawable; pushed by an automated feed (left out
    unless asked for); no version touching the box; included.
    """
    drawable = F.col("geom.kind").isNotNull()
    mark = F.when(drawable, F.col("geom.feed_mark"))
    order = F.struct("servertime", "id")
    last = F.struct(F.col("geom.kind").alias("kind"), "cot_type")
    per_object = parsed.groupBy("uid").agg(
        F.count_if(drawable).alias("versions"),
        F.array_join(F.sort_array(F.collect_set(mark)), "+").alias("feed_marks"),
        F.max(F.when(drawable, geometry.touches_box(F.col("geom"), box)).otherwise(False)).alias("touches"),
        F.max_by(F.when(drawable, last), F.when(drawable, order)).alias("last"),
    )
    fate = (
        F.when(F.col("versions") == 0, "no geometry")
        .when((F.col("feed_marks") != "") & ~F.lit(include_feed_shapes), "feed")
        .when(~F.col("touches"), "excluded")
        .otherwise("included")
    )
    return per_object.select("uid", fate.alias("fate"), "versions", "feed_marks", "last")


def included_versions(parsed: DataFrame, fates: DataFrame) -> DataFrame:
    """Every drawable version of every included object, not only those in the box."""
    chosen = fates.filter(F.col("fate") == "included").select("uid")
    return parsed.filter(F.col("geom.kind").isNotNull()).join(chosen, "uid", "left_semi")


def first_deletions(deletions: DataFrame) -> DataFrame:
    """Each uid's earliest deletion, ties by id."""
    return (
        deletions.groupBy("uid")
        .agg(F.min(F.struct("ts", "id", "creatoruid", "mission_id")).alias("d"))
        .select("uid", F.col("d.ts").alias("deleted_at"), F.col("d.creatoruid").alias("deleted_by"), F.col("d.mission_id").alias("deleted_in"))
    )


def _shown_callsign() -> Column:
    return F.coalesce(F.nullif(F.col("geom.callsign"), F.lit("")), F.col("callsign"), F.lit(""))


def shapes_result(parsed: DataFrame, fates: DataFrame, deletions: DataFrame) -> DataFrame:
    """Versions and deletions of the included objects, in one list."""
    g = F.col("geom")
    versions = included_versions(parsed, fates).select(
        F.lit("version").alias("record"),
        "uid",
        g["kind"].alias("shape_kind"),
        "cot_type",
        "servertime",
        "event_time",
        _shown_callsign().alias("callsign"),
        g["creator_uid"].alias("creator_uid"),
        g["creator_callsign"].alias("creator_callsign"),
        g["creator_time"].alias("creator_time"),
        g["vertices_text"].alias("vertices"),
        F.when(g["closed"], "yes").otherwise("no").alias("closed"),
        g["center_lat"].alias("center_lat"),
        g["center_lon"].alias("center_lon"),
        g["radius_m"].alias("radius_m"),
        g["minor_m"].alias("minor_radius_m"),
        g["angle_deg"].alias("angle_deg"),
        classify.argb_hex(g["stroke_argb"]).alias("stroke_argb"),
        classify.argb_hex(g["fill_argb"]).alias("fill_argb"),
        g["stroke_weight"].alias("stroke_weight"),
        "channels",
        "channel_numbers",
        F.lit(None).cast("bigint").alias("mission_id"),
        F.col("id").cast("string").alias("record_id"),
    )
    blank = F.lit("")
    who = F.nullif(F.trim(F.coalesce("deleted_by", blank)), blank)
    deleted = (
        fates.filter(F.col("fate") == "included")
        .join(first_deletions(deletions), "uid")
        .select(
            F.lit("deleted").alias("record"),
            "uid",
            F.col("last.kind").alias("shape_kind"),
            F.col("last.cot_type").alias("cot_type"),
            F.col("deleted_at").alias("servertime"),
            blank.alias("callsign"),
            F.coalesce(who, F.lit(NOT_RECORDED)).alias("creator_uid"),
            *[blank.alias(c) for c in ("creator_callsign", "creator_time", "vertices", "closed")],
            *[blank.alias(c) for c in ("stroke_argb", "fill_argb", "channels", "channel_numbers")],
            F.col("deleted_in").cast("bigint").alias("mission_id"),
            blank.alias("record_id"),
        )
    )
    return versions.unionByName(deleted, allowMissingColumns=True).select(*SHAPE_COLUMNS)


def ordered_shapes(result: DataFrame) -> DataFrame:
    """Chronological; ids compare as text."""
    return result.orderBy(F.col("servertime").cast("string"), "uid", "record_id")


def shape_summary(fates: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row: objects by fate, version rows a feed left out, deletions."""
    removed = deletions.select("uid").distinct().withColumn("__removed", F.lit(True))
    fate = F.col("fate")
    return fates.join(removed, "uid", "left").agg(
        F.count_if(fate == "included").alias("included"),
        F.count_if(fate == "excluded").alias("excluded"),
        F.count_if(fate == "no geometry").alias("no_geometry"),
        F.count_if(fate == "feed").alias("feed_objects"),
        F.coalesce(F.sum(F.when(fate == "feed", F.col("versions"))), F.lit(0)).alias("feed_versions"),
        F.count_if((fate == "included") & F.col("__removed")).alias("deletions"),
    )


def feed_mark_counts(fates: DataFrame) -> DataFrame:
    """Objects carrying each automated-feed mark, left out or not."""
    return (
        fates.filter((F.col("fate") != "no geometry") & (F.col("feed_marks") != ""))
        .select(F.explode(F.split("feed_marks", r"\+")).alias("mark"))
        .groupBy("mark")
        .agg(F.count("*").alias("objects"))
    )


def manifest_with_shapes(manifest: DataFrame, fates: DataFrame | None) -> DataFrame:
    """The manifest with each row's fate in the shapes result."""
    types = F.split(F.coalesce("cot_types_seen", F.lit("")), " ")
    is_shape = F.exists(types, lambda t: F.coalesce(classify.cot_category(t) == classify.MAP_OBJECTS, F.lit(False)))
    if fates is None:
        outcome = F.when(is_shape, FATE_NOT_SELECTED).otherwise(FATE_NOT_A_SHAPE)
        return manifest.withColumn("in_shapes_export", outcome)
    joined = manifest.join(fates.select("uid", "fate", "feed_marks"), "uid", "left")
    by_feed = F.concat(
        F.lit("no - from an automated feed (the record carries a "), F.col("feed_marks"), F.lit(" element)")
    )
    outcome = (
        F.when(~is_shape, FATE_NOT_A_SHAPE)
        .when(F.col("fate") == "included", FATE_YES)
        .when(F.col("fate") == "feed", by_feed)
        .when(F.col("fate") == "excluded", FATE_OUTSIDE)
        .when(F.col("fate") == "no geometry", FATE_NO_GEOMETRY)
        # Seen in the manifest but not among the shapes: only the channel
        # choice can do that.
        .otherwise(FATE_CHANNEL)
    )
    return joined.withColumn("in_shapes_export", outcome).drop("fate", "feed_marks")


def latest_versions(versions: DataFrame) -> DataFrame:
    """Each uid's newest row by (servertime, id)."""
    columns = [c for c in versions.columns if c != "uid"]
    newest = F.max_by(F.struct(*columns), F.struct("servertime", "id"))
    return versions.groupBy("uid").agg(newest.alias("v")).select("uid", "v.*")


def outlines(latest: DataFrame, box: Box, include_feed_shapes: bool = False) -> DataFrame:
    """Shape outlines for a map: geometry only, nothing that identifies.

    ``latest`` holds parsed newest versions. Points are positions, not shapes,
    and are left out; an ellipse is drawn as its ring.
    """
    g = F.col("geom")
    kept = latest.filter(
        g["kind"].isNotNull()
        & (g["kind"] != "point")
        & (F.lit(include_feed_shapes) | g["feed_mark"].isNull())
        & geometry.touches_box(g, box)
    )
    ring = geometry.ellipse_ring(
        g["center_lat"], g["center_lon"], g["radius_m"], g["minor_m"], g["angle_deg"]
    )
    circle = g["kind"] == "circle"
    return kept.select(
        F.when(g["kind"] == "ellipse", "polygon").otherwise(g["kind"]).alias("kind"),
        F.when(g["kind"] == "ellipse", ring).when(~circle, g["vertices"]).alias("latlngs"),
        F.when(circle, g["center_lat"]).alias("center_lat"),
        F.when(circle, g["center_lon"]).alias("center_lon"),
        F.when(circle, g["radius_m"]).alias("radius_m"),
    )


def version_validity(versions: DataFrame, deletions: DataFrame) -> DataFrame:
    """When each drawn version was current: from its own time to the next
    version's, else to the object's deletion, else open.

    ``versions`` are parsed; points are not drawn and take no place in the count.
    """
    drawn = versions.filter(F.col("geom.kind").isNotNull() & (F.col("geom.kind") != "point"))
    # An object without a name is one object too.
    sliced = drawn.withColumns(
        {"__slice": time_slice("servertime", 86400), "__uid": F.coalesce("uid", F.lit("")), "__named": F.col("uid").isNotNull()}
    )
    numbered = placed(sliced, ["__uid", "__named"], "__slice", ["servertime", "id"], ["servertime"])
    return (
        numbered.join(first_deletions(deletions).select("uid", "deleted_at"), "uid", "left")
        .withColumnsRenamed({"place": "version_no", "total": "version_count"})
        .withColumn("valid_from", F.col("servertime"))
        .withColumn(
            "valid_to", F.when(F.col("next_row"), F.col("next_servertime")).otherwise(F.col("deleted_at"))
        )
        .drop("__slice", "__uid", "__named", "next_row", "next_servertime")
    )


def current_at(validity: DataFrame, moments: DataFrame) -> DataFrame:
    """The version of each asked-for object that was current at each moment.

    ``moments`` holds (uid, at) and more. Versions and moments are put in one
    sequence of each object, and the last version before a moment is carried to
    it; it answers unless it had ended by then. No row is copied.
    """
    columns = [c for c in validity.columns if c != "uid"]
    asked = [c for c in moments.columns if c not in ("uid", "at")]
    both = validity.filter(F.col("uid").isNotNull() & F.col("valid_from").isNotNull()).select(
        "uid", F.col("valid_from").alias("at"), F.lit(0).alias("__kind"), F.struct(*columns).alias("__version")
    ).unionByName(
        moments.filter(F.col("uid").isNotNull() & F.col("at").isNotNull()).select(
            "uid", "at", F.lit(1).alias("__kind"), F.struct(F.lit(1).alias("__"), *asked).alias("__asked")
        ),
        allowMissingColumns=True,
    )
    # Of versions of one moment the one that goes on is the last to end.
    open_end = F.coalesce(F.unix_micros("__version.valid_to"), F.lit((1 << 63) - 1))
    both = both.withColumns({"__slice": time_slice("at", 86400), "__until": F.when(F.col("__kind") == 0, open_end)})
    found = carried(both, ["uid"], "__slice", ["at", "__kind", "__until"], "__version", "__current")
    version = F.col("__current")
    return (
        found.filter(F.col("__kind") == 1)
        .filter(version["valid_to"].isNull() | (F.col("at") < version["valid_to"]))
        .filter(version.isNotNull())
        .select("uid", "at", *[F.col("__asked")[c].alias(c) for c in asked], *[version[c].alias(c) for c in columns])
    )


def object_labels(versions: DataFrame) -> DataFrame:
    """What each object is called; a repeated name gets the start of its uid.

    The name is the newest drawn version's callsign, else the uid.
    """
    drawn = F.col("geom.kind") != "point"
    named = versions.groupBy("uid").agg(
        F.max_by(
            F.when(drawn, F.nullif(_shown_callsign(), F.lit(""))),
            F.when(drawn, F.struct("servertime", "id")),
        ).alias("callsign")
    ).select("uid", F.coalesce("callsign", "uid").alias("raw_label"))
    # Counted apart, not in a window: one default name may be on most objects.
    repeated = named.groupBy("raw_label").agg(F.count("*").alias("__n")).filter(F.col("__n") > 1)
    return named.join(repeated, "raw_label", "left").select(
        "uid",
        F.when(F.col("__n").isNotNull(), F.concat("raw_label", F.lit(" ["), F.substring("uid", 1, 8), F.lit("]")))
        .otherwise(F.col("raw_label"))
        .alias("label"),
    )


def draw_order(versions: DataFrame) -> DataFrame:
    """Objects with their largest footprint; large ones are drawn first."""
    return (
        versions.groupBy("uid")
        .agg(F.max(geometry.footprint_area(F.col("geom"))).alias("area"))
        .orderBy(F.desc("area"), "uid")
    )


def shape_features(versions: DataFrame, deletions: DataFrame) -> DataFrame:
    """One drawable feature per version: validity, label, colours and outline."""
    g = F.col("geom")
    ring = geometry.ellipse_ring(
        g["center_lat"], g["center_lon"], g["radius_m"], g["minor_m"], g["angle_deg"]
    )
    areas = versions.groupBy("uid").agg(F.max(geometry.footprint_area(g)).alias("draw_area"))
    return (
        version_validity(versions, deletions)
        .join(object_labels(versions), "uid")
        .join(areas, "uid")
        .select(
            "uid",
            "id",
            "label",
            "version_no",
            "version_count",
            F.col("deleted_at").isNotNull().alias("deleted"),
            "valid_from",
            "valid_to",
            g["kind"].alias("kind"),
            classify.argb_to_abgr(g["stroke_argb"]).alias("line_color"),
            classify.argb_to_abgr(g["fill_argb"]).alias("fill_color"),
            g["stroke_weight"].alias("stroke_weight"),
            "draw_area",
            F.when(g["kind"].isin("circle", "ellipse"), ring).otherwise(g["vertices"]).alias("outline"),
        )
    )


def touched_boxes(parsed: DataFrame, boxes: dict[str, Box]) -> DataFrame:
    """(uid, id, box) for every named box a version touches.

    The boxes are part of the request; they ride along as expressions, so no
    row is ever paired with a box it does not touch.
    """
    named = F.array(*[geometry.box_struct(box, name) for name, box in boxes.items()])
    touched = F.filter(named, lambda b: geometry.touches_box(F.col("geom"), b))
    return parsed.select("uid", "id", F.explode(touched["name"]).alias("box"))
