"""Lookups over point fields, files and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry

from . import spatial

#: Names of coordinate frames and the columns that hold them.
FRAMES = {"pixel": ("x", "y"), "real": ("rx", "ry"), "warped": ("wx", "wy")}


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing value (null or NaN) in ``columns``; an error, when read, if none is left is the caller's."""
    return rows.dropna(subset=columns)


def values_at(fields: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    """``field`` of the points (tp, pt) that ``ids`` lists at one or many times: (tp, pt, field)."""
    return fields.select("tp", "pt", field).join(ids.select("tp", "pt").distinct(), ["tp", "pt"], "left_semi")


def coordinates(points: DataFrame, frame: str) -> DataFrame:
    """Points with the coordinates of a frame by name as x and y; unknown names are an error."""
    if frame not in FRAMES:
        raise ValueError(f"no coordinate frame {frame}")
    x, y = FRAMES[frame]
    return points.select(*[c for c in points.columns if c not in sum(FRAMES.values(), ())], F.col(x).alias("x"), F.col(y).alias("y"))


def points_in(points: DataFrame, vertices: tuple[tuple[float, float], ...]) -> DataFrame:
    """Points inside a polygon, which is first widened by 1e-5 about its centroid. A box filter goes first and reaches the scan."""
    xs, ys = zip(*vertices, strict=True)
    pad = 1e-4 * max(max(xs) - min(xs), max(ys) - min(ys))
    near = points.filter(F.col("x").between(min(xs) - pad, max(xs) + pad) & F.col("y").between(min(ys) - pad, max(ys) + pad))
    return near.filter(geometry.contains(geometry.scale(geometry.polygon(*vertices), 1 + 1e-5), F.col("x"), F.col("y")))


def tracks_in(points: DataFrame, vertices: tuple[tuple[float, float], ...], first: int | None = None, last: int | None = None) -> DataFrame:
    """Tracks with a point in the polygon at the times from ``first`` to ``last``, once each."""
    for bound, keep in ((first, lambda b: F.col("tp") >= b), (last, lambda b: F.col("tp") <= b)):
        if bound is not None:
            points = points.filter(keep(bound))
    return points_in(points, vertices).select("track").distinct()


def point_tracks(track_points: DataFrame, points: DataFrame) -> DataFrame:
    """The track of each point (tp, pt); points of no track have none."""
    return points.join(track_points.select("tp", "pt", "track"), ["tp", "pt"], "left")


def neighbours_over_time(near: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track, near): tracks that are neighbours at any time, from point neighbours (tp, pt, near) and (tp, pt, track)."""
    own = tracks.select("tp", "pt", "track")
    rows = near.join(own, ["tp", "pt"]).join(own.toDF("tp", "near", "other"), ["tp", "near"])
    return rows.filter("track <> other").select("track", F.col("other").alias("near")).distinct()


def tracks_near(points: DataFrame, radius: float) -> DataFrame:
    """(track, near): tracks with points (tp, track, x, y) of one time within ``radius``, both ways.

    The search carries the tracks, so no pair of points is shuffled again but to tell equal pairs of tracks apart, and these
    go one way only.
    """
    own = points.select("tp", F.col("track").alias("pt"), "x", "y").distinct()
    pairs = spatial.grid_join(own, own, radius).filter("pt1 < pt2").select("pt1", "pt2").distinct()
    way = lambda a, b: F.struct(F.col(a).alias("track"), F.col(b).alias("near"))
    return pairs.select(F.explode(F.array(way("pt1", "pt2"), way("pt2", "pt1"))).alias("e")).select("e.*")


def named(parts: dict[str, Column]) -> Column:
    """Output name of a record: base, tile folder, and stem with channel and three-digit time."""
    return F.format_string("%s/tile%02d/%s-t%03d.%s", *[parts[k] for k in ("base", "tile", "channel", "timepoint", "ext")])


def clean_channel(name: Column) -> Column:
    """Upper case without separators."""
    return F.regexp_replace(F.upper(name), r"[\s_.-]+", "")


def canonical(rows: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """``channel``: the canonical name of the cleaned ``column`` by a table of aliases, itself where it has none."""
    table = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    return rows.withColumn("channel", F.coalesce(table[clean_channel(F.col(column))], clean_channel(F.col(column))))


def detector_spec(spec: Column) -> dict[str, Column]:
    """Name, run and iterations of ``name-rN-Mk`` or ``name-rN-Mm``; no run is 0."""
    field = lambda i: F.regexp_extract(spec, r"^(.*?)-r(\d+)-(\d+)([kmKM]?)$", i)
    unit = F.when(F.lower(field(4)) == "k", 1000).when(F.lower(field(4)) == "m", 1_000_000).otherwise(1)
    return {"detector": F.when(field(1) != "", field(1)).otherwise(spec), "run": F.when(field(2) != "", field(2).cast("long")).otherwise(F.lit(0)), "iterations": F.when(field(3) != "", field(3).cast("long") * unit).otherwise(F.lit(0))}


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number; a catalog must have none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def file_groups(files: DataFrame, keys: list[str], order: str, path: str) -> DataFrame:
    """Members of each key in order, with their number: (keys, n, first, last). Members of one key never meet in a task as a list."""
    key = F.struct(order, path)
    return files.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(path, key).alias("first"), F.max_by(path, key).alias("last"))


def complete_tiles(files: DataFrame, tile: str, channel: str, channels: int) -> DataFrame:
    """Tiles that all channels have."""
    return files.groupBy(tile).agg(F.count_distinct(channel).alias("n")).filter(F.col("n") == channels).select(tile)


def detector_groups(outputs: DataFrame, keys: list[str], detector: str, least: int) -> DataFrame:
    """Keys with the outputs of at least ``least`` detectors: (keys, detectors in order, number of outputs)."""
    rows = outputs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(detector)), ",").alias("detectors"), F.count_distinct(detector).alias("n_detectors"), F.count("*").alias("n"))
    return rows.filter(F.col("n_detectors") >= least).drop("n_detectors")


def replica_links(rows: DataFrame, keys: list[str], order: str, item: str) -> DataFrame:
    """The first item of each key with each of the others: (keys, reference, item)."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(order, item)).alias("m")).select(*keys, F.col(f"m.{item}").alias("reference"))
    return rows.join(first, keys).filter(F.col(item) != F.col("reference")).select(*keys, "reference", item)


def first_by_prefix(files: DataFrame, group: str, name: str, prefix: Column) -> DataFrame:
    """The first name of each group that begins with ``prefix``."""
    return files.filter(F.col(name).startswith(prefix)).groupBy(group).agg(F.min(name).alias("found"))


def unpaired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner; pairing asks for none."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def parsed_box(text: Column) -> Column:
    """Four numbers of ``a,b,c,d`` or ``axbxcxd``; nothing gives (0, 0, -1, -1)."""
    parts = F.split(F.regexp_replace(F.lower(text), r"\s", ""), "[,x]")
    none = F.array(*[F.lit(v) for v in (0, 0, -1, -1)])
    return F.when(text.isNull() | (F.trim(text) == ""), none).otherwise(parts.cast("array<int>"))


def frames_of(minutes: float, scale: float) -> int:
    """Whole frames that cover ``minutes``."""
    return -int(-minutes // scale)


def to_pixels(microns: Column, space: float) -> Column:
    return microns / space


#: The forms of image names, in the order in which they are tried, and the places of their fields' groups.
NAME_FORMS = (
    (r"^([a-z0-9_ ]+)-(s([0-9]+))?(z([0-9]+))?(t([0-9]+))?(m([0-9]+))?(((InverseWarp)|(Warp)|(Affine)|(_resp))?\.[a-z]+(\.[a-z]+)*)$", {"channel_name": 1, "tile": 3, "slice": 5, "timepoint": 7, "multi_tile": 9, "suffix": 10}),
    (r"^([a-z0-9-\. ]+)_s([0-9]+)t([0-9]+)([a-z][a-z0-9 _+-]+?)?(_ORG)?(((InverseWarp)|(Warp)|(Affine))?\.[a-z]+(\.[a-z]+)*)$", {"prefix": 1, "tile": 2, "timepoint": 3, "channel": 4, "suffix": 6}),
    (r"^([a-z0-9-\. ]+)_s([0-9]+)t([0-9]+)_([a-z][a-z0-9 _+-]+)_ORG(((InverseWarp)|(Warp)|(Affine))?\.[a-z]+(\.[a-z]+)*)$", {"prefix": 1, "tile": 2, "timepoint": 3, "channel_name": 4, "suffix": 5}),
    (r"^([a-z0-9-\. ]+)-([0-9]+)_s([0-9]+)(c([0-9]+))?(_ORG)?(\.tif)$", {"prefix": 1, "timepoint": 2, "tile": 3, "channel": 5, "suffix": 7}),
    (r"^([a-z0-9_ ]+)-s([0-9]+)t([0-9]+)(((InverseWarp)|(Warp)|(Affine)|(_resp))?\.[a-z]+(\.[a-z]+)*)$", {"channel_name": 1, "tile": 2, "timepoint": 3, "suffix": 4}),
)
#: Names of channels by number.
CHANNELS = {1: "TL Brightfield", 2: "mCherry", 3: "EGFP", 4: "mKate"}


def parsed_name(name: Column) -> dict[str, Column]:
    """Fields of an image's name by the first of NAME_FORMS that it has; all are null if it has none.

    Numbers that are missing are 0. A channel without a name or number is 1, as is one whose name isn't in CHANNELS; one without digits where a number stands is null;
    ``key`` is the tile with the channel's name.
    """
    fits = [name.rlike("(?i)" + form) for form, _ in NAME_FORMS]

    def field(key: str) -> Column:
        out = F.lit(None).cast("string")
        for fit, (form, places) in reversed(list(zip(fits, NAME_FORMS, strict=True))):
            out = F.when(fit, F.nullif(F.regexp_extract(name, "(?i)" + form, places[key]), F.lit("")) if key in places else F.lit(None)).otherwise(out)
        return out

    known = F.coalesce(*[F.when(fit, F.lit(True)) for fit in fits])
    number = lambda key: F.when(known, F.coalesce(field(key).cast("int"), F.lit(0)))
    by_number = F.create_map(*[F.lit(v) for pair in CHANNELS.items() for v in pair])
    by_name = F.create_map(*[F.lit(v) for k, n in CHANNELS.items() for v in (n.lower(), k)])
    raw, said = field("channel"), field("channel_name")
    told = F.regexp_extract(raw, r"([0-9]+)$", 1).try_cast("int")
    titled = raw.contains("_")
    title = F.when(titled, F.regexp_extract(raw, r"^(.*)_[^_]*$", 1))
    channel = F.when(raw.isNotNull(), told).otherwise(F.coalesce(by_name[F.lower(said)], F.lit(1)))
    label = F.when(raw.isNotNull(), F.when(titled, title).otherwise(F.coalesce(by_number[told], told.cast("string")))).otherwise(F.coalesce(said, F.lit(CHANNELS[1])))
    slug = F.lower(F.regexp_replace(label, "[^A-Za-z0-9]+", "_"))
    out = {k: number(k) for k in ("tile", "timepoint", "slice", "multi_tile")}
    out |= {"channel": F.when(known, channel), "channel_name": F.when(known, label), "key": F.when(known, F.concat(number("tile").cast("string"), F.lit("-"), slug))}
    return out


def detector_settings(table: DataFrame, column: str, value: str) -> dict:
    """The one row of a table of detector settings with ``value`` in ``column`` (microscope, training set); none or several are an error."""
    found = table.filter(F.col(column) == value).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{len(found)} settings for {column} {value}")
    return found[0].asDict()


def above_thresholds(points: DataFrame, thresholds: DataFrame, detector: str, score: str) -> DataFrame:
    """Points that reach their detector's ``threshold``, with its ``weight``; names agree in lower case; points of other detectors go."""
    table = thresholds.select(F.lower(detector).alias("_detector"), "threshold", "weight")
    return points.join(table, F.lower(detector) == F.col("_detector")).filter(F.col(score) >= F.col("threshold")).drop("_detector")


#: Types that have no plain form.
OPAQUE = ("binary", "void", "interval", "variant")


def as_json(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, json): the columns of each row as one JSON object, keys of maps as text, missing values left out; a column that holds a type without a plain form is an error."""
    for c in columns:
        kind = rows.schema[c].dataType.simpleString()
        if any(name in kind for name in OPAQUE):
            raise TypeError(f"{c} of type {kind} has no plain form")
    return rows.select(key, F.to_json(F.struct(*columns)).alias("json"))
