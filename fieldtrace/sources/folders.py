"""Catalogs of image files in folders: names, lengths and times alone are read, never contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.operators import lookups

#: Endings of image files.
SUFFIXES = (".tif", ".jpg", ".png")
#: What makes a record's key, and what orders its members.
KEYS, MEMBERS = ("channel_name", "tile", "timepoint"), ("slice", "multi_tile")


def images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, folder, name, stem, suffix, length, modified) of all images under a folder, at any depth.

    Files and folders whose name begins with a dot, and files of other endings, are left out. Any store that Spark reads serves.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    files = files.withColumn("name", F.element_at(parts, -1)).withColumn("folder", F.element_at(parts, -2))
    inside = F.substring("path", F.length(F.lit(folder.rstrip("/").split("/")[-1])) + F.instr(F.col("path"), folder.rstrip("/").split("/")[-1]), 1 << 20)
    files = files.filter(~F.exists(F.split(inside, "/"), lambda p: p.startswith(".")))
    suffix = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes)).select("path", "folder", "name", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), "suffix", "length", "modified")


def records(files: DataFrame, channel: str | None = None, any_name: bool = False) -> DataFrame:
    """The fields of each file's name; files of no known form, and with ``channel`` those of another one, go.

    With ``any_name`` a file's folder is its channel and tile, and its place among the folder's paths its time.
    """
    if any_name:
        place = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
        rows = files.withColumns({"channel_name": F.col("folder"), "tile": F.col("folder"), "timepoint": place, "slice": F.lit(0), "multi_tile": F.lit(0)})
    else:
        fields = lookups.parsed_name(F.col("name"))
        rows = files.withColumns({k: fields[k] for k in (*KEYS, *MEMBERS)}).filter(F.col("channel_name").isNotNull())
    return rows if channel is None else rows.filter(same_channel(F.col("channel_name"), F.lit(channel)))


def same_channel(a, b):
    """Whether two names are one channel: equal without case and separators."""
    return lookups.clean_channel(a) == lookups.clean_channel(b)


def catalog(files: DataFrame, channel: str | None = None, any_name: bool = False, keys: tuple[str, ...] = KEYS, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """(keys, suffix, n, members): one row a record, its members as structs of ``members`` and path in their order.

    Two files with the same key and member are a KeyError that names one of them.
    """
    rows = records(files, channel, any_name)
    twice = rows.groupBy(*keys, *members).agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b")).filter("n > 1").limit(1).collect()
    if twice:
        raise KeyError(f"{twice[0].n} files of one record, among them {twice[0].a} and {twice[0].b}")
    own = F.array_sort(F.collect_list(F.struct(*members, "path", "suffix")))
    out = rows.groupBy(*keys).agg(own.alias("members"))
    return out.select(*keys, F.col("members")[0]["suffix"].alias("suffix"), F.size("members").alias("n"), "members")


def training_images(files: DataFrame) -> DataFrame:
    """Images of cells that were drawn for training."""
    return files.filter(F.col("name").endswith("cell.png"))


def training_masks(files: DataFrame) -> DataFrame:
    """(key, path): masks of marked points, by the stem of the image that they belong to."""
    return files.filter(F.col("name").endswith("dots.png")).select(F.replace(F.col("stem"), F.lit("dots"), F.lit("cell")).alias("key"), "path")


def with_mask(files: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with their mask's path as ``mask``; images without one go, and two masks of one key are a KeyError."""
    twice = masks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise KeyError(f"{twice[0].n} masks of {twice[0].key}")
    return files.join(masks.select(F.col("key").alias("stem"), F.col("path").alias("mask")), "stem")


def tile_folders(files: DataFrame) -> DataFrame:
    """(folder path, tile, n): folders named by a tile's number, with the number of their images."""
    rows = files.withColumn("tile", F.regexp_extract("folder", r"^tile([0-9]+)$", 1)).filter("tile <> ''")
    return rows.groupBy(F.regexp_replace("path", r"/[^/]+$", "").alias("path"), F.col("tile").cast("int").alias("tile")).agg(F.count("*").alias("n"))
