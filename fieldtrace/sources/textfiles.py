"""Text files of points and tracks. ``#`` starts a comment, blank lines are skipped; ``file`` is the file's path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header of point files.
POINT_HEADER = "#point_x,point_y,point_score"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, score), one point a line; a line without three numbers is an error."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim(F.split("value", "#")[0]).alias("line")).filter("line <> ''")
    parts = F.split("line", r"\s*,\s*")
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three values: "), F.col("line"))).cast("array<string>"))
    return rows.withColumn("p", checked).select("file", *[F.col("p")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "score"))])


def write_points(points: DataFrame, path: str, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None) -> None:
    """Points inside the ranges (ends included; None: all), six decimals, each part with the header."""
    for c, bounds in (("x", x_range), ("y", y_range)):
        if bounds is not None:
            points = points.filter(F.col(c).between(*bounds))
    names = dict(zip(("x", "y", "score"), POINT_HEADER.split(","), strict=True))
    # The writer would quote a name that starts with the comment sign, so that is set to another one.
    points.select(*[F.format_string("%.6f", c).alias(n) for c, n in names.items()]).write.option("header", True).option("comment", "~").csv(path)


def read_tracks(spark: SparkSession, path: str, min_len: int = 0) -> DataFrame:
    """(file, track, tp, t, x, y) from blocks of a ``Track`` line and the lines of t, x and y; shorter tracks are left out."""
    text = F.regexp_replace("value", r"#[^\n]*", "")
    blocks = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(text, r"(?m)^\s*Track[^\n]*$")).alias("k", "block")).filter("k > 0")
    lines = F.filter(F.transform(F.split("block", "\n"), lambda line: F.trim(line)), lambda line: line != "")
    rows = blocks.select("file", (F.col("k") - 1).alias("track"), lines.alias("lines")).filter(F.size("lines") >= 3)
    t, x, y = (F.transform(F.split(F.col("lines")[i], ","), lambda v: F.trim(v).cast("double")) for i in range(3))
    sound = (F.size("lines") == 3) & (F.size(t) == F.size(x)) & (F.size(t) == F.size(y))
    zipped = F.when(sound, F.arrays_zip(t.alias("t"), x.alias("x"), y.alias("y"))).otherwise(F.raise_error(F.concat(F.lit("broken track in "), F.col("file"))))
    rows = rows.filter(F.size(t) >= min_len).select("file", "track", F.posexplode(zipped).alias("tp", "p"))
    return rows.select("file", "track", "tp", F.col("p.t").cast("int").alias("t"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def write_tracks(points: DataFrame, path: str) -> None:
    """One block a track: whole times, four decimals of x and y, in order of time."""
    rows = points.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p"))
    line = lambda form, c: F.array_join(F.transform("p", lambda p: F.format_string(form, p[c])), ",")
    times = F.array_join(F.transform("p", lambda p: p["t"].cast("long").cast("string")), ",")
    rows.orderBy("track").select(F.concat_ws("\n", F.format_string("Track%03d", "track"), times, line("%.4f", "x"), line("%.4f", "y"))).write.text(path)


def read_simulation(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, track, x, y) of tab-separated simulation files; the first line of each is its header. A line without seven fields, or without a number first, is an error."""
    line = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"), "value")
    heads = rows.groupBy("file").agg(F.min("line").alias("head"))
    rows = rows.join(heads, "file").filter(F.trim("value") != "")
    parts = F.split("value", "\t")
    rows = rows.withColumn("p", F.when(F.size(parts) == 7, parts).otherwise(F.raise_error(F.concat(F.lit("not seven fields: "), F.col("value"))).cast("array<string>")))
    rows = rows.filter((F.col("line") != F.col("head")) | F.col("p").isNull())  # a header's fields are counted too
    number = F.coalesce(F.expr("try_cast(p[0] as double)"), F.raise_error(F.concat(F.lit("no number first: "), F.col("value"))).cast("double"))
    return rows.withColumn("t", number).select("file", "t", F.col("p")[1].cast("long").alias("track"), F.col("p")[2].cast("double").alias("x"), F.col("p")[3].cast("double").alias("y"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, number) from a JSON object of lists of files by split; number is the last one in a file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("split", "files"))
    name = F.element_at(F.split("file", "/"), -1)
    return raw.select("split", F.explode("files").alias("file")).withColumn("number", F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("long"))


def write_splits(splits: DataFrame, path: str) -> None:
    """One JSON row (split, file) a member, which any reader of JSON lines takes; parts are written by the tasks."""
    splits.select("split", "file").write.json(path)


def outside(splits: DataFrame, folder: str) -> DataFrame:
    """Members of each split that do not lie under ``folder``: (split, n)."""
    return splits.filter(~F.col("file").startswith(folder.rstrip("/") + "/")).groupBy("split").agg(F.count("*").alias("n"))


def read_index(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A sample index with a header line; a key that two rows have is an error."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    twice = rows.groupBy(*keys).count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"keys of several rows: {[tuple(r) for r in twice.limit(3).collect()]}")
    return rows


def write_table(table: DataFrame, path: str, suffix: str = "") -> None:
    """A summary table as CSV with a header; companions of one table differ by ``suffix`` (``_dist``, ``_sig``)."""
    table.write.option("header", True).csv(path + suffix)


def write_curve(curve: DataFrame, path: str, metadata: dict[str, str] | None = None, plot_only: bool = False) -> None:
    """A score curve as JSON rows under ``path``/curve and its metadata under ``path``/metadata; ``plot_only`` keeps score, tpr, fpr and precision."""
    kept = [c for c in curve.columns if not plot_only or c in ("score", "tpr", "fpr", "precision")]
    curve.select(*kept).write.json(f"{path}/curve")
    rows = [(k, str(v)) for k, v in sorted((metadata or {}).items())]
    curve.sparkSession.createDataFrame(rows, "name string, value string").write.json(f"{path}/metadata")


def read_curve(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The curve and the (name, value) rows of its metadata. Columns that were dropped are null."""
    schema = "score double, tp long, fp long, tpr double, fpr double, precision double"
    return spark.read.schema(schema).json(f"{path}/curve"), spark.read.schema("name string, value string").json(f"{path}/metadata")
