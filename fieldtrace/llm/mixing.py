"""Mixing sources to target weights with Sainte-Laguë apportionment, in DataFrame operations alone.

The mix is cut to blocks of equal tokens. Blocks are seats: they go to sources by the highest quotients
target / (2k - 1), and a source's seats go to its shards in the same way by shard size. A shard's quota
is then met by whole passes over its documents and by blocks of its words that a seeded permutation picks.
Only per-source and per-shard sums meet in small tables; documents are windowed within shards, so a hot source is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, n_words, text_or_empty

#: Weights by place in code-point order of sources; share of all sizes; most passes over a document.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2
#: Words of a block; documents of a shard, about; seed of the order in a shard.
BLOCK, SHARD_DOCS, SEED = 64, 1024, 17
#: Strides of the permutations of blocks: primes, more than any shard has blocks. Most sources that are broadcast.
STRIDES, FEW = (1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033), 10_000


def targets(sizes: DataFrame, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes by weight; a target stops at ``passes``
    times its source's size and the excess goes to the others by weight until none is above.

    Capped sources are those first in order of cap by weight: one running sum over the sources finds the
    level at which the rest is shared. Only the table of sources is in one task.
    """
    everyone = Window.partitionBy()
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * float(passes)).withColumn("total", F.sum("source_size").over(everyone) * share)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    #: The first source, in that order, whose level is under its own ratio is the first without a cap.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everyone)["level"]
    rows = rows.withColumn("shared", level)
    return rows.withColumn("target", F.when(F.col("shared").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("shared") * F.col("weight")))).select("source", "source_size", "target")


def seats(rows: DataFrame, group: list[str], votes: Column, places: Column) -> DataFrame:
    """Sainte-Laguë seats of each row among the rows of its group, in column ``seats``.

    A row's fair share is bounded below and above by what the divisor can shift, so only seats between
    these bounds compete by quotient; the rest are sure. Ties go to the first by ``tie``.
    """
    own = Window.partitionBy(*group)
    rows = rows.withColumn("_votes", votes.cast("double")).withColumn("_places", places.cast("long"))
    rows = rows.withColumn("_n", F.count("*").over(own)).withColumn("_all", F.sum("_votes").over(own))
    fair = F.when(F.col("_all") > 0, F.col("_places") * F.col("_votes") / F.col("_all")).otherwise(F.lit(0.0))
    shift = F.col("_n") / (2 * F.greatest("_places", F.lit(1)))
    #: Seats are votes / divisor, rounded; n roundings move the sum by n / 2 at most, and so the divisor by that share.
    rows = rows.withColumn("_fair", fair).withColumn("_shift", shift)
    rows = rows.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_fair") * (1 - F.col("_shift")) - 1)).cast("long"))
    rows = rows.withColumn("_high", F.least(F.col("_places"), F.ceil(F.col("_fair") * (1 + F.col("_shift")) + 1).cast("long")))
    rows = rows.withColumn("_rest", F.col("_places") - F.sum("_low").over(own))
    open_ = rows.filter("_high > _low and _votes > 0").select(*group, "tie", "_votes", "_rest", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    rank = Window.partitionBy(*group).orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") - 1)), "tie", "_k")
    won = open_.withColumn("_r", F.row_number().over(rank)).filter("_r <= _rest").groupBy("tie").agg(F.count("*").alias("_won"))
    return rows.join(won, "tie", "left").withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_votes", "_places", "_n", "_all", "_fair", "_shift", "_low", "_high", "_rest", "_won")


def _label() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def taken(docs: DataFrame, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The rows with source_size, target, whole (passes over all words), picks (word ranges ``at``, ``n`` of one more pass) and taken.

    ``docs`` has doc_id, source and size. Null sources are a source of their own, the last. Repeated rows are
    documents of their own. Rows of size 0 take nothing. An empty table gives no rows.
    """
    docs = cut(docs)
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sources.select("source", "source_size"), share, passes).withColumn("tie", _label())
    goal = goal.join(sources.select(_label().alias("tie"), F.greatest(F.ceil(F.col("n") / SHARD_DOCS), F.lit(1)).cast("long").alias("shards")), "tie")
    total = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")
    goal = seats(goal.withColumn("places", total), ["places"], F.col("target"), F.col("places"))
    goal = cut(goal.select(F.col("tie").alias("label"), "source_size", "target", "shards", F.col("seats").alias("source_seats")))
    if goal.count() <= FEW:
        goal = F.broadcast(goal)
    rows = docs.withColumn("label", _label()).join(goal, "label").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("shards")))
    shards = rows.groupBy("label", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("source_seats"))
    shards = shards.withColumn("tie", F.concat_ws("/", F.lpad(F.col("shard").cast("string"), 12, "0"), "label"))
    quota = seats(shards, ["label"], F.col("shard_size"), F.col("source_seats")).select("label", "shard", "shard_size", F.least(F.col("seats") * BLOCK, F.col("shard_size") * passes).alias("quota"))
    rows = rows.join(quota, ["label", "shard"])
    order = Window.partitionBy("label", "shard").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("whole", F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    blocks = F.ceil(F.col("shard_size") / BLOCK).cast("long")
    draw = lambda n, seed: F.pmod(F.xxhash64("label", "shard", F.lit(seed)), n)
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (draw(F.lit(len(STRIDES)), SEED + 2) + 1).cast("int"))
    most = F.round((F.col("quota") - F.col("whole") * F.col("shard_size")) / BLOCK)
    chosen = F.filter(F.sequence(F.floor(F.col("before") / BLOCK), F.floor((F.col("before") + F.col("size") - 1) / BLOCK)), lambda b: F.pmod(b * stride + draw(blocks, SEED + 3), blocks) < most)
    start = lambda b: F.greatest(b * BLOCK - F.col("before"), F.lit(0)).cast("long")
    ranges = F.transform(chosen, lambda b: F.struct(start(b).alias("at"), (F.least((b + 1) * BLOCK - F.col("before"), F.col("size")) - start(b)).cast("long").alias("n")))
    rows = rows.withColumn("picks", F.when((F.col("size") > 0) & (most > 0), ranges).otherwise(F.array().cast("array<struct<at:bigint,n:bigint>>")))
    picked = F.aggregate("picks", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + picked)
    return rows.drop("label", "shard", "shards", "source_seats", "shard_size", "quota", "before")


def mix_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of documents.

    Null texts have size 0 and texts of any length their whole one; a null doc_id is kept; other columns aren't read; the rest is as in ``taken``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"))
    return taken(rows).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: a document as often as it is taken whole, then one copy of the blocks that are picked of it.

    Columns are those of ``docs``, of any name. The last copy keeps the blanks and line breaks before its words. Null and
    empty texts take nothing and go; rows with equal id, source and size are alike to the plan and numbered by text;
    a text of any length is one row; an empty table gives no rows.
    """
    size = n_words(text_or_empty())
    plan = taken(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))).filter("taken > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "whole", "picks"))).alias("plans")).toDF("i", "s", "z", "plans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    once, many = rows.filter("size(plans) = 1").withColumn("k", F.lit(1)), rows.filter("size(plans) > 1")
    many = many.withColumn("k", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("text")))
    rows = once.unionByName(many).filter("k <= size(plans)").withColumn("plan", F.element_at("plans", F.col("k")))
    full = F.col("plan.whole") + (F.col("plan.taken") - F.col("plan.whole") * F.col("size") == F.col("size")).cast("int")
    rest = F.when(F.col("plan.taken") > full * F.col("size"), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    rows = rows.withColumn("part", F.explode(F.concat(F.array_repeat(F.lit(False), full.cast("int")), rest)))
    text = F.when(~F.col("part"), F.col("text")).otherwise(_picked(F.col("text"), F.col("plan.picks")))
    return rows.select(*[text.cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _picked(text: Column, picks: Column) -> Column:
    """The words of the ranges, each with the blanks before it."""
    words = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1)
    some = F.flatten(F.transform(picks, lambda p: F.slice(words, (p["at"] + 1).cast("int"), p["n"].cast("int"))))
    return F.regexp_replace(F.array_join(some, ""), r"^[\x20\x09-\x0D]+", "")
