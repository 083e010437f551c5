"""Bootstrap intervals of statistics made of weighted sums or of weighted order, for groups of any size.

A resample gives each distinct value a Poisson weight with its number of copies as mean: the sum of its copies'
weights. Weights are a function of (seed, group, value, resample) alone, so they can be drawn again wherever they are
needed. Values are dealt to stretches; a stretch sends one array of sums over the resamples, and a quantile is then
looked up in the one stretch in which a resample's cumulative weight passes its rank.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .written import written

#: Values in a block, and drawn at a time; copies up to which weights come from the table of the distribution; values that make stretches worth it.
BLOCK, FEW, TABLED, FEW_VALUES = 512, 16, 4096, 4096
#: Values of a group that are summed by one task.
PIECE = 1 << 15
#: Fixed values of a 64-bit mixing function: step between resamples, and its two factors.
STEP, FACTORS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Sums(NamedTuple):
    """A statistic of weighted sums: ``parts`` makes columns of the value, ``value`` the statistic of the weight's and the parts' sums."""

    parts: Callable[[Column], list[Column]]
    value: Callable[..., Column]


class Quantile(NamedTuple):
    """The value at a share of a sample's order, between two values in proportion."""

    share: float


MEAN = Sums(lambda v: [v], lambda w, s: s / w)
DEVIATION = Sums(lambda v: [v, v * v], lambda w, s, q: F.sqrt(F.greatest(q / w - (s / w) * (s / w), F.lit(0.0))))
MEDIAN = Quantile(0.5)


@lru_cache(256)
def distribution(mean: int) -> np.ndarray:
    """Cumulative Poisson probabilities from 0 up to where they are 1."""
    k = np.arange(1, mean + int(12 * mean**0.5) + 20)
    return np.cumsum(np.exp(-mean + np.concatenate([[0.0], np.cumsum(np.log(mean / k))])))


@lru_cache(64)
def guide(mean: int) -> np.ndarray:
    """The draw by the first 16 bits of a number in [0, 1), or -1 where these leave it open."""
    edge = np.arange((1 << 16) + 1) / (1 << 16)
    low, high = np.searchsorted(distribution(mean), edge[:-1], "right"), np.searchsorted(distribution(mean), edge[1:], "left")
    return np.where(low == high, low, -1).astype(np.int16)


class Room(NamedTuple):
    """Arrays that are filled again and again: new ones of this size cost more than the draws in them."""

    x: np.ndarray
    y: np.ndarray
    drawn: np.ndarray
    out: np.ndarray


def room(boots: int, rows: int) -> Room:
    return Room(*[np.empty((FEW, boots), kind) for kind in (np.uint64, np.uint64, np.int16)], np.empty((rows, boots + 1), np.int64))


def _mixed(key: np.ndarray, boots: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x`` filled with 64 mixed bits by key and resample, from 1; ``y`` is scratch."""
    np.add(np.arange(1, boots + 1, dtype=np.uint64)[None] * np.uint64(STEP), key.astype(np.uint64)[:, None], out=x)
    for shift, factor in ((30, FACTORS[0]), (27, FACTORS[1]), (31, None)):
        np.right_shift(x, np.uint64(shift), out=y)
        np.bitwise_xor(x, y, out=x)
        if factor:
            np.multiply(x, np.uint64(factor), out=x)
    return x


def uniform(key: np.ndarray, boots: int) -> np.ndarray:
    """Numbers in [0, 1) by key and resample, from 1."""
    x, y = np.empty((2, len(key), boots), np.uint64)
    return (_mixed(key, boots, x, y) >> np.uint64(11)) * 2.0**-53


def weights(key: np.ndarray, copies: np.ndarray, boots: int, held: Room | None = None) -> np.ndarray:
    """Weights by value and resample; column 0 is the sample itself. A few values at a time, so that they stay in the cache; of ``held`` the result is a part."""
    held = held or room(boots, len(key))
    out = held.out[: len(key)]
    out[:, 0] = copies
    order = np.argsort(copies, kind="stable")
    order = order[: np.searchsorted(copies[order], TABLED, "right")]
    for a in range(0, len(order), FEW):
        some = order[a : a + FEW]
        x, y, drawn, n = *(h[: len(some)] for h in held[:3]), copies[some]
        _mixed(key[some], boots, x, y)
        at = np.right_shift(x, np.uint64(48), out=y).view(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            np.take(guide(int(n[i])), at[i:j], out=drawn[i:j], mode="clip")
            if drawn[i:j].min(initial=0) < 0:
                left = drawn[i:j] < 0
                drawn[i:j][left] = np.searchsorted(distribution(int(n[i])), (x[i:j][left] >> np.uint64(11)) * 2.0**-53, "right")
        out[some, 1:] = drawn
    for i in np.flatnonzero(copies > TABLED).tolist():
        out[i, 1:] = np.random.Generator(np.random.Philox(int(key[i]))).poisson(copies[i], boots)
    return out


def _blocks(table: pa.Table, boots: int, parts: int):
    """(values, their parts, weights) in order of value; the weights hold until the next block."""
    table, held = table.sort_by("_v"), room(boots, min(BLOCK, table.num_rows))
    for a in range(0, table.num_rows, BLOCK):
        part = table.slice(a, BLOCK)
        column = lambda c: part.column(c).to_numpy()  # noqa: E731, B023
        yield column("_v"), [column(f"_p{i}") for i in range(parts)], weights(column("_key"), column("_n"), boots, held)


def _head(table: pa.Table, keys: list[str], n: int) -> dict[str, pa.ChunkedArray]:
    return {k: pa.concat_arrays(table.column(k).slice(0, 1).chunks).take(pa.array([0] * n)) for k in keys}


def _keys(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def _looked_up(counted: DataFrame, sums: DataFrame, keys: list[str], share: float, boots: int) -> DataFrame:
    """(keys, boot, value): the quantile of each resample."""

    def asked(table: pa.Table) -> pa.Table:
        """Which stretch holds each resample's two ranks, and where in it."""
        table = table.sort_by("_a")
        total = np.array(table.column("_w").to_pylist(), np.int64)
        before = np.vstack([np.zeros((1, boots + 1), np.int64), np.cumsum(total, 0)])
        place = share * (before[-1] - 1)
        low = np.floor(place).astype(np.int64)
        part = place - low
        out = []
        for which, rank in enumerate((low + 1, np.minimum(low + 2, before[-1]))):
            some = np.flatnonzero(before[-1] > 0)
            at = (before[1:, some] < rank[some]).sum(0)
            out.append((table.column("_a").to_numpy()[at], some, np.full(len(some), which), rank[some] - before[at, some], part[some]))
        a, boot, which, rank, part = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table(_head(table, keys, len(a)) | {"_a": a.astype(np.int32), "boot": boot.astype(np.int32), "which": which.astype(np.int32), "rank": rank, "part": part})

    def found(rows: pa.Table, asks: pa.Table) -> pa.Table:
        boot, rank = (asks.column(c).to_numpy() for c in ("boot", "rank"))
        value, past = np.zeros(len(boot)), np.zeros(boots + 1, np.int64)
        if len(boot):
            for v, _, w in _blocks(rows, boots, 0):
                cumulated = np.cumsum(w, 0)
                here = np.flatnonzero((past[boot] < rank) & (rank <= past[boot] + cumulated[-1, boot]))
                value[here] = v[(cumulated[:, boot[here]] < rank[here] - past[boot[here]]).sum(0)]
                past = past + cumulated[-1]
        head = _head(asks, keys, len(boot)) if len(boot) else {k: pa.array([], rows.schema.field(k).type) for k in keys}
        return pa.table(head | {"boot": boot, "which": asks.column("which"), "value": value, "part": asks.column("part")})

    named = _keys(counted, keys)
    asks = written(sums.groupBy(*keys).applyInArrow(asked, f"{named}_a int, boot int, which int, rank long, part double"))
    near = asks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_a").alias("_at")).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    some = counted.join(near, same & (F.col("_a") == F.col("_at")), "left_semi")
    ends = some.groupBy(*keys, "_a").cogroup(asks.groupBy(*keys, "_a")).applyInArrow(found, f"{named}boot int, which int, value double, part double")
    at = lambda i: F.max(F.when(F.col("which") == i, F.col("value")))
    ends = ends.groupBy(*keys, "boot").agg(at(0).alias("a"), at(1).alias("b"), F.first("part").alias("part"))
    return ends.select(*keys, "boot", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def bootstrap(rows: DataFrame, by: list[str], score: str, statistic: Sums | Quantile = MEAN, seed: str = "0", boots: int = 1000, ci: float = 0.95) -> DataFrame:
    """``centre`` (the statistic of the rows), ``lo`` and ``hi`` (its percentiles over ``boots`` resamples) and ``n`` of each group of ``by``.

    Null scores don't count and a group of only these has no row; below three scores there are no bounds; null keys are a
    group; reruns agree. Of a group only one array a stretch of values, of ``boots`` numbers, meets in a task.
    """
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    own = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("_g0")]
    rows = rows.select(*own, F.col(f"`{score}`").cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    digest = F.md5(F.concat_ws("/", F.lit(seed), *[F.col(k).cast("string") for k in keys[: len(by)]], F.col("_v").cast("string")))
    parts = statistic.parts(F.col("_v")) if isinstance(statistic, Sums) else []
    n_parts = len(parts)
    counted = written(counted.select("*", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_key"), *[p.cast("double").alias(f"_p{i}") for i, p in enumerate(parts)]))
    if isinstance(statistic, Quantile):
        edges = ranks.bounds(counted, "_v") if counted.count() > FEW_VALUES else []
        counted = counted.withColumn("_a", ranks.stretch("_v", edges).cast("int"))
    else:
        #: Sums need no order, so only a group of many values is cut up: arrays grow with groups and values, not with groups times stretches.
        sizes = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_size"))
        counted = counted.join(sizes, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])
        counted = counted.withColumn("_a", F.pmod("_key", F.ceil(F.col("_size") / PIECE)).cast("int")).drop("_size")

    def summed(table: pa.Table) -> pa.Table:
        total, sums, real = np.zeros(boots + 1, np.int64), np.zeros((n_parts, boots + 1)), np.empty((BLOCK, boots + 1))
        for _, values, w in _blocks(table, boots, n_parts):
            total += w.sum(0)
            real[: len(w)] = w
            for i, v in enumerate(values):
                sums[i] += v @ real[: len(w)]
        columns = {f"_s{i}": pa.array([s], pa.list_(pa.float64())) for i, s in enumerate(sums)}
        return pa.table(_head(table, [*keys, "_a"], 1) | {"_w": pa.array([total], pa.list_(pa.int64()))} | columns)

    arrays = ["_w", *(f"_s{i}" for i in range(len(parts)))]
    named = _keys(counted, keys)
    sums = counted.groupBy(*keys, "_a").applyInArrow(summed, f"{named}_a int, _w array<bigint>{''.join(f', {s} array<double>' for s in arrays[1:])}")
    if isinstance(statistic, Quantile):
        values = _looked_up(counted, written(sums), keys, statistic.share, boots)
    else:
        each = sums.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("boot", "s")).groupBy(*keys, "boot").agg(*[F.sum(f"s.{c}").alias(c) for c in arrays])
        values = each.filter("_w > 0").select(*keys, "boot", statistic.value(*[F.col(c) for c in arrays]).alias("value"))
    drawn = F.when(F.col("boot") > 0, F.col("value"))
    out = values.groupBy(*keys).agg(F.max(F.when(F.col("boot") == 0, F.col("value"))).alias("centre"), F.percentile(drawn, [(1 - ci) / 2, (1 + ci) / 2]).alias("p"))
    size = counted.groupBy(*keys).agg(F.sum("_n").alias("n")).select(*[F.col(k).alias(f"_{k}") for k in keys], "n")
    out = out.join(size, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    bound = lambda i: F.when(F.col("n") >= 3, F.col("p")[i])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "centre", bound(0).alias("lo"), bound(1).alias("hi"), "n")
