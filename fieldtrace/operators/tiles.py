"""Searches around each point in tiles of a frame: pairs live in NumPy arrays of bounded size only, and are neither shuffled nor sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Side of a tile in radii; pairs that are held at a time.
SIDE, CHUNK = 4, 1 << 19
#: What a bound is widened by, so that no partner is lost to rounding.
SLACK = 1 + 1e-9


def dealt(own: DataFrame, near: DataFrame, radius: float, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: tuple[str, ...] = ("tp",)) -> DataFrame:
    """``f`` of each tile's rows of ``own`` and all rows of ``near`` within ``radius`` of the tile, where there are both; rows have ``by``, x and y, and those without a place are left out."""
    side = SIDE * radius
    known = " AND ".join(["abs(x) < double('infinity')", "abs(y) < double('infinity')", *[f"{c} IS NOT NULL" for c in by]])
    cell = lambda c: F.floor(c / side)
    around = lambda c: F.explode(F.sequence(cell(F.col(c) - radius * SLACK), cell(F.col(c) + radius * SLACK)))
    place = {c: F.col(c).cast("double") for c in "xy"}
    left = own.filter(known).withColumns(place).withColumns({"ti": cell(F.col("x")), "tj": cell(F.col("y"))})
    #: New names: columns that both sides share by lineage are lost on one of them.
    right = near.select(*[F.col(c).alias(c) for c in near.columns]).filter(known).withColumns(place).withColumn("ti", around("x")).withColumn("tj", around("y"))
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    tile = lambda one, two: f(one, two).cast(empty.schema) if one.num_rows and two.num_rows else empty
    return left.groupBy(*by, "ti", "tj").cogroup(right.groupBy(*by, "ti", "tj")).applyInArrow(tile, schema)


def places_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("x").to_numpy(), table.column("y").to_numpy()


def pairs(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(q, p, distance) of all pairs of indices within ``radius``, and of some beyond; those of a q are together and in order, about ``CHUNK`` at a time."""
    if not len(qx) or not len(px):
        return
    high, wide = radius / 2, radius * SLACK
    row = lambda y: np.floor(y / high)
    least = row(py.min())
    own = (row(py) - least).astype(np.int64)
    order = np.lexsort((px, own))
    count, ranks, rows = len(px), np.sort(px), int(own.max()) + 1
    key = own[order] * (count + 1) + np.searchsorted(ranks, px[order])
    first = np.searchsorted(own[order], np.arange(rows))
    filled = np.flatnonzero(np.diff(np.append(first, count)))
    low, top = np.full(rows, np.inf), np.full(rows, -np.inf)
    low[filled], top[filled] = (f.reduceat(py[order], first[filled]) for f in (np.minimum, np.maximum))
    one, two = row(qy - wide) - least, row(qy + wide) - least
    begin, size = [], []
    for k in range(int((two - one).max()) + 1):
        at = one + k
        fits = (at <= two) & (at >= 0) & (at < rows)
        at = np.where(fits, at, 0).astype(np.int64)
        away = np.maximum(0, np.maximum(low[at] - qy, qy - top[at]))
        fits &= away <= wide
        half = np.sqrt(np.maximum(0, wide * wide - np.where(fits, away, 0) ** 2)) + 1e-6 * radius
        a = np.searchsorted(key, at * (count + 1) + np.searchsorted(ranks, qx - half))
        b = np.searchsorted(key, at * (count + 1) + np.searchsorted(ranks, qx + half, "right"))
        begin.append(a)
        size.append(np.where(fits, b - a, 0))
    begin, size = np.stack(begin, 1), np.stack(size, 1)
    total = np.cumsum(size.sum(1))
    start = 0
    while start < len(qx):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CHUNK, "right")))
        n = size[start:stop].ravel()
        p = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[start:stop].ravel(), n)]
        q = np.repeat(np.arange(start, stop), size[start:stop].sum(1))
        if len(q):
            dx, dy = px[p] - qx[q], py[p] - qy[q]
            yield q, p, np.sqrt(dx * dx + dy * dy)
        start = stop


def firsts(q: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)


def added(v: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Sums of stretches of these lengths, each added up in order, as a fold over rows would: a last bit decides a rounded half."""
    return np.bincount(np.repeat(np.arange(len(wide)), wide), v, len(wide))


def closest(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, radius: float, strict: bool = False, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest p of each q, the first of equals, and its distance; -1 where none is within ``radius``. ``but`` is a p that a q may not have.

    It begins with a few points' distance and doubles it for those that find none, so few pairs are met however dense the points are.
    """
    best, dist = np.full(len(qx), -1), np.full(len(qx), np.inf)
    if not len(qx) or not len(px):
        return best, dist
    area = max(np.ptp(px), radius / 8) * max(np.ptp(py), radius / 8)
    reach = min(radius, max(radius / 256, np.sqrt(area / len(px))))
    todo = np.arange(len(qx))
    while len(todo):
        for q, p, d in pairs(qx[todo], qy[todo], px, py, reach):
            if but is not None:
                d = np.where(p == but[todo[q]], np.inf, d)
            at = firsts(q)
            least = np.minimum.reduceat(d, at)
            one = np.minimum.reduceat(np.where(d == np.repeat(least, np.diff(np.append(at, len(q)))), p, len(px)), at)
            mine = todo[q[at]]
            dist[mine], best[mine] = least, one
        if reach >= radius:
            break
        todo = todo[dist[todo] > reach]
        reach = min(radius, 2 * reach)
    none = dist >= radius if strict else dist > radius
    best[none] = -1
    return best, dist


def ordered(table: pa.Table, *names: str) -> pa.Table:
    """The rows in order of columns of any orderable kind."""
    if not any(pa.types.is_nested(table.column(c).type) for c in names):
        return table.sort_by([(c, "ascending") for c in names])
    plain = lambda v: tuple(map(plain, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else v
    values = list(zip(*([plain(v) for v in table.column(c).to_pylist()] for c in names), strict=True))
    return table.take(pa.array(sorted(range(len(values)), key=values.__getitem__), pa.int64()))


def nearest(own: DataFrame, near: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """(tp, pt, x, y, near, nx, ny, dist): for each point of ``own`` the nearest of ``near`` in its frame within ``radius``, of equals the least; points without one have no row."""
    kind = {"own": own.schema["pt"].dataType.simpleString(), "near": near.schema["pt"].dataType.simpleString(), "tp": own.schema["tp"].dataType.simpleString()}
    columns = ["tp", "pt", "x", "y"]

    def tile(one: pa.Table, two: pa.Table) -> pa.Table:
        two = ordered(two, "pt")
        best, dist = closest(*places_of(one), *places_of(two), radius, strict)
        some = np.flatnonzero(best >= 0)
        one, two = one.take(pa.array(some)).select(columns), two.take(pa.array(best[some]))
        return pa.table([*one.columns, two.column("pt"), two.column("x"), two.column("y"), pa.array(dist[some])], names=[*columns, "near", "nx", "ny", "dist"])

    schema = f"tp {kind['tp']}, pt {kind['own']}, x double, y double, near {kind['near']}, nx double, ny double, dist double"
    return dealt(own.select(*columns), near.select(*columns), radius, tile, schema)


def _before(qx: np.ndarray, qy: np.ndarray, t0: np.ndarray, px: np.ndarray, py: np.ndarray, t1: np.ndarray, max_lag: float, radius: float, but: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the p of least lag, then distance, then place for each q, -1 where there is none, with lag and distance."""
    best, lag, dist = np.full(len(qx), -1), np.full(len(qx), np.inf), np.full(len(qx), np.inf)
    times, ends = np.unique(t0), np.unique(t1)
    if len(times) * len(ends) <= 4 + (len(qx) + len(px)) / 8:  # frames: lag by lag
        for time in times:
            mine, lags = np.flatnonzero(t0 == time), time - t1
            for own in np.unique(lags[(lags > 0) & (lags <= max_lag)]):
                there = np.flatnonzero(lags == own)
                place = np.searchsorted(there, but[mine])
                mask = np.where((but[mine] >= 0) & (there[np.minimum(place, len(there) - 1)] == but[mine]), place, -1)
                found, d = closest(qx[mine], qy[mine], px[there], py[there], radius, but=mask)
                some = found >= 0
                best[mine[some]], lag[mine[some]], dist[mine[some]] = there[found[some]], own, d[some]
                mine = mine[~some]
                if not len(mine):
                    break
        return best, lag, dist
    for q, p, d in pairs(qx, qy, px, py, radius):
        own = t0[q] - t1[p]
        fits = (own > 0) & (own <= max_lag) & (d <= radius) & (p != but[q])
        at = firsts(q)
        wide = np.diff(np.append(at, len(q)))
        least = lambda v, at=at: np.minimum.reduceat(v, at)
        own = np.where(fits, own, np.inf)
        low = least(own)
        d = np.where(own == np.repeat(low, wide), d, np.inf)
        near = least(d)
        one = least(np.where(d == np.repeat(near, wide), p, len(px)))
        some = np.isfinite(low)
        mine = q[at][some]
        best[mine], lag[mine], dist[mine] = one[some], low[some], near[some]
    return best, lag, dist


def latest(starts: DataFrame, ends: DataFrame, max_lag: float, radius: float) -> DataFrame:
    """(own, t, x, y, before, lag, dist): for each start (own, t, x, y) the end (track, rank, t, x, y) of another track within ``max_lag`` before it and
    within ``radius``, of least (lag, distance, rank, track). Only a start with ``own`` may meet an end of its own track."""
    time = lambda t: F.floor(t / max_lag)
    left = starts.withColumns({"t": F.col("t").cast("double"), "frame": time(F.col("t"))})
    right = ends.withColumn("t", F.col("t").cast("double"))
    right = right.select("rank", "track", "t", "x", "y", F.explode(F.sequence(time(F.col("t")), time(F.col("t") + max_lag * SLACK))).alias("frame"))
    kind = ends.schema["track"].dataType.simpleString()

    def tile(one: pa.Table, two: pa.Table) -> pa.Table:
        two = ordered(two, "rank", "track")
        but = pc.fill_null(pc.index_in(one.column("own"), value_set=two.column("track")), -1).to_numpy().astype(np.int64)
        best, lag, dist = _before(*places_of(one), one.column("t").to_numpy(), *places_of(two), two.column("t").to_numpy(), max_lag, radius, but)
        some = np.flatnonzero(best >= 0)
        one, two = one.take(pa.array(some)), two.take(pa.array(best[some]))
        return pa.table([*(one.column(c) for c in ("own", "t", "x", "y")), two.column("track"), pa.array(lag[some]), pa.array(dist[some])], names=["own", "t", "x", "y", "before", "lag", "dist"])

    return dealt(left, right, radius, tile, f"own {kind}, t double, x double, y double, before {kind}, lag double, dist double", by=("frame",))


def within(one: pa.Table, two: pa.Table, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(q, p) of the rows of ``two`` within ``radius`` of each row of ``one``, those of a row together."""
    for q, p, d in pairs(*places_of(one), *places_of(two), radius):
        fits = d <= radius
        if fits.any():
            yield q[fits], p[fits]


def means(own: DataFrame, near: DataFrame, radius: float, value: Callable[..., tuple], names: tuple[str, ...], but: str | None = None, least: int = 1) -> DataFrame:
    """Rows of ``own`` (tp, x, y, numbers) with the means of ``value`` (own columns, near columns, q, p) over those of ``near`` within ``radius``, and their number n.

    Rows with the same ``but`` don't meet; rows that meet fewer than ``least`` are left out.
    """

    columns = own.columns

    def tile(one: pa.Table, two: pa.Table) -> pa.Table:
        mine, other = ({c: t.column(c).to_numpy() for c in t.column_names} for t in (one, two))
        sums, n = np.zeros((len(names), one.num_rows)), np.zeros(one.num_rows, np.int64)
        for q, p in within(one, two, radius):
            if but:
                some = mine[but][q] != other[but][p]
                q, p = q[some], p[some]
            at = firsts(q)
            if len(q):
                wide = np.diff(np.append(at, len(q)))
                n[q[at]] = wide
                for k, v in enumerate(value(mine, other, q, p)):
                    sums[k, q[at]] = added(v, wide)
        some = np.flatnonzero(n >= max(1, least))
        found = one.select(columns).take(pa.array(some))
        for c, v in zip((*names, "n"), (*(sums[:, some] / n[some]), n[some]), strict=True):
            found = found.append_column(c, pa.array(v))
        return found

    plain = ", ".join(f"{c} {'double' if c in 'xy' else kind}" for c, kind in own.dtypes)
    return dealt(own, near, radius, tile, plain + "".join(f", {c} double" for c in names) + ", n long")


def polygon_areas(spots: DataFrame, radius: float) -> DataFrame:
    """(tp, x, y, area): of the polygon of the places (tp, x, y, n) within ``radius`` of each, in order of their angle about the mean of their n points.

    A point isn't its own neighbour; places with fewer than three have no row.
    """

    def tile(one: pa.Table, two: pa.Table) -> pa.Table:
        (qx, qy), (px, py), n = places_of(one), places_of(two), two.column("n").to_numpy()
        area = np.full(one.num_rows, np.nan)
        for q, p in within(one, two, radius):
            w = n[p] - ((px[p] == qx[q]) & (py[p] == qy[q]))
            q, p, w = q[w > 0], p[w > 0], w[w > 0]
            if not len(q):
                continue
            at = firsts(q)
            wide = np.diff(np.append(at, len(q)))
            many = np.add.reduceat(w, at)
            x, y = px[p], py[p]
            mx, my = (np.repeat(added(w * v, wide) / many, wide) for v in (x, y))
            order = np.lexsort((y, x, np.arctan2(y - my, x - mx), q))
            x, y = x[order], y[order]
            after = np.arange(1, len(q) + 1)
            after[at + wide - 1] = at
            enough = many >= 3
            area[q[at][enough]] = (np.abs(added(x * y[after] - x[after] * y, wide)) / 2)[enough]
        some = pa.array(np.flatnonzero(~np.isnan(area)))
        return one.select(["tp", "x", "y"]).take(some).append_column("area", pa.array(area).take(some))

    rows = spots.select("tp", "x", "y", "n")
    return dealt(rows.drop("n"), rows, radius, tile, f"tp {spots.schema['tp'].dataType.simpleString()}, x double, y double, area double")


def heads(spots: DataFrame, radius: float) -> DataFrame:
    """The rows of ``spots`` (tp, pt, x, y, n) with ``head``, the least ``pt`` within ``radius``, its own included."""

    def tile(one: pa.Table, two: pa.Table) -> pa.Table:
        two = ordered(two, "pt")
        least = np.full(one.num_rows, -1)
        for q, p in within(one, two, radius):
            at = firsts(q)
            least[q[at]] = np.minimum.reduceat(p, at)
        some = np.flatnonzero(least >= 0)
        return one.select(["tp", "x", "y", "n"]).take(pa.array(some)).append_column("head", two.column("pt").take(pa.array(least[some])))

    rows = spots.select("tp", "pt", "x", "y", "n")
    return dealt(rows.drop("pt"), rows.drop("n"), radius, tile, f"tp {spots.schema['tp'].dataType.simpleString()}, x double, y double, n long, head {spots.schema['pt'].dataType.simpleString()}")
