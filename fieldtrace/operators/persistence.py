"""Rolling fits, smoothed positions, flat runs and persistent stretches of tracks (track, tp, t, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.geometry import once

from .series import with_unwrapped
from .tracks import order, rolling_value


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the product's own error is added at the end."""
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    whole = once(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), high(a).alias("ah"), high(b).alias("bh"), (a * b).alias("p")), _sum)
    return F.nanvl(whole, a * b + c)


def _sum(z: Column) -> Column:
    al, bl, s = z["a"] - z["ah"], z["b"] - z["bh"], z["p"] + z["c"]
    lost = ((z["ah"] * z["bh"] - z["p"]) + z["ah"] * bl + al * z["bh"]) + al * bl
    other = s - z["p"]
    return s + (((z["p"] - (s - other)) + (z["c"] - other)) + lost)


def fused_slope(pairs: Column) -> Column:
    """Least-squares slope of an array of (v, t) in its order, by running means whose co-moment is rounded once a step.

    A slope that is just at a cutoff falls on the side of it that ``regr_slope`` of the SQL gives.
    """
    known = F.filter(pairs, lambda p: p["v"].isNotNull() & p["t"].isNotNull())
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mt", "mv", "co", "var")])

    def step(s: Column, p: Column) -> Column:
        n, dt = s["n"] + 1, p["t"] - s["mt"]
        means = F.struct((s["mt"] + dt / n).alias("t"), (s["mv"] + (p["v"] - s["mv"]) / n).alias("v"))
        return once(means, lambda m: F.struct(n.alias("n"), m["t"].alias("mt"), m["v"].alias("mv"), _fused(dt, p["v"] - m["v"], s["co"]).alias("co"), (s["var"] + (p["t"] - m["t"]) * dt).alias("var")))

    return F.aggregate(known, zero, step, lambda s: F.when(s["var"] > 0, (s["co"] / s["n"]) / (s["var"] / s["n"])))


def _with_fits(rows: DataFrame, window: int, time: str, fields: tuple[str, ...], fused: bool = False) -> DataFrame:
    """``rows`` with slope and intercept of each field (field_slope, field_intercept), over windows of the track alone: nothing is joined.
    ``fused`` slopes are those of ``fused_slope``."""
    span = order().rowsBetween(-(window // 2), window - 1 - window // 2)
    pairs = lambda c: F.collect_list(F.struct(F.col(c).cast("double").alias("v"), F.col(time).cast("double").alias("t"))).over(span)
    slope = lambda c: fused_slope(pairs(c)) if fused else F.regr_slope(F.col(c), F.col(time)).over(span)
    made = {"slope": slope, "intercept": lambda c: F.regr_intercept(F.col(c), F.col(time)).over(span)}
    fits = {f"{c}_{n}": F.when(F.count(c).over(span) == window, f(c)) for c in fields for n, f in made.items()}
    before, whole = order().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("track")
    #: The first fit is looked up once a track: a frame from each row to the last would read all rows behind each.
    held = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.min_by(c, F.when(F.col(c).isNotNull(), F.col("tp"))).over(whole))
    return rows.withColumns(fits).withColumns({c: held(c) for c in fits})


def rolling_fit(points: DataFrame, window: int, time: str, field: str) -> DataFrame:
    """(track, tp, slope, intercept) of least-squares lines over centred windows; places near an end have the first or last
    full window's. Tracks shorter than the window have none."""
    rows = _with_fits(points.select("track", "tp", F.col(time).alias("_t"), F.col(field).alias("_v")), window, "_t", ("_v",), fused=True)
    return rows.select("track", "tp", F.col("_v_slope").alias("slope"), F.col("_v_intercept").alias("intercept")).filter("slope is not null")


def smoothed(points: DataFrame, window: int, factor: int, fields: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``factor`` times as many even times from first to last point of each track, with the fit of the point at or before each: (track, place, t, fields)."""
    own = Window.partitionBy("track")
    rows = points.withColumn("n", F.count("*").over(own) * factor).withColumn("t0", F.min("t").over(own)).withColumn("step", (F.max("t").over(own) - F.col("t0")) / (F.col("n") - 1))
    rows = _with_fits(rows.withColumn("later", F.lead("t").over(order())), window, "t", fields).dropna(subset=[f"{c}_slope" for c in fields])
    place = lambda t: F.ceil((t - F.col("t0")) / F.col("step"))
    last = F.when(F.col("later").isNull(), F.col("n") - 1).otherwise(F.least(place(F.col("later")) - 1, F.col("n") - 2))
    first = F.when(F.col("later").isNull(), F.least(place(F.col("t")), F.col("n") - 1)).otherwise(place(F.col("t")))
    rows = rows.filter("step > 0").withColumn("first", first).withColumn("last", last).filter("first <= last")
    rows = rows.withColumn("place", F.explode(F.sequence("first", "last"))).withColumn("at", F.col("t0") + F.col("place") * F.col("step"))
    return rows.select("track", "place", F.col("at").alias("t"), *[(F.col(f"{c}_intercept") + F.col(f"{c}_slope") * F.col("at")).alias(c) for c in fields])


def _runs(flag: str) -> Column:
    """A number for each run of equal flags of a track, to be taken with the flag."""
    return F.row_number().over(order()) - F.row_number().over(Window.partitionBy("track", flag).orderBy("tp"))


def flat_mask(series: DataFrame, cutoff: float, noise: int) -> DataFrame:
    """``series`` (track, tp, slope) with ``flat``: |slope| < cutoff, without runs and then without holes shorter than ``noise``.

    A track that is flat all over stays so, however short.
    """
    rows = series.withColumn("flat", F.abs("slope") < cutoff).withColumn("all", F.min("flat").over(Window.partitionBy("track")))
    for kept in (True, False):
        rows = rows.withColumn("run", _runs("flat")).withColumn("n", F.count("*").over(Window.partitionBy("track", "flat", "run")))
        turn = (F.col("flat") == kept) & (F.col("n") < noise) & ~F.col("all")
        #: Where nothing is left of the flat runs, the holes aren't filled either.
        some = F.max("flat").over(Window.partitionBy("track")) if not kept else F.lit(True)
        rows = rows.withColumn("flat", F.when(turn & some, ~F.col("flat")).otherwise(F.col("flat")))
    return rows.drop("run", "n", "all")


def flat_runs(series: DataFrame, cutoff: float, noise: int) -> DataFrame:
    """Flat runs of a series, short holes filled: (track, start, stop, n)."""
    rows = flat_mask(series, cutoff, noise).withColumn("run", _runs("flat"))
    return rows.filter("flat").groupBy("track", "run").agg(F.min("tp").alias("start"), F.max("tp").alias("stop"), F.count("*").alias("n")).drop("run")


def islands(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's duration, path, displacement and mean speed over the steps that begin in it, and the gap after the run before."""
    steps = points.select("track", "tp", "t", "x", "y", *[(F.lead(c).over(order()) - F.col(c)).alias(f"d{c}") for c in "txy"]).filter("dt is not null")
    steps = steps.withColumn("ds", F.hypot("dx", "dy")).withColumn("speed", F.when(F.col("dt") > 0, F.col("ds") / F.col("dt")))
    inside = steps.join(runs.select("track", "start", "stop", F.explode(F.sequence("start", "stop")).alias("tp")), ["track", "tp"])
    #: Sums run in order of the points, so that their last bits, and with them a rounded half, don't hang on how rows are dealt out.
    so_far = Window.partitionBy("track", "start", "stop").orderBy("tp").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumns({"dt": F.sum("dt").over(so_far), "ds": F.sum("ds").over(so_far), "speed": F.avg("speed").over(so_far)})
    last = lambda c: F.max_by(c, "tp")
    end = lambda c: last(c) - F.min_by(c, "tp")
    rows = inside.groupBy("track", "start", "stop").agg(last("dt").alias("duration"), last("ds").alias("distance"), F.hypot(end("x"), end("y")).alias("displacement"), last("speed").alias("speed"), F.min("t").alias("begins"), F.max("t").alias("ends"))
    before = F.lag("ends").over(Window.partitionBy("track").orderBy("start"))
    return rows.select("track", "start", "stop", "duration", "distance", "displacement", "speed", (F.col("begins") - before).alias("gap"))


def scalars(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Duration, path, displacement, straightness, mean velocity and speed of each track, and its shares of persistent and quiescent points.

    A run's last point doesn't count as persistent (its stretch is half open).
    """
    whole = points.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order()), F.col("y") - F.lag("y").over(order())), F.lit(0.0)))
    end = lambda c: F.max_by(c, "tp") - F.min_by(c, "tp")
    rows = whole.groupBy("track").agg(F.count("*").alias("n"), end("t").alias("duration"), F.sum("step").alias("distance"), F.hypot(end("x"), end("y")).alias("displacement"))
    held = runs.groupBy("track").agg(F.sum(F.col("n") - 1).alias("held"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    share = F.coalesce("held", F.lit(0)) / F.col("n")
    return rows.join(held, "track", "left").select("track", "duration", "distance", "displacement", ratio("displacement", "distance").alias("straightness"), ratio("displacement", "duration").alias("velocity"), ratio("distance", "duration").alias("speed"), share.alias("persistent"), (1 - share).alias("quiescent"))


def timeline(points: DataFrame, factor: int = 4, window: int = 7, smooth: int = 5, cutoff: float = 2.5, noise: int = 5) -> DataFrame:
    """The whole chain from positions to persistent stretches, on ``factor`` times as many even times of each track.

    Positions are fitted in windows of ``window`` points and averaged over ``smooth * factor`` times; headings of the steps
    between them are unwrapped, and their slope in windows of ``window`` times is persistent where it is under ``cutoff`` degrees a
    unit of time, without runs and holes shorter than ``noise``. Gives (track, tp, t, x, y, speed, angle, slope, flat):
    the last time of a track has no step, so null from speed on. Tracks shorter than ``window`` have no row.
    """
    rows = smoothed(points, window, factor).withColumnRenamed("place", "tp")
    if smooth > 0:
        rows = rows.withColumns({c: rolling_value(c, smooth * factor) for c in "xy"})
    rows = rows.withColumns({f"d{c}": F.lead(c).over(order()) - F.col(c) for c in "txy"})
    rows = rows.withColumn("speed", F.when(F.col("dt") > 0, F.hypot("dx", "dy") / F.col("dt"))).withColumn("heading", F.when(F.col("dt").isNotNull(), F.atan2("dy", "dx")))
    rows = with_unwrapped(rows, "heading")
    rows = _with_fits(rows, window, "t", ("angle",)).withColumn("slope", F.when(F.col("dt").isNotNull(), F.col("angle_slope")))
    return flat_mask(rows, cutoff, noise).select("track", "tp", "t", "x", "y", "speed", "angle", "slope", "flat")


def stretches(chain: DataFrame) -> DataFrame:
    """Runs of persistent steps of a ``timeline``: (track, start, stop, n)."""
    rows = chain.filter("flat is not null").withColumn("run", _runs("flat"))
    return rows.filter("flat").groupBy("track", "run").agg(F.min("tp").alias("start"), F.max("tp").alias("stop"), F.count("*").alias("n")).drop("run")


def waveform(chain: DataFrame) -> DataFrame:
    """(track, tp, t, persistent, waveform): whether a time lies in a stretch, its last one left out, and its speed if so."""
    rows = chain.withColumn("persistent", F.coalesce(F.col("flat") & F.lead("flat").over(order()), F.lit(False)))
    return rows.select("track", "tp", "t", "persistent", F.when(F.col("persistent"), F.col("speed")).alias("waveform"))


def persistence_at(chain: DataFrame, time: float, span: float = 1.0) -> DataFrame:
    """(track, persistent, quiescent): shares of the times from ``time`` on and before ``time + span``, of the tracks that have any."""
    share = F.avg(F.col("persistent").cast("double"))
    return waveform(chain).filter((F.col("t") >= time) & (F.col("t") < time + span)).groupBy("track").agg(share.alias("persistent"), (1 - share).alias("quiescent"))


def sampled_waveform(chain: DataFrame, times: list[float]) -> DataFrame:
    """(track, time, waveform): mean speed of the persistent times from each of ``times`` up to the next; the last has none, as have times without persistence."""
    ends = F.array(*[F.struct(F.lit(float(a)).alias("time"), F.lit(float(b)).alias("next")) for a, b in zip(times, [*times[1:], times[-1]], strict=True)])
    which = F.try_element_at(F.filter(ends, lambda e: (e["time"] <= F.col("t")) & (F.col("t") < e["next"])), F.lit(1))["time"]
    found = waveform(chain).groupBy("track", F.when(F.col("persistent"), which).alias("time")).agg(F.avg(F.when(F.col("persistent"), F.col("waveform"))).alias("waveform"))
    own = found.groupBy("track").agg(F.map_from_entries(F.collect_list(F.when(F.col("time").isNotNull(), F.struct("time", "waveform")))).alias("m"))
    return own.select("track", "m", F.explode(ends).alias("e")).select("track", "e.time", F.try_element_at("m", F.col("e.time")).alias("waveform"))
