"""Rolling features over profiles, for windows that differ from path to path.

Frame bounds must be constants, so positions are scaled: ordered by pos / half in millionths,
a RANGE of a million to each side holds half rows to each side (one more, against rounding).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import FeatureConfig, check_features
from .profile import log_width, multi_channel

_MILLION = 1_000_000


def expand(profile: DataFrame, plan: DataFrame) -> DataFrame:
    """profile rows for each distinct window of their path, with half, the rows to each side."""
    windows = plan.where("is_feasible").select("mip", "window_m", "window_pts").distinct()
    return profile.join(windows, "mip").withColumn("half", F.floor(F.col("window_pts") / 2).cast("int"))


def frame(keys: tuple[str, ...] = ("mip", "window_m")) -> WindowSpec:
    """The centred window of each row of an expanded profile."""
    return Window.partitionBy(*keys).orderBy(F.col("pos") * float(_MILLION) / F.greatest(F.col("half"), F.lit(1))).rangeBetween(-_MILLION - 1, _MILLION + 1)


def _quantile(value: Column, q: float, w: WindowSpec) -> Column:
    """The quantile of the known values in a frame, linear between ranks.

    The frame's sorted list: percentile() would count its values in a hash table for every row.
    """

    def between(known: Column) -> Column:
        place = (F.size(known) - 1) * F.lit(q)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        a, b = F.get(known, low), F.get(known, high)
        return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)

    # As the element of an array the list is sorted once, not for each use of it.
    return F.transform(F.array(F.sort_array(F.collect_list(value.cast("double")).over(w))), between)[0]


def rolling(value: Column, how: str, w: WindowSpec, min_points: int = 5) -> Column:
    """median, mean, rms or p90 of the known values in a frame of enough of them, or mode of the rounded ones."""
    if how == "median":
        x = _quantile(value, 0.5, w)
    elif how == "p90":
        x = _quantile(value, 0.9, w)
    elif how == "mean":
        x = F.avg(value).over(w)
    elif how == "rms":
        x = F.sqrt(F.avg(value * value).over(w))
    elif how == "mode":
        x = F.mode(F.rint(value), True).over(w)
    else:
        raise ValueError(f"unknown statistic: {how}")
    return F.when(F.count(value).over(w) >= min_points, x)


def rolling_slope(dist: Column, height: Column, points: Column, w: WindowSpec, fraction: float = 0.8, least: int = 10) -> Column:
    """Fall of height along the distance by least squares, where enough of the window is known."""
    y = F.when(height.isNotNull(), height)
    enough = F.greatest(F.ceil(F.lit(fraction) * points), F.lit(least))
    return F.when(F.count(y).over(w) >= enough, -F.regr_slope(y, F.when(y.isNotNull(), dist)).over(w))


def fill_gaps(df: DataFrame, value: str, out: str, keys: tuple[str, ...], limit: int | None = 5) -> DataFrame:
    """Linear fill between known neighbours, but only within `limit` rows of one; edges repeat the known value.

    With no limit every gap is filled.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v, p = F.col(value), F.when(F.col(value).isNotNull(), F.col("pos"))
    v0, p0 = F.last(v, True).over(past), F.last(p, True).over(past)
    v1, p1 = F.first(v, True).over(ahead), F.first(p, True).over(ahead)
    line = F.when(v.isNotNull(), v).when(v0.isNotNull() & v1.isNotNull(), v0 + (v1 - v0) * (F.col("pos") - p0) / (p1 - p0)).otherwise(F.coalesce(v0, v1))
    if limit is None:
        return df.withColumn(out, line)
    near = F.least(F.coalesce(F.col("pos") - p0, F.lit(1 << 30)), F.coalesce(p1 - F.col("pos"), F.lit(1 << 30)))
    return df.withColumn(out, F.when(near <= limit, line))


def fill_nearest(df: DataFrame, value: str, out: str, keys: tuple[str, ...]) -> DataFrame:
    """Forward, then backward fill."""
    w = Window.partitionBy(*keys).orderBy("pos")
    before = F.last(F.col(value), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.col(value), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(before, after))


def rolling_sinuosity(df: DataFrame, out: str, keys: tuple[str, ...] = ("mip", "window_m"), min_points: int = 5) -> DataFrame:
    """Length along known points of the frame over the straight distance of its ends.

    Needs x, y and half; points without coordinates are bridged.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    px, py = F.last(F.when(known, F.col("x")), True).over(past), F.last(F.when(known, F.col("y")), True).over(past)
    step = F.when(known, F.coalesce(F.hypot(F.col("x") - px, F.col("y") - py), F.lit(0.0)))
    run = df.withColumn("_run", F.when(known, F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    f = frame(keys)
    point = F.when(F.col("_run").isNotNull(), F.struct("x", "y", F.col("_run").alias("s")))
    run = run.withColumn("_a", F.first(point, True).over(f)).withColumn("_z", F.last(point, True).over(f)).withColumn("_n", F.count("_run").over(f))
    straight = F.hypot(F.col("_z.x") - F.col("_a.x"), F.col("_z.y") - F.col("_a.y"))
    along = F.col("_z.s") - F.col("_a.s")
    return run.withColumn(out, F.when((F.col("_n") >= min_points) & (straight > 0), along / straight)).drop("_run", "_a", "_z", "_n")


def moving_average(df: DataFrame, value: str, out: str, window: int, keys: tuple[str, ...] = ("mip",)) -> DataFrame:
    """Centred mean over an odd number of rows (an even one counts one more); the ends repeat the edge value."""
    half = window // 2
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(w) - 1
    inside = F.sum(value).over(w.rowsBetween(-half, half))
    before, after = F.greatest(half - i, F.lit(0)), F.greatest(i + half - n + 1, F.lit(0))
    return df.withColumn(out, (inside + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / (2 * half + 1))


def curvature(df: DataFrame, step_m: float = 10.0, keys: tuple[str, ...] = ("mip",), out: str = "kappa", signed: bool = True, eps: float = 1e-12) -> DataFrame:
    """Curvature of equally spaced points by central differences, one-sided at the ends; NULL under five points."""
    w = Window.partitionBy(*keys).orderBy("pos")

    def slope(c: str) -> Column:
        back, ahead, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        return F.when(back.isNull(), (ahead - here) / step_m).when(ahead.isNull(), (here - back) / step_m).otherwise((ahead - back) / (2 * step_m))

    d = df.withColumn("_dx", slope("x")).withColumn("_dy", slope("y"))
    d = d.withColumn("_ddx", slope("_dx")).withColumn("_ddy", slope("_dy")).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    k = (F.col("_dx") * F.col("_ddy") - F.col("_dy") * F.col("_ddx")) / F.greatest(F.pow(F.col("_dx") ** 2 + F.col("_dy") ** 2, 1.5), F.lit(eps))
    return d.withColumn(out, F.when(F.col("_n") >= 5, k if signed else F.abs(k))).drop("_dx", "_dy", "_ddx", "_ddy", "_n")


#: Distances in metres up to which two points count as one.
SAME_M = 1e-6


def aligned(points: DataFrame, external: DataFrame, *columns: str, keys: tuple[str, ...] = ("mip", "window_m")) -> DataFrame:
    """points (keys, pos, dist_m) with columns of external (keys, dist_m) at their distances.

    Where a group has as many rows on both sides, no pair of them further apart than SAME_M,
    the values are taken as they are. Otherwise a point has the value at its distance, or
    the one interpolated between the known values before and after it; before the first and
    after the last it stays missing, and a single known value holds everywhere. Groups that
    external lacks stay missing.

    Both sides become one table ordered by distance, in which the known values around a
    point are the last before it and the first after it: one shuffle by the keys, no range join.
    """
    place = Window.partitionBy(*keys, "_given").orderBy("dist_m", "_pos")
    side = lambda df, given, pos, value: df.select(*keys, F.col("dist_m").cast("double").alias("dist_m"), pos.alias("_pos"), F.lit(given).alias("_given"), *[value(c) for c in columns])
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    rows = side(points, False, F.col("pos"), lambda c: F.lit(None).cast("double").alias(c)).unionByName(side(external.where("dist_m is not null"), True, F.lit(0), known))
    rows = rows.withColumn("_place", F.row_number().over(place))
    # By place: the partner's distance and values, and whether all places of the group have a partner that near.
    pair = Window.partitionBy(*keys, "_place")
    near = F.coalesce((F.count("*").over(pair) == 2) & (F.max("dist_m").over(pair) - F.min("dist_m").over(pair) <= SAME_M), F.lit(False))
    rows = rows.withColumn("_near", near).select("*", *[F.max(c).over(pair).alias(f"_own_{c}") for c in columns])
    group = Window.partitionBy(*keys)
    before = group.orderBy("dist_m", F.desc("_given")).rowsBetween(Window.unboundedPreceding, 0)
    after = group.orderBy("dist_m", "_given").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_same", F.min("_near").over(group))
    for c in columns:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("dist_m").alias("d"), F.col(c).alias("v")))
        rows = rows.withColumn("_a", F.last(point, ignorenulls=True).over(before)).withColumn("_b", F.first(point, ignorenulls=True).over(after)).withColumn("_n", F.count(c).over(group))
        a, b = F.col("_a"), F.col("_b")
        between = F.when(b["d"] - a["d"] <= 0, a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("dist_m") - a["d"]) / (b["d"] - a["d"]))
        value = F.when(F.col("_same"), F.col(f"_own_{c}")).when(F.col("_n") == 1, F.coalesce(a["v"], b["v"])).otherwise(between)
        rows = rows.withColumn(f"_to_{c}", value)
    return rows.where(~F.col("_given")).select(*keys, F.col("_pos").alias("pos"), "dist_m", *[F.col(f"_to_{c}").alias(c) for c in columns])


def build_features(profile: DataFrame, plan: DataFrame, features, config: FeatureConfig = FeatureConfig(), external: DataFrame | None = None) -> DataFrame:
    """(mip, window_m, pos, dist_m, window_pts, a column for each feature).

    external: (mip, window_m, pos, sinuosity, curvature) from the geometry operators, or with
    dist_m in place of pos, and is then aligned by distance. The raw window has width and
    channels only.
    """
    features = check_features(features)
    rows = expand(profile, plan).withColumn("_w", log_width(F.col("width")) if config.log_width else F.col("width").cast("double"))
    channels = multi_channel(F.col("n_channels"), config.channel_threshold) if config.binary_channels else F.col("n_channels").cast("double")
    rows = rows.withColumn("_c", channels)
    f, raw, key = frame(), F.col("half") == 0, ("mip", "window_m")
    if "width" in features:
        rows = rows.withColumn("width_f", F.when(raw, F.col("_w")).otherwise(rolling(F.col("_w"), config.width_summary, f, config.min_points)))
    if "channels" in features:
        rows = rows.withColumn("channels_f", F.when(raw, F.col("_c")).otherwise(rolling(F.col("_c"), config.channels_summary, f, config.min_points)))
    if "slope" in features:
        rows = rows.withColumn("_s", rolling_slope(F.col("dist_m"), F.col("wse"), F.col("window_pts"), f, config.slope_min_fraction, config.slope_min_points))
        rows = fill_nearest(fill_gaps(rows, "_s", "_g", key, config.slope_max_gap), "_g", "slope_f", key)
    geometry = [g for g in ("sinuosity", "curvature") if g in features]
    if geometry:
        if external is None:
            raise ValueError("sinuosity and curvature need the geometry features of the paths")
        if "pos" not in external.columns:
            external = aligned(rows.where(~raw).select("mip", "window_m", "pos", "dist_m"), external, *geometry)
        rows = rows.join(external.select("mip", "window_m", "pos", *[F.col(g).alias(f"{g}_f") for g in geometry]), ["mip", "window_m", "pos"], "left")
        if "curvature" in geometry and config.abs_curvature:
            rows = rows.withColumn("curvature_f", F.abs("curvature_f"))
    return rows.select("mip", "window_m", "pos", "dist_m", "window_pts", *[F.col(f"{c}_f").alias(c) for c in features])


def standardize(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("mip", "window_m")) -> DataFrame:
    """z-scores by the population deviation; a constant column becomes 0, missing stays missing."""
    w = Window.partitionBy(*keys)
    for c in columns:
        mean, deviation = F.avg(c).over(w), F.stddev_pop(c).over(w)
        df = df.withColumn(c, F.when(deviation > 0, (F.col(c) - mean) / deviation).otherwise(F.col(c) * 0))
    return df


def impute(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("mip", "window_m")) -> DataFrame:
    """Missing values become the median of their window's column, or 0 where all are missing."""
    w = Window.partitionBy(*keys)
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), F.percentile(c, F.lit(0.5)).over(w), F.lit(0.0)))
    return df


def useful_features(df: DataFrame, *columns: str) -> DataFrame:
    """(mip, feature): those that vary in at least one window of a path."""
    per = df.groupBy("mip", "window_m").agg(*[F.stddev_pop(c).alias(c) for c in columns])
    most = per.groupBy("mip").agg(*[F.max(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("deviation")) for c in columns]))
    return most.select("mip", pairs.alias("_")).select("mip", "_.feature", "_.deviation").where("deviation > 1e-12")


def nan_rates(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("mip", "window_m")) -> DataFrame:
    """Known and missing values of each feature and window."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(*keys, pairs.alias("_")).select(*keys, "_.feature", "_.value")
    return long.groupBy(*keys, "feature").agg(
        F.count("*").alias("n"), F.count("value").alias("n_finite"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg(F.col("value").isNull().cast("double")).alias("missing_fraction")
    )
