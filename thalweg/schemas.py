"""Table schemas at the engine's borders. Missing is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"

REACHES = f"reach_id long, main_path_id long, is_mainstem boolean, rch_id_dn array<long>, reach_len double, width double, dist_out double, n_chan double, geometry {LINE}"
NODES = "node_id long, reach_id long, dist_out double, node_length double, width double, n_channels double, wse double, x double, y double"
OBSERVATIONS = "node_id long, reach_id string, wse_sm double, wse_sm_u double, dark_frac double, xtrk_dist double"
CENTERLINES = f"main_path_id long, line {LINE}"
PROFILE = "mip long, pos int, node_id long, reach_id long, dist_m double, width double, n_channels double, wse double, x double, y double"
WINDOW_PLAN = "mip long, family string, window_order int, window_m double, window_label string, window_pts int, is_feasible boolean"
RUNS = "mip long, window_m double, penalty double, n_points int, min_size int, break_index array<int>, break_m array<double>, status string"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df


def first_of(df: DataFrame, *columns: str) -> str:
    """The first of the column names that df has."""
    for c in columns:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {list(columns)} is there")


def finite(c):
    """NULL for NaN and infinities."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)
