"""Tables in: network, nodes, observations, centerlines, and what earlier runs left."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConsensusConfig
from ..operators.profile import web_mercator
from ..schemas import finite, first_of, require
from . import wkb


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Tables as temporary views, to be used in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def downstream_columns(columns: list[str]) -> list[str]:
    """rch_id_dn_1, rch_id_dn_2 ... but not those of another kind, rch_id_dn_m..."""
    return [c for c in columns if re.match(r"rch_id_dn_(?!m)", c)]


def normalize_reaches(df: DataFrame) -> DataFrame:
    """Reaches with one array of downstream ids, known types, and missing as NULL."""
    require(df, "reach_id", "main_path_id")
    wide = downstream_columns(df.columns)
    down = F.array(*[F.col(c).cast("long") for c in wide]) if wide else F.col("rch_id_dn") if "rch_id_dn" in df.columns else F.array().cast("array<long>")
    number = lambda c: finite(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    flag = F.col("is_mainstem").cast("boolean") if "is_mainstem" in df.columns else F.lit(None).cast("boolean")
    geometry = [F.col("geometry")] if "geometry" in df.columns else []
    if geometry and dict(df.dtypes)["geometry"] in ("binary", "string"):
        # One line as it is; the parts of several are kept beside it.
        df = wkb.with_parts(df, "geometry", "geometry_parts")
        geometry = [F.when(F.size("geometry_parts") == 1, F.col("geometry_parts")[0]).alias("geometry"), F.col("geometry_parts"), F.col("geometry_status")]
    return df.select(F.col("reach_id").cast("long"), F.col("main_path_id").cast("long"), flag.alias("is_mainstem"), down.alias("rch_id_dn"), *[number(c).alias(c) for c in ("reach_len", "width", "dist_out", "n_chan")], *geometry)


def normalize_nodes(df: DataFrame, project: bool = False) -> DataFrame:
    """Nodes under fixed names; x and y are projected from degrees if asked."""
    require(df, "node_id", "reach_id")
    n_chan = "n_chan_mod" if "n_chan_mod" in df.columns else "n_channels"
    number = lambda c: finite(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    x, y = number("x"), number("y")
    if project:
        x, y = web_mercator(x, y)
    return df.select(
        F.col("node_id").cast("long"), F.col("reach_id").cast("long"), number(first_of(df, "hydro_dist_out", "dist_out")).alias("dist_out"),
        number(first_of(df, "node_length", "node_len")).alias("node_length"), number("width").alias("width"), number(n_chan).alias("n_channels"), number("wse").alias("wse"), x.alias("x"), y.alias("y"),
    )


def read_observations(spark: SparkSession, folder: str, continent: str) -> DataFrame:
    """Observation files of a continent; files whose names begin with a dot are left alone."""
    return spark.read.option("pathGlobFilter", f"*{continent}*.parquet").parquet(folder)


def lookup_centerlines(centerlines: DataFrame, paths: DataFrame) -> DataFrame:
    """The line of each path: (mip, line, status), status telling of none or more than one."""
    n = centerlines.groupBy("main_path_id").agg(F.count("*").alias("_n"), F.first("line").alias("line"))
    joined = paths.select("mip").distinct().join(n, F.col("mip") == F.col("main_path_id"), "left")
    status = F.when(F.col("_n").isNull(), "missing_centerline").when(F.col("_n") > 1, "duplicate_centerline").otherwise("ok")
    return joined.select("mip", F.when(F.col("_n") == 1, F.col("line")).alias("line"), status.alias("status"))


def parse_ids(text: str) -> list[int]:
    """Path ids from a JSON list or from text with commas or white space; none is an error."""
    text = text.strip()
    ids = [int(x) for x in (json.loads(text) if text.startswith("[") else re.split(r"[,\s]+", text)) if str(x).strip()]
    if not ids:
        raise ValueError("no path ids given")
    return ids


def consensus_config(spark: SparkSession, path: str) -> ConsensusConfig:
    """A merge threshold that a calibration wrote as JSON."""
    row = spark.read.option("multiLine", True).json(path).first()
    return ConsensusConfig(merge_threshold_m=float(row["merge_threshold_m"]))


def resume(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of an earlier run; a missing one is an error that names it."""
    out, missing = {}, []
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{folder}/{n}")
        except Exception as e:  # the kind differs between file systems
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            missing.append(n)
    if missing:
        raise FileNotFoundError(f"{folder} lacks {missing}")
    return out
