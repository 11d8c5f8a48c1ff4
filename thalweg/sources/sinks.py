"""Tables out: Parquet as they are, CSV with nested columns as JSON, small facts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(F.col(c)).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_tables(tables: dict, folder: str, csv: bool = False, mode: str = "overwrite") -> list[str]:
    """Write every DataFrame among tables under its name; empty ones too, so that a later run can resume."""
    done = []
    for name, df in tables.items():
        if isinstance(df, DataFrame):
            if csv:
                flat(df).write.mode(mode).option("header", True).csv(f"{folder}/{name}")
            else:
                df.write.mode(mode).parquet(f"{folder}/{name}")
            done.append(name)
    return done


def write_json(spark: SparkSession, facts: dict, path: str, mode: str = "overwrite") -> None:
    """One JSON object, in a folder of its own."""
    import json

    spark.createDataFrame([(json.dumps(facts, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def write_calibration(spark: SparkSession, found: dict, folder: str) -> None:
    """Pairs and sweep as tables, the threshold as JSON."""
    write_tables({"pairs": found["pairs"], "sweep": found["sweep"]}, folder)
    facts = {k: v for k, v in found.items() if not isinstance(v, DataFrame)}
    write_json(spark, facts | {"merge_threshold_m": 1000.0 * found["threshold_km"]}, f"{folder}/consensus")
