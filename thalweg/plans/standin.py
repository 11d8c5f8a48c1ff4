"""Profiles out of the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Users are paths and events their nodes, 200 m apart.
SHORT = """
SELECT user_id AS mip,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos,
       event_id AS node_id,
       CAST(NULL AS BIGINT) AS reach_id,
       200.0D * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dist_m,
       value AS width,
       CAST(1 + event_id % 3 AS DOUBLE) AS n_channels,
       CAST(500.0D - value / 10.0D AS DOUBLE) AS wse,
       CAST(200.0D * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS x,
       value AS y
FROM events
"""

#: Suppliers are paths and their lines nodes.
LONG = """
SELECT l_suppkey AS mip,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INT) AS pos,
       l_orderkey AS node_id,
       CAST(NULL AS BIGINT) AS reach_id,
       200.0D * row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS dist_m,
       l_quantity AS width,
       CAST(l_linenumber AS DOUBLE) AS n_channels,
       CAST(l_extendedprice AS DOUBLE) AS wse,
       CAST(l_tax * 100 AS DOUBLE) AS x,
       CAST(l_discount * 100 AS DOUBLE) AS y
FROM lineitem
"""


def for_duckdb(sql: str) -> str:
    return sql.replace("200.0D", "200.0::DOUBLE").replace("500.0D", "500.0::DOUBLE").replace("10.0D", "10.0::DOUBLE")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    # The path's column has one name from the start: under a second one Spark would not know that the profiles are dealt by it, and deal them again.
    spark.table("events").withColumnRenamed("user_id", "mip").createOrReplaceTempView("path_events")
    return spark.sql(SHORT.replace("user_id AS mip", "mip").replace("user_id", "mip").replace("FROM events", "FROM path_events"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(LONG)
