"""A base of runs on disk that several finals share and that an interrupted run goes on from.

What solving leaves for a path (window plan, standardised features, runs, support) is kept in
tables bucketed by path and partitioned by batch. A batch holds some paths; its partitions
are written with dynamic overwrite, and only then are its paths noted as finished. A run
that was stopped half-way thus leaves a batch that nobody reads, and that the next run
writes over; paths that are finished are not solved again. Reads bring each path's rows in
one bucket, so windows and groups by path need no exchange, and neither do joins by path and
more where spark.sql.requireAllClusterKeysForCoPartition is off.

The tables lie in a folder that driver and executors share. A session that does not know
them yet is told by the schemas that stand beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import support
from . import runner

#: What is kept of a base; its support is made anew, without an exchange.
TABLES = ("plan", "windows", "z", "runs")
FINISHED = "finished"


@contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key, "static")
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Base:
    """The base of one configuration in a folder. buckets: as many as tasks that read it."""

    def __init__(self, spark: SparkSession, folder: str, config: PipelineConfig = PipelineConfig(), buckets: int = 64, tuning_run: bool = False):
        self.spark, self.folder, self.config, self.buckets, self.tuning_run = spark, folder.rstrip("/"), config, buckets, tuning_run
        self.prefix = "base_" + re.sub(r"\W", "_", self.folder).strip("_").lower()

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def _declare(self, table: str, ddl: str | None = None) -> bool:
        """Make a table known to the session, by a schema given now or kept before; whether there is one."""
        name, where = self._name(table), f"{self.folder}/{table}"
        if self.spark.catalog.tableExists(name):
            return True
        kept = f"{self.folder}/schemas/{table}"
        known = ddl is None
        if known:
            try:
                ddl = self.spark.read.text(kept).first()[0]
            except Exception as e:  # the kind differs between file systems
                if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                    raise
                return False
        else:
            self.spark.createDataFrame([(ddl,)], "value string").coalesce(1).write.mode("overwrite").text(kept)
        self.spark.sql(f"CREATE TABLE {name} ({ddl}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (mip) SORTED BY (mip) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        if known:
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return True

    def _put(self, table: str, df: DataFrame, batch: int) -> None:
        if not self._declare(table):
            self._declare(table, df._jdf.schema().toDDL())
        columns = [c for c in self.spark.table(self._name(table)).columns if c != "batch"]
        with _dynamic(self.spark):
            df.select(*columns, F.lit(batch).alias("batch")).repartition(self.buckets, "mip").write.mode("overwrite").insertInto(self._name(table))

    def finished(self) -> DataFrame:
        """(mip, batch) of the paths that are done."""
        if not self._declare(FINISHED):
            return self.spark.createDataFrame([], "mip long, batch int")
        return self.spark.table(self._name(FINISHED))

    def complete(self, profile: DataFrame, batches: int = 1, external: DataFrame | None = None) -> int:
        """Solve the paths of profile that are not finished, in so many batches; how many there were."""
        todo = profile.join(self.finished().select("mip"), "mip", "left_anti")
        paths = runner.settle(todo.select("mip").distinct())
        last = self.finished().agg(F.max("batch")).first()[0]
        first = -1 if last is None else last
        for k in range(batches):
            mine = paths.where(F.pmod(F.xxhash64("mip"), F.lit(batches)) == k)
            if mine.limit(1).count():
                self.solve(todo.join(mine, "mip", "left_semi"), mine, first + 1 + k, external)
        return paths.count()

    def solve(self, profile: DataFrame, paths: DataFrame, batch: int, external: DataFrame | None = None) -> None:
        """One batch: its tables, and then its paths as finished."""
        made = runner.base_tables(profile, self.config, self.tuning_run, external)
        for table in TABLES:
            self._put(table, made[table], batch)
        self._put(FINISHED, paths.select("mip"), batch)

    def tables(self) -> dict[str, DataFrame]:
        """The base as base_tables() gives it, of all finished paths."""
        done = [r["batch"] for r in self.finished().select("batch").distinct().collect()]  # a row for each batch
        out = {}
        for table in TABLES:
            if not self._declare(table):
                raise FileNotFoundError(f"{self.folder} has no finished base")
            out[table] = self.spark.table(self._name(table)).where(F.col("batch").isin(done)).drop("batch")
        out["features"] = out["z"]
        out["support"] = support.support_table(out["runs"], self.config.stability_tolerance_m)
        return out

    def finalize(self, profile: DataFrame, family: str = "w2", **options) -> dict[str, DataFrame]:
        """A final run over the base, for all its paths or those of profile."""
        base = self.tables()
        only = profile.select("mip").distinct()
        base = {k: v.join(only, "mip", "left_semi") for k, v in base.items()}
        return runner.finalize(profile, self.config, family, base=base, **options)
