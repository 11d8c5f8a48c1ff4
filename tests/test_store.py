"""The base on disk: shared by finals, completed after an interruption, read without an exchange."""

import pytest
from pyspark.sql import functions as F

from thalweg.plans import queries, runner, store

import numpy as np


@pytest.fixture(scope="module")
def profile(spark):
    rng = np.random.default_rng(5)
    rows = [(m, k, m * 1000 + k, 200.0 * (k + 1), float(50 + 80 * ((k // 20 + m) % 2) + rng.normal(scale=5)), float(1 + k % 3)) for m in range(8) for k in range(70)]
    df = spark.createDataFrame(rows, "mip long, pos int, node_id long, dist_m double, width double, n_channels double")
    none = F.lit(None).cast("double")
    return df.select("mip", "pos", "node_id", F.lit(None).cast("long").alias("reach_id"), "dist_m", "width", "n_channels", none.alias("wse"), none.alias("x"), none.alias("y"))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_an_interrupted_base_is_completed(spark, profile, tmp_path, monkeypatch):
    folder = f"file:{tmp_path}/base"
    base = store.Base(spark, folder, queries.SMALL, 4)
    assert base.finished().count() == 0
    with pytest.raises(FileNotFoundError):
        base.tables()
    put, count = store.Base._put, []

    def broken(self, table, df, batch):
        count.append(table)
        if len(count) == 8:  # in the second batch, with two of its tables written
            raise RuntimeError("lost")
        put(self, table, df, batch)

    monkeypatch.setattr(store.Base, "_put", broken)
    with pytest.raises(RuntimeError):
        base.complete(profile, 3)
    monkeypatch.setattr(store.Base, "_put", put)
    done = {r["mip"] for r in base.finished().collect()}
    assert 0 < len(done) < 8 and {r["mip"] for r in base.tables()["z"].select("mip").distinct().collect()} == done
    for table in (*store.TABLES, store.FINISHED):  # a session that does not know the tables
        spark.sql(f"DROP TABLE IF EXISTS {base._name(table)}")
    again = store.Base(spark, folder, queries.SMALL, 4)
    assert again.complete(profile, 2) == 8 - len(done)
    assert again.complete(profile, 2) == 0
    whole = runner.base_tables(profile, queries.SMALL)
    got = again.tables()
    for table in store.TABLES:
        assert rows(got[table].select(sorted(got[table].columns))) == rows(whole[table].select(sorted(whole[table].columns))), table
    final = again.finalize(profile, "w2", threshold_m=1500.0)
    want = runner.finalize(profile, queries.SMALL, "w2", threshold_m=1500.0)
    assert rows(final["segments"]) == rows(want["segments"]) and final["segments"].count() > 8
    part = again.finalize(profile.where("mip < 3"), "w2", threshold_m=1500.0)["segments"]
    assert rows(part) == rows(want["segments"].where("mip < 3"))


def test_reads_of_a_base_need_no_exchange_by_path(spark, profile, tmp_path):
    base = store.Base(spark, f"file:{tmp_path}/base", queries.SMALL, 4)
    base.complete(profile)
    made = base.tables()
    plan = made["z"].groupBy("mip", "window_m").agg(F.avg("width"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        plan = made["windows"].join(made["z"], ["mip", "window_m"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    finally:
        for k in options:
            spark.conf.unset(k)
