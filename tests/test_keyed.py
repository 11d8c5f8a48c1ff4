"""Keyed networks, alignment by distance and the table function, against kernels and plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thalweg.operators import centerline, changepoint, features, graph, network

REACHES = "reach_id long, main_path_id long, is_mainstem boolean, rch_id_dn array<long>, reach_len double, width double"


def _network(paths):
    rows = []
    for mip in range(paths):
        rng = random.Random(mip)
        n, base, new = rng.randrange(4, 40), mip * 1000, mip * 1000 + 500
        down = {base + k: [base + k + 1] if k < n - 1 else [] for k in range(n)}
        main = set(down)
        for _ in range(rng.randrange(7)):
            a = rng.randrange(n - 1)
            ids = list(range(new, new + rng.randrange(1, 4)))
            new += len(ids)
            down[base + a].append(ids[0])
            down |= {x: [y] for x, y in zip(ids, ids[1:])}
            b = min(n - 1, a + rng.randrange(1, 9))
            down[ids[-1]] = [base + b] if rng.random() < 0.9 else [0]
            if rng.random() < 0.3:  # a branch of the side channel
                down[new] = [base + b]
                down[ids[0]] = down[ids[0]] + [new]
                new += 1
        rows += [(i, mip, i in main, d, 100.0, 50.0) for i, d in down.items()]
    return rows


def test_components_and_corridors_are_those_of_the_kernel(spark):
    rows = _network(25)
    net = network.junctions(spark.createDataFrame([*rows, rows[0], (5, None, True, [6], 1.0, 1.0), (None, 3, True, [6], 1.0, 1.0)], REACHES).repartition(3))
    components = network.side_components(net)
    parts, between = {}, {}
    for r in components.collect():
        parts.setdefault((r["mip"], r["component"]), set()).add(r["node"])
    for r in network.corridors(net, None, components).collect():
        between.setdefault((r["mip"], r["component"]), set()).add(r["reach_id"])
    ends = {r["reach_id"]: (r["u"], r["v"]) for r in net.collect()}
    table = pd.DataFrame(rows, columns=[c.split()[0] for c in REACHES.split(", ")])
    seen = 0
    for mip, part in table.groupby("main_path_id"):
        own = graph.Network(part)
        name = {n: ends[i][k] for i, uv in own.edges.items() for k, n in enumerate(uv)}
        found = own.components()
        assert {c: s for (m, c), s in parts.items() if m == mip} == {min(name[n] for n in nodes): {name[n] for n in nodes} for nodes, _ in found}
        at = {n: k for k, n in enumerate(own.main_order())}
        for nodes, side in found:
            key = (mip, min(name[n] for n in nodes))
            starts, stops = {own.edges[i][0] for i in side}, {own.edges[i][1] for i in side}
            splits = sorted(at[n] for n in nodes if n in at and n in starts)
            merges = sorted(at[n] for n in nodes if n in at and n in stops and splits and at[n] > splits[0])
            if not merges:
                assert key not in between
                continue
            place = {k: n for n, k in at.items()}
            every = own.out(own.reach)
            inside = graph.reachable(place[splits[0]], every) & graph.reachable(place[merges[-1]], graph.reverse(every))
            assert between[key] == {i for i, (u, v) in own.edges.items() if u in inside and v in inside}
            seen += 1
    assert seen > 20
    none = network.junctions(spark.createDataFrame([], REACHES))
    assert network.side_components(none).count() == 0 and network.corridors(none).count() == 0


def test_labels_of_a_long_chain_take_few_rounds(spark):
    edges = spark.range(3000).select(F.lit(1).alias("mip"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = network.min_labels(edges).groupBy("label").count().collect()
    assert [tuple(r) for r in got] == [(0, 3001)]


def _by_hand(dist, ext_dist, ext):
    ext = np.array([np.nan if v is None else v for v in ext], dtype=float)
    order = np.argsort(ext_dist, kind="stable")
    ext_dist, ext = np.array(ext_dist, dtype=float)[order], ext[order]
    if len(dist) == len(ext_dist) and np.allclose(dist, ext_dist, rtol=0, atol=1e-6):
        return ext
    known = np.isfinite(ext)
    if known.sum() == 1:
        return np.full(len(dist), ext[known][0])
    if not known.any():
        return np.full(len(dist), np.nan)
    return np.interp(dist, ext_dist[known], ext[known], left=np.nan, right=np.nan)


def test_external_features_are_aligned_by_distance(spark):
    rng = np.random.default_rng(6)
    points, external, want = [], [], {}
    for mip in range(24):
        n = int(rng.integers(1, 30))
        dist = np.cumsum(rng.uniform(50, 250, n))
        m = n if mip % 3 == 0 else int(rng.integers(0, 12))
        at = dist + rng.uniform(-4e-7, 4e-7, n) if mip % 3 == 0 else np.unique(np.append(rng.uniform(0, dist[-1] * 1.2, m), rng.choice(dist, min(n, m // 3))))
        value = [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(v) for v in rng.normal(size=len(at))]
        points += [(mip, 1.0, k, float(d)) for k, d in enumerate(dist)]
        external += [(mip, 1.0, float(d), v) for d, v in zip(at, value)]
        want[mip] = _by_hand(dist, at, value)
    p = spark.createDataFrame(points, "mip long, window_m double, pos int, dist_m double").repartition(3)
    e = spark.createDataFrame(external, "mip long, window_m double, dist_m double, sinuosity double").repartition(3)
    got = features.aligned(p, e, "sinuosity").toPandas()
    assert len(got) == len(points)
    for mip, part in got.groupby("mip"):
        assert np.allclose(part.sort_values("pos")["sinuosity"].to_numpy(dtype=float), want[mip], equal_nan=True)
    assert features.aligned(p.limit(0), e, "sinuosity").count() == 0
    plan = features.aligned(p, e, "sinuosity")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # windows over one union


def test_change_points_from_sql(spark):
    rng = np.random.default_rng(3)
    rows = [(m, w, k, 200.0 * k, int(w), float(rng.normal() + (k // 12) * (m % 3)), float(rng.normal())) for m in range(6) for w in (3.0, 6.0) for k in range(int(rng.integers(2, 70)))]
    table = spark.createDataFrame(rows, "mip long, window_m double, pos int, dist_m double, window_pts int, width double, slope double").repartition(4)
    table.createOrReplaceTempView("sql_rows")
    changepoint.register(spark, "breaks_of", [1.0, 4.0, 20.0])
    got = spark.sql("SELECT * FROM breaks_of(TABLE(SELECT * FROM sql_rows) PARTITION BY (mip, window_m) ORDER BY pos)").collect()
    want = changepoint.sweep(table, ["width", "slope"], [1.0, 4.0, 20.0])
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and len(got) == 36
    joined = spark.sql("""
      SELECT p.mip, count(*) AS n FROM (SELECT DISTINCT mip FROM sql_rows) p
      JOIN breaks_of(TABLE(SELECT * FROM sql_rows) PARTITION BY (mip, window_m) ORDER BY pos) b ON b.mip = p.mip GROUP BY p.mip""")
    assert sorted(tuple(r) for r in joined.collect()) == [(m, 6) for m in range(6)]


def test_merged_lines_of_paths(spark):
    xy = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    rows = [
        (1, 11, 0.0, True, xy((0, 0), (60, 0))), (1, 12, 1.0, True, xy((40, 0), (100, 0))), (1, 13, 2.0, None, xy((0, 9), (9, 9))),
        (2, 21, 0.0, True, xy((0, 0), (50, 0), (100, 0))), (2, 22, 1.0, True, xy((103, 0), (150, 0), (200, 0))), (3, 31, 0.0, True, None), (None, 41, 0.0, True, xy((0, 0), (1, 1))),
    ]
    reaches = spark.createDataFrame(rows, "main_path_id long, reach_id long, dist_out double, is_mainstem boolean, geometry array<struct<x:double,y:double>>")
    got = {r["main_path_id"]: r for r in centerline.merge_mainpaths(reaches).collect()}
    assert {k: (r["status"], r["merged_length_m"], r["n_snapped"]) for k, r in got.items()} == {1: ("ok", 100.0, 0), 2: ("ok", 200.0, 2), 3: ("empty", 0.0, 0)}
    assert got[1]["removed_m"] == 20 and got[1]["loss_fraction"] == pytest.approx(1 / 6)
    ends = centerline.endpoint_diagnostics(reaches).where("main_path_id = 2").collect()
    assert {(r["x"], r["status"], r["moved_to_x"]) for r in ends} == {(0.0, "outer", None), (100.0, "snapped_to_end", 101.5), (103.0, "snapped_to_end", 101.5), (200.0, "outer", None)}
    assert [r["fault"] for r in centerline.line_faults(centerline.merge_mainpaths(reaches), reaches).orderBy("main_path_id").collect()] == ["length_lost", "empty_line"]


def test_paths_go_on_from_batch_to_batch(spark):
    """Many paths stand in one Arrow batch, and one that is cut by the end of a batch is put together again."""
    line = lambda m, k: [{"x": 1000.0 * k + 3 * (k % 2) + 100 * i, "y": float(m)} for i in range(10)]
    rows = [(m, 100 * m + k, float(k % 3), True, None if m == 4 and k == 2 else line(m, k)) for m in range(1, 10) for k in range(m)]
    schema = "main_path_id long, reach_id long, dist_out double, is_mainstem boolean, geometry array<struct<x:double,y:double>>"
    reaches = spark.createDataFrame(rows, schema)
    of = lambda: [sorted(map(repr, f(reaches).collect())) for f in (centerline.merge_mainpaths, centerline.endpoint_diagnostics)]
    whole = of()
    assert len(whole[0]) == 9 and "GroupsInPandas" not in centerline.merge_mainpaths(reaches)._jdf.queryExecution().toString()
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert of() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
