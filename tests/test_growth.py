"""What a query does a path must grow with the path, and give what the plain form gives."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from thalweg.config import GeometryConfig
from thalweg.operators import centerline, features, geometry, graph, network, noding, support, windows
from thalweg.plans import queries, runner, standin

COLUMNS = "reach_id main_path_id is_mainstem rch_id_dn reach_len width n_chan".split()


def _stem(n, loops, rng=None):
    """A main stem of n reaches with side loops; with rng also ways back, so that some run in a circle."""
    down = {k: [k + 1] if k < n - 1 else [] for k in range(n)}
    for j, a in enumerate(loops):
        x, y = 10_000 + 2 * j, 10_001 + 2 * j
        b = min(n - 1, a + 4) if rng is None else rng.randrange(n)
        down[a] = [*down[a], x]
        down[x], down[y] = [y], [b]
    rows = [(i, 7, i < n, d, 100.0, 50.0, 1.0) for i, d in down.items()]
    return pd.DataFrame(rows, columns=COLUMNS).assign(mip=7)


def test_side_channels_walk_a_path_a_few_times_however_many_components_it_has(monkeypatch):
    seen, out = [], graph.Network.out

    def counted(self, ids):
        ids = list(ids)
        seen.append(len(ids))
        return out(self, ids)

    monkeypatch.setattr(graph.Network, "out", counted)
    rows = _stem(800, range(3, 790, 8))
    found = graph.enrich(rows)
    assert len(found) == 3 * 99 and set(found["status"]) == {"ok"} and set(found["k_max"]) == {2}
    assert sum(seen) < 6 * len(rows)


def test_corridors_of_a_path_are_what_the_source_reaches_and_what_reaches_the_sink():
    turned = 0
    for seed in range(60):
        rng = random.Random(seed)
        net = graph.Network(_stem(rng.randrange(6, 30), [rng.randrange(5) for _ in range(3)], rng))
        order = net.main_order()
        held, every = graph.Corridors(net, order), net.out(net.reach)
        turned += len(held.turned)
        for s in range(0, len(order), 2):
            for t in range(s + 1, len(order), 2):
                inside = graph.reachable(order[s], every) & graph.reachable(order[t], graph.reverse(every))
                assert held.between(order[s], order[t]) == {i for i, (u, v) in net.edges.items() if u in inside and v in inside}
    assert turned


def _many(paths):
    rows = []
    for mip in range(paths):
        rng = random.Random(100 + mip)
        n, base = rng.randrange(3, 40), mip * 100_000
        part = _stem(n, [rng.randrange(n - 1) for _ in range(rng.randrange(6))])
        rows += [(base + r.reach_id, mip, r.is_mainstem, [base + x for x in r.rch_id_dn] + ([None, 0] if mip % 2 else []), r.reach_len, r.width) for r in part.itertuples()]
    rows += [(*r[:2], None, None, *r[4:]) for r in rows[::29]] + [(*r[:3], [5, *r[3]], *r[4:]) for r in rows[::31]]
    return rows + [(9 * 100_000 + 77, 9, True, [9 * 100_000 + 78], 1.0, 1.0), (9 * 100_000 + 78, 9, True, [9 * 100_000 + 77], 1.0, 1.0)]


def test_networks_are_the_same_by_path_and_by_rounds_and_paths_in_tasks_settle_no_rounds(spark, monkeypatch):
    reaches = spark.createDataFrame(_many(24), "reach_id long, main_path_id long, is_mainstem boolean, rch_id_dn array<long>, reach_len double, width double").repartition(3)
    settled, settle = [], network.settle
    monkeypatch.setattr(network, "settle", lambda df: settled.append(1) or settle(df))

    def found():
        large = network.large_paths(reaches, "main_path_id")
        net = network.junctions(reaches, large)
        tables = [net, network.side_components(net, large), network.corridors(net, large=large)]
        return [sorted(map(tuple, t.collect())) for t in tables]

    own = found()
    assert len(settled) == 1 and all(map(len, own))
    for limit in (20,):  # larger paths by rounds
        monkeypatch.setattr(network, "IN_TASK", limit)
        assert found() == own


def test_the_smoother_holds_a_few_lines_at_once_however_many_a_batch_has(spark):
    at = F.sequence(F.lit(0), F.lit(40) + F.col("id").cast("int") % 5)
    lines = spark.range(400, numPartitions=1).select(F.col("id").alias("mip"), F.transform(at, lambda k: F.struct((100.0 * k).alias("x"), (30.0 * (k % 3)).alias("y"))).alias("line"))
    df = centerline.smooth_mainpaths(lines.where("mip % 50 <> 7"), 100.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan
    got = {r["mip"]: r for r in df.collect()}
    assert len(got) == 392
    for mip in (0, 63, 64, 399):
        own = lines.where(F.col("mip") == mip).first()["line"]
        want = centerline.simplest_similar(centerline.as_points(own), 100.0)
        assert (got[mip]["sigma_m"], got[mip]["status"]) == (want["sigma_m"], want["status"])
        assert [(p["x"], p["y"]) for p in got[mip]["line"]] == [tuple(p) for p in want["line"].tolist()]


class _Counted(np.ndarray):
    looked = 0

    def __ge__(self, other):
        _Counted.looked += len(self)
        return np.asarray(self) >= other


def test_stretches_of_a_line_are_smoothed_without_a_look_at_all_its_points():
    rng = np.random.default_rng(4)
    d, xy = geometry.sample(np.cumsum(rng.normal(60, 20, (90, 2)), axis=0))
    borders = np.linspace(0, d[-1], 61)
    groups = [(float(a), float(b), float(w)) for a, b, w in zip(borders, borders[1:], rng.uniform(1, 900, 60))]
    config = GeometryConfig()
    _Counted.looked = 0
    got = geometry.smooth_by_width(xy, d.view(_Counted), groups, config)
    assert _Counted.looked < 3 * len(d)
    total, weight = np.zeros_like(xy), np.zeros(len(xy))
    for lo, hi, width in groups:
        blend = min(5 * config.step_m if config.blend_m is None else config.blend_m, (hi - lo) / 2)
        at = np.flatnonzero((d >= lo - blend) & (d <= hi + blend))
        if len(at) >= 3:
            sigma = np.clip(config.sigma_width_fraction * width, config.sigma_min_m, config.sigma_max_m)
            w = np.clip(1 - np.maximum(np.maximum(lo - d[at], d[at] - hi), 0) / blend, 0, 1)
            total[at] += geometry.smooth_gaussian(xy[at], float(sigma), config.step_m) * w[:, None]
            weight[at] += w
    want = np.where(weight[:, None] > 0, total / np.where(weight > 0, weight, 1)[:, None], xy)
    want[0], want[-1] = xy[0], xy[-1]
    assert np.array_equal(got, want)


def test_medians_of_few_and_many_numbers_are_numpys():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 64, 65, 200):
        x = rng.normal(size=n)
        assert geometry.median_of(x) == np.median(x)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_are_dealt_once_and_their_windows_planned_once(spark):
    profile = standin.short(spark, "/root/testdata/sf0.001")
    assert _plan(windows.path_facts(profile, queries.FIXED)).count("Exchange hashpartitioning") == 1
    base = runner.base_tables(profile, queries.SMALL)
    for table in ("plan", "windows"):
        plan = _plan(base[table])
        assert "Window [" not in plan and "FileScan" not in plan
    assert "Expand" not in _plan(base["support"])


def test_clusters_keep_their_penalties_by_window(spark):
    runs = spark.createDataFrame(
        [(1, "w2", w, label, p, b) for w, label, p, b in [(2000.0, "W2km", 1.0, [500.0, 5000.0]), (1000.0, "W1km", 2.0, [600.0]), (1000.0, "W1km", 1.0, [550.0, 620.0]), (1000.0, "W1km", 5.0, [])]],
        "mip long, family string, window_m double, window_label string, penalty double, break_m array<double>",
    )
    one, two = support.support_table(runs, 1000.0).orderBy("cluster_id").collect()
    assert (one["support_by_window"], one["support_counts_by_window"]) == ({"W1km": [1.0, 2.0], "W2km": [1.0]}, {"W1km": 3, "W2km": 1})
    assert (one["n_windows_supported"], one["n_penalties_supported"], one["n_run_pairs_supported"], one["runs_total"], one["windows_total"]) == (2, 2, 3, 4, 2)
    assert (two["support_by_window"], two["support_counts_by_window"], two["support_runs"]) == ({"W2km": [1.0]}, {"W2km": 1}, 0.25)


def test_quantiles_of_a_frame_are_those_of_percentile_without_its_table(spark):
    value = F.when(F.col("id") % 7 != 3, F.round(F.sin("id") * 20) / 10)
    rows = spark.range(300).select((F.col("id") % 5).alias("mip"), F.lit(1.0).alias("window_m"), F.floor(F.col("id") / 5).cast("int").alias("pos"), (1 + F.col("id") % 5).alias("half"), value.alias("v"))
    w = features.frame()
    for how, q in (("median", 0.5), ("p90", 0.9)):
        assert "percentile" not in _plan(rows.select(features.rolling(F.col("v"), how, w)))
        both = rows.select(features.rolling(F.col("v"), how, w, 1).alias("a"), F.percentile("v", F.lit(q)).over(w).alias("b"))
        assert both.where("not (a <=> b)").count() == 0 and both.where("a is not null").count() > 250


def _along_axes(rng, n, size, longest):
    """n lines along two axes, which cross, touch and overlap."""
    a = rng.integers(0, size, (n, 2)).astype(float)
    b = a.copy()
    b[np.arange(n), rng.integers(0, 2, n)] += rng.choice([-1, 1], n) * rng.integers(1, longest, n)
    return [np.array(ends) for ends in zip(a, b)]


def _network(net):
    """A network's places and pieces, in whichever order they came."""
    of = [tuple(p) for p in np.round(net.points, 6).tolist()]
    pieces = [(*sorted((of[x], of[y])), len(p), round(float(geometry.along(p)[-1]), 6)) for (x, y), p in zip(net.ends.tolist(), net.pieces)]
    return sorted(of), sorted(pieces), net.cycle_rank(), round(net.length(), 6)


def test_lines_that_lie_on_each_other_are_not_compared_pair_by_pair(monkeypatch):
    seen, found = [], noding.box_pairs

    def counted(*args):
        for i, j in found(*args):
            seen.append(len(i))
            yield i, j

    monkeypatch.setattr(noding, "box_pairs", counted)
    lines = [np.array([[x, 10.0 * y], [x + 9, 10.0 * y]]) for x in range(60) for y in range(7)] + [np.array([[5.0 * x, y], [5.0 * x, y + 20]]) for x in range(12) for y in range(50)]
    net = noding.node_lines(lines)
    assert net.length() == 7 * 68 + 12 * 69 and net.cycle_rank() == 11 * 6
    assert sum(seen) < len(lines)


def test_lines_made_one_give_the_network_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    whole = noding._united
    for k in range(120):
        parts = _along_axes(rng, 30, 12, 7)
        if k % 3 == 1:  # others that run across
            parts += [np.array([p, p + [rng.choice([-1, 1]), 9]]) for p in rng.integers(0, 12, (3, 2)).astype(float)]
        if k % 3 == 2:  # others of several points, which run along too
            parts += [np.cumsum(rng.integers(-2, 3, (5, 2)) * rng.choice([0, 1], (5, 2)), axis=0) + 6.0 for _ in range(3)]
        one = _network(noding.node_lines(parts))
        monkeypatch.setattr(noding, "_united", lambda a, b, may, *rest: whole(a, b, may & False, *rest))
        assert one == _network(noding.node_lines(parts))
        monkeypatch.setattr(noding, "_united", whole)


def test_places_are_those_of_one_point_after_the_other():
    rng = np.random.default_rng(4)
    for _ in range(200):
        p = rng.integers(0, 4, (40, 2)) + rng.choice([0, 0, 5e-7, 1.1e-6, 1.9e-6, 3e-6, 5e-6], (40, 2))
        at, want = [], []
        for q in p:
            near = [k for k, r in enumerate(at) if np.hypot(*(r - q)) <= 2e-6]
            want.append(near[0] if near else len(at))
            at += [] if near else [q]
        found, points = noding.places(p, 1e-6)
        assert found.tolist() == want and (points == np.array(at)).all()


def test_networks_of_paths_are_read_in_arrow_batches_whole_also_without_lines(spark):
    rng = np.random.default_rng(5)
    paths = {k: _along_axes(rng, 20, 12, 7) for k in range(40)}
    rows = [(k, [(float(x), float(y)) for x, y in p]) for k, lines in paths.items() for p in lines] + [(99, None), (98, []), (98, [(1.0, 2.0)]), (0, None), (None, [(0.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, "main_path_id long, line array<struct<x:double,y:double>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = centerline.noded(df)
        assert "InArrow" in _plan(made) and "InPandas" not in _plan(made)
        got = {r[0]: tuple(r)[1:] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == {*paths, 98, 99} and got[98] == got[99] == (0, 0, 0, 0, 0, 0.0)
    for k, lines in paths.items():
        net = noding.node_lines(lines)
        assert got[k][:4] == (len(net.points), len(net.pieces), len(set(net.components())), net.cycle_rank()) and abs(got[k][5] - net.length()) < 1e-9


def test_paths_noded_at_once_are_as_each_alone(spark, monkeypatch):
    rng = np.random.default_rng(6)
    parts = [[*_along_axes(rng, 25, 12, 7), *(rng.uniform(0, 12, (rng.integers(2, 5), 2)) for _ in range(k % 3))] for k in range(30)]
    made, whole = [], noding.node_points
    xy = np.concatenate([p for lines in parts for p in lines])
    line = np.repeat(np.arange(sum(map(len, parts))), [len(p) for lines in parts for p in lines])
    path = np.repeat(np.arange(30), [sum(map(len, lines)) for lines in parts])
    got = np.stack(noding.figures(xy, line, path, 31), axis=1)
    assert got[30].tolist() == [0] * 6
    for k, lines in enumerate(parts):
        net = noding.node_lines(lines)
        degree = np.bincount(net.ends.reshape(-1))
        want = [len(net.points), len(net.pieces), len(set(net.components())), net.cycle_rank(), (degree == 1).sum(), net.length()]
        assert got[k, :5].tolist() == want[:5] and abs(got[k, 5] - want[5]) < 1e-9
    rows = [(k, [tuple(map(float, p)) for p in line]) for k, lines in enumerate(parts) for line in lines]
    df = spark.createDataFrame(rows, "main_path_id long, line array<struct<x:double,y:double>>")
    run = centerline.noded(df).collect()
    assert {r[0]: r[1] for r in run} == {k: int(n) for k, n in enumerate(got[:30, 0])}
    # Many paths take few calls.
    monkeypatch.setattr(noding, "node_points", lambda *a: made.append(1) or whole(*a))
    monkeypatch.setattr(centerline, "figures", noding.figures)
    batch = pa.RecordBatch.from_pylist([{"main_path_id": k, "line": [{"x": x, "y": y} for x, y in line]} for k, line in rows])
    for points, calls in ((1 << 15, 3), (1, 30)):  # one for each batch, and one for the last path
        monkeypatch.setattr(centerline, "POINTS", points)
        made.clear()
        out = pa.Table.from_batches(list(centerline.node_batches([batch.slice(0, 100), batch.slice(100)], 1e-6)))
        assert len(made) == calls and out["n_nodes"].to_pylist() == got[:30, 0].tolist()


def test_lines_without_a_coordinate_leave_the_others_as_they_are():
    lone = [np.array([[0.0, 0], [10, 0]]), np.array([[5.0, -1], [5, 2]])]
    for lost in (np.array([[5, -1], [5, np.nan]]), np.array([[2, 0], [np.nan, 0]]), np.array([[np.nan, np.nan], [1, 0]])):
        assert _network(noding.node_lines([*lone, lost]))[1] == _network(noding.node_lines(lone))[1]
    net = noding.node_lines([*lone, np.array([[0, 7], [np.inf, 7]])])
    assert len(net.pieces) == 5 and np.isinf(net.length()) and sorted(net.lengths())[:4] == [1, 2, 5, 5]
