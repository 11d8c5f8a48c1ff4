import itertools

import numpy as np
import pandas as pd
import pytest

from thalweg import config
from thalweg.operators import centerline, changepoint, gaps, geometry, graph, noding, selection


def brute(x, pen, least, jump):
    n = len(x)
    grid = [g for g in range(jump, n, jump)]
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum()
    best = None
    for k in range(0, 4):
        for cuts in itertools.combinations(grid, k):
            edges = [0, *cuts, n]
            if min(np.diff(edges)) < least:
                continue
            c = sum(cost(a, b) for a, b in zip(edges, edges[1:])) + pen * k
            if best is None or c < best - 1e-9:
                best = c
    return best


@pytest.mark.parametrize("seed,jump,least", [(0, 1, 3), (1, 2, 4), (2, 5, 5)])
def test_change_points_are_exact(seed, jump, least):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 0.3, (7, 2)) for m in (0, 3, 1)])[:20]
    for pen, breaks in zip((8.0, 20.0), changepoint.solve(x, (8.0, 20.0), least, jump)):
        edges = [0, *breaks, len(x)]
        assert min(np.diff(edges)) >= least and all(b % jump == 0 for b in breaks)
        got = sum(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum() for a, b in zip(edges, edges[1:])) + pen * len(breaks)
        assert got == pytest.approx(brute(x, pen, least, jump))


def test_step_constant_and_short():
    step = np.array([[10.0]] * 30 + [[100.0]] * 30)
    assert changepoint.solve(step, [5.0], 3, 1) == [[30]] and changepoint.solve(step, [5.0], 3, 5) == [[30]]
    assert changepoint.solve(np.ones((40, 1)), [1.0], 5) == [[]]
    assert changepoint.solve(step[:5], [1.0], 3) == [[]]


def test_greedy_matches_direct_errors():
    rng = np.random.default_rng(5)
    dist = np.arange(1, 61) * 200.0
    tables = [np.repeat(rng.normal(0, 2, (6, 2)), 10, axis=0) + rng.normal(0, 0.2, (60, 2)) for _ in range(2)]
    positions = dist[[5, 10, 20, 30, 40, 50, 55]]
    cfg = config.SelectionConfig(min_spacing_m=1500.0, stop_relative=0.01)
    base, made = selection.greedy(selection.Profile(dist, tables), positions, cfg)

    def error(breaks):
        edges = [0, *np.searchsorted(dist, sorted(breaks)), 60]
        return sum(((t[a:b] - t[a:b].mean(axis=0)) ** 2).sum() for t in tables for a, b in zip(edges, edges[1:]))

    chosen, now = [], error([])
    assert base == pytest.approx(now)
    for m, after, gain in made:
        options = [(now - error([*chosen, c]), -c) for c in positions if c not in chosen and all(abs(c - b) >= 1500 for b in chosen)]
        best = max(options)
        assert gain == pytest.approx(best[0]) and after == pytest.approx(now - best[0])
        chosen.append(m)
        now = error(chosen)
    assert selection.prefix(base, made, 1.0, 0.0) == 0 and selection.prefix(base, made, 0.0, 0.0) == len(made)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_ends_where_every_stop_rule_has(seed):
    rng = np.random.default_rng(seed)
    dist = 200.0 * np.arange(80)
    profile = selection.Profile(dist, [rng.normal(0, 1, (80, 2)) + np.repeat(rng.normal(0, 2, 8), 10)[:, None]])
    rules = config.SelectionConfig(min_spacing_m=400.0, stop_absolute=1.0)
    base, every = selection.greedy(profile, dist[2:78:2], rules)
    some = selection.greedy(profile, dist[2:78:2], rules, 0.05)[1]
    assert len(some) < len(every) and some == every[: len(some)]
    for stop in (0.05, 0.06, 0.2, 0.9):
        assert selection.prefix(base, some, stop, 1.0) == selection.prefix(base, every, stop, 1.0)


def test_greedy_rules():
    dist = np.arange(1, 101) * 1000.0
    x = np.repeat([[0.0], [5.0], [0.0], [5.0]], 25, axis=0)
    p = selection.Profile(dist, [x])
    near = selection.greedy(p, np.array([26000.0, 35900.0, 51000.0]), config.SelectionConfig(min_spacing_m=10_000.0))[1]
    assert 35900.0 not in [m for m, _, _ in near[:1]]
    exact = selection.greedy(p, np.array([26000.0, 36000.0]), config.SelectionConfig(min_spacing_m=10_000.0))[1]
    assert len(exact) == 2
    assert selection.greedy(p, np.array([26000.0]), config.SelectionConfig(min_reach_m=30_000.0))[1] == []
    assert len(selection.greedy(p, np.array([26000.0, 51000.0, 76000.0]), config.SelectionConfig(max_breaks=1))[1]) == 1


def network(rows):
    return pd.DataFrame([{"mip": 1, "reach_id": i, "is_mainstem": m, "rch_id_dn": dn, "reach_len": 1000.0, "width": w, "n_chan": 1.0} for i, m, dn, w in rows])


def test_one_loop_makes_two_channels():
    rows = network([(1, True, [2, 4], 10.0), (2, True, [3], 10.0), (3, True, [], 10.0), (4, False, [5], 4.0), (5, False, [3], 4.0)])
    out = graph.enrich(rows)
    assert list(out["reach_id"]) == [2] and list(out["k_max"]) == [2]
    assert out["k_eff"].iloc[0] == 1.0 and out["width_extra"].iloc[0] == 4.0 and out["status"].iloc[0] == "ok"


def test_single_side_reach_and_bad_main_stem():
    assert len(graph.enrich(network([(1, True, [2], 1.0), (2, True, [], 1.0), (3, False, [2], 1.0)]))) == 0
    assert "source" in graph.enrich(network([(1, True, [], 1.0), (2, True, [], 1.0)]))["status"].iloc[0]


def test_best_way_and_cycle():
    out = {"a": [("b", 1), ("c", 2)], "b": [("d", 3)], "c": [("d", 4)]}
    assert graph.best_way(out, "a", "d", lambda i: 1.0) == [1, 3] and graph.best_way(out, "a", "d", float) == [2, 4]
    assert graph.best_way(out, "d", "a", float) is None
    with pytest.raises(ValueError):
        graph.depth({"a": [("b", 1)], "b": [("a", 2)]}, "a")


def test_ways_over_reaches_in_either_direction():
    # Reaches that part at p do not meet head to tail, but both meet the one that comes to p.
    edges = {1: ("a", "b"), 2: ("b", "c"), 3: ("p", "b"), 4: ("k", "p"), 5: ("p", "z")}
    assert graph.reach_ways(edges, "a", "z") == ([[1, 2, 3, 4, 5]], False)
    assert graph.reach_ways({1: ("a", "z")}, "a", "z") == ([[1]], False)
    many = {k: ("a", "b") for k in range(80)} | {100 + k: ("b", "z") for k in range(80)}
    assert graph.reach_ways(many, "a", "z", limit=10)[1]


def test_parallel_channels_of_a_loop_within_the_corridor():
    """Main stem of four reaches; beside it a way of three, from which a loop leaves that rejoins the main stem earlier."""
    rows = network([
        (1, True, [2, 11], 10.0), (2, True, [3], 10.0), (3, True, [4], 10.0), (4, True, [5], 10.0), (5, True, [], 10.0),
        (11, False, [12], 4.0), (12, False, [13], 4.0), (13, False, [5], 6.0),
    ])
    net = graph.Network(rows.assign(chan_sum=1.0, chan_nodes=1))
    source, sink = net.edges[2][0], net.edges[4][1]
    ids = {2, 3, 4, 11, 12, 13}
    assert graph.most_parallel(net, ids, source, sink) == 2
    # A third channel of one reach beside 12 stands in its slice only; depth of the sides stays three.
    rows = pd.concat([rows, network([(14, False, [13], 2.0)])], ignore_index=True)
    rows.at[5, "rch_id_dn"] = [12, 14]
    net = graph.Network(rows.assign(chan_sum=1.0, chan_nodes=1))
    assert graph.most_parallel(net, ids | {14}, source, sink) == 3
    out = graph.enrich(rows).set_index("reach_id")
    assert sorted(out.index) == [2, 3, 4] and set(out["k_max"]) == {3} and set(out["l_dominant"]) == {3000.0} and set(out["l_extra"]) == {1000.0}
    assert out["k_eff"].iloc[0] == 1.0 and out["width_extra"].iloc[0] == pytest.approx(4.0 + 1 / 3 * 2.0)


def test_channels_are_averaged_over_nodes():
    rows = network([(1, True, [2, 4], 10.0), (2, True, [3], 10.0), (3, True, [], 10.0), (4, False, [5], 4.0), (5, False, [3], 4.0)])
    rows = rows.drop(columns="n_chan").assign(chan_sum=[0.0, 0.0, 0.0, 6.0, 1.0], chan_nodes=[0, 0, 0, 2, 1])
    assert graph.enrich(rows)["k_eff"].iloc[0] == pytest.approx(7 / 3)


def test_smoothing_blends_by_stretch():
    rng = np.random.default_rng(0)
    xy = np.stack([np.arange(0, 400.0, 10), rng.normal(0, 5, 40)], axis=1)
    d = np.arange(40) * 10.0
    cfg = config.GeometryConfig(smoothing="piecewise", step_m=10.0, blend_m=50.0, sigma_width_fraction=1.0, sigma_min_m=1.0, sigma_max_m=100.0)
    groups = [(0.0, 200.0, 20.0), (200.0, 220.0, 30.0), (220.0, 390.0, 40.0)]
    got = geometry.smooth_by_width(xy, d, groups, cfg)
    total, weight = np.zeros_like(xy), np.zeros(40)
    for lo, hi, width in groups:  # by hand: the middle stretch blends over half of its 20 m
        blend = min(50.0, (hi - lo) / 2)
        at = [i for i in range(40) if lo - blend <= d[i] <= hi + blend]
        part = geometry.smooth_gaussian(xy[at], width, 10.0)
        for i, q in zip(at, part):
            w = 1.0 if lo <= d[i] <= hi else 1 - max(lo - d[i], d[i] - hi) / blend
            total[i] += w * q
            weight[i] += w
    want = total / weight[:, None]
    want[0], want[-1] = xy[0], xy[-1]
    assert np.allclose(got, want)


def test_circle_and_straight_line():
    t = np.linspace(0, np.pi, 2000)
    circle = np.stack([3000 * np.cos(t), 3000 * np.sin(t)], axis=1)
    d, xy = geometry.sample(circle, 10.0)
    assert np.median(geometry.curvature(xy, 10.0)) == pytest.approx(1 / 3000, rel=1e-2)
    line = np.array([[0.0, 0.0], [20_000.0, 0.0]])
    dist = np.arange(1, 99) * 200.0
    one = geometry.window_features(line, dist, np.full(98, 100.0), [2000.0])[0]
    assert np.allclose(one["sinuosity"], 1.0) and np.allclose(one["curvature"], 0.0)


def test_lines():
    xy = np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 10.0]])
    assert geometry.along(xy)[-1] == 20 and np.allclose(geometry.substring(xy, 5, 15), [[5, 0], [10, 0], [10, 5]])
    groups = geometry.width_groups(np.arange(6.0), np.array([10, 10, 11, 30, 31, np.nan]), 6.0, 0.2)
    assert [g[:2] for g in groups] == [(0.0, 2.5), (2.5, 6.0)]


def test_merge_closes_gaps_and_drops_loops():
    parts = [np.array([[0.0, 0.0], [100.0, 0.0]]), np.array([[103.0, 0.0], [200.0, 0.0]]), np.array([[200.0, 0.0], [300.0, 0.0]])]
    r = centerline.merge_path(parts, [0.0, 1.0, 2.0], gap=5.0)
    assert r["status"] == "ok" and r["terminals"] == "reach_order" and geometry.along(r["line"])[-1] == pytest.approx(300.0) and r["n_snapped"] == 2
    loop = np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [5.0, 10.0], [5.0, -10.0], [20.0, -10.0]])
    line, status, rank = centerline.repair(loop)
    assert geometry.along(line)[-1] == pytest.approx(5 + 10 + 15) and (status, rank) == ("repaired", 1)


def A(*points):
    return np.array(points, dtype=float)


@pytest.mark.parametrize(
    ("parts", "nodes", "edges", "rank", "length"),
    [
        ([A((0, 0), (60, 0)), A((40, 0), (100, 0))], 4, 3, 0, 100),  # an overlap
        ([A((0, 0), (60, 0)), A((100, 0), (40, 0))], 4, 3, 0, 100),
        ([A((0, 0), (10, 0)), A((5, 0), (5, 9))], 4, 3, 0, 19),  # a T
        ([A((0, 0), (10, 0)), A((5, -4), (5, 9))], 5, 4, 0, 23),  # a cross
        ([A((0, 0), (10, 0)), A((10, 0), (20, 5)), A((10, 0), (20, -5))], 4, 3, 0, 10 + 2 * 125**0.5),
        ([A((0, 0), (4, 0), (9, 3)), A((9, 3), (4, 0), (0, 0))], 3, 2, 0, 4 + 34**0.5),  # the same line twice
        ([A((0, 0), (10, 0), (5, 0))], 3, 2, 0, 10),  # a line that turns back
        ([A((0, 0), (10, 0), (5, 0), (5, 3))], 4, 3, 0, 13),
        ([A((0, 0), (4, 0), (9, 0)), A((-2, 0), (20, 0))], 5, 4, 0, 22),  # one inside another
        ([A((0, 0), (10, 10), (10, 0), (0, 10))], 3, 3, 1, 10 + 800**0.5),  # a figure-eight's half
        ([A((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))], 1, 1, 1, 16),
        ([A((0, 0), (4, 0)), A((10, 10), (11, 10))], 4, 2, 0, 5),
        ([A((1e7, 1e7), (1e7 + 60, 1e7 + 30)), A((1e7 + 40, 1e7 + 20), (1e7 + 100, 1e7 + 50))], 4, 3, 0, 12500**0.5),
    ],
)
def test_noding(parts, nodes, edges, rank, length):
    for order in (parts, parts[::-1], [p[::-1] for p in parts]):
        net = noding.node_lines(order)
        assert (len(net.points), len(net.pieces), net.cycle_rank()) == (nodes, edges, rank)
        assert net.length() == pytest.approx(length)
        joined = noding.chained(net)
        assert sum(geometry.along(p)[-1] for p in joined) == pytest.approx(length)
        again = noding.node_lines(joined)
        assert again.length() == pytest.approx(length) and again.cycle_rank() == rank


def test_noding_of_random_lines_is_by_hand():
    rng = np.random.default_rng(2)
    for _ in range(30):
        segments = rng.integers(0, 12, (25, 2, 2)).astype(float)
        segments = [s for s in segments if (s[0] != s[1]).any()]
        net = noding.node_lines(segments)
        want = set()
        from fractions import Fraction as Q

        def meet(p, q):  # points that two segments share, exactly
            (x1, y1), (x2, y2), (x3, y3), (x4, y4) = [[Q(int(v)) for v in e] for e in (*p, *q)]
            d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
            on = lambda x, y, a: (a[1][0] - a[0][0]) * (y - int(a[0][1])) == (a[1][1] - a[0][1]) * (x - int(a[0][0])) and min(a[0][0], a[1][0]) <= x <= max(a[0][0], a[1][0]) and min(a[0][1], a[1][1]) <= y <= max(a[0][1], a[1][1])
            found = {(Q(int(x)), Q(int(y))) for s, t in ((p, q), (q, p)) for x, y in s if on(Q(int(x)), Q(int(y)), t)}
            if d:
                u = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / d
                v = ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / d
                if 0 <= u <= 1 and 0 <= v <= 1:
                    found.add((x1 + u * (x2 - x1), y1 + u * (y2 - y1)))
            return found

        edges = set()
        on_each = [set() for _ in segments]
        for i, p in enumerate(segments):
            on_each[i] |= {tuple(Q(int(v)) for v in e) for e in p}
            for j, q in enumerate(segments):
                if i != j:
                    on_each[i] |= meet(p, q)
        for points in on_each:
            want |= points
            ordered = sorted(points)
            edges |= set(zip(ordered, ordered[1:]))
        assert len(net.points) == len(want) and len(net.pieces) == len(edges)


def test_overlapping_reaches_keep_their_length():
    r = centerline.merge_path([A((0, 0), (60, 0)), A((40, 0), (100, 0))], [0.0, 1.0])
    assert r["status"] == "ok" and geometry.along(r["line"])[-1] == 100
    doubled = centerline.merge_path([A((0, 0), (50, 0), (100, 0)), A((0, 0), (50, 0), (100, 0)), A((100, 0), (150, 0))], [0.0, 1.0, 2.0])
    assert doubled["status"] == "ok" and geometry.along(doubled["line"])[-1] == 150
    tee = centerline.merge_path([A((0, 0), (100, 0)), A((100, -50), (100, 50))], [0.0, 1.0])
    assert tee["status"] == "ok" and geometry.along(tee["line"])[-1] == 150


def test_statuses_of_a_merged_line():
    apart = centerline.merge_path([A((0, 0), (60, 0)), A((400, 0), (900, 0))], [0.0, 1.0])
    assert (apart["status"], apart["terminals"], apart["n_components"]) == ("other_terminals", "longest_pair", 2)
    assert geometry.along(apart["line"])[-1] == 500
    ring = centerline.merge_path([A((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))], [0.0])
    assert ring["status"] == "only_closed_pieces" and ring["cycle_rank"] == 1 and ring["repair"] == "closed"
    assert centerline.merge_path([], [])["status"] == "empty"
    ladder = [(0, 0)]
    for k in range(6):
        ladder += [(10 * k + 6, 0), (10 * k + 6, 3), (10 * k + 3, 3), (10 * k + 3, -2), (10 * k + 8, -2), (10 * k + 8, 0)]
    ladder = A(*ladder, (80, 0))
    line, status, rank = centerline.repair(ladder)
    assert (status, rank) == ("too_many_cycles", 6) and line is ladder
    line, status, rank = centerline.repair(ladder, max_cycles=6)
    assert (status, rank) == ("repaired", 6) and geometry.along(line)[-1] == 104
    assert centerline.repair(ladder, max_vertices=20)[1:] == ("too_many_vertices", None)
    long = centerline.merge_path([ladder], [0.0], max_vertices=20)
    assert (long["status"], long["repair"]) == ("too_many_vertices", "too_many_vertices")


def ends_of(records):
    return {(r["part"], r["end"]): r["status"] for r in records}


def test_gaps_between_ends():
    # Mutual nearest ends meet halfway; the outer ends stay.
    parts, ends, how = gaps.snap_gaps([A((0, 0), (100, 0)), A((103, 0), (200, 0)), A((204, 0), (300, 0))])
    assert [p[[0, -1]].tolist() for p in parts] == [[[0, 0], [101.5, 0]], [[101.5, 0], [202, 0]], [[202, 0], [300, 0]]]
    assert ends_of(ends) == {(0, "start"): "outer", (0, "end"): "snapped_to_end", (1, "start"): "snapped_to_end", (1, "end"): "snapped_to_end", (2, "start"): "snapped_to_end", (2, "end"): "outer"} and how == "graph"
    # Ends that are further apart than the gap stay.
    parts, ends, _ = gaps.snap_gaps([A((0, 0), (100, 0)), A((106, 0), (200, 0))])
    assert parts[0][-1].tolist() == [100, 0] and ends_of(ends)[0, "end"] == "unresolved"


def test_gaps_to_lines_and_ends_that_stay():
    # An end goes to the inside of the nearest part, which gets a vertex there.
    parts, ends, _ = gaps.snap_gaps([A((0, 0), (200, 0)), A((50, 3), (50, 90))])
    assert parts[1][0].tolist() == [50, 0] and [50, 0] in parts[0].tolist() and len(parts[0]) == 3
    # What touches another part stays where it is, whatever is near.
    parts, ends, _ = gaps.snap_gaps([A((0, 0), (50, 0), (100, 0)), A((100, 0), (150, 0), (200, 0)), A((102, 1), (150, 80))])
    of = {(r["part"], r["end"]): r for r in ends}
    assert of[0, "end"]["status"] == "protected" and of[0, "end"]["reasons"] == {"connected_endpoint", "connected_to_line"}
    assert parts[0][-1].tolist() == [100, 0] and parts[2][0].tolist() == [102, 0]
    # A stump: the last segment starts where another part ends.
    parts, ends, _ = gaps.snap_gaps([A((0, 0), (100, 0), (102, 2)), A((100, 0), (200, 0))])
    of = {(r["part"], r["end"]): r for r in ends}
    assert "stump_candidate" in of[0, "end"]["reasons"] and "stump_target" in of[1, "start"]["reasons"] and parts[0][-1].tolist() == [102, 2]
    # A line that passes one of two ends more closely than they are to each other comes first.
    parts, ends, _ = gaps.snap_gaps([A((0, 0), (100, 0)), A((104, 0), (200, 0)), A((101, -50), (101, 50))])
    assert parts[0][-1].tolist() == [101, 0] and parts[1][0].tolist() == [101, 0]


def test_outer_ends_by_points_then_graph_then_distance():
    parts = [A((0, 0), (50, 0), (100, 0)), A((100, 0), (100, 200), (100, 500)), A((100, 0), (200, 0), (300, 0))]
    records = gaps.end_records(parts)
    grid = gaps.SegmentGrid(parts)
    gaps.protect(records, grid, 1e-6, 1e-6)
    at = lambda found: [tuple(r["at"]) for r in found[0]]
    assert gaps.outer_ends(parts, records, [A((0, 0))[0], A((300, 0))[0]])[1] == "points"
    found = gaps.outer_ends(parts, records)
    assert found[1] == "graph" and sorted(at(found)) == [(100, 500), (300, 0)]
    found = gaps.outer_ends(parts, records, [A((0, 0))[0]])
    assert found[1] == "points+graph" and at(found)[0] == (0, 0)
    away = [A((0, 0), (100, 0)), A((150, 0), (400, 0))]
    records = gaps.end_records(away)
    gaps.protect(records, gaps.SegmentGrid(away), 1e-6, 1e-6)
    assert sorted(at(gaps.outer_ends(away, records))) == [(0, 0), (400, 0)]
    rows = gaps.end_rows(away, records)
    assert [r[11] for r in rows] == [150, 50, 50, 300]
    adaptive = gaps.end_records([A((0, 0), (50, 0), (300, 0))], 40.0, adaptive=True, most=100.0)
    assert [r["tolerance_m"] for r in adaptive] == [pytest.approx(55), 100]


def test_two_thousand_parts_merge_in_seconds():
    import time

    x = [np.linspace(k * 100, k * 100 + 97, 20) for k in range(2000)]
    began = time.perf_counter()
    r = centerline.merge_path([np.stack([v, 50 * np.sin(v / 300)], axis=1) for v in x], list(range(2000)))
    assert r["status"] == "ok" and r["n_snapped"] == 2 * 1999 and time.perf_counter() - began < 30


def test_smoother_keeps_a_line_and_calms_a_wiggle():
    x = np.linspace(0, 20_000, 2000)
    wiggle = np.stack([x, 10 * np.sin(x / 60)], axis=1)
    r = centerline.simplest_similar(wiggle, 20.0, budget=50.0)
    assert r["status"] == "ok" and r["drop"] > 0.15
    assert centerline.simplest_similar(np.array([[0.0, 0.0], [20_000.0, 0.0]]), 50.0)["status"] == "turning_not_reduced"


def test_distances_to_a_line_are_those_of_all_segments():
    rng = np.random.default_rng(1)
    for n, m in ((2, 5), (40, 90), (500, 300)):
        line, points = np.cumsum(rng.normal(size=(n, 2)), axis=0), rng.normal(scale=12, size=(m, 2))
        want = [centerline.nearest_on(line, p)[0] for p in points]
        assert np.allclose(centerline.distances(line, points), want)


def _river(n, seed, step=50.0):
    rng = np.random.default_rng(seed)
    x = np.arange(n) * step
    return np.stack([x, 400 * np.sin(x / 2500) + 60 * np.sin(x / 300) + np.cumsum(rng.normal(scale=2, size=n))], axis=1)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("budget", [15.0, 80.0, 900.0])
def test_the_coarse_pass_does_not_change_the_sigma(seed, budget):
    xy = _river(700, seed)
    for statistic in ("p95", "max", "mean"):
        with_, without = centerline.simplest_similar(xy, budget=budget, statistic=statistic), centerline.simplest_similar(xy, budget=budget, statistic=statistic, coarse=1)
        assert with_["sigma_m"] == without["sigma_m"] and with_["status"] == without["status"] and np.array_equal(with_["line"], without["line"])
        assert with_["n_fine"] < without["n_fine"] or without["n_fine"] < 6 or with_["sigma_m"] < 300


def test_twenty_thousand_points_are_smoothed_in_seconds():
    import time

    began = time.perf_counter()
    r = centerline.simplest_similar(_river(20_000, 3), budget=80.0)
    assert r["status"] == "ok" and len(r["line"]) >= 20_000 and time.perf_counter() - began < 20
    assert centerline.simplest_similar(_river(100, 1), budget=np.inf)["status"] == "budget_not_finite"


def _unpruned(x, penalties, least, jump):
    """The recursion over all starts, for one profile."""
    n = len(x)
    if n < 2 * least or n < 2:
        return [[] for _ in penalties]
    grid = sorted({*range(0, n, jump), n})
    run, square = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)]), np.append(0.0, np.cumsum((x * x).sum(axis=1)))
    out = []
    for pen in penalties:
        best, came = {0: -pen}, {}
        for t in grid[1:]:
            found = [(best[s] + square[t] - square[s] - ((run[t] - run[s]) ** 2).sum() / (t - s) + pen, s) for s in grid if s <= t - least and s in best]
            if found:
                best[t], came[t] = min(found)
        breaks, t = [], n
        while came.get(t, 0):
            t = came[t]
            breaks.append(t)
        out.append(breaks[::-1])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_dropped_starts_do_not_change_a_break(seed):
    rng = np.random.default_rng(seed)
    n, least, jump = int(rng.integers(2, 260)), int(rng.integers(1, 20)), int(rng.integers(1, 4))
    level = np.repeat(rng.normal(scale=4, size=(n // 15 + 1, 2)), 15, axis=0)[:n]
    x = level + rng.normal(scale=rng.choice([0.1, 0.3, 1]), size=(n, 2))
    penalties = [0.5, 2.5, 10.0, 40.0]
    assert changepoint.solve(x, penalties, least, jump) == _unpruned(x, penalties, least, jump)


def test_work_grows_with_the_points_where_there_are_many_changes():
    rng = np.random.default_rng(0)
    work = {}
    for n in (2000, 4000, 8000):
        x = np.repeat(rng.normal(scale=3, size=(n // 50, 2)), 50, axis=0) + rng.normal(size=(n, 2))
        starts: list[int] = []
        changepoint.solve_all(x[None], [2.5, 10.0, 40.0], 10, 1, starts)
        work[n] = sum(starts)
    assert work[8000] < 2.5 * work[4000] and work[4000] < 2.5 * work[2000] and work[8000] < 8000**2 / 20


def test_settings():
    assert [config.final_stable_count(n) for n in range(1, 7)] == [1, 2, 2, 3, 4, 5]
    assert config.setting_label(1, 0.1, 0.05) == "mw1_runs0p1_stop0p05"
    assert config.parse_setting_label("mw1_runs0p1_stop0p05") == config.Setting(0.1, 1, 0.05)
    assert len(config.selector_grid(config.FAMILIES[4])) == 60 and config.window_label(2500) == "W2.5km"
    with pytest.raises(ValueError):
        config.check_stage(config.Stage("x", ("sinuosity",), ("raw", "w2")))
    with pytest.raises(ValueError):
        config.check_features(("depth",))


def test_parts_that_go_on_are_not_cut_to_look_for_loops(monkeypatch):
    """Of a path of seven parts with gaps only the network of all parts is made, not one for each part too."""
    made = []
    whole = centerline.node_lines
    monkeypatch.setattr(centerline, "node_lines", lambda parts, *a: made.append(len(parts)) or whole(parts, *a))
    lines = [np.stack([200.0 * np.arange(10) + 2008 * k, np.sin(np.arange(10))], axis=1) for k in range(7)]
    assert centerline.merge_path(lines, list(range(7)), 5.0)["repair"] == "simple" and made == [7]


@pytest.mark.parametrize("seed", range(6))
def test_what_goes_on_is_one_piece(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        p = np.stack([np.cumsum(rng.uniform(1e-8, 1e-4, 12)), rng.normal(0, 1, 12)], axis=1)[:: rng.choice([-1, 1])][:, :: rng.choice([-1, 1])]
        if noding.advances(p, 1e-6):
            net = noding.node_lines([p], 1e-6)
            assert len(net.pieces) == 1 and net.cycle_rank() == 0
    assert not noding.advances(np.array([[0.0, 0], [5, 0], [5, 5], [0, 5], [0, -1]]))


@pytest.mark.parametrize("seed", range(4))
def test_ends_compared_at_once_are_as_by_cells(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    parts = [np.cumsum(rng.normal(0, 3, (5, 2)), axis=0) + rng.uniform(0, 20, 2) for _ in range(8)]
    parts += [parts[0][::-1] + 3, np.stack([parts[1][-1], parts[1][-1] + 9])]

    def rows():
        new, records, how = gaps.snap_gaps(parts, 5.0)
        return [p.tolist() for p in new], how, gaps.end_rows(parts, records)

    at_once = rows()
    monkeypatch.setattr(gaps, "ALL_PAIRS", 0)
    assert repr(at_once) == repr(rows())


def test_far_parts_of_ends_take_one_search(monkeypatch):
    """Whether all loose ends are connected is asked once, not once for each of them."""
    n = []
    search = gaps.shortest
    monkeypatch.setattr(gaps, "shortest", lambda *a: n.append(1) or search(*a))
    parts = [np.array([[0.0, 0], [10.0 + k, 100 * np.sin(k)]]) for k in range(12)]
    records = gaps.end_records(parts)
    gaps.by_graph(parts, records, records, 1e-6)
    assert len(n) <= 3


@pytest.mark.parametrize("seed", range(4))
def test_costs_at_once_are_as_step_by_step(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (5, 40, 2)) + np.repeat(rng.normal(0, 2, (5, 4, 2)), 10, axis=1), seed % 2 + 1)
    x[1] = 0.0
    cases = [(x, m, jump) for m in (1, 5, 20) for jump in (1, 3)]
    at_once = [changepoint.solve_all(*c[:1], [0.0, 1.0, 5.0], *c[1:]) for c in cases]
    monkeypatch.setattr(changepoint, "AT_ONCE", 0)
    assert at_once == [changepoint.solve_all(*c[:1], [0.0, 1.0, 5.0], *c[1:]) for c in cases]


def test_short_profiles_of_many_batches_are_solved_together():
    """Paths of several Arrow batches wait for each other, and stay whole and in order."""
    batches = [pd.DataFrame({"mip": [m, m, m + 1], "v": [1, 2, 3]}) for m in range(1, 9)]
    used = []
    out = list(changepoint.by_path(iter(batches), lambda rows: used.append(len(rows)) or rows, 10))
    assert len(used) <= 3 and max(used) >= 10
    assert pd.concat(out, ignore_index=True).equals(pd.concat(batches, ignore_index=True))
    assert all(not (set(a["mip"]) & set(b["mip"])) for a, b in itertools.combinations(out, 2))


@pytest.mark.parametrize("seed", range(4))
def test_profiles_of_nearly_one_length_are_solved_together(seed):
    rng = np.random.default_rng(seed)
    sizes = np.array([40, 9, 37, 1, 36, 21, 40])
    x = np.round(rng.normal(0, 1, (7, 40, 2)) + np.repeat(rng.normal(0, 2, (7, 4, 2)), 10, axis=1), seed % 2 + 1)
    for least in (1, 5, 10):
        want = [changepoint.solve(of[:n], [0.0, 1.0, 5.0], least) for of, n in zip(x, sizes)]
        assert changepoint.solve_all(x, [0.0, 1.0, 5.0], least, sizes=sizes) == want


@pytest.mark.parametrize("seed", range(6))
def test_many_greedy_choices_at_once_are_those_of_plain_loops(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    rules = config.SelectionConfig(min_spacing_m=700.0, stop_absolute=0.5, min_reach_m=[None, 900.0][seed % 2], max_breaks=[30, 3][seed // 4])
    problems = []
    for k in range(40):
        n, columns = int(rng.integers(2, 50)), 1 + k % 3
        x = np.round(rng.normal(0, 1, (n, columns)), k % 2)  # whole numbers make equal gains
        dist = 200.0 * np.arange(1, n + 1)
        some = rng.choice(dist, min(n, int(rng.integers(1, 20))), replace=False) - 100.0 * (k % 2)
        problems.append((selection.Profile(dist, [x]), np.sort(some), [None, 0.0, 0.05][k % 3]))

    def plain(profile, positions, least):
        error = lambda a, b: float(profile.error(np.array(a), np.array(b)))
        base = now = error(0, len(profile.dist))
        cuts, chosen, made = [0, len(profile.dist)], [], []
        while len(made) < rules.max_breaks:
            best, which = 0.0, None
            for m, at in zip(positions.tolist(), np.searchsorted(profile.dist, positions).tolist()):
                ends = [profile.dist[0], *sorted([*chosen, m]), profile.dist[-1]]
                if not 0 < at < cuts[-1] or any(abs(m - b) < rules.min_spacing_m for b in chosen) or (rules.min_reach_m is not None and np.diff(ends).min() < rules.min_reach_m - 1e-9):
                    continue
                lo, hi = max(c for c in cuts if c <= at), min(c for c in cuts if c > at)
                gain = 0.0 if lo == at else error(lo, hi) - error(lo, at) - error(at, hi)
                if gain > best + 1e-12:
                    best, which = gain, (m, at)
            if which is None:
                break
            now -= best
            chosen.append(which[0])
            cuts = sorted({*cuts, which[1]})
            made.append((which[0], now, best))
            if least is not None and selection.prefix(base, made[-1:], least, rules.stop_absolute) == 0:
                break
        return base, made

    want = [plain(*p) for p in problems]
    assert selection.greedy_all(problems, rules) == want and sum(len(made) for _, made in want) > 40
    monkeypatch.setattr(selection, "STEP_POSITIONS", 7)
    assert selection.greedy_all(problems, rules) == want
