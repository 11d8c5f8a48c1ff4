"""Junctions, side components and corridors of all paths at once, over keyed edges.

Paths of at most IN_TASK reaches are each solved in one task, on arrays, after one exchange by
path. Larger ones are solved on rows (mip, reach, ends), so that a path may be larger than a
task: components come from minimum labels that are halved in each
round; places along a main stem from pointers that double; what a side junction can be
reached from, and what it reaches, from bounds that are handed along side reaches only.
Rounds are as many as the logarithm of a path's reaches, or for the bounds as the reaches
of the longest side channel. Each round is settled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settled import settle
from .graph import first_met, reverse

#: Places along the main stem that one bin of the corridor join holds.
BIN = 64
#: Reaches of a path that a task holds at once.
IN_TASK = 1 << 18


def _none(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).limit(1).collect()


def large_paths(rows: DataFrame, path: str = "mip") -> DataFrame:
    """(mip) of the paths with more rows than a task should hold."""
    return settle(rows.groupBy(F.col(path).alias("mip")).count().where(F.col("count") > IN_TASK).select("mip"))


def _by_path(rows: DataFrame, large: DataFrame | None, own, schema: str, rounds) -> DataFrame:
    """own() of the arrow table of each path, and rounds() of the rows of all large paths, which have the same columns."""
    large = large_paths(rows) if large is None else large
    done = lambda part: part.groupBy("mip").applyInArrow(own, schema)
    if _none(large):
        return done(rows)
    return done(rows.join(large, "mip", "left_anti")).unionByName(rounds(rows.join(large, "mip", "left_semi")))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each one is connected with by edges a to b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        for ends in (a, b, x, y):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _table(schema: list[str], mip, *columns) -> pa.Table:
    return pa.table([pa.repeat(mip, len(columns[0])), *columns], names=schema)


def _first_rows(table: pa.Table, ids: np.ndarray) -> np.ndarray:
    """One row of each reach: of repeated ones that with the least flag, then the least way down as text."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
    kept = order[starts]
    for k in np.flatnonzero(np.diff(np.append(starts, len(order))) > 1).tolist():
        rows = order[starts[k] : starts[k] + np.count_nonzero(ids == ids[kept[k]])].tolist()
        kept[k] = min(rows, key=lambda i: ((x := table["_flag"][i].as_py()) is not None, x or 0, _text(table["rch_id_dn"][i].as_py())))
    return kept


def _text(down: list | None) -> str:
    """What to_json gives for a struct of it."""
    return "{}" if down is None else '{"rch_id_dn":[%s]}' % ",".join("null" if x is None else str(x) for x in down)


def _own_junctions(table: pa.Table) -> pa.Table:
    mip, ids = table.column("mip")[0], _array(table, "reach_id")
    kept = _first_rows(table, ids)
    if len(kept) < len(ids) or (np.diff(kept) < 0).any():
        table = table.take(kept)
        ids = ids[kept]
    down = table.column("rch_id_dn").combine_chunks()
    row, to = pc.list_parent_indices(down), pc.list_flatten(down)
    if to.null_count:
        row, to = row.filter(to.is_valid()), to.filter(to.is_valid())
    row, to = row.to_numpy(zero_copy_only=False), to.to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    met = (to != 0) & (to != ids[row]) & (ids[at] == to)
    label = least_labels(2 * len(ids), 2 * row[met] + 1, 2 * at[met])
    name = 2 * ids[label // 2] + label % 2
    return _table(["mip", "reach_id", "is_main", "u", "v"], mip, table.column("reach_id"), table.column("is_main"), name[0::2], name[1::2])


def _components(main: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Junctions beside the main stem, the least junction that each is connected with, and the reaches inside its component."""
    side = ~main
    nodes, at = np.unique(np.concatenate([u[side], v[side]]), return_inverse=True)
    a, b = np.split(at, 2)
    label = least_labels(len(nodes), a, b)
    if not len(nodes):
        return nodes, nodes, nodes
    of = lambda x: np.where(nodes[i := np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)] == x, label[i], -1)
    x, y = of(u), of(v)
    inside = np.bincount(x[(x == y) & (x >= 0)], minlength=len(nodes))
    return nodes, nodes[label], inside[label]


def _own_side_components(table: pa.Table) -> pa.Table:
    nodes, component, inside = _components(*(_array(table, c) for c in ("is_main", "u", "v")))
    held = inside >= 2
    return _table(["mip", "component", "node", "n_inside"], table.column("mip")[0], component[held], nodes[held], inside[held].astype(np.int64))


def _chain(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Junctions of a main stem that is one chain of reaches, from its source on; else none."""
    sources, sinks = np.setdiff1d(u, v), np.setdiff1d(v, u)
    if len(sources) != 1 or len(sinks) != 1 or len(np.unique(u)) < len(u) or len(np.unique(v)) < len(v):
        return []
    to, order = dict(zip(u.tolist(), v.tolist())), sources.tolist()
    while order[-1] in to:
        order.append(to[order[-1]])
    return order


def _own_corridors(table: pa.Table) -> pa.Table:
    reach, main, u, v = (_array(table, c) for c in ("reach_id", "is_main", "u", "v"))
    order, found = _chain(u[main], v[main]), []
    nodes, component, inside = _components(main, u, v)
    of = dict(zip(nodes[inside >= 2].tolist(), component[inside >= 2].tolist())) if order else {}
    place = {n: k for k, n in enumerate(order)}
    ways, spans = defaultdict(list), defaultdict(list)
    for a, b in zip(u[~main].tolist(), v[~main].tolist()):
        ways[a].append((b, None))
        if a in of:
            spans[of[a]].append((place.get(a), place.get(b)))
    # The last place that each junction is reached from, and the first that it reaches.
    up, down = first_met(order[::-1], ways), first_met(order, reverse(ways))
    a, b = u.tolist(), v.tolist()
    held = [(len(order) - 1 - max(up[x], up[y]), max(down[x], down[y]), k) for k, (x, y) in enumerate(zip(a, b)) if x in up and y in up and x in down and y in down]
    low, high, row = np.array(sorted(held), dtype=np.int64).reshape(-1, 3).T
    turned = np.flatnonzero(low > high)
    for name, ends in spans.items():
        source = min((s for s, _ in ends if s is not None), default=None)
        sink = None if source is None else max((t for _, t in ends if t is not None and t > source), default=None)
        if sink is not None:
            near = np.arange(*np.searchsorted(low, [source, sink + 1]))
            near = np.union1d(near, turned) if len(turned) else near
            near = near[(low[near] >= source) & (high[near] <= sink)]
            found.append((np.full(len(near), name), np.full(len(near), source), np.full(len(near), sink), reach[row[near]]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 4
    return _table(["mip", "component", "source", "sink", "reach_id"], table.column("mip")[0], *columns)


def min_labels(edges: DataFrame) -> DataFrame:
    """(mip, node, label) of every node of edges (mip, a, b): the least node that it is connected with, in whatever direction."""
    both = settle(edges.select("mip", "a", "b").unionByName(edges.select("mip", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("mip", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels.select("mip", F.col("node").alias("b"), "label"), ["mip", "b"]).groupBy("mip", F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = settle(labels.join(heard, ["mip", "node"]).select("mip", "node", F.col("label").alias("was"), F.least("label", "heard").alias("label")))
        jump = lower.select("mip", F.col("node").alias("label"), F.col("label").alias("further"))  # a label's own label
        new = settle(lower.join(jump, ["mip", "label"]).select("mip", "node", "was", F.least("label", "further").alias("label")))
        labels = new.select("mip", "node", "label")
        if _none(new.where("label <> was")):
            return labels


def junctions(reaches: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(mip, reach_id, is_main, u, v) of each reach: the junctions at its upper and lower end.

    The lower end of a reach is one junction with the upper ends of the reaches of its path
    that it runs to. Junctions are numbered by the least of the ends in them, 2 * reach_id
    for an upper and 2 * reach_id + 1 for a lower end. Of a repeated reach one row counts.
    large: the paths that are more than a task should hold (mip); counted if not given.
    """
    given = reaches.where("reach_id is not null and main_path_id is not null")
    large = large_paths(given, "main_path_id") if large is None else large
    rows = given.select(
        F.col("main_path_id").cast("long").alias("mip"), F.col("reach_id").cast("long").alias("reach_id"), F.coalesce(F.col("is_mainstem").cast("boolean"), F.lit(False)).alias("is_main"),
        F.col("rch_id_dn").cast("array<long>").alias("rch_id_dn"), F.col("is_mainstem").cast("int").alias("_flag"),
    )
    text = F.to_json(F.struct("rch_id_dn"))
    return _by_path(rows, large, _own_junctions, "mip long, reach_id long, is_main boolean, u long, v long", lambda part: _keyed_junctions(part, text))


def _keyed_junctions(rows: DataFrame, text: Column) -> DataFrame:
    own = F.min_by(F.struct("is_main", "rch_id_dn"), F.struct("_flag", text))
    rows = settle(rows.groupBy("mip", "reach_id").agg(own.alias("_")).select("mip", "reach_id", "_.is_main", "_.rch_id_dn"))
    down = rows.select("mip", "reach_id", F.explode("rch_id_dn").alias("dn")).where("dn <> 0 and dn <> reach_id")
    met = down.join(rows.select("mip", F.col("reach_id").alias("dn")), ["mip", "dn"])
    ends = met.select("mip", (2 * F.col("reach_id") + 1).alias("a"), (2 * F.col("dn")).alias("b"))
    labels = min_labels(ends)
    out = rows.select("mip", "reach_id", "is_main", (2 * F.col("reach_id")).alias("_u"), (2 * F.col("reach_id") + 1).alias("_v"))
    for end, name in (("_u", "u"), ("_v", "v")):
        out = out.join(labels.select("mip", F.col("node").alias(end), F.col("label").alias(name)), ["mip", end], "left").withColumn(name, F.coalesce(name, end))
    return settle(out.select("mip", "reach_id", "is_main", "u", "v"))


def side_components(net: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(mip, component, node, n_inside) of side components with two reaches of the whole network inside at least.

    net: what junctions() gives. component: the least junction in it. n_inside: reaches of the
    path, of the main stem too, with both ends in it. large: as in junctions().
    """
    return _by_path(net, large, _own_side_components, "mip long, component long, node long, n_inside long", _keyed_side_components)


def _keyed_side_components(net: DataFrame) -> DataFrame:
    labels = settle(min_labels(net.where("not is_main").select("mip", F.col("u").alias("a"), F.col("v").alias("b"))))
    of = lambda end: labels.select("mip", F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    inside = net.join(of("u"), ["mip", "u"]).join(of("v"), ["mip", "v"]).where("_u = _v").groupBy("mip", F.col("_u").alias("label")).agg(F.count("*").alias("n_inside"))
    return labels.join(inside.where("n_inside >= 2"), ["mip", "label"]).select("mip", F.col("label").alias("component"), "node", "n_inside")


def main_places(net: DataFrame) -> DataFrame:
    """(mip, node, place) of the junctions of main stems, 0 at the source, for paths whose main stem is one chain of reaches."""
    main = net.where("is_main").select("mip", "u", "v")
    ends = main.select("mip", F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(main.select("mip", F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degrees = settle(ends.groupBy("mip", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
    chain = degrees.groupBy("mip").agg(F.max(F.greatest("o", "i")).alias("most"), F.count_if(F.col("i") == 0).alias("sources"), F.count_if(F.col("o") == 0).alias("sinks")).where("most = 1 and sources = 1 and sinks = 1")
    back = F.when(F.col("i") == 1, F.lit(1)).otherwise(0)
    start = degrees.join(chain.select("mip"), "mip", "left_semi").join(main.select("mip", F.col("v").alias("node"), F.col("u").alias("to")), ["mip", "node"], "left")
    rows = settle(start.select("mip", "node", F.coalesce("to", "node").alias("to"), back.cast("long").alias("place")))
    while True:
        ahead = rows.select("mip", F.col("node").alias("to"), F.col("to").alias("further"), F.col("place").alias("more"))
        new = settle(rows.join(ahead, ["mip", "to"]).select("mip", "node", "to", F.col("further"), (F.col("place") + F.col("more")).alias("place")))
        rows = new.select("mip", "node", F.col("further").alias("to"), "place")
        if _none(new.where("further <> to")):
            break
    # A ring beside a chain has no source: its pointers never reach one.
    sources = degrees.where("i = 0").select("mip", F.col("node").alias("to"))
    return rows.join(sources, ["mip", "to"], "left_semi").select("mip", "node", "place")


def _handed_on(side: DataFrame, start: DataFrame, tail: str, head: str, best) -> DataFrame:
    """(mip, node, bound): the best bound of start (mip, node, bound) that comes along side reaches from tail to head."""
    links = settle(side.select("mip", F.col(tail).alias("node"), F.col(head).alias("to")).distinct())
    known = settle(start)
    while True:
        sent = known.join(links, ["mip", "node"]).groupBy("mip", F.col("to").alias("node")).agg(best("bound").alias("new"))
        both = known.join(sent, ["mip", "node"], "full")
        now = settle(both.select("mip", "node", F.col("bound").alias("was"), F.when(F.col("bound").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("bound")).otherwise(_of(best)(F.col("bound"), F.col("new"))).alias("bound")))
        known = now.select("mip", "node", "bound")
        if _none(now.where("was is null or was <> bound")):
            return known


def _of(best):
    return F.greatest if best is F.max else F.least


def corridors(net: DataFrame, places: DataFrame | None = None, components: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
    """(mip, component, source, sink, reach_id) of every reach between the source and the sink of each side component.

    A component's source is the first junction of the main stem where one of its side reaches
    starts, its sink the last one after that where one ends. Between them are the reaches whose
    ends can be reached from the source and reach the sink. A junction that a place of the main
    stem reaches is reached from all places before, so two bounds for each junction decide: the
    last place that it is reached from, and the first that it reaches. Paths whose main stem is
    not one chain, and components without a source and a sink, have none. Side reaches must
    not run in a circle. large: as in junctions(). Where places or components are given, those
    of all paths are used, by rounds.
    """
    if places is not None or components is not None:
        return _keyed_corridors(net, places, components)
    return _by_path(net, large, _own_corridors, "mip long, component long, source long, sink long, reach_id long", _keyed_corridors)


def _keyed_corridors(net: DataFrame, places: DataFrame | None = None, components: DataFrame | None = None) -> DataFrame:
    net = settle(net)
    places = settle(main_places(net) if places is None else places)
    components = settle(_keyed_side_components(net) if components is None else components)
    side = net.where("not is_main")
    at = lambda end: places.select("mip", F.col("node").alias(end), F.col("place").alias(f"{end}_place"))
    of = components.select("mip", F.col("node").alias("u"), "component")
    placed = side.join(of, ["mip", "u"]).join(at("u"), ["mip", "u"], "left").join(at("v"), ["mip", "v"], "left")
    first = placed.groupBy("mip", "component").agg(F.min("u_place").alias("source"))
    spans = placed.join(first, ["mip", "component"]).where("v_place > source").groupBy("mip", "component", "source").agg(F.max("v_place").alias("sink"))
    # The last place that each junction is reached from, and the first that it reaches.
    main = places.select("mip", "node", F.col("place").alias("bound"))
    up, down = _handed_on(side, main, "u", "v", F.max), _handed_on(side, main, "v", "u", F.min)
    bounds = up.withColumnRenamed("bound", "up").join(down.withColumnRenamed("bound", "down"), ["mip", "node"])
    end = lambda n: bounds.select("mip", F.col("node").alias(n), F.col("up").alias(f"{n}_up"), F.col("down").alias(f"{n}_down"))
    reaches = net.join(end("u"), ["mip", "u"]).join(end("v"), ["mip", "v"])
    low, high = F.least("u_up", "v_up"), F.greatest("u_down", "v_down")
    reaches = reaches.select("mip", "reach_id", low.alias("_low"), high.alias("_high"), F.floor(low / BIN).alias("_bin"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("source") / BIN), F.floor(F.col("sink") / BIN))))
    inside: Column = (F.col("_low") >= F.col("source")) & (F.col("_high") <= F.col("sink"))
    return spans.join(reaches, ["mip", "_bin"]).where(inside).select("mip", "component", "source", "sink", "reach_id")
