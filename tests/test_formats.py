"""Lines as well-known binary and text."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import centerline
from thalweg.sources import readers, wkb

LINE, TWO = np.array([[0.0, 1.0], [2.5, -3.0], [1e7, 4.125]]), [np.array([[0.0, 0.0], [1.0, 1.0]]), np.array([[5.0, 5.0], [6.0, 6.0], [7.0, 5.5]])]


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(x, y) for x, y in zip(a, b))


@pytest.mark.parametrize("big", [False, True])
def test_round_trip(big):
    for parts in ([LINE], TWO):
        found, status = wkb.parse(wkb.build(parts, big))
        assert status == "ok" and same(found, parts)


def test_heights_measures_and_reference_systems_are_dropped():
    xyz = struct.pack("<BII", 1, 1002, 2) + np.array([1.0, 2, 9, 3, 4, 9]).astype("<f8").tobytes()
    extended = struct.pack("<BIII", 1, 2 | 0x80000000 | 0x40000000 | 0x20000000, 3857, 2) + np.array([1.0, 2, 9, 9, 3, 4, 9, 9]).astype("<f8").tobytes()
    zm = struct.pack(">BII", 0, 3002, 2) + np.array([1.0, 2, 9, 9, 3, 4, 9, 9]).astype(">f8").tobytes()
    mixed = struct.pack("<BII", 1, 5, 2) + wkb.build([TWO[0]], True) + wkb.build([TWO[1]])
    for raw in (xyz, extended, zm):
        assert wkb.parse(raw)[1] == "ok" and wkb.parse(raw)[0][0].tolist() == [[1, 2], [3, 4]]
    assert same(wkb.parse(mixed)[0], TWO)


def test_what_is_no_line_has_a_status():
    good = wkb.build(TWO)
    assert wkb.parse(None)[1] == "missing"
    for raw in (b"", b"\x05", good[:-1], good + b"\0", b"\1" + good[1:5] + b"\xff\xff\xff\xff", bytes([1]) + struct.pack("<I", 77), struct.pack("<BII", 1, 2, 1 << 31), wkb.build([np.array([[np.nan, 1.0], [2, 3]])])):
        assert wkb.parse(raw) == ([], "malformed")
    assert wkb.parse(struct.pack("<BI2d", 1, 1, 1.0, 2.0))[1] == "wrong_type"
    assert wkb.parse(struct.pack("<BII", 1, 2, 0))[1] == "empty" and wkb.parse(struct.pack("<BII", 1, 5, 0))[1] == "empty"
    rng = np.random.default_rng(0)
    for _ in range(2000):  # whatever the bytes, no error
        raw = bytearray(good)
        for k in rng.integers(0, len(raw), 3):
            raw[k] = rng.integers(0, 256)
        assert wkb.parse(bytes(raw[: rng.integers(0, len(raw) + 1)]))[1] in ("ok", "malformed", "wrong_type", "empty")


def test_columns(spark):
    points = lambda p: [[{"x": float(x), "y": float(y)} for x, y in line] for line in p]
    rows = [(1, points([LINE])), (2, points(TWO)), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "k int, parts array<array<struct<x:double,y:double>>>").repartition(2)
    made = df.select("k", wkb.to_wkb(F.col("parts")).alias("b"), wkb.to_wkt(F.col("parts")).alias("t"))
    assert {r["k"]: r["t"] for r in made.collect()} == {
        1: "LINESTRING (0 1, 2.5 -3, 1.0E7 4.125)", 2: "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6, 7 5.5))", 3: None, 4: None,
    }
    for column in ("b", "t"):
        back = {r["k"]: r for r in wkb.with_parts(made, column).collect()}
        assert {k: r["geometry_status"] for k, r in back.items()} == {1: "ok", 2: "ok", 3: "missing", 4: "missing"}
        assert [[[tuple(q) for q in line] for line in back[k]["parts"]] for k in (1, 2)] == [[[tuple(q) for q in line] for line in p] for p in ([LINE], TWO)]
    lines = wkb.lines_out(df.select("k", F.get("parts", F.lit(0)).alias("line")), "wkt").orderBy("k").collect()
    assert lines[1]["line"] == "LINESTRING (0 0, 1 1)" and lines[2]["line"] is None


def test_text(spark):
    cases = {
        "LINESTRING(0 0,1 1)": "ok", " linestring z (0 0 5, 1 1 5) ": "ok", "SRID=3857;LINESTRING (0 0, 1e3 -.5)": "ok", "MULTILINESTRING((0 0,1 1),(2 2, 3 3))": "ok", "LINESTRING EMPTY": "empty",
        "POINT (1 1)": "wrong_type", "MULTIPOLYGON (((0 0, 1 1, 1 0, 0 0)))": "wrong_type", "LINESTRING (0 0, 1": "malformed", "LINESTRING (0, 1 1)": "malformed", "": "malformed", "LINESTRING ((0 0, 1 1))": "malformed",
    }
    got = wkb.with_parts(spark.createDataFrame(list(cases.items()), "t string, want string"), "t").collect()
    assert [(r["t"], r["geometry_status"]) for r in got] == [(r["t"], r["want"]) for r in got]
    assert [tuple(p) for p in got[1]["parts"][0]] == [(0, 0), (1, 1)] and [tuple(p) for p in got[2]["parts"][0]] == [(0, 0), (1000, -0.5)]


def test_reaches_of_several_lines_are_merged(spark):
    rows = [(1, 7, True, 0.0, wkb.build([np.array([[0.0, 0], [50, 0]]), np.array([[50.0, 0], [90, 0]])])), (2, 7, True, 1.0, wkb.build([np.array([[90.0, 0], [140, 0]])])), (3, 8, True, 0.0, b"bad")]
    reaches = readers.normalize_reaches(spark.createDataFrame(rows, "reach_id long, main_path_id long, is_mainstem boolean, dist_out double, geometry binary"))
    assert {r["reach_id"]: r["geometry_status"] for r in reaches.collect()} == {1: "ok", 2: "ok", 3: "malformed"}
    got = {r["main_path_id"]: r for r in centerline.merge_mainpaths(reaches).collect()}
    assert got[7]["status"] == "ok" and got[7]["merged_length_m"] == 140 and got[7]["n_parts"] == 3 and got[8]["status"] == "empty"
