"""Importance resampling, the Merkle manifest, source mixing and exact ranks, against plain versions."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thalweg.llm import common, merkle, mixing, queries, ranks, resample

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rank string, weight string, _g string, target string, kids string, _cell string"
CLASH = ("x",) * 6


def table(spark, rows):
    """rows: (doc_id, source, text)."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, s, None if t is None else len(t), *CLASH) for i, s, t in rows], SCHEMA).repartition(3)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    words = [f"Wort{k}" for k in range(300)] + ["Straße", "日本", "a-b", "x_y", "\x0b", "7"]
    sources = [None, "", "web", "Web", "ü", "wiki", "web", "web", "web"]
    rows = [(rng.choice((1, -1)) * k * 7, rng.choice(sources), rng.choice(["", " ", "\t"]).join(rng.choice(words) + " " for _ in range(rng.choice((0, 1, 5, 30, 90))))) for k in range(n)]
    return rows + [(n * 7 + 1, "web", None), (n * 7 + 2, None, ""), (n * 7 + 3, "solo", "one two")]


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("cell", [1, 2, 7, 1000])
def test_ranks(spark, cell):
    rng = random.Random(cell)
    keys = [rng.choice((rng.randrange(1 << 62), rng.randrange(50), -rng.randrange(9), 5)) for _ in range(600)]
    rows = common.cut(spark.createDataFrame([(k, "hot" if i % 3 else f"g{i % 30}", i) for i, k in enumerate(keys)], "k long, g string, i long").repartition(4))
    got = ranks.ranked(rows, ["g"], F.concat(ranks.digits(F.col("k")), ranks.digits(F.col("i"))), cell)
    assert got.columns == ["k", "g", "i", "_rank"]
    for _, part in got.toPandas().groupby("g"):
        part = part.sort_values(["k", "i"])
        assert part["_rank"].tolist() == list(range(len(part)))
    assert ranks.ranked(common.cut(rows.limit(0)), ["g"], ranks.digits(F.col("k")), cell).count() == 0


def test_digits(spark):
    numbers = [0, 1, -1, 15, 16, -(1 << 63), (1 << 63) - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", ranks.digits(F.col("n"))).collect()
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(numbers) and {len(r[1]) for r in got} == {16}


@pytest.mark.parametrize("run", [1, 2])
def test_resample(spark, run):
    rows = some_rows(150)
    docs, target = table(spark, rows), spark.createDataFrame([("Wort1 wort2 wort3 Straße",), (None,), ("日本 7 wort1",)], "text string")
    want = resample.by_hand([(i, t) for i, _, t in rows], [r[0] for r in target.collect()], run=run, percent=30)
    got = values(resample.resample(docs, target, run=run, percent=30), "doc_id", "n_features", "weight", "score", "rank")
    assert got == sorted(((d, *v) for d, v in want.items()), key=repr)
    assert sum(r[4] is not None for r in got) > 10


def test_resample_with_odd_rows(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"v{k % 30000}" for k in range(200_000))
    rows = [(None, "a", text)] * 2 + [(5, "a", text)] * 30 + [(6, None, None), (7, "a", ""), (8, "a", long)]
    got = resample.resample(table(spark, rows), table(spark, []), folder=str(tmp_path / "m"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    out = got.collect()
    assert len(out) == len(rows) and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]
    assert {r["score"] for r in out if r["doc_id"] == 5} and len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    assert {(r["n_features"], r["weight"], r["rank"]) for r in out if r["doc_id"] in (6, 7)} == {(0, 0, None)}
    blocks = spark.read.parquet(str(tmp_path / "m" / "documents")).collect()
    total = np.zeros(resample.BUCKETS, dtype=int)
    for b in blocks:
        np.add.at(total, np.frombuffer(b["buckets"], "<u4"), np.frombuffer(b["counts"], "<u4"))
    want = np.zeros(resample.BUCKETS, dtype=int)
    for _, _, t in rows:
        for w in (t or "").split():
            want[zlib.crc32(w.encode()) % resample.BUCKETS] += 1
    assert (total == want).all()
    assert resample.resample(table(spark, []), table(spark, rows[:1])).count() == 0


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_manifest(spark, n):
    rows = some_rows(n)
    docs = table(spark, rows)
    plain = [(i, s, "en" if (i or 0) % 3 else None, None if t is None else len(t), t) for i, s, t in rows]
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert values(merkle.audit(docs), *columns) == sorted(merkle.by_hand(plain), key=repr)
    assert values(merkle.audit(docs, 3), *columns) == sorted(merkle.by_hand(plain, 3), key=repr)


def test_manifest_with_odd_rows(spark):
    rows = [(None, "a", "Text"), (None, "a", None), *[(3, "a", "Same")] * 40, (3, "a", "other"), (4, None, "X" * 100_000)]
    got = merkle.audit(table(spark, rows)).collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 2
    hit = zlib.crc32(b"4") % 5 == 0, zlib.crc32(b"3") % 5 == 0
    for r in got:
        assert r["verified"] == (not {4: hit[0], 3: hit[1]}.get(r["doc_id"], False))
    again = merkle.audit(table(spark, rows[::-1])).first()["root"]
    assert again == got[0]["root"]  # the order of rows does not matter
    one = merkle.manifest(table(spark, rows[-1:])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["steps"] == [] and one["source"] is None
    empty = merkle.audit(table(spark, []))
    assert empty.count() == 0 and empty.columns == [c for c in merkle.audit(table(spark, rows)).columns]


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_as_near_as_any_choice(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(1, 60), rng.integers(1, 8), replace=False).astype(np.int64)
    counts = rng.integers(0, 5, len(lengths))
    total = int((lengths * counts).sum())
    for budget in {0, 1, total // 3, total // 2, total - 1, total, total + 5}:
        took = mixing.fit(lengths, counts, budget)
        assert (took >= 0).all() and (took <= counts).all()
        sums = {0}
        for v, c in zip(lengths.tolist(), counts.tolist()):
            for _ in range(c):
                sums |= {s + v for s in sums}
        assert int((lengths * took).sum()) == min(sums, key=lambda s: (abs(budget - s), s))


def test_fit_of_a_large_budget(spark):
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 20_000, 3000)).astype(np.int64)
    counts = rng.integers(1, 2000, len(lengths))
    total = int((lengths * counts).sum())
    took = mixing.fit(lengths, counts, total * 2 // 5)
    assert int((lengths * took).sum()) == total * 2 // 5 and (took <= counts).all()
    assert np.abs(took / counts - 0.4)[counts > 200].max() < 0.02  # every length gives its share
    for sizes, budget, best in (([500_000, 900_000], 300_000, 500_000), ([500_000], 200_000, 0), ([1 << 20, 1], 400_000, 1)):
        took = mixing.fit(np.array(sizes), np.ones(len(sizes), dtype=np.int64), budget)
        assert int((np.array(sizes) * took).sum()) == best


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, s, " ".join("w" * rng.randrange(1, 40))) for k, s in enumerate(rng.choices([None, "a", "b", "ü", "zz", "Z", "z"], [1, 30, 4, 3, 1, 1, 20], k=400))]
    rows += [(1000, "none", None), (1001, "none", "")] + [(2000, "b", "one two\x0bthree")] * 50
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert mixing.mix(docs).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    want = mixing.by_hand([(s, t) for _, s, t in rows])
    source = {i: s for i, s, _ in rows}
    assert len(got) == len(rows)
    for s, (size, target, nearest) in want.items():
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {size} and all(abs(r["target"] - target) < 1e-6 for r in own)
        assert sum(r["taken"] for r in own) == nearest
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert values(mixing.mix(docs.repartition(7)), "doc_id", "taken") == values(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(None, None, None)])).collect()[0][1:5] == (0, 0, 0.0, 0)


def test_targets_stop_at_twice_the_source(spark):
    rows = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 3000), ("1", 0)], "_g string, source_size long")
    got = {r["_g"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got["0a"] == 20 and got["1"] == 0 and got["0b"] == 2000 and got["0c"] == 1.5 * 4010 - 2020


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_merkle_manifest"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[want.columns]
    key = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False)
