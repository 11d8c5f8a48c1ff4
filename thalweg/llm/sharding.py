"""Shards of near-equal size by sampled splitters, with DataFrame functions only.

Records are put in the order of a key, (hash of the text, hash of the id), in which equal
texts stand together. A size-weighted sample of keys gives quantile boundaries, which cut
the order into many small ranges. Ranges that turn out overfull are sampled again and cut
further. Prefix sums over the ranges, and running sums inside each, then give every
record its exact place, and a shard is the stretch of the order with its share of bytes.
So a group of equal texts lies in one shard or in adjacent ones, and a group with a third
of all rows is cut by the hash of the id like anything else.

Laws: "bytes" makes the summed sizes near equal (no shard is off by more than one
record), "rows" makes the counts at most one apart, and "key" uses only doc_id and the
number of shards (jump consistent hash: one more shard takes rows only into itself).

Defined cases: a null text has no bytes and the crc of an empty one; a null doc_id is a
key of its own; repeated rows follow each other; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes that a record counts besides its text.
OVERHEAD = 16
#: Ranges to aim at, keys sampled for each, and the multiple of a range's share at which it is cut again.
RANGES = 1024
SAMPLE_PER_RANGE = 16
OVERFULL = 3
ROUNDS = 4


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the order key of each record."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.concat(F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))).alias("_key"),
    )


def _range_of(splitters: list[str]) -> Column:
    """The number of splitters at or below the key, by halving."""
    if not splitters:
        return F.lit(0)
    steps = F.lit([1 << b for b in reversed(range(len(splitters).bit_length()))])
    keys = F.lit(splitters)
    return F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= len(splitters)) & (F.try_element_at(keys, found + step) <= F.col("_key")), found + step
        ).otherwise(found),
    )


def _quantiles(sample: list, parts: int) -> list[str]:
    """Keys at the quantiles of a weighted sample."""
    rows = sorted((r["_key"], r["w"]) for r in sample)
    total, run, out = sum(w for _, w in rows), 0.0, []
    for key, w in rows:
        if int(run * parts / total) != int((run + w) * parts / total):
            out.append(key)
        run += w
    return out


def _sample(rows: DataFrame, weight: Column, total: float, expected: int) -> list:
    """Keys drawn with a chance in proportion to weight, about `expected` of them."""
    # The chance comes from a hash, so that a task that runs again draws the same keys.
    u = F.pmod(F.xxhash64("_key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = weight * F.lit(expected / total)
    drawn = rows.where(u < chance).select("_key", F.greatest(weight, F.lit(total / expected)).alias("w"))
    return drawn.collect()


def place(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Add _rank (rows before) and _before (bytes before) in key order; also returns the sums."""
    sums = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, total = sums["n"], sums["b"] or 0
    if not n:
        return rows.withColumn("_rank", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")), 0, 0
    # Half a record's weight is its size and half the mean size, so that ranges are bounded in rows too.
    weight = (F.col("size") + F.lit(total / n)) / 2
    splitters = _quantiles(_sample(rows, weight, float(total), RANGES * SAMPLE_PER_RANGE), RANGES)
    for _ in range(ROUNDS):
        ranged = rows.withColumn("_range", _range_of(splitters))
        stats = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum(weight).alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
        known = stats.collect()  # a row for each range
        full = [r for r in known if r["w"] > OVERFULL * total / RANGES and r["n"] > 1 and r["lo"] < r["hi"]]
        if not full:
            break
        part = ranged.where(F.col("_range").isin([r["_range"] for r in full]))
        in_full = float(sum(r["w"] for r in full))
        cuts = max(2 * len(full), int(2 * RANGES * in_full / total))
        more = _quantiles(_sample(part, weight, in_full, cuts * SAMPLE_PER_RANGE), cuts)
        grown = sorted({*splitters, *more})
        if len(grown) == len(splitters):
            break
        splitters = grown
    ranged = cut(rows.withColumn("_range", _range_of(splitters)))
    known = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    known.sort(key=lambda r: r["_range"])
    # What stands before each range: two lists as long as the number of ranges, some thousands at most.
    row0, byte0 = [0] * (len(splitters) + 2), [0] * (len(splitters) + 2)
    for r in known:
        row0[r["_range"] + 1], byte0[r["_range"] + 1] = r["n"], r["b"]
    before = lambda sums: F.get(F.lit(list(accumulate(sums))), F.col("_range")).cast("long")
    inside = Window.partitionBy("_range").orderBy("_key", "doc_id", "text_crc32", "size")
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_rank", before(row0) + F.row_number().over(inside) - 1).withColumn(
        "_before", before(byte0) + F.coalesce(F.sum("size").over(run), F.lit(0))
    )
    return placed.select(*rows.columns, "_rank", "_before"), n, total


def jump_hash(key: Column, shards: int) -> Column:
    """A shard of `shards` from a 64-bit key such that one more shard moves rows only into itself.

    Walks the shard counts at which the key would move: at each count k a hash of (key, k)
    decides with chance 1 / k.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)),
        F.lit(0),
        lambda at, k: F.when(F.pmod(F.xxhash64(key, k), k.cast("long")) == 0, k - 1).otherwise(at),
    )


def shard(docs: DataFrame, shards: int, law: str = "bytes") -> DataFrame:
    """Records with law, shard, slot (gapless in each shard) and grown_shard."""
    rows = cut(records(docs))
    placed, n, total = place(rows)
    none = F.lit(None).cast("int")
    if law == "bytes":
        # The middle of a record decides, so that no shard is off by more than a record.
        middle = F.col("_before") + F.expr("size div 2")
        at = F.least(F.floor(middle * F.lit(float(shards) / max(total, 1))), F.lit(shards - 1)).cast("int")
        grown = none
    elif law == "rows":
        at = F.expr(f"cast(_rank * {shards} div {max(n, 1)} as int)")
        grown = none
    elif law == "key":
        at = jump_hash(F.xxhash64("doc_id"), shards).cast("int")
        grown = jump_hash(F.xxhash64("doc_id"), shards + 1).cast("int")
    else:
        raise ValueError(f"unknown law: {law}")
    placed = placed.withColumn("shard", at).withColumn("grown_shard", grown)
    if law == "key":
        placed = _slots(placed)
    else:
        # Shards are stretches of one order, so a slot is a rank less the shard's first rank.
        placed = cut(placed)
        firsts = {r["shard"]: r["m"] for r in placed.groupBy("shard").agg(F.min("_rank").alias("m")).collect()}  # a row for each shard
        first = F.get(F.lit([firsts.get(k, 0) for k in range(shards)]), F.col("shard"))
        placed = placed.withColumn("slot", (F.col("_rank") - first).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def _slots(placed: DataFrame) -> DataFrame:
    """Slots where shards are not stretches of the order: counts by (shard, stretch), then ranks inside."""
    stretch = F.expr("_rank div 4096")
    cells = placed.withColumn("_cell", stretch)
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("shard", "_cell").agg(F.count("*").alias("_c"))
    bases = sizes.select("shard", "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_rank")
    return cells.withColumn("_in", F.row_number().over(inside) - 1).join(bases, ["shard", "_cell"]).withColumn("slot", F.col("_base") + F.col("_in"))


def write_shards(docs: DataFrame, shards: int, path: str, law: str = "bytes") -> None:
    """Write the records as Parquet, a folder for each shard (of "bytes", "rows" or "key" law)."""
    placed = shard(docs, shards, law).select("doc_id", "text_crc32", "size", "shard", "slot").withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "text_crc32", "size").orderBy("shard", "slot")))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    numbered = docs.withColumn("_crc", F.crc32(raw)).withColumn("_size", F.octet_length(raw).cast("long") + OVERHEAD)
    numbered = numbered.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_crc", "_size").orderBy("text")))
    joined = numbered.alias("d").join(
        placed.alias("p"),
        F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("_crc") == F.col("text_crc32")) & (F.col("_size") == F.col("size")) & (F.col("d._copy") == F.col("p._copy")),
    )
    joined.select("d.doc_id", "d.text", "p.shard", "p.slot").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: Law "bytes" for 40 shards in SQL. crc32 is folded over the bytes, with its table made by the usual eight steps.
ORACLE = """
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8
), records AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
                         lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
         concat(coalesce(md5(text), ''), coalesce(md5(CAST(doc_id AS VARCHAR)), '')) AS k
  FROM documents, crc
), placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY k, doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
  FROM records
), sharded AS (
  SELECT *, CAST(least(floor((before + size // 2) * (CAST(40 AS DOUBLE) / total)), 39) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k, doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""
