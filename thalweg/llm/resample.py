"""Importance resampling towards a target distribution, over a sparse matrix of feature counts.

Features of a text are its runs of one to RUN consecutive words, hashed to buckets. The
counts of all documents are written once as a matrix of documents by buckets, in blocks of
compressed sparse rows (Parquet, a row for each block). Its column sums and those of the
target's matrix give a gain for each bucket, and the matrix times the gains gives every
document's weight; other targets need no second reading of the texts. Documents are drawn
without replacement by weight plus Gumbel noise from a hash of the id, the highest first.

The draw's order is exact: rows are dealt by sampled ranges of (score, doc_id, place in the
matrix), so a score that many rows share is divided like any other, and a row's rank is
its place in its range plus the rows of the ranges before.

Defined cases: a null text, or one without words, has no features and weight 0; a null
doc_id has the noise of an empty one and stands after others of its score; repeated rows
are rows of their own; other columns are not read; an empty table gives an empty result, an
empty target lets every gain follow from the documents alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_of, plain_id, release, scratch, small_batches

BUCKETS, RUN = 10_000, 1
#: Documents of fewer words are never drawn, and the share of the others that is, in percent.
LEAST_WORDS, PERCENT = 20, 10
#: Words whose bucket a task remembers.
KNOWN = 200_000

#: Small letters and digits of ASCII and all bytes of other characters stay; A-Z become small, all else a blank.
_FOLD = bytes((i | 32) if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 128 else 32 for i in range(256))
BLOCK = "first long, n int, ids binary, nulls binary, words binary, ends binary, buckets binary, counts binary"


class _Buckets(dict):
    """The bucket of each feature."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < KNOWN:
            self[feature] = bucket
        return bucket


def _features(words: list[bytes], run: int) -> list[bytes]:
    if run == 1:
        return words
    return [b" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def matrix(docs: DataFrame, path: str, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Write the count matrix of docs (doc_id, text) to path, and give it back as a table of BLOCK rows.

    ends: where each document's entries end; buckets and counts: an entry for each bucket that
    a document has. Numbers are little-endian: ids, words and ends of 64 bits, the rest of 32.
    """
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, first = _Buckets(buckets), 0
        for batch in batches:
            entries, rows, words = [], [], []
            for text in batch["text"]:
                found = text.translate(_FOLD).split() if text else []
                words.append(len(found))
                found = _features(found, run)
                entries.append(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)))
                rows.append(len(found))
            owner = np.repeat(np.arange(len(rows)), rows)
            cells, counts = np.unique(owner * buckets + np.concatenate([*entries, np.zeros(0, dtype=np.int64)]), return_counts=True)
            ends = np.searchsorted(cells, np.arange(1, len(rows) + 1) * buckets)
            yield pd.DataFrame(
                [(first, len(rows), batch["doc_id"].to_numpy(dtype="<i8").tobytes(), batch["_null"].to_numpy(dtype=bool).tobytes(), np.array(words, dtype="<i8").tobytes(), ends.astype("<i8").tobytes(), (cells % buckets).astype("<u4").tobytes(), counts.astype("<u4").tobytes())],
                columns=[c.split()[0] for c in BLOCK.split(", ")],
            )
            first += len(rows)
        release()

    plain_id(docs, F.col("text").cast("binary").alias("text")).mapInPandas(make, BLOCK).write.parquet(path)
    return docs.sparkSession.read.schema(BLOCK).parquet(path)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents by bucket. A task sends a row for each bucket it has, and one for each bucket comes back."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b, c in zip(batch["buckets"], batch["counts"]):
                total += np.bincount(np.frombuffer(b, dtype="<u4"), weights=np.frombuffer(c, dtype="<u4"), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "s": total[at]})

    sums = blocks.select("buckets", "counts").mapInPandas(add, "bucket long, s long").groupBy("bucket").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums:
        out[r["bucket"]] = r["s"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, rounded down."""
    n = len(own)
    s, t = float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + n)) / ((a + 1) * (t + n)))) for a, b in zip(own.tolist(), target.tolist())], dtype=np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document: the matrix times the gains, block by block."""
    small_batches(blocks.sparkSession)
    values = gain.tolist()  # a number for each bucket, sent with the function

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.array(values, dtype=np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                counts = np.frombuffer(r.counts, dtype="<u4").astype(np.int64)
                ends = np.frombuffer(r.ends, dtype="<i8")
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
                ids = pd.DataFrame({"doc_id": np.frombuffer(r.ids, dtype="<i8"), "_null": np.frombuffer(r.nulls, dtype=bool)})
                yield pd.DataFrame(
                    {"doc_id": ids_of(ids), "n_words": np.frombuffer(r.words, dtype="<i8"), "n_features": sums(counts), "weight": sums(counts * g[np.frombuffer(r.buckets, dtype="<u4")])}
                )
        release()

    return blocks.mapInPandas(times, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 2024) -> Column:
    """A thousand times Gumbel noise from a hash of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, score, ...) with rank: 1, 2, ... for the floor(percent * N / 100) highest of the N eligible rows, else null."""
    rows = cut(scored.withColumn("_row", F.monotonically_increasing_id()).withColumn("_in", F.coalesce(eligible, F.lit(False))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    # The number of a row is that of its range, and its place in it.
    dealt = rows.where("_in").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dict(dealt.groupBy(part.alias("p")).count().collect())  # a row for each range
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=0))
    rank = F.get(F.lit(before), part.cast("int")).cast("long") + place + 1
    ranked = dealt.withColumn("rank", F.when(rank <= percent * before[-1] // 100, rank))
    rest = rows.where(~F.col("_in")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, folder: str | None = None, buckets: int = BUCKETS, run: int = RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document of docs, drawn towards the texts of target.

    folder: where the matrices are written; by default one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "counts")
    own = matrix(docs, f"{folder}/documents", buckets, run)
    wanted = matrix(target.select(F.lit(0).alias("doc_id"), "text"), f"{folder}/target", buckets, run)
    gain = gains(column_sums(own, buckets), column_sums(wanted, buckets))
    scored = weights(own, gain).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    return draw(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def by_hand(docs: list[tuple], target: list[str | None], buckets: int = BUCKETS, run: int = RUN, least: int = LEAST_WORDS, percent: int = PERCENT) -> dict:
    """(n_features, weight, score, rank) by doc_id of (doc_id, text) rows with distinct ids; for tests."""
    import hashlib
    import re
    from collections import Counter

    def features(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return w, Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1))

    own, want = {d: features(t) for d, t in docs}, [features(t)[1] for t in target]
    s, t = sum((c for _, c in own.values()), Counter()), sum(want, Counter())
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    out = {}
    for d, (w, c) in own.items():
        weight = sum(n * gain[b] for b, n in c.items())
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)]
    drawn = sorted((d for d in out if out[d][4] >= least), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(drawn[: percent * len(drawn) // 100]):
        out[d][3] = k + 1
    return {d: tuple(v[:4]) for d, v in out.items()}


#: Single words and 10,000 buckets in SQL; words are hashed once each.
ORACLE = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), words AS (
  SELECT doc_id, true AS own, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT item_id, false, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT doc_id, own, w, count(*) AS c FROM words GROUP BY ALL
), bucket AS (
  SELECT w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(w)), '..')]),
                lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w FROM counted), crc
), cells AS (
  SELECT doc_id, own, b, CAST(sum(c) AS BIGINT) AS c FROM counted JOIN bucket USING (w) GROUP BY ALL
), sums AS (
  SELECT b, CAST(coalesce(sum(c) FILTER (WHERE own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (WHERE NOT own), 0) AS DOUBLE) AS t FROM cells GROUP BY b
), totals AS (
  SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM sums
), gain AS (
  SELECT b, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) AS g FROM sums, totals
), weight AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * g) AS BIGINT) AS weight FROM cells JOIN gain USING (b) WHERE own GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weight USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
