"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its letter 3- and 4-grams (over UTF-8 bytes, lower
case, all else a blank), hashed to BUCKETS rows; a linear layer and softmax give the
languages. Training is stochastic gradient descent in numpy on a bounded sample of
labelled rows. Since the whole is linear up to the softmax, embeddings and layer are
multiplied into one table of bucket by language before they are applied.

A part of the sample is held back to calibrate: a temperature makes probabilities match
frequencies, and the rejection threshold lets the accepted ones be right at least TARGET of
the time where rejecting the least probable texts can reach that. A text is never rejected
where the accuracy near its probability is at least LOCAL of that among the more probable
half, nor more than MOST_REJECTED of the rows held back, so wrong labels on clean texts, which
are errors at any probability, do not raise the threshold. Texts without a letter are always
rejected.

Defined cases: lang_pred of a null text, or of one without a letter, is "und" with score 0;
rows with null lang, null text or null doc_id are not learned from; without any labelled
row every prediction is "und" with score 0; repeated rows are judged each; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, release, small_batches, working

UND = "und"
BUCKETS = 1 << 16
DIM = 16
#: Bound of the training sample: labelled rows of each language, and characters of a row in it.
TRAIN_ROWS, TRAIN_CHARS = 1000, 20_000
#: Share of right answers that accepted ones must reach on the rows held back.
TARGET = 0.99
#: Accuracy near the threshold, relative to the more probable half, and the largest share of the rows held back that it may reject.
LOCAL, MOST_REJECTED = 0.9, 0.05
CHUNK = 1 << 19

#: ASCII: letters to lower case, all else to a blank. Bytes of other characters stay.
_FOLD = bytes(
    (i | 32) if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def _codes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the 3- and 4-grams that end at each byte, and whether each counts.

    Grams of which the last two bytes are blanks are left out.
    """
    b = raw.astype(np.uint32)
    tri = b[3:] | b[2:-1] << np.uint32(8) | b[1:-2] << np.uint32(16)
    keep = ~((raw[3:] == 32) & (raw[2:-1] == 32))
    four = (tri ^ (b[:-3] << np.uint32(24))) * np.uint32(0x9E3779B1)
    tri = tri * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.stack([(tri >> shift), (four >> shift)]), keep


def _fold(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" "


def has_letter(text: str) -> bool:
    """Whether a character of the text is of Unicode's letters; signs and numbers that look like some are not."""
    return any(map(str.isalpha, text))


class Model:
    """languages, and a table of BUCKETS x languages whose mean over grams is the logits."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, threshold: float):
        self.languages, self.table = languages, table.astype(np.float32)
        self.temperature, self.threshold = temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean logits of each text, over all of its grams."""
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw = np.frombuffer(b"  " + _fold(text), dtype=np.uint8)
            for lo in range(0, max(1, len(raw) - 3), CHUNK):
                codes, keep = _codes(raw[lo : lo + CHUNK + 3])
                for c in codes:
                    c = c[keep]
                    for k in range(len(self.languages)):
                        sums[i, k] += np.take(self.columns[k], c).sum()
                    counts[i] += len(c)
        return sums / np.maximum(counts, 1)[:, None]

    @property
    def columns(self) -> list[np.ndarray]:
        if not hasattr(self, "_columns"):
            self._columns = [np.ascontiguousarray(self.table[:, k]) for k in range(self.table.shape[1])]
        return self._columns

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [t is not None and t == t and has_letter(t) for t in texts]
        names, score = [UND] * len(texts), np.zeros(len(texts))
        at = [i for i, f in enumerate(found) if f]
        if at and self.languages:
            p = _softmax(self.logits([texts[i] for i in at]) / self.temperature)
            best = p.argmax(axis=1)
            for i, k in zip(at, best):
                names[i] = self.languages[k]
            score[at] = p[np.arange(len(at)), best]
        return names, score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list:
    """At most about `rows` labelled rows of each language: those of the least hashes."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    limit = F.lit(0)
    for r in counts:
        limit = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, rows / r["count"]) * (1 << 30)))).otherwise(limit)
    drawn = labelled.where((draw < limit) & (F.length("text") <= chars))
    return drawn.select("text", "lang").collect()


def train(rows: list, seed: int = 0, epochs: int = 6, step: float = 0.5, grams: int = 1024) -> Model:
    """Train on (text, lang) rows; each visit of a row draws at most `grams` of its grams."""
    rows = [r for r in rows if r[0] and has_letter(r[0])]
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([languages.index(r[1]) for r in rows])
    held = len(rows) // 5 if len(rows) >= 10 else 0
    docs = []
    for text, _ in rows:
        codes, keep = _codes(np.frombuffer(b"  " + _fold(text), dtype=np.uint8))
        docs.append(np.concatenate([c[keep] for c in codes]).astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    weight = np.bincount(y[held:], minlength=len(languages))
    weight = weight.sum() / np.maximum(weight, 1) / len(languages)
    steps, total = 0, epochs * (len(rows) - held)
    for _ in range(epochs):
        for i in held + rng.permutation(len(rows) - held):
            ids = docs[i]
            if len(ids) > grams:
                ids = ids[rng.integers(0, len(ids), grams)]
            if not len(ids):
                continue
            rate = step * (1 - steps / total)
            steps += 1
            mean = emb[ids].mean(axis=0)
            z = mean @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            # Each gram's gradient is back / n; the usual fast form leaves the n to the rate.
            np.subtract.at(emb, ids, (rate * back / len(ids) ** 0.5).astype(np.float32))
    model = Model(languages, emb @ layer, 1.0, 0.0)
    if held:
        _calibrate(model, [r[0] for r in rows[:held]], y[:held])
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    z = model.logits(texts)
    at = np.arange(len(y))
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(z / t)[at, y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    model.threshold = _threshold(p.max(axis=1), p.argmax(axis=1) == y)


def _rising(right: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to `right` in squares (pooled adjacent violators)."""
    pools: list[list[float]] = []
    for r in right:
        pools.append([float(r), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, count = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += count
    return np.repeat([t / c for t, c in pools], [int(c) for _, c in pools])


def _threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The score under which texts are rejected, from the rows held back."""
    order = np.argsort(score, kind="stable")
    score, right = score[order], right[order]
    n = len(score)
    kept = np.cumsum(right[::-1])[::-1] / np.arange(n, 0, -1)  # accuracy with the k least probable rejected
    good = np.flatnonzero(kept >= TARGET)
    wanted = int(good[0]) if len(good) else n
    unsure = int((_rising(right) < LOCAL * right[n // 2 :].mean()).sum())
    k = min(wanted, unsure, int(MOST_REJECTED * n))
    return float(score[k]) if k else 0.0


def fit(docs: DataFrame, usable: Column | None = None) -> Model:
    """Train on the labelled rows of docs (text, lang) for which `usable` holds."""
    return train([(r["text"], r["lang"]) for r in sample(docs, F.lit(True) if usable is None else usable)])


def judge_of(spark: SparkSession, model: Model) -> Callable[..., Column]:
    """A function of a text column that gives a struct of lang_pred and score.

    The model is a few MB of numbers whatever the corpus, so it is broadcast.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        working("langid")
        m = shared.value
        for text in batches:
            names, score = m.predict(text.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score})
        release()

    return judge


def rejected(judged: Column, model: Model) -> Column:
    """Whether the model rejects what judge_of() gave."""
    return (judged["lang_pred"] == UND) | (judged["score"] < F.lit(model.threshold))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each document."""
    judged = docs.select("doc_id", judge_of(docs.sparkSession, model)("text").alias("judged"))
    return judged.select("doc_id", "judged.lang_pred", "judged.score", rejected(F.col("judged"), model).alias("rejected"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns and no others."""
    held = docs.select(F.struct(*columns_of(docs)).alias("own"), judge_of(docs.sparkSession, model)("text").alias("judged"))
    return held.where(~rejected(F.col("judged"), model)).select("own.*")
