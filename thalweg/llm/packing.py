"""Sum-of-squares packing of documents into training sequences.

Each piece goes where the sum of N(g)^2 over residual gaps g becomes smallest, N(g) being
the number of open sequences with g tokens left (closed and untouched ones do not
count); a new sequence is opened only for a piece that no open one holds, since
sequences are to be few. The rule is applied to every piece, longest first.

Pieces are dealt evenly to cells of about CELL_ROWS, whatever their content, and each cell
is packed by itself in one task: its last few sequences may stay open, one in some ten
thousand. Nothing reaches the driver but the number of pieces.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept; repeated
rows are packed as often as they occur; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_of, plain_id, release, small_batches, working
from .tokens import encoder

CAPACITY = 2048
#: Pieces that one cell holds, about.
CELL_ROWS = 131_072
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths fall.

    Moving a sequence from gap g to g - n changes the sum of squares by
    2 (N(g - n) - N(g) + 1), and closing it by 1 - 2 N(n). Ties: the smaller gap.
    """
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by gap
    total = np.zeros(capacity + 1)
    made = 0
    starts = np.flatnonzero(np.diff(lengths, prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)]):
        n = int(lengths[lo])
        # change[g - n]: what a piece of this length does to the sum in gap g, kept up to date below.
        change = 2 * (total[: capacity - n] - total[n:capacity] + 1)
        if len(change):
            change[0] = 1 - 2 * total[n]
        change[total[n:capacity] == 0] = np.inf
        for k in range(lo, hi):
            gap = n + int(change.argmin()) if len(change) else capacity
            if gap == capacity or change[gap - n] == np.inf:
                gap, which, made = capacity, made, made + 1
            else:
                which = open_[gap].pop()
                total[gap] -= 1
            sequence[k], offset[k] = which, capacity - gap
            left = gap - n
            if left:
                open_[left].append(which)
                total[left] += 1
            # The counts of gap and left differ now, and so do the changes from and into them.
            for g in (gap, left, gap + n, gap):
                if n <= g < capacity:
                    into = total[g - n] - total[g] + 1 if g > n else 0.5 - total[n]
                    change[g - n] = 2 * into if total[g] else np.inf
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encode docs, add the end id and cut what is longer than a sequence; the first piece takes the rest."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("tokens")
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [None if t is None or t != t else t for t in batch["text"]]
            for d, ids in enumerate(enc.encode(texts)):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                lo, k = 0, 0
                while lo < n:
                    hi = min(n, lo + ((n - lo - 1) % capacity + 1 if not lo else capacity))
                    rows.append((d, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])))
                    lo, k = hi, k + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=ids_of(batch).take(out["doc_id"].to_numpy(dtype=np.int64)))
        release()

    return plain_id(docs, "text").mapInPandas(encode, PIECES_SCHEMA)


def assign(items: DataFrame, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add sequence_id and offset to pieces (see PIECES_SCHEMA), which must not change when read twice."""
    cells = max(1, -(-items.count() // cell_rows))
    # Rows of each partition go to the cells in turn, from a cell of its own on: what a row holds has no say.
    at = F.monotonically_increasing_id()
    cell = F.pmod(at.bitwiseAND((1 << 33) - 1) + F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(cells)), F.lit(cells))
    columns = [c.split()[0] for c in PIECES_SCHEMA.split(", ")]
    dealt = plain_id(items, *columns[1:], cell.alias("_cell"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # Longest first; rows alike in all columns may change places.
        order = ["length", "_null", "doc_id", "piece", "start", "ids_crc32"]
        rows = rows.sort_values(order, ascending=[False] + [True] * 5, kind="stable")
        sequence, offset = place(rows["length"].to_numpy(), capacity)
        return rows[columns].assign(doc_id=ids_of(rows), sequence_id=(rows["_cell"].to_numpy() << 32) + sequence, offset=offset)

    return dealt.groupBy("_cell").applyInPandas(pack, f"{PIECES_SCHEMA}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs with their sequence and place in it."""
    return assign(cut(pieces(docs, tokenizer_path, end_id, capacity)), capacity)
