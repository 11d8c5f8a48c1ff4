"""Token-id files: every id in the least number of bits that the vocabulary needs.

File layout (little-endian), one file for each shard of documents in ascending id order::

    magic "THWGBITS"
    blocks          BLOCK ids each (the last may be shorter), bit-packed
    block offsets   u8 x (blocks + 1), bytes from the file's start
    document table  i8 doc_id, u8 first id, u1 id-is-null, as three arrays
    footer          u4 version, u4 bits, u8 ids, u8 documents, u8 block size,
                    u8 position of the block offsets, magic

Ids are packed in groups of 64, which fill a whole number of 64-bit words at any width,
so packing and unpacking are a few numpy operations over columns, and any block can be
read by itself.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first and
comes back null; repeated rows are kept, ordered by text; other columns are not read;
an empty table makes no file and gives an empty result.
"""

from __future__ import annotations

import atexit
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, plain_id, scratch, small_batches
from .tokens import encoder

MAGIC = b"THWGBITS"
FOOTER = struct.Struct("<IIQQQQ8s")
#: Ids in a block; a multiple of 64.
BLOCK = 1 << 16
FILES_SCHEMA = "part int, path string, docs long, ids long"
INDEX_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-pack ids; the last group is filled with zeros."""
    n = len(ids)
    groups = np.zeros((-(-n // 64), 64), dtype=np.uint64)
    groups.reshape(-1)[:n] = ids
    words = np.zeros((len(groups), bits + 1), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= groups[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[:, :bits]).astype("<u8").tobytes()


def unpack(packed: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed block."""
    words = np.frombuffer(packed, dtype="<u8").reshape(-1, bits)
    ids = np.empty((len(words), 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        ids[:, j] = x & mask
    return ids.reshape(-1)[:n]


class TokenFileWriter:
    """Writes one token file to a stream that need not seek."""

    def __init__(self, stream, bits: int):
        self.out, self.bits = stream, bits
        self.at = self.out.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)
        self.blocks = [self.at]
        self.rest = np.zeros(0, dtype=np.uint32)
        self.doc_ids: list[int] = []
        self.firsts: list[int] = []
        self.nulls: list[int] = []
        self.ids = 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        for d, x in zip(doc_ids, ids):
            self.nulls.append(int(d is None))
            self.doc_ids.append(0 if d is None else d)
            self.firsts.append(self.ids)
            self.ids += len(x)
        self.rest = np.concatenate([self.rest, *ids])
        full = len(self.rest) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[full:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        at = self.at
        self.out.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.out.write(np.array(self.doc_ids, dtype="<i8").tobytes())
        self.out.write(np.array(self.firsts, dtype="<u8").tobytes())
        self.out.write(np.array(self.nulls, dtype="u1").tobytes())
        self.out.write(FOOTER.pack(1, self.bits, self.ids, len(self.doc_ids), BLOCK, at, MAGIC))


class TokenFile:
    """Random access to one token file."""

    def __init__(self, stream):
        self.f = stream
        size = stream.size()
        version, self.bits, self.ids, self.docs, self.block, at, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(self._read(at, 8 * (blocks + 1)), dtype="<u8")
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.docs), dtype="<i8")
        self.firsts = np.frombuffer(self._read(at + 8 * self.docs, 8 * self.docs), dtype="<u8")
        self.nulls = np.frombuffer(self._read(at + 16 * self.docs, self.docs), dtype="u1")

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks first to last - 1."""
        lo, hi = int(self.offsets[first]), int(self.offsets[last])
        n = min(self.ids, last * self.block) - first * self.block
        return unpack(self._read(lo, hi - lo), self.bits, n)

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        lo = int(self.firsts[k])
        hi = int(self.firsts[k + 1]) if k + 1 < self.docs else self.ids
        if lo == hi:
            return np.zeros(0, dtype=np.uint32)
        first = lo // self.block
        ids = self.blocks(first, -(-hi // self.block))
        return ids[lo - first * self.block : hi - first * self.block]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> list[tuple]:
    """Encode docs and write them as token files; returns (part, path, documents, ids) of each file.

    The list has a row for each file, not for each document. A task that runs again writes
    the same bytes under a name of its own and moves them into place.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    bits = bits_for(vocabulary)
    fs, root = filesystem(folder)
    fs.create_dir(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        fs, root = filesystem(folder)
        task = TaskContext.get()
        part, name = task.partitionId(), f"{root}/tokens-{task.partitionId():08d}.bits"
        draft = f"{name}.{task.taskAttemptId()}.tmp"
        out = stream = None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                stream = fs.open_output_stream(draft)
                out = TokenFileWriter(stream, bits)
            texts = [None if t is None or t != t else t for t in batch["text"]]
            ids = [np.frombuffer(x + end, dtype="<u4") for x in enc.encode(texts)]
            out.add([None if n else d for d, n in zip(batch["doc_id"].tolist(), batch["_null"])], ids)
        if out is not None:
            out.close()
            stream.close()
            fs.move(draft, name)
            yield pd.DataFrame({"part": [part], "path": [name], "docs": [len(out.doc_ids)], "ids": [out.ids]})

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return sorted(tuple(r) for r in plain_id(dealt, "text").mapInPandas(write, FILES_SCHEMA).collect())


def read_token_files(spark: SparkSession, files: list[tuple], folder: str) -> DataFrame:
    """Read token files back: a row for each document, as in INDEX_SCHEMA, one task a file."""
    if not files:
        return spark.createDataFrame([], INDEX_SCHEMA)
    starts = np.concatenate([[0], np.cumsum([f[3] for f in files])]).tolist()
    todo = [(f[1], s) for f, s in zip(files, starts)]
    step = 64  # blocks read at once

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for k in batch["id"]:
                path, start = todo[k]
                with fs.open_input_file(path) as stream:
                    f = TokenFile(stream)
                    ends = np.append(f.firsts[1:], np.uint64(f.ids)).astype(np.int64)
                    firsts = f.firsts.astype(np.int64)
                    crc = np.zeros(f.docs, dtype=np.int64)
                    d = 0
                    blocks = len(f.offsets) - 1
                    for b in range(0, blocks, step):
                        ids = f.blocks(b, min(blocks, b + step)).astype("<u4")
                        lo = b * f.block
                        hi = lo + len(ids)
                        while d < f.docs:
                            a, z = max(int(firsts[d]), lo), min(int(ends[d]), hi)
                            crc[d] = zlib.crc32(ids[a - lo : z - lo], int(crc[d]))
                            if ends[d] > hi:
                                break
                            d += 1
                    found = pd.DataFrame({"doc_id": pd.array(f.doc_ids, dtype="Int64"), "start": firsts + start, "n_tokens": ends - firsts, "ids_crc32": crc})
                    found.loc[f.nulls.astype(bool), "doc_id"] = pd.NA
                yield found

    return spark.range(0, len(todo), 1, len(todo)).mapInPandas(read, INDEX_SCHEMA)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs as token files in the shared folder and read them back.

    The files stay until the Python driver ends, since the result is read from them.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    files = write_token_files(docs, tokenizer_path, end_id, folder)

    def drop() -> None:
        fs, root = filesystem(folder)
        fs.delete_dir(root)

    atexit.register(drop)
    return read_token_files(spark, files, folder)
