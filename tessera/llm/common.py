"""What the corpus operators share: words and their hashes as numpy arrays,
Arrow slices of bounded size, stored tables, and blocks of documents that
exchange packed arrays with hash shards.

Words are ``[^\\x20\\x09-\\x0D]+``.  The separators are ASCII bytes, so words of
UTF-8 bytes are the words of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import files

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on (a longer document is its own step).
SLICE_BYTES = 2 << 20
#: Bytes of text in one block of documents that is processed together.
BLOCK_BYTES = 8 << 20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir``
    and read it back: lineage ends at files that every executor can reach, and that
    go when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files.drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks hold the texts at ``block_bytes`` each on average."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well-mixed bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if bufs[1] is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) \
        if isinstance(batch, pa.RecordBatch) else \
        pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some texts: ``start``/``end`` byte offsets into ``data`` and
    ``first`` (index of each text's first word; one more entry than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP):
        self.data, self.offsets = data, offsets
        ok = ~gap[data]
        lead, tail = ok.copy(), ok.copy()
        if len(ok):
            lead[1:] &= ~ok[:-1]
            tail[:-1] &= ~ok[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(ok))]
            lead[cuts] = ok[cuts]
            tail[cuts - 1] = ok[cuts - 1]
        self.start = np.flatnonzero(lead)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._ok = ok

    @classmethod
    def of(cls, column, gap: np.ndarray = _GAP) -> "Words":
        return cls(*text_buffers(column), gap)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (``lower``: of the word with A-Z lowered;
        ``prefix``: of its first so many bytes)."""
        byte = _BYTE_LOWER if lower else _BYTE
        lens = self.end - self.start
        if prefix is None:
            packed = self.data[self._ok]
        else:
            lens = np.minimum(lens, prefix)
            ends = np.cumsum(lens)
            packed = self.data[np.arange(ends[-1] if len(ends) else 0)
                               + np.repeat(self.start - (ends - lens), lens)]
        at = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(len(lens), np.uint64)
        i = 0
        while i < len(lens):
            j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 17), "right")) - 1)
            n = int(at[j] - at[i])
            within = np.arange(n) - np.repeat(at[i:j] - at[i], lens[i:j])
            power = np.empty(int(lens[i:j].max()), np.uint64)
            power[0] = 1
            if len(power) > 1:
                power[1:] = _BASE
                np.multiply.accumulate(power, out=power)
            value = byte[packed[at[i]:at[j]]] * power[within]
            out[i:j] = np.add.reduceat(value, at[i:j] - at[i])
            i = j
        return mix(out + lens.astype(np.uint64) * _BASE)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes (empty if too few)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out *= _BASE
        out += words[j:len(words) - n + 1 + j]
    return mix(out + np.uint64(n))


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def binary_rows(column) -> list[memoryview]:
    """The values of a binary column as buffers, without copying them."""
    if isinstance(column, pa.ChunkedArray):
        return [x for c in column.chunks for x in binary_rows(c)]
    return [x.as_buffer() for x in column]


def ints(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)
