"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles at a time; a longer document is a step of its own.
STEP_BYTES = 500_000
#: Characters that separate words: space and the five ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pageguard-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pageguard/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch carries to a Python worker, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving freed memory back at the end of a task: workers are kept, and would keep it beside the next stage."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def join_sized(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = 100_000) -> DataFrame:
    """Join with a materialized side: broadcast if its counted rows are within limit, else let Spark shuffle."""
    return left.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def held_out(col: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(True))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches so that the text of each slice stays within limit bytes, or is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, STEP_BYTES + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 16 * STEP_BYTES:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


#: Bytes of a word that word_hashes mixes in numpy; a longer word is hashed by BLAKE2b.
_SHORT_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time, each followed by a scrambling that is not linear.

    Unlike SpanHash's polynomial, whose collisions of regular texts do not depend on its base, equal values mean equal
    words for all purposes. Costs grow with the bytes of the spans.
    """
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix64(size.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    live = np.flatnonzero((size > 0) & (size <= _SHORT_WORD))
    for at in range(0, _SHORT_WORD, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        left = np.minimum(size[live] - at, 8)
        block = eights[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        out[live] = mix64(mix64(out[live]) + block * np.uint64(0xFF51AFD7ED558CCD))
    long = np.flatnonzero(size > _SHORT_WORD)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [int.from_bytes(hashlib.blake2b(raw[b:e], digest_size=8).digest(), "little") for b, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


class SpanHash:
    """64-bit hashes of any byte spans of data, from one prefix sum of a polynomial modulo 2**64.

    Regular texts of over a thousand letters can collide (Thue-Morse words do, for every base): for finding candidates
    only, whatever decides must compare bytes or a stronger digest.
    """

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * power[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, end) ^ (end - start).astype(np.uint64))

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all spans of k bytes."""
        return mix64((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (n + 1 values); words do not cross rows."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1]
    stop = word.copy()
    stop[:-1] &= space[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)
