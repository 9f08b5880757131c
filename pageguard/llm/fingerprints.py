"""Operator 10: MinHash fingerprints of documents.

A document's shingles are its runs of SHINGLE words, as bytes; a text with fewer words uses runs of SHORT bytes, one run
if it is shorter still. Each of PERMUTATIONS universal hash functions (a * x + b modulo 2**64, the upper half kept) is
taken over all shingles in numpy, and the smallest value kept. The fingerprint is the lower 16 bits of each, as hex.

Defined results: null is the empty text; all texts without shingles share one fingerprint of `f`s; equal texts have equal
fingerprints; likeness is the share of equal permutations, so 1.0 for equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near_dedup
from .common import SpanHash, materialize, mix64, steps, text_buffer, tidy, word_spans

PERMUTATIONS = 64
SHINGLE = 5
SHORT = 5
_A = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def shingle_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles and the place of each row's first (n + 1 values)."""
    spans = SpanHash(data)
    starts, ends, first = word_spans(data, off)
    words, size = np.diff(first), np.diff(off)
    n = np.where(words >= SHINGLE, words - SHINGLE + 1, np.where(size > 0, np.maximum(size - SHORT + 1, 1), 0))
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(at[-1]) - at[row]
    by_word = words[row] >= SHINGLE
    w = np.where(by_word, first[row] + i, 0)
    b = off[row] + i
    short_end = np.minimum(b + SHORT, off[row + 1])
    if len(starts) < SHINGLE:
        return spans(b, short_end), at
    begin = np.where(by_word, starts[w], b)
    end = np.where(by_word, ends[np.minimum(w + SHINGLE - 1, len(ends) - 1)], short_end)
    return spans(begin, end), at


def signatures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x PERMUTATIONS of 32-bit minima; rows without shingles are all ones."""
    x, at = shingle_hashes(data, off)
    out = np.full((len(at) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for j in range(PERMUTATIONS):
            h = ((x * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(h, at[full])
    return out


def _hex(sig: np.ndarray) -> list[str]:
    low = np.ascontiguousarray((sig & 0xFFFF).astype(">u2"))
    return [r.tobytes().hex() for r in low]


def _low(hexes: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), ">u2").reshape(-1, PERMUTATIONS)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    return (_low(a) == _low(b)).mean(axis=1) if a else np.zeros(0)


def fingerprints(texts: pa.Array) -> list[str]:
    return _hex(signatures(*text_buffer(texts)))


def edited(text: str, following: str) -> str:
    """text with its last quarter of characters replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], prints: list[str], next_texts: list[str], next_prints: list[str]) -> list[list]:
    """Output columns of documents with their next ones at hand."""
    changed = [edited(a, b) for a, b in zip(texts, next_texts)]
    new = fingerprints(pa.array(changed, pa.string())) if changed else []
    return [ids, [len(t) for t in texts], [hashlib.sha256(c.encode()).hexdigest() for c in changed], prints, new, likeness(prints, new).tolist(), likeness(prints, next_prints).tolist()]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted range: results of all rows but the last, and the first and last rows themselves, for their neighbours."""
    last: tuple | None = None
    names = [n for n, _ in _OUT] + ["edge", "part", "edge_text"]
    part = TaskContext.get().partitionId()

    def batch_of(cols: list, edge: str | None, texts: list | None) -> pa.RecordBatch:
        n = len(cols[0])
        arrays = [pa.array(c, t) for c, (_, t) in zip(cols, _OUT)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([edge] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())], names=names)

    def edge_row(row: tuple, edge: str) -> pa.RecordBatch:
        return batch_of([[row[0]], [len(row[1])], [None], [row[2]], [None], [None], [None]], edge, [row[1]])

    for batch in steps(batches):
        ids = batch.column(0).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        prints = fingerprints(batch.column(1))
        if last is None:
            yield edge_row((ids[0], texts[0], prints[0]), "first")
        else:
            ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
        if len(ids) > 1:
            yield batch_of(_compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), None, None)
        last = (ids[-1], texts[-1], prints[-1])
    if last is not None:
        yield edge_row(last, "last")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        ids, texts, prints, next_texts, next_prints = (batch.column(i).to_pylist() for i in range(5))
        cols = _compared(ids, texts, prints, next_texts, next_prints)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _OUT)], names=[n for n, _ in _OUT])


def near_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: documents linked by at least this Jaccard similarity of their shingles.

    Signature bands (30 of 5 permutations) are joined in Spark and every pair that they propose is verified on the full
    sets of shingles before it links.
    """
    return near_dedup.near_classes(docs, shingle_hashes, percent, bands=30, rows=5)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and with the next document's.

    Texts are shuffled once, into ranges of ids. Inside a range a row's next one follows it; only the first and last row
    of each range are kept back, written with the results, and matched across ranges: the ranges are put in order by
    number and first id alone, and the last row of each is joined with the first one of the next.
    Rows with equal ids lie in one range and follow one another by text, a null id comes first.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialize(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(_ranges), f"{_SCHEMA}, edge string, part int, edge_text string"))
    # One short row for each range, whatever the input: an ordering over all of them is small.
    w = Window.partitionBy().orderBy(F.col("doc_id").asc_nulls_first())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = materialize(made.where("edge = 'first'").select("doc_id", "part").select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(whole)).alias("next_part")))
    first = made.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = made.where("edge = 'last'").select("doc_id", F.col("edge_text").alias("text"), "fingerprint", "part")
    pairs = last.join(following, "part").join(first, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    ends = pairs.mapInArrow(tidy(_edges), _SCHEMA)
    return made.where("edge is null").drop("edge", "part", "edge_text").unionByName(ends)
