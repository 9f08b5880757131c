"""Operator 9: byte-level BPE encoding and decoding.

Every text is cut into chunks of CHUNK characters that overlap by OVERLAP. Each chunk is pre-tokenised by itself;
neighbours are stitched at the last place in their overlap where both end a piece. The pattern looks only ahead, so from a
common boundary on the pieces are those of the whole text. The last pieces of a chunk that is not the text's end are not
trusted, because more text could lengthen or split them. Where an overlap has no common boundary (a run of one kind of
character longer than it), the text from the last sure boundary on is pre-tokenised in a chunk of twice the size, and so
on, so the result is exact for every text.

The stitched pieces are then encoded: a piece that is a token is its rank; all others begin as single bytes, and the pair of
neighbours with the lowest rank is joined until no pair is a token. A batch's new pieces are merged together, one join of
each in a numpy step; a worker remembers REMEMBERED pieces. Decoding concatenates the raw bytes of the ids.

Defined results: null and empty texts have no tokens (an empty list of ids, empty bytes); repeated rows repeat; what the
pattern does not match has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from .common import tidy

CHUNK = 4_096
OVERLAP = 128
#: Pieces whose ids a worker remembers.
REMEMBERED = 300_000
#: Bytes of a piece that the joint merge takes; a longer one is merged alone, with a heap.
WIDE = 64
_NONE = np.int32(np.iinfo(np.int32).max)


def chunk_pieces(pattern: regex.Pattern, text: str, start: int, stop: int) -> tuple[list[str], list[str]]:
    """The trusted pieces of text[start:stop], and the text up to the end of each where the pattern leaves something out."""
    part = text[start:stop]
    found = [] if pattern.groups else pattern.findall(part)
    spans = found
    if len("".join(found)) != len(part):  # a gap, or groups: a piece's span begins where the one before ended
        matches = list(pattern.finditer(part))
        found = [m.group() for m in matches]
        spans = [part[a:b] for a, b in zip([0, *(m.end() for m in matches)], (m.end() for m in matches))]
    return (found, spans) if stop == len(text) else (found[:-2], spans[:-2])


def pieces(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pattern's matches in text, from overlapping chunks stitched where their boundaries meet."""
    size = len(text)
    bounds = [(s, min(s + chunk, size)) for s in range(0, max(size - overlap, 1), chunk - overlap)]
    parts = [chunk_pieces(pattern, text, *b) for b in bounds]
    out, spans = parts[0]
    if len(bounds) == 1:
        return out
    spans = list(spans)
    at, covered = sum(map(len, spans)), bounds[0][1]  # where the stitched pieces end, and what has been looked at
    for (start, stop), (found, own) in zip(bounds[1:], parts[1:]):
        if stop <= covered:
            continue
        places, end = {}, start  # the chunk's ends up to the stitched pieces' end
        for i, span in enumerate(own):
            end += len(span)
            if end > at:
                break
            places[end] = i + 1
        keep, end = len(out), at
        while keep and end > start and end not in places:
            keep -= 1
            end -= len(spans[keep])
        if end in places:
            del out[keep:], spans[keep:]
            found, own, at = found[places[end] :], own[places[end] :], end
        else:  # no boundary in common: chunks of twice the size from the last sure one on, until something can be trusted
            found, own = [], []
            while not own and stop:
                stop = min(size, at + 2 * (stop - at))
                found, own = chunk_pieces(pattern, text, at, stop)
                if stop == size:
                    break
        out += found
        spans += own
        at += sum(map(len, own))
        covered = stop
    return out


class Coder:
    """The ranks of a vocabulary file, the pre-tokeniser, and the pieces seen so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.raw = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.raw[rank] = token
        self.bytes_of, self.decimal = pa.array(self.raw, pa.binary()), pa.array([str(i) for i in range(len(self.raw))])
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.forget()

    def forget(self) -> None:
        """No piece is known. first and ids hold the places of known pieces' ids, and these."""
        self.known, self.first, self.ids = _Places(), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens as one token, or _NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)

    def merge(self, found: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces of at most WIDE bytes, all merged together."""
        out: list[tuple[int, ...]] = [()] * len(found)
        size = np.array([len(p) for p in found])
        for low, high in ((0, 6), (6, 8), (8, 11), (11, 16), (16, WIDE)):
            own = np.flatnonzero((size > low) & (size <= high))
            if not len(own):
                continue
            width = int(size[own].max()) + 1
            flat = np.frombuffer(b"".join(found[i].ljust(width, b"\0") for i in own.tolist()), np.uint8).reshape(-1, width)
            tokens = np.where(np.arange(width) < size[own][:, None], self.byte[flat], -1)
            rank = self.joined(tokens[:, :-1], tokens[:, 1:])
            place = np.arange(width - 1, dtype=np.int16)
            while len(own):
                rows = np.arange(len(own))
                at = rank.argmin(axis=1)
                best = rank[rows, at]
                ended = best == _NONE
                if ended.any():
                    for i, row in zip(own[ended].tolist(), tokens[ended].tolist()):
                        out[i] = tuple(row[: row.index(-1)])
                    live = ~ended
                    own, tokens, rank, at, best = own[live], tokens[live], rank[live], at[live], best[live]
                    rows = rows[: len(own)]
                later = place > at.astype(np.int16)[:, None]
                tokens[rows, at] = best
                np.copyto(tokens[:, :-1], tokens[:, 1:], where=later)
                tokens[:, -1] = -1
                np.copyto(rank[:, :-1], rank[:, 1:], where=later[:, :-1])
                rank[:, -1] = _NONE
                rank[rows, at] = self.joined(best, tokens[rows, at + 1])
                inner = at > 0
                rank[rows[inner], at[inner] - 1] = self.joined(tokens[rows[inner], at[inner] - 1], best[inner])
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of any length: the pairs wait in a heap by rank and place."""
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it has been joined to the one before
        before = list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != to:  # one of the two parts has changed since
                continue
            end[i], end[middle] = to, 0
            if to < n:
                before[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            left = before[i]
            if left >= 0 and (r := get(piece[left:to])) is not None:
                heapq.heappush(heap, (r, left, to))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return tuple(out)

    def learn(self) -> None:
        """Encode the pieces that have been met since the last time."""
        new = [p.encode() for p in self.known.new]
        self.known.new = []
        if not new:
            return
        made: list[tuple[int, ...]] = [(r,) if (r := self.ranks.get(p)) is not None else () for p in new]
        short = [i for i, p in enumerate(new) if not made[i] and len(p) <= WIDE]
        for i, ids in zip(short, self.merge([new[i] for i in short])):
            made[i] = ids
        made = [ids or self.merge_long(p) for ids, p in zip(made, new)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(counts.sum()))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the place of each text's first (n + 1)."""
        if len(self.known) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.forget()
        split = [pieces(self.pattern, t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.learn()
        n = (self.first[1:] - self.first[:-1])[place]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[place] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """The raw bytes of each text's ids."""
        taken = self.bytes_of.take(pa.array(ids))
        off = np.frombuffer(taken.buffers()[1], np.int32)[at] if len(ids) else np.zeros(len(at), np.int32)
        data = memoryview(taken.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


class _Places(dict):
    """Piece -> its number; a new piece gets the next one and waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `ids` (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*coder(path, pattern).encode(batch.column(1).to_pylist()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, `ids` and `decoded` (the raw bytes of the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).fill_null([])
            at = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())))
            decoded = [bytes(x) for x in coder(path, pattern).decode(ids.flatten().to_numpy(), at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, "ids").mapInArrow(tidy(run), f"`{id_col}` {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and, with_ids, `ids`: texts are encoded and decoded by one worker a task."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            ids, at = own.encode(batch.column(1).to_pylist())
            lists = _lists(ids, at)
            listed = pa.compute.binary_join(pa.ListArray.from_arrays(lists.offsets, own.decimal.take(lists.values)), ",")
            id_hash = [digest(x.as_buffer()) for x in listed]
            decoded = [digest(x) for x in own.decode(ids, at)]
            cols = [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(id_hash, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[lists] * with_ids], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
