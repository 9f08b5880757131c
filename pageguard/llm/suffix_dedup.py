"""Operator 3: exact removal of repeated byte strings with sparse suffix arrays, sorted deep-shallow.

A window is a string of `length` bytes (400). Every window is ruled by one anchor: the leftmost least hash among its
strings of `core` bytes. Equal windows have equal anchors at equal places, so only anchors are shuffled (about one for
each (length - core) / 2 bytes), never all suffixes.

1. Each run of windows with the same anchor is one row: the core's hash, a digest of the run's whole extent, its place.
2. Cores that occur once are done. Runs whose whole extent occurs again consist of repeated windows only. (Extents count
   as equal where the core's 64-bit hash and a 64-bit BLAKE2b digest of extent and place of the core in it are both equal.)
3. Where a core has several extents, one run of each is cut out of its text and compared in its core's group: the
   suffixes that start at the anchors and the reversed prefixes that end there are both sorted deep-shallow, by bytes: a
   multikey quicksort over 8-byte words to SHALLOW bytes past the core, then a blind trie for each group that is still
   equal. Two windows at one distance from their anchors are equal iff they lie in one class of each order, cut at their
   two lengths.
4. A core with more than GROUP extents does not go to one task: its windows are split into BANDS ranges of distances, and a
   range's extents into groups by the string that all their windows share. These groups are sorted like those of 3; the
   few that still have more than GROUP extents hold one string of nearly the windows' length at one place, and their
   windows are counted in Spark by digests (64 bits, within the group) instead.
5. Windows of whole words (WordWindows) go the same way, with words for bytes: a core is so many words, and a class of the
   sorted contexts is cut at each window's own length in bytes.
6. Texts that occur more than once are repeated as a whole; the other documents' repeated windows are joined with their
   text by its hash (128 bits), and the union of the windows' bytes is removed.
7. digest_rows also says which documents share a passage of PASSAGE_WORDS words with another one: the same steps over
   windows of words, where a class counts only if its members come from several documents.

Defined results: null is the empty text; texts shorter than a window keep all bytes; repeated rows are copies of each
other; matches never cross documents; removing bytes can cut a character, whose other bytes stay in `kept` as they are
(kept_documents drops such bytes from the text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, SpanHash, materialize, steps, text_buffer, tidy, word_spans

LENGTH, CORE = 400, 200
#: Bytes past the core that the multikey sort looks at before blind tries take over.
SHALLOW = 16
#: Extents of one core that one task compares.
GROUP = 400
#: Ranges of distances into which the windows of a larger core are split.
BANDS = 16
#: Words of a passage that counts as shared between documents.
PASSAGE_WORDS = 51
#: Bytes of context that are compared in one go.
GO = 4 << 20
_PLACE = np.uint64((1 << 31) - 1)


def anchored_runs(data: np.ndarray, off: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window (in data), windows, anchor's distance from the first, hashes of core and extent."""
    size = np.diff(off)
    width = length - core + 1
    none = np.zeros(0, np.int64)
    if len(data) < length or not (size >= length).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spans = SpanHash(data)
    h = spans.rolling(core)
    first, count, x = _by_anchor(h, off, length, width)
    reach = x - first
    row = np.searchsorted(off, first, "right") - 1
    return row, first - off[row], count, reach, h[x], _extents(data, first, first + count - 1 + length, reach)


def digest(data: bytes, salt: int = 0) -> int:
    """64 bits of BLAKE2b, signed."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=salt.to_bytes(8, signed=True)).digest(), signed=True)


def _extents(data: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Digests of the strings begin to end together with the distance of their cores."""
    raw, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    out = b"".join([blake(raw[b:e], digest_size=8, salt=r.to_bytes(4)).digest() for b, e, r in zip(begin.tolist(), end.tolist(), reach.tolist())])
    return np.frombuffer(out, np.uint64)


def _by_anchor(h: np.ndarray, off: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows and anchor of each run of windows of `length` units with one anchor; h: hashes of cores, off: rows' first units."""
    size = np.diff(off)
    n = len(h)
    v = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    v[:n] = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    ahead = np.minimum.accumulate(v.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(v.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & _PLACE).astype(np.int64)
    fits = np.zeros(starts + 1, np.int32)
    long = size >= length
    np.add.at(fits, off[:-1][long], 1)
    np.add.at(fits, np.minimum(off[1:][long] - length + 1, starts), -1)
    p = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    x = anchor[p]
    new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return p[new], np.diff(np.concatenate((new, [len(p)]))), x[new]


def anchored_word_runs(data: np.ndarray, off: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """anchored_runs for windows of `length` words and cores of `core` words; windows and distances in words, places in bytes, and each extent's bytes."""
    starts, ends, first_word = word_spans(data, off)
    none = np.zeros(0, np.int64)
    if not (np.diff(first_word) >= length).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    spans = SpanHash(data)
    h = spans(starts[: len(starts) - core + 1], ends[core - 1 :])
    first, count, x = _by_anchor(h, first_word, length, length - core + 1)
    reach = x - first
    row = np.searchsorted(first_word, first, "right") - 1
    begin, end = starts[first], ends[first + count - 1 + length - 1]
    return row, begin - off[row], count, reach, h[x], _extents(data, begin, end, reach), end - begin


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text (null as empty), and the two hashes k1 and k2 that stand for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    return own.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})


def runs(keyed: DataFrame, windows: ByteWindows | WordWindows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            row, first, count, reach, h, extent, size = windows.runs(*text_buffer(batch.column(0)))
            keys = [batch.column(i).take(pa.array(row)) for i in (1, 2)]
            ints = [pa.array(c.astype(np.int32)) for c in (first, count, reach, size)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(h.astype(np.int64)), pa.array(extent.astype(np.int64)), *ints], names=["k1", "k2", "core", "extent", "first", "windows", "reach", "bytes"])

    return keyed.select("text", "k1", "k2").mapInArrow(tidy(run), "k1 long, k2 long, core long, extent long, first int, windows int, reach int, bytes int")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by branch bytes only; each insertion compares one stored string in full, to find where to branch."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        # A node is [depth, {byte at depth, or -1 for the end: child}, any leaf below]; a leaf is [-1, its strings, one].
        self.root: list | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i], i]
            return
        node = self.root
        while node[0] >= 0:  # blind: follow known branch bytes, else any child
            child = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            if child is None:
                break
            node = child
        shared = common_prefix(s, self.strings[node[2]])
        parent, key, node = None, None, self.root
        while 0 <= node[0] < shared:
            parent, key = node, s[node[0]]
            node = node[1][key]
        other = self.strings[node[2]]
        if node[0] < 0 and shared == len(s) == len(other):
            node[1].append(i)
            return
        at = s[shared] if shared < len(s) else -1
        if node[0] == shared:
            if at in node[1]:  # only an end can be there already: an equal string
                node[1][at][1].append(i)
            else:
                node[1][at] = [-1, [i], i]
            return
        split = [shared, {(other[shared] if shared < len(other) else -1): node, at: [-1, [i], i]}, node[2]]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def order(self) -> tuple[list[int], list[int]]:
        """The strings in order, and each one's common prefix with the one before it (-1 for the first)."""
        out, shared, stack = [], [], [(self.root, -1)]
        while stack:
            node, depth = stack.pop()
            if node[0] < 0:
                n = len(self.strings[node[2]])
                for i in node[1]:
                    out.append(i)
                    shared.append(depth)
                    depth = n
            else:
                children = [node[1][k] for k in sorted(node[1])]
                stack += [(c, node[0]) for c in reversed(children[1:])]
                stack.append((children[0], depth))
        return out, shared


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of unsigned numbers, and the places where runs of equal rows begin, with the end.

    Each round splits every open segment three ways around its pivot (the median of its first, middle and last row) in the
    column that it has come to; the part equal to the pivot goes on to the next column.
    """
    n, columns = keys.shape
    order, starts, depth = np.arange(n), np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    while True:
        size = np.diff(np.append(starts, n))
        open_ = (size > 1) & (depth < columns)
        if not open_.any():
            return order, np.append(starts, n)
        first, count, at = starts[open_], size[open_], depth[open_]
        segment = np.repeat(np.arange(len(first)), count)
        place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(segment))
        value = keys[order[place], at[segment]]
        three = np.sort(keys[order[np.stack((first, first + count // 2, first + count - 1))], at], axis=0)
        pivot = three[1][segment]
        part = 3 * segment + (value >= pivot) + (value > pivot)
        moved = np.argsort(part, kind="stable")
        order[place] = order[place][moved]
        part = part[moved]
        new = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        starts = np.concatenate((starts[~open_], place[new]))
        depth = np.concatenate((depth[~open_], at[part[new] // 3] + (part[new] % 3 == 1)))
        sort = np.argsort(starts)
        starts, depth = starts[sort], depth[sort]


def deep_shallow(group: np.ndarray, strings: list[bytes], skip: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings within their groups and common prefixes with the one before, -1 at a group's start.

    All strings of a group share their first `skip` bytes, if they have as many.
    """
    n = len(strings)
    packed = b"".join(s[skip : skip + shallow].ljust(shallow, b"\0") for s in strings)
    words = np.frombuffer(packed, ">u8").reshape(n, shallow // 8).astype(np.uint64)
    length = np.array([min(max(len(s) - skip, 0), shallow) for s in strings])
    order, edge = multikey_quicksort(np.column_stack((group.astype(np.uint64), words, length.astype(np.uint64))))
    same_group = group[order][1:] == group[order][:-1]
    tied = np.ones(max(n - 1, 0), bool)
    tied[edge[1:-1] - 1] = False
    shared = np.full(n, -1, np.int64)
    for i in np.flatnonzero(same_group & ~tied) + 1:
        shared[i] = common_prefix(strings[order[i - 1]], strings[order[i]])
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 1:
            trie = BlindTrie(strings)
            for i in order[a:b]:
                trie.insert(int(i))
            out, lcp = trie.order()
            head = shared[a]
            order[a:b], shared[a:b] = out, lcp
            shared[a] = head
            if a and group[order[a - 1]] == group[order[a]]:
                shared[a] = common_prefix(strings[order[a - 1]], strings[order[a]])
            if b < n and group[order[b]] == group[order[b - 1]]:
                shared[b] = common_prefix(strings[order[b - 1]], strings[order[b]])
    return order, shared


def _numbered(strings: list[bytes]) -> np.ndarray:
    """Equal strings have equal numbers."""
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(s, len(number)) for s in strings], np.int64)


def _repeated(back: np.ndarray, sources: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Whether each member's class has another member, or, given least and greatest sources, members from several."""
    if sources is None:
        return np.bincount(back)[back] > 1
    low, high = np.full(back.max() + 1, np.iinfo(np.int64).max), np.full(back.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, back, sources[0])
    np.maximum.at(high, back, sources[1])
    return (low != high)[back]


def repeated_windows(contexts: list[bytes], reach: np.ndarray, count: np.ndarray, length: int, core: int, sources: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """contexts x (length - core + 1) booleans: whether the window at each distance from the anchor has an equal, around an equal core.

    With sources (least and greatest of the documents that each context stands for), an equal in another document.
    """
    n = len(contexts)
    group = _numbered([c[r : r + core] for c, r in zip(contexts, reach.tolist())])
    right = deep_shallow(group, [c[r:] for c, r in zip(contexts, reach.tolist())], core)
    left = deep_shallow(group, [c[:r][::-1] for c, r in zip(contexts, reach.tolist())], 0)
    rank = []
    for order, _ in (right, left):
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        rank.append(at)
    out = np.zeros((n, length - core + 1), bool)
    least = reach - count + 1
    for a in range(int(least.min()), int(reach.max()) + 1):
        live = np.flatnonzero((least <= a) & (a <= reach))
        if not len(live):
            continue
        r = np.cumsum(right[1] < length - a)[rank[0][live]]
        s = np.cumsum(left[1] < a)[rank[1][live]]
        back = np.unique(r * (n + 1) + s, return_inverse=True)[1]
        out[live, a] = _repeated(back, sources and (sources[0][live], sources[1][live]))
    return out


def repeated_word_windows(contexts: list[bytes], reach: np.ndarray, count: np.ndarray, length: int, core: int, sources: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """repeated_windows for windows of words; contexts begin and end with a word.

    Windows at one distance differ in bytes: two are equal iff both sides need the same bytes and lie in one class, cut there.
    """
    n = len(contexts)
    at = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
    starts, ends, first = word_spans(np.frombuffer(b"".join(contexts), np.uint8), at)
    anchor = first[:-1] + reach
    begin, end = starts[anchor] - at[:-1], ends[anchor + core - 1] - at[:-1]  # the core's, in its context
    group = _numbered([c[b:e] for c, b, e in zip(contexts, begin.tolist(), end.tolist())])
    right = deep_shallow(group, [c[e:] for c, e in zip(contexts, end.tolist())], 0)
    left = deep_shallow(group, [c[:b][::-1] for c, b in zip(contexts, begin.tolist())], 0)
    rank = []
    for order, _ in (right, left):
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        rank.append(place)

    def classes(shared: np.ndarray, place: np.ndarray, need: np.ndarray) -> np.ndarray:
        out = np.empty(len(need), np.int64)
        for size in np.unique(need):
            own = need == size
            out[own] = np.cumsum(shared < size)[place[own]]
        return out

    out = np.zeros((n, length - core + 1), bool)
    least = reach - count + 1
    for a in range(int(least.min()), int(reach.max()) + 1):
        live = np.flatnonzero((least <= a) & (a <= reach))
        if not len(live):
            continue
        window = anchor[live] - a
        after = ends[window + length - 1] - at[live] - end[live]
        before = begin[live] + at[live] - starts[window]
        keys = np.stack([classes(right[1], rank[0][live], after), after, classes(left[1], rank[1][live], before), before], axis=1)
        back = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
        out[live, a] = _repeated(back, sources and (sources[0][live], sources[1][live]))
    return out


@dataclass(frozen=True)
class ByteWindows:
    """Windows of `length` bytes with cores of `core` bytes."""

    length: int
    core: int

    def long_enough(self, text: str) -> Column:
        return F.octet_length(text) >= self.length

    def runs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        out = anchored_runs(data, off, self.length, self.core)
        return *out, out[2] - 1 + self.length

    def repeated(self, contexts: list[bytes], reach: np.ndarray, count: np.ndarray, sources: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        return repeated_windows(contexts, reach, count, self.length, self.core, sources)

    def units(self, context: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of a context's units, here bytes."""
        first = np.arange(len(context))
        return first, first + 1


@dataclass(frozen=True)
class WordWindows:
    """Windows of `length` whole words, and what stands between them, with cores of `core` words."""

    length: int
    core: int

    def long_enough(self, text: str) -> Column:
        return (F.octet_length(text) >= 2 * self.length - 1) & (F.regexp_count(text, F.lit(WORD_PATTERN)) >= self.length)

    def runs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        return anchored_word_runs(data, off, self.length, self.core)

    def repeated(self, contexts: list[bytes], reach: np.ndarray, count: np.ndarray, sources: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        return repeated_word_windows(contexts, reach, count, self.length, self.core, sources)

    def units(self, context: bytes) -> tuple[np.ndarray, np.ndarray]:
        return word_spans(np.frombuffer(context, np.uint8), np.array([0, len(context)]))[:2]


def _intervals(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


_CONTEXT = "core long, extent long, group long, shift int, reach int, windows int, low long, high long, context binary"
_CONTEXT_TYPES = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()]
_FOUND = "core long, extent long, begins array<int>, ends array<int>"
_NAMES = ["core", "extent", "group", "shift", "reach", "windows", "low", "high", "context"]


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _CONTEXT_TYPES)], names=_NAMES)


def _contexts():
    """Cut the extents asked for (struct list `asked`) out of their texts; a context's group is its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows: list[tuple] = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                rows += [(q["core"], q["extent"], q["core"], 0, q["reach"], q["windows"], q["low"], q["high"], data[q["first"] : q["first"] + q["bytes"]]) for q in asked]
            yield _context_rows(rows)

    return run


def _bands(windows: ByteWindows | WordWindows):
    """Contexts cut to each range of distances of their windows; the group is a digest of the range and of what all its windows share."""
    far = windows.length - windows.core
    width = -(-(far + 1) // BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for q in batch.to_pylist():
                starts, ends = windows.units(q["context"])
                reach, least = q["reach"], q["reach"] - q["windows"] + 1
                for low in range(0, far + 1, width):
                    high = min(low + width - 1, far)
                    a, b = max(low, least), min(high, reach)
                    if a <= b:
                        begin, end = int(starts[reach - b]), int(ends[reach - a + windows.length - 1])
                        common = q["context"][starts[reach - low] : ends[reach - high + windows.length - 1]]
                        rows.append((q["core"], q["extent"], digest(common, low), begin, b, b - a + 1, q["low"], q["high"], q["context"][begin:end]))
            yield _context_rows(rows)

    return run


def _compare(windows: ByteWindows | WordWindows, across: bool):
    """Over rows sorted by group: repeated windows of each context, whole groups at a time."""

    def done(table: pa.Table) -> pa.RecordBatch:
        reach, count, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("reach", "windows", "low", "high"))
        contexts = table.column("context").to_pylist()
        flags = windows.repeated(contexts, reach, count, (low, high) if across else None)
        begins, ends = [], []
        for context, shift, f, r, c in zip(contexts, table.column("shift").to_pylist(), flags, reach.tolist(), count.tolist()):
            b, e = _intervals(f[r - c + 1 : r + 1][::-1])  # by place in the text, the farthest from the anchor first
            first, after = windows.units(context) if b else ([], [])
            begins.append([int(first[i]) + shift for i in b])
            ends.append([int(after[i - 1 + windows.length - 1]) + shift for i in e])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([table.column("core").combine_chunks(), table.column("extent").combine_chunks(), pa.array(begins, ints), pa.array(ends, ints)], names=["core", "extent", "begins", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= GO:
                table = pa.Table.from_batches(held)
                groups = table.column("group").to_numpy()
                cut = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if groups[0] != groups[-1] else 0
                if cut:
                    yield done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held) if cut else 0
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _window_digests(windows: ByteWindows | WordWindows):
    """core, extent, group, begin and end (in the extent), distance, digest, low and high of every window of the given contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "extent", "group", "begin", "end", "distance", "digest", "low", "high"]
        types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 3
        for batch in batches:
            rows = []
            for q in batch.to_pylist():
                starts, ends = windows.units(q["context"])
                for i in range(q["windows"]):
                    begin, end = int(starts[i]), int(ends[i + windows.length - 1])
                    rows.append((q["core"], q["extent"], q["group"], begin + q["shift"], end + q["shift"], q["reach"] - i, digest(q["context"][begin:end]), q["low"], q["high"]))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    return run


def _repeated_in_contexts(contexts: DataFrame, sizes: DataFrame, windows: ByteWindows | WordWindows, group: int, across: bool) -> DataFrame:
    """core, extent, begins, ends of repeated windows; contexts of small cores by their core, of large ones by bands."""
    sized = contexts.join(sizes, "core")
    small = sized.where(F.col("in_core") <= group).select(*_NAMES)
    if not sizes.where(F.col("in_core") > group).limit(1).count():
        return small.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_compare(windows, across)), _FOUND)
    bands = materialize(sized.where(F.col("in_core") > group).select(*_NAMES).mapInArrow(tidy(_bands(windows)), _CONTEXT))
    shared = materialize(bands.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    bands = bands.join(shared, "group")
    grouped = small.unionByName(bands.where(F.col("n") <= group).select(*_NAMES)).repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_compare(windows, across)), _FOUND)
    large = bands.where(F.col("n") > group).select(*_NAMES).mapInArrow(tidy(_window_digests(windows)), "core long, extent long, group long, begin int, end int, distance int, digest long, low long, high long")
    large = materialize(large)
    key = ["group", "distance", "digest"]
    again = materialize(large.groupBy(*key).agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("greatest")).where("least != greatest" if across else "n > 1").select(*key))
    counted = large.join(again, key).select("core", "extent", F.array("begin").alias("begins"), F.array("end").alias("ends"))
    return grouped.unionByName(counted)


def marks(docs: DataFrame, windows: ByteWindows | WordWindows, group: int = GROUP, across: bool = False) -> DataFrame:
    """k1, k2, whole, begins, ends: what is repeated of each text; whole is set for texts that occur more than once.

    begins and ends are first bytes and the places after last bytes of repeated runs (unmerged, of one document). With
    across, only what also starts in another document counts, and the places are left out.
    Tables are written where a join follows an aggregation, so that both sides of the join are plain shuffles and a hot
    key can be split.
    """
    keyed = _keyed(docs)
    copies = materialize(keyed.where(windows.long_enough("text")).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("only")).where("n > 1").drop("n"))
    every = materialize(runs(keyed, windows))
    cores = materialize(every.groupBy("core").agg(F.count("*").alias("n"), (F.min("extent") != F.max("extent")).alias("mixed")).where("n > 1").select("core", "mixed"))
    shared = materialize(every.join(cores, "core"))
    place = F.struct("k1", "k2", "first", "windows", "reach", "bytes")
    extents = materialize(shared.groupBy("core", "extent", "mixed").agg(F.count("*").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high"), F.min(place).alias("at")))
    mixed = extents.where("mixed")
    sizes = materialize(mixed.groupBy("core").agg(F.count("*").alias("in_core")))
    asked = mixed.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("core", "extent", "at.first", "at.windows", "at.reach", "at.bytes", "low", "high")).alias("asked"))
    asked = materialize(asked.join(copies, ["k1", "k2"], "left"))
    # Of a text with copies, the one with the least id is read; should several have that id, equal contexts fall together.
    texts = keyed.join(asked, ["k1", "k2"]).where("only is null or doc_id = only")
    contexts = materialize(texts.select("text", "asked").mapInArrow(tidy(_contexts()), _CONTEXT).dropDuplicates(["core", "extent"]))
    found = _repeated_in_contexts(contexts, sizes, windows, group, across).where(F.size("begins") > 0)
    # One row for each extent, whether its windows were compared together, by bands, or counted one by one.
    found = materialize(found.groupBy("core", "extent").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends"))))
    whole = extents.where("low != high" if across else "n > 1").select("core", "extent", F.lit(True).alias("all"))
    part = found.join(whole, ["core", "extent"], "left_anti").select("core", "extent", F.lit(False).alias("all"), "begins", "ends")
    none = F.lit(None).cast("array<int>")
    known = materialize(whole.select("*", none.alias("begins"), none.alias("ends")).unionByName(part))
    # Copies are removed as a whole; their places would only swell what is gathered for each text.
    hits = shared.join(copies, ["k1", "k2"], "left_anti").join(known, ["core", "extent"])
    all_of = copies.select("k1", "k2", F.lit(True).alias("whole"), none.alias("begins"), none.alias("ends"))
    if across:
        return hits.select("k1", "k2").distinct().select("k1", "k2", F.lit(False).alias("whole"), none.alias("begins"), none.alias("ends")).unionByName(all_of)
    begin = F.when(F.col("all"), F.array(F.lit(0))).otherwise(F.col("begins"))
    end = F.when(F.col("all"), F.array("bytes")).otherwise(F.col("ends"))
    moved = hits.select("k1", "k2", F.explode(F.arrays_zip(F.transform(begin, lambda x: x + F.col("first")).alias("b"), F.transform(end, lambda x: x + F.col("first")).alias("e"))).alias("w"))
    gathered = moved.groupBy("k1", "k2").agg(F.collect_list("w.b").alias("begins"), F.collect_list("w.e").alias("ends"))
    return gathered.select("k1", "k2", F.lit(False).alias("whole"), "begins", "ends").unionByName(all_of)


def _cut(data: bytes, whole: bool, begins: list[int] | None, ends: list[int] | None) -> tuple[bytes, int]:
    """The bytes that stay and the number of maximal runs that go."""
    if whole:
        return b"", 1
    if not begins:
        return data, 0
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.array(begins), 1)
    np.add.at(edge, np.array(ends), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs_ = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), runs_


def cleaned(docs: DataFrame, carry: bool = False, length: int = LENGTH, core: int = CORE, group: int = GROUP, words: int = 0, passage_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every document; with carry, its row as struct `carried`, and `text`.

    With words, repeated strings of so many whole words are removed too, however few bytes they have. With passage_words,
    `repeats_passage` says whether a string of so many whole words also starts in another document. `text` is what stays, without
    the bytes of characters that a cut went through.
    """
    none = F.lit(None).cast("array<int>")
    known = materialize(marks(docs, ByteWindows(length, core), group).withColumn("passage", F.lit(False)))
    more = []
    if words:
        more.append(materialize(marks(docs, WordWindows(words, words // 2), group).withColumn("passage", F.lit(False))))
    if passage_words:
        shared = marks(docs, WordWindows(passage_words, passage_words // 2), group, across=True)
        more.append(materialize(shared.select("k1", "k2", F.lit(False).alias("whole"), none.alias("begins"), none.alias("ends"), F.lit(True).alias("passage"))))
    if more:
        for other in more:
            known = known.unionByName(other)
        all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)
        known = materialize(known.groupBy("k1", "k2").agg(F.max("whole").alias("whole"), all_of("begins"), all_of("ends"), F.max("passage").alias("passage")))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried")] if carry else []
    joined = _keyed(docs, *row).join(known, ["k1", "k2"], "left").drop("k1", "k2")
    kept = ["carried"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            raw = [t.encode() for t in col("text").to_pylist()]
            out = [_cut(t, bool(w), b, e) for t, w, b, e in zip(raw, col("whole").to_pylist(), col("begins").to_pylist(), col("ends").to_pylist())]
            n = np.array([len(t) for t in raw], np.int64)
            stay = np.array([len(k) for k, _ in out], np.int64)
            arrays = [col("doc_id"), pa.array(n), pa.array(n - stay), pa.array([s for _, s in out], pa.int64()), col("passage").fill_null(False), *[col(c) for c in kept]]
            last = pa.array([whole_characters(k) for k, _ in out], pa.string()) if carry else pa.array([k for k, _ in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*arrays, last], names=["doc_id", "n_bytes", "n_removed", "n_spans", "repeats_passage", *kept, "text" if carry else "kept"])

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, repeats_passage boolean, "
    fields += f"carried {joined.schema['carried'].dataType.simpleString()}, text string" if carry else "kept binary"
    return joined.select("doc_id", "text", "whole", "begins", "ends", "passage", *kept).mapInArrow(tidy(run), fields)


def digest_rows(docs: DataFrame) -> DataFrame:
    out = cleaned(docs, passage_words=PASSAGE_WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats_passage")


def whole_characters(data: bytes) -> str:
    """data as text, without the bytes of characters that a cut went through."""
    return data.decode(errors="ignore")


def kept_documents(docs: DataFrame, length: int = LENGTH, core: int = CORE, words: int = 0) -> DataFrame:
    """docs with repeated strings cut from their texts and n_chars (if there) set anew; columns as given."""
    out = cleaned(docs, carry=True, length=length, core=core, words=words)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"carried.`{c}`").alias(c))
    return out.select(*cols)
