"""Operator 12: spelling variants by a trie self-join with active-node sets.

1. word_counts: runs of letters of whole texts, A-Z in lower case, some shortened by a rule (see `shortened`), counted.
   A task adds up what it reads in a dictionary of at most HELD words and passes sums on.
2. near_words: words at distance one (one code point inserted, deleted or replaced). The vocabulary is cut into cells that
   share the ends of their words. If u and v differ by one edit and the shorter has m code points, they share their first
   m // 2 or their last m // 2 ones; so each word goes to the cells of its own length and of the length below, by its
   beginning and by its end. What is left over of the words in a cell differs by one edit again, so a cell of more than
   CELL words is cut in the same way, again and again: no cell grows with the vocabulary, and no pair is lost. A pair
   belongs to the cell of common beginnings wherever it shares enough of them; that makes it come up exactly once.
3. In a task, the cells' words stand in one trie under their cells' roots, level by level in numpy. The active nodes of a
   node at distance one are found from its parent's: the parent itself (a deletion), its siblings (a replacement), and the
   children, by the same code point, of the parent's active nodes. Insertions are deletions seen from the other side.
   Terminal pairs are what the operator emits; a task sums them up for each word before they are shuffled.
4. Forms: a word's near word of largest n (ties: the smallest), if that is FACTOR times its own. Roots follow from forms by
   pointer jumping; as n grows by FACTOR at each step, there are few rounds, and no cycles.

Defined results: null and empty texts have no words; a null id counts as the empty text in the rule of `shortened`; repeated
rows count again; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, materialize, tidy

LEAST_LETTERS, LEAST_COUNT = 6, 5
FACTOR = 5
#: One in so many runs loses a code point.
RULE = 199
#: Words of a cell that is not cut again, and words that a task counts before it passes sums on.
CELL = 2000
HELD = 300_000
#: Words of cells that are put into one trie.
TRIE = 100_000

# A text in Latin-1 (all else is `?`), with A-Z in lower case and spaces for all but A-Z, a-z and U+00C0 to U+00FF.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def shortened(doc_id: int | None, run: str) -> str:
    """run, or if RULE divides h, the crc32 of `<doc_id>:<run>`, run without its code point h % length."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % RULE else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the words of at least LEAST_LETTERS code points that occur at least LEAST_COUNT times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = crc(f"{'' if doc_id is None else doc_id}:".encode())
                own: dict[bytes, int] = {}
                for raw in (text or "").encode("latin-1", "replace").translate(_LETTERS).split():
                    if len(raw) >= LEAST_LETTERS:
                        own[raw] = own.get(raw, 0) + 1
                for raw, k in own.items():
                    word = raw.decode("latin-1")
                    if crc(raw if raw.isascii() else word.encode(), start) % RULE == 0:
                        word = shortened(doc_id, word)
                    if len(word) >= LEAST_LETTERS:
                        n[word] = n.get(word, 0) + k
                if len(n) > HELD:
                    yield sums()
                    n.clear()
        if n:
            yield sums()

    made = docs.select(id_col, text_col).mapInArrow(tidy(run), "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _split(left: Column, right: Column, bound: Column) -> Column:
    """The two cells into which a cell of words that share `left` and `right` code points is cut, for a shorter word of m."""
    half = F.floor((F.col("m") - left - right) / 2).cast("int")
    cell = lambda a, b, c: F.struct(a.cast("int").alias("left"), b.cast("int").alias("right"), c.cast("int").alias("bound"))
    return F.array(cell(left + half, right, bound), cell(left, right + half, F.least(bound, left + half)))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows and their cell's key: lengths, then the shared beginning and end."""
    ends = [F.substring("word", F.lit(1), F.col("left")), F.expr("substring(word, length(word) - right + 1, right)")]
    return rows.withColumn("cell", F.concat_ws("|", "m", "left", "right", "bound", *ends))


def cells(words: DataFrame, most: int = CELL) -> DataFrame:
    """word, n, left, right, bound and cell: each pair of words at distance one, and with a common beginning of less than
    `bound` code points in all cells that share ends, meets in exactly one cell. Cells have `most` words at most, or
    words that differ in two code points only.
    """
    own = F.length("word")
    every = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("m"))
    no = F.lit(0)
    rows = _keyed(every.select("*", F.inline(_split(no, no, F.lit((1 << 31) - 1)))))
    done = None
    while True:
        rows = materialize(rows)
        sizes = rows.where("m - left - right > 1").groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most)
        large = materialize(sizes.select("cell"))
        split = large.limit(1).count() > 0
        small = join_sized(rows, large, ["cell"], "left_anti") if split else rows
        done = small if done is None else done.unionByName(small)
        if not split:
            return done
        parts = join_sized(rows, large, ["cell"], "left_semi").select("word", "n", "m", F.inline(_split(F.col("left"), F.col("right"), F.col("bound"))))
        rows = _keyed(parts)


def _levels(root: np.ndarray, code: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The trie by depth: keys (parent * 256 + code point) of the next depth's nodes, each node's first child and number
    of children, and the word that ends at each node (-1: none). Nodes of a depth are numbers; the first are the roots.
    """
    size = np.diff(at)
    word = np.arange(len(root))
    _, node = np.unique(root, return_inverse=True)
    n, out = int(node.max()) + 1, []
    while n:
        depth = len(out)
        ends = size[word] == depth
        end = np.full(n, -1)
        end[node[ends]] = word[ends]
        word, node = word[~ends], node[~ends]
        keys, node = np.unique(node * 256 + code[at[word] + depth], return_inverse=True)
        out.append((keys, np.searchsorted(keys, np.arange(n) * 256), np.bincount(keys >> 8, minlength=n), end))
        n = len(keys)
    return out


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of `count` numbers from `first`: the range of each number, and the numbers."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - (np.cumsum(count) - count)[of] + first[of]


def _onwards(pairs: tuple[np.ndarray, ...], of_x: tuple[np.ndarray, ...], of_y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Children of x and y by the same code point; of_x and of_y: the levels on which x and y stand."""
    x, y, shared = pairs
    keys, first, count, _ = of_x
    if not len(x) or not len(of_y[0]):
        return x[:0], y[:0], shared[:0]
    of, kid = _expanded(first[x], count[x])
    wanted = y[of] * 256 + (keys[kid] & 255)
    place = np.minimum(np.searchsorted(of_y[0], wanted), len(of_y[0]) - 1)
    there = of_y[0][place] == wanted
    return kid[there], place[there], shared[of][there]


def trie_pairs(root: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words at distance one under the same root, each once, and how many code points they share at the beginning.

    root: a number for each word; code, at: the words' code points (under 256) and their places (n + 1 values). The words of
    a root are distinct.
    """
    none = np.zeros(0, np.int64)
    out = [(none, none, none)]
    levels = _levels(root, code, at) if len(root) else []
    # Active nodes at distance one: `same` on one level, `deeper` with x one level below y.
    same = deeper = (none, none, none)
    for depth, level in enumerate(levels):
        keys, first, count, end = level
        for (x, y, shared), end_y in ((same, end), (deeper, levels[depth - 1][3])):
            both = (end[x] >= 0) & (end_y[y] >= 0)
            out.append((end[x[both]], end_y[y[both]], shared[both]))
        kids, up = np.arange(len(keys)), keys >> 8
        of, other = _expanded(kids + 1, first[up] + count[up] - kids - 1)
        moved = _onwards(deeper, level, levels[depth - 1])
        other_parent = up[moved[0]] != moved[1]  # a child and its parent come anew, with all of the parent in common
        moved = tuple(c[other_parent] for c in moved)
        deeper = tuple(map(np.concatenate, zip(moved, (kids, up, np.full(len(kids), depth)))))
        same = tuple(map(np.concatenate, zip(_onwards(same, level, level), (of, other, np.full(len(of), depth)))))
    return tuple(map(np.concatenate, zip(*out)))


def _best(words: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """For each word that is an x: the number of its y, and of these the one of largest n, the smallest first."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words)] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(x)])))
    cols = [pa.array(words[x[first]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[y[first]], pa.int64()), pa.array(words[y[first]], pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["word", "n_near", "near_n", "near"])


def _trie_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole cells, TRIE words or more at a time, through one trie; rows come in the order of their cells."""

    def near(table: pa.Table) -> pa.RecordBatch:
        word = np.array(table.column("word").to_pylist(), object)
        n, m, left, right, bound = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "m", "left", "right", "bound"))
        size = np.array([len(w) for w in word], np.int64)
        middle = [w[a : k - b].encode("latin-1") for w, a, b, k in zip(word, left.tolist(), right.tolist(), size.tolist())]
        at = np.concatenate(([0], np.cumsum([len(x) for x in middle]))).astype(np.int64)
        root = table.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()
        x, y, shared = trie_pairs(root, np.frombuffer(b"".join(middle), np.uint8).astype(np.int64), at)
        own = (np.minimum(size[x], size[y]) == m[x]) & (left[x] + shared < bound[x])
        x, y = x[own], y[own]
        return _best(word, n, np.concatenate((x, y)), np.concatenate((y, x)))

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(batch.schema.get_field_index("cell"))
        if rows >= TRIE:
            # The batch's rows up to the last change of cell complete what is held.
            last = held[-1].column(held[-1].schema.get_field_index("cell"))[-1]
            changes = np.flatnonzero(np.array(pa.compute.not_equal(cell, pa.concat_arrays([pa.array([last.as_py()], cell.type), cell.slice(0, len(cell) - 1)]))))
            if len(changes):
                cut = int(changes[-1])
                yield near(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield near(pa.Table.from_batches(held))


def near_words(words: DataFrame, most: int = CELL) -> DataFrame:
    """word, n_near, near_n and near (the near word of largest n, the smallest of several) of the words that have near ones."""
    placed = cells(words, most).repartition("cell").sortWithinPartitions("cell")
    cols = ["word", "n", "m", "left", "right", "bound", "cell"]
    made = placed.select(*cols).mapInArrow(tidy(_trie_batches), "word string, n_near long, near_n long, near string")
    least = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    both = made.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("best"))
    return both.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the chain of forms that starts at each word ends; forms: word and form."""
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(state.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        state = new.select("word", "root")


def variant_groups(docs: DataFrame, most: int = CELL) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = materialize(word_counts(docs))
    near = words.join(near_words(words, most), "word", "left")
    is_form = F.col("near_n") >= FACTOR * F.col("n")
    own = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    linked = roots(own.where("form is not null").select("word", "form"))
    return own.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The crc32 is computed in SQL from its table, which follows from the polynomial.
ORACLE_SQL = """
with recursive crc_table as (select list(c order by i) as t from (select i,
    list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
counted as (select id, run, count(*) as k, hex(encode(id || ':' || run)) as h from runs where length(run) >= 6 group by id, run),
hashed as (select run, k, xor(4294967295, list_reduce(list_concat([4294967295],
    [('0x' || substr(h, 2 * i - 1, 2))::bigint for i in range(1, length(h) // 2 + 1)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from counted, crc_table),
words as (select case when h % 199 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, sum(k)::bigint as n
    from hashed group by 1 having n >= 5 and length(word) >= 6),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
cuts as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as cut from places),
near as (select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.i = b.i and a.cut = b.cut and a.word != b.word
    union select a.word, b.word, b.n from cuts a join words b on a.cut = b.word
    union select b.word, a.word, a.n from cuts a join words b on a.cut = b.word),
best as (select word, count(*) as n_near, max(near_n) as near_n from near group by word),
formed as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 5 * w.n then b.near_n end as form_n,
    case when b.near_n >= 5 * w.n then (select min(x.near) from near x where x.word = w.word and x.near_n = b.near_n) end as form
    from words w left join best b using (word)),
chain as (select word, word as root, form as further from formed
    union all select c.word, f.word, f.form from chain c join formed f on f.word = c.further)
select f.word, f.form, c.root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
from formed f join chain c on c.word = f.word and c.further is null
"""
