"""Operator 6: near duplicates by MinHash bands, odd sketches and exact verification.

1. Each text becomes a set of distinct shingle hashes; from it come a set key (count and two sums, equal for equal sets),
   BANDS band keys of ROWS MinHash values each, and an odd sketch: every MinHash sample flips one bit of BITS.
2. Documents with equal sets form one class; only one row of each class goes on.
3. Classes that share a band key are candidates. Buckets of up to SMALL classes give all their pairs (a few per class);
   in larger ones each class first meets the one of highest degree, to which changed copies of one text are nearest.
4. The XOR of two odd sketches has about n/2 * (1 - exp(-2m/n)) bits when m samples differ; pairs whose estimate is far
   under the threshold (margin below) are dropped, all others are confirmed on the full sets before they count as links.
   First each class's likeliest pair is confirmed, then every other pair that would join two components.
5. Components follow from minimum labels with pointer jumping; each round is a table in the shared folder.
6. A large bucket whose members are then in several components is gone through in full: each member outside the main
   component is held against all members of other components, by odd sketch and then by full set. Blocks of at most
   about BLOCK members and ITEMS shingles meet in pairs, one task each; of what is found there, only links that join two
   components leave the task. So no candidate is left out, and no list of a group's pairs is made.

At Jaccard 0.85 a pair misses all bands with probability (1 - 0.85**7)**28, about 2e-5.

Defined results: texts without words (null, empty, blank) have an empty set and link with nothing; fewer words than a
shingle make one shingle of all of them; rows with a null id belong to their class but never name it; equal rows share
a component. near_classes has `kept` for each id, as its SQL does; first_documents keeps exactly one row of each component,
whatever the rows' ids: by a key of each row that is written once with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, materialize, mix64, steps, text_buffer, tidy, word_hashes, word_spans

SHINGLE = 3
BANDS, ROWS = 28, 7
BITS = 512
SMALL = 8
#: Members and shingles of a large bucket that one task holds of each of two blocks.
BLOCK, ITEMS = 512, 2_000_000
PERCENT = 85
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def margin(percent: int, samples: int) -> float:
    """How far below the threshold an odd sketch's estimate may lie: five standard errors of it at the threshold.

    m of the samples differ, a binomial count; 2m bits are flipped, so the number of odd ones scatters too.
    """
    m = samples * (1 - percent / 100)
    flips = BITS / 16 * np.expm1(8 * m / BITS) - m / 2
    return 5 * float(np.sqrt(m * percent / 100 + flips)) / samples


FAR = margin(PERCENT, BANDS * ROWS)

#: Texts' bytes and offsets -> shingle hashes and the place of each text's first (n + 1 values); repeats allowed.
Shingler = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_shingles(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `width` words, A-Z in lower case, whatever stands between the words."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, off)
    word = word_hashes(data, starts, ends)
    words = np.diff(first)
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    i = first[row] + np.arange(at[-1]) - at[row]
    out = np.zeros(len(i), np.uint64)
    for j in range(width):
        there = i + j < first[row + 1]
        out = np.where(there, mix64(out + word[np.minimum(i + j, max(len(word) - 1, 0))] + np.uint64(j + 1)), out) if len(word) else out
    return out, at


def distinct_sets(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted, and their places."""
    rows = [np.unique(x[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(rows) if rows else x[:0]), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix64(i) | np.uint64(1), mix64(i + np.uint64(1 << 20))


def sketch(x: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x bands) and odd sketches (n x BITS / 64) of non-empty sets."""
    k, n = bands * rows, len(at) - 1
    a, b = _permutations(k)
    keys = np.zeros((n, bands), np.uint64)
    odd = np.zeros((n, BITS // 64), np.uint64)
    every = np.arange(n)
    for j in range(k):
        low = np.minimum.reduceat(((x * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), at[:-1]).astype(np.uint64)
        sample = mix64(low + np.uint64(j << 33))
        keys[:, j // rows] = mix64(keys[:, j // rows] + sample)
        bit = sample % np.uint64(BITS)
        odd[every, (bit >> np.uint64(6)).astype(int)] ^= np.uint64(1) << (bit & np.uint64(63))
    return keys, odd


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.astype(np.int64).ravel()))


def with_keys(docs: DataFrame, *more: Column) -> DataFrame:
    """key (a number of each row's own), doc_id and text, written once, so that the key stays with its row."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more))


def sketches(keyed: DataFrame, shingler: Shingler, bands: int, rows: int) -> DataFrame:
    """key, doc_id, n_shingles, node and check (a set's key), bands and odd; the last four are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x, at = distinct_sets(*shingler(*text_buffer(batch.column(1))))
            n = np.diff(at)
            full = np.flatnonzero(n)
            none = pa.array(n == 0)
            key = np.zeros((2, len(n)), np.uint64)
            keys, odd = np.zeros((len(n), bands), np.uint64), np.zeros((len(n), BITS // 64), np.uint64)
            if len(full):
                places = np.concatenate((at[full], at[-1:]))
                for i in range(2):
                    key[i, full] = mix64(np.add.reduceat(mix64(x + np.uint64(i)), places[:-1]) + n[full].astype(np.uint64))
                keys[full], odd[full] = sketch(x, places, bands, rows)
            null_if_none = lambda c: pa.compute.if_else(none, pa.scalar(None, c.type), c)
            cols = [pa.array(key[0].astype(np.int64)), pa.array(key[1].astype(np.int64)), _lists(keys), _lists(odd)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *map(null_if_none, cols)], names=["key", "doc_id", "n_shingles", "node", "check", "bands", "odd"])

    return keyed.select("key", "text", "doc_id").mapInArrow(tidy(run), "key long, doc_id long, n_shingles long, node long, check long, bands array<long>, odd array<long>")


def full_sets(keyed: DataFrame, shingler: Shingler) -> DataFrame:
    """key, node and shingles (the whole distinct set) of the rows' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x, at = distinct_sets(*shingler(*text_buffer(batch.column(1))))
            n = np.diff(at)
            full = np.flatnonzero(n)
            places = np.concatenate((at[full], at[-1:]))
            node = mix64(np.add.reduceat(mix64(x), places[:-1]) + n[full].astype(np.uint64)) if len(full) else x[:0]
            sets = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array(node.astype(np.int64)), sets], names=["key", "node", "shingles"])

    return keyed.select("key", "text").mapInArrow(tidy(run), "key long, node long, shingles array<long>")


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First pairs a < b of nodes that share a band key, distinct, and the members of large buckets (key, node, n_shingles).

    nodes: node, n_shingles and bands, one row each. A node's degree is the size of all its large buckets together: in a
    group of copies that were each changed a little, the least changed one has the largest.
    """
    member = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    buckets = materialize(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialize(member.join(buckets, "key"))
    small = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("all"))
    paired = small.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    large = shared.where(F.col("n") > SMALL)
    degree = materialize(large.groupBy("node").agg(F.sum("n").alias("degree")))
    large = materialize(large.join(degree, "node"))
    centre = materialize(large.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("other")))
    first = large.join(centre, "key").where("node != other").select(*_ordered("node", "other"))
    return paired.unionByName(first).distinct(), large.select("key", "node", "n_shingles")


def divided_buckets(large: DataFrame, root: DataFrame) -> DataFrame:
    """Members of the large buckets that are in several components: key, node, root, rest (not in the main one), blocks."""
    known = large.join(root, "node", "left").select("key", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    parts = known.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("items"))
    main = parts.groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count("*").alias("parts"), F.sum("m").alias("n"), F.sum("items").alias("items"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("items") / ITEMS)).cast("int").alias("blocks")
    main = materialize(main.where("parts > 1").select("key", "main", blocks))
    return materialize(known.join(main, "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("rest"), "blocks"))


def _cells() -> Column:
    """Pairs of blocks (i, j) that a member goes to: in the row of its block for comparing, if it is one of the rest, in the column to be compared with."""
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != b)
    cell = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))
    yes, no = F.lit(True), F.lit(False)
    asking = F.when(F.col("rest"), F.transform(others, lambda j: cell(b, j, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,asks:boolean,answers:boolean>>"))
    return F.concat(F.array(cell(b, b, F.col("rest"), yes)), asking, F.transform(others, lambda i: cell(i, b, no, yes)))


def _matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)


def _links_of_cell(percent: int, samples: int):
    """Links a, b that join two components, between the asking and the answering members of one cell."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        key, node, root = (table.column(c).to_numpy() for c in ("key", "node", "root"))
        asks, answers = (table.column(c).to_numpy() for c in ("asks", "answers"))
        odd, bands = _matrix(table.column("odd"), n), _matrix(table.column("bands"), n)
        sets = table.column("shingles").combine_chunks()
        size = pa.compute.list_value_length(sets).to_numpy().astype(np.int64)
        at = np.cumsum(size) - size
        values, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        band = int(np.flatnonzero(bands[0].view(np.int64) == key[0])[0])
        mark = np.zeros(len(values), bool)
        over = {int(r): int(r) for r in np.unique(root)}
        a, b = [], []

        def top(r: int) -> int:
            while over[r] != r:
                over[r] = r = over[over[r]]
            return r

        for i in np.flatnonzero(asks).tolist():
            # A pair that shares an earlier band has been compared there; of two that ask, the greater one compares.
            fit = answers & (root != root[i]) & ~(asks & (node > node[i])) if answers[i] else answers & (root != root[i])
            fit &= (size * 100 >= size[i] * percent) & (size[i] * 100 >= size * percent)
            fit &= ~(bands[:, :band] == bands[i, :band]).any(axis=1)
            c = np.flatnonzero(fit)
            share = np.minimum(np.bitwise_count(odd[c] ^ odd[i]).sum(axis=1) * (2.0 / BITS), 0.999)
            c = c[1.0 + np.log(1.0 - share) * (BITS / 2.0) / (2.0 * samples) >= percent / 100 - margin(percent, samples)]
            mine = top(int(root[i]))
            c = c[[top(r) != mine for r in root[c].tolist()]] if len(c) else c
            if len(c):
                own = code[at[i] : at[i] + size[i]]
                mark[own] = True
                ends = np.cumsum(size[c])
                items = np.repeat(at[c] - ends + size[c], size[c]) + np.arange(ends[-1])  # the candidates' items only
                both = np.add.reduceat(mark[code[items]], ends - size[c], dtype=np.int64)
                mark[own] = False
                for j in c[both * 100 >= (size[i] + size[c] - both) * percent].tolist():
                    x, y = top(int(root[i])), top(int(root[j]))
                    if x != y:
                        over[max(x, y)] = min(x, y)
                        a.append(min(node[i], node[j]))
                        b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _estimate(odd_a: Column, odd_b: Column, samples: int) -> Column:
    """Jaccard similarity from two odd sketches of so many samples."""
    bits = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    share = F.least(bits * (2.0 / BITS), F.lit(0.999))
    return 1.0 - F.log(1.0 - share) * (-BITS / 2.0) / (2.0 * samples)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets meet 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) of every node with a link."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    state = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(state.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("seen"))
        lower = state.join(near, "node").select("node", "root", F.least("root", "seen").alias("low"))
        jump = state.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = materialize(lower.join(jump, "low").select("node", F.least("low", "far").alias("root"), F.col("root").alias("was")))
        moved = new.where("root != was").limit(1).count()
        state = new.select("node", "root")
        if not moved:
            return state


def standing(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """key of one row for each of the nodes, so that sets made of these rows' texts need no shuffle to be one a node."""
    first = classes.select("node", F.col("first.key").alias("key"))
    return nodes.distinct().join(first, "node").groupBy("node").agg(F.min("key").alias("key")).select("key")


def near_rows(keyed: DataFrame, shingler: Shingler, percent: int, bands: int, rows: int) -> DataFrame:
    """key, doc_id, n_shingles, component_id and first_key (of the row that stands for the component) of every row of with_keys."""
    own = materialize(sketches(keyed, shingler, bands, rows))
    full = own.where("node is not null")
    classes = materialize(full.groupBy("node", "check").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("n"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"), F.min("odd").alias("odd")))
    pairs, large = candidate_pairs(classes.select("node", "n_shingles", "bands"))
    odd = lambda side: classes.select(F.col("node").alias(side), F.col("odd").alias(f"odd_{side}"))

    def likely_of(pairs: DataFrame) -> DataFrame:
        both = pairs.join(odd("a"), "a").join(odd("b"), "b").select("a", "b", _estimate(F.col("odd_a"), F.col("odd_b"), bands * rows).alias("estimate"))
        return materialize(both.where(F.col("estimate") >= percent / 100 - margin(percent, bands * rows)))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return materialize(full_sets(keyed.join(materialize(standing(nodes, classes)), "key", "left_semi"), shingler))

    def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
        """The pairs that join two components."""
        side = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(root_a, a) != coalesce(root_b, b)").select(*pairs.columns)

    # Each class's likeliest pair first, then all that still matter.
    likely = likely_of(pairs)
    sets = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")))
    best = materialize(likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b"))
    links = materialize(confirm(best, sets, percent))
    rest = apart(likely.select("a", "b"), components(links)).join(best, ["a", "b"], "left_anti")
    links = materialize(links.union(confirm(rest, sets, percent)))
    root = components(links)
    divided = divided_buckets(large, root)
    if divided.limit(1).count():
        info = classes.select("node", "odd", "bands").join(sets_of(divided.select("node")).select("node", "shingles"), "node")
        cells = divided.select("key", "node", "root", F.explode(_cells()).alias("cell")).select("key", "node", "root", "cell.*").join(info, "node")
        across = materialize(cells.groupBy("key", "i", "j").applyInArrow(_links_of_cell(percent, bands * rows), "a long, b long"))
        if across.limit(1).count():
            root = components(links.union(across))
    named = classes.join(root, "node", "left").select("node", "check", "first", "n", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("low"), F.sum("n").alias("size")).where("size > 1")
    grouped = materialize(named.join(least, "root").select("node", "check", F.col("low.doc_id").alias("component_id"), F.col("low.key").alias("first_key")))
    out = own.select("key", "doc_id", "n_shingles", "node", "check").join(grouped, ["node", "check"], "left")
    return out.select("key", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first_key", "key").alias("first_key"))


def near_classes(docs: DataFrame, shingler: Shingler = word_shingles, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    out = near_rows(with_keys(docs), shingler, percent, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_documents(docs: DataFrame, shingler: Shingler = word_shingles, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each near-duplicate group; columns as given."""
    keyed = with_keys(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried"))
    dropped = materialize(near_rows(keyed, shingler, percent, bands, rows).where("key != first_key").select("key"))
    kept = join_sized(keyed, dropped, ["key"], "left_anti")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = """
with recursive docs as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, regexp_extract_all(coalesce(t, ''), '[^\\x20\\x09-\\x0D]+') as w from docs),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from words),
classes as (select list_sort(s) as s, min(doc_id) as node from sets where len(s) > 0 group by 1),
items as (select node, len(s) as n, unnest(s) as g from classes),
common as (select a.node as a, b.node as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared
  from items a join items b on a.g = b.g and a.node < b.node and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 group by 1, 2),
links as (select a, b from common where 100 * shared >= 85 * (na + nb - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select node, node as goal from classes union select r.node, l.b from reach r join both_ways l on r.goal = l.a),
least_node as (select node, min(goal) as component_id from reach group by node)
select sets.doc_id, len(sets.s)::bigint as n_shingles, coalesce(l.component_id, sets.doc_id) as component_id,
  coalesce(l.component_id, sets.doc_id) = sets.doc_id as kept
from sets left join classes c on list_sort(sets.s) = c.s left join least_node l on l.node = c.node
"""
