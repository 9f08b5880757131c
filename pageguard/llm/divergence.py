"""Operator 13: how far the sources of a language diverge, term by term and pair by pair, exactly.

1. term_counts: occurrences of each term in each (lang, source) group, and the number of documents with it. A task adds up
   what it reads in a dictionary of at most HELD entries and passes sums on.
2. postings: one row for each term that its language keeps (LEAST_DOCUMENTS documents or more), with its count in each
   source that has it. A row is as long as the language has sources, never as long as the corpus.
3. Probabilities are integers: p = 1 + floor(SCALE * (count + 1) / (N + V)); f(p, q) = floor((p - q)^2 / q).
4. pair_values sums f over all kept terms for each ordered pair of a language's sources, by a heavy-light split. A term
   that HEAVY of the sources have is heavy: these terms stand in dense numpy tiles, terms x sources, and every pair is
   computed. Of a light term most pairs have none in either source; these have one value, f of the two least
   probabilities, taken once for all light terms. What differs is corrected: for sources that have the term against all
   others, by how often each count occurs, and for pairs that both have it, from its posting list. All are integers,
   and so the sums of both parts are exact.
   Pairs are cut into blocks of sources, so that what a task holds stays under CELLS sums, whatever the number of sources.
5. Term rows are the first RANKS of each group by a window whose limit Spark takes before it shuffles.

Sums stay under 2**63: probabilities of a group add up to little over SCALE, and (p - q)^2 / q to little over SCALE^2.

Defined results: null text, lang and source count as ''; a group whose documents have no terms is a group; a language
without kept terms has the value 0 for all its pairs, and one with a single source has no pairs; repeated rows count again; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_sized, materialize, tidy

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
RANKS = 200
#: Share of a language's sources from which on a term is heavy.
HEAVY = 0.25
#: Terms of a dense tile, and light posting pairs that are looked at in one go.
TILE, GO = 256, 1_000_000
#: Sums of pairs that a task holds for one language.
CELLS = 4_000_000
HELD = 300_000

# Bytes of terms: letters, A-Z in lower case, and all bytes of characters past ASCII; all others are spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs of all terms, whatever their number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = lambda v, k=len(n): pa.array([v] * k, pa.string())
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "count", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (lang, source) not in counts:
                    counts[lang, source] = (Counter(), Counter())
                n, d = counts[lang, source]
                before = len(n)
                terms = text.encode().translate(_TERMS).split()
                n.update(terms)
                d.update(set(terms))
                held += len(n) - before
                if held > HELD:
                    yield from sums()
                    counts, held = {}, 0
        yield from sums()

    made = named(docs).mapInArrow(tidy(run), "lang string, source string, term string, count long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def postings(counts: DataFrame) -> DataFrame:
    """lang, term, total and each (a list of source and count) of the terms that a language keeps."""
    all_of = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("each"))
    return all_of.where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "total", "each")


def probability(count: str, size: str) -> Column:
    """1 + floor(SCALE * (count + 1) / size) of two columns, in whole numbers."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({size} as decimal(20,0))")


def probabilities(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same in numpy: three digits of SCALE at a time, so that no product leaves 63 bits."""
    whole, rest = np.divmod(count + 1, size)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digits
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Pairs:
    """Sums of f over the terms of one language, for pairs of the sources `block` with all sources."""

    def __init__(self, sizes: np.ndarray, block: np.ndarray):
        self.sizes, self.block = sizes, block
        self.row = np.full(len(sizes), -1)
        self.row[block] = np.arange(len(block))
        self.none = probabilities(np.zeros(len(sizes), np.int64), sizes)
        self.neither = distance(self.none[block][:, None], self.none)
        self.sums = np.zeros((len(block), len(sizes)), np.int64)

    def heavy(self, term: np.ndarray, source: np.ndarray, count: np.ndarray, terms: int) -> None:
        """Dense tiles: every pair of sources, for every term."""
        for at in range(0, terms, TILE):
            here = slice(*np.searchsorted(term, [at, at + TILE]))
            tile = np.zeros((min(TILE, terms - at), len(self.sizes)), np.int64)
            tile[term[here] - at, source[here]] = count[here]
            p = probabilities(tile, self.sizes)
            for i, s in enumerate(self.block):
                self.sums[i] += distance(p[:, s : s + 1], p).sum(axis=0)

    def light(self, term: np.ndarray, source: np.ndarray, count: np.ndarray, terms: int) -> None:
        """All pairs as if no source had the terms, corrected for those that do."""
        self.sums += terms * self.neither
        p = probabilities(count, self.sizes[source])
        kinds, times = np.unique(np.stack((source, p)), axis=1, return_counts=True)
        for s in np.unique(kinds[0]):
            own = kinds[0] == s
            value, n = kinds[1][own][:, None], times[own][:, None]
            if self.row[s] >= 0:
                self.sums[self.row[s]] += (n * (distance(value, self.none) - self.neither[self.row[s]])).sum(axis=0)
            self.sums[:, s] += (n * (distance(self.none[self.block], value) - self.neither[:, s])).sum(axis=0)
        size = np.bincount(term, minlength=terms)
        first = np.cumsum(size) - size
        last = 0
        while last < terms:
            # Terms whose posting pairs are GO at most, or one term.
            pairs = np.cumsum(size[last:] ** 2)
            stop = last + max(1, int(np.searchsorted(pairs, GO, "right")))
            k = size[last:stop]
            x = np.repeat(np.arange(first[last], first[last] + k.sum()), np.repeat(k, k))
            y = np.arange(len(x)) - np.repeat(np.cumsum(k * k) - k * k, k * k)
            y = first[last:stop][np.repeat(np.arange(len(k)), k * k)] + y % np.repeat(k, k * k)
            own = (x != y) & (self.row[source[x]] >= 0)
            x, y = x[own], y[own]
            s, t = source[x], source[y]
            both = distance(p[x], p[y]) - distance(p[x], self.none[t]) - distance(self.none[s], p[y]) + self.neither[self.row[s], t]
            np.add.at(self.sums, (self.row[s], t), both)
            last = stop


def pair_sums(kept: DataFrame, groups: list[tuple[str, str, int]]) -> DataFrame:
    """lang, source, item and value: each task's sums of f over its terms of `kept` (postings), for pairs of sources.

    groups: lang, source and N + V of every group. It is at hand in every task; its square is the result's size.
    """
    sizes: dict[str, dict[str, int]] = {}
    for lang, source, size in sorted(groups):
        sizes.setdefault(lang, {})[source] = size
    blocks = {lang: -(-len(own) ** 2 // CELLS) for lang, own in sizes.items()}
    many = [x for lang, n in blocks.items() if n > 1 for x in (F.lit(lang), F.lit(n))]
    n_blocks = F.coalesce(F.create_map(*many)[F.col("lang")], F.lit(1)) if many else F.lit(1)
    rows = kept.select("lang", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), "each").sortWithinPartitions("lang", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, names = None, None, []

        def sums() -> pa.RecordBatch:
            lang = now[0]
            one = np.repeat(pairs.block, len(names))
            other = np.tile(np.arange(len(names)), len(pairs.block))
            apart = one != other
            name = pa.array(names, pa.string())
            cols = [pa.array([lang] * int(apart.sum()), pa.string()), name.take(pa.array(one[apart])), name.take(pa.array(other[apart])), pa.array(pairs.sums.ravel()[apart])]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "item", "value"])

        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            starts = [i for i in range(len(key)) if not i or key[i] != key[i - 1]]
            for begin, end in zip(starts, [*starts[1:], len(key)]):
                if key[begin] != now:
                    if pairs is not None:
                        yield sums()
                    now = key[begin]
                    names = list(sizes[now[0]])
                    every = np.arange(len(names))
                    pairs = _Pairs(np.array(list(sizes[now[0]].values()), np.int64), every[now[1] :: blocks[now[0]]])
                each = batch.column(2).slice(begin, end - begin)
                k = pa.compute.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = each.flatten()
                coded = flat.field("source").dictionary_encode()
                at = {n: i for i, n in enumerate(names)}
                source = np.array([at[n] for n in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                count = flat.field("count").to_numpy()
                heavy = k >= max(2, HEAVY * len(names))
                term = np.repeat(np.arange(len(k)), k)
                for kind, add in ((heavy, pairs.heavy), (~heavy, pairs.light)):
                    if kind.any():
                        own = kind[term]
                        add((np.cumsum(kind) - 1)[term[own]], source[own], count[own], int(kind.sum()))
        if pairs is not None:
            yield sums()

    return rows.mapInArrow(tidy(run), "lang string, source string, item string, value long")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: parts `pair` and `term` of every group."""
    kept = materialize(postings(term_counts(docs)))
    each = kept.select("lang", "term", "total", F.inline("each"))
    of_group = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
    found = named(docs).select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    no = F.lit(0)
    groups = materialize(found.select("lang", "source", (F.coalesce("n", no) + F.coalesce("terms", no)).alias("size"), (F.coalesce("lang_n", no) + F.coalesce("terms", no)).alias("lang_size")))
    sizes = [(r["lang"], r["source"], r["size"]) for r in groups.where("size > 0").select("lang", "source", "size").collect()]
    sums = pair_sums(kept, sizes).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source != item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", no).cast("long").alias("value"))

    terms = join_sized(each, groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), probability("count", "size").alias("p"), probability("total", "lang_size").alias("q"))
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(first))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= RANKS))


ORACLE_SQL = """
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
found as (select lang, source, row, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
counts as (select lang, source, term, count(*)::hugeint as n, count(distinct row) as docs from found group by all),
kept as (select lang, term, sum(n)::hugeint as total from counts group by all having sum(docs) >= 3),
grouped as (select distinct lang, source from d),
of_lang as (select lang, sum(total)::hugeint as lang_n, count(*)::hugeint as v from kept group by lang),
of_group as (select g.lang, g.source, coalesce(sum(c.n) filter (k.term is not null), 0)::hugeint as n from grouped g
    left join counts c using (lang, source) left join kept k on k.lang = c.lang and k.term = c.term group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.n + l.v) as p,
    1 + 1000000000::hugeint * (k.total + 1) // (l.lang_n + l.v) as q
    from of_group g join of_lang l using (lang) join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::hugeint as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
rows as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
    from grouped a join grouped b on a.lang = b.lang and a.source != b.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
    union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from rows
qualify part = 'pair' or rank <= 200
"""
