"""Operator 1: mix sources to target weights by systematic sampling, with DataFrame functions only.

A source's documents are laid out by size; each adds its expected number of copies (target size / source size) to a
running sum that starts at one random offset for the source, and is emitted once for each integer that the sum passes.
Laying out by size makes the sample a stratified one, so the words taken stay within about one document of the target.

The running sum has two levels: documents are ranked inside cells of about sqrt(rows) documents (source, size class,
hash split), and a short table of cells carries the sums before each cell. No window sees more than a cell, so a source
that holds a third of all rows is spread over all tasks.

Defined results: null text has size 0; a null source is a source of its own, last in order; an empty table gives no
rows; repeated rows are documents of their own; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, join_sized, materialize

#: No source is repeated more often than this.
MOST_COPIES = 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _bits20(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """s_null, s, source_size -> weight and target: shares by weight, cut at MOST_COPIES times the size, the rest reshared.

    One row per source. Ordered by size per weight, the sources that are cut come first; the level of the others is what
    the cut ones leave over, per weight.
    """
    ordered = Window.orderBy("s_null", "s")
    by_level = Window.orderBy("ratio", "s_null", "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = (
        sizes.withColumn("weight", (F.row_number().over(ordered) - 1) % 3 + 1)
        .withColumn("cut", F.col("source_size") * MOST_COPIES)
        .withColumn("ratio", F.col("cut") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cut").over(by_level), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cut"))
    )
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("ratio"))).over(every)
    return w.withColumn("target", F.least(F.col("cut").cast("double"), F.col("weight") * level)).select("s_null", "s", "source_size", "target")


def mix_to_weights(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and the carried columns in a struct `carried`."""
    digits = F.col("size").cast("string")
    cell = [
        F.col(source_col).isNull().alias("s_null"),
        F.coalesce(F.col(source_col), F.lit("")).alias("s"),
        F.col(id_col).alias("doc_id"),
        word_count(F.col(text_col)).alias("size"),
    ]
    klass = (F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int")).alias("klass")
    narrow = materialize(docs.select(*cell)).select("*", klass)
    n = narrow.count()
    per_cell = max(64, math.isqrt(n))
    classes = materialize(narrow.groupBy("s_null", "s", "klass").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    splits = classes.select("s_null", "s", "klass", F.ceil(F.col("n") / per_cell).cast("long").alias("n_splits"))
    split = F.pmod(_bits20(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.col("n_splits")).alias("split")
    targets = source_targets(classes.groupBy("s_null", "s").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("s_null", "s").orderBy("klass", "split").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_sized(narrow, splits, ["s_null", "s", "klass"]).select("*", split)
    cells = placed.groupBy("s_null", "s", "klass", "split").agg(F.count("*").alias("n"))
    cells = cells.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before")).drop("n")
    offset = _bits20(F.concat(F.lit(f"{seed}:"), F.when(F.col("s_null"), "null").otherwise(F.concat(F.lit("="), F.col("s"))))) / F.lit(float(1 << 20))
    cells = materialize(cells.join(targets, ["s_null", "s"]).withColumn("offset", offset))
    if carry is not None:
        full = docs.select(*cell, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")).select("*", klass)
        placed = join_sized(full, splits, ["s_null", "s", "klass"]).select("*", split)
    within = Window.partitionBy("s_null", "s", "klass", "split").orderBy("size", "doc_id")
    ranked = join_sized(placed.withColumn("rank_in", F.row_number().over(within)), cells, ["s_null", "s", "klass", "split"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("rank_before") + F.col("rank_in")
    copies = (F.floor(rank * expected + F.col("offset")) - F.floor((rank - 1) * expected + F.col("offset"))).cast("long")
    keep = ["carried"] if carry is not None else []
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *keep).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a repeated one as often as it is taken; columns as given."""
    out = mix_to_weights(docs, carry=docs.columns)
    return out.where("copies > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")


_TARGET_SQL = r"""
  narrow as (select source is null as s_null, coalesce(source, '') as s, doc_id,
      coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, {carry} from {docs}),
  classed as (select *, length(size::varchar) * 10 + left(size::varchar, 1)::int as klass from narrow),
  classes as (select s_null, s, klass, count(*) as n, sum(size)::bigint as words from classed group by all),
  sizes as (select s_null, s, sum(words)::bigint as source_size from classes group by all),
  weighed as (select *, (row_number() over (order by s_null, s) - 1) % 3 + 1 as weight, source_size * 3 as cut from sizes),
  levels as (select *, cut / weight as ratio,
      (sum(source_size) over () - coalesce(sum(cut) over w, 0))::double / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as level
      from weighed window w as (order by cut / weight, s_null, s rows between unbounded preceding and 1 preceding)),
  lowest as (select min_by(level, ratio) as level from levels where level * weight <= cut),
  targets as (select s_null, s, source_size, least(cut::double, weight * lowest.level) as target from levels, lowest),
  split as (select d.*, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 5))::bigint
      % ceil(n::double / greatest(64, floor(sqrt((select count(*) from narrow))))::double)::bigint as split
      from classed d join classes using (s_null, s, klass)),
  ranked as (select *, row_number() over (partition by s_null, s order by klass, split, size, doc_id) as rank,
      ('0x' || substr(md5('17:' || case when s_null then 'null' else '=' || s end), 1, 5))::bigint / 1048576.0::double as u
      from split join targets using (s_null, s)),
  rated as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from ranked),
  mixed as (select *, (floor(rank * rate + u) - floor((rank - 1) * rate + u))::bigint as copies from rated)
"""

ORACLE_SQL = "with" + _TARGET_SQL.format(docs="documents", carry="0 as carried") + "select doc_id, size, source_size, target, copies, copies * size as taken from mixed"
