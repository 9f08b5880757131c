"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Characters of a longer text that are learnt from, in one slice, so that a sample's size in bytes is bounded too.
SLICE = 1 << 16
#: Rows of a sample, however many label values there are; each value has an equal share, of LEAST_ROWS at least.
MOST_ROWS, LEAST_ROWS = 6000, 20


def hash_bound(n: int, per_class: int) -> int:
    """The value of a 63-bit hash under which about per_class of n rows lie."""
    return min((1 << 63) - 1, (per_class << 63) // max(n, 1))


def slice_of(text: Column, key: Column, size: int = SLICE) -> Column:
    """text, or of a longer one `size` characters from a place that follows from key."""
    room = F.length(text) - size
    return F.when(room > 0, F.substring(text, F.pmod(F.xxhash64(key), room + 1).cast("int") + 1, F.lit(size))).otherwise(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, size: int = SLICE) -> pa.Table:
    """doc_id, text and y of about per_class training documents for each label value, chosen by a hash of the id.

    labels: doc_id and label_col; ids whose crc32 mod 5 is 0 are held out, null labels and ids are skipped, and an id
    labelled more than once has its largest label. A first pass counts the classes in the narrow labels; the thresholds
    that follow bound the ids (and so what is broadcast and collected) to about per_class for each class at every size.
    A class of fewer rows is taken whole. Of a text of more than `size` characters one slice is learnt from, at a place
    that follows from its id, so a class of nothing but long texts is learnt like any other. A class that has training
    documents but none in the sample is an error, not a class that is never predicted.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max(label_col).alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = min(per_class, max(LEAST_ROWS, MOST_ROWS // max(len(counts), 1)))
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    chosen = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        chosen = chosen | ((F.col("y") == F.lit(value)) & (share <= F.lit(hash_bound(n, rows))))
    ids = materialize(own.where(chosen))
    text = F.coalesce(slice_of(F.col("text"), F.col("doc_id"), size), F.lit("")).alias("text")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", text, "y")
    out = found.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    for value in counts.keys() - set(out.column("y").to_pylist()):
        if own.where(F.col("y") == F.lit(value)).join(docs.select("doc_id"), "doc_id", "left_semi").limit(1).count():
            raise ValueError(f"no document of class {value!r} of {label_col} is in the sample")
    return out
