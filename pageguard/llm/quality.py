"""Operator 2: document quality from a linear-chain CRF that labels every line good or bad.

Each line has shape features (shares of character kinds, repeats, lengths), cut at quantiles; the line before and the
line after add theirs. Documents' labels are given to all their lines for training. Forward-backward gives each line's
probability of being good; their mean, weighted by the lines' bytes, is the document's score.

The CRF is fitted on about SAMPLE training documents for each label value; scoring covers every line of every text.
Defined results: a text that is null, empty or has blank lines only has score 0.0; without labelled training documents
all scores are 0.5; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, held_out, steps, text_buffer, tidy, word_spans
from .crf import Adam, Chain, gradients, marginals
from .samples import labelled_sample

SAMPLE = 1500
THRESHOLD = 0.3
BINS = 8
ROUNDS = 120
BAD, GOOD = 0, 1

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:'\"?()-",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>{}[]\\/_=+`",
    "space": b" \t\r\x0b\x0c",
}


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a byte in them (lines x features), their bytes, and each row's first line (n + 1)."""
    cut = data == 10
    first = np.zeros(len(data), bool)
    if len(data):
        first[1:] = cut[:-1]
        first[off[:-1][off[:-1] < len(data)]] = True
    first &= ~cut
    starts = np.flatnonzero(first)
    stop = np.zeros(len(data), bool)
    if len(data):
        stop[:-1] = cut[1:]
        inner = off[1:][off[1:] > 0] - 1
        stop[inner] = True
    stop &= ~cut
    ends = np.flatnonzero(stop) + 1
    size = (ends - starts).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return (total[ends] - total[starts]) / np.maximum(size, 1)

    cols = []
    for chars in _KINDS.values():
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        cols.append(share(lut[data]))
    w_start, w_end, _ = word_spans(data, off)
    w_first, w_last = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    words = np.maximum(w_last - w_first, 0)
    spans = SpanHash(data)
    h = spans(w_start, w_end)
    same = np.zeros(len(h) + 1, np.int32)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    again = np.where(words > 1, same[np.maximum(w_last, 1)] - same[np.minimum(w_first + 1, len(h))], 0)
    cols.append(again / np.maximum(words - 1, 1))
    cols.append(size / np.maximum(words, 1))
    cols.append(np.log1p(words))
    row = np.searchsorted(off, starts, "right") - 1
    key = spans(starts, ends) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    cols.append((count[back] > 1).astype(float) if len(key) else np.zeros(0))
    cols.append(np.isin(data[np.maximum(ends - 1, 0)], list(b".!?")).astype(float) if len(ends) else np.zeros(0))
    at = np.searchsorted(starts, off)
    keep = words > 0
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    return np.stack(cols, axis=1)[keep], size[keep], at


class Model:
    """Bin edges, one table of scores for own, previous and next line, and the chain."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.table = np.zeros((3, len(edges), BINS + 1))
        self.chain = Chain(np.zeros(2), np.zeros((2, 2)))

    def bins(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """lines x 3 x features; a missing neighbour has the bin BINS."""
        own = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)
        out = np.full((len(x), 3, len(self.edges)), BINS, np.int64)
        out[:, 0] = own
        row = np.searchsorted(at, np.arange(len(x)), "right")
        same = row[1:] == row[:-1]
        out[1:, 1][same] = own[:-1][same]
        out[:-1, 2][same] = own[1:][same]
        return out

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        em = np.zeros((len(bins), 2))
        for side in range(3):
            for f in range(len(self.edges)):
                em[:, GOOD] += self.table[side, f, bins[:, side, f]]
        return em

    def scores(self, texts: pa.Array) -> np.ndarray:
        x, size, at = line_features(*text_buffer(texts))
        good = marginals(self.emissions(self.bins(x, at)), at, self.chain)[:, GOOD]
        total = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[at])
        weight = total(size)
        return np.clip(np.where(weight > 0, total(good * size) / np.maximum(weight, 1), 0.0), 0.0, 1.0)


def fit(sample: pa.Table, rounds: int = ROUNDS) -> Model | None:
    if not sample.num_rows:
        return None
    texts = pa.array(sample.column("text").to_pylist(), pa.string())
    y = np.array(sample.column("y").to_pylist(), int).clip(0, 1)
    x, _, at = line_features(*text_buffer(texts))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]))[: BINS - 1] if len(c) else np.zeros(0) for c in x.T]
    # A rare kind has all its quantiles at 0: set one edge between none and some of it, and one at a tenth.
    edges = [e if len(e) > 2 else np.unique(np.concatenate((e, [1e-9, 0.1])))[: BINS - 1] for e in edges]
    model = Model(edges)
    bins = model.bins(x, at)
    gold = np.repeat(y, np.diff(at))
    share = np.bincount(gold, minlength=2) / max(len(gold), 1)
    if not len(gold) or not share.all():
        model.chain.start[y[0] if len(y) else GOOD] = 8.0
        return model
    steps_ = Adam([model.table, model.chain.start, model.chain.trans], 0.1, 1e-3)
    for _ in range(rounds):
        d_em, d_start, d_trans = gradients(model.emissions(bins), at, model.chain, gold)
        d_table = np.stack([[np.bincount(bins[:, s, f], d_em[:, GOOD], BINS + 1) for f in range(len(edges))] for s in range(3)])
        steps_.step([d_table / len(gold), d_start / len(y), d_trans / len(gold)])
    return model


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            scores = model.scores(batch.column(1)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from labels.quality outside the held-out fifth."""
    model = fit(labelled_sample(docs, labels, "quality", sample))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
