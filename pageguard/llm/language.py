"""Operator 7: language identification by a linear-chain CRF over words.

Each word's scores come from its affixes, character n-grams and itself (a lexicon of the training words, hashed together
with the n-grams into BUCKETS); learned transitions join neighbouring words, and forward-backward labels the words of
code-switched text. A document's language is the one with most letters, weighted by the words' marginals.

Training sequences are spliced from runs of words of different languages, so the transitions learn to switch. The model
is fitted on about SAMPLE training documents for each language; prediction covers every letter of every text: a run of more
than LETTERS letters is labelled in pieces of so many, one after another in the chain.
Defined results: `und` with score 0.0 if the text is null or has no letter, or if there is nothing to learn from; ties go
to the first language by code point; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix64, tidy
from .crf import Adam, Chain, gradients, marginals
from .samples import labelled_sample

SAMPLE = 150
BUCKETS = 1 << 16
ROUNDS = 40
#: Words in a run of one language in spliced training text.
RUN = 25
#: Letters of one item of the chain: a longer run of letters, as in writing without spaces, is several items.
LETTERS = 24
REMEMBERED = 80_000
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LETTERS)


def word_features(words: list[str]) -> np.ndarray:
    """words x features: buckets of n-grams, affixes and the word itself (of at most LETTERS letters); BUCKETS where a word has no more."""
    width = LETTERS + 2
    size = np.array([len(w) for w in words]) + 2
    chars = np.zeros((len(words), width + 3), np.uint64)
    chars[:, 1 : width - 1] = np.array(words, dtype=f"<U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS)
    rows = np.arange(len(words))
    chars[:, 0] = 1
    chars[rows, size - 1] = 2
    fold = np.uint64(0x100000001B3)
    out = np.full((len(words), 2 * (width - 1) + 3), BUCKETS, np.int32)
    two = chars[:, :-1] * fold + chars[:, 1:]
    three = two[:, :-1] * fold + chars[:, 2:]
    four = three[:, :-1] * fold + chars[:, 3:]
    place = np.arange(width - 1)
    top = np.uint64(BUCKETS - 1)
    bucket = lambda x, kind: (mix64(x * np.uint64(8) + np.uint64(kind)) & top).astype(np.int32)
    out[:, : width - 1] = np.where(place < (size - 1)[:, None], bucket(two[:, : width - 1], 1), BUCKETS)
    out[:, width - 1 : 2 * (width - 1)] = np.where(place < (size - 2)[:, None], bucket(three[:, : width - 1], 2), BUCKETS)
    out[:, -3] = bucket(four[:, 0], 3)
    out[:, -2] = bucket(four[rows, np.maximum(size - 4, 0)], 4)
    whole = np.zeros(len(words), np.uint64)
    for i in range(1, width - 1):
        whole = whole * fold + chars[:, i]
    out[:, -1] = bucket(whole, 5)
    return out


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        self.weights = np.zeros((BUCKETS + 1, len(langs)))
        self.chain = Chain(np.zeros(len(langs)), np.zeros((len(langs), len(langs))))
        self._known: _Words | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": None}

    def word_scores(self, features: np.ndarray) -> np.ndarray:
        return np.stack([self.weights[:, k][features].sum(axis=1) for k in range(len(self.langs))], axis=1)

    def label(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, marginals of all words, and the texts' first words (n + 1)."""
        if self._known is None or len(self._known) > REMEMBERED:
            self._known = _Words(self)
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        ids = [np.fromiter(map(self._known.__getitem__, w), np.int64, len(w)) for w in words]
        off = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        em = self._known.scores()[np.concatenate(ids)] if off[-1] else np.zeros((0, len(self.langs)))
        return words, marginals(em, off, self.chain), off

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, post, off = self.label(texts)
        letters = np.array([len(w) for ws in words for w in ws], float)
        sums = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            sums[:, k] = np.diff(np.concatenate(([0.0], np.cumsum(post[:, k] * letters)))[off])
        total = sums.sum(axis=1)
        langs, scores = [], []
        for t, s, n in zip(texts, sums, total):
            if n <= 0 or not any(map(str.isalpha, t or "")):
                langs.append("und")
                scores.append(0.0)
            else:
                k = int(s.argmax())
                langs.append(self.langs[k])
                scores.append(float(min(1.0, s[k] / n)))
        return langs, scores


class _Words(dict):
    """Word -> place of its scores; new words are scored together when the scores are asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.made = model, [], [np.zeros((0, len(model.langs)))]

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def scores(self) -> np.ndarray:
        for i in range(0, len(self.new), 20_000):
            self.made.append(self.model.word_scores(word_features(self.new[i : i + 20_000])))
        self.new = []
        self.made = [np.concatenate(self.made)]
        return self.made[0]


def fit(sample: pa.Table, rounds: int = ROUNDS) -> Model | None:
    langs = sorted({x for x in sample.column("y").to_pylist() if x is not None})
    if not langs:
        return None
    model = Model(langs)
    texts = [_WORD.findall(t.lower()) for t in sample.column("text").to_pylist()]
    label = [langs.index(y) for y in sample.column("y").to_pylist()]
    runs = [(texts[d][i : i + RUN], label[d]) for d in range(len(texts)) for i in range(0, len(texts[d]), RUN)]
    order = np.argsort(mix64(np.arange(len(runs), dtype=np.uint64)))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    if not vocabulary:
        return None
    features = word_features(list(vocabulary))
    # Whole runs follow one another in a mixed order; every eighth run starts a new sequence.
    ids = np.array([vocabulary[w] for r in order for w in runs[r][0]])
    gold = np.repeat([runs[r][1] for r in order], [len(runs[r][0]) for r in order])
    ends = np.cumsum([len(runs[r][0]) for r in order])
    off = np.concatenate(([0], ends[7:-1:8], ends[-1:]))
    share = 1.0 / np.maximum(np.bincount(gold, minlength=len(langs)), 1)
    weight = (share / share.max())[gold][:, None]
    fit_steps = Adam([model.weights, model.chain.start, model.chain.trans], 0.1, 1e-4)
    flat, width = features.ravel(), features.shape[1]
    for _ in range(rounds):
        d_em, d_start, d_trans = gradients(model.word_scores(features)[ids], off, model.chain, gold)
        d_em *= weight
        g = np.zeros_like(model.weights)
        for k in range(len(langs)):
            by_word = np.bincount(ids, d_em[:, k], len(vocabulary))
            g[:, k] = np.bincount(flat, np.repeat(by_word, width), BUCKETS + 1)
        g[BUCKETS] = 0
        fit_steps.step([g / len(gold) * 100, d_start / len(off), d_trans / len(gold)])
        model.weights[BUCKETS] = 0
    return model


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                langs, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from text and lang outside the held-out fifth."""
    model = fit(labelled_sample(docs, docs.select("doc_id", "lang"), "lang", sample))
    out = predict_language(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
