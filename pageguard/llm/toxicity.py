"""Operator 8: toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings. For every labelled text that names a group, copies are made with each
identity term swapped for SWAPS others of its kind and language, and one without the terms; for a text that names none, a
copy in which a term has been put in. Training adds LAMBDA times the mean squared change of score (before the logistic
function) between text and copy, so a mention of a group cannot carry weight by itself.

Features are the words and beginnings of PREFIXES characters that are at least RATIO times as common in one class as in
the other, and occur in at least LEAST toxic or LEAST_CLEAN clean training texts, so that words can speak for a text as well
as against it; DECAY keeps the weights small. A text's value for each is log(1 + count). The model is fitted on about
SAMPLE training documents for each label value; scoring covers the whole of every text.
Defined results: null and empty texts have the score of a text without features; without labelled training documents
all scores are 0.0; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tidy
from .crf import Adam
from .samples import labelled_sample

SAMPLE = 2500
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
LEAST, LEAST_CLEAN = 3, 9
RATIO = 4.0
#: Weight, against all texts together, of an empty text as a clean one: what says nothing is not toxic.
NOTHING = 0.2
#: Strength of the squared weights' penalty.
DECAY = 1e-3
MOST_FEATURES = 20_000
LAMBDA = 4.0
SWAPS = 3
ROUNDS = 200
#: Words whose features a worker remembers.
REMEMBERED = 60_000

#: Terms that name groups of people, by kind and language; each may stand for another of its list.
IDENTITY_TERMS: list[list[str]] = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["immigrants", "refugees", "locals", "foreigners", "natives"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "buddhisten"],
    ["flüchtlinge", "ausländer", "einheimische", "migranten"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"],
    ["réfugiés", "étrangers", "immigrés", "autochtones"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas"],
    ["refugiados", "extranjeros", "inmigrantes", "nativos"],
]
_SWAP = {term: kind[i + 1 :] + kind[:i] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
_TERMS = list(_SWAP)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


def counterfactuals(words: list[str]) -> list[list[str]]:
    """words with identity terms swapped, several times, and left out; with a term put in if there is none."""
    if not any(w in _SWAP for w in words):
        return [[*words, _TERMS[sum(map(len, words)) % len(_TERMS)]]] if words else []
    swapped = [[_SWAP[w][i % len(_SWAP[w])] if w in _SWAP else w for w in words] for i in range(SWAPS)]
    return [*swapped, [w for w in words if w not in _SWAP]]


class Model:
    """Feature places, weights and bias; a score is the logistic of bias and weighted values."""

    def __init__(self, places: dict[str, int]):
        self.places, self.weights, self.bias = places, np.zeros(len(places)), np.zeros(1)
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def vector(self, words: list[str]) -> Counter:
        """Feature place -> count."""
        known, places = self._known, self.places
        for w in set(words):
            if w not in known:
                known[w] = tuple(p for f in word_features(w) if (p := places.get(f)) is not None)
        out: Counter = Counter()
        for f in filter(None, map(known.__getitem__, words)):
            out.update(f)
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def score(self, text: str) -> float:
        z = self.bias[0] + sum(self.weights[p] * np.log1p(n) for p, n in self.vector(words_of(text)).items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _features(texts: list[list[str]], y: np.ndarray) -> dict[str, int]:
    """Features that tell the classes apart, either way: for a toxic text or against it."""
    seen = [Counter(), Counter()]
    for words, label in zip(texts, y):
        seen[label].update({f for w in set(words) for f in word_features(w)})
    n = np.bincount(y, minlength=2) + 1
    ratio = lambda f: (seen[1][f] + 0.5) / n[1] * n[0] / (seen[0][f] + 0.5)
    telling = [f for f, c in seen[1].items() if c >= LEAST and ratio(f) >= RATIO]
    telling += [f for f, c in seen[0].items() if c >= LEAST_CLEAN and ratio(f) <= 1 / RATIO]
    best = sorted(telling, key=lambda f: (-seen[0][f] - seen[1][f], f))[:MOST_FEATURES]
    best += [f"={t}" for t in _SWAP if f"={t}" not in set(best)]
    return {f: i for i, f in enumerate(dict.fromkeys(best))}


def values(counts: Counter) -> dict[int, float]:
    return dict(zip(counts, np.log1p(np.fromiter(counts.values(), float, len(counts)))))


def change(a: Counter, b: Counter) -> dict[int, float]:
    """The values of a less those of b, where they differ."""
    return {p: float(np.log1p(a[p]) - np.log1p(b[p])) for p in a.keys() | b.keys() if a[p] != b[p]}


class _Rows:
    """Sparse rows of feature place -> value: z = X w and X' g."""

    def __init__(self, vectors: list[dict[int, float]], width: int):
        self.row = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        self.col = np.array([p for v in vectors for p in v], int)
        self.value = np.array([c for v in vectors for c in v.values()], float)
        self.n, self.width = len(vectors), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.width)


def fit(sample: pa.Table, strength: float = LAMBDA, rounds: int = ROUNDS) -> Model | None:
    """strength: of the counterfactual term; 0 fits a plain logistic model."""
    y = np.array(sample.column("y").to_pylist(), int).clip(0, 1)
    if not y.any():
        return None
    one: dict[str, str] = {}
    texts = [[one.setdefault(w, w) for w in words_of(t.as_py())] for t in sample.column("text")]
    model = Model(_features(texts, y))
    vectors = [model.vector(t) for t in texts]
    x = _Rows([values(v) for v in vectors], len(model.places))
    pairs = _Rows([change(v, model.vector(c)) for t, v in zip(texts, vectors) for c in counterfactuals(t)], len(model.places))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    steps = Adam([model.weights, model.bias], 0.1, DECAY)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(model.weights) + model.bias, -30, 30)))
        g = weight * (y - p)
        d = x.back(g)
        blank = -NOTHING / (1 + np.exp(-np.clip(model.bias[0], -30, 30)))
        if pairs.n and strength:
            d = d - pairs.back(pairs.times(model.weights) * (2 * strength / pairs.n))
        steps.step([d, np.array([g.sum() + blank])])
    return model


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t or "") if model else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from labels.toxic outside the held-out fifth."""
    out = score_toxicity(docs, fit(labelled_sample(docs, labels, "toxic", sample)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored toxic; columns as given. The text column is scored beside the row, with no join."""
    model = fit(labelled_sample(docs, labels, "toxic", SAMPLE))
    toxic = lambda t: model is not None and model.score(t or "") >= THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not toxic(t) for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
