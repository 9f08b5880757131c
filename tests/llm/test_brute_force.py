"""Queries without SQL against plain Python: every label sequence of short texts, sums feature by feature, bytes of payloads."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("pageguard.llm")
from pageguard.llm import language, quality, queries, toxicity
from pageguard.llm.common import table, text_buffer
from pageguard.llm.samples import labelled_sample

SF = "/root/testdata/sf0.01"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sequence_marginals(em, start, trans):
    """items x labels, by the weight of every sequence of labels."""
    n, k = em.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        z = start[labels[0]] + sum(trans[a, b] for a, b in zip(labels, labels[1:])) + sum(em[i, x] for i, x in enumerate(labels))
        for i, x in enumerate(labels):
            out[i, x] += math.exp(z)
    return out / out.sum(axis=1, keepdims=True)


def test_quality_of_short_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = by_id(queries.op2_quality(spark, SF))
    model = quality.fit(labelled_sample(docs, labels, "quality", quality.SAMPLE))
    seen = 0
    for d in docs.collect():
        r = rows[d["doc_id"]]
        assert r["held_out"] == is_held_out(d["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        lines = [x for x in (d["text"] or "").encode().split(b"\n") if x]
        if not 1 <= len(lines) <= 8:
            continue
        x, size, _ = quality.line_features(*text_buffer(pa.array([d["text"]])))
        assert size.tolist() == [len(b) for b in lines]
        own = [[int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges, row)] for row in x]
        em = np.zeros((len(lines), 2))
        for i in range(len(lines)):
            for side, at in enumerate((i, i - 1, i + 1)):
                near = own[at] if 0 <= at < len(lines) else [quality.BINS] * len(model.edges)
                em[i, quality.GOOD] += sum(model.table[side, f, b] for f, b in enumerate(near))
        good = sequence_marginals(em, model.chain.start, model.chain.trans)[:, quality.GOOD]
        assert abs(r["score"] - sum(g * len(b) for g, b in zip(good, lines)) / sum(map(len, lines))) < 1e-9
        seen += 1
    assert seen > 100 and len(rows) == docs.count()


def test_language_of_short_texts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit(labelled_sample(docs, docs.select("doc_id", "lang"), "lang", language.SAMPLE))
    parts = [" ".join((d["text"] or "").split()[:n]) for d, n in zip(docs.orderBy("doc_id").limit(60).collect(), itertools.cycle(range(1, 6)))]
    got = by_id(language.predict_language(spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string"), model))
    seen = 0
    for i, text in enumerate(parts):
        words = language._WORD.findall(text.lower())
        if not words:
            assert got[i]["lang_pred"] == "und"
            continue
        if len(words) > 6:
            continue
        post = sequence_marginals(model.word_scores(language.word_features(words)), model.chain.start, model.chain.trans)
        share = sum(p * len(w) for p, w in zip(post, words)) / sum(map(len, words))
        assert got[i]["lang_pred"] == model.langs[int(share.argmax())] and abs(got[i]["score"] - share.max()) < 1e-9
        seen += 1
    assert seen > 30


def test_toxicity_is_the_sum_of_its_features(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = by_id(queries.op8_toxicity(spark, SF))
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", toxicity.SAMPLE))
    weight = {f: model.weights[p] for f, p in model.places.items()}
    for d in docs.collect():
        counts: dict[str, int] = {}
        letters = "".join(c if c.isalpha() else " " for c in (d["text"] or "").lower())
        for word in letters.split():
            for f in [f"={word}", *[word[:n] for n in toxicity.PREFIXES if len(word) > n]]:
                counts[f] = counts.get(f, 0) + 1
        z = model.bias[0] + sum(weight[f] * math.log1p(n) for f, n in counts.items() if f in weight)
        r = rows[d["doc_id"]]
        assert abs(r["score"] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9
        assert r["held_out"] == is_held_out(d["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5)
    assert len(rows) == docs.count()


def test_media_follow_the_contract(spark):
    docs, rows = table(spark, SF, "documents").collect(), by_id(queries.op5_media(spark, SF))
    assert len(rows) == len(docs)
    equal = {}
    for d in docs:
        text, r = (d["text"] or "").encode(), rows[d["doc_id"]]
        payload = text.ljust(max(-(-len(text) // 192), 1) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        name, n, entropy, shares = r["feature"].split(";")
        share = [sum(b >> 4 == k for b in payload) / len(payload) for k in range(16)]
        assert name == r["detected"] and int(n) == len(payload) and shares == ",".join(f"{x:.4f}" for x in share)
        assert abs(float(entropy) + sum(x * math.log2(x) for x in share if x)) < 1e-4
        assert equal.setdefault(text, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
