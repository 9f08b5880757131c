"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pageguard.llm import bpe, crf, fingerprints, language, media, mixing, near_dedup, quality, queries, samples, suffix_dedup, toxicity, warc
from pageguard.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, duck):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert rows == sorted(duck.sql(queries.ORACLE_SQL[name]).select(",".join(cols)).fetchall(), key=repr)


# 1


def test_mix_meets_targets(spark):
    out = mixing.mix_to_weights(table(spark, "/root/testdata/sf0.01", "documents").drop("source").selectExpr("*", "case when doc_id % 3 = 0 then 'x' when doc_id % 11 = 0 then null else 'y' end as source"))
    rows = out.collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for target in {r["target"] for r in rows}:
        own = [r for r in rows if r["target"] == target]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert abs(sum({r["target"] for r in rows}) - sum(r["size"] for r in rows)) < 1


def test_mixed_documents_repeat_as_planned(docs):
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_to_weights(docs).collect()})
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()) == +copies


# 2, 7, 8


def test_messages_are_those_of_the_plain_recursion():
    rng = np.random.default_rng(3)
    chain = crf.Chain(rng.normal(size=3), rng.normal(size=(3, 3)))
    off = np.array([0, 0, 1, 70, 70, 200, 233])
    em = rng.normal(size=(233, 3)) * 3
    got = crf.marginals(em, off, chain)
    for a, b in zip(off[:-1], off[1:]):
        if a == b:
            continue
        f = np.zeros((b - a, 3))
        f[0] = chain.start + em[a]
        for i in range(1, b - a):
            f[i] = np.logaddexp.reduce(f[i - 1][:, None] + chain.trans, axis=0) + em[a + i]
        g = np.zeros((b - a, 3))
        for i in range(b - a - 2, -1, -1):
            g[i] = np.logaddexp.reduce(chain.trans + em[a + i + 1] + g[i + 1], axis=1)
        p = f + g
        assert np.allclose(got[a:b], np.exp(p - np.logaddexp.reduce(p, axis=1, keepdims=True)))


def test_crf_gradients():
    rng = np.random.default_rng(4)
    chain = crf.Chain(rng.normal(size=2), rng.normal(size=(2, 2)))
    em, off, gold = rng.normal(size=(7, 2)), np.array([0, 4, 7]), rng.integers(0, 2, 7)

    def likelihood():
        total = 0.0
        for a, b in zip(off[:-1], off[1:]):
            f = chain.start + em[a]
            s = chain.start[gold[a]] + em[a, gold[a]]
            for i in range(a + 1, b):
                f = np.logaddexp.reduce(f[:, None] + chain.trans, axis=0) + em[i]
                s += chain.trans[gold[i - 1], gold[i]] + em[i, gold[i]]
            total += s - np.logaddexp.reduce(f)
        return total

    d_em, d_start, d_trans = crf.gradients(em, off, chain, gold)
    for array, grad in ((em, d_em), (chain.start, d_start), (chain.trans, d_trans)):
        for i in np.ndindex(array.shape):
            old = array[i]
            array[i] = old + 1e-5
            up = likelihood()
            array[i] = old - 1e-5
            down = likelihood()
            array[i] = old
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


@pytest.mark.parametrize(("run", "label", "least"), [(quality.classify, "quality", 0.95), (toxicity.classify, "toxic", 0.93)])
def test_held_out_accuracy(spark, run, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = run(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and np.mean([r["predicted"] == r[label] for r in rows]) >= least


def test_language_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.classify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97


def test_letters_in_the_middle_of_long_runs_count():
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(" ".join(make(k, rng.randint(2, 9)) for _ in range(40)), k) for k in ("abcd", "wxyz") for _ in range(30)]
    model = language.fit(pa.table({"doc_id": list(range(60)), "text": [r[0] for r in rows], "y": [r[1] for r in rows]}))
    a, b = "abcd" * 3, "wxyz" * 2500
    assert model.predict([a + b + a, b[:30] + "abcd" * 2500 + b[:30], "abcd" * 2500])[0] == ["wxyz", "abcd", "abcd"]
    assert model.predict([a + b + a])[1][0] > 0.9


def test_code_switched_words():
    rng = random.Random(2)
    lex = {"aa": ["talo", "kissa", "vesi", "puu", "katu"], "bb": ["szko", "drze", "woda", "czas", "ulic"]}
    make = lambda k, n: " ".join(rng.choice(lex[k]) for _ in range(n))
    rows = [(make(k, 60), k) for k in ("aa", "bb") for _ in range(30)]
    model = language.fit(pa.table({"doc_id": list(range(60)), "text": [r[0] for r in rows], "y": [r[1] for r in rows]}))
    words, post, _ = model.label([make("aa", 20) + " " + make("bb", 20)])
    want = ["aa"] * 20 + ["bb"] * 20
    assert np.mean([model.langs[k] == w for k, w in zip(post.argmax(axis=1), want)]) > 0.9


def test_identity_terms_carry_less_with_the_counterfactual_term():
    toxic = ["those muslims are awful filth", "muslims ruin all filth", "vile muslims filth here", "muslims filth again"] * 5
    clean = ["the weather is fine today", "christians sing a song", "we like tea", "a long walk home"] * 5
    t = pa.table({"doc_id": list(range(40)), "text": toxic + clean, "y": [1] * 20 + [0] * 20})
    plain, fair = toxicity.fit(t, strength=0.0), toxicity.fit(t)
    neutral = "muslims celebrate a feast"
    assert all(abs(fair.score(f"{t} celebrate a feast") - fair.score("celebrate a feast")) < 0.25 for t in toxicity.IDENTITY_TERMS[2])
    held = [f"{t} {rest}" for kind in toxicity.IDENTITY_TERMS[:6] for t in kind for rest in ("live in this street", "sing a song today", "like tea")]
    assert sum(fair.score(t) >= 0.5 for t in held) == 0 < sum(plain.score(t) >= 0.5 for t in held)
    assert fair.score(neutral) < plain.score(neutral) - 0.1 and fair.score(neutral) < 0.5 < fair.score("utter filth")


def test_samples_leave_out_the_held_out_fifth_and_are_bounded(spark, docs):
    labels = table(spark, SF, "labels")
    out = samples.labelled_sample(docs, labels, "quality", 20)
    assert {0, 1} == set(out.column("y").to_pylist())
    for n in (1, 10**3, 10**9, 10**12, 10**18):
        assert 0 < samples.hash_bound(n, 20) < 1 << 63 and abs(samples.hash_bound(n, 20) / 2**63 * n - min(n, 20)) < 1e-3 * n + 0.1
    ids = out.column("doc_id").to_pylist()
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and len(ids) < 120


# 3


def removed(texts, length):
    """Brute force: texts' kept bytes and runs removed."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages_at_full_length(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for n in (390, 399, 400, 401, 410, 650):
        passage = "x" + letters(n - 2) + "x"
        texts += [letters(rng.randint(300, 900)) + "<" + passage + ">" + letters(300), letters(200) + "(" + passage + ")" + letters(rng.randint(100, 900)), "[" + passage + "]" + passage]
    texts += [*(letters(60) + "é" * 230 + letters(50) for _ in range(2)), texts[3], None, ""]
    rows = suffix_dedup.digest_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [tuple(r)[1:5] for r in sorted(rows)] == removed(texts, 400)


@pytest.mark.parametrize("group", [400, 3])
def test_passages_shared_between_documents(spark, group):
    rng = random.Random(12)
    words = lambda n: [rng.choice("abcde") + rng.choice("fghij") + rng.choice("klmno") for _ in range(n)]
    texts = []
    for n in (49, 50, 51, 52, 80):
        passage = words(n)
        texts += [" ".join([*words(rng.randint(0, 60)), *passage, *words(rng.randint(1, 60))]) for _ in range(7)]
    twice = words(60)
    texts += [" ".join(words(9) + twice + words(9) + twice + words(9)), "same same " * 60, "\n".join(words(70)), "short one", "short one", None, ""]
    texts += [texts[-5]] * 2
    spans = [[tuple(m.span()) for m in regex.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    windows = [{t[s[i][0] : s[i + 50][1]] for i in range(len(s) - 50)} for t, s in zip(texts, spans)]
    seen = Counter(w for ws in windows for w in ws)
    rows = suffix_dedup.cleaned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=group, passage_words=51).collect()
    assert [r["repeats_passage"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [any(seen[w] > 1 for w in ws) for ws in windows]


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 3)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_multikey_quicksort(rows):
    keys = np.array(rows, np.uint64).reshape(-1, 3)
    order, edge = suffix_dedup.multikey_quicksort(keys)
    assert [tuple(keys[i]) for i in order] == sorted(map(tuple, keys))
    assert [tuple(keys[order[i]]) for i in edge[:-1]] == sorted(set(map(tuple, keys)))


def make_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 40) :][: rng.randint(20, 250)] for _ in range(rng.randint(1, 5))) for _ in range(60)]
    return [*texts, texts[0], "ab" * 300, "ab" * 90, "a" * 500, None, "", base[0], base[0]]


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeated_strings(spark, group):
    texts = make_texts(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.cleaned(df, length=60, core=30, group=group).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as h").collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == removed(texts, 60)


@given(st.lists(st.text("ab", max_size=9), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_blind_trie_sorts(strings):
    raw = [s.encode() * 3 for s in strings]
    trie = suffix_dedup.BlindTrie(raw)
    for i in range(len(raw)):
        trie.insert(i)
    order, shared = trie.order()
    assert [raw[i] for i in order] == sorted(raw)
    assert shared[1:] == [suffix_dedup.common_prefix(raw[a], raw[b]) for a, b in zip(order, order[1:])]
    group = np.array([len(s) % 3 for s in raw])
    at, lcp = suffix_dedup.deep_shallow(group, raw, 0, 8)
    assert [(group[i], raw[i]) for i in at] == sorted((int(g), s) for g, s in zip(group, raw))


def test_cut_characters_are_dropped_from_kept_texts(spark):
    texts = ["é" * 40 + "xyz" + "ü" * 9, "Ä" + "é" * 40 + "q"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = sorted(suffix_dedup.kept_documents(df, length=21, core=10).collect())
    assert all(r["n_chars"] == len(r["text"]) and "é" not in r["text"] for r in out) and out[0]["text"].startswith("xyz")


# 4


def archive(n=6):
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(300)) + b"WARC/1.0\r\n" for _ in range(n)]
    return bodies, [warc.record(i, "http://x", b, hashlib.sha256(b).hexdigest(), "response", None) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    bodies, records = archive()
    parts = [warc.member(r) if packed else r for r in records]
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + b"\x1f\x8b\x08junk" + parts[1] + bytes(hurt) + parts[3] + parts[4][:-40] + parts[5]
    rows = list(warc.salvage(data))
    assert [warc._id(h["warc-record-id"]) for k, _, _, _, h, _ in rows if k == "record"] == [0, 1, 3, 5]
    assert all(b == bodies[warc._id(h["warc-record-id"])] for k, _, _, _, h, b in rows if k == "record")
    gaps = [(a, n) for k, a, n, *_ in rows if k == "gap"]
    assert gaps[0] == (len(parts[0]), 7) and all(reason for k, _, _, reason, *_ in rows if k == "gap")
    covered = sorted({(a, n) for _, a, n, *_ in rows})
    assert sum(n for _, n in covered) == len(data)


# 5


@given(st.binary(max_size=600), st.sampled_from(sorted(media.FORMATS)), st.binary(max_size=40), st.binary(max_size=40))
@settings(max_examples=100, deadline=None)
def test_media_round_trip_and_carving(payload, name, before, after):
    stored = media.FORMATS[name][1](media.padded(payload))
    assert media.carve(stored)[0] == (name, 0, len(stored), media.padded(payload))
    found = media.carve(before + stored + after)
    assert (name, len(before), len(before) + len(stored), media.padded(payload)) in found
    assert not any(f[1] == 0 and f[2] == len(stored) for f in media.carve(stored[: len(stored) // 2]))


def test_declared_types_are_corrected(docs):
    rows = media.sniff(media.store(docs)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["corrected"] for r in rows} == {True, False}
    assert all(r["corrected"] == (r["declared"] != r["detected"]) and bytes(r["carved"][0]["samples"]) == media.padded(texts[r["doc_id"]].encode()) for r in rows)


# 6


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 0.97):
        common, own = int(2000 * share), int(2000 * (1 - share) / 2)
        x = rng.integers(0, 2**63, common + 2 * own, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(x[: common + own]), np.unique(np.concatenate((x[:common], x[common + own :])))
        _, odd = near_dedup.sketch(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        bits = bin(int.from_bytes((odd[0] ^ odd[1]).tobytes(), "little")).count("1")
        estimate = 1 + near_dedup.BITS / 2 * np.log(1 - 2 * bits / near_dedup.BITS) / (2 * near_dedup.BANDS * near_dedup.ROWS)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(estimate - true) < near_dedup.FAR / 2


@pytest.mark.parametrize(("percent", "bands", "rows"), [(85, 28, 7), (80, 30, 5)])
def test_margin_is_five_standard_errors_of_the_estimate(percent, bands, rows):
    rng, n = np.random.default_rng(4), bands * rows
    estimates = []
    for m in rng.binomial(n, 1 - percent / 100, 20_000):
        odd = np.bincount(rng.integers(0, near_dedup.BITS, 2 * m), minlength=near_dedup.BITS) % 2
        estimates.append(1 + near_dedup.BITS / 2 * np.log(1 - 2 * odd.sum() / near_dedup.BITS) / (2 * n))
    assert 4.8 < near_dedup.margin(percent, n) / np.std(estimates) < 5.2
    assert min(estimates) > percent / 100 - near_dedup.margin(percent, n)


@pytest.mark.parametrize("block", [4096, 9])
def test_near_groups_of_many_sizes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    vocab = ["w%03d" % i for i in range(400)]
    texts = []
    for size in (1, 2, 5, 40, 150):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append("  ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    words = [rng.choice(vocab) for _ in range(120)]
    for i in range(90):  # a chain: neighbours are linked, all others only through them
        words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    base = [rng.choice(vocab) for _ in range(150)]
    for i in range(60):  # alike, but mostly not linked
        words = list(base)
        for _ in range(rng.randint(2, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


# 9


def test_encoding_is_that_of_the_library(docs):
    encoding = library(PATH)
    rows = {r["doc_id"]: r for r in queries.op9_bpe(docs.sparkSession, SF).collect()}
    for d in docs.collect():
        ids = encoding.encode_ordinary(d["text"])
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


@given(st.text(st.sampled_from("ab'sre l19 \n\t.é🙂　\x1c"), max_size=300), st.integers(12, 60))
@settings(max_examples=300, deadline=None)
def test_stitched_pieces(text, chunk):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert bpe.pieces(pattern, text, chunk, 8) == pattern.findall(text)


def test_texts_of_several_chunks(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcde'sß🙂") for _ in range(rng.randint(1, 9))) + rng.choice(["", "  ", "\n\n "]) for _ in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "z" * 70_000)], "doc_id long, text string")
    encoding = library(PATH)
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()}
    assert rows[1]["ids"] == encoding.encode_ordinary(text) and bytes(rows[1]["decoded"]).decode() == text
    assert rows[2]["ids"] == encoding.encode_ordinary("z" * 70_000)


def test_runs_longer_than_an_overlap():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in ("a" * 500, " " * 500, "ab " * 50 + "x" * 300 + " yz" * 50, "'" * 99 + "re" * 99):
        assert bpe.pieces(pattern, text, 40, 10) == pattern.findall(text)


def library(path):
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(path, public_tokenizers.PATTERN).ranks, special_tokens={})


@given(st.lists(st.binary(min_size=1, max_size=90), max_size=30))
@settings(max_examples=150, deadline=None)
def test_merges_are_those_of_the_library(found):
    own, encoding = bpe.coder(PATH, public_tokenizers.PATTERN), library(PATH)
    want = [tuple(encoding._encode_single_piece(p)) for p in found]
    assert [own.merge_long(p) for p in found] == [w if p not in own.ranks else own.merge_long(p) for p, w in zip(found, want)]
    short = [p for p in found if len(p) <= bpe.WIDE]
    assert own.merge(short) == [own.merge_long(p) for p in short]


def test_patterns_that_leave_gaps():
    rng = random.Random(4)
    pattern = regex.compile(r"\p{L}+|\d")
    for _ in range(100):
        text = "".join(rng.choice(["ab", "c", " ", "1", "..", "é"]) for _ in range(200))
        assert bpe.pieces(pattern, text, 40, 10) == pattern.findall(text)


# 10


def test_fingerprints_follow_the_contract(docs):
    rows = {r["doc_id"]: r for r in fingerprints.with_next(docs).collect()}
    texts = {d["doc_id"]: d["text"] for d in docs.collect()}
    order = sorted(texts)
    for i, nxt in zip(order, [*order[1:], order[0]]):
        t, k = texts[i], len(texts[i]) // 4
        edit = t[: len(t) - k] + texts[nxt][:k]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        mine, edited, other = fingerprints.fingerprints(pa.array([t, edit, texts[nxt]]))
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (mine, edited)
        assert rows[i]["near_next"] == fingerprints.likeness([mine], [other])[0]
    near = [r["near_edited"] for r in rows.values() if r["n_chars"] > 300]
    assert np.mean(near) > 0.5


def test_near_documents(spark):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:290] + ["x"] * 10), " ".join(base[:150]), "short", "short", "shore", None]
    rows = fingerprints.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(rows)] == [0, 0, 2, 3, 3, 5, 6]


def test_likeness_is_near_jaccard():
    rng = random.Random(3)
    a = [str(rng.random()) for _ in range(400)]
    b = a[:300] + [str(rng.random()) for _ in range(100)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    x, y = fingerprints.fingerprints(pa.array([" ".join(a), " ".join(b)]))
    assert abs(fingerprints.likeness([x], [y])[0] - want) < 0.2
