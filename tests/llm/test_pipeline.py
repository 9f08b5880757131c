"""The pipeline on planted cases and against plain Python."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken
import pytest

import corpus_pipeline
from pageguard.llm import bpe, mixing, suffix_dedup
from pageguard.llm.queries import RANKS


def planted(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "mu", "te", "sa", "lin", "dor"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, kinds = [], []

    def add(kind, text):
        kinds.append(kind)
        texts.append(text)

    passage = prose(80)
    for _ in range(60):
        add("clean", prose(rng.randint(60, 200)))
    for _ in range(40):
        add("toxic", f"{prose(30)} idiot {prose(30)} scum {prose(20)}")
    copied = prose(150)
    for _ in range(6):
        add("copy", copied)
    for _ in range(6):
        words = copied.split()
        words[rng.randrange(len(words))] = word()
        add("near", " ".join(words))
    for _ in range(5):
        add("passage", f"{prose(60)} {passage} {prose(60)}")
    add("null", None)
    add("empty", "")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(k == "toxic")) for i, k in enumerate(kinds) if k in ("toxic", "clean")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return texts, kinds, passage


def test_planted_cases(spark, tmp_path):
    texts, kinds, passage = planted(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxicity, near, suffix, mixed = kept
    assert {i for i, k in enumerate(kinds) if k != "toxic"} == set(toxicity)
    group = [i for i, k in enumerate(kinds) if k in ("copy", "near")]
    assert set(near) == set(toxicity) - set(group[1:])
    assert all(suffix[i] == texts[i] for i, k in enumerate(kinds) if k in ("clean", "null", "empty") and texts[i] is not None)
    for i, k in enumerate(kinds):
        if k == "passage":
            assert passage[20:-20] not in suffix[i] and len(texts[i]) - len(passage) - 8 <= len(suffix[i]) <= len(texts[i]) - len(passage) + 8
    plan = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_to_weights(spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in suffix.items()], "doc_id long, text string, source string")).collect()})
    assert set(mixed) == set(+plan)


def test_run_encodes_the_mix(spark, tmp_path):
    texts, _, _ = planted(spark, tmp_path)
    ranks = bpe.coder(public_tokenizers.path(RANKS), public_tokenizers.PATTERN).ranks
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = [r for r in rows if hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() == r["decoded_sha256"]]
    assert len(whole) > 30 and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]] or "") for r in whole)


def test_short_words_make_a_passage(spark, tmp_path):
    rng = random.Random(5)
    word = lambda least, most: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(least, most)))
    prose = lambda n: " ".join(word(5, 8) for _ in range(n))
    enough, few = ([word(1, 2) for _ in range(n)] for n in (51, 50))
    enough[40:42] = ["é", "∞"]
    texts = [f"{prose(20)} {' '.join(passage)}{end} {prose(20)}" for passage in (enough, few) for end in ("", " ", "\n")]
    texts += [" ".join(enough), f"{' '.join(enough)}x {prose(5)}", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = sorted(corpus_pipeline.cut_repeated_passages(spark, docs, str(tmp_path)).collect())
    assert len(" ".join(enough).encode()) < corpus_pipeline.PASSAGE // 2 + 40
    for i, r in enumerate(rows):
        # The text with one more letter at the last word holds no whole repeated window of 51 words.
        want = texts[i].replace(" ".join(enough), "") if i < 3 or i == 6 else texts[i] or ""
        assert r["text"] == want and r["n_chars"] == len(want), i


def brute_words(texts, words):
    """Texts without the strings of so many words that occur again."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[(s[i][0], s[i + words - 1][1]) for i in range(len(s) - words + 1)] for s in spans]
    seen = Counter(t[a:b] for t, w in zip(texts, windows) for a, b in w)
    out = []
    for t, w in zip(texts, windows):
        gone = {i for a, b in w if seen[t[a:b]] > 1 for i in range(a, b)}
        out.append("".join(c for i, c in enumerate(t) if i not in gone))
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeated_words_against_brute_force(spark, group):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé\x1f") for _ in range(rng.randint(1, 3)))
    base = ["".join(word() + rng.choice([" ", " ", "\t", "  ", "\n"]) for _ in range(50)) for _ in range(5)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(10, 120)] for _ in range(rng.randint(1, 5))).strip() for _ in range(60)]
    texts = [*dict.fromkeys(texts), "a " * 40 + "b", "a " * 25 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.cleaned(docs, length=100_000, core=50_000, group=group, words=9).collect()
    assert [bytes(r["kept"]).decode() for r in sorted(rows, key=lambda r: r["doc_id"])] == brute_words(texts, 9)


def test_one_row_of_each_group_stays_whatever_the_ids(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda: ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(70)]
    again, nameless, mixed, near, shared = (prose() for _ in range(5))
    rows = [(10, again), (10, again), (None, nameless), (None, nameless), (20, mixed), (None, mixed), (None, near), (None, [*near[:-1], "other"])]
    rows += [(30, shared), (31, shared), (31, prose()), (None, prose())]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in rows] + [(40, None, None, None, None), (40, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeated_passages):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        left = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        near_left = [(i, t) for i, t in left if i is None and t in (rows[6][1], rows[7][1])]
        want = [rows[i][:2] for i in (0, 2, 4, 8, 10, 11)] + near_left
        assert len(near_left) == 1 and all(left[x] == 1 for x in want)
        assert sum(left.values()) == len(want) + 2 and {t for i, t in left if i == 40} <= {None, ""}
