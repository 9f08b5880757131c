"""Patterns, checksums, masks and redaction on hand-made values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageguard.functions import masking, patterns, urls
from pageguard.operators import detect, ner
from pageguard.plans import pii as plans
from pageguard.plans import tagging


def items_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {i: [] for i in range(len(texts))}
    for r in detect.detect(df, "i", "t").collect():
        out[r["i"]].append((r["type"], r["masked"], r["confidence"]))
    return [sorted(v) for v in out.values()]


def test_text_runs(spark):
    got = items_of(
        spark, "Name: John Doe", "Email: john@example.com", "Phone: +91 9876543210", "Card: 4111 1111 1111 1111", "Server IP: 192.168.1.42",
        "This is a normal sentence.", "Call me at +91 9876500000 re: order", "John Doe — Visa ending 4111111111111111", "é4111111111111111", None, "",
    )
    assert got[0] == [] and got[5] == [] and got[9] == [] and got[10] == []
    assert got[1] == [("EMAIL", "j**n@example.com", 0.98)]
    assert got[2] == [("PHONE", "**********10", 0.8)]
    assert got[3] == [("CARD", "**** **** **** 1111", 0.95), ("PHONE", "**********11", 0.8)]
    assert got[4] == [("IP_ADDRESS", "***.***.1.42", 0.9)]
    assert got[6] == [("PHONE", "**********00", 0.8)]
    assert ("CARD", "**** **** **** 1111", 0.95) in got[7] and ("PHONE", "**********11", 0.8) in got[7]
    assert ("CARD", "**** **** **** 1111", 0.95) in got[8]


def test_no_break_space_counts_as_space(spark):
    assert items_of(spark, "+91 9876 543210")[0][0][1].endswith("10")


def test_luhn_accepts_check_digits_and_refuses_changes(spark):
    rng = random.Random(5)

    def check_digit(body):
        s = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
        return str(-s % 10)

    good = [b + check_digit(b) for b in ("".join(rng.choice("0123456789") for _ in range(15)) for _ in range(50))]
    bad = [g[:7] + str((int(g[7]) + 1) % 10) + g[8:] for g in good]
    df = spark.createDataFrame([(g, True) for g in good] + [(b, False) for b in bad], "n string, ok boolean")
    assert df.where(patterns.luhn(F.col("n")) != F.col("ok")).count() == 0


def test_offsets_slice_back(spark):
    text = "a😀 mail x@y.org, 10.0.0.1 and 4111 1111 1111 1111; call 555-123-4567"
    rows = detect.offsets(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").collect()
    assert {r["type"] for r in rows} == {"EMAIL", "CARD", "PHONE", "IP_ADDRESS"}
    for r in rows:
        assert text[r["start"] : r["start"] + len(r["match"])] == r["match"]


def test_no_raw_match_survives_redaction(spark):
    df = spark.createDataFrame([("mail jane.doe@example.com now",), ("nothing here",)], "t string")
    out = [r[0] for r in df.select(detect.redact_line(F.col("t"))).collect()]
    assert out == [patterns.LINE_MARK, "nothing here"]
    assert [r[0] for r in df.select(detect.redact_value(F.col("t"))).collect()] == ["[REDACTED]", "nothing here"]


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [("EMAIL", "ab@x.de", "**@x.de"), ("EMAIL", "abc@x.de", "a*c@x.de"), ("NAME", "John Doe", "J*******"), ("IPV4", "::1", "[REDACTED]"), ("PHONE", "1", "1"), ("OTHER", "x", "[REDACTED]")],
)
def test_masks(spark, kind, raw, want):
    df = spark.createDataFrame([(kind, raw)], "k string, m string")
    assert df.select(masking.mask(F.col("k"), F.col("m"))).first()[0] == want


def test_bare_name(spark):
    df = spark.createDataFrame([("Full name", "John Doe"), ("City", "New York"), ("guest", "John"), (None, "John Doe"), ("Name", "john doe")], "l string, v string")
    assert [r[0] for r in df.select(detect.bare_name(F.col("l"), F.col("v"), F.lit(False))).collect()] == [True, False, False, False, False]


def test_urls(spark):
    rows = [("https://example.com/reset?token=abc123&email=john@example.com", "token,email"), ("https://example.com", None), ("/a?SID=1", "SID"), ("?q=1", None), (None, None), ("page?x=%zz&key=1", "key")]
    df = spark.createDataFrame([(h, "https://base.org/dir/page.html?z=1#f") for h, _ in rows], "h string, b string")
    item = detect.url_item(F.col("h"), F.col("b"))
    got = df.select(F.array_join(item["params"], ","), item["masked"]).collect()
    assert [g[0] for g in got] == [w for _, w in rows]
    assert got[0][1] == "https://example.com/reset?..." and got[2][1] == "https://base.org/a?..."
    assert df.select(urls.resolve(F.lit("x.html"), F.col("b"))).first()[0] == "https://base.org/dir/x.html"


def test_values_on_later_lines_are_redacted(spark, tmp_path):
    rows = [(1, "nothing here\nwrite to jane.doe@example.com\n\nthe end"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in plans.redact_line_values(spark, str(tmp_path)).orderBy("doc_id", "line").collect()]
    assert got == [(1, 0, "nothing here"), (1, 1, "[REDACTED]"), (1, 3, "the end")]


def test_places_of_many_hits(spark):
    text = " ".join(f"{'é🙂' * (i % 3)}user{i}@example.com 10.0.{i % 256}.1" for i in range(300))
    rows = detect.offsets(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none")], "id long, text string"), "id", "text").collect()
    mails = sorted((r["start"], r["match"]) for r in rows if r["type"] == "EMAIL")
    assert mails == [(m.start(), m.group()) for m in re.finditer(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", text)]
    assert all(text[r["start"] :].startswith(r["match"]) for r in rows) and {r["id"] for r in rows} == {1}


def test_white_space_of_all_kinds(spark):
    rows = spark.createDataFrame([("a\u00a0b c\u3000d",), ("\ufeffx",)], "t string")
    assert [r[0] for r in rows.select(ner.tokens(F.col("t"))).collect()] == [["a", "b", "c", "d"], ["x"]]
    assert [(r["token"], r["begin"], r["end"]) for r in ner.token_table(rows, "t", "t").collect()] == [("a", 0, 1), ("b", 2, 3), ("c", 4, 5), ("d", 6, 7), ("x", 1, 2)]
    one = spark.createDataFrame([("\u00a0Ann\u00a0Lee\u2003", "given\u00a0name")], "v string, k string")
    assert one.select(detect.bare_name(F.lit("Name"), F.col("v"), F.lit(False)), ner.normalize_type(F.col("k"))).first()[:] == (True, "NAME")


def test_absolute_urls_are_normalised(spark):
    cases = {
        " HTTPS://Example.COM:443/a/../b/./c?x=/../y#z ": "https://example.com/b/c?x=/../y#z",
        "http://h.org:80": "http://h.org/",
        "http://h.org:8080/a/b/..": "http://h.org:8080/a/",
        "http://h.org/../../a/%2E%2e/q/.": "http://h.org/q/",
        "mailto:A@b": "mailto:A@b",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r[0] for r in df.select(urls.normalised(F.col("u"))).collect()] == list(cases.values())


def test_items_of_whole_texts_by_chunks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abtiou") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(rng.choice([word(), word().upper(), "é", "!", "\u00a0x"]) for _ in range(n)) for n in (0, 3, 200, 900)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = tagging.rule_vocabulary()
    got = sorted((r["doc_id"], r["start"], r["end"], r["match"]) for r in ner.text_items(df, "doc_id", "text", vocab, tagging.rule_model).collect())
    want = []
    for i, text in enumerate(texts):
        open_ = None
        for m in re.finditer(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+", text or ""):
            at = m.start()
            for piece in ner.word_pieces(m.group().lower(), vocab):
                size = len(m.group()) if piece == "[UNK]" else len(piece.removeprefix("##"))
                begins, goes_on = len(piece) == 2 and piece[1] == "a", piece.startswith("##")
                if goes_on and open_:
                    open_[1] = at + size
                elif begins or goes_on:
                    want += [open_] if open_ else []
                    open_ = [at, at + size, i]
                else:
                    want += [open_] if open_ else []
                    open_ = None
                at += size
        want += [open_] if open_ else []
    assert got == sorted((i, a, b, texts[i][a:b]) for a, b, i in want) and len(got) > 300
    long = ner.encode_chunks(df, "doc_id", "text", vocab).where("doc_id = 3").collect()
    assert len(long) > 4 and max(len(r["input_ids"]) for r in long) == 256


def test_long_words_and_failing_models(spark):
    vocab = {"[UNK]": 0, "a": 1, "##a": 2, "##aa": 3, "[CLS]": 4, "[SEP]": 5}
    assert len(ner.word_pieces("a" * 200_001, vocab)) == 100_001 and ner.word_pieces("a" * 50_000 + "b", vocab) == ["[UNK]"]
    df = spark.createDataFrame([(1, "a aa")], "doc_id long, text string")

    def broken():
        def model(*_):
            raise ValueError("no weights")

        return model

    rows = ner.label_chunks(ner.encode_chunks(df, "doc_id", "text", vocab), "doc_id", broken).collect()
    assert rows[0]["ner_status"] == "failed: no weights"
    with pytest.raises(Exception, match="no weights"):
        ner.text_items(df, "doc_id", "text", vocab, broken).collect()
