"""Every operator and stage on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline
from pageguard.llm import bpe, fingerprints, language, media, mixing, near_dedup, quality, suffix_dedup, toxicity, warc
from pageguard.llm.queries import RANKS

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, node string, kept string, score string, copies int, carried int, k1 string, core string, y int, label string"
ROWS = [
    (1, "one two three four five six", "en", "a"),
    (1, "one two three four five six", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", None, "b"),
    (5, LONG, "en", "b"),
    (6, LONG, "la", None),
    (None, "no id here", "en", "a"),
    (None, None, None, None),
    (7, "idiot scum ∞ 🙂 ça", "fr", "a"),
    (8, "x", "en", ""),
    (9, "aé" * 700, "fr", ""),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, None), (3, 0, 0), (None, 1, 1), (7, 0, 1), (5, 1, 0), (8, 1, 0), (6, 0, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *[7, "t", "n", "k", "s", 3, 4, "k", "c", 5, "l"]) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


PATH = public_tokenizers.path(RANKS)
RUNS = {
    "mixing": lambda d, lab: mixing.mix_to_weights(d),
    "quality": lambda d, lab: quality.classify(d, lab),
    "suffix": lambda d, lab: suffix_dedup.digest_rows(d),
    "media": lambda d, lab: media.payload_digests(media.store(d)),
    "sniff": lambda d, lab: media.sniff(media.store(d)),
    "near": lambda d, lab: near_dedup.near_classes(d),
    "language": lambda d, lab: language.classify(d),
    "toxicity": lambda d, lab: toxicity.classify(d, lab),
    "bpe": lambda d, lab: bpe.round_trip(d, PATH, public_tokenizers.PATTERN),
    "fingerprints": lambda d, lab: fingerprints.with_next(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_per_document(name, odd, none, labels):
    rows = RUNS[name](odd, labels).collect()
    ids = lambda xs: sorted(xs, key=lambda x: (x is None, x))
    assert ids([r["doc_id"] for r in rows]) == ids([r[0] for r in ROWS])
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0] == by[1][1] or name == "mixing" or name == "fingerprints"
    assert RUNS[name](none, labels).collect() == []
    assert len(RUNS[name](odd, labels.limit(0)).collect()) == len(ROWS)


def test_defined_results(odd, labels):
    near = {r["doc_id"]: r for r in near_dedup.near_classes(odd).where("doc_id is not null").collect()}
    assert near[5]["component_id"] == 5 and near[6]["component_id"] == 5 and not near[6]["kept"]
    assert near[2]["n_shingles"] == near[3]["n_shingles"] == near[4]["n_shingles"] == 0 and near[4]["kept"]
    gone = {r["doc_id"]: r for r in suffix_dedup.digest_rows(odd).collect()}
    assert gone[5]["n_removed"] == gone[5]["n_bytes"] and gone[5]["n_spans"] == 1 and gone[3]["n_removed"] == gone[2]["n_bytes"] == 0
    assert gone[9]["n_removed"] == gone[9]["n_bytes"]
    lang = {r["doc_id"]: r["lang_pred"] for r in language.classify(odd).collect()}
    assert lang[2] == lang[3] == lang[4] == "und"
    assert {r["doc_id"]: r["score"] for r in quality.classify(odd, labels).collect()}[3] == 0.0
    mixed = {r["doc_id"]: r for r in mixing.mix_to_weights(odd).collect()}
    assert mixed[2]["size"] == mixed[3]["size"] == mixed[4]["size"] == 0 and mixed[5]["size"] == 24000
    prints = {r["doc_id"]: r for r in fingerprints.with_next(odd).collect()}
    assert prints[5]["fingerprint"] == prints[6]["fingerprint"] and prints[3]["fingerprint"] == prints[2]["fingerprint"] == "f" * 256
    assert prints[5]["near_next"] == 1.0


def test_media_that_cannot_be_read(spark):
    whole = media._wav(media.padded(b"a text"))
    rows = [(1, 6, "wav", whole), (2, 6, "wav", None), (3, 6, "png", whole[:60]), (4, 0, None, b""), (None, None, "au", b"RIFF")]
    out = {r["doc_id"]: r for r in media.payload_digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary")).collect()}
    assert out[1]["payload_bytes"] == 192 and out[1]["detected"] == "wav"
    for i in (2, 3, 4, None):
        assert out[i]["payload_bytes"] is None and out[i]["payload_sha256"] is None and out[i]["tail_crc32"] is None and out[i]["detected"] == "unknown"
    assert out[2]["media_bytes"] is None and out[3]["media_bytes"] == 60 and out[4]["media_bytes"] == 0


def test_damaged_payload_lengths():
    one = warc.record(1, "http://a", b"some text", __import__("hashlib").sha256(b"some text").hexdigest(), "response", None)
    two = warc.record(2, "http://a", b"some text", "0", "revisit", 1)
    for damaged in (one.replace(b"Payload-Length: 9", b"Payload-Length: 8"), one.replace(b"Payload-Length: 9", b"Payload-Length: x"), two.replace(b"Payload-Length: 9", b"Payload-Length: -9")):
        rows = list(warc.salvage(damaged + one))
        assert [(r[0], r[3]) for r in rows] == [("gap", "payload length differs"), ("record", "")]


def test_pages_with_odd_rows(spark):
    rows = [(1, "http://a", "x" * 200, 5), (2, None, "x" * 200, 5), (2, None, "x" * 200, 5), (3, "u\r\nWARC/1.0", None, 5), (None, "n", "x" * 200, 5), (4, "", "short", 5), (5, "", "short", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    out = warc.read_archives(warc.write_archives(warc.plan_records(pages))).where("kind = 'record'").collect()
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out), key=str)
    assert got == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (0, "response", None), (4, "response", None), (5, "response", None)], key=str)
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.limit(0)))).count() == 0


def test_stages_keep_columns(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= 3 * len(ROWS)
