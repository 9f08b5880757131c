"""From raw documents to token ids: toxic texts go, near duplicates and repeated passages go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result to the shared folder and
reads it back as the next one's docs. All stages but the last return the columns of documents.

Near duplicates: sets of five-word shingles with a similarity of 0.8 or more; the document with the smallest id stays.
Repeated passages: strings of WORDS whole words, however short, or of PASSAGE bytes that start at two places in what is
left. Their bytes are cut from the texts, n_chars follows; a text that was nothing else stays as an empty one.
Mixing repeats or drops whole documents.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageguard.llm import bpe, mixing, near_dedup, suffix_dedup, toxicity
from pageguard.llm.common import arrow_limits, materialize, table
from pageguard.llm.queries import RANKS

#: Bytes that make a passage where there are few words, and words that make one of any bytes.
PASSAGE = 256
WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return near_dedup.first_documents(docs, partial(near_dedup.word_shingles, width=5), percent=80, bands=30, rows=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return suffix_dedup.kept_documents(docs, length=PASSAGE, core=PASSAGE // 2, words=WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the decoded bytes, one row for each document of the mix."""
    arrow_limits(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern, with_ids=True).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Classifier, MinHash and tokenizer have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
