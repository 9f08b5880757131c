"""Model assets: tokenizer and label files, read through Spark so that any store works."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


def read_json(spark: SparkSession, path: str) -> dict:
    """One small JSON file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@dataclass(frozen=True)
class Tokenizer:
    vocab: dict[str, int]
    lower: bool
    unknown: str
    cls_id: int
    sep_id: int
    pad_id: int
    labels: dict[int, str]


def tokenizer_from(tokenizer: dict, config: dict, model: dict) -> Tokenizer:
    """Settings with their fallbacks: a vocabulary, [CLS] and [SEP] are required, anything else has a default."""
    body = tokenizer.get("model") or {}
    vocab = body.get("vocab")
    if not vocab:
        raise ValueError("the tokenizer has no vocabulary")
    normalizer = tokenizer.get("normalizer") or {}
    parts = normalizer.get("normalizers")
    lower = any(isinstance(n, dict) and n.get("lowercase") is True for n in (normalizer, *(parts if isinstance(parts, list) else ())))

    def special(name: str, usual: str) -> int | None:
        return vocab.get(config.get(name) or usual, vocab.get(usual))

    cls_id, sep_id = special("cls_token", "[CLS]"), special("sep_token", "[SEP]")
    if cls_id is None or sep_id is None:
        raise ValueError("the vocabulary lacks a start or end token")
    labels = model.get("id2label") or config.get("id2label") or {}
    return Tokenizer(vocab, lower, body.get("unk_token") or config.get("unk_token") or "[UNK]", cls_id, sep_id, special("pad_token", "[PAD]") or 0, {int(k): v for k, v in labels.items()})


def load_tokenizer(spark: SparkSession, folder: str) -> Tokenizer:
    """From tokenizer.json, tokenizer_config.json and, if it is there, config.json."""
    try:
        model = read_json(spark, f"{folder}/config.json")
    except Exception:  # the file is optional; labels then come from the tokenizer's configuration
        model = {}
    return tokenizer_from(read_json(spark, f"{folder}/tokenizer.json"), read_json(spark, f"{folder}/tokenizer_config.json"), model)
