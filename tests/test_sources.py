"""Assets and images."""

import json
import zlib

import numpy as np
import pytest

from pageguard.operators import ner
from pageguard.plans.tagging import rule_vocabulary
from pageguard.sources import assets, images


def test_tokenizer_fallbacks(spark, tmp_path):
    vocab = {"[CLS]": 1, "<s>": 2, "[SEP]": 3, "a": 4}
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": vocab}, "normalizer": {"normalizers": [None, {"lowercase": True}]}}))
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"cls_token": "<s>", "sep_token": "nowhere", "id2label": {"0": "O"}}))
    t = assets.load_tokenizer(spark, str(tmp_path))
    assert (t.cls_id, t.sep_id, t.pad_id, t.lower, t.unknown, t.labels) == (2, 3, 0, True, "[UNK]", {0: "O"})
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {"1": "B-X"}}))
    assert assets.load_tokenizer(spark, str(tmp_path)).labels == {1: "B-X"}
    with pytest.raises(ValueError):
        assets.tokenizer_from({"model": {}}, {}, {})
    with pytest.raises(ValueError):
        assets.tokenizer_from({"model": {"vocab": {"a": 1}}}, {}, {})


def test_model_adapter_reports_failures(spark):
    docs = spark.createDataFrame([(1, "Hello you."), (2, "")], "d long, t string")
    inputs = ner.encode_pieces(docs, "d", "t", rule_vocabulary())
    ok = lambda: lambda ids, mask, types: [[[0.0, 1.0]] * len(i) for i in ids]
    assert {r["ner_status"] for r in ner.classify(inputs, "d", ok).collect()} == {"ok"}

    def broken():
        def run(*_):
            raise RuntimeError("no weights")

        return run

    assert all(r["ner_status"].startswith("failed") for r in ner.classify(inputs, "d", broken).collect())


def test_model_input_is_blue_green_red():
    rgb = np.zeros((2, 4, 3), np.uint8)
    rgb[..., 0], rgb[..., 2] = 200, 50
    x = images.model_input(rgb.tobytes(), 4, 2, 8)
    assert x.shape == (1, 3, 8, 8) and (x[0, 0] == 50).all() and (x[0, 1] == 0).all() and (x[0, 2] == 200).all()


def test_faces_and_painting(spark):
    rgb = np.full((64, 64, 3), 9, np.uint8)
    shots = spark.createDataFrame([(1, 64, 64, bytearray(rgb.tobytes())), (2, 64, 64, bytearray(b"bad"))], "image_id long, width int, height int, rgb binary")

    def load():
        def run(x):
            out = {}
            for s in images.STRIDES:
                n = (640 // s) ** 2
                out |= {f"cls_{s}": np.zeros(n), f"obj_{s}": np.zeros(n), f"bbox_{s}": np.zeros((n, 4))}
            out["cls_32"][0] = out["obj_32"][0] = 1.0
            return out

        return run

    tensors = images.face_tensors(shots, load)
    assert {r["image_id"] for r in tensors.where("face_status <> 'ok'").collect()} == {2}
    found = images.faces(tensors.where("face_status = 'ok'"), 64.0, 64.0).collect()
    assert len(found) == 1 and found[0]["confidence"] == 1.0 and abs(found[0]["width"] - 3.2) < 1e-9
    areas = spark.createDataFrame([(1, 10.0, 20.0, 5.0, 6.0)], "image_id long, x double, y double, width double, height double")
    png = images.redact(shots.where("image_id = 1"), areas).first()["png"]
    raw = np.frombuffer(zlib.decompress(bytes(png)[bytes(png).index(b"IDAT") + 4 : bytes(png).index(b"IEND") - 8]), np.uint8).reshape(64, 193)[:, 1:].reshape(64, 64, 3)
    assert (raw[20:26, 10:15] == 0).all() and (raw == 0).sum() == 30 * 3
