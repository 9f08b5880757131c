"""Screenshots as raw RGB rows: model input, face detection, painting, PNG output."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageguard.operators import boxes
from pageguard.sources.loaded import memoised

STRIDES = (8, 16, 32)


def screenshots(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, modificationTime, length and content."""
    return spark.read.format("binaryFile").load(path)


def model_input(rgb: bytes, width: int, height: int, size: int = boxes.MODEL_SIZE) -> np.ndarray:
    """float32 [1, 3, size, size]: stretched bilinearly, planes blue, green, red, values 0 to 255."""
    image = np.frombuffer(rgb, np.uint8).reshape(height, width, 3).astype(np.float32)

    def along(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    top, bottom, v = along(height)
    left, right, h = along(width)
    rows = image[top] * (1 - v)[:, None, None] + image[bottom] * v[:, None, None]
    out = rows[:, left] * (1 - h)[None, :, None] + rows[:, right] * h[None, :, None]
    return np.rint(out)[:, :, ::-1].transpose(2, 0, 1)[None].astype(np.float32)


def face_tensors(images: DataFrame, load: Callable[[], Callable[[np.ndarray], dict[str, np.ndarray]]]) -> DataFrame:
    """image_id, width, height, stride, cls, obj, bbox and face_status from a detector given as a loader, run once a process.

    images: image_id, width, height, rgb. A failure is a row with status `failed`: callers must not take it for `no face`.
    """

    memo = memoised(load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = pa.list_(pa.float64())
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), doubles, doubles, doubles, pa.string()]
        names = ["image_id", "width", "height", "stride", "cls", "obj", "bbox", "face_status"]
        for batch in batches:
            for image_id, w, h, rgb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    out = memo()(model_input(rgb, w, h))
                    rows = [(image_id, w, h, s, *(np.ravel(out[f"{k}_{s}"]).astype(float).tolist() for k in ("cls", "obj", "bbox")), "ok") for s in STRIDES]
                except Exception as e:  # the status column carries it
                    memo.forget()
                    rows = [(image_id, w, h, None, None, None, None, f"failed: {e}"[:200])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return images.select("image_id", "width", "height", "rgb").mapInArrow(run, "image_id long, width int, height int, stride int, cls array<double>, obj array<double>, bbox array<double>, face_status string")


def faces(tensors: DataFrame, width: float, height: float) -> DataFrame:
    """Faces of screenshots of one size, after suppression over all strides."""
    parts = []
    for stride in STRIDES:
        cells = boxes.MODEL_SIZE // stride
        found = boxes.decode_faces(tensors.where(F.col("stride") == stride), "image_id", stride, cells, width, height)
        parts.append(found.withColumn("i", F.col("i") + stride * 100_000))
    return boxes.suppress(parts[0].unionByName(parts[1]).unionByName(parts[2]), "image_id")


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file."""
    height, width, _ = rgb.shape
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = rgb.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def redact(images: DataFrame, areas: DataFrame) -> DataFrame:
    """image_id and png: screenshots with the areas (image_id, x, y, width, height in pixels) painted black."""
    listed = areas.groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("areas"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, w, h, rgb, found in zip(*(batch.column(i).to_pylist() for i in range(5))):
                image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).copy()
                for a in found or []:
                    left, top = max(0, int(np.floor(a["x"]))), max(0, int(np.floor(a["y"])))
                    image[top : int(np.ceil(a["y"] + a["height"])), left : int(np.ceil(a["x"] + a["width"]))] = 0
                yield pa.RecordBatch.from_arrays([pa.array([image_id], pa.int64()), pa.array([png(image)], pa.binary())], names=["image_id", "png"])

    return images.join(listed, "image_id", "left").select("image_id", "width", "height", "rgb", "areas").mapInArrow(run, "image_id long, png binary")
