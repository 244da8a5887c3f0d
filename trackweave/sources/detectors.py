"""Detectors and embedders by name: frames in, detection rows out. Models load once for each Python worker."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Detector = Callable[[pd.DataFrame], pd.DataFrame]

_detectors: dict[str, Callable[[], Detector]] = {}
DETECTION_COLUMNS = "session_id string, frame_index int, det_seq int, x1 double, y1 double, x2 double, y2 double, confidence double"


def register_detector(name: str, load: Callable[[], Detector]) -> None:
    """``load`` makes a detector inside a worker."""
    _detectors[name] = load


def detect(frames: DataFrame, name: str) -> DataFrame:
    load = _detectors[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in batches:
            yield detector(batch)

    return frames.mapInPandas(run, DETECTION_COLUMNS)


def embed(rows: DataFrame, load: Callable[[], Callable[[list[bytes]], list]], image: str = "image", batch: int = 16) -> DataFrame:
    """Adds ``embedding``, made in batches; after one failure a worker gives nulls, as counting works without."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for images in batches:
            out: list = []
            for k in range(0, len(images), batch):
                part = list(images.iloc[k : k + batch])
                try:
                    out += model(part) if model is not None else [None] * len(part)
                except Exception:  # noqa: BLE001
                    model = None
                    out += [None] * len(part)
            yield pd.Series(out)

    return rows.withColumn("embedding", run(F.col(image)))


def providers(asked: str, available: list[str] | None = None) -> list[str]:
    """Where a model runs: on the graphics card if that is asked for and there, and always on the processor as the fallback."""
    if available is None:
        try:
            import onnxruntime

            available = onnxruntime.get_available_providers()
        except ImportError:
            available = []
    cuda, cpu = "CUDAExecutionProvider", "CPUExecutionProvider"
    if asked.lower() == "cuda":
        if cuda in available:
            return [cuda, cpu]
        logging.getLogger(__name__).warning("the CUDA provider was asked for but isn't available, so the processor is used")
    return [cpu]
