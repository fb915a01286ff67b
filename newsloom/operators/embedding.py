"""Where a model comes in: texts are embedded in sub-batches by a callable that is shipped to the workers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What stands before a text that is stored and one that is asked.
PASSAGE, QUERY = "passage: ", "query: "
#: Texts and characters of a request, attempts at it, and seconds before the second of them; each later wait is twice as long.
REQUEST, BUDGET, ATTEMPTS, WAIT_S = 64, 200_000, 6, 0.2

#: Takes texts; gives token vectors (texts x tokens x size), their mask (texts x tokens) and the model's version.
Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray, str]]


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the tokens that the mask keeps, at unit length; a text without tokens is all 0."""
    m = mask[:, :, None].astype(np.float64)
    mean = (tokens * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1.0)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1)[:, None], 1e-12)).astype(np.float32)


def requests(texts: list[str], most: int = REQUEST, budget: int = BUDGET) -> Iterator[slice]:
    """Neighbouring texts that go together: at most ``most``, of at most ``budget`` characters unless one alone has more."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most or size + len(t) > budget):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def tried(call: Callable[[], tuple], attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> tuple:
    for i in range(attempts):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if i == attempts - 1:
                raise
            time.sleep(wait_s * 2**i)
    raise ValueError("no attempt allowed")


def embed(rows: DataFrame, key: str, text: str, model: Model, prefix: str = PASSAGE, most: int = REQUEST, budget: int = BUDGET, attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> DataFrame:
    """``key``, ``vector``, ``model_version`` in the order of the rows of each partition.

    A null text counts as empty. A request that fails for want of a connection
    is tried again; a model that changes its version within a partition is
    refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: str | None = None
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            vectors: list[np.ndarray] = []
            for s in requests(texts, most, budget):
                tokens, mask, version = tried(lambda s=s: model(texts[s]), attempts, wait_s)
                if known not in (None, version):
                    raise RuntimeError(f"the model changed from {known} to {version}")
                known = version
                vectors.extend(pooled(np.asarray(tokens), np.asarray(mask)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), pa.array([known] * len(texts), pa.string())], names=[key, "vector", "model_version"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<float>, model_version string")


def means_path(model_version: str, folder: str = "config/centering") -> str:
    """Where the frozen means of a model's version lie: other characters than letters, digits and dots become dashes."""
    return f"{folder}/" + "".join(c if c.isascii() and (c.isalnum() or c == ".") else "-" for c in model_version) + ".json"
