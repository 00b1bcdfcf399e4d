"""Scoring by batches: any function of arrays, run over Arrow batches. The networks here are forward passes only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Scorer = Callable[[np.ndarray], np.ndarray]


def score_batches(df: DataFrame, item: str, features: str, scorer: Scorer) -> DataFrame:
    """``item, score``: the scorer gets a matrix for each batch. Rows without features have a null score; nulls and NaNs inside count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.array([0 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
            width = int(lengths.max(initial=0))
            out = np.full(batch.num_rows, np.nan)
            whole = np.flatnonzero(lengths == width) if width else np.empty(0, np.int64)
            if len(whole):
                flat = lists.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float)
                out[whole] = scorer(np.nan_to_num(flat.reshape(len(whole), width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=np.isnan(out))], names=[item, "score"])

    return df.select(item, features).mapInArrow(run, f"`{item}` {dict(df.dtypes)[item]}, score double")


def logistic_mean(x: np.ndarray) -> np.ndarray:
    """Sigmoid of the mean: the scorer used where no model is given."""
    return 1 / (1 + np.exp(-x.mean(1)))


def perceptron(layers: list[tuple[np.ndarray, np.ndarray]]) -> Scorer:
    """Dense layers with rectifiers between, a sigmoid behind."""

    def run(x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            if k + 1 < len(layers):
                x = np.maximum(x, 0)
        return 1 / (1 + np.exp(-x[:, 0]))

    return run


def attend(centre: np.ndarray, around: np.ndarray, distance: np.ndarray, scale: float = 1.0, far: float = 1e6) -> np.ndarray:
    """Distance-biased attention of each centre over its neighbours; without valid neighbours, the centre itself."""
    valid = np.isfinite(distance) & (distance < far)
    logits = np.einsum("nd,nkd->nk", centre, around) / np.sqrt(centre.shape[1]) - scale * np.where(valid, distance, 0.0)
    logits = np.where(valid, logits, -np.inf)
    top = np.where(valid.any(1), logits.max(1, where=valid, initial=-np.inf), 0.0)
    w = np.where(valid, np.exp(logits - top[:, None]), 0.0)
    total = w.sum(1, keepdims=True)
    mixed = np.einsum("nk,nkd->nd", w / np.where(total == 0, 1, total), around)
    return np.where(total > 0, mixed, centre)


def blend(centre: np.ndarray, context: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Gated mean of a vector and its context; the gate is a logit for each row."""
    g = 1 / (1 + np.exp(-gate))[:, None]
    return g * centre + (1 - g) * context
