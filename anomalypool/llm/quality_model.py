"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_stats
from .common import byte_list, materialise, per_batch
from .text_stats import COUNTS, RATIOS

MAX_LABELLED = 20_000  # labelled texts to fit on, at most
FEATURES, BANDWIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 42
SUMS = 16  # partitions whose sums come to the driver, at most
CLIP = 6.0


def statistics(counts: np.ndarray) -> np.ndarray:
    """Document statistics: the ratios, and logarithms of size and of the rarer counts."""
    return np.concatenate([text_stats.ratio_matrix(counts), np.log1p(counts.astype(float))], axis=1)


N_STATISTICS = len(RATIOS) + len(COUNTS)


@dataclass
class Kernel:
    """Cosines whose inner products approximate a Gaussian kernel on standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.directions = rng.normal(size=(N_STATISTICS, FEATURES)) / (BANDWIDTH * np.sqrt(N_STATISTICS / 4))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))], axis=1)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and the calibrated value of each, with half a count of either label added to a block."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(scores[order], labels[order]):
        blocks.append([float(y), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, n1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2] + s1]
    at = np.array([b[2] / b[1] for b in blocks])
    value = np.maximum.accumulate([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    return at, value


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the ridge score: mostly the calibrated value, with a trace of the ridge score that keeps order within flat parts."""
        raw = self.kernel(statistics(counts)) @ self.weights
        return np.clip(0.98 * np.interp(raw, self.at, self.value) + 0.02 * np.clip((raw + 1) / 3, 0, 1), 0.0, 1.0)


def _normal_equations(sample: DataFrame, kernel: Kernel) -> np.ndarray:
    """Sums over two folds of Z'Z with Z'y as its last column, shape (2, d, d + 1): each partition sums its own rows, the driver adds at most SUMS of them."""
    d = FEATURES + 1

    def add(batches):
        total, any_rows = np.zeros((2, d, d + 1)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows = True
            x, y, fold = _arrays(batch)
            z = kernel(statistics(x))
            for k in (0, 1):
                zk = z[fold == k]
                total[k] += zk.T @ np.concatenate([zk, y[fold == k, None]], axis=1)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = sample.coalesce(SUMS).mapInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(p["sums"]).reshape(2, d, d + 1) for p in parts), np.zeros((2, d, d + 1)))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], axis=1)
    return counts, batch.column(len(COUNTS)).to_numpy(zero_copy_only=False).astype(float), batch.column(len(COUNTS) + 1).to_numpy(zero_copy_only=False)


def _solve(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:, :-1], sums[:, -1]
    return np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(len(a)), b)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_LABELLED) -> Model | None:
    """A model of P(label = 1), from at most bound labelled texts whose row of labels is usable (a condition on `_lid`, the id).

    Each of two folds is scored by the ridge of the other to calibrate. None without labelled rows.
    """
    sample = text_stats.labelled_counts(docs, labels, label, bound, id_col, text_col, usable)
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(2)).cast("int").alias("_fold")
    sample = materialise(sample.select("_counts.*", F.col("_label").cast("double").alias("_label"), fold).repartition(SUMS), "quality-sample")
    rows = sample.toPandas()  # bound rows at most
    if rows.empty:
        return None
    counts, y, folds = rows[list(COUNTS)].to_numpy(), rows["_label"].to_numpy(), rows["_fold"].to_numpy()
    x = statistics(counts)
    scale = x.std(axis=0)
    kernel = Kernel(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    sums = _normal_equations(sample, kernel)
    raw = np.zeros(len(y))
    for k in (0, 1):
        if (folds == k).any():
            raw[folds == k] = kernel(x[folds == k]) @ _solve(sums[1 - k])
    return Model(kernel, _solve(sums.sum(axis=0)), *isotonic(raw, y))


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: one row per row of docs. Null texts count as empty and have a score, as has every text; without a model all scores are 0.5."""
    rows = docs.select(F.col(id_col), F.col(text_col))

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        counts = np.array([text_stats.text_counts(b) for b in byte_list(batch.column(1))], dtype=np.int64)
        score = model.score(counts) if model is not None else np.full(len(counts), 0.5)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    return rows.mapInArrow(per_batch(lambda: step), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")
