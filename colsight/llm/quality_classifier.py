"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.quality_rules import STOP_WORDS
from colsight.llm.shared import broadcast_if_small, quoted, stored

STATISTICS, FEATURES, WIDTH, RIDGE, SEED = 16, 256, 4.0, 1.0, 42
FOLDS, HELD_OUT, CALIBRATION, THRESHOLD = 5, 0, 1, 0.3
_STOPS = tuple(w.encode() for w in STOP_WORDS)


def statistics(text: str | None) -> np.ndarray:
    """``STATISTICS`` numbers about a whole text; all are defined for an empty one."""
    data = (text or "").encode()
    size = max(1, len(data))
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    tokens = data.split()
    n = max(1, len(tokens))
    counts = Counter(tokens)
    lines = [line for line in data.split(b"\n") if line.strip()]
    upper, lower, digits = of[65:91].sum(), of[97:123].sum(), of[48:58].sum()
    white = of[9:14].sum() + of[32]
    letters = [len(w) for w in counts]
    pairs = len(set(zip(tokens, tokens[1:], strict=False)))
    return np.array(
        [
            np.log1p(len(tokens)),
            (size - white) / n,
            upper / size,
            lower / size,
            digits / size,
            of[128:].sum() / size,
            white / size,
            (of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) / size,
            of[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / n,
            of[33] / n,
            sum(counts[w] for w in _STOPS) / n,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            pairs / n,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(max(letters, default=0)),
        ]
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.list_(pa.float64()))], names=["id", "x"])


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the statistics ``x`` of each document."""
    columns = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    return columns.mapInArrow(_measure, f"id {columns.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the Fourier features: a row for each statistic
    phases: np.ndarray
    ridge: np.ndarray
    raw: np.ndarray  # calibration: raw values and their probabilities, both rising
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose products average to a Gaussian kernel, and a constant."""
        waves = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phases)
        return np.hstack([waves * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.round(self.features(x) @ self.ridge, 4), -1, 2) if len(self.ridge) else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_score(x), self.raw, self.probability) if len(self.raw) else np.full(len(x), 0.5)


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """``of(x, y)``, a matrix with ``width`` columns, summed in each partition and then over all of them.

    The sums over partitions are taken by Spark, entry by entry; only the total comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(np.stack(batch.column("x").to_numpy(zero_copy_only=False)), batch.column("y").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["at", "part"])

    sums = rows.select("x", "y").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).toPandas()
    flat = np.zeros(0 if sums.empty else int(sums["at"].max()) + 1)
    flat[sums["at"].to_numpy()] = sums["total"]
    return flat.reshape(-1, width)


def pool_adjacent(raw: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: rising means of ``labels / counts`` at the mean ``raw`` value of each pooled block."""
    blocks: list[list[float]] = []
    for x, y, n in zip(raw, labels, counts, strict=True):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x2, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fold(identity: Column) -> Column:
    return (F.crc32(identity.cast("string").cast("binary")) % FOLDS).cast("int")


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fits stored rows ``x, y, fold``: all folds but one give the ridge weights, fold ``CALIBRATION`` calibrates.

    What comes to the driver has the size of the model: moments, one matrix, and counts by rounded score.
    """
    rng = np.random.default_rng(seed)
    fitting, holding = rows.where(F.col("fold") != CALIBRATION), rows.where(F.col("fold") == CALIBRATION)
    moments = _summed(fitting, lambda x, _: np.vstack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))]), STATISTICS)
    none = np.zeros(0)
    if not moments.size:
        return Model(none, none, none, none, none, none, none)
    mean = moments[0] / moments[2]
    deviation = np.sqrt(np.maximum(moments[1] / moments[2] - mean * mean, 0))
    scale = np.where(deviation > 1e-9, deviation, 1.0)
    waves, phases = rng.normal(0, 1 / width, (STATISTICS, features)), rng.uniform(0, 2 * np.pi, features)
    plain = Model(mean, scale, waves, phases, none, none, none)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = plain.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    equations = _summed(fitting, normal, features + 2)
    solved = np.linalg.solve(equations[:, :-1] + ridge * np.eye(features + 1), equations[:, -1])
    fitted = Model(mean, scale, waves, phases, solved, none, none)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = fitted.raw_score(np.stack(batch.column("x").to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], names=["raw", "y"])

    held = holding.select("x", "y").mapInArrow(scored, "raw double, y double")
    by_raw = held.groupBy("raw").agg(F.sum("y").alias("labels"), F.count("*").alias("n")).toPandas().sort_values("raw")
    raw, probability = pool_adjacent(by_raw["raw"].to_numpy(), by_raw["labels"].to_numpy(float), by_raw["n"].to_numpy(float))
    return Model(mean, scale, waves, phases, solved, raw, probability)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Scores depend on the text alone. Labels (0 or 1; null ones are left out, several for one id all count) are
    learnt from ids whose ``crc32`` modulo 5 is not 0; documents of the others are held out. A null text counts as
    empty; a null id is never learnt from and has ``held_out`` null. Without labels to learn from, scores are 0.5.
    """
    stats = stored(measured(docs, id_column, text))
    known = labels.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(label)).cast("double").alias("y"), fold(F.col(quoted(id_column))).alias("fold"))
    known = stored(known.where(F.col("y").isNotNull() & (F.col("fold") != HELD_OUT)))
    model = fit(stored(stats.join(broadcast_if_small(known, 24), "id").select("x", "y", "fold")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = model.score(np.stack(batch.column("x").to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values)], names=["id", "score"])

    done = stats.mapInArrow(scored, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return done.select(F.col("id").alias(id_column), (fold(F.col("id")) == HELD_OUT).alias("held_out"), "score", predicted)
