"""Quality scores from random Fourier features of document statistics.

Each document is measured (stats.py) and described by ratios. FEATURES random cosines
approximate a Gaussian kernel over them; tasks add up the normal equations of their own
rows, a matrix whose size is that of the features, and the sums of the partitions are solved
with a ridge. Scores of the training rows, counted in BINS bins, give the isotonic
calibration, so a score is the share of good documents among those that look as good.

At most MAX_LABELLED labelled rows are learnt from (a bounded sample by a hash of the id), in as
many tasks as learn.PARTS says, so that as many matrices are summed, however large the table.
Null and empty texts are scored like any text, from their statistics. Without labels of both
kinds every score is the share of good labels, or 0.5. Ids may be null or repeated; other
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.learn import PARTS, fold_of, isotonic, training_rows
from quire.llm.shared import cut
from quire.llm.stats import measure_all
from quire.llm.words import Texts, texts_of

FEATURES = 128
WIDTH = 1.5  # of the kernel, in standard deviations
RIDGE = 1e-2
BINS = 2000
MAX_LABELLED = 50_000
THRESHOLD = 0.3


def describe(texts: Texts) -> np.ndarray:
    """One row of ratios for each text."""
    m = {k: v.astype(np.float64) for k, v in measure_all(texts).items()}
    words, chars, line = np.maximum(m["n_words"], 1), np.maximum(m["n_chars"], 1), np.maximum(m["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(m["n_words"]) / 3,
            m["word_chars"] / words / 3,
            np.sqrt(m["n_symbols"] / words),
            np.sqrt(m["n_dup_lines"] / line),
            np.sqrt(m["n_repeat_words"] / words),
            np.sqrt(m["n_same_as_before"] / words),
            np.sqrt(m["n_caps_words"] / words),
            m["n_distinct_words"] / words,
            np.sqrt(m["n_upper"] / chars),
            np.sqrt(m["n_digits"] / chars),
            np.sqrt(m["n_stops"] / words),
            np.log1p(m["n_words"] / line) / 3,
        ]
    )


class Model:
    def __init__(self, inputs: int, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-6, spread, 1.0)
        self.turn = rng.normal(size=(inputs, FEATURES)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2.0 / FEATURES) * np.cos(z @ self.turn + self.shift), np.ones(len(rows))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.cosines(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.x, self.y) if len(rows) else np.zeros(0)


def fit(rows: DataFrame) -> Model:
    """rows: (text, y)."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    if rows.rdd.getNumPartitions() > PARTS:
        rows = rows.repartition(PARTS)
    described = cut(rows.mapInArrow(facts, "x array<double>, y double"))
    inputs = describe(Texts(np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1]
    first = described.agg(F.count("*").alias("n"), F.sum("y").alias("good"), *(f(F.col("x")[k]).alias(f"{name}{k}") for k in range(inputs) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not first.n:
        return Model(inputs, np.zeros(inputs), np.ones(inputs))
    model = Model(inputs, np.array([first[f"m{k}"] for k in range(inputs)]), np.array([first[f"s{k}"] for k in range(inputs)]))
    if first.good in (0, first.n):
        model.y = np.full(2, first.good / first.n)
        return model

    def unpack(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(0).flatten()).reshape(-1, inputs)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, rows = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            z = model.cosines(unpack(batch))
            left += z.T @ z
            right += z.T @ batch.column(1).to_numpy()
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["a", "b"])

    sums = described.mapInArrow(equations, "a binary, b binary").collect()  # one matrix of a fixed size for each of PARTS tasks
    left = sum(np.frombuffer(bytes(r.a)) for r in sums).reshape(FEATURES + 1, FEATURES + 1)
    right = sum(np.frombuffer(bytes(r.b)) for r in sums)
    model.weights = np.linalg.solve(left + RIDGE * np.eye(FEATURES + 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.clip(((model.raw(unpack(batch)) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(1)], names=["bin", "y"])

    bins = described.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()  # BINS rows at most
    model.x, model.y = isotonic(np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in bins]), np.array([r.n for r in bins], float), np.array([r.good for r in bins], float))
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(describe(texts_of(batch.column(1)))))], names=[key, "score"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(training_rows(df, labels, "quality", fold_of("doc_id", 5) != 0, "doc_id", "text", MAX_LABELLED))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(df, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
