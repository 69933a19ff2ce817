"""What the two classifiers share: the labelled sample and a logistic fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, shingle_sets

#: Labelled rows that a classifier is fitted on at most: those whose hashed ids are smallest.
SAMPLE_ROWS = 20_000


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most `rows` labelled documents that `train` allows.

    A document labelled twice has its larger label; null labels are none. The join's
    small side holds at most `rows` ids, so it is broadcast.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = own.where(train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def without_copies(sample: DataFrame, sketches: int = 3) -> DataFrame:
    """One row (smallest doc_id) of each group of sampled rows that share a min-hash of their shingles.

    Copies of one text would otherwise count as many witnesses. sample: doc_id, label, text;
    it is a bounded sample, so its groups are bounded too.
    """
    names = [f"sketch{k}" for k in range(sketches)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.zeros((sketches, b.num_rows), np.uint64)
            for i, found in shingle_sets(b["text"]):
                for k in range(sketches):
                    low[k, i] = mix(found + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min() if len(found) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x.view(np.int64)) for x in low]], [*b.schema.names, *names])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sample.schema)
    found = sample.mapInArrow(run, f"{own}, {', '.join(f'{n} long' for n in names)}")
    for n in names:
        first = F.row_number().over(Window.partitionBy(n).orderBy("doc_id"))
        found = found.withColumn("place", first).where("place = 1").drop("place")
    return found.drop(*names)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of y (0 to 1) on x, by Newton's method on standardised x."""
    if len(x) == 0:
        return 0.0, 0.0
    centre, scale = float(np.mean(x)), float(np.std(x)) or 1.0
    z = np.stack([(x - centre) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    hold = np.array([ridge, ridge])
    for _ in range(steps):
        p = sigmoid(z @ w)
        gradient = z.T @ (p - y) + hold * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)
