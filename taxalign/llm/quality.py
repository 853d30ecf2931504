"""Ordinal quality classifier: a cumulative-link regression over hashed text.

Words of the whole text fall into ``BUCKETS`` hash buckets.  One weight per bucket, shared
by all grades, gives a text's value ``f``; ordered thresholds give ``P(grade <= k) =
sigmoid(theta_k - f)``.  Thresholds are a first one and logarithms of the gaps, so their
order can't be lost.  Selection uses the expected grade, or the probability of the tail.

*Training.*  At most ``SAMPLE`` rated rows, least hashes of the key first.  They are dealt
over ``PARTS`` tasks by key; in each round every task starts from the shared weights, runs
``EPOCHS`` passes over its rows, and weights are averaged by rows.  What comes back is one
vector of weights per task.

Defined results: null and empty texts have no words and the value 0; ratings without a
grade, and ratings of rows that are absent, teach nothing; of several ratings of a key the
lowest grade counts; without any rating all grades are equally likely; repeated rows give a
row each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow, steps, utf8
from taxalign.llm.hashing import row_hash
from taxalign.llm.tables import drop, write
from taxalign.llm.words import word_hashes

BUCKETS = 1 << 18
SAMPLE, PARTS = 20_000, 8
ROUNDS, EPOCHS, BATCH = 5, 4, 64
RATE, DECAY = 0.4, 1e-5


def features(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, buckets, values) of the texts of a batch, rows laid end to end."""
    raw, begins = utf8(batch.column(column))
    hashes, texts = word_hashes(raw, begins)
    cells, counts = np.unique(texts * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    rows = cells // BUCKETS
    values = 1.0 + np.log(counts)
    size = np.bincount(rows, minlength=batch.num_rows)
    # longer texts count less per word, yet not so little that one telling word is lost
    values /= np.maximum(size[rows], 1) ** 0.25
    return np.searchsorted(rows, np.arange(batch.num_rows + 1)), cells % BUCKETS, values


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def thresholds(t: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def above(f: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(grade > k) for each value (row) and each threshold (column)."""
    return sigmoid(f[:, None] - thresholds(t)[None, :])


def gradient(f: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the summed negative log-likelihood by each value and by ``t``."""
    theta, k = thresholds(t), len(t)
    upper = np.where(y < k, sigmoid(theta[np.minimum(y, k - 1)] - f), 1.0)
    lower = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - f), 0.0)
    p = np.maximum(upper - lower, 1e-12)
    by_theta = np.bincount(np.minimum(y, k - 1), np.where(y < k, -upper * (1 - upper) / p, 0.0), k)
    by_theta += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, lower * (1 - lower) / p, 0.0), k)
    later = np.cumsum(by_theta[::-1])[::-1]
    return 1.0 - upper - lower, later * np.concatenate([[1.0], np.exp(t[1:])])


def _passes(w: np.ndarray, t: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``EPOCHS`` passes of gradient steps scaled by their running size (Adagrad)."""
    w, t = w.copy(), t.copy()
    seen_w, seen_t = np.full(len(w), 1e-2), np.full(len(t), 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = shuffled[at:at + BATCH]
            cells, values = (np.concatenate([rows[i][c] for i in some]) for c in (0, 1))
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            f = np.bincount(owner, w[cells] * values, len(some))
            by_f, by_t = gradient(f, y[some], t)
            g = np.bincount(cells, by_f[owner] * values, len(w)) / len(some) + DECAY * w
            by_t = by_t / len(some)
            seen_w += g * g
            seen_t += by_t * by_t
            w -= RATE * g / np.sqrt(seen_w)
            t -= RATE * by_t / np.sqrt(seen_t)
    return w, t


def learn(df: DataFrame, ratings: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the buckets, and the parameters of ``n_grades - 1`` thresholds."""
    k = n_grades - 1
    w, t = np.zeros(BUCKETS), np.concatenate([[-np.log(k)], np.log(np.diff([np.log(j / (n_grades - j)) for j in range(1, n_grades)]))]) if k > 1 else np.zeros(1)
    rated = ratings.where(F.col(f"`{grade}`").between(0, k) & F.col(f"`{key}`").isNotNull())
    rated = rated.groupBy(F.col(f"`{key}`").alias("_rated")).agg(F.min(F.col(f"`{grade}`")).cast("int").alias("grade"))
    rated = rated.withColumn("hash", row_hash("_rated")).orderBy("hash").limit(sample)
    texts = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text"))
    # the sample has ``sample`` rows of three numbers at most
    joined = texts.join(F.broadcast(rated), F.col("_key") == F.col("_rated")).select("hash", "grade", "text")

    def vectors(batches):
        for batch in steps(batches, 2):
            begins, cells, values = features(batch, 2)
            lists = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(c)) for c in (cells.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["hash", "grade", "cells", "weights"])

    rows = write(map_arrow(joined, vectors, "hash long, grade int, cells array<int>, weights array<double>").withColumn("part", F.col("hash") % PARTS), "rated")
    for turn in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast((w, t))

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("grade", "ascending")])
            found = [(np.array(c.values), np.array(v.values)) for c, v in zip(table.column("cells"), table.column("weights"))]
            part = int(table.column("part")[0].as_py())
            new_w, new_t = _passes(*shared.value, found, table.column("grade").to_numpy(), turn * PARTS + part)
            return pa.table({"n": pa.array([len(found)], pa.int64()), "w": pa.array([new_w.tobytes()], pa.binary()), "t": pa.array([new_t.tobytes()], pa.binary())})

        parts = rows.groupBy("part").applyInArrow(train, "n long, w binary, t binary").collect()  # PARTS rows
        shared.unpersist()
        if not parts:
            break
        parts.sort(key=lambda r: bytes(r["w"]))
        n = sum(r["n"] for r in parts)
        w, t = (sum(r["n"] / n * np.frombuffer(r[c], np.float64) for r in parts) for c in ("w", "t"))
    drop(rows)
    return w, t


def graded(df: DataFrame, ratings: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade",
           tail: int | None = None, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``key``, expected_grade, tail_prob (of grade ``tail`` or more, the top one by default) and kept."""
    w, t = learn(df, ratings, n_grades, key, text, grade, sample)
    shared = df.sparkSession.sparkContext.broadcast((w, t))
    at = (n_grades - 1 if tail is None else tail) - 1

    def run(batches):
        weights, params = shared.value
        for batch in steps(batches, 1):
            begins, cells, values = features(batch, 1)
            sums = np.concatenate([[0.0], np.cumsum(weights[cells] * values)])
            p = above(sums[begins[1:]] - sums[begins[:-1]], params)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, at]), pa.array(p[:, at] >= least)], ["key", "expected_grade", "tail_prob", "kept"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_arrow(rows, run, f"key {df.schema[key].dataType.simpleString()}, expected_grade double, tail_prob double, kept boolean").withColumnRenamed("key", key)
