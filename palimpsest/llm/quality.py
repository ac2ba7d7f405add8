"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile.

A document that is labelled good is preferred to one that is labelled bad. The probability that
``a`` beats ``b`` is modelled as ``sigmoid(w . (f(a) - f(b)))``; ``w`` is learned by logistic loss on
feature differences. The cut between accepted and rejected is the quantile of the training scores
that separates the labels best, and it is placed at ``CUT`` on the 0-to-1 scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import crc32_of, lean

CUT = 0.7
_MARKS = b"!%$*#&|.,;:?-_/\\()[]{}<>=+~^@\"'`"


def features(text: str | None) -> np.ndarray:
    """What a whole text looks like: shares of kinds of characters, of repeats and of odd words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    letters = max(1, counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum())
    words = data.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    w = max(1, len(words))
    ordered = np.sort(hashes)
    edges = np.flatnonzero(np.diff(ordered)) + 1
    runs = np.diff(np.concatenate(([0], edges, [len(words)]))) if len(words) else np.zeros(1)
    pairs = hashes[1:] * 31 + hashes[:-1]
    lines = data.split(b"\n")
    shares = np.array(
        [
            counts[65:91].sum() / letters, counts[48:58].sum() / n, counts[128:].sum() / n, counts[10] / n,
            *(counts[list(_MARKS)] / n), counts[list(_MARKS)].sum() / n,
            len(runs) / w, runs.max() / w, (hashes[1:] == hashes[:-1]).mean() if len(words) > 1 else 0.0,
            len(np.unique(pairs)) / max(1, len(pairs)), len(set(lines)) / len(lines),
        ]
    )
    sizes = np.log1p([len(words), len(data) / w, len(data) / len(lines), len(lines)])
    return np.concatenate((shares, np.sqrt(shares), np.minimum(1.0, 20 * shares), sizes))


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row, so that equal texts have equal scores wherever they stand.
        return (np.clip((x - self.centre) / self.scale, -8, 8) * self.weight).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def learn(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 40, seed: int = 7) -> Model:
    """Bradley-Terry fit on rows ``x`` with labels ``y`` (0 or 1); bounded by the rows it is given. ``pairs`` preferences
    are drawn from all pairs of a good and a bad row; the fit is by Newton steps until they no longer move."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.0, 1.0 if len(good) or not len(bad) else 0.0)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    good, bad = (np.clip((part - centre) / scale, -8, 8) for part in (good, bad))
    rng = np.random.default_rng(seed)
    one, other = rng.integers(len(good), size=pairs), rng.integers(len(bad), size=pairs)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for k in range(0, pairs, 4096):  # differences are made when needed, a block at a time
            d = good[one[k : k + 4096]] - bad[other[k : k + 4096]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient += d.T @ (p - 1) / pairs
            hessian += (d.T * (p * (1 - p))) @ d / pairs
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    raw = np.concatenate((bad @ w, good @ w))
    label = np.concatenate((np.zeros(len(bad)), np.ones(len(good))))
    order = np.argsort(raw, kind="stable")
    raw, label = raw[order], label[order]
    # Errors if the cut lies before each rank: rejected good ones plus accepted bad ones. Of equal ranks the middle.
    errors = np.concatenate(([0], np.cumsum(label))) + (len(bad) - np.concatenate(([0], np.cumsum(1 - label))))
    at = np.flatnonzero(errors == errors.min())
    quantile = int(at[len(at) // 2])
    cut = (raw[max(quantile - 1, 0)] + raw[min(quantile, len(raw) - 1)]) / 2
    return Model(centre, scale, w, float(cut))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> Model:
    """Learn from at most ``train_rows`` labelled rows (those of the smallest hash of doc_id, so no part of
    the table is preferred), none of them with crc32(doc_id) mod 4 = 2. Labels other than 0 and 1 are
    ignored. The bound makes it safe to broadcast the labels and to collect the features."""
    known = (
        labels.where("quality in (0, 1) and doc_id is not null").where(F.pmod(crc32_of(F.col("doc_id")), F.lit(4)) != 2)
        .groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(train_rows)
    )
    width = len(features(""))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "quality": b["quality"], "x": [features(t).tobytes() for t in b["text"]]})

    found = (
        docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "id").mapInPandas(lean(rows), "id long, quality int, x binary")
        .orderBy(F.xxhash64("id"), "id", "x").limit(train_rows).toPandas()
    )
    x = np.frombuffer(b"".join(map(bytes, found["x"])), float).reshape(-1, width)
    return learn(x, found["quality"].to_numpy(int))


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Add the score of every row's whole text as ``column``; nothing is shuffled.

    Null and empty text are scored as an empty text. Further columns, repeated rows and null ids are
    carried through; a column that is already called ``column`` is replaced.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, column])

    plain = docs.drop(column)
    return plain.mapInArrow(lean(add), T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Without any bad example every score is 1, without any good one 0. Labels, lang, source and doc_id
    are never inputs of a score. Repeated rows are each scored, and those of one doc_id are each an example of its label; a
    null doc_id gives a null held_out. An empty table gives an empty result. A very long text is one row, read whole.
    Further columns, whatever their names, are ignored.
    """
    model = fit(docs, labels, train_rows)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hold", F.pmod(crc32_of(F.col("doc_id")), F.lit(4)) == 2), model)
    return scored.select("doc_id", F.col("hold").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
