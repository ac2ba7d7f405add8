"""Exact top-k search over binary codes by incremental multi-index hashing.

The codes are dealt to shards, and a shard's index cuts each code into as many segments as make a segment
about as wide as the logarithm of the shard's size, with a table of rows per segment value. If two codes
differ in fewer than segments * r + j bits, one of the first j segments differs in at most r bits or one of
the others in at most r - 1. So once the values within radius r of a query's have been looked up in the
first j tables, and within r - 1 in the others, all that is nearer than segments * r + j has been verified.
Radii grow, segment by segment, until the kth verified distance is below that. The shards' answers, each
exact, are merged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, materialize

WORD = 32


def codes(vectors: DataFrame, bits: int) -> DataFrame:
    """vec_id and w0..: the signs of the first ``bits`` components, in words of 32 bits. A row whose id or
    embedding is null, has another length or holds a null or NaN has no code and is left out."""
    e = F.col("embedding")
    ok = vectors.where(F.col("vec_id").isNotNull() & (F.size(e) == bits) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)))
    zero = F.lit(0).cast("long")
    cut = lambda j: F.aggregate(F.slice(e, j * WORD + 1, min(WORD, bits - j * WORD)), zero, lambda a, x: F.shiftleft(a, 1) + F.when(x >= 0, 1).otherwise(0))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), *(cut(j).alias(f"w{j}") for j in range(-(-bits // WORD))))


@dataclass
class Index:
    """Segment tables over the rows of ``words`` (one code a row, 32 bits a column)."""

    words: np.ndarray
    bits: int
    segments: int | None = None
    #: Of the rows that were verified, those that a table led to, and those that were cheaper to verify outright.
    probed: int = 0
    direct: int = 0
    tables: list = field(default_factory=list)

    def __post_init__(self) -> None:
        n = len(self.words)
        want = self.segments or round(self.bits / max(1.0, log2(max(n, 2))))
        self.segments = min(self.bits, max(1, want, -(-self.bits // 20)))  # a table has 2 ** 20 entries at most
        ends = np.linspace(0, self.bits, self.segments + 1).astype(int)
        self.spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        for values, (lo, hi) in zip(self.values(self.words), self.spans, strict=True):
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << hi - lo) + 1))
            self.tables.append((order, starts))

    def values(self, words: np.ndarray) -> list[np.ndarray]:
        """The value of each segment of each code."""
        on = (words[:, :, None] >> np.arange(WORD, dtype=np.int64)) & 1
        on = on.reshape(len(words), WORD * words.shape[1])
        return [on[:, lo:hi] @ (1 << np.arange(hi - lo, dtype=np.int64)) for lo, hi in self.spans]

    def near(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << b for b in on) for on in combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def search(self, word: np.ndarray, values: list[int], k: int, probe_limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes that are no farther than the kth nearest, and maybe some more."""
        n = len(self.words)
        unseen = np.ones(n, bool)
        rows, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        upto = np.zeros(self.bits + 2, np.int64)  # verified rows by distance

        def verify(at: np.ndarray) -> None:
            unseen[at] = False
            d = np.bitwise_count(self.words[at] ^ word).sum(1, dtype=np.int64)
            rows.append(at), far.append(d)
            upto[: self.bits + 1] += np.bincount(d, minlength=self.bits + 1)

        left = n
        for radius in range(max(hi - lo for lo, hi in self.spans) + 1):
            for j, ((lo, hi), (order, starts)) in enumerate(zip(self.spans, self.tables, strict=True)):
                # Everything nearer than this has been verified.
                if left == 0 or upto[: self.segments * radius + j].sum() >= k:
                    return np.concatenate(rows), np.concatenate(far)
                probes = comb(hi - lo, radius)
                if probes >= left or (probe_limit is not None and probes > probe_limit):
                    self.direct += left
                    verify(np.flatnonzero(unseen))
                    return np.concatenate(rows), np.concatenate(far)
                at = values[j] ^ self.near(hi - lo, radius)
                first, size = starts[at], starts[at + 1] - starts[at]
                some = size > 0
                first, size = first[some], size[some]
                if len(size):
                    before = np.cumsum(size) - size
                    met = order[np.arange(size.sum()) + np.repeat(first - before, size)]
                    met = met[unseen[met]]
                    verify(met)
                    self.probed += len(met)
                    left -= len(met)
        return np.concatenate(rows), np.concatenate(far)


def nearest(index: Index, ids: np.ndarray, asked: np.ndarray, k: int, probe_limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code of ``asked`` the ``k`` nearest rows of the index, ties by id: position in ``asked``, id, distance."""
    of, found, far = [], [], []
    values = np.stack(index.values(asked), 1).tolist() if len(asked) else []
    for i, word in enumerate(asked):
        rows, d = index.search(word, values[i], k, probe_limit)
        if len(d) > k:
            keep = d <= np.partition(d, k - 1)[k - 1]
            rows, d = rows[keep], d[keep]
        best = np.lexsort((ids[rows], d))[:k]
        of.append(np.full(len(best), i)), found.append(ids[rows[best]]), far.append(d[best])
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (of, found, far))  # type: ignore[return-value]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, chunks: int | None = None, probe_limit: int | None = None, shard: int = 1 << 16, block: int = 1 << 16) -> DataFrame:
    """query_id, neighbour_id, distance, rank (1 to k): the k nearest other rows by Hamming distance, ties by id.

    Exact. A row without a code (see ``codes``) is neither asked for nor found; a query with fewer than k other
    rows has them all; an empty table on either side gives no rows. Repeated rows of an id and code count
    once, and so do queries; an id with several codes is searched with each and ranked by its nearest. Of a code
    that very many rows share, the k + 1 smallest ids are enough, and the others are left out within each task
    before the shuffle. Further columns are ignored.

    ``chunks`` sets the number of segments, else that of rows does. Rows that are left are verified outright where
    a table would need more probes than they are many, or more than ``probe_limit``. A task holds ``shard`` codes of the
    index and ``block`` queries; every block of queries meets every shard.
    """
    ws = [f"w{j}" for j in range(-(-bits // WORD))]
    spark = vectors.sparkSession
    once = lambda x: codes(x, bits).groupBy("vec_id").agg(F.min(F.struct(*ws)).alias("w")).select("vec_id", "w.*")
    asked = materialize(once(queries), "asked")
    by_code = Window.partitionBy(*ws).orderBy("vec_id")
    rows = once(vectors).withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k + 1)
    rows = materialize(rows.select(*ws, "vec_id"), "codes")
    total = rows.count()
    # As many shards as the session has partitions, unless they would hold less than 2,048 codes.
    wide = max(1, -(-total // shard), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 11))
    distinct = asked.select(*ws).distinct()
    blocks = max(1, -(-asked.count() // block))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index, ask = Index(left[ws].to_numpy(np.int64), bits, chunks), right[ws].to_numpy(np.int64)
        of, ids, far = nearest(index, left["vec_id"].to_numpy(np.int64), ask, k + 1, probe_limit)
        return pd.DataFrame({**{w: ask[of, j] for j, w in enumerate(ws)}, "other": ids, "d": far})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.withColumn("shard", F.pmod(F.xxhash64(*ws, "vec_id"), F.lit(wide)).cast("int")).select("*", every(blocks).alias("block"))
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64(*ws), F.lit(blocks)).cast("int")).select("*", every(wide).alias("shard"))
    schema = ", ".join([*(f"{w} long" for w in ws), "other long", "d long"])
    # A number of partitions that is asked for is kept; small shards would otherwise be put into one task.
    left, right = (x.repartition(2 * wide * blocks, "shard", "block").groupBy("shard", "block") for x in (index, dealt))
    met = left.cogroup(right).applyInPandas(search, schema)
    # A code's k + 1 nearest rows hold the k nearest others of every query with that code.
    by_near = Window.partitionBy(*ws).orderBy("d", "other")
    met = materialize(met.withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= k + 1).drop("r"), "nearest")
    discard(rows)
    pairs = asked.join(met.hint("merge"), ws).where("other <> vec_id")
    order = Window.partitionBy("vec_id").orderBy("d", "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), F.col("other").alias("neighbour_id"), F.col("d").cast("int").alias("distance"), "rank")
