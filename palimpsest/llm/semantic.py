"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are rows of a TF-IDF matrix over the words of the benchmark. A randomised
singular value decomposition is computed in one distributed pass: with a random test matrix W each
task adds up C'(C W) over its passages' counts C, and the document frequencies; their sums give
the leading right singular vectors (Nystroem). Windows of every document and the benchmark items are
folded into that latent space; windows of high cosine are candidates, and a candidate counts if the
longest common subsequence of words, or a shorter one that holds the item's answer, confirms it.
Windows that no check could confirm are not folded: what holds 0.6 of an item's words holds a known number
of its rarest ones, so places without so many of any item's are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import lean, materialize

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EDGE = b".,;:!?\"'()[]{}<>*-_#%$&|"
SIZES = (16, 24, 36, 54, 80)


def _sizes(longest: int) -> list[int]:
    """Widths of windows: SIZES, and on by half until the longest item's length is near one."""
    out = list(SIZES)
    while out[-1] < longest:
        out.append(out[-1] * 3 // 2)
    return out


class _Tokens(dict):
    """Word to the column of its normal form (A-Z lower-cased, marks at its ends dropped), -1 if that is not a
    word of the benchmark, -2 if nothing is left of it; bounded."""

    def __init__(self, columns: dict[bytes, int], most: int = 500_000):
        self.columns, self.most = columns, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        normal = word.strip(_EDGE)
        self[word] = out = self.columns.get(normal, -1) if normal else -2
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Columns of a whole text's words, those without letters left out."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        t = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return t[t > -2]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = where.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Items:
    """The benchmark: token columns of every item, and of its answer (the words after the last full stop
    but the closing one; at most the last third)."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        normal = [(i, [w.strip(_EDGE) for w in _words(t)], _words(t)) for i, t in rows]
        normal = [(i, [w for w in n if w], raw) for i, n, raw in normal]
        normal = [x for x in normal if x[1]]
        self.columns: dict[bytes, int] = {}
        for _, words, _ in normal:
            for w in words:
                self.columns.setdefault(w, len(self.columns))
        self.ids = np.array([i for i, _, _ in normal], np.int64)
        self.tokens = [np.array([self.columns[w] for w in words], np.int64) for _, words, _ in normal]
        self.answers = []
        for tokens, (_, _, raw) in zip(self.tokens, normal, strict=True):
            stops = [k for k, w in enumerate(raw[:-1]) if w.endswith((b".", b"?", b":"))]
            most = max(1, len(tokens) // 3)
            self.answers.append(tokens[-min(most, len(raw) - 1 - stops[-1] if stops else most) :])
        self.sizes = _sizes(max(map(len, self.tokens), default=0))
        self.kind = np.array([int(np.argmin([abs(np.log(len(t) / s)) for s in self.sizes])) for t in self.tokens], np.int64)


def _passage_sums(items: Items, rank: int, passage: int, seed: int):
    """Per task: C'(C W), document frequencies and the number of passages, in rows of (column, values), and a row
    per text with a doc_id: its tokens, so that no later step has to make them again."""
    columns, width = items.columns, len(items.columns)
    test = np.random.default_rng(seed).standard_normal((width, rank)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Tokens(columns)
        y, df, n = np.zeros((width, rank)), np.zeros(width), 0

        def add(cols: np.ndarray, rows: np.ndarray) -> None:
            """cols: tokens, rows: their passages, ascending from 0."""
            starts = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1))
            sums = np.add.reduceat(test[cols], starts, axis=0)
            of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(rows)]))))
            order = np.argsort(cols, kind="stable")
            c, at = cols[order], of[order]
            first = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
            y[c[first]] += np.add.reduceat(sums[at], first, axis=0)
            new = np.concatenate(([True], (c[1:] != c[:-1]) | (at[1:] != at[:-1])))
            df[:] += np.bincount(c[new], minlength=width)

        cols, rows, held = [], [], 0
        for batch in batches:
            texts = []
            for text in batch.column(1).to_pylist():
                t = memo.of(text)
                texts.append(t.astype(np.int32).tobytes())
                at = np.flatnonzero(t >= 0)
                if len(at):
                    cols.append(t[at])
                    rows.append(n + at // passage)
                    held += len(at)
                n += -(-len(t) // passage)
                if held > 200_000:
                    add(np.concatenate(cols), np.concatenate(rows))
                    cols, rows, held = [], [], 0
            each = len(texts)
            yield pa.RecordBatch.from_arrays([pa.nulls(each, pa.int64()), pa.nulls(each, pa.list_(pa.float64())), pa.nulls(each, pa.float64()), batch.column(0), pa.array(texts, pa.binary())], names=_NAMES)
        if held:
            add(np.concatenate(cols), np.concatenate(rows))
        some = np.flatnonzero(df)
        each = len(some) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array([*y[some].tolist(), [0.0] * rank], pa.list_(pa.float64())), pa.array(np.append(df[some], n), pa.float64()), pa.nulls(each, pa.int64()), pa.nulls(each, pa.binary())], names=_NAMES)

    return run, test


_SUMS = "column long, y array<double>, df double, doc_id long, tokens binary"
_NAMES = [x.split()[0] for x in _SUMS.split(", ")]


def latent_space(docs: DataFrame, items: Items, rank: int = 48, passage: int = 64, seed: int = 11) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Fold-in matrix (columns of the benchmark x rank, whitened) and idf, from the passages of all ``docs``, and
    the tokens (32-bit columns) of those with a doc_id.

    What comes to the driver has one row per word of the (bounded) benchmark, whatever the corpus.
    """
    run, test = _passage_sums(items, rank, passage, seed)
    width = len(items.columns)
    made = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _SUMS), "passages")
    long = made.where("column is not null").select("column", "df", F.posexplode("y").alias("k", "v"))
    sums = long.groupBy("column", "k").agg(F.sum("v").alias("v"), F.sum("df").alias("df")).toPandas()
    tokens = made.where("doc_id is not null").select("doc_id", "tokens")
    y, df = np.zeros((width, rank)), np.zeros(width)
    real = sums[sums["column"] >= 0]
    y[real["column"].to_numpy(int), real["k"].to_numpy(int)] = real["v"]
    df[real["column"].to_numpy(int)] = real["df"]
    total = float(sums.loc[sums["column"] < 0, "df"].max()) if (sums["column"] < 0).any() else 0.0
    idf = np.log((total + 2) / (df + 1)) + 0.05
    core = test.T.astype(float) @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(), 0) * 1e-9
    if not keep.any():
        return np.zeros((width, 0)), idf, tokens
    half = (idf[:, None] * y) @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, sing, _ = np.linalg.svd(half, full_matrices=False)
    ok = sing > sing.max() * 1e-6
    return idf[:, None] * left[:, ok] / sing[ok], idf, tokens


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


class _Rare:
    """Where enough of an item's rarest words stand close together.

    Of an item's n words at least ``least`` must be in what the check compares. With r of them called rare (counted as
    often as they occur), at least r - (n - least) rare ones are among those. r is chosen so that this is a third of ``least``."""

    def __init__(self, items: Items, rarity: np.ndarray, partly: float):
        rows, need = [], []
        for i, t in enumerate(items.tokens):
            least = math.ceil(partly * len(t) - 1e-9)
            most = max(1, -(-least // 3))
            rare = t[np.argsort(-rarity[t], kind="stable")][: len(t) - least + most]
            need.append(most)
            rows += [(c, i) for c in np.unique(rare).tolist()]
        rows.sort()
        self.items = np.array([i for _, i in rows], np.int64)
        self.starts = np.searchsorted([c for c, _ in rows], np.arange(len(items.columns) + 1))
        self.need = np.array(need, np.int64)
        self.span = np.array([items.sizes[k] + 2 * (items.sizes[k] // 2) for k in items.kind], np.int64)
        self.gap = int(self.span.max())

    def places(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, item and place of the first of enough rare words of the item within its span, for all texts."""
        size = np.array([len(t) for t in tokens], np.int64)
        begin = np.cumsum(size) - size
        t = np.concatenate(tokens)
        text = np.repeat(np.arange(len(tokens)), size)
        at = np.flatnonzero(t >= 0)
        first = self.starts[t[at]]
        many = self.starts[t[at] + 1] - first
        place = np.repeat(at, many)
        item = self.items[np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)]
        far = place + text[place] * self.gap  # no span reaches from one text into the next
        order = np.lexsort((far, item))
        item, place, far = item[order], place[order], far[order]
        last = np.arange(len(item)) + self.need[item] - 1
        ok = last < len(item)
        last = np.minimum(last, max(len(item) - 1, 0))
        ok &= (item[last] == item) & (far[last] - far < self.span[item])
        place, item = place[ok], item[ok]
        return text[place], item, place - begin[text[place]]


def find(docs: DataFrame, benchmark: DataFrame, rank: int = 48, cosine: float = 0.5, whole: float = 0.7, partly: float = 0.6, answer: float = 0.8, max_items: int = 100_000) -> DataFrame:
    """doc_id, item_id, common (words of the longest common subsequence), item_words, answer_share: one row
    per document and benchmark item found in it.

    An item is found if a window's cosine reaches ``cosine`` and, in it and half its width on either side, the longest
    common subsequence holds ``whole`` of the item's words, or ``partly`` of them and ``answer`` of its answer's.
    Windows of whole texts are compared, of a width near the item's length, however long it is, and a third of it apart, but
    for those that no check could confirm (see ``_Rare``). The benchmark is collected, so it is counted first and may
    have ``max_items`` rows.

    Null and empty texts contain nothing, null or word-less items are in nothing; an empty benchmark or
    table gives no rows. Repeated rows of a doc_id and item give the best one. Null doc_ids are left out.
    Other columns, of whatever name, are not read.
    """
    schema = "doc_id long, item_id long, common int, item_words int, answer_share double"
    if benchmark.limit(max_items + 1).count() > max_items:
        raise ValueError(f"the benchmark has more than {max_items} items; raise max_items if the driver can hold them")
    items = Items([(r[0], r[1]) for r in benchmark.where("item_id is not null").select("item_id", "text").collect()])
    if not len(items.ids):
        return docs.sparkSession.createDataFrame([], schema)
    fold, rarity, rows = latent_space(docs, items, rank)
    fold = fold.astype(np.float32)
    latent = _unit(np.array([fold[t].sum(0) for t in items.tokens])).astype(np.float32)
    tokens, answers, ids, rare = items.tokens, items.answers, items.ids, _Rare(items, rarity, partly)
    by_kind = {}
    for kind, size in enumerate(items.sizes):
        which = np.flatnonzero(items.kind == kind)
        if len(which):
            by_kind[kind] = (size, which, np.ascontiguousarray(latent[which].T))

    def confirmed(t: np.ndarray, starts_of: dict[int, np.ndarray]) -> dict[int, tuple]:
        """Item to (common, words, share of the answer) for one text, of whose windows those count that hold one of the
        given places of their kind."""
        is_known = t >= 0
        known = np.concatenate(([0], np.cumsum(is_known)))
        # Prefix sums over the known words only; ``known`` counts those before each place.
        sums = np.zeros((known[-1] + 1, fold.shape[1]))
        np.cumsum(fold[t[is_known]], axis=0, dtype=float, out=sums[1:])
        best: dict[int, tuple] = {}
        for kind, places in starts_of.items():
            size, which, targets = by_kind[kind]
            step = size // 3
            starts = np.arange(0, max(1, len(t) - size + step), step)
            ends = np.minimum(starts + size, len(t))
            starts = np.maximum(0, ends - size)
            low, high = np.maximum(0, starts - size // 2), np.minimum(len(t), ends + size // 2)
            places = np.sort(places)
            some = np.searchsorted(places, low) < np.searchsorted(places, high)
            starts, ends, low, high = starts[some], ends[some], low[some], high[some]
            for block in range(0, len(starts), 4096):
                cut = slice(block, block + 4096)
                near = _unit((sums[known[ends[cut]]] - sums[known[starts[cut]]]).astype(np.float32)) @ targets >= cosine
                for w, i in np.argwhere(near).tolist():
                    item, part = int(which[i]), t[low[block + w] : high[block + w]]
                    n = len(tokens[item])
                    if np.isin(tokens[item], part).sum() < partly * n:
                        continue
                    common = lcs(tokens[item], part)
                    if common < partly * n or (item in best and best[item][0] >= common):
                        continue
                    share = lcs(answers[item], part) / len(answers[item])
                    if common >= whole * n or share >= answer:
                        best[item] = (common, n, share)
        return best

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            docs, held = [], 0
            last = batch.num_rows - 1
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                docs.append((doc, np.frombuffer(text, np.int32)))
                held += len(docs[-1][1])
                if held < 500_000 and row < last:
                    continue
                where, item, place = rare.places([t for _, t in docs])
                order = np.argsort(where, kind="stable")
                for chosen in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
                    kinds = items.kind[item[chosen]]
                    doc_id, t = docs[where[chosen[0]]]
                    best = confirmed(t, {int(k): place[chosen][kinds == k] for k in np.unique(kinds)})
                    out += [(doc_id, int(ids[i]), *x) for i, x in best.items()]
                docs, held = [], 0
            data = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(data, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "common", "item_words", "answer_share"])

    found = rows.mapInArrow(lean(search), schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("common").alias("common"), F.max("item_words").alias("item_words"), F.max("answer_share").alias("answer_share"))
