"""Best-fit packing: a configuration linear program over the histogram of lengths.

Documents become token ids and one end id; only what is longer than a sequence is cut. The
histogram of piece lengths has at most ``capacity`` rows however large the corpus is, so the
driver solves the program over it: minimise the number of sequences so that the chosen
configurations (multisets of lengths that fit one sequence) cover every length. Multiplicative
weights hold a price per length; a knapsack dynamic program finds the best-paid configurations;
the average of the answers is an approximate fractional solution, which is rounded, and what that
leaves is a smaller program of the same kind. Places are then handed out to the pieces in parallel
from ranks that are prefix sums of per-partition counts.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import lean, materialize

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


_MARKS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))))
_LATIN = frozenset(c for c in map(chr, range(256)) if c.isascii() and c.isalpha() or c >= "\xc0" and c.isalpha())
#: Marks but the apostrophe, between letters, digits, blanks and the ends of a text: a run of marks of the tokenizer's.
_CUT = re.compile("(?<![^a-z0-9\xdf-\xf6\xf8-\xff ])[!-&(-/:-@\\[-`{-~]++(?![^a-z0-9\xdf-\xf6\xf8-\xff ])")
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, then from 256 on.
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


class _Bounded(dict):
    """A dict that makes what is missing and takes about ``most`` bytes: when it holds half of that, its entries
    become the older half, out of which only what is asked for again comes back. Keeps no long keys."""

    #: Bytes of an entry besides those of its key and value: their headers and the dict's own slot.
    EACH = 49 + 33 + 100

    def __init__(self, make, most: int):
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) > 200:
            return out
        size = self.EACH + 2 * len(key) + len(out)
        if 2 * (self.held + size) > self.most:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = out
        return out


class _Ids:
    """ids of a text as little-endian bytes, equal to those of the tokenizer.

    A tokenizer that ignores white space and case and cuts words into runs of letters, single digits and runs
    of marks gets its texts by white-space-free runs, which are kept in about ``most`` bytes. A text of Latin-1 alone
    is made small and cut at its marks beforehand, which leaves few different runs; a run of Latin letters goes
    straight to the vocabulary. Any other tokenizer gets whole texts."""

    def __init__(self, path: str, most: int = 112 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor already use its cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_run = self._cuts_words(json.loads(self.tokenizer.to_str()))
        self.runs = _Bounded(self._of_run, most)

    @staticmethod
    def _cuts_words(spec: dict) -> bool:
        """If the tokenizer is of the kind for which the ways by runs and stems are exact."""
        normal = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        special = all(x["content"].startswith("<|") and x["special"] and not (x["lstrip"] or x["rstrip"] or set(x["content"]) & set(" \n")) for x in spec["added_tokens"])
        return special and normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and cut == [("Split", {"Regex": words}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_run:
            return self._encode(text)
        text = text.replace("\n", " ")
        if "<|" not in text and self._is_latin(text):
            text = _CUT.sub(r" \g<0> ", text.lower())
        return b"".join(map(self.runs.__getitem__, text.split(" ")))

    @staticmethod
    def _is_latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _of_run(self, run: str) -> bytes:
        if _LATIN.issuperset(run):
            small = run.lower()
            chars = small if small.isascii() else small.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()
        stem = run.rstrip(_MARKS)
        # What may hold a special token, or has marks that may join what is before them, stays whole.
        if len(stem) == len(run) or stem[-1:] not in _LATIN or "<|" in run:
            return self._encode(run)
        return self.runs[stem] + self.runs[run[len(stem) :]]


@lru_cache(maxsize=1)
def _ids_of(path: str) -> _Ids:
    """One per Python worker, so that the tasks it runs one after another share it."""
    return _Ids(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each row of ``docs`` with its place within the partition that made it.

    Null or empty text is one piece that holds the end id alone. Rows that repeat, also under one
    doc_id, are packed one by one; a null doc_id stays null; further columns are ignored.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, part = _ids_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last, width = np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                data = ids.of(text) + last
                for k in range(0, len(data), width):
                    one = data[k : k + width]
                    n = len(one) // 4
                    rows.append((doc, k // width, k // 4, n, zlib.crc32(one), part, int(seen[n])))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])
            out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], "Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(lean(cut), PIECE_SCHEMA)


class _Knapsack:
    """Bounded knapsack over lengths: no configuration holds more of a length than there are pieces of it."""

    def __init__(self, lengths: np.ndarray, need: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.copies = np.minimum(need, capacity // lengths)
        goods = []  # a length's copies as bundles of 1, 2, 4, ...
        for i, left in enumerate(self.copies.tolist()):
            bundle = 1
            while left > 0:
                goods.append((i, min(bundle, left)))
                left, bundle = left - bundle, 2 * bundle
        self.of, self.times = (np.array(x, np.int64) for x in zip(*goods, strict=True))
        self.size = self.times * lengths[self.of]

    def answers(self, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For every length the best-paid configuration that holds it (and the best of all), what each is paid, and the
        highest pay."""
        best = np.zeros(self.capacity + 1)
        take = np.zeros((len(self.of), self.capacity + 1), bool)
        for k, (size, worth) in enumerate(zip(self.size.tolist(), (self.times * prices[self.of]).tolist(), strict=True)):
            with_it = best[: self.capacity + 1 - size] + worth
            take[k, size:] = with_it > best[size:] + 1e-12
            np.maximum(best[size:], with_it, out=best[size:])
        room = self.capacity - np.append(self.lengths, 0)
        rows = np.eye(len(room), len(self.lengths), dtype=np.int16)
        for k in range(len(self.of) - 1, -1, -1):
            at = np.flatnonzero(take[k, room])
            room[at] -= self.size[k]
            rows[at, self.of[k]] += np.int16(self.times[k])
        np.minimum(rows, self.copies.astype(np.int16), out=rows)  # the one that was held from the start may be one too many
        return rows, rows @ prices, float(best[-1])


def _fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int, step: float, slack: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations, how often the fractional solution uses each, and a lower bound on the number of sequences.

    The oracle's answer to a round's prices is a mix of configurations that are paid the highest price but for
    ``slack``, each as often as its scarcest length allows: a mix covers many lengths at once, which keeps the
    program's width, and so the rounds, small. Weights fall with what a round covers. By duality the sum of all
    prices over the highest pay bounds every solution from below."""
    pack = _Knapsack(lengths, need, capacity)
    weight = need * lengths * (1 + 0.05 * lengths / capacity)  # near the best prices if waste can be avoided
    bound, made, used = 0.0, [], []
    for _ in range(rounds):
        rows, paid, top = pack.answers(weight / need)
        bound = max(bound, float(weight.sum() / top))
        rows = rows[paid >= (1 - slack) * top - 1e-12]
        times = (need / np.maximum(rows, 1)).min(1)
        cover = times @ rows / need
        made.append(rows), used.append(times / cover.max())
        weight = weight * np.exp(-step * cover / cover.max())
        weight = np.maximum(weight / weight.max(), 1e-9)
    rows, back = np.unique(np.concatenate(made), axis=0, return_inverse=True)
    times = np.bincount(back.ravel(), np.concatenate(used), len(rows))
    return rows, times * bound / times.sum(), bound


@dataclass(frozen=True)
class Solution:
    """plan: configurations and how often each is used; bound: no packing has fewer sequences; by_program: the
    pieces that the rounded program placed, of ``pieces`` shorter than a sequence."""

    plan: list[tuple[dict[int, int], int]]
    bound: int
    pieces: int
    by_program: int


def solve(histogram: dict[int, int], capacity: int, rounds: int = 6) -> list[tuple[dict[int, int], int]]:
    """The plan of ``solution``."""
    return solution(histogram, capacity, rounds).plan


def solution(histogram: dict[int, int], capacity: int, rounds: int = 6, step: float = 1.0, slack: float = 0.005) -> Solution:
    """Configurations that together hold every piece of ``histogram`` (length to number) exactly once.

    The program's fractional solution is rounded: configurations in falling order of use, at least once each,
    as far as pieces last. What that leaves is a smaller program, which is solved and rounded in turn until
    less than 1 / 200 of the pieces are left or a program places less than 1 / 1000 of its own. Those go by best fit. Work and
    memory depend on the number of different lengths, which ``capacity`` bounds, and hardly on that of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0 and n > 0}
    full = left.pop(capacity, 0)
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    pieces, by_program, bound = sum(left.values()), 0, 0
    while left:
        lengths = np.array(sorted(left), np.int64)
        need = np.array([left[n] for n in lengths.tolist()], np.int64)
        rows, use, least = _fractional(lengths, need, capacity, rounds, step, slack)
        bound = bound or max(math.ceil(least - 1e-6), -(-int(need @ lengths) // capacity))
        rest = need.copy()
        fill = np.concatenate([rows[k : k + 512] @ lengths for k in range(0, len(rows), 512)])
        for k in np.lexsort((-fill, -use)).tolist():
            on = np.flatnonzero(rows[k])
            held = rows[k, on].astype(np.int64)
            times = min(max(1, math.floor(use[k])), int((rest[on] // held).min()))
            if times > 0:
                rest[on] -= times * held
                plan.append((dict(zip(lengths[on].tolist(), held.tolist(), strict=True)), times))
        placed = int((need - rest).sum())
        by_program += placed
        left = {n: c for n, c in zip(lengths.tolist(), rest.tolist(), strict=True) if c}
        if 1000 * placed < need.sum() or 200 * rest.sum() <= pieces:
            break
    # Fill a sequence with the longest piece left and then, again and again, the best-fitting one; repeat that
    # configuration while its pieces last.
    while left:
        order = np.array(sorted(left))
        config, room = {}, capacity
        while True:
            at = int(np.searchsorted(order, room, "right")) - 1
            while at >= 0 and config.get(int(order[at]), 0) >= left[int(order[at])]:
                at -= 1
            if at < 0:
                break
            n = int(order[at])
            take = min(room // n, left[n] - config.get(n, 0))
            config[n] = config.get(n, 0) + take
            room -= take * n
        times = min(left[n] // a for n, a in config.items())
        plan.append((config, times))
        for n, a in config.items():
            left[n] -= times * a
            if not left[n]:
                del left[n]
    return Solution(plan, full + bound, pieces, by_program)


def _places(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Ranges of ranks: pieces of ``length`` ranked [first, first + size) lie in sequences from ``base``."""
    rows, taken, base = [], {}, 0
    for config, times in plan:
        at = 0
        for n in sorted(config, reverse=True):
            first = taken.get(n, 0)
            rows.append((n, first, config[n], base, at))
            taken[n] = first + times * config[n]
            at += n * config[n]
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "base", "at"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, rounds: int = 6) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)`` with their sequence and offset.

    Null or empty text: one piece, the end id. An empty table gives an empty result. Repeated rows
    and rows of one doc_id are packed apart; ties among equal lengths go by partition and row order.
    Very long texts are cut into whole sequences and one rest. Only doc_id and text are read.
    """
    made = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    # At most `capacity` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(solve(histogram, capacity, rounds))
    key = places["length"].to_numpy(np.int64) << 48 | places["first"].to_numpy(np.int64)
    first, each, base, at = (places[c].to_numpy(np.int64) for c in ("first", "each", "base", "at"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, rank = x["length"].to_numpy(np.int64), x["local"].to_numpy(np.int64) + x["ahead"].to_numpy(np.int64)
            i = np.searchsorted(key, length << 48 | rank, "right") - 1
            within = rank - first[i]
            yield x[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=base[i] + within // each[i], offset=at[i] + within % each[i] * length, doc_id=x["doc_id"].astype("Int64"))

    return made.join(offsets, ["part", "length"]).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
