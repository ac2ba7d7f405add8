"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Two sets of sizes s <= t with a Jaccard similarity of 3/4 or more differ in at most (s + t) / 7
elements. The universe of hashed shingles is cut into segments, more of them the larger the size
band, so that those differences cannot touch every segment: some segment has the same subset of
elements in both sets. Segment subsets are the index.

1. *Subsets.* Every distinct set indexes its segment subsets in the layout of its own size band and
   in that of the band below. A subset that few sets hold is cheap: all pairs of its holders are
   proposed. For a subset that many hold only a star around one of them is proposed. A set that has
   more cheap segments than it can have differences is *covered*: all its partners were proposed.
2. *Neighbourhoods.* Sets that are not covered index their subsets again, now with the one-deletion
   neighbourhoods of every segment; holders that are linked already count as one. Each segment is
   allocated a threshold by cost: 1 if its subset and neighbours are cheap, 0 if only the subset is,
   -1 otherwise. A set whose thresholds plus one sum to more than its differences is covered.
3. *The rest.* Sets that are still not covered consist almost wholly of what very many others hold.
   They are compared exactly within families that share a subset, block against block.

A proposed pair must agree in as many segments as its differences leave untouched, and is then
verified on the full sets. Links are closed to components by union-find.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import components, discard, lean, materialize, partitions_for, release

WORDS = 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


class _Hash(dict):
    """Word to 64-bit hash; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, memo: _Hash, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a whole text.

    A-Z is lower-cased; words are runs of characters other than space and U+0009 to U+000D. With fewer
    words the whole sequence is the one element; without any, or null, the set is empty.
    """
    run = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not run:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, run), np.uint64, len(run))
    n = min(words, len(run))
    odd = _ODD if words <= len(_ODD) else _mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    out = h[: len(h) - n + 1] * odd[0]
    for i in range(1, n):
        out = out + h[i : len(h) - n + 1 + i] * odd[i]
    if n < words:
        out = out + np.uint64(n)
    return np.unique(out)


def _bands(most: int = 1 << 40) -> list[int]:
    """First sizes of the bands: a partner of a set is in its band or in a neighbouring one."""
    out = [1, 2]
    while out[-1] < most:
        out.append(max(out[-1] + 1, 4 * (out[-1] - 1) // 3 + 1))
    return out


_BANDS = _bands()


class _Layouts:
    """Segments of each band, made when needed."""

    def __init__(self, slack: float):
        self.slack, self.made = slack, {}

    def __getitem__(self, band: int) -> tuple[np.ndarray, np.ndarray]:
        if band not in self.made:
            last = _BANDS[band + 1] - 1
            segments = int(((last + 4 * last // 3) // 7 + 1) * self.slack) + 2
            step = (1 << 64) // segments
            bounds = np.array([i * step for i in range(1, segments)], np.uint64)
            self.made[band] = bounds, _mix(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 40))
        return self.made[band]

    def of(self, u: np.ndarray, guest: bool) -> tuple[int, int] | None:
        """Band whose layout a set uses as a member (or as a guest from the band above) and the most
        differences it can have from a partner there; None if it can have none there."""
        n = len(u)
        band = bisect_right(_BANDS, n) - 1
        if not guest:
            return band, (n + 4 * n // 3) // 7
        last = _BANDS[band] - 1
        return (band - 1, (n + last) // 7) if last and 4 * last >= 3 * n else None

    def subsets(self, u: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each segment: where it starts in u, its count, the sum of mixed elements and its seed."""
        bounds, seeds = self[band]
        at = np.concatenate(([0], np.searchsorted(u, bounds), [len(u)]))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(u), dtype=np.uint64)))
        return at, np.diff(at), sums[at[1:]] - sums[at[:-1]], seeds


def _signature(sums: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return _mix(sums ^ seeds)


_OUT = "kind int, a long, b long, n long, own_ne int, own_h int, guest_ne int, guest_h int, key binary"
_MID = _OUT + ", bucket int, sigs binary, at binary, docs binary, sizes binary, comps binary"
_OUT_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "own_ne": pa.int32(), "own_h": pa.int32(), "guest_ne": pa.int32(), "guest_h": pa.int32(), "key": pa.binary(), "bucket": pa.int32()}
PROFILE, BLOCK, STAR, SKIPPED, PAIR = range(5)
#: Flags of an index entry: more holders were combined in its task; it uses the layout of the band below; it is a deletion.
THIN, GUEST, DELETION = 1, 2, 4
#: Added to the segment of an empty subset of a set that has enough filled ones: it names no family.
EMPTY = 1 << 28


def _batch(names: list[str], rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES.get(c, pa.binary())) if c in columns else pa.nulls(rows, _TYPES.get(c, pa.binary())) for c in names], names=names)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    return starts, np.diff(np.concatenate((starts, [len(x)])))


def _entries(layouts: _Layouts, u: np.ndarray, band: int, most: int, deep: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set's segment subsets, what each is (segment and flags) and how many segments count.

    ``deep`` adds the empty segments, which the deletion of a partner's only element meets, and one-deletion
    neighbours. Empty segments are marked unless the set has too few filled ones to be covered."""
    _, count, sums, seeds = layouts.subsets(u, band)
    seg = np.arange(len(count)) if deep else np.flatnonzero(count)
    sig = _signature(sums[seg], seeds[seg])
    if not deep:
        return sig, np.zeros(len(sig), np.int64), len(seg)
    of = np.repeat(seg, count)
    named = seg + EMPTY * (count == 0) if np.count_nonzero(count) > most else seg
    return np.concatenate((sig, _signature(sums[of] - _mix(u), seeds[of]))), np.concatenate((named << 3, of << 3 | DELETION)), len(seg)


def _mapper(slack: float, spread: np.ndarray, local: int, forward: int, deep: bool, flush: int = 1_000_000):
    """Profiles and blocks of index entries of the texts of one task.

    Copies within the task index their set once. A subset that more than ``local`` sets of the task
    hold is combined here: a star around the smallest id, and ``forward`` of the rows as its witnesses.
    """
    names, buckets = [x.split()[0] for x in _MID.split(", ")], len(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, layouts, known, turn = _Hash(), _Layouts(slack), set(), 0
        sigs: list[np.ndarray] = []
        whats: list[np.ndarray] = []
        docs: list[tuple] = []  # id, size, component
        tags: list[tuple] = []  # position in docs, count
        held = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            s, what = np.concatenate(sigs), np.concatenate(whats)
            which, count = (np.array(x, np.int64) for x in zip(*tags, strict=True))
            d = np.repeat(which, count)
            order = np.argsort(s, kind="stable")
            s, what, d = s[order], what[order], d[order]
            ids, sizes, comps = (np.array(x, np.int64) for x in zip(*docs, strict=True))
            starts, lengths = _runs(s)
            keep = np.ones(len(s), bool)
            for k in np.flatnonzero(lengths > local):
                lo, hi = starts[k], starts[k] + lengths[k]
                of = ids[d[lo:hi]]
                stay = np.zeros(hi - lo, bool)
                stay[:forward] = stay[of.argmin()] = True
                keep[lo:hi] = stay
                what[lo:hi] |= THIN
                rest, n = ~stay, hi - lo
                hint = what[lo:hi] >> 3 < EMPTY
                h = int(hint.sum())
                yield _batch(names, h, kind=np.full(h, STAR), a=np.full(h, of.min()), b=of[hint], own_ne=(sizes[d[lo:hi]] + sizes[d[lo + of.argmin()]])[hint], n=np.ones(h, np.int64), bucket=spread[np.arange(h) % buckets])
                m = int(rest.sum())
                yield _batch(names, m, kind=np.full(m, SKIPPED), a=of[rest], b=what[lo:hi][rest] >> 1 & 3, own_ne=what[lo:hi][rest] >> 3, n=np.ones(m, np.int64), bucket=spread[np.arange(m) % buckets])
            s, what, d = s[keep], what[keep], d[keep]
            bucket = ((s >> _S) * np.uint64(buckets) >> _S).astype(np.int64)
            starts, lengths = _runs(bucket)
            rows: dict[str, list] = {c: [] for c in ("sigs", "at", "docs", "sizes", "comps")}
            for lo, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                one, back = np.unique(d[lo : lo + n], return_inverse=True)
                rows["sigs"].append(s[lo : lo + n].astype(np.uint32).tobytes())
                at = back << 32 | what[lo : lo + n] if deep else back << 2 | what[lo : lo + n]
                rows["at"].append((at if deep else at.astype(np.uint16 if len(one) <= 1 << 14 else np.uint32)).tobytes())
                rows["docs"].append(ids[one].tobytes())
                rows["sizes"].append(sizes[one].astype(np.int32).tobytes())
                rows["comps"].append(comps[one].tobytes() if deep else b"")
            if len(starts):
                yield _batch(names, len(starts), kind=np.full(len(starts), BLOCK), bucket=spread[bucket[starts]], **rows)

        for batch in batches:
            cols = batch.to_pydict()
            prof: dict[str, list] = {c: [] for c in ("a", "n", "own_ne", "own_h", "guest_ne", "guest_h", "key", "bucket")}
            for doc, text, comp, own, guest in zip(cols["doc_id"], cols["text"], cols["comp"], cols["own"], cols["guest"], strict=True):
                u = shingles(text, memo)
                key = xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None
                ne: list[int | None] = [None] * 4
                if doc is not None and len(u) and key not in known:
                    known.add(key)
                    if len(known) > 1_000_000:
                        known.clear()
                    docs.append((doc, len(u), doc if comp is None else comp))
                    for side in (0, 1):
                        where = layouts.of(u, bool(side)) if (own, guest)[side] else None
                        if where:
                            sig, what, filled = _entries(layouts, u, *where, deep)
                            sigs.append(sig)
                            whats.append(what | side * GUEST)
                            tags.append((len(docs) - 1, len(sig)))
                            held += len(sig)
                            ne[2 * side : 2 * side + 2] = filled, where[1]
                for c, v in zip(prof, (doc, len(u), *ne, key, int(spread[turn % buckets])), strict=True):
                    prof[c].append(v)
                turn += 7919
                if held >= flush:
                    yield from blocks()
                    sigs, whats, docs, tags, held = [], [], [], [], 0
            yield _batch(names, batch.num_rows, kind=np.full(batch.num_rows, PROFILE), **prof)
        if sigs:
            yield from blocks()

    return run


def _cross(lo: int, hi: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of unlike components in one run, which is sorted by component."""
    starts, lengths = _runs(c[lo:hi])
    i = [np.repeat(np.arange(a, a + n), hi - lo - a - n) for a, n in zip(starts, lengths, strict=True)]
    j = [np.tile(np.arange(a + n, hi - lo), n) for a, n in zip(starts, lengths, strict=True)]
    return lo + np.concatenate(i), lo + np.concatenate(j)


def _reducer(few: int, deep: bool, ratio: int = 32):
    """Groups the entries of one task by signature: enumerate the cheap ones; of the others propose a star
    and tell their holders that the entry was skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            plain = batch.filter(pa.array(kind != BLOCK))
            if plain.num_rows:
                yield plain.select(_OUT_NAMES)
            x = batch.filter(pa.array(kind == BLOCK))
            get = [x.column(x.schema.get_field_index(c)).to_pylist() for c in ("bucket", "sigs", "at", "docs", "sizes", "comps")]
            for bucket, s, at, docs, sizes, comps in zip(*get, strict=True):
                at = np.frombuffer(at, {2: np.uint16, 4: np.uint32, 8: np.int64}[4 * len(at) // len(s)]).astype(np.int64)
                of, what = (at >> 32, at & 0xFFFFFFFF) if deep else (at >> 2, at & 3)
                doc = np.frombuffer(docs, np.int64)
                comp = np.frombuffer(comps, np.int64) if deep else doc
                parts.append((np.frombuffer(s, np.uint32).astype(np.uint64) | np.uint64(bucket << 32), what.astype(np.uint32), doc[of], np.frombuffer(sizes, np.int32)[of], comp[of]))
        if not parts:
            return
        s, what, ids, sizes, comps = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(s, kind="stable")
        _, lengths = _runs(s[order])
        order = order[np.repeat(lengths > 1, lengths)]
        order = order[np.lexsort((comps[order], s[order]))]
        s, what, ids, sizes, comps = s[order], what[order], ids[order], sizes[order], comps[order]
        starts, n = _runs(s)
        if not len(s):
            return
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (comps[1:] != comps[:-1])))
        kinds = np.add.reduceat(new, starts, dtype=np.int64)
        at = np.flatnonzero(new)
        squares = np.zeros(len(s), np.int64)
        squares[at] = np.diff(np.concatenate((at, [len(s)]))) ** 2
        cross = (n * n - np.add.reduceat(squares, starts)) // 2
        thin = np.bitwise_or.reduceat(what & THIN, starts) > 0
        cheap = (kinds > 1) & ~thin & (kinds <= few) & (cross <= ratio * n)
        costly = ~cheap & ((kinds > 1) | thin)
        found: list[tuple] = []
        for size in np.unique(n[cheap]):
            first = starts[cheap & (n == size)]
            if size <= 64:
                i, j = np.triu_indices(size, 1)
                i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            else:
                i, j = (np.concatenate(x) for x in zip(*(_cross(a, a + size, comps) for a in first.tolist()), strict=True))
            ok = (comps[i] != comps[j]) & (what[i] & what[j] & (GUEST | DELETION) == 0) & (4 * np.minimum(sizes[i], sizes[j]) >= 3 * np.maximum(sizes[i], sizes[j]))
            i, j = i[ok], j[ok]
            weight = np.where((what[i] | what[j]) & DELETION, 1, 2 if deep else 1)
            found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), sizes[i] + sizes[j], weight))
        mask = np.repeat(costly, n)
        # The holder of the least id stands in the middle of the star.
        place = np.lexsort((ids, np.repeat(np.arange(len(n)), n)))[starts]
        least, middle = np.repeat(ids[place], n), np.repeat(sizes[place], n)
        near = 4 * np.minimum(sizes, middle) >= 3 * np.maximum(sizes, middle)
        one = np.ones(int(mask.sum()), np.int64)
        # Stars are hints in the first pass, so a quarter of the subsets is enough; later they name families.
        hint = mask & (what >> 3 < EMPTY) if deep else mask & near & (s & np.uint64(3) == 0)
        star = (least[hint], ids[hint], sizes[hint] + middle[hint], np.ones(int(hint.sum()), np.int64))
        skipped = (ids[mask], (what[mask] >> 1 & 3).astype(np.int64), (what[mask] >> 3).astype(np.int64), one)

        def counted(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((c, b, a))
            a, b, c, w = a[order], b[order], c[order], w[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.empty(0, bool)
            at = np.flatnonzero(new)
            total = np.add.reduceat(w, at) if len(at) else w
            for k in range(0, len(at), 100_000):
                z = at[k : k + 100_000]
                yield _batch(_OUT_NAMES, len(z), kind=np.full(len(z), kind), a=a[z], b=b[z], own_ne=c[z], n=total[k : k + 100_000])

        if found:
            yield from counted(PAIR, *(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)))
        yield from counted(STAR, *star)
        yield from counted(SKIPPED, *skipped)

    return run


def _spread(spark: SparkSession, parts: int) -> np.ndarray:
    """One number for each of ``parts`` hash partitions that Spark puts there, so that buckets are dealt evenly."""
    at = spark.range(16 * parts).select(F.col("id").cast("int").alias("v"))
    rows = at.groupBy(F.pmod(F.hash("v"), F.lit(parts)).alias("p")).agg(F.min("v").alias("v")).collect()
    out = np.arange(parts, dtype=np.int64)
    for r in rows:
        out[r["p"]] = r["v"]
    return out


def _index(docs: DataFrame, slack: float, few: int, local: int, parts: int, deep: bool) -> DataFrame:
    """One pass of the index over docs(doc_id, text, comp, own, guest): rows of ``_OUT``."""
    mapped = docs.select("doc_id", "text", "comp", "own", "guest").mapInArrow(lean(_mapper(slack, _spread(docs.sparkSession, parts), local, few + 1, deep)), _MID)
    out = materialize(mapped.repartition(parts, "bucket").mapInArrow(lean(_reducer(few, deep)), _OUT), "index")
    del mapped
    release(docs.sparkSession)  # the largest of all shuffles
    return out


def _verify(docs: DataFrame, pairs: DataFrame, width: int, chunk: int = 64) -> DataFrame:
    """Those pairs(a, b) whose full sets of shingles have a Jaccard similarity of 3/4 or more.

    The texts of at most about ``chunk`` partners meet that of one document in a group.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    roles = dealt.select(F.col("b").alias("doc_id"), "a", "chunk", F.lit(1).alias("role")).union(dealt.select(F.col("a").alias("doc_id"), "a", "chunk", F.lit(0)).distinct())
    # Shuffled at every size, so that it neither depends on an estimate nor broadcasts what grows with the input.
    texts = docs.join(roles.hint("shuffle_hash"), "doc_id").select("doc_id", "a", "chunk", "role", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, now, centre = _Hash(), None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            cols = batch.to_pydict()
            for doc, left, part, role, text in zip(cols["doc_id"], cols["a"], cols["chunk"], cols["role"], cols["text"], strict=True):
                u = shingles(text, memo)
                if role == 0:
                    now, centre = (left, part), u
                elif now == (left, part):
                    both = len(np.intersect1d(centre, u, assume_unique=True))
                    if 100 * both >= 75 * (len(u) + len(centre) - both) and both:
                        a.append(left), b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return texts.repartition(width, "a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(lean(check), "a long, b long")


def _blocks(docs: DataFrame, family: DataFrame, size: int = 512) -> DataFrame:
    """Links between unlike components within each family, by comparing blocks of about ``size`` documents.

    family(rep, comp, family) names the documents. A task holds two blocks; of the links that it finds it
    returns a spanning set over components.
    """
    counts = family.groupBy("family").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = family.join(counts, "family").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "comp", "family", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    texts = docs.join(dealt.hint("shuffle_hash"), docs["doc_id"] == dealt["rep"]).select("rep", "comp", "family", "i", "lo", "hi", "text")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        memo = _Hash()
        sets = [shingles(t, memo) for t in x["text"]]
        n = np.array([len(u) for u in sets], np.int64)
        order = np.argsort(n, kind="stable")
        sets, n, x = [sets[k] for k in order], n[order], x.iloc[order]
        comp, rep, block = (x[c].to_numpy(np.int64) for c in ("comp", "rep", "i"))
        every, back = np.unique(np.concatenate(sets), return_inverse=True)
        df = np.bincount(back, minlength=len(every))
        rank = np.cumsum(df > 1) - 1
        row, col = np.repeat(np.arange(len(n)), n), np.where(df[back] > 1, rank[back], -1)
        common = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, 2048):
            some = (col >= at) & (col < at + 2048)
            m = np.zeros((len(n), 2048), np.float32)
            m[row[some], col[some] - at] = 1
            common += m @ m.T
        i, j = np.nonzero(np.triu(100 * common >= 75 * (n[:, None] + n[None, :] - common), 1))
        across = (comp[i] != comp[j]) & ((block[i] != block[j]) | (x["lo"].iloc[0] == x["hi"].iloc[0]))
        i, j = i[across], j[across]
        pairs, first = np.unique(np.stack((comp[i], comp[j])), axis=1, return_index=True) if len(i) else (np.empty((2, 0), int), np.empty(0, int))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c] = root.get(root[c], root[c])
            return c

        out = []
        for a, b, k in zip(*pairs.tolist(), first.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(rep[i[k]]), int(rep[j[k]])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return texts.groupBy("family", "lo", "hi").applyInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, few: int = 4, local: int = 64, bytes_each: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text); see the module's text.

    Null, empty and blank texts have an empty set, link to nothing and are their own component. Copies
    are one class from the start. Repeated rows come back as often as they went in; rows that share
    a doc_id are one node of the link graph, which links with all that any of its texts does. A row without
    doc_id gets the component of the ids that have its very set (null if none has). An empty table gives an
    empty result. Only doc_id and text are read. ``few``, ``local`` and ``bytes_each`` change the work, never the result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = partitions_for(docs, bytes_each)
    counts = base.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    often = materialize(counts.where("rows > 1").select("doc_id"), "repeated")
    if often.isEmpty():
        return _of_nodes(base, None, few, local, width)
    # Every different text of a repeated doc_id is a node of its own, numbered below all ids, and linked to the others.
    least = base.agg(F.min("doc_id").alias("x")).first()["x"]
    texts = base.join(often, "doc_id").groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("copies"))
    texts = materialize(texts.withColumn("node", F.lit(least - 1) - F.monotonically_increasing_id()), "texts")
    same = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")
    nodes = base.join(often, "doc_id", "left_anti").union(texts.select("node", "text"))
    got = _of_nodes(nodes, same, few, local, width)
    real = texts.select("node", F.col("doc_id").alias("real"), "copies")
    rows = materialize(got.join(real, got["doc_id"] == real["node"], "left").select(F.coalesce("real", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("root"), F.coalesce("copies", F.lit(1)).alias("copies")), "rows")
    smallest = rows.where((F.col("root") < least) & (F.col("n_shingles") > 0)).groupBy("root").agg(F.min("doc_id").alias("smallest"))
    out = rows.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("smallest", "root")))
    return out.select("doc_id", "n_shingles", "component_id", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def _of_nodes(base: DataFrame, linked: DataFrame | None, few: int, local: int, width: int) -> DataFrame:
    """jaccard_components() of rows of which each doc_id has one text; ``linked`` (a, b) are further links."""
    spark, none = base.sparkSession, F.lit(None).cast("long")
    first = _index(base.select("*", none.alias("comp"), F.lit(True).alias("own"), F.lit(True).alias("guest")), 1.25, few, local, width, False)
    profiles = first.where(F.col("kind") == PROFILE)
    classes = profiles.where("n > 0").groupBy("key").agg(F.min("a").alias("rep"))
    placed = materialize(profiles.where("n > 0").join(classes, "key", "left").select(F.col("a").alias("doc"), "n", "rep", "own_ne", "own_h", "guest_ne", "guest_h"), "placed")
    copies = placed.where("own_ne is not null and doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    copies = copies if linked is None else copies.union(linked)

    def coverage(index: DataFrame, held: DataFrame, gain: int) -> DataFrame:
        """Per indexed document and layout: the sum over segments of threshold + 1, and the differences a partner
        may have."""
        skipped = index.where(F.col("kind") == SKIPPED).select(F.col("a").alias("doc"), F.col("b").bitwiseAND(F.lit(1)).cast("int").alias("side"), F.col("own_ne").alias("seg"), (F.col("b") < 2).alias("subset"), "n")
        if gain == 1:
            lost = skipped.groupBy("doc", "side").agg(F.sum("n").alias("lost"))
        else:
            lost = skipped.groupBy("doc", "side", "seg").agg(F.max(F.col("subset").cast("int")).alias("s")).groupBy("doc", "side").agg(F.sum(F.col("s") + 1).alias("lost"))
        lost = lost.groupBy("doc").agg(*(F.sum(F.when(F.col("side") == i, F.col("lost")).otherwise(0)).alias(f"{c}_lost") for i, c in enumerate(("own", "guest"))))
        both = held.where("own_ne is not null or guest_ne is not null").join(lost, "doc", "left")
        return both.select("doc", *(x for c in ("own", "guest") for x in ((gain * F.col(f"{c}_ne") - F.coalesce(f"{c}_lost", F.lit(0))).alias(f"{c}_bought"), f"{c}_h")))

    def proposals(index: DataFrame, cover: DataFrame, hint: str) -> DataFrame:
        """Distinct pairs: from cheap entries if they agree as often as their differences allow, and from stars if
        ``hint`` holds, which a linked pair of costly subsets alone meets."""
        two = index.where(F.col("kind").isin(STAR, PAIR) & (F.col("a") != F.col("b"))).select("kind", "a", "b", F.col("own_ne").alias("total"), "n")
        two = two.groupBy("a", "b").agg(F.max("total").alias("total"), F.sum(F.when(F.col("kind") == PAIR, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("kind") == STAR, F.col("n")).otherwise(0)).alias("star"))
        two = two.where(f"n > 0 or {hint}")
        least = cover.select("doc", F.least("own_bought", "guest_bought").alias("least"))
        ca, cb = (least.select(F.col("doc").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
        two = two.join(ca, "a", "left").join(cb, "b", "left").withColumn("untouched", F.greatest(F.lit(1), F.coalesce("least_a", F.lit(1)) - F.floor(F.col("total") / 7), F.coalesce("least_b", F.lit(1)) - F.floor(F.col("total") / 7)))
        return two.where(f"n >= untouched or (star > 0 and {hint})").select("a", "b")

    def uncovered(cover: DataFrame, roots: DataFrame) -> DataFrame:
        own, guest = F.coalesce(F.col("own_bought") <= F.col("own_h"), F.lit(False)), F.coalesce(F.col("guest_bought") <= F.col("guest_h"), F.lit(False))
        rest = cover.where(own | guest).select("doc", own.alias("own"), guest.alias("guest"))
        return materialize(rest.join(roots, rest["doc"] == roots["node"], "left").select("doc", F.coalesce("root", "doc").alias("comp"), "own", "guest"), "open")

    def links(cover: DataFrame, index: DataFrame, hint: str) -> DataFrame:
        pairs = materialize(proposals(index, cover, hint), "pairs")
        out = materialize(_verify(base, pairs, width), "links")
        discard(pairs)
        release(spark)
        return out

    cover = materialize(coverage(first, placed, 1), "cover")
    # Linked sets differ in a seventh of their elements at most, so of 1.25 / 7 and 1.5 / 7 as many segments more than 1 / 28
    # and 1 / 14 agree. A quarter of the stars is told in the first pass; subsets count twice in the second.
    found = [links(cover, first, "n + 4 * star > total / 32")]
    edges = copies.union(found[0])
    roots = components(edges, "cc")
    rest = uncovered(cover, roots)
    if not rest.isEmpty():
        again = base.join(rest.hint("shuffle_hash"), base["doc_id"] == rest["doc"]).select("doc_id", "text", "comp", "own", "guest")
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        second = _index(again, 1.5, 4 * few, 64 * local, max(least, -(-rest.count() // 500)), True)
        held = second.where(F.col("kind") == PROFILE).select(F.col("a").alias("doc"), "own_ne", "own_h", "guest_ne", "guest_h")
        discard(cover, rest, roots)
        cover = materialize(coverage(second, held, 2), "cover")
        found.append(links(cover, second, "n / 2 + star > total / 16"))
        edges = edges.union(found[-1])
        roots = components(edges, "cc")
        rest = uncovered(cover, roots)
        if not rest.isEmpty():
            # Two sets within reach of each other hold a subset in common, so they are in one family.
            families = components(second.where(F.col("kind") == STAR).select("a", "b"), "family")
            grouped = rest.join(families, rest["doc"] == families["node"]).select(F.col("doc").alias("rep"), "comp", F.col("root").alias("family"))
            edges = edges.union(materialize(_blocks(base, materialize(grouped, "family")), "links"))
            roots = components(edges, "cc")
        discard(second)
    discard(cover, rest, *found)

    some = placed.join(roots, placed["rep"] == roots["node"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    return some.union(profiles.where("n = 0").select(F.col("a"), F.col("n"), F.col("a")))
