"""Fuzzy line deduplication in DataFrame operations only.

Lines are lower-cased and trimmed. Their character shingles (all runs of ``size`` bytes of UTF-8) are
hashed, a MinHash signature is the minima of the hash under several XOR permutations, and bands
of it bring candidates together. Candidates are
verified by the exact Jaccard similarity of all their character shingles, links are closed by
union-find, and of each component the first line by (doc_id, position) is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ._util import components, discard, fresh, materialize, partitions_for, release

LOC = "decimal(38,0)"


def plain(line: Column) -> Column:
    return F.trim(F.lower(line))


def _place(docs: DataFrame) -> tuple[str, Column]:
    """The type of a line's place, doc_id * 2 ** 31 + pos, and what doc_id counts from: a long where the ids span less
    than 32 bits, since minima of decimals cost more than all else that is done for a shingle."""
    if isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if lo is None or hi - lo < 1 << 32:
            return "long", F.lit(lo or 0).cast("long")
    return LOC, F.lit(0).cast(LOC)


def _lines(docs: DataFrame, least: int, place: tuple[str, Column]) -> DataFrame:
    """doc_id, pos, loc, line (plain) and two hashes of every line of at least ``least`` bytes that is not blank."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    # Blanks are looked for in what stands in the text: a condition on ``line`` would make it once more for each line.
    rows = rows.where(F.ltrim("raw", F.lit(" \t\n\x0b\f\r")) != "").select("doc_id", "pos", plain(F.col("raw")).alias("line"))
    if least > 1:
        rows = rows.where(F.octet_length("line") >= least)
    kind, base = place
    loc = ((F.col("doc_id").cast(kind) - base) * F.lit(1 << 31).cast("long" if kind == "long" else "decimal(10,0)") + F.col("pos").cast("long" if kind == "long" else "decimal(10,0)")).cast(kind)
    return rows.select("doc_id", "pos", loc.alias("loc"), "line", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))


def _constants(n: int) -> list[int]:
    """XOR constants that differ in their leading bits, so that their minima are nearly independent."""
    return [((2 * i + 1) * (1 << 32) // (2 * n) + (i * 0x9E3779B1) % (1 << 32) // (2 * n)) % (1 << 32) - (1 << 31) for i in range(n)]


def signatures(lines: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """One row per distinct line: h, g, loc (its first place), n (its occurrences) and m (its minima).

    Repeated lines are combined before the shuffle. Minima are over 32-bit hashes of all the line's shingles. A row has four
    of them, so that its group is looked up and updated once for four; a line's last row repeats its last shingle. The
    least of four is taken by ``if``, which costs less than ``least``, and eight would be too much code to be compiled."""
    last = F.greatest(F.octet_length("line") - size + 1, F.lit(1))
    placed = lines.select("h", "g", "loc", F.col("line").cast("binary").alias("raw"), last.alias("last"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(1), "last", F.lit(4))).alias("at"))
    hashes = [F.hash(F.substring("raw", F.least(F.col("at") + k, F.col("last")), F.lit(size))).alias(f"x{k}") for k in range(4)]
    each = placed.select("h", "g", F.when(F.col("at") == 1, F.col("loc")).alias("loc"), "at", *hashes)
    lesser = lambda a, b: F.expr(f"if({a} < {b}, {a}, {b})")
    halves = [lesser(f"(x{k} ^ {c})", f"(x{k + 1} ^ {c})").alias(f"m{i}_{k}") for i, c in enumerate(_constants(bands * rows)) for k in (0, 2)]
    each = each.select("h", "g", "loc", "at", *halves)
    each = each.select("h", "g", "loc", "at", *(lesser(f"m{i}_0", f"m{i}_2").alias(f"m{i}") for i in range(bands * rows)))
    minima = [F.min(f"m{i}").alias(f"m{i}") for i in range(bands * rows)]
    every = each.groupBy("h", "g").agg(F.min("loc").alias("loc"), F.sum((F.col("at") == 1).cast("int")).alias("n"), *minima)
    return every.select("h", "g", "loc", "n", F.array(*(f"m{i}" for i in range(bands * rows))).alias("m"))


def _agree(bands: int, rows: int) -> Column:
    """Whether the minima ``m`` and ``om`` of two lines agree in half (fewer do by chance in one of 200 pairs at a
    similarity of 0.75)."""
    return 2 * sum((F.when(F.get("m", F.lit(i)) == F.get("om", F.lit(i)), 1).otherwise(0) for i in range(bands * rows)), F.lit(0)) >= bands * rows


def _alike(sa: str, sb: str, percent: int) -> Column:
    """Whether two shingle sets have a Jaccard similarity of ``percent`` / 100; the sizes alone rule out most."""
    of_size = 100 * F.least(F.size(sa), F.size(sb)) >= percent * F.greatest(F.size(sa), F.size(sb))
    shared = F.size(sa) - F.size(F.array_except(sa, sb))  # one hash table, where array_intersect fills two
    return of_size & ((100 + percent) * shared >= percent * (F.size(sa) + F.size(sb)))


def _within(near: DataFrame, texts: DataFrame, size: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """Verified pairs of unlike roots among all of each bucket of near(band, bands, n, h, root, m).

    A bucket of more than ``block`` lines is dealt to blocks, and each of them meets every other. Minima are compared
    first, without texts, and only lines that have a partner there, on their side, go on. Texts travel with those, and a
    line's shingles are made once where it is dealt to, so that a pair costs the intersection of two sets. A pair of
    several buckets is compared in the first of them. Only what is verified leaves the join."""
    dealt = near.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    left = dealt.select("band", "bands", "h", "root", "m", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = dealt.select(F.col("band").alias("oband"), F.col("h").alias("oh"), F.col("root").alias("oroot"), F.col("m").alias("om"), F.col("bands").alias("obands"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("oi"), F.col("own").alias("oj"))
    met = (F.col("band") == F.col("oband")) & (F.col("i") == F.col("oi")) & (F.col("j") == F.col("oj"))
    apart = (F.col("root") != F.col("oroot")) & ((F.col("i") < F.col("j")) | (F.col("h") < F.col("oh")))
    partners = met & apart & _agree(bands, rows) & (F.get(F.array_intersect("bands", "obands"), F.lit(0)) == F.col("band"))
    # The shingles are many times the texts and are sorted with them, so there are parts enough for an executor's memory.
    parts, other = partitions_for(texts, 1 << 20), texts.select(F.col("h").alias("oh"), F.col("raw").alias("oraw"))
    some = left.join(right.hint("merge"), partners, "left_semi").join(texts, "h").repartition(parts, "band", "i", "j").withColumn("s", shingle_set(F.col("raw"), size)).drop("raw")
    others = right.join(left.hint("merge"), partners, "left_semi").join(other, "oh").repartition(parts, "oband", "oi", "oj").withColumn("os", shingle_set(F.col("oraw"), size)).drop("oraw")
    return some.join(others.hint("merge"), partners & _alike("s", "os", percent)).select(F.least("h", "oh").alias("a"), F.greatest("h", "oh").alias("b"))


def _buckets(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """h, band, lo and hi (the ends of the bucket), n (lines in it), loc, m and bands (all of the line): the lines that
    share a band with another."""
    hashes = F.array(*(F.xxhash64(*(F.get("m", F.lit(j * rows + i)) for i in range(rows)), F.lit(j)) for j in range(bands)))
    # Dealt by band before they are counted, since few bands repeat, so that one shuffle serves the count and the join
    # (which would else ask for ``h`` on its side alone).
    banded = sig.where("h is not null").select("h", F.explode(hashes).alias("band")).repartition("band")
    buckets = banded.groupBy("band").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("n > 1 and lo < hi")
    # Few buckets and few lines of them are left, so looking them up costs less than sorting all bands, and all signatures,
    # to merge them.
    found = banded.join(buckets.hint("shuffle_hash"), "band")
    return found.hint("shuffle_hash").join(sig.select("h", "loc", "m"), "h").withColumn("bands", hashes)


def _links(docs: DataFrame, sig: DataFrame, place: tuple[str, Column], size: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """Verified pairs that link all lines which share a band and agree in half of their minima.

    Each line of a bucket meets its first and last. What that links is contracted, and then all lines of a bucket that
    are still apart are compared."""
    near, agree = materialize(_buckets(sig, bands, rows), "near"), _agree(bands, rows)
    ends = near.where("h = lo or h = hi").select("band", F.col("h").alias("oh"), F.col("m").alias("om"))
    once = (F.col("h") != F.col("oh")) & ((F.col("oh") == F.col("lo")) | (F.col("h") != F.col("lo")))  # not from both ends
    stars = near.join(ends.hint("shuffle_hash"), "band").where(once & agree).select(F.least("h", "oh").alias("a"), F.greatest("h", "oh").alias("b"))
    pairs, texts = materialize(stars.distinct(), "pairs"), _texts(docs, near, place)
    edges = materialize(_verified(texts, pairs, size, percent), "edges")
    release(docs.sparkSession)
    large = near.where("n > 2")
    if large.isEmpty():
        discard(near, pairs, texts)
        return edges
    roots = components(edges, "hot")
    placed = large.join(roots.hint("shuffle_hash"), large["h"] == roots["node"], "left").select("band", "bands", "n", "h", F.coalesce("root", "h").alias("root"), "m")
    apart = placed.groupBy("band").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first < last").select("band")
    more = materialize(_within(placed.join(apart.hint("shuffle_hash"), "band", "left_semi"), texts, size, percent, bands, rows, block), "edges")
    discard(near, pairs, texts, roots)
    release(docs.sparkSession)
    return edges.union(more)


def shingles(raw: Column, size: int) -> Column:
    """Hashed character shingles of a line's UTF-8, in their order; the line itself if it is shorter. ``raw`` should be
    a stored column: it is read for the number of shingles and once for all of them."""
    # Bound to a variable, the line is copied out of its row once and not for each shingle.
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - size + 1, F.lit(1)))
    each = F.transform(F.array(raw), lambda r: F.transform(starts, lambda i: F.xxhash64(F.substring(r, i, F.lit(size)))))
    return F.get(each, F.lit(0))


def shingle_set(raw: Column, size: int) -> Column:
    """Distinct shingles() of a line."""
    return F.array_distinct(shingles(raw, size))


def _texts(docs: DataFrame, near: DataFrame, place: tuple[str, Column]) -> DataFrame:
    """h and raw (UTF-8) of the lines that share a bucket, taken from where each occurs first."""
    kind, base = place
    whole = F.shiftright("loc", 31) + base if kind == "long" else F.floor(F.col("loc") / (1 << 31)).cast("long")
    at = near.select("h", "loc").distinct().select("h", whole.alias("doc_id"), F.pmod(F.col("loc"), F.lit(1 << 31)).cast("int").alias("pos"))
    wanted = at.groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos")).alias("w")).hint("shuffle_hash")
    # Only texts with a wanted line are split, after the join; bound to a variable, their lines are made once.
    texts = docs.where("doc_id is not null").select("doc_id", "text").join(wanted, "doc_id")
    each = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform("w", lambda x: F.struct(x["h"].alias("h"), F.get(lines, x["pos"]).alias("line"))))
    taken = texts.select(F.inline(F.get(each, F.lit(0)))).select("h", plain(F.col("line")).alias("line"))
    return materialize(taken.where("line is not null and h = xxhash64(line)").groupBy("h").agg(F.min(F.encode("line", "UTF-8")).alias("raw")), "found")


def _verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose exact similarity over all character shingles is at least ``percent`` / 100."""
    left, right = (texts.select(F.col("h").alias(c), F.col("raw").alias(f"raw_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    # Generated, the sets are made once; a condition on selected columns would make them for each mention. The hashes are
    # selected before, since a generator that holds a lambda is not compiled, and its sets are then of boxed values.
    hashed = both.select("a", "b", shingles(F.col("raw_a"), size).alias("xa"), shingles(F.col("raw_b"), size).alias("xb"))
    sets = hashed.select("a", "b", F.inline(F.array(F.struct(F.array_distinct("xa").alias("sa"), F.array_distinct("xb").alias("sb")))))
    return sets.where(_alike("sa", "sb", percent)).select("a", "b")


def duplicate_lines(docs: DataFrame, size: int = 8, percent: int = 75, bands: int = 6, rows: int = 3, least: int = 20, small: int = 512) -> DataFrame:
    """doc_id and drop: the positions (from 0) of the lines of each document that go.

    With 6 bands of 3 rows a pair at the threshold of 0.75 is a candidate with probability 0.96, one of
    0.85 with 0.997. Every line of at least ``least`` bytes counts, whatever its length; shorter and
    blank ones stay. Rows without doc_id or text drop nothing. Rows that share a doc_id are one
    document, so the same positions go from each. Equal lines within a document are duplicates too.
    ``small`` (lines of a bucket that meet in one task) changes the work, never the result.
    """
    place = _place(docs)
    lines = _lines(docs, least, place)
    sig = materialize(signatures(lines, size, bands, rows), "sig")
    roots = components(_links(docs, sig, place, size, percent, bands, rows, small), "lines")
    # What is joined here has few rows, of a key each, and is looked up: all lines would else be sorted by it.
    known = sig.join(roots.hint("shuffle_hash"), sig["h"] == roots["node"], "left").where("n > 1 or root is not null").select("h", "loc", F.coalesce("root", "h").alias("root"))
    first = known.groupBy("root").agg(F.min("loc").alias("first"))
    keep = materialize(known.join(first.hint("shuffle_hash"), "root").select("h", "first"), "keep")
    gone = lines.select("doc_id", "pos", "h", "loc").join(keep.hint("shuffle_hash"), "h").where("loc <> first")
    out = materialize(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("drop")), "gone")
    discard(sig, roots, keep)
    return out


def dedup(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped", **options) -> DataFrame:
    """``docs`` with ``text`` without its duplicate lines, and its lines and dropped lines in ``n_lines`` and ``n_dropped``.

    See duplicate_lines() for which go. All rows stay, also repeated ones and those without a doc_id, and so do all
    other columns, but those that are called like the two new ones are replaced. A text that loses nothing is
    unchanged to the byte; one that loses all its lines is empty; null stays null with 0 lines. An empty table
    gives an empty result. Each line of a very long text is looked up at its place, at the same cost.
    """
    # One byte per line up to the last that goes, so that a line's fate is found at its place.
    marks = F.array_join(F.transform("drop", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get("drop", i - 1), F.lit(-1)) - 1), F.lit("1"))), "")
    rows = docs.drop(n_lines, n_dropped)
    id_, gone_, marks_ = (fresh(rows, c) for c in ("_gone_id", "_gone", "_marks"))
    gone = duplicate_lines(docs, **options).select(F.col("doc_id").alias(id_), F.size("drop").alias(gone_), F.encode(marks, "UTF-8").alias(marks_)).hint("shuffle_hash")
    rows = rows.join(gone, F.col("doc_id") == F.col(id_), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.substring(marks_, i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))), "\n")
    out = rows.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    out = out.withColumn(n_dropped, F.when(F.col("text").isNull() | F.col(gone_).isNull(), 0).otherwise(F.col(gone_)))
    return out.withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(kept)).drop(id_, gone_, marks_)
