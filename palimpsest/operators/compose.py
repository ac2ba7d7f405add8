"""Hunks, composition and payloads as set operations over all partitions and artifacts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CUMULATIVE, DELTA, STATE


def hunk_is_valid(version: Column, hunk: Column, precedence: Column) -> Column:
    return F.when(version == STATE, (hunk == STATE) & precedence.isNull()).when(version == CUMULATIVE, hunk != DELTA).otherwise(F.lit(True))


def composition_map(hunks: DataFrame, keys: list[str], order: str, cumulative: bool = True) -> DataFrame:
    """Hunks that make up each group of ``keys``: from the newest (largest ``order``) down to the first state,
    with ``ord`` counted from the newest. After a cumulative delta only the state counts. Input holds
    the hunks of the wanted version and its ancestors alone. One shuffle on ``keys``, no join."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    newer = newest.rowsBetween(Window.unboundedPreceding, -1)
    n = lambda kind: F.coalesce(F.count(F.when(F.col("representation") == kind, 1)).over(newer), F.lit(0))
    rows = hunks.withColumn("states", n(STATE)).withColumn("cumulatives", n(CUMULATIVE)).withColumn("ord", F.row_number().over(newest) - 1)
    keep = F.col("states") == 0
    if cumulative:
        keep &= (F.col("cumulatives") == 0) | (F.col("representation") == STATE)
    return rows.where(keep).drop("states", "cumulatives")


def composition_with_precedence(hunks: DataFrame, keys: list[str], cumulative: bool = False) -> DataFrame:
    """As composition_map for a group's hunks(ord, representation, prec): a kept hunk with ``prec`` locks the
    group until that ord is reached, and, if so asked, after a cumulative delta only the state counts. Rows: keys, kept (ords), done (false: unfulfilled or lock never
    reached). It is a fold over hunk metadata; payloads are not touched."""
    rows = hunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "representation", "prec"))).alias("rows"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("bigint").alias("lock"), F.lit(False).alias("done"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        skip = acc["done"] | (x["ord"] < acc["lock"]) | (acc["over"] & (x["representation"] != STATE))
        over = acc["over"] | (F.lit(cumulative) & (x["representation"] == CUMULATIVE))
        return F.when(skip, acc).otherwise(F.struct(F.array_append(acc["kept"], x["ord"].cast("bigint")).alias("kept"), F.when(x["representation"] == STATE, F.lit(0)).otherwise(F.coalesce(x["prec"], F.lit(0))).cast("bigint").alias("lock"), (x["representation"] == STATE).alias("done"), over.alias("over")))

    folded = rows.withColumn("f", F.aggregate("rows", start, step))
    return folded.select(*keys, F.col("f.kept").alias("kept"), F.col("f.done").alias("done"))


def unfulfilled(composition: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that have deltas but no state below them."""
    return composition.groupBy(*keys).agg(F.max((F.col("representation") == STATE).cast("int")).alias("s")).where("s = 0").select(*keys)


def composite_state(composition: DataFrame, payloads: DataFrame, on: list[str], keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """State of a keyed table: per key the value of the newest hunk that has it; a null value removes the key.

    The metadata side names the hunks to read; values are combined before the shuffle."""
    rows = payloads.join(composition.select(*dict.fromkeys([*on, *keys, "ord"])), on)
    newest = rows.groupBy(*keys, key).agg(F.min_by(F.struct(value), "ord").alias("x"))
    return newest.select(*keys, key, F.col(f"x.{value}").alias(value)).where(F.col(value).isNotNull())


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, old, new, change (added, removed, changed) between two states; equal entries are left out."""
    a = old.select(*keys, F.col(value).alias("old"))
    b = new.select(*keys, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change)


def merge_conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, ours, theirs, same: the entries that both lines have changed since ``base`` (null: removed), and whether
    they agree. Entries that one line alone has changed are merged without a conflict and left out."""
    changed = lambda x, name: version_diff(base, x, keys, value).select(*keys, F.col("new").alias(name))
    return changed(ours, "ours").join(changed(theirs, "theirs"), keys).withColumn("same", F.col("ours").eqNullSafe(F.col("theirs")))


def blob_compose(state: Column, indices: Column, data: Column) -> Column:
    """Put data's bytes at indices; the shorter rules, of equal indices the last, an index outside is an error."""
    n = F.least(F.size(indices), F.octet_length(data))
    pairs = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.element_at(indices, i).alias("i"), F.substring(data, i, F.lit(1)).alias("b")))
    return F.aggregate(pairs, state, lambda acc, p: F.when((p["i"] >= 0) & (p["i"] < F.octet_length(acc)), F.overlay(acc, p["b"], (p["i"] + 1).cast("int"), F.lit(1))).otherwise(F.raise_error(F.lit("blob index out of range")).cast("binary")))


def blob_negate(blob: Column) -> Column:
    return F.unhex(F.translate(F.hex(blob), "0123456789ABCDEF", "FEDCBA9876543210"))


def payload_hash(kind: str | Column, *columns: Column) -> Column:
    return F.xxhash64(F.lit(kind) if isinstance(kind, str) else kind, *columns)


def version_hash(hunks: DataFrame, version: str = "version_id") -> DataFrame:
    """Content hash of each version: its hunks' hashes in ascending partition order."""
    return hunks.groupBy(version).agg(F.xxhash64(F.to_json(F.array_sort(F.collect_list(F.struct("partition_id", "hash"))))).alias("hash"))
