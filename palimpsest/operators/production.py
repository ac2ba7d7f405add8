"""Production policies, specs and strategy selection as set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extant_specs(new_parents: DataFrame, dependence: DataFrame) -> DataFrame:
    """Extant policy. new_parents(new_version, parent): versions just committed and their parents;
    dependence(producer_version, dependency, relation): what producer versions used. Each producer
    version that used a parent is made anew with it replaced. Rows: new_version, producer_version, deps
    (sorted array of struct(relation, dependency))."""
    hit = dependence.join(new_parents, dependence["dependency"] == new_parents["parent"]).select("producer_version", "new_version", "parent").distinct()
    rows = hit.join(dependence, "producer_version")
    swapped = rows.select("new_version", "producer_version", F.struct("relation", F.when(F.col("dependency") == F.col("parent"), F.col("new_version")).otherwise(F.col("dependency")).alias("dependency")).alias("d"))
    return swapped.groupBy("new_version", "producer_version").agg(F.array_sort(F.collect_set("d")).alias("deps"))


def merge_specs(specs: DataFrame) -> DataFrame:
    """One production per dependency set: deps and its parents, sorted; null parents are dropped from the set."""
    return specs.groupBy("deps").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def leaf_bootstrap(dependencies: DataFrame, versions: DataFrame) -> DataFrame:
    """Producers without versions whose every dependency(producer, dependency) has exactly one version."""
    counts = versions.groupBy("artifact_id").agg(F.count("*").alias("n"))
    met = dependencies.join(counts, dependencies["dependency"] == counts["artifact_id"], "left").groupBy("producer").agg(F.bool_and(F.coalesce("n", F.lit(0)) == 1).alias("ok"))
    return met.where("ok").join(versions.select(F.col("artifact_id").alias("producer")), "producer", "left_anti").select("producer")


def tracking_specs(specs: DataFrame, tips: DataFrame) -> DataFrame:
    """Specs whose parent producer version made a current branch tip; tips(producer_version)."""
    return specs.join(tips, "producer_version", "left_semi")


def capability_match(inputs: DataFrame, allowed: DataFrame) -> DataFrame:
    """strategy, ok: whether every known input's representation is allowed; unknown inputs are accepted.
    inputs(case_id, name, representation), allowed(strategy, name, representations)."""
    rows = inputs.join(allowed, "name")
    return rows.groupBy("case_id", "strategy").agg(F.bool_and(F.array_contains("representations", F.col("representation"))).alias("ok"))


def select_strategy(outputs: DataFrame) -> DataFrame:
    """case_id, strategy, cost: the cheapest by the sum over outputs of the least weight (state 3, cumulative
    delta 2, delta 1), ties by name. outputs(case_id, strategy, output, representation)."""
    weight = F.when(F.col("representation") == "state", 3).when(F.col("representation") == "cumulative_delta", 2).otherwise(1)
    least = outputs.groupBy("case_id", "strategy", "output").agg(F.min(weight).alias("w"))
    cost = least.groupBy("case_id", "strategy").agg(F.sum("w").alias("cost"))
    best = cost.groupBy("case_id").agg(F.min(F.struct("cost", "strategy")).alias("x"))
    return best.select("case_id", F.col("x.strategy").alias("strategy"), F.col("x.cost").alias("cost"))


def stale_versions(dependence: DataFrame, parents: DataFrame) -> DataFrame:
    """version_id of versions that depend on one which has a child by now."""
    return dependence.join(parents.select(F.col("parent_id").alias("dependency")), "dependency", "left_semi").select(F.col("producer_version").alias("version_id")).distinct()
