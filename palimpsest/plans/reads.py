"""Reads of versions from a store, of no more rows than are asked for: filters reach the files, and both directions
of a relation are two equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELTA, POLICY_NEEDS, Need, StateOnly
from ..operators import lineage
from ..sources.store import Store


def _list(store: Store, ids: list[str], column: str) -> DataFrame:
    return store.spark.createDataFrame([(i,) for i in ids], f"{column} string")


def versions(store: Store, ids: list[str]) -> DataFrame:
    """The last row of each version."""
    return lineage.latest(store.read("version").join(_list(store, ids, "uuid"), "uuid", "left_semi"), ["uuid"], ["txn"]).drop("txn")


def versions_of(store: Store, artifacts: list[str]) -> DataFrame:
    """The last rows of all versions of artifacts."""
    return lineage.latest(store.read("version").join(_list(store, artifacts, "artifact"), "artifact", "left_semi"), ["uuid"], ["txn"]).drop("txn")


def relations(store: Store, ids: list[str], direction: str = "both") -> DataFrame:
    """source, dependent, edge_type, name of the edges of versions: what leads to them (``in``), from them (``out``)
    or both; an edge to a parent has the type ``parent``."""
    of = _list(store, ids, "id")
    parents = store.read("version_parent").select(F.col("parent").alias("source"), F.col("child").alias("dependent"), F.lit("parent").alias("edge_type"), F.lit("parent").alias("name"))
    edges = store.read("version_relation").select("source", "dependent", "edge_type", "name").union(parents)
    into, out = (edges.join(of, edges[c] == of["id"], "left_semi") for c in ("dependent", "source"))
    return {"in": into, "out": out}.get(direction, into.union(out)).distinct()


def version(store: Store, id_: str) -> tuple[DataFrame, DataFrame]:
    """A version's row and all its edges, one step far."""
    return versions(store, [id_]), relations(store, [id_])


def version_graph(store: Store, artifacts: list[str]) -> tuple[DataFrame, DataFrame]:
    """All versions of a graph's artifacts and what leads to them."""
    rows = versions_of(store, artifacts)
    of = rows.select(F.col("uuid").alias("id"))
    parents = store.read("version_parent").select(F.col("parent").alias("source"), F.col("child").alias("dependent"), F.lit("parent").alias("edge_type"), F.lit("parent").alias("name"))
    edges = store.read("version_relation").select("source", "dependent", "edge_type", "name").union(parents)
    return rows, edges.join(of, edges["dependent"] == of["id"], "left_semi").distinct()


def needs(policies: set[str]) -> tuple[Need, Need]:
    """What a producer's policies need together, of its own versions and of those of its dependencies."""
    found = [POLICY_NEEDS[p] for p in policies] or [(0, 0)]
    return Need(max(a for a, _ in found)), Need(max(b for _, b in found))


def for_policies(store: Store, new: str, producer: str, dependencies: list[str], policies: set[str]) -> tuple[DataFrame, DataFrame]:
    """producer versions and dependency versions that the policies of ``producer`` need to see of a new version.

    Related producer versions are those that used a parent of it; related dependency versions those that the producer
    versions used."""
    own, other = needs(policies)
    made = versions_of(store, [producer])
    used = store.read("version_relation").select("source", "dependent")
    if own is Need.RELATED:
        parents = store.read("version_parent").where(F.col("child") == new).select(F.col("parent").alias("source"))
        made = made.join(used.join(parents, "source", "left_semi").select(F.col("dependent").alias("uuid")), "uuid", "left_semi")
    elif own is Need.NONE:
        made = made.where("false")
    held = versions_of(store, dependencies)
    if other is Need.RELATED:
        held = held.join(used.join(made.select(F.col("uuid").alias("dependent")), "dependent", "left_semi").select(F.col("source").alias("uuid")), "uuid", "left_semi")
    elif other is Need.NONE:
        held = held.where("false")
    return made, held


def states_only(hunks: DataFrame) -> DataFrame:
    """Composition of a datatype without deltas: its states; a delta is an error."""
    if not hunks.where(F.col("representation") == DELTA).isEmpty():
        raise StateOnly("a delta of a datatype that has states alone")
    return hunks
