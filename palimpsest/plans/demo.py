"""A small production chain: blob 1 -> negate -> blob 2 -> negate -> blob 3, with a branch that tracks all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CUSTOM, DELTA, DTYPE, LEAF_BOOTSTRAP, PARTITIONING, PRODUCER, STATE, Artifact, Edge, Hunk, Version, new_id
from ..sources.store import shared_folder
from .engine import Engine
from .graph import ArtifactGraph


def chain_graph() -> tuple[ArtifactGraph, dict[str, str]]:
    kinds = {"Test Blob 1": "Blob", "Test Blob 2": "Blob", "Test Blob 3": "Blob", "Test Producer 1": "NegateBlobProducer", "Test Producer 2": "NegateBlobProducer", "Arbitrary Partitioning": "ArbitraryPartitioning", "TBP": "TrackingBranchProducer", "blobs": "Ref"}
    ids = {n: new_id() for n in kinds}
    g = ArtifactGraph({ids[n]: Artifact(ids[n], k, n) for n, k in kinds.items()})
    blobs = [ids[f"Test Blob {i}"] for i in (1, 2, 3)]
    for i in (1, 2):
        g.add_edge(Edge(blobs[i - 1], ids[f"Test Producer {i}"], PRODUCER, "input"))
        g.add_edge(Edge(ids[f"Test Producer {i}"], blobs[i], PRODUCER, "output"))
    for b in blobs:
        g.add_edge(Edge(b, ids["TBP"], PRODUCER, "tracked"))
        g.add_edge(Edge(b, ids["blobs"], DTYPE, "ref"))
    g.add_edge(Edge(ids["TBP"], ids["blobs"], PRODUCER, "output"))
    for n in (*blobs, ids["Test Producer 1"], ids["Test Producer 2"]):
        g.add_edge(Edge(ids["Arbitrary Partitioning"], n, DTYPE, PARTITIONING))
    return g, ids


def blob_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "hunk string, kind string, state binary, indices array<long>, bytes binary")


def run_chain(spark: SparkSession, path: str) -> tuple[Engine, dict[str, str], list[str], list[str]]:
    e = Engine(spark, path)
    g, ids = chain_graph()
    e.add_graph(g)
    e.set_policies(ids["TBP"], {LEAF_BOOTSTRAP, CUSTOM})
    vg = e.versions
    parts = vg.add(Version(new_id(), ids["Arbitrary Partitioning"]))
    e.stage(parts.uuid, [], None, partition_ids=[0, 1])
    e.commit(parts.uuid)
    first = vg.add(Version(new_id(), ids["Test Blob 1"]))
    vg.relations.add((parts.uuid, first.uuid, DTYPE, PARTITIONING))
    hunks = [Hunk(new_id(), first.uuid, p, STATE) for p in (0, 1)]
    e.stage(first.uuid, hunks, blob_rows(spark, [(h.uuid, STATE, bytes(range(7)), None, None) for h in hunks]))
    done1 = e.commit(first.uuid)
    second = vg.new_child(first.uuid, DELTA)
    vg.relations.add((parts.uuid, second.uuid, DTYPE, PARTITIONING))
    hunks = [Hunk(new_id(), second.uuid, p, DELTA) for p in (0, 1)]
    e.stage(second.uuid, hunks, blob_rows(spark, [(h.uuid, DELTA, None, [1, 6], bytes([7, 8])) for h in hunks]))
    return e, ids, done1, e.commit(second.uuid)


def blob_chain(spark: SparkSession) -> DataFrame:
    e, ids, _, _ = run_chain(spark, f"{shared_folder(spark)}/chain-{new_id()}")
    out = None
    for n in (1, 2, 3):
        for k, v in enumerate(sorted(e.versions.artifact_versions(ids[f"Test Blob {n}"]), key=lambda v: len(e.versions.ancestors(v)))):
            one = e.blob_state(v).select(F.lit(n).alias("blob"), F.lit(k + 1).alias("version"), "partition_id", F.hex("state").alias("state"))
            out = one if out is None else out.union(one)
    return out
