import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.specifiers import ArtifactSpecifier, BranchRevision, Revision, UuidSpecifier, VersionSpecifier, parse_columns, revision_path
from palimpsest.model import DELTA, STATE, Artifact, BlobDelta, Edge, HashMismatch, Hunk, Invalid, NotFound, Spec, SpecifierFormat
from palimpsest.operators import compose, production
from palimpsest.plans.graph import ArtifactGraph, toposort
from palimpsest.registry import Cardinality, default_registry


def test_specifiers():
    assert [revision_path(x) for x in ("", "HEAD", "head", "squash")] == ["HEAD", "HEAD", "HEAD", "squash"]
    assert Revision.parse("~3") == Revision("HEAD", -3) and Revision.parse("squash~1") == Revision("squash", -1)
    assert UuidSpecifier.parse("f3b4958c-52a1-11e7-802a-010203040506").complete and not UuidSpecifier.parse("abcd1").complete
    assert ArtifactSpecifier.parse("#abcd1").uuid.text == "abcd1" and ArtifactSpecifier.parse("abcd1").name == "abcd1"
    assert BranchRevision.parse("master:squash~1") == BranchRevision("master", Revision("squash", -1))
    v = VersionSpecifier.parse("all/master:squash~1/data")
    assert (v.ref.name, v.branch.branch, v.artifact.name) == ("all", "master", "data")
    for bad in ("a~1~2", "a~x"):
        with pytest.raises(SpecifierFormat):
            Revision.parse(bad)
    for bad in ("name", "a/b", "a/b:c:d/e"):
        with pytest.raises(SpecifierFormat):
            VersionSpecifier.parse(bad)


def test_specifier_columns(spark):
    cases = {"#abcd1": ("uuid", "abcd1", None, 0), "all/master:squash~1/data": ("branch", None, "squash", -1), "r/b/a": ("branch", None, "HEAD", 0), "a/b": ("error", None, None, 0), "a/b~1~2/c": ("branch", None, "HEAD", 0)}
    df = spark.createDataFrame([(k,) for k in cases], "spec string")
    got = {r.spec: r for r in df.select("spec", *(c.alias(n) for n, c in parse_columns(F.col("spec")).items())).collect()}
    for k, (kind, prefix, path, _) in cases.items():
        assert (got[k].kind, got[k].uuid_prefix, got[k].path) == (kind, prefix, path)
    assert got["all/master:squash~1/data"].revision_offset == -1


def test_hunk_validity():
    assert Hunk("h", "v", 0, STATE).is_valid(STATE) and not Hunk("h", "v", 0, DELTA).is_valid(STATE)
    assert not Hunk("h", "v", 0, STATE, precedence="w").is_valid(STATE) and Hunk("h", "v", 0, STATE, precedence="w").is_valid(DELTA)
    assert not Hunk("h", "v", 0, DELTA).is_valid("cumulative_delta")


def test_blob_delta(spark):
    state = bytes(range(7))
    assert BlobDelta((1, 6), b"\7\10").apply(state) == bytes([0, 7, 2, 3, 4, 5, 8])
    assert BlobDelta((1, 1, 2), b"\7\10").apply(state)[1] == 8
    with pytest.raises(Invalid):
        BlobDelta((9,), b"\1").apply(state)
    df = spark.createDataFrame([(bytearray(state), [1, 6], bytearray([7, 8])), (bytearray(state), [1, 1, 2], bytearray([7, 8])), (bytearray(state), [], bytearray())], "s binary, i array<long>, b binary")
    got = [bytes(r.x) for r in df.select(compose.blob_compose(F.col("s"), F.col("i"), F.col("b")).alias("x")).collect()]
    assert got == [BlobDelta((1, 6), b"\7\10").apply(state), BlobDelta((1, 1), b"\7\10").apply(state), state]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(bytearray(state), [7], bytearray([1]))], "s binary, i array<long>, b binary").select(compose.blob_compose(F.col("s"), F.col("i"), F.col("b"))).collect()


def test_spec_map():
    a, b, c = (0, 0), (1, 1), (2, 0)
    one, two = Spec(), Spec()
    one.insert(frozenset({a, b}), 0), one.insert(frozenset({a, b}), None), one.insert(frozenset({c, b}), 1)
    two.insert(frozenset({c, b}), 2)
    one.merge(two)
    assert one.specs == {frozenset({a, b}): {0, None}, frozenset({c, b}): {1, 2}}
    assert one.retain(lambda _, p: p == 2).specs == {frozenset({c, b}): {2}}


def test_capability(spark):
    allowed = spark.createDataFrame([("s", "a", ["state"]), ("s", "b", ["state", "delta"])], "strategy string, name string, representations array<string>")
    rows = [(0, n, r) for n, r in (("a", "state"), ("b", "state"), ("b", "delta"), ("c", "cumulative_delta"))] + [(1, "a", "delta"), (1, "b", "state")]
    got = production.capability_match(spark.createDataFrame(rows, "case_id int, name string, representation string"), allowed).collect()
    assert {r.case_id: r.ok for r in got} == {0: True, 1: False}


def test_precedence_hand_cases(spark):
    cases = {0: ([("delta", 3), ("delta", None), ("delta", None), ("delta", None), ("state", None), ("delta", None)], [0, 3, 4], True), 1: ([("delta", None), ("state", None), ("state", None)], [0, 1], True), 2: ([("delta", 9), ("state", None)], [0], False)}
    rows = [(k, i, r, p) for k, (hunks, _, _) in cases.items() for i, (r, p) in enumerate(hunks)]
    got = compose.composition_with_precedence(spark.createDataFrame(rows, "k int, ord int, representation string, prec int"), ["k"]).collect()
    assert {r.k: (r.kept, r.done) for r in got} == {k: (kept, done) for k, (_, kept, done) in cases.items()}


def test_cumulative_skips_to_the_state(spark):
    rows = [(0, 5, "delta"), (0, 4, "cumulative_delta"), (0, 3, "delta"), (0, 2, "state"), (0, 1, "state")]
    got = compose.composition_map(spark.createDataFrame(rows, "k int, seq int, representation string"), ["k"], "seq").orderBy("ord").collect()
    assert [r.seq for r in got] == [5, 4, 2]


def test_random_histories_against_a_fold(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        hunks = [(s, "state" if s == 0 else rnd.choice(["state", "delta", "delta", "cumulative_delta"])) for s in range(rnd.randint(1, 9))]
        rows += [(k, s, r) for s, r in hunks]
        kept, cumulative = [], False
        for s, r in reversed(hunks):
            if cumulative and r != "state":
                continue
            kept.append(s)
            cumulative |= r == "cumulative_delta"
            if r == "state":
                break
        want[k] = kept
    got: dict = {}
    for r in compose.composition_map(spark.createDataFrame(rows, "k int, seq int, representation string"), ["k"], "seq").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append(r.seq)
    assert got == want


def test_graph_hash_delta_and_errors():
    g = ArtifactGraph({i: Artifact(i, "Blob", n) for i, n in (("1", "a"), ("2", "b"), ("3", "c"))})
    g.add_edge(Edge("1", "2", "dtype", "x")), g.add_edge(Edge("2", "3", "dtype", "x"))
    s = g.sealed()
    assert s.verify_hash()
    renamed = ArtifactGraph({"9" + i: Artifact("9" + i, "Blob", a.name) for i, a in g.artifacts.items()}, {Edge("9" + e.source, "9" + e.dependent, e.edge_type, e.name) for e in g.edges})
    assert renamed.hash == g.hash and renamed != g
    assert set(s.apply_delta(removals=["3"]).artifacts) == {"1", "2"}
    with pytest.raises(HashMismatch):
        s.apply_delta(removals=["1"])
    with pytest.raises(NotFound):
        s.apply_delta(removals=["8"])
    with pytest.raises(Invalid):
        g.add_edge(Edge("1", "2", "producer", "y"))
    with pytest.raises(Invalid):
        toposort("ab", [("a", "b"), ("b", "a")])
    p = g.add_unary_partitioning()
    g.add_uniform_partitioning(p)
    assert g.related(p, "dtype", "Partitioning") == ["1", "2", "3"] and g.unary_partitioning() == p and g.find_by_name("b") == "2"


def test_registry():
    r = default_registry()
    assert r.implements("TrackingBranchProducer", "Producer") and not r.implements("Blob", "Producer")
    assert r.get_by_uuid(r.get("Blob").uuid).name == "Blob"
    with pytest.raises(NotFound):
        r.get("nothing")
    assert Cardinality(1, 1).allows(1) and not Cardinality(1, 1).allows(2) and Cardinality(0, None).allows(99)
    with pytest.raises(Invalid):
        r.validate("NegateBlobProducer", {"input": 2})
