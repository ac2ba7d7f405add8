import pytest

from palimpsest.model import DELTA, STATE, TABLES, Artifact, Edge, EngineError, HashMismatch, Hunk, Invalid, NotFound, StateOnly, Unfulfilled, Version, new_id
from palimpsest.plans import reads
from palimpsest.plans.demo import blob_rows, chain_graph, run_chain
from palimpsest.plans.engine import Engine, NegateBlobProducer, Producer, VersionGraph
from palimpsest.plans.graph import ArtifactGraph, Description, Existing
from palimpsest.registry import default_registry
from palimpsest.sources.store import Store, open_store, read_json, read_optional_json, write_json
from palimpsest.streaming import cascade


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    return run_chain(spark, f"file://{tmp_path_factory.mktemp('repo')}/r")


def test_production_chain(spark, chain):
    e, ids, done1, done2 = chain
    vg = e.versions
    versions = {n: sorted(vg.artifact_versions(ids[f"Test Blob {n}"]), key=lambda v: len(vg.ancestors(v))) for n in (1, 2, 3)}
    assert {n: len(v) for n, v in versions.items()} == {1: 2, 2: 2, 3: 2}
    want = {1: bytes(range(7)), 2: bytes([0, 7, 2, 3, 4, 5, 8])}
    for n in (1, 2, 3):
        for k in (1, 2):
            state = want[k] if n != 2 else bytes(255 - b for b in want[k])
            assert {r.partition_id: bytes(r.state) for r in e.blob_state(versions[n][k - 1]).collect()} == {0: state, 1: state}
    for k in (0, 1):
        assert vg.versions[versions[1][k]].hash == vg.versions[versions[3][k]].hash != vg.versions[versions[2][k]].hash
    assert vg.versions[versions[3][1]].representation == DELTA
    assert e.resolve("blobs/master/Test Blob 3") == versions[3][1] and e.resolve(f"#{versions[1][0]}") == versions[1][0]
    assert len(vg.artifact_versions(ids["blobs"])) == 4
    assert e.resolve("blobs/master:~3/Test Blob 3") == versions[3][0]
    with pytest.raises(NotFound):
        e.resolve("blobs/other/Test Blob 3")
    with pytest.raises(Invalid):
        e.create_branch(ids["blobs"], "master", versions[1][0])
    with pytest.raises(Invalid):
        e.commit(versions[1][0])


def test_reload_and_compact(spark, chain):
    e, ids, _, _ = chain
    again = Engine(spark, e.store.path)
    assert again.versions.versions == e.versions.versions and again.tips == e.tips and again.hunks == e.hunks
    tip = again.versions.tips(ids["Test Blob 1"])[0]
    assert {bytes(r.state) for r in again.compact(tip).collect()} == {bytes([0, 7, 2, 3, 4, 5, 8])}
    again.write_message(tip, "a note"), again.write_message(tip, None)
    assert Engine(spark, e.store.path).read_message(tip) == "a note"
    assert again.list_artifacts().count() == 8
    assert again.origin_root() == again.origin_root()


def test_stream_commits_requests(spark, chain, tmp_path):
    e, ids, _, _ = chain
    tip = e.versions.tips(ids["Test Blob 1"])[0]
    part = e.versions.partitioning(tip, e.graph)
    new = e.versions.new_child(tip, DELTA)
    e.versions.relations.add((part, new.uuid, "dtype", "Partitioning"))
    hunk = Hunk(new_id(), new.uuid, 1, DELTA)
    e.stage(new.uuid, [hunk], blob_rows(spark, [(hunk.uuid, DELTA, None, [0], b"\x09")]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(f'{{"version": "{new.uuid}"}}\n')
    q = cascade.run(e, cascade.commits(e, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.exception() is None and e.versions.versions[new.uuid].status == "committed"
    last = e.resolve("blobs/master/Test Blob 3")
    got = {r.partition_id: bytes(r.state) for r in e.blob_state(last).collect()}
    assert got[0][0] == 0 and got[1][0] == 9


def test_composition_errors(spark, chain):
    e, ids, _, _ = chain
    lone = e.versions.add(Version(new_id(), ids["Test Blob 1"], DELTA))
    h = Hunk(new_id(), lone.uuid, 0, DELTA)
    e.stage(lone.uuid, [h], None)
    with pytest.raises(Unfulfilled):
        e.composition(lone.uuid, {0})
    assert e.composition(lone.uuid, {7}) == {}
    with pytest.raises(Invalid):
        e.stage(e.versions.add(Version(new_id(), ids["Test Blob 1"], STATE)).uuid, [Hunk(new_id(), "x", 0, DELTA)], None)


def test_version_graph():
    vg = VersionGraph()
    a = vg.add(Version("a", "art"))
    b, c = vg.new_child("a", DELTA), vg.new_child("a", DELTA)
    vg.relations.add(("z", "a", "dtype", "d"))
    m = vg.new_child(b.uuid, DELTA, same_dependencies=True)
    vg.parents.add((c.uuid, m.uuid))
    assert vg.tips("art") == [m.uuid] and vg.get_parents(m.uuid) == sorted([b.uuid, c.uuid])
    assert vg.ancestors(m.uuid)[0] == m.uuid and vg.ancestors(m.uuid)[-1] == a.uuid


def test_origin_is_a_graph_that_can_be_read(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/o")
    origin, root = e.origin_root()
    again = Engine(spark, e.store.path)
    assert again.origin_root() == (origin, root)
    version = again.versions.tips(origin)[0]
    assert again.versions.versions[version].status == "committed" and list(again.composition(version)) == [0]
    held = again.graph_at(version)
    assert {a.name for a in held.artifacts.values()} == {"origin", "root", "Unary Partitioning Singleton"} and held.verify_hash()
    assert again.versions.versions[version].hash == held.hash and again.graph_at(again.versions.tips(root)[0]).artifacts == {}
    assert again.state_interface(again.versions.partitioning(version, again.graph), "Partitioning") == [0]
    with pytest.raises(Invalid):
        again._tie_off(version, "other")


def test_graphs_are_versioned(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/g")
    root = e.origin_root()[1]
    ids = {n: new_id() for n in "abc"}
    art = lambda n: Artifact(ids[n], "Blob", n)
    g = ArtifactGraph({ids["a"]: art("a"), ids["b"]: art("b")}, {Edge(ids["a"], ids["b"], "dtype", "x")})
    called = []
    e.on_init["Blob"] = lambda a: called.append(a.name)
    v1 = e.create_graph(g, "mine")
    assert sorted(called) == ["a", "b"] and e.versions.versions[v1].status == "committed"
    v2 = e.change_graph(v1, [art("c")], [Edge(ids["b"], ids["c"], "dtype", "y")])
    v3 = e.change_graph(v2, removals=[ids["c"]])
    v4 = e.change_graph(v3, [art("c")])
    with pytest.raises(HashMismatch):
        e.change_graph(v2, removals=[ids["b"]])
    again = Engine(spark, e.store.path)
    names = lambda v: "".join(sorted(a.name for a in again.graph_at(v).artifacts.values()))
    assert [names(v) for v in (v1, v2, v3, v4)] == ["ab", "abc", "ab", "abc"]
    assert len(again.graph_at(v2).edges) == 2 and len(again.graph_at(v4).edges) == 1
    assert again.graph_at(v1).hash == g.hash == again.graph_at(v3).hash != again.graph_at(v4).hash
    assert again.versions.versions[v3].hash == g.hash
    made = [a.name for a in again.graph_at(again.versions.tips(root)[0]).artifacts.values()]
    assert "mine" in made and again.graph.artifacts.keys() == e.graph.artifacts.keys() and ids["c"] in e.graph.artifacts
    assert {r.name for r in again.list_artifacts().collect()} >= {"a", "b", "c", "mine", "origin", "root"}


def test_a_cascade_is_committed_whole_or_not_at_all(spark, tmp_path):
    class Breaks(Producer):
        dtype = "NegateBlobProducer"
        strategies = NegateBlobProducer.strategies
        on = True

        def produce(self, engine, version, strategy):
            out = NegateBlobProducer.produce(self, engine, version, strategy)
            if Breaks.on and engine.graph.get(engine.versions.versions[version].artifact).name == "Test Producer 2":
                raise RuntimeError("lost")
            return out

    e = Engine(spark, f"file://{tmp_path}/a", producers=())
    e.producers["NegateBlobProducer"] = Breaks()
    g, ids = chain_graph()
    e.add_graph(g)
    parts = e.versions.add(Version(new_id(), ids["Arbitrary Partitioning"]))
    e.stage(parts.uuid, [], None, partition_ids=[0])
    e.commit(parts.uuid)
    first = e.versions.add(Version(new_id(), ids["Test Blob 1"]))
    e.versions.relations.add((parts.uuid, first.uuid, "dtype", "Partitioning"))
    hunk = Hunk(new_id(), first.uuid, 0, STATE)
    e.stage(first.uuid, [hunk], blob_rows(spark, [(hunk.uuid, STATE, b"\x00\x01", None, None)]))
    before = e.store.transactions()
    with pytest.raises(RuntimeError):
        e.commit(first.uuid)
    assert e.store.transactions() == before and e.versions.versions[first.uuid].status == "staging" and not e.versions.artifact_versions(ids["Test Blob 2"])
    Breaks.on = False
    done = e.commit(first.uuid)
    assert len(e.store.transactions()) == len(before) + 1 and len(done) > 3
    last = Engine(spark, e.store.path)
    assert {bytes(r.state) for r in last.blob_state(last.versions.tips(ids["Test Blob 3"])[0]).collect()} == {b"\x00\x01"}
    rows, edges = reads.version(last.store, first.uuid)
    assert [r.status for r in rows.collect()] == ["committed"] and edges.where("name = 'input'").count() == 1
    assert reads.relations(last.store, [first.uuid], "in").count() == 1
    versions, into = reads.version_graph(last.store, [ids["Test Blob 1"], ids["Test Blob 2"]])
    assert versions.count() == 2 and into.where("name = 'output'").count() == 1
    made, held = reads.for_policies(last.store, first.uuid, ids["Test Producer 1"], [ids["Test Blob 1"]], {"leaf_bootstrap"})
    assert made.count() == 1 == held.count()
    made, held = reads.for_policies(last.store, first.uuid, ids["Test Producer 1"], [ids["Test Blob 1"]], {"extant"})
    assert made.count() == 0 == held.count() and reads.needs(set()) == (0, 0) and reads.needs({"extant", "leaf_bootstrap"}) == (2, 2)


def test_two_writers_and_half_written_entries(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/s")
    a.init(default_registry())
    b = Store(spark, a.path)
    with pytest.raises(EngineError), a.transaction():
        a.commit({"message": [("v", "mine")]})
        b.commit({"message": [("v", "theirs")]})
    assert [r.message for r in b.read("message").collect()] == ["theirs"]
    (tmp_path / "s/_log/7.json").write_text('{"folders"')
    assert 7 not in b.transactions()
    b.commit({"message": [("v", "later")]})
    assert [r.message for r in b.read("message").orderBy("txn").collect()] == ["theirs", "later"] and 8 in b.transactions()
    b.commit({"schema_version": [(99,)]})
    with pytest.raises(Invalid):
        b.init(default_registry())


def test_memory_store_urls_and_json(spark, tmp_path):
    e, ids, _, _ = run_chain(spark, "memory:")
    assert e.blob_state(e.resolve("blobs/master/Test Blob 3")).count() == 2
    with pytest.raises(Invalid):
        open_store(spark, "postgres://host/db")
    assert type(open_store(spark, str(tmp_path))) is Store
    rows = e.store.read("blob").drop("txn")
    write_json(rows, f"file://{tmp_path}/j")
    assert sorted(map(repr, read_json(spark, f"file://{tmp_path}/j", TABLES["blob"]).collect())) == sorted(map(repr, rows.collect()))
    assert read_optional_json(spark, f"file://{tmp_path}/none", TABLES["blob"]) is None
    with pytest.raises(StateOnly):
        reads.states_only(spark.createDataFrame([("delta",)], "representation string"))


def test_descriptions():
    a, b = Artifact("1", "Blob", "a"), Artifact("2", "Blob", "b")
    state = Description({"a": a, "b": b}, {Edge("a", "b", "dtype", "x")})
    assert state.is_independent() and state.is_valid_state() and state.graph().hash == Description({"p": b, "q": a}, {Edge("q", "p", "dtype", "x")}).graph().hash
    more = Description({"old": Existing("2"), "c": Artifact("3", "Blob", "c")}, {Edge("old", "c", "dtype", "y")})
    assert not more.is_independent() and more.is_valid_payload() and not more.is_valid_state()
    assert not Description({"old": Existing("2"), "c": Artifact("3", "Blob")}, {Edge("c", "old", "dtype", "y")}).is_valid_payload()
    assert not Description({"c": Artifact("", "Blob")}).is_valid_payload()
    whole = state.compose(more)
    assert whole == Description({"x": a, "y": b, "z": Artifact("3", "Blob", "c")}, {Edge("x", "y", "dtype", "x"), Edge("y", "z", "dtype", "y")}) != state
    assert whole.compose(Description(), ["3"]) == state
    with pytest.raises(NotFound):
        state.compose(Description({"old": Existing("9")}))
    with pytest.raises(Invalid):
        more.graph()


def test_cumulative_and_precedence_compose_alike(spark, tmp_path):
    """The fold over all partitions gives what the walk over one gives."""
    import random

    e, rnd = Engine(spark, f"file://{tmp_path}/c"), random.Random(5)
    g = ArtifactGraph()
    unary = g.add_unary_partitioning()
    blob = Artifact(new_id(), "Blob", "b")
    g.artifacts[blob.uuid] = blob
    g.add_uniform_partitioning(unary)
    e.add_graph(g)
    chain = [e.versions.add(Version(new_id(), blob.uuid, DELTA)).uuid]
    for _ in range(6):
        chain.append(e.versions.new_child(chain[-1], DELTA).uuid)
    for k, v in enumerate(chain):
        hunks = []
        for p in range(12):
            kind = STATE if k == 0 else rnd.choice([STATE, DELTA, DELTA, "cumulative_delta"])
            if k == 0 or rnd.random() < 0.7:
                hunks.append(Hunk(new_id(), v, p, kind, precedence=rnd.choice([None, None, chain[rnd.randrange(k)]]) if k and kind != STATE else None))
        e.stage(v, hunks, None)
    want = {(h.uuid, p) for p, hunks in e.composition(chain[-1], set(range(12))).items() for h in hunks}
    assert {(r.hunk, r.partition_id) for r in e.composition_rows(chain[-1], set(range(12))).collect()} == want


def test_conflicts_between_two_lines(spark, tmp_path):
    e = Engine(spark, "memory:")
    g = ArtifactGraph()
    unary = g.add_unary_partitioning()
    blob = Artifact(new_id(), "Blob", "b")
    g.artifacts[blob.uuid] = blob
    g.add_uniform_partitioning(unary)
    e.add_graph(g)
    base = e.versions.add(Version(new_id(), blob.uuid, DELTA)).uuid
    a1, b1 = (e.versions.new_child(base, DELTA).uuid for _ in "ab")
    a2 = e.versions.new_child(a1, DELTA).uuid
    for v, parts in ((base, [0, 1, 2, 3]), (a1, [0, 1]), (a2, [1, 3]), (b1, [1, 2, 3])):
        e.stage(v, [Hunk(new_id(), v, p, DELTA) for p in parts], None)
    assert e.common_ancestors(a2, b1) == [base] and e.common_ancestors(a2, a1) == [a1]
    assert e.conflicts(a2, b1) == {1: ([a2, a1], [b1]), 3: ([a2], [b1])} and e.conflicts(a2, a1) == {}


def test_command_line(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    assert main(["init", f"file://{tmp_path}/r"]) == 0 == main(["ls", f"file://{tmp_path}/r", "--origin"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert sorted(x.split(" ", 2)[2] for x in lines) == ["Unary Partitioning Singleton UnaryPartitioning", "origin ArtifactGraph", "root ArtifactGraph"]
    assert main(["ls", f"file://{tmp_path}/r"]) == 0 and "root" in capsys.readouterr().out
