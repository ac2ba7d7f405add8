"""Artifact graph on the driver: descriptions, deltas, content hashes, lookups and orders."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from heapq import heapify, heappop, heappush

from ..model import DTYPE, PARTITIONING, Artifact, Edge, HashMismatch, Invalid, NotFound, new_id


def content_hash(artifact: Artifact, parents: Iterable[int]) -> int:
    """f(sorted parent hashes, dtype, name, self_partitioning); ids play no part."""
    text = f"{sorted(parents)}|{artifact.dtype}|{artifact.name}|{artifact.self_partitioning}"
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big", signed=True)


def toposort(nodes: Iterable[str], edges: Iterable[tuple[str, str]], sources: Iterable[str] | None = None) -> list[str]:
    """Nodes reachable from ``sources`` (all without), each after all that lead to it; ties by node."""
    nodes, onward = set(nodes), {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    if sources is not None:
        seen, todo = set(sources), list(sources)
        while todo:
            for b in onward.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        nodes &= seen
    waiting = dict.fromkeys(nodes, 0)
    for a in nodes:
        for b in onward.get(a, ()):
            if b in nodes:
                waiting[b] += 1
    ready, out = [n for n, k in waiting.items() if not k], []
    heapify(ready)
    while ready:
        at = heappop(ready)
        out.append(at)
        for b in onward.get(at, ()):
            if b in nodes:
                waiting[b] -= 1
                if not waiting[b]:
                    heappush(ready, b)
    if len(out) != len(nodes):
        raise Invalid("the graph has a cycle")
    return out


@dataclass(frozen=True)
class Existing:
    """A node of a description that names an artifact of the graph that the description will be put into."""

    uuid: str


@dataclass
class Description:
    """What a graph is made of, or what is put into one: new artifacts (by a key; their uuid is empty as long as
    they have none), existing ones, and edges between keys."""

    nodes: dict[str, Artifact | Existing] = field(default_factory=dict)
    edges: set[Edge] = field(default_factory=set)

    def is_independent(self) -> bool:
        """It names no existing node."""
        return not any(isinstance(n, Existing) for n in self.nodes.values())

    def is_valid_payload(self) -> bool:
        """Every new node has an id, and no edge leads to an existing one."""
        ids = all(isinstance(n, Existing) or n.uuid for n in self.nodes.values())
        return ids and not any(isinstance(self.nodes[e.dependent], Existing) for e in self.edges)

    def is_valid_state(self) -> bool:
        return self.is_independent() and self.is_valid_payload()

    def compose(self, additions: Description, removals: Iterable[str] = ()) -> Description:
        """This state without the artifacts ``removals`` and with a delta's additions; an existing node of the delta
        stands for the state's own."""
        by_id = {n.uuid: k for k, n in self.nodes.items()}
        gone = set(removals)
        wanted = gone | {n.uuid for n in additions.nodes.values() if isinstance(n, Existing)}
        if missing := wanted - set(by_id):
            raise NotFound(f"artifacts {sorted(missing)}")
        keys = {k: by_id[n.uuid] if isinstance(n, Existing) else k for k, n in additions.nodes.items()}
        lost = {by_id[i] for i in gone}
        if lost & {keys[k] for k, n in additions.nodes.items() if isinstance(n, Existing)}:
            raise Invalid("an existing node is removed by the same delta")
        nodes = {k: n for k, n in self.nodes.items() if k not in lost}
        nodes.update({k: n for k, n in additions.nodes.items() if not isinstance(n, Existing) and k not in nodes})
        edges = {e for e in self.edges if not lost & {e.source, e.dependent}}
        edges |= {replace(e, source=keys[e.source], dependent=keys[e.dependent]) for e in additions.edges}
        return Description(nodes, edges)

    def graph(self) -> ArtifactGraph:
        """The graph of a valid state, by the ids of its nodes; hashes are filled in and verified."""
        if not self.is_valid_state():
            raise Invalid("not a state: a node without an id, or one of another graph")
        ids = {k: n.uuid for k, n in self.nodes.items()}
        return ArtifactGraph.from_description(self.nodes.values(), (replace(e, source=ids[e.source], dependent=ids[e.dependent]) for e in self.edges))

    def __eq__(self, other) -> bool:
        """Equal nodes, whatever their keys, and equal edges between them."""
        if not isinstance(other, Description):
            return NotImplemented

        def plain(d: Description) -> tuple:
            return Counter(d.nodes.values()), Counter((d.nodes[e.source], d.nodes[e.dependent], e.edge_type, e.name) for e in d.edges)

        return plain(self) == plain(other)

    __hash__ = None


@dataclass
class ArtifactGraph:
    artifacts: dict[str, Artifact] = field(default_factory=dict)
    edges: set[Edge] = field(default_factory=set)

    @classmethod
    def from_description(cls, artifacts: Iterable[Artifact], edges: Iterable[Edge]) -> ArtifactGraph:
        """Build a graph; a node that states a hash must have it. Between two artifacts there is one edge at most."""
        out = cls({a.uuid: a for a in artifacts})
        for e in edges:
            out.add_edge(e)
        for id_, h in out.hashes().items():
            if out.artifacts[id_].hash not in (0, h):
                raise HashMismatch(f"artifact {id_}")
            out.artifacts[id_] = replace(out.artifacts[id_], hash=h)
        return out

    def add_edge(self, e: Edge) -> None:
        if e.source not in self.artifacts or e.dependent not in self.artifacts:
            raise NotFound(f"an end of {e}")
        if any(x != e and (x.source, x.dependent) == (e.source, e.dependent) for x in self.edges):
            raise Invalid(f"a second edge between {e.source} and {e.dependent}")
        self.edges.add(e)

    def order(self, sources: Iterable[str] | None = None, keep: Callable[[Edge], bool] = lambda e: True) -> list[str]:
        return toposort(self.artifacts, [(e.source, e.dependent) for e in self.edges if keep(e)], sources)

    def hashes(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for id_ in self.order():
            out[id_] = content_hash(self.artifacts[id_], (out[e.source] for e in self.edges if e.dependent == id_))
        return out

    @property
    def hash(self) -> int:
        text = ",".join(map(str, sorted(self.hashes().values())))
        return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big", signed=True)

    def verify_hash(self) -> bool:
        return all(self.artifacts[i].hash == h for i, h in self.hashes().items())

    def description(self) -> tuple[list[Artifact], list[Edge]]:
        return [self.artifacts[i] for i in self.order()], sorted(self.edges, key=lambda e: (e.source, e.dependent))

    def apply_delta(self, artifacts: Iterable[Artifact] = (), edges: Iterable[Edge] = (), removals: Iterable[str] = ()) -> ArtifactGraph:
        """A new graph without the removals and with the additions. What still depends on a removed
        artifact has another hash than it states, which is an error."""
        gone = set(removals)
        if missing := gone - set(self.artifacts):
            raise NotFound(f"artifacts {sorted(missing)}")
        kept = {i: a for i, a in self.artifacts.items() if i not in gone}
        kept.update({a.uuid: a for a in artifacts if a.uuid not in kept})
        rest = {e for e in self.edges if e.source not in gone and e.dependent not in gone} | set(edges)
        return ArtifactGraph.from_description(kept.values(), rest)

    def neighbors(self, id_: str, direction: str = "out") -> list[str]:
        return sorted({e.dependent for e in self.edges if e.source == id_} if direction == "out" else {e.source for e in self.edges if e.dependent == id_})

    def related(self, id_: str, edge_type: str, name: str, direction: str = "out") -> list[str]:
        some = [e for e in self.edges if (e.edge_type, e.name) == (edge_type, name)]
        return sorted(e.dependent if direction == "out" else e.source for e in some if (e.source if direction == "out" else e.dependent) == id_)

    def unary_partitioning(self) -> str | None:
        return min((i for i, a in self.artifacts.items() if a.dtype == "UnaryPartitioning"), default=None)

    def find_by_name(self, name: str) -> str | None:
        return min((i for i, a in self.artifacts.items() if a.name == name), default=None)

    def get(self, id_: str, hash_: int | None = None) -> Artifact:
        a = self.artifacts.get(id_)
        if a is None or hash_ not in (None, a.hash):
            raise NotFound(f"artifact {id_}")
        return a

    def emplace(self, id_: str, make: Callable[[], Artifact]) -> Artifact:
        if id_ not in self.artifacts:
            self.artifacts[id_] = make()
        return self.artifacts[id_]

    def add_unary_partitioning(self) -> str:
        one = Artifact(new_id(), "UnaryPartitioning", "Unary Partitioning Singleton", True)
        self.artifacts[one.uuid] = one
        return one.uuid

    def add_uniform_partitioning(self, partitioning: str) -> None:
        have = {e.dependent for e in self.edges if e.name == PARTITIONING}
        for id_ in sorted(set(self.artifacts) - have - {partitioning}):
            if not self.artifacts[id_].self_partitioning:
                self.add_edge(Edge(partitioning, id_, DTYPE, PARTITIONING))

    def sealed(self) -> ArtifactGraph:
        """The same graph with every artifact's hash filled in."""
        return ArtifactGraph.from_description((replace(a, hash=0) for a in self.artifacts.values()), self.edges)

    def __eq__(self, other) -> bool:
        """Equal nodes and equal edges."""
        return isinstance(other, ArtifactGraph) and self.artifacts == other.artifacts and self.edges == other.edges

    __hash__ = None
