"""Data model: artifacts, versions, hunks, their relations, and the schemas of their tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from enum import IntEnum

STATE, CUMULATIVE, DELTA = "state", "cumulative_delta", "delta"
REPRESENTATIONS = (STATE, CUMULATIVE, DELTA)
STAGING, COMMITTED = "staging", "committed"
COMPLETE, RAGGED = "complete", "ragged"
DTYPE, PRODUCER = "dtype", "producer"
EXTANT, LEAF_BOOTSTRAP, CUSTOM = "extant", "leaf_bootstrap", "custom"
DEFAULT_POLICIES = frozenset({EXTANT, LEAF_BOOTSTRAP})
PARTITIONING = "Partitioning"
UNARY_PARTITION = 0
#: Per policy the need of producer versions (RELATED: those that used a parent of the new version) and of
#: versions of their dependencies (RELATED: those that producer versions used).
POLICY_NEEDS = {"extant": (1, 1), "leaf_bootstrap": (2, 2), "custom": (1, 1)}
#: Cost of a representation in strategy selection.
WEIGHTS = {STATE: 3, CUMULATIVE: 2, DELTA: 1}


class EngineError(Exception):
    """Base of all errors of the engine."""


class NotFound(EngineError):
    pass


class HashMismatch(EngineError):
    pass


class Invalid(EngineError):
    pass


class SpecifierFormat(EngineError):
    pass


class StateOnly(EngineError):
    """A delta of a datatype that has states alone."""


class Unfulfilled(EngineError):
    """Partitions that have deltas but no state below them."""


class Need(IntEnum):
    """What a production policy needs to see of the versions of a producer, or of those of its dependencies; more
    includes less, so that of several policies the largest need is loaded."""

    NONE = 0
    RELATED = 1
    ALL = 2


def new_id() -> str:
    return str(uuid.uuid4())


@dataclass(frozen=True)
class Identity:
    uuid: str
    hash: int = 0


@dataclass(frozen=True)
class Artifact:
    uuid: str
    dtype: str
    name: str | None = None
    self_partitioning: bool = False
    hash: int = 0


@dataclass(frozen=True)
class Edge:
    source: str
    dependent: str
    edge_type: str
    name: str

    def __post_init__(self):
        if self.edge_type not in (DTYPE, PRODUCER):
            raise Invalid(f"edge type {self.edge_type}")


@dataclass(frozen=True)
class Version:
    uuid: str
    artifact: str
    representation: str = STATE
    status: str = STAGING
    hash: int = 0

    def __post_init__(self):
        if self.representation not in REPRESENTATIONS:
            raise Invalid(f"representation {self.representation}")


@dataclass(frozen=True)
class Hunk:
    uuid: str
    version: str
    partition: int
    representation: str
    completion: str = COMPLETE
    precedence: str | None = None
    hash: int = 0

    def is_valid(self, version_representation: str) -> bool:
        """State versions hold states only, cumulative ones no plain deltas; a state version has no precedence."""
        if version_representation == STATE:
            return self.representation == STATE and self.precedence is None
        return version_representation == DELTA or self.representation != DELTA


@dataclass(frozen=True)
class BlobDelta:
    """Bytes to put at indices; the shorter list rules, and of equal indices the last."""

    indices: tuple[int, ...]
    values: bytes

    def apply(self, state: bytes) -> bytes:
        out = bytearray(state)
        for i, v in zip(self.indices, self.values, strict=False):
            if not 0 <= i < len(out):
                raise Invalid(f"index {i} outside a blob of {len(out)} bytes")
            out[i] = v
        return bytes(out)


@dataclass
class Spec:
    """Productions to make: dependency set -> parents (None for a production without one)."""

    specs: dict[frozenset, set] = field(default_factory=dict)

    def insert(self, dependencies: frozenset, parent) -> None:
        self.specs.setdefault(dependencies, set()).add(parent)

    def merge(self, other: Spec) -> Spec:
        for dependencies, parents in other.specs.items():
            self.specs.setdefault(dependencies, set()).update(parents)
        return self

    def retain(self, keep) -> Spec:
        self.specs = {d: kept for d, parents in self.specs.items() if (kept := {p for p in parents if keep(d, p)})}
        return self


#: Version of the tables below.
SCHEMA_VERSION = 1

#: Append-only tables of the store and their columns. ``graph`` is the hunk of an artifact graph that holds the row.
TABLES = {
    "schema_version": "version int",
    "datatype": "uuid string, hash long, version long, name string",
    "artifact": "uuid string, hash long, graph string, dtype string, self_partitioning boolean, name string",
    "artifact_edge": "graph string, source string, dependent string, edge_type string, name string",
    "artifact_removal": "graph string, uuid string",
    "version": "uuid string, hash long, artifact string, status string, representation string",
    "version_parent": "parent string, child string",
    "version_relation": "source string, dependent string, edge_type string, name string",
    "hunk": "uuid string, hash long, version string, partition_id long, representation string, completion string, precedence string",
    "producer_artifact": "artifact string, policies array<string>",
    "producer_version": "version string, strategy string",
    "arbitrary_partitioning": "version string, partition_ids array<long>",
    "branch": "ref_artifact string, name string",
    "revision_path": "ref_artifact string, branch string, path string, version string",
    "message": "version string, message string",
    "origin": "artifact string, version string, hunk string",
    "blob": "hunk string, kind string, state binary, indices array<long>, bytes binary",
}
