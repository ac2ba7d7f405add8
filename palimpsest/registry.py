"""Registry of datatypes and interfaces, and validation of declared dependencies."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import DELTA, STATE, Invalid, NotFound

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "palimpsest.datatypes")


@dataclass(frozen=True)
class Interface:
    name: str
    extends: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cardinality:
    """How many dependencies of a kind are allowed; most None: no bound."""

    least: int = 1
    most: int | None = 1

    def allows(self, n: int) -> bool:
        return n >= self.least and (self.most is None or n <= self.most)


@dataclass(frozen=True)
class DependencyDescription:
    name: str
    datatype: str | None = None
    interface: str | None = None
    cardinality: Cardinality = Cardinality()


@dataclass(frozen=True)
class Datatype:
    name: str
    version: int = 1
    representations: frozenset[str] = frozenset({STATE})
    implements: frozenset[str] = frozenset()
    dependencies: tuple[DependencyDescription, ...] = ()

    @property
    def uuid(self) -> str:
        return str(uuid.uuid5(NAMESPACE, self.name))

    @property
    def hash(self) -> int:
        return zlib.crc32(f"{self.name}|{self.version}|{','.join(sorted(self.representations))}".encode())


@dataclass
class Registry:
    interfaces: dict[str, Interface] = field(default_factory=dict)
    by_name: dict[str, Datatype] = field(default_factory=dict)

    def register_interface(self, one: Interface) -> Registry:
        missing = [x for x in one.extends if x not in self.interfaces]
        if missing:
            raise NotFound(f"interfaces {missing}")
        self.interfaces[one.name] = one
        return self

    def register(self, one: Datatype) -> Registry:
        unknown = [x for x in one.implements if x not in self.interfaces]
        if unknown:
            raise NotFound(f"interfaces {unknown}")
        self.by_name[one.name] = one
        return self

    def get(self, name: str) -> Datatype:
        if name not in self.by_name:
            raise NotFound(f"datatype {name}")
        return self.by_name[name]

    def get_by_uuid(self, id_: str) -> Datatype:
        for one in self:
            if one.uuid == id_:
                return one
        raise NotFound(f"datatype {id_}")

    def implements(self, name: str, interface: str) -> bool:
        """Directly or through an interface that extends it."""
        todo = list(self.get(name).implements)
        while todo:
            one = todo.pop()
            if one == interface:
                return True
            todo += self.interfaces[one].extends
        return False

    def __iter__(self):
        return iter(self.by_name.values())

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d.uuid, d.hash, d.version, d.name) for d in self], "uuid string, hash long, version long, name string")

    def validate(self, dtype: str, counts: dict[str, int]) -> None:
        """Raise if the number of dependencies by name breaks what the datatype declares."""
        for d in self.get(dtype).dependencies:
            if not d.cardinality.allows(counts.get(d.name, 0)):
                raise Invalid(f"{dtype}: {counts.get(d.name, 0)} dependencies called {d.name}")


def cardinality_check(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """dependent, name, n, ok: dependencies of each name against bounds(name, least, most)."""
    counts = edges.groupBy("dependent", "name").agg(F.count("*").alias("n"))
    return counts.join(bounds, "name", "left").select("dependent", "name", "n", ((F.col("n") >= F.coalesce("least", F.lit(0))) & (F.col("most").isNull() | (F.col("n") <= F.col("most")))).alias("ok"))


def default_registry() -> Registry:
    r = Registry()
    for i in ("ArtifactMeta", "Partitioning", "Producer", "CustomProductionPolicy"):
        r.register_interface(Interface(i))
    both = frozenset({STATE, DELTA})
    any_number = Cardinality(0, None)
    for d in (
        Datatype("ArtifactGraph", representations=both),
        Datatype("Ref", dependencies=(DependencyDescription("ref", cardinality=any_number),)),
        Datatype("UnaryPartitioning", implements=frozenset({"Partitioning"})),
        Datatype("ArbitraryPartitioning", implements=frozenset({"Partitioning"})),
        Datatype("Blob", representations=both),
        Datatype("KeyedTable", representations=frozenset({STATE, DELTA, "cumulative_delta"})),
        Datatype("NoopProducer", implements=frozenset({"Producer"}), dependencies=(DependencyDescription("input", cardinality=any_number),)),
        Datatype("NegateBlobProducer", implements=frozenset({"Producer"}), dependencies=(DependencyDescription("input", "Blob"),)),
        Datatype("TrackingBranchProducer", implements=frozenset({"Producer", "CustomProductionPolicy"}), dependencies=(DependencyDescription("tracked", cardinality=any_number),)),
    ):
        r.register(d)
    return r
