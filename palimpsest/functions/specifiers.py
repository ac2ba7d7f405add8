"""Specifiers of versions: ``#uuid-prefix`` or ``ref/branch[:path[~n]]/artifact``."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SpecifierFormat

HEAD = "HEAD"


def revision_path(text: str) -> str:
    return HEAD if text.lower() in ("", "head") else text


@dataclass(frozen=True)
class Revision:
    path: str = HEAD
    offset: int = 0

    @classmethod
    def parse(cls, text: str) -> Revision:
        parts = text.split("~")
        if len(parts) > 2:
            raise SpecifierFormat(f"more than one ~ in {text!r}")
        if len(parts) == 2 and not re.fullmatch(r"\d+", parts[1]):
            raise SpecifierFormat(f"no offset after ~ in {text!r}")
        return cls(revision_path(parts[0]), -int(parts[1]) if len(parts) == 2 else 0)


@dataclass(frozen=True)
class UuidSpecifier:
    text: str
    complete: bool

    @classmethod
    def parse(cls, text: str) -> UuidSpecifier:
        try:
            return cls(str(uuid.UUID(text)), True)
        except ValueError:
            return cls(text, False)


@dataclass(frozen=True)
class ArtifactSpecifier:
    name: str | None = None
    uuid: UuidSpecifier | None = None

    @classmethod
    def parse(cls, text: str) -> ArtifactSpecifier:
        return cls(uuid=UuidSpecifier.parse(text[1:])) if text.startswith("#") else cls(name=text)


@dataclass(frozen=True)
class BranchRevision:
    branch: str
    revision: Revision = Revision()

    @classmethod
    def parse(cls, text: str) -> BranchRevision:
        parts = text.split(":")
        if len(parts) > 2:
            raise SpecifierFormat(f"more than one : in {text!r}")
        return cls(parts[0], Revision.parse(parts[1]) if len(parts) == 2 else Revision())


@dataclass(frozen=True)
class VersionSpecifier:
    uuid: UuidSpecifier | None = None
    ref: ArtifactSpecifier | None = None
    branch: BranchRevision | None = None
    artifact: ArtifactSpecifier | None = None

    @classmethod
    def parse(cls, text: str) -> VersionSpecifier:
        if text.startswith("#"):
            return cls(uuid=UuidSpecifier.parse(text[1:]))
        parts = text.split("/")
        if len(parts) != 3:
            raise SpecifierFormat(f"not #uuid nor ref/branch/artifact: {text!r}")
        return cls(ref=ArtifactSpecifier.parse(parts[0]), branch=BranchRevision.parse(parts[1]), artifact=ArtifactSpecifier.parse(parts[2]))


def parse_columns(spec: Column) -> dict[str, Column]:
    """The same grammar as columns: kind (uuid, branch or error), uuid_prefix, ref, branch, path, revision_offset, artifact."""
    parts = F.split(spec, "/")
    mid = F.split(F.get(parts, F.lit(1)), ":")
    rev = F.split(F.coalesce(F.get(mid, F.lit(1)), F.lit("")), "~")
    step = F.get(rev, F.lit(1))
    is_uuid = spec.startswith("#")
    ok = (F.size(parts) == 3) & (F.size(mid) <= 2) & (F.size(rev) <= 2) & (step.isNull() | step.rlike("^[0-9]+$"))
    kind = F.when(is_uuid, "uuid").when(ok, "branch").otherwise("error")
    only = lambda c: F.when(kind == "branch", c)
    path = F.get(rev, F.lit(0))
    return {
        "kind": kind, "uuid_prefix": F.when(is_uuid, F.substring(spec, 2, 1 << 30)), "ref": only(F.get(parts, F.lit(0))), "branch": only(F.get(mid, F.lit(0))),
        "path": only(F.when(F.lower(path).isin("", "head"), HEAD).otherwise(path)), "revision_offset": only(-F.coalesce(step.try_cast("long"), F.lit(0))), "artifact": only(F.get(parts, F.lit(2))),
    }
