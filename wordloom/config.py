"""A collection's configuration: a JSON file whose stem must be its id; sources resolved inside the collection only."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from wordloom.operators.binder import Resources


@dataclass(frozen=True)
class Collection:
    id: str
    sources: dict[str, str] = field(default_factory=dict)
    gates: dict[str, float] = field(default_factory=dict)
    strip: tuple[str, ...] = ()
    marked: bool = False

    def source(self, key: str, required: bool = False) -> str | None:
        """The source's path; None means that what needs it is unavailable, never another collection's file."""
        path = self.sources.get(key)
        if path is None and required:
            raise KeyError(f"{self.id} declares no source {key}")
        return path

    def resources(self) -> Resources:
        return Resources(marks=self.marked, inventory="inventory" in self.sources or "witness" in self.sources, witness="witness" in self.sources)


def load(path: str) -> Collection:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    stem = os.path.splitext(os.path.basename(path))[0]
    if raw.get("id") != stem:
        raise ValueError(f"{path}: its id is {raw.get('id')!r}, its name {stem!r}")
    return Collection(raw["id"], dict(raw.get("sources", {})), dict(raw.get("gates", {})), tuple(raw.get("strip", ())), bool(raw.get("marked")))


def gate(collection: Collection, name: str, parts: int | None, whole: int | None) -> str:
    """PASS, FAIL or NOT_GATED of a share in percent; a share that could not be measured fails its gate."""
    if name not in collection.gates:
        return "NOT_GATED"
    if not whole or parts is None:
        return "FAIL"
    return "PASS" if parts * 100 >= collection.gates[name] * whole else "FAIL"
