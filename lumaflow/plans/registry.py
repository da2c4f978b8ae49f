"""Kinds by id: registration, lookup, search."""

from __future__ import annotations

from lumaflow.plans.graph import Kind
from lumaflow.model import ContractError


class Registry:
    def __init__(self, kinds=()):
        self.kinds: dict[str, Kind] = {}
        for k in kinds:
            self.register(k)

    def register(self, kind: Kind) -> Kind:
        if kind.id in self.kinds:
            raise ContractError(f"kind {kind.id} is registered twice")
        self.kinds[kind.id] = kind
        return kind

    def find(self, kind: str) -> Kind:
        if kind not in self.kinds:
            raise ContractError(f"unknown kind {kind}")
        return self.kinds[kind]

    def search(self, text: str = "", tags=()) -> list[Kind]:
        """Kinds with all tags; names that start with the text first, then words, then parts of names, then ids and tags."""
        text = text.lower().strip()

        def rank(k: Kind) -> int | None:
            name = (k.name or k.id).lower()
            if name.startswith(text):
                return 0
            if any(w.startswith(text) for w in name.replace("-", " ").split()):
                return 1
            if text in name:
                return 2
            return 3 if text in k.id or any(text in t for t in k.tags) else None

        found = [(r, (k.name or k.id).lower(), k) for k in self.kinds.values() if set(tags) <= set(k.tags) and (r := rank(k)) is not None]
        return [k for _, _, k in sorted(found, key=lambda x: x[:2])]
