"""Projects as JSON: nodes by kind and parameters, edges by port names. Loading reads no image."""

from __future__ import annotations

import json

from lumaflow.model import ContractError
from lumaflow.plans.graph import Dag
from lumaflow.plans.registry import Registry

VERSION = 0


def to_json(dag: Dag, ui=None) -> str:
    nodes = dag.nodes()
    place = {n: i for i, n in enumerate(nodes)}
    entries = [dag.entry(n) for n in nodes]
    if lost := [e.kind.id for e in entries if not e.kind.persistent]:
        raise ContractError(f"{lost[0]} cannot be saved")
    return json.dumps(
        {
            "version": VERSION,
            "nodes": [{"kind": e.kind.id, "parameters": e.params, "ui": e.ui} for e in entries],
            "edges": [[{"node": place[s.node], "port": s.port}, {"node": place[t.node], "port": t.port}] for s, t in dag.edges()],
            "ui": ui,
        },
        indent=1,
    )


def _only(value: dict, names: set[str]) -> dict:
    if not isinstance(value, dict) or set(value) - names:
        raise ContractError(f"unknown fields {sorted(set(value) - names) if isinstance(value, dict) else value}")
    return value


def from_json(text: str, registry: Registry) -> tuple[Dag, object]:
    doc = _only(json.loads(text), {"version", "nodes", "edges", "ui"})
    if doc.get("version") != VERSION:
        raise ContractError(f"version {doc.get('version')}: projects are not migrated")
    dag = Dag()

    def build(draft: Dag) -> None:
        ids = []
        for n in doc.get("nodes", []):
            _only(n, {"kind", "parameters", "ui"})
            ids.append(draft.add(registry.find(n["kind"]), n.get("parameters"), n.get("ui")))
        for source, target in doc.get("edges", []):
            for end in (source, target):
                _only(end, {"node", "port"})
                if not 0 <= end["node"] < len(ids):
                    raise ContractError("edge to a node that is not there")
            draft.connect(draft.output(ids[source["node"]], source["port"]), draft.input(ids[target["node"]], target["port"]))

    dag.edit(build)
    return dag, doc.get("ui")


def unique_name(name: str, taken) -> str:
    """The name, or the name with the first free number from 2."""
    if name not in taken:
        return name
    return next(f"{name} {i}" for i in range(2, len(taken) + 3) if f"{name} {i}" not in taken)


def template(dag: Dag, registry: Registry) -> Dag:
    """A copy with external parameters at their defaults."""
    out, _ = from_json(to_json(dag), registry)
    for n in out.nodes():
        e = out.entry(n)
        e.params = e.kind.schema.reset_external(e.params)
    return out
