"""The typed graph: checked edges, transactions, topological order. Building it runs no Spark."""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from lumaflow.plans.params import Schema


class GraphError(ValueError):
    """An edit that the graph does not allow."""


class NodeError(RuntimeError):
    """A node that failed in an evaluation, or one below it."""

    def __init__(self, node: NodeId, kind: str, cause: Exception):
        super().__init__(f"{kind}: {cause}")
        self.node, self.kind, self.cause = node, kind, cause


class MissingInput(RuntimeError):
    def __init__(self, node: NodeId, port: str):
        super().__init__(f"input {port} is not connected")
        self.node, self.port = node, port


@dataclass(frozen=True)
class Port:
    payload: str
    requirement: str = "any"  # any, rec2020 or camera
    optional: bool = False


@dataclass(frozen=True)
class Kind:
    """An operator: ports, parameters, contract(context, params, descriptions) and run(context, params, frames, descriptions).

    load(context, params) reads what the parameters name (headers, profiles) when the node is first needed. The value, or
    the error, stays with the node and all copies of its graph until its parameters are set again; contract, run and action
    see it as params["loaded"]."""

    id: str
    inputs: dict[str, Port]
    outputs: dict[str, Port]
    contract: Callable[..., dict[str, Any]] | None
    run: Callable[..., dict[str, Any]]
    name: str = ""
    tags: tuple[str, ...] = ()
    schema: Schema = field(default_factory=Schema)
    action: Callable[..., Any] | None = None
    persistent: bool = True
    load: Callable[..., Any] | None = None


@dataclass(frozen=True)
class NodeId:
    graph: int
    index: int
    generation: int


@dataclass(frozen=True)
class OutputId:
    node: NodeId
    port: str


@dataclass(frozen=True)
class InputId:
    node: NodeId
    port: str


@dataclass
class Entry:
    id: NodeId
    kind: Kind
    params: dict
    inputs: dict[str, OutputId] = field(default_factory=dict)
    ui: Any = None
    cache: dict = field(default_factory=dict)

    def loaded(self, context) -> dict:
        """The parameters, with what they name."""
        if self.kind.load is None:
            return self.params
        if not self.cache:
            try:
                self.cache["value"] = self.kind.load(context, self.params)
            except Exception as error:
                self.cache["error"] = error
        if "error" in self.cache:
            raise self.cache["error"]
        return {**self.params, "loaded": self.cache["value"]}


_graphs, _generations = itertools.count(), itertools.count()


class Dag:
    def __init__(self):
        self.id = next(_graphs)
        self.entries: list[Entry | None] = []
        self.order: list[NodeId] = []

    # -- lookups
    def entry(self, node: NodeId) -> Entry:
        if node.graph != self.id:
            raise GraphError("handle of another graph")
        found = self.entries[node.index] if node.index < len(self.entries) else None
        if found is None or found.id != node:
            raise GraphError("stale handle")
        return found

    def nodes(self) -> list[NodeId]:
        return [e.id for e in self.entries if e]

    def edges(self) -> list[tuple[OutputId, InputId]]:
        return [(source, InputId(e.id, port)) for e in self.entries if e for port, source in e.inputs.items()]

    def output(self, node: NodeId, port: str = "output") -> OutputId:
        if port not in self.entry(node).kind.outputs:
            raise GraphError(f"no output {port}")
        return OutputId(node, port)

    def input(self, node: NodeId, port: str) -> InputId:
        if port not in self.entry(node).kind.inputs:
            raise GraphError(f"no input {port}")
        return InputId(node, port)

    # -- edits
    def add(self, kind: Kind, params: dict | None = None, ui: Any = None) -> NodeId:
        admitted = kind.schema.admit(params)
        free = next((i for i, e in enumerate(self.entries) if e is None), len(self.entries))
        node = NodeId(self.id, free, next(_generations))
        made = Entry(node, kind, admitted, ui=ui)
        if free == len(self.entries):
            self.entries.append(made)
        else:
            self.entries[free] = made
        self.order = self._sorted()
        return node

    def remove(self, node: NodeId) -> None:
        self.entry(node)
        self.entries[node.index] = None
        for e in self.entries:
            if e:
                e.inputs = {p: s for p, s in e.inputs.items() if s.node != node}
        self.order = self._sorted()

    def connect(self, source: OutputId, target: InputId) -> None:
        """Occupied inputs, other payloads, wrong directions, foreign or stale handles and cycles are refused."""
        if not isinstance(source, OutputId) or not isinstance(target, InputId):
            raise GraphError("an edge goes from an output to an input")
        out, into = self.entry(source.node), self.entry(target.node)
        if source.port not in out.kind.outputs or target.port not in into.kind.inputs:
            raise GraphError("no such port")
        if target.port in into.inputs:
            raise GraphError(f"input {target.port} is taken")
        have, want = out.kind.outputs[source.port].payload, into.kind.inputs[target.port].payload
        if have != want:
            raise GraphError(f"{have} does not go into {want}")
        into.inputs[target.port] = source
        try:
            self.order = self._sorted()
        except GraphError:
            del into.inputs[target.port]
            raise

    def link(self, source: NodeId, target: NodeId, into: str = "image", out: str = "output") -> None:
        self.connect(self.output(source, out), self.input(target, into))

    def reconnect(self, source: OutputId, target: InputId) -> None:
        """Connect in place of what the input has."""

        def change(draft: Dag) -> None:
            if target.port in draft.entry(target.node).inputs:
                draft.disconnect(target)
            draft.connect(source, target)

        self.edit(change)

    def disconnect(self, target: InputId) -> None:
        if self.entry(target.node).inputs.pop(target.port, None) is None:
            raise GraphError("nothing to disconnect")
        self.order = self._sorted()

    def set_parameters(self, node: NodeId, params: dict) -> None:
        e = self.entry(node)
        e.params, e.cache = e.kind.schema.admit(params), {}

    def replace(self, node: NodeId, kind: Kind, params: dict | None = None) -> None:
        if kind.id != self.entry(node).kind.id:
            raise GraphError("only a node of the same kind can take a node's place")
        self.set_parameters(node, params or {})

    def edit(self, change: Callable[[Dag], Any]) -> Any:
        """All of a change or nothing: it works on a draft with the same handles."""
        draft = copy.copy(self)
        draft.entries = [e and Entry(e.id, e.kind, dict(e.params), dict(e.inputs), e.ui, e.cache) for e in self.entries]
        draft.order = list(self.order)
        result = change(draft)
        draft.order = draft._sorted()
        self.entries, self.order = draft.entries, draft.order
        return result

    def _sorted(self) -> list[NodeId]:
        waiting = {e.id: {s.node for s in e.inputs.values()} for e in self.entries if e}
        order: list[NodeId] = []
        while waiting:
            ready = [n for n, above in waiting.items() if not above & waiting.keys()]
            if not ready:
                raise GraphError("the edge would close a cycle")
            order += ready
            for n in ready:
                del waiting[n]
        return order

    def required(self, targets) -> set[NodeId]:
        """The targets' nodes and all above them."""
        out, stack = set(), [t.node for t in targets]
        while stack:
            n = stack.pop()
            if n not in out:
                out.add(n)
                stack += [s.node for s in self.entry(n).inputs.values()]
        return out


class History:
    """Undo and redo by snapshots of any value."""

    def __init__(self, start: Any, depth: int = 100):
        self.past, self.now, self.future, self.depth = [], copy.deepcopy(start), [], depth

    def push(self, state: Any) -> None:
        self.past = [*self.past, self.now][-self.depth :]
        self.now, self.future = copy.deepcopy(state), []

    def undo(self) -> Any:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        return copy.deepcopy(self.now)

    def redo(self) -> Any:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        return copy.deepcopy(self.now)
