"""Evaluation: contracts on the driver in topological order, then lowering to DataFrames.

Nothing is computed here; a result's DataFrame runs when an action asks for it. A node is lowered
once for all its consumers and targets, only ancestors of the targets are looked at, and in a batch
a failure stays with the branch it is on.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lumaflow.model import REC2020_D65, ContractError, Frame, Response
from lumaflow.plans.graph import Dag, Entry, MissingInput, NodeError, NodeId, OutputId


@dataclass(frozen=True)
class Context:
    """scale: the detail that a request needs; demosaicing reduces by it first."""

    spark: SparkSession | None = None
    scale: int = 1

    def __post_init__(self):
        if not 1 <= self.scale <= 256:
            raise ContractError("scale must be 1 to 256")


@dataclass
class Statistics:
    nodes: int = 0
    seconds: dict[NodeId, float] = field(default_factory=dict)


@dataclass
class Evaluation:
    frame: Frame
    statistics: Statistics


def check_requirement(requirement: str, desc) -> None:
    coordinates = getattr(desc, "coordinates", None)
    if requirement == "rec2020" and coordinates != REC2020_D65:
        raise ContractError(f"needs linear Rec.2020 / D65, not {getattr(desc, 'label', desc)}")
    if requirement == "camera" and not isinstance(coordinates, Response):
        raise ContractError("needs camera RGB")


class Run:
    def __init__(self, dag: Dag, context: Context):
        self.dag, self.context = dag, context
        self.values: dict[OutputId, Frame] = {}
        self.failed: dict[NodeId, Exception] = {}
        self.statistics = Statistics()

    def inputs(self, e: Entry) -> dict[str, Frame | None]:
        out = {}
        for name, port in e.kind.inputs.items():
            source = e.inputs.get(name)
            if source is None:
                if not port.optional:
                    raise MissingInput(e.id, name)
                out[name] = None
                continue
            if source.node in self.failed:
                raise self.failed[source.node]
            frame = self.values[source]
            check_requirement(port.requirement, frame.desc)
            out[name] = frame
        return out

    def node(self, e: Entry) -> None:
        began = time.perf_counter()
        frames = self.inputs(e)
        descs = {k: f.desc if f else None for k, f in frames.items()}
        params = e.loaded(self.context)
        made = e.kind.contract(self.context, params, descs) if e.kind.contract else {}
        if set(made) != set(e.kind.outputs):
            raise ContractError("a contract describes every output")
        for name, port in e.kind.outputs.items():
            check_requirement(port.requirement, made[name])
        data = e.kind.run(self.context, params, frames, made) if e.kind.outputs else {}
        for name in e.kind.outputs:
            self.values[OutputId(e.id, name)] = Frame(made[name], data[name])
        self.statistics.nodes += 1
        self.statistics.seconds[e.id] = time.perf_counter() - began

    def execute(self, targets) -> None:
        needed = self.dag.required(targets)
        for node in self.dag.order:
            if node not in needed:
                continue
            e = self.dag.entry(node)
            try:
                self.node(e)
            except (NodeError, MissingInput) as error:
                self.failed[node] = error
            except Exception as error:
                self.failed[node] = NodeError(node, e.kind.id, error)


def evaluate(dag: Dag, context: Context, output: OutputId) -> Evaluation:
    dag.output(output.node, output.port)
    run = Run(dag, context)
    run.execute([output])
    if output.node in run.failed:
        raise run.failed[output.node]
    return Evaluation(run.values[output], run.statistics)


def evaluate_batch(dag: Dag, context: Context, targets: list[OutputId]) -> dict[OutputId, Frame | Exception]:
    """Every target's frame, or the error of the branch it is on; shared nodes are lowered once."""
    run = Run(dag, context)
    run.execute(targets)
    return {t: run.failed[t.node] if t.node in run.failed else run.values[t] for t in targets}


def run_action(dag: Dag, context: Context, node: NodeId):
    """A node's side effect on its evaluated inputs, at full detail."""
    e = dag.entry(node)
    if e.kind.action is None:
        raise ContractError(f"{e.kind.id} has no action")
    full = Context(context.spark, 1)
    run = Run(dag, full)
    above = list(e.inputs.values())
    run.execute(above)
    frames = run.inputs(e)
    return e.kind.action(full, e.loaded(full), frames)


