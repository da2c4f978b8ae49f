import pytest

from lumaflow.model import REC2020_D65, BayerDesc, Calibration, Camera, ContractError, Extent, Frame, Metadata, Phase, Response, RgbDesc
from lumaflow.operators import nodes
from lumaflow.plans import project
from lumaflow.plans.evaluate import Context, evaluate, evaluate_batch, run_action
from lumaflow.plans.graph import Dag, GraphError, History, Kind, MissingInput, NodeError, Port

FIND = nodes.REGISTRY.find


def rgb_source(coordinates=REC2020_D65):
    return nodes.bound_source(Frame(RgbDesc(Extent(2, 2), coordinates), "pixels"), nodes.RGB)


def counting(calls, fail=False):
    def run(ctx, params, frames, descs):
        calls.append(1)
        if fail:
            raise RuntimeError("broken")
        return {"output": frames["image"].data}

    return Kind(id="count", inputs={"image": Port(nodes.RGB)}, outputs={"output": Port(nodes.RGB)}, contract=lambda c, p, d: {"output": d["image"]}, run=run)


def test_cycles_occupancy_and_types():
    dag = Dag()
    a, b = dag.add(FIND("exposure")), dag.add(FIND("exposure"))
    dag.link(a, b)
    with pytest.raises(GraphError):
        dag.link(b, a)
    with pytest.raises(GraphError):
        dag.link(a, b)
    bayer = dag.add(FIND("reduce-bayer"))
    with pytest.raises(GraphError):
        dag.connect(dag.output(a), dag.input(bayer, "image"))
    with pytest.raises(GraphError):
        dag.connect(dag.input(b, "image"), dag.output(a))
    assert dag.order.index(a) < dag.order.index(b)


def test_stale_and_foreign_handles():
    dag, other = Dag(), Dag()
    a = dag.add(FIND("exposure"))
    dag.remove(a)
    b = dag.add(FIND("exposure"))
    assert b.index == a.index
    with pytest.raises(GraphError):
        dag.entry(a)
    with pytest.raises(GraphError):
        other.entry(b)


def test_remove_clears_consumers():
    dag = Dag()
    a, b = dag.add(FIND("exposure")), dag.add(FIND("exposure"))
    dag.link(a, b)
    dag.remove(a)
    assert not dag.edges()


def test_edit_is_all_or_nothing():
    dag = Dag()
    a = dag.add(FIND("exposure"))

    def change(draft):
        b = draft.add(FIND("exposure"))
        draft.link(a, b)
        draft.link(b, a)

    with pytest.raises(GraphError):
        dag.edit(change)
    assert dag.nodes() == [a] and not dag.edges()


def test_reconnect_and_replace():
    dag = Dag()
    a, b, c = (dag.add(FIND("exposure")) for _ in range(3))
    dag.link(a, c)
    dag.reconnect(dag.output(b), dag.input(c, "image"))
    assert dag.edges()[0][0].node == b
    dag.replace(c, FIND("exposure"), {"ev": 2.0})
    assert dag.entry(c).params == {"ev": 2.0}
    with pytest.raises(GraphError):
        dag.replace(c, FIND("sigmoid"))


def test_parameters():
    dag = Dag()
    for bad in ({"ev": float("nan")}, {"ev": 400.0}, {"other": 1}, {"ev": "1"}):
        with pytest.raises(ContractError):
            dag.add(FIND("exposure"), bad)
    with pytest.raises(ContractError):
        dag.add(FIND("chromatic-adaptation"), {"illuminant": {"custom": {"x": 0.0, "y": 0.0001}}})
    assert dag.entry(dag.add(FIND("histogram"), {"unknown": 1})).params["scale"] == "linear"


def test_shared_node_runs_once_and_branches_fail_alone():
    calls, dag = [], Dag()
    source = dag.add(rgb_source())
    shared = dag.add(counting(calls))
    bad, below, good = dag.add(counting([], fail=True)), dag.add(FIND("reduce-rgb")), dag.add(counting([]))
    unused = dag.add(counting([], fail=True))
    for x, y in ((source, shared), (shared, bad), (bad, below), (shared, good), (shared, unused)):
        dag.link(x, y)
    found = evaluate_batch(dag, Context(), [dag.output(below), dag.output(good)])
    assert len(calls) == 1
    assert isinstance(found[dag.output(below)], NodeError) and found[dag.output(below)].node == bad
    assert found[dag.output(good)].data == "pixels"
    assert evaluate(dag, Context(), dag.output(good)).statistics.nodes == 3


def test_missing_input_and_requirements():
    dag = Dag()
    lone = dag.add(FIND("exposure"))
    with pytest.raises(MissingInput):
        evaluate(dag, Context(), dag.output(lone))
    camera, tone = dag.add(rgb_source(Response(Camera("a", "b")))), dag.add(FIND("sigmoid"))
    dag.link(camera, tone)
    with pytest.raises(NodeError):
        evaluate(dag, Context(), dag.output(tone))


def test_optional_input_that_fails_is_an_error():
    dag = Dag()
    image, orient = dag.add(rgb_source()), dag.add(FIND("orientation"))
    raw = dag.add(FIND("bayer-raw"))
    dag.link(image, orient)
    dag.link(raw, orient, "metadata", "metadata")
    with pytest.raises(NodeError):
        evaluate(dag, Context(), dag.output(orient))


def test_gains_contract_checks_camera(spark):
    dag = Dag()
    mosaic = Frame(BayerDesc(Extent(2, 2), Phase.RGGB, Response(Camera("other", ""))), None)
    a = dag.add(nodes.bound_source(mosaic, nodes.BAYER))
    meta = Metadata(calibration=Calibration(cfa=((0, 1), (3, 2)), maximum=10))
    b, g = dag.add(nodes.bound_source(Frame(meta, meta), nodes.METADATA)), dag.add(FIND("bayer-site-gains"))
    dag.link(a, g)
    dag.link(b, g, "metadata")
    with pytest.raises(NodeError):
        evaluate(dag, Context(spark), dag.output(g))


def test_project_round_trip_and_template():
    dag = nodes.raw_template()
    export = next(n for n in dag.nodes() if dag.entry(n).kind.id == "export-tiff")
    dag.set_parameters(export, {"path": "/tmp/x.tiff", "depth": "u8", "compression": "none"})
    text = project.to_json(dag, {"zoom": 2})
    again, ui = project.from_json(text, nodes.REGISTRY)
    assert project.to_json(again, ui) == text
    clean = project.template(dag, nodes.REGISTRY)
    params = next(clean.entry(n).params for n in clean.nodes() if clean.entry(n).kind.id == "export-tiff")
    assert params["path"] is None and params["depth"] == "u8"


@pytest.mark.parametrize("text", ['{"version":1,"nodes":[],"edges":[]}', '{"version":0,"nodes":[],"edges":[],"more":1}', '{"version":0,"nodes":[{"kind":"nothing"}],"edges":[]}', '{"version":0,"nodes":[{"kind":"exposure","parameters":{"x":1}}],"edges":[]}'])
def test_bad_projects(text):
    with pytest.raises(ContractError):
        project.from_json(text, nodes.REGISTRY)


def test_bound_sources_are_not_saved():
    dag = Dag()
    dag.add(rgb_source())
    with pytest.raises(ContractError):
        project.to_json(dag)


def test_registry():
    assert len(nodes.REGISTRY.kinds) == 18
    with pytest.raises(ContractError):
        nodes.REGISTRY.register(FIND("exposure"))
    names = [k.id for k in nodes.REGISTRY.search("re")]
    assert names[:2] == ["reduce-bayer", "reduce-rgb"]
    assert {k.id for k in nodes.REGISTRY.search("", ["scope"])} == {"histogram", "waveform", "vectorscope"}
    assert project.unique_name("a", {"a", "a 2"}) == "a 3"


def test_actions(spark):
    from lumaflow.sources.rasters import bound_rgb

    dag = Dag()
    image = bound_rgb(spark, [(g, g, g) for g in (0, 0.045, 0.09, 0.045)], Extent(2, 2), REC2020_D65)
    source, ev = dag.add(nodes.bound_source(image, nodes.RGB)), dag.add(FIND("exposure"), {"ev": 5.0})
    dag.link(source, ev)
    assert abs(run_action(dag, Context(spark), ev)["ev"] - 2) < 1e-6
    out = dag.add(FIND("export-tiff"))
    dag.link(source, out)
    with pytest.raises(ContractError):
        run_action(dag, Context(spark), out)


def test_history():
    h = History(0, depth=2)
    for x in (1, 2, 3):
        h.push(x)
    assert [h.undo(), h.undo(), h.undo()] == [2, 1, 1]
    assert h.redo() == 2
