"""The registered kinds: contracts on descriptions, lowering to the operators."""

from __future__ import annotations

import math
from dataclasses import replace

from lumaflow.functions import color, profiles
from lumaflow.model import REC2020_D65, BayerDesc, ContractError, Extent, Frame, LevelsDesc, Phase, Response, RgbDesc
from lumaflow.operators import demosaic, highlights, pointwise, reduce, scopes
from lumaflow.plans.graph import Dag, Kind, NodeId, Port
from lumaflow.plans.params import Param, Schema
from lumaflow.plans.registry import Registry
from lumaflow.sinks import encode

BAYER, RGB, LEVELS, METADATA, TABLE = "Bayer", "RGB", "Bayer levels", "Capture metadata", "Table"

REGISTRY = Registry()


def node(**settings):
    """Register a function run(context, params, frames, descs) as a kind."""

    def add(run):
        return REGISTRY.register(Kind(run=run, **settings))

    return add


def same(ctx, params, descs):
    return {"output": descs["image"]}


IMAGE = {"image": Port(RGB)}
REC_IMAGE = {"image": Port(RGB, "rec2020")}
RGB_OUT, REC_OUT, CAMERA_OUT = {"output": Port(RGB)}, {"output": Port(RGB, "rec2020")}, {"output": Port(RGB, "camera")}
META = {"metadata": Port(METADATA, optional=True)}


def bound_source(frame: Frame, payload: str) -> Kind:
    """A source of an in-memory frame; it is not saved."""
    return Kind(id=f"bound-source-{payload.lower().replace(' ', '-')}", name="Bound source", inputs={}, outputs={"output": Port(payload)}, contract=lambda c, p, d: {"output": frame.desc}, run=lambda c, p, f, d: {"output": frame.data}, persistent=False)


def _raw_check(values):
    from lumaflow.sources.raw import EXTENSIONS

    path = values["path"]
    if path and path.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
        raise ContractError("not a known raw file extension")


def _raw_header(ctx, params):
    """What the files under the path share; tasks read the headers, and one of them reaches the driver."""
    from lumaflow.sources.raw import common_metadata, read_headers

    if not params["path"]:
        raise ContractError("the raw source has no file to read")
    return common_metadata(read_headers(ctx.spark, params["path"]))


def _raw_contract(ctx, params, descs):
    meta, width, height = params["loaded"]
    return {"mosaic": BayerDesc(Extent(width, height), Phase.of_cfa(meta.calibration.cfa), Response(meta.camera)), "metadata": meta}


@node(id="bayer-raw", name="Bayer RAW", tags=("io", "bayer-raw"), inputs={}, outputs={"mosaic": Port(BAYER), "metadata": Port(METADATA)}, schema=Schema({"path": Param("path", external=True)}, _raw_check), contract=_raw_contract, load=_raw_header)
def bayer_raw(ctx, params, frames, descs):
    from lumaflow.sources.raw import normalize_each, read_headers, scan_raw

    codes = scan_raw(ctx.spark, params["path"]).select("image_id", "row", "col", "code")
    return {"mosaic": normalize_each(codes, read_headers(ctx.spark, params["path"])), "metadata": descs["metadata"]}


FACTOR = Schema({"factor": Param("int", 2, 1, 256)}, lambda v: reduce.check_factor(v["factor"]))


@node(id="reduce-bayer", name="Reduce Bayer", tags=("bayer-raw", "geometry"), inputs={"image": Port(BAYER)}, outputs={"output": Port(BAYER)}, schema=FACTOR, contract=lambda c, p, d: {"output": replace(d["image"], extent=reduce.bayer_extent(d["image"].extent, p["factor"]))})
def reduce_bayer(ctx, params, frames, descs):
    image = frames["image"]
    return {"output": reduce.reduce_bayer(image.data, params["factor"], image.desc.extent)}


@node(id="reduce-rgb", name="Reduce RGB", tags=("geometry",), inputs=IMAGE, outputs=RGB_OUT, schema=FACTOR, contract=lambda c, p, d: {"output": replace(d["image"], extent=reduce.rgb_extent(d["image"].extent, p["factor"]))})
def reduce_rgb(ctx, params, frames, descs):
    return {"output": reduce.reduce_rgb(frames["image"].data, params["factor"])}


def _gains_contract(ctx, params, descs):
    image, meta = descs["image"], descs["metadata"]
    from lumaflow.model import Phase

    if image.response.camera != meta.camera or image.phase != Phase.of_cfa(meta.calibration.cfa):
        raise ContractError("image and metadata are of different cameras")
    gains = color.as_shot_balance(meta.calibration.as_shot)
    prior = image.response.balance or (1.0,) * 4
    response = Response(image.response.camera, tuple(a * b for a, b in zip(prior, gains, strict=True)))
    return {"output": replace(image, response=response), "levels": LevelsDesc(image.phase, response)}


@node(id="bayer-site-gains", name="Bayer site gains", tags=("input-transform", "bayer-raw", "color"), inputs={"image": Port(BAYER), "metadata": Port(METADATA)}, outputs={"output": Port(BAYER), "levels": Port(LEVELS)}, contract=_gains_contract)
def bayer_site_gains(ctx, params, frames, descs):
    calibration = frames["metadata"].data.calibration
    balance = descs["output"].response.balance
    levels = tuple(v * balance[calibration.cfa[i // 2][i % 2]] for i, v in enumerate(calibration.site_levels))
    return {"output": pointwise.apply_site_gains(frames["image"].data, pointwise.site_gains(calibration)), "levels": levels}


def _highlights_contract(ctx, params, descs):
    image, levels = descs["image"], descs["levels"]
    if image.phase != levels.phase or image.response != levels.response:
        raise ContractError("levels are of another phase or response")
    return {"output": image}


@node(id="highlights-opposed", name="Highlights: opposed", tags=("bayer-raw", "recovery"), inputs={"image": Port(BAYER), "levels": Port(LEVELS)}, outputs={"output": Port(BAYER)}, schema=Schema({"threshold": Param("float", 0.98, 0, 1)}, lambda v: highlights.check_threshold(v["threshold"])), contract=_highlights_contract)
def highlights_opposed(ctx, params, frames, descs):
    image, levels = frames["image"], frames["levels"].data
    if not all(math.isfinite(v) and v > 0 for v in levels):
        raise ContractError("levels must be finite and positive")
    return {"output": highlights.highlights_opposed(image.data, levels, image.desc.phase, image.desc.extent, params["threshold"])}


def _scaled(ctx, desc: BayerDesc) -> BayerDesc:
    """Detail that a request does not need goes before the demosaic, below all that follows."""
    return replace(desc, extent=reduce.bayer_extent(desc.extent, ctx.scale))


@node(id="bayer-2x2-demosaic", name="Demosaic: 2x2", tags=("bayer-raw", "demosaic"), inputs={"image": Port(BAYER)}, outputs=CAMERA_OUT, contract=lambda c, p, d: {"output": RgbDesc(demosaic.bin_extent(_scaled(c, d["image"]).extent), d["image"].response)})
def bayer_2x2(ctx, params, frames, descs):
    image = frames["image"]
    small = reduce.reduce_bayer(image.data, ctx.scale, image.desc.extent)
    return {"output": demosaic.demosaic_2x2(small, image.desc.phase, _scaled(ctx, image.desc).extent)}


@node(id="rcd-demosaic", name="Demosaic: RCD", tags=("bayer-raw", "demosaic"), inputs={"image": Port(BAYER)}, outputs=CAMERA_OUT, contract=lambda c, p, d: {"output": RgbDesc(_scaled(c, d["image"]).extent, d["image"].response)})
def rcd(ctx, params, frames, descs):
    image = frames["image"]
    small = reduce.reduce_bayer(image.data, ctx.scale, image.desc.extent)
    return {"output": demosaic.demosaic_rcd(small, image.desc.phase, _scaled(ctx, image.desc).extent)}


def _to_rgb_contract(ctx, params, descs):
    if descs["image"].coordinates.camera != descs["metadata"].camera:
        raise ContractError("image and metadata are of different cameras")
    return {"output": RgbDesc(descs["image"].extent, REC2020_D65)}


@node(id="camera-to-color-rgb", name="Camera to color RGB", tags=("input-transform", "color"), inputs={"image": Port(RGB, "camera"), "metadata": Port(METADATA)}, outputs=REC_OUT, contract=_to_rgb_contract)
def camera_to_rgb(ctx, params, frames, descs):
    image, meta = frames["image"], frames["metadata"].data
    return {"output": pointwise.transform(image.data, color.camera_matrix(meta.calibration.xyz_to_cam, image.desc.coordinates.balance))}


def _illuminant_check(values):
    if isinstance(values["illuminant"], dict):
        xy = values["illuminant"]["custom"]
        try:
            color.adaptation((xy["x"], xy["y"]))
        except (ValueError, ZeroDivisionError) as error:
            raise ContractError(f"illuminant: {error}") from error


_CUSTOM = Schema({"x": Param("float", color.D65[0]), "y": Param("float", color.D65[1])})


@node(id="chromatic-adaptation", name="Chromatic adaptation", tags=("color",), inputs={**REC_IMAGE, **META}, outputs=REC_OUT, schema=Schema({"illuminant": Param("choice", {"custom": _CUSTOM.defaults()}, options={"as_shot": None, "custom": _CUSTOM})}, _illuminant_check), contract=same)
def chromatic_adaptation(ctx, params, frames, descs):
    chosen = params["illuminant"]
    if chosen == "as_shot":
        if frames["metadata"] is None:
            raise ContractError("as-shot adaptation needs metadata")
        calibration = frames["metadata"].data.calibration
        white = color.as_shot_white(calibration.xyz_to_cam, color.as_shot_balance(calibration.as_shot))
    else:
        white = (chosen["custom"]["x"], chosen["custom"]["y"])
    return {"output": pointwise.transform(frames["image"].data, color.rec2020_adaptation(white))}


def _orientation(params, meta) -> int:
    if params["orientation"] == "from_metadata":
        return meta.orientation if meta else 1
    return int(params["orientation"])


def _orientation_contract(ctx, params, descs):
    e = descs["image"].extent
    turned = _orientation(params, descs["metadata"]) >= 5
    return {"output": replace(descs["image"], extent=Extent(e.height, e.width) if turned else e)}


@node(id="orientation", name="Orientation", tags=("geometry",), inputs={**IMAGE, **META}, outputs=RGB_OUT, schema=Schema({"orientation": Param("choice", "from_metadata", options=dict.fromkeys(["from_metadata", *map(str, range(1, 9))]))}), contract=_orientation_contract)
def orientation(ctx, params, frames, descs):
    image = frames["image"]
    o = _orientation(params, frames["metadata"].data if frames["metadata"] else None)
    return {"output": pointwise.orient(image.data, o, image.desc.extent.width, image.desc.extent.height)}


@node(id="exposure", name="Exposure", tags=("color", "look"), inputs=IMAGE, outputs=RGB_OUT, schema=Schema({"ev": Param("float", 0.0, -32, 32)}, lambda v: pointwise.check_ev(v["ev"])), contract=same, action=lambda ctx, params, frames: measure_exposure(frames["image"]))
def exposure(ctx, params, frames, descs):
    return {"output": pointwise.exposure(frames["image"].data, params["ev"])}


def measure_exposure(image: Frame) -> dict:
    """The exposure node's action: new parameters from its input, whatever its own setting is."""
    if image.desc.coordinates != REC2020_D65:
        raise ContractError("metering needs linear Rec.2020 / D65")
    from pyspark.sql import functions as F

    ev = scopes.auto_exposure(image.data.withColumn("image_id", F.lit(0).cast("long"))).first()  # one row
    if ev is None or ev["ev"] is None:
        raise ContractError("mean luminance must be finite and positive")
    return {"ev": ev["ev"]}


def _sigmoid_check(values):
    if not (0 < values["contrast"] < math.inf and -1 <= values["skew"] <= 1 and 0 <= values["preserve_hue"] <= 1):
        raise ContractError("sigmoid parameters out of range")


@node(id="sigmoid", name="Sigmoid", tags=("look", "tonemap"), inputs=REC_IMAGE, outputs=REC_OUT, schema=Schema({"contrast": Param("float", 1.5, 0.5, 4), "skew": Param("float", -0.2, -1, 1), "preserve_hue": Param("float", 0.0, 0, 1)}, _sigmoid_check), contract=same)
def sigmoid(ctx, params, frames, descs):
    return {"output": pointwise.sigmoid(frames["image"].data, **params)}


def _output() -> dict[str, Param]:
    """Settings of a conversion to an output profile."""
    file = Schema({"path": Param("path", external=True)})
    return {
        "profile": Param("choice", "srgb", options={"srgb": None, "display_p3": None, "rec2020": None, "file": file}),
        "intent": Param("choice", "relative", options=dict.fromkeys(profiles.INTENTS)),
        "black_point_compensation": Param("bool", True),
    }


def _profile(ctx, params) -> profiles.OutputProfile | str:
    if isinstance(params["profile"], str):
        return params["profile"]
    return profiles.load(ctx.spark, params["profile"], params["intent"], params["black_point_compensation"])


def _proof_profile(ctx, params) -> profiles.OutputProfile | str | None:
    return None if params["mode"] == "none" else _profile(ctx, *params["mode"].values())


def _file_export(kind, options):
    def act(ctx, params, frames):
        meta = frames["metadata"].data if frames["metadata"] else None
        encode.export(frames["image"].data, params["path"], frames["image"].desc.extent, kind, profile=params["loaded"], meta=meta, **options(params))

    return act


def _tiff_options(params):
    c = params["compression"]
    return {"depth": params["depth"], "compression": "none" if c == "none" else "deflate", "level": c["deflate"]["level"] if isinstance(c, dict) else "balanced"}


_LEVEL = Schema({"level": Param("choice", "balanced", options=dict.fromkeys(encode.DEFLATE))})


@node(
    id="export-tiff", name="Export TIFF", tags=("io", "output-transform"), inputs={**REC_IMAGE, **META}, outputs={}, contract=None, action=_file_export("tiff", _tiff_options), load=_profile,
    schema=Schema({"path": Param("path", external=True), **_output(), "depth": Param("choice", "u16", options=dict.fromkeys(("u8", "u16", "f32"))), "compression": Param("choice", {"deflate": _LEVEL.defaults()}, options={"none": None, "deflate": _LEVEL})}),
)
def export_tiff(ctx, params, frames, descs):
    return {}


def _jpeg_check(values):
    if not 1 <= values["quality"] <= 100:
        raise ContractError("quality is 1 to 100")


@node(
    id="export-jpeg", name="Export JPEG", tags=("io", "output-transform"), inputs={**REC_IMAGE, **META}, outputs={}, contract=None, action=_file_export("jpeg", lambda p: {"quality": p["quality"], "subsampling": p["subsampling"]}), load=_profile,
    schema=Schema({"path": Param("path", external=True), **_output(), "quality": Param("int", 95, 1, 100), "subsampling": Param("choice", "444", options=dict.fromkeys(("444", "422", "420")))}, _jpeg_check),
)
def export_jpeg(ctx, params, frames, descs):
    return {}


_PROOF = Schema(_output())


@node(id="preview", name="Preview", tags=("view",), inputs=REC_IMAGE, outputs=REC_OUT, schema=Schema({"mode": Param("choice", "none", options={"none": None, "softproof": _PROOF, "gamutcheck": _PROOF}), "interpolation": Param("bool", False)}), contract=same, load=_proof_profile)
def preview(ctx, params, frames, descs):
    mode, image = params["mode"], frames["image"].data
    if mode == "none":
        return {"output": image}
    (name,) = mode
    return {"output": (pointwise.soft_proof if name == "softproof" else pointwise.gamut_check)(image, params["loaded"])}


def _range_check(values):
    scopes.check_range(values["min_ev"], values["max_ev"])


def _scope(scale):
    return Schema({"min_ev": Param("float", -12.0), "max_ev": Param("float", 4.0), "scale": Param("choice", scale, options=dict.fromkeys(("linear", "log")))}, _range_check, strict=False)


@node(id="histogram", name="Histogram", tags=("view", "scope"), inputs=IMAGE, outputs={"output": Port(TABLE)}, schema=_scope("linear"), contract=same)
def histogram(ctx, params, frames, descs):
    return {"output": scopes.density(scopes.histogram(frames["image"].data, params["min_ev"], params["max_ev"]), params["scale"] == "log")}


@node(id="waveform", name="Waveform", tags=("view", "scope"), inputs=IMAGE, outputs={"output": Port(TABLE)}, schema=_scope("log"), contract=same)
def waveform(ctx, params, frames, descs):
    image = frames["image"]
    return {"output": scopes.density(scopes.waveform(image.data, image.desc.extent, params["min_ev"], params["max_ev"]), params["scale"] == "log")}


@node(id="vectorscope", name="Vectorscope", tags=("view", "scope"), inputs=REC_IMAGE, outputs={"output": Port(TABLE)}, schema=Schema({"scale": Param("choice", "log", options=dict.fromkeys(("linear", "log")))}), contract=same)
def vectorscope(ctx, params, frames, descs):
    return {"output": scopes.density(scopes.vectorscope(frames["image"].data), params["scale"] == "log")}


def develop(mosaic: Frame, metadata, settings: dict | None = None, demosaicer: str = "rcd-demosaic") -> tuple[Dag, dict[str, NodeId]]:
    """The standard development graph from a bound mosaic and metadata to the tone-mapped image."""
    settings, dag = settings or {}, Dag()
    at = {"mosaic": dag.add(bound_source(mosaic, BAYER)), "metadata": dag.add(bound_source(Frame(metadata, metadata), METADATA))}
    for kind in ("bayer-site-gains", "highlights-opposed", demosaicer, "camera-to-color-rgb", "chromatic-adaptation", "orientation", "exposure", "sigmoid"):
        at[kind] = dag.add(REGISTRY.find(kind), settings.get(kind))
    chain = ["mosaic", "bayer-site-gains", "highlights-opposed", demosaicer, "camera-to-color-rgb", "chromatic-adaptation", "orientation", "exposure", "sigmoid"]
    for a, b in zip(chain[:-1], chain[1:], strict=True):
        dag.link(at[a], at[b])
    dag.link(at["bayer-site-gains"], at["highlights-opposed"], "levels", "levels")
    for kind in ("bayer-site-gains", "camera-to-color-rgb", "chromatic-adaptation", "orientation"):
        dag.link(at["metadata"], at[kind], "metadata")
    return dag, at


def raw_template(registry: Registry = REGISTRY, sink: str = "export-tiff") -> Dag:
    """RAW file to image file, as a project that can be saved."""
    dag = Dag()
    kinds = ["bayer-raw", "bayer-site-gains", "highlights-opposed", "rcd-demosaic", "camera-to-color-rgb", "chromatic-adaptation", "orientation", "exposure", "sigmoid", sink]
    at = {k: dag.add(registry.find(k), {"illuminant": "as_shot"} if k == "chromatic-adaptation" else None) for k in kinds}
    for a, b in zip(kinds[:-1], kinds[1:], strict=True):
        dag.link(at[a], at[b], "image", "mosaic" if a == "bayer-raw" else "output")
    dag.link(at["bayer-site-gains"], at["highlights-opposed"], "levels", "levels")
    for k in ("bayer-site-gains", "camera-to-color-rgb", "chromatic-adaptation", "orientation", sink):
        dag.link(at["bayer-raw"], at[k], "metadata", "metadata")
    return dag
