"""Registered queries over rasters, one or more by operator, and their DuckDB forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow import oracles, standards
from lumaflow.functions import color
from lumaflow.functions.exprs import cfa_color
from lumaflow.model import BayerDesc, Calibration, Camera, Extent, Frame, Metadata, Phase, Response
from lumaflow.operators import demosaic, highlights, nodes, pointwise, reduce, scopes
from lumaflow.plans import project
from lumaflow.plans.evaluate import Context, evaluate
from lumaflow.sinks.encode import encode_images
from lumaflow.sources import rasters
from lumaflow.sources.jpeg import read_jpegs
from lumaflow.sources.raw import normalize_each, read_headers, read_tiff, scan_raw, write_dng, write_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CALIBRATION = Calibration(cfa=((0, 1), (3, 2)), black=100, channel_black=(10, 20, 30, 40), pattern=(1, 2, (5, 7)), maximum=2000, as_shot=(2.0, 1.0, 1.5, 1.0), xyz_to_cam=((0.9, 0.1, -0.1), (-0.2, 1.2, 0.05), (0.02, -0.1, 0.8), (0.0, 0.0, 0.0)))
PLAIN = Calibration(cfa=((0, 1), (3, 2)), black=64, channel_black=(0, 4, 8, 4), maximum=2112, as_shot=(2.0, 1.0, 1.5, 1.0), xyz_to_cam=CALIBRATION.xyz_to_cam)
LEVELS, THRESHOLD = (1.0, 0.95, 0.95, 0.9), 0.98
ILLUMINANT_A = (0.44757, 0.40745)
AS_SHOT = color.as_shot_balance(CALIBRATION.as_shot)


# Samples are often dyadic fractions that end in a 5 at the seventh decimal; a small shift on both sides keeps them off the ties of round.
OFF_TIE = 3.3e-8


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.replace(", 6)", f" + {oracles.lit(OFF_TIE)}, 6)")
        return f

    return add


def shown(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + F.lit(OFF_TIE), 6) + F.lit(0.0) for n in names})


def pixels(df: DataFrame) -> DataFrame:
    return shown(df, "r", "g", "b").select("image_id", "row", "col", "r", "g", "b")


def samples(df: DataFrame) -> DataFrame:
    return shown(df, "v").select("image_id", "row", "col", "v")


@query("normalize_raw", oracles.normalize_raw(CALIBRATION))
def normalize_raw(spark, d):
    return samples(pointwise.normalize_raw(rasters.events_codes(spark, d), CALIBRATION))


RAW_FILES = ((("A", "One", 1), 100, 2100, (0.5, 1.0, 0.8)), (("B", "Two", 6), (64, 68, 72, 76), 4096, (0.25, 1.0, 0.5)), (("A", "One", 8), 0, 65535, None))


def _raw_folder(spark, d) -> str:
    """Three files of 20 x 100 codes of the events, written where all executors see them."""
    codes = rasters.events_codes(spark, d).where(f"row < {20 * len(RAW_FILES)}").orderBy("row", "col").select("code").toPandas()["code"].to_numpy().reshape(len(RAW_FILES), 20, 100)
    return write_files(spark, {f"image-{i}.dng": write_dng(codes[i], black=black, white=white, make=make, model=model, orientation=o, neutral=neutral) for i, ((make, model, o), black, white, neutral) in enumerate(RAW_FILES)})


def _number():
    return F.regexp_extract("path", r"image-(\d+)", 1).cast("int").alias("image")


_LEVELS = "CASE i WHEN 0 THEN 100 WHEN 1 THEN 64 + 4 * ((y % 2) * 2 + x % 2) ELSE 0 END"


@query("raw_samples", f"""SELECT CAST(i AS INTEGER) AS image, CAST(y AS INTEGER) AS "row", CAST(x AS INTEGER) AS col, round((code - {_LEVELS}) / CASE i WHEN 0 THEN 2000.0::DOUBLE WHEN 1 THEN 4032.0::DOUBLE ELSE 65535.0::DOUBLE END, 6) + 0.0 AS v
FROM (SELECT code, "row" // 20 AS i, "row" % 20 AS y, col AS x FROM {oracles.CODES} WHERE "row" < 60)""")
def raw_samples(spark, d):
    """Files of two cameras through the raw source, each normalised by its own header."""
    folder = _raw_folder(spark, d)
    headers = read_headers(spark, folder)
    each = normalize_each(scan_raw(spark, folder), headers).join(headers.select("image_id", "path"), "image_id")
    return shown(each.select(_number(), "row", "col", "v"), "v")


@query("raw_headers", oracles.rows("image, width, height, make, model, orientation, black_0, black_3, white, gain_red, gain_blue", (0, 100, 20, "A", "One", 1, 100.0, 100.0, 2100.0, 2.0, 1.25), (1, 100, 20, "B", "Two", 6, 64.0, 76.0, 4096.0, 4.0, 2.0), (2, 100, 20, "A", "One", 8, 0.0, 0.0, 65535.0, 1.0, 1.0)))
def raw_headers(spark, d):
    at = lambda name, i: F.element_at(name, i + 1)
    return read_headers(spark, _raw_folder(spark, d)).select(
        _number(), "width", "height", "make", "model", "orientation", at("black", 0).alias("black_0"), at("black", 3).alias("black_3"), "white", at("as_shot", 0).alias("gain_red"), at("as_shot", 2).alias("gain_blue")
    )


def _site_gains(phase: Phase):
    cfa = {0: ((0, 1), (3, 2)), 1: ((1, 0), (2, 3)), 2: ((1, 2), (0, 3)), 3: ((2, 1), (3, 0))}[phase]
    c = Calibration(cfa=cfa, channel_black=(0, 0, 0, 500), maximum=1000, as_shot=(2.0, 1.0, 4.0, 3.0))
    gains = pointwise.site_gains(c)
    by_site = [{0: 2.0, 1: 1.0, 2: 4.0, 3: 3.0}[k] for line in cfa for k in line]
    query(f"site_gains_{phase.name.lower()}", oracles.site_gains(by_site))(lambda spark, d: samples(pointwise.apply_site_gains(rasters.events_mosaic(spark, d), gains)))

    @query(f"site_levels_{phase.name.lower()}", oracles.site_levels(str([k for line in cfa for k in line]), "[0, 0, 0, 500]", 1000, "[2.0, 1.0, 4.0, 3.0]"))
    def site_levels(spark, d):
        balance = color.as_shot_balance(c.as_shot)
        levels = [v * balance[c.cfa[i // 2][i % 2]] for i, v in enumerate(c.site_levels)]
        return shown(spark.createDataFrame(list(enumerate(levels)), "site int, level double"), "level")


for _phase in Phase:
    _site_gains(_phase)


@query("cfa_color", oracles.cfa_color(range(4)))
def cfa_colors(spark, d):
    at = spark.range(256).selectExpr("cast(id div 16 as int) as row", "cast(id % 16 as int) as col")
    parts = [at.select(F.lit(int(p)).alias("phase"), "row", "col", cfa_color(F.col("row"), F.col("col"), p).alias("color")) for p in Phase]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


for _f in (1, 2, 3):
    query(f"reduce_bayer_f{_f}", oracles.reduce_bayer(_f))(lambda spark, d, f=_f: samples(reduce.reduce_bayer(rasters.events_mosaic(spark, d), f, rasters.events_extent(spark, d))))
for _f in (2, 7):
    query(f"reduce_rgb_f{_f}", oracles.reduce_rgb(_f))(lambda spark, d, f=_f: pixels(reduce.reduce_rgb(rasters.events_rgb(spark, d), f)))


@query("demosaic_2x2", oracles.demosaic_2x2(0))
def demosaic_2x2(spark, d):
    return pixels(demosaic.demosaic_2x2(rasters.events_mosaic(spark, d), Phase.RGGB, rasters.events_extent(spark, d)))


def _mosaic_frame(spark, d) -> Frame:
    return Frame(BayerDesc(rasters.events_extent(spark, d), Phase.RGGB, Response(Camera("", ""))), rasters.events_mosaic(spark, d))


@query("demosaic_2x2_scale2", oracles.demosaic_2x2(0, f"({oracles.reduce_bayer(2).replace('round(avg(v), 6) + 0.0', 'avg(v)')})", "50", f"({oracles.HEIGHT} // 4 * 2)"))
def demosaic_2x2_scale2(spark, d):
    """The request's detail is pushed below the demosaic by the evaluator."""
    dag = nodes.Dag()
    source, node = dag.add(nodes.bound_source(_mosaic_frame(spark, d), nodes.BAYER)), dag.add(nodes.REGISTRY.find("bayer-2x2-demosaic"))
    dag.link(source, node)
    return pixels(evaluate(dag, Context(spark, 2), dag.output(node)).frame.data)


@query("demosaic_rcd")
def demosaic_rcd(spark, d):
    return pixels(demosaic.demosaic_rcd(rasters.events_mosaic(spark, d), Phase.RGGB, rasters.events_extent(spark, d)))


# Pixels (phase, row, column, R, G, B) that an implementation of the method gives for this 277 x 269 pattern.
RCD_SAMPLE = "((i * 137 + (i div 277) * 29) % 2048) / 1024D - 0.03D"
RCD_PIXELS = (
    (0, 65, 91, 1.1011219, 1.00051701, 0.857695341), (0, 186, 71, 2.64047599, 1.81667972, 1.63603163), (0, 62, 51, 0.0, 0.242460936, 0.691574931),
    (1, 118, 170, 1.16048717, 1.0852344, 0.637626886), (1, 239, 150, 0.817505777, 0.728823841, 0.0442187488), (1, 115, 130, 2.41577721, 1.47413707, 0.469999999),
    (2, 171, 249, 2.14177895, 1.31277347, 0.405323982), (2, 47, 229, 2.60264063, 1.73855472, 1.25656879), (2, 168, 209, 2.47765136, 1.61105525, 0.697539091),
    (3, 224, 75, 1.24642122, 1.69167972, 2.28666472), (3, 100, 55, 0.333478987, 0.117460936, 0.0), (3, 221, 35, 1.07644534, 0.901073158, 0.706824481),
)


@query("demosaic_rcd_pixels", 'SELECT phase, "row", col, ' + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in "rgb") + f" FROM ({oracles.rows('phase, row, col, r, g, b', *RCD_PIXELS)})")
def demosaic_rcd_pixels(spark, d):
    mosaic = rasters.formula_mosaic(spark, 277, 269, RCD_SAMPLE)
    parts = [demosaic.demosaic_rcd(mosaic, p, Extent(277, 269), tile=128).select(F.lit(int(p)).alias("phase"), "row", "col", "r", "g", "b") for p in Phase]
    wanted = spark.createDataFrame([x[:3] for x in RCD_PIXELS], "phase int, row int, col int")
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.join(wanted, ["phase", "row", "col"], "left_semi").select("phase", "row", "col", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "rgb"])


def _marked(spark, d):
    return highlights.marked(rasters.events_mosaic(spark, d), LEVELS, THRESHOLD, Phase.RGGB)


@query("highlights_mask", oracles.highlights("mask", LEVELS, THRESHOLD, 0))
def highlights_mask(spark, d):
    return highlights.clip_mask(_marked(spark, d))


@query("highlights_dilate", oracles.highlights("dilate", LEVELS, THRESHOLD, 0))
def highlights_dilate(spark, d):
    return highlights.dilate(highlights.clip_mask(_marked(spark, d)), rasters.events_extent(spark, d))


@query("highlights_reference3x3", oracles.highlights("reference", LEVELS, THRESHOLD, 0))
def highlights_reference(spark, d):
    mosaic = rasters.events_mosaic(spark, d)
    return shown(highlights.reference(mosaic, mosaic, Phase.RGGB), "reference")


@query("highlights_chroma", oracles.highlights("chroma", LEVELS, THRESHOLD, 0))
def highlights_chroma(spark, d):
    e = rasters.events_extent(spark, d)
    tiles = highlights.tiling_of(e).deal(rasters.events_mosaic(spark, d))
    return shown(highlights.chrominance(tiles, LEVELS, Phase.RGGB, e, THRESHOLD), "chroma")


@query("highlights_opposed", oracles.highlights("opposed", LEVELS, THRESHOLD, 0))
def highlights_opposed(spark, d):
    return samples(highlights.highlights_opposed(rasters.events_mosaic(spark, d), LEVELS, Phase.RGGB, rasters.events_extent(spark, d), THRESHOLD))


def _bag_transform(name: str, matrix, expected):
    query(name, oracles.transform(expected))(lambda spark, d: pixels(pointwise.transform(rasters.lineitem_bag(spark, d), matrix)))


_bag_transform("camera_to_rgb", color.camera_matrix(CALIBRATION.xyz_to_cam, AS_SHOT), standards.camera(CALIBRATION.xyz_to_cam, (2.0, 1.0, 1.5, 1.0)))
_bag_transform("cat16_custom", color.rec2020_adaptation(ILLUMINANT_A), standards.adapted(ILLUMINANT_A))
_bag_transform("cat16_as_shot", color.rec2020_adaptation(color.as_shot_white(CALIBRATION.xyz_to_cam, AS_SHOT)), standards.adapted(standards.camera_white(CALIBRATION.xyz_to_cam, (2.0, 1.0, 1.5, 1.0))))
for _name, _ev in (("exposure", 1.25), ("exposure_negative_ev", -3.5)):
    query(_name, oracles.exposure(_ev))(lambda spark, d, ev=_ev: pixels(pointwise.exposure(rasters.lineitem_bag(spark, d), ev)))
for _name, _args, _signed in (("sigmoid_default", (1.5, -0.2, 0.0), False), ("sigmoid_hue_half", (2.0, 0.3, 0.5), False), ("sigmoid_negative_rgb", (1.5, -0.2, 1.0), True)):
    query(_name, oracles.sigmoid(*_args, oracles.SIGNED if _signed else oracles.BAG))(lambda spark, d, a=_args, s=_signed: pixels(pointwise.sigmoid((rasters.embedding_rgb if s else rasters.lineitem_bag)(spark, d), *a)))
for _o in range(1, 9):

    @query(f"orientation_{_o}", oracles.orientation(_o))
    def orientation(spark, d, o=_o):
        e = rasters.events_extent(spark, d)
        return pixels(pointwise.orient(rasters.events_rgb(spark, d), o, e.width, e.height))


@query("orientation_from_metadata", oracles.orientation_from_metadata())
def orientation_from_metadata(spark, d):
    images = rasters.embedding_images(spark, d)
    meta = rasters.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), (F.col("vec_id") % 8 + 1).alias("orientation"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return samples(pointwise.orient_each(images, meta))


query("histogram_default", oracles.histogram(-12.0, 4.0))(lambda spark, d: scopes.histogram(rasters.lineitem_bag(spark, d)))
query("histogram_range", oracles.histogram(-3.0, 1.5))(lambda spark, d: scopes.histogram(rasters.lineitem_bag(spark, d), -3.0, 1.5))
query("histogram_by_image", oracles.histogram(-12.0, 4.0, oracles.SIGNED))(lambda spark, d: scopes.histogram(rasters.embedding_rgb(spark, d)))
query("waveform", oracles.waveform(-12.0, 4.0))(lambda spark, d: scopes.waveform(rasters.events_rgb(spark, d), rasters.events_extent(spark, d)))
_ONE = "(SELECT 0::BIGINT AS image_id, r, g, b FROM " + oracles.BAG + ")"


def _one_bag(spark, d):
    return rasters.lineitem_bag(spark, d).withColumn("image_id", F.lit(0).cast("long"))


query("vectorscope", oracles.vectorscope(_ONE))(lambda spark, d: scopes.vectorscope(_one_bag(spark, d)))
for _log in (False, True):
    _which = "log" if _log else "linear"
    query(f"scope_density_{_which}", oracles.density(oracles.histogram(-12.0, 4.0, _ONE), _log, "channel, bin"))(lambda spark, d, log=_log: shown(scopes.density(scopes.histogram(_one_bag(spark, d)), log), "density"))


@query("vectorscope_colors", oracles.vectorscope_colors(_ONE))
def vectorscope_colors(spark, d):
    return shown(scopes.vectorscope_colors(scopes.density(scopes.vectorscope(_one_bag(spark, d)), True)), "r", "g", "b")


query("auto_exposure", oracles.auto_exposure(oracles.BAG))(lambda spark, d: shown(scopes.auto_exposure(rasters.lineitem_bag(spark, d)), "mean", "ev"))
for _p in color.PROFILES:
    query(f"softproof_{_p}", oracles.soft_proof(_p))(lambda spark, d, p=_p: pixels(pointwise.soft_proof(rasters.events_rgb(spark, d), p)))
    query(f"gamutcheck_{_p}", oracles.soft_proof(_p, True))(lambda spark, d, p=_p: pixels(pointwise.gamut_check(rasters.events_rgb(spark, d), p)))
for _p, _depth, _most in (("srgb", "u8", 255), ("p3", "u16", 65535), ("rec2020", "u16", 65535)):
    query(f"encode_{_depth}_{_p}", oracles.encode(_p, _most))(lambda spark, d, p=_p, depth=_depth: pointwise.encode_profile(rasters.events_rgb(spark, d), p, depth).select("image_id", "row", "col", "r", "g", "b"))
query("display_encoding", oracles.display())(lambda spark, d: pixels(pointwise.display(rasters.events_rgb(spark, d))))
query("sigmoid_curve_samples", oracles.curve_samples(1.5, -0.2))(lambda spark, d: shown(scopes.curve_samples(spark), "value"))


@query("batch_pipeline", oracles.supplier_gains())
def batch_pipeline(spark, d):
    """Many small images in one plan: gains by image from a metadata table (images without a row keep their samples),
    demosaic, metering by image."""
    k = F.col("s_suppkey")
    gains = rasters.table(spark, d, "supplier").select(k.cast("long").alias("image_id"), F.array(1.0 + k % 7 / F.lit(10.0), F.lit(1.0), F.lit(1.0), 1.0 + k % 5 / F.lit(10.0)).alias("gains"))
    mosaic = pointwise.apply_image_gains(rasters.embedding_images(spark, d), gains)
    return shown(scopes.auto_exposure(demosaic.demosaic_2x2(mosaic, Phase.RGGB, Extent(8, 8))), "mean", "ev")


def _settings() -> dict:
    """What the flagship's calibration comes to, for its DuckDB form: sites red, green, second green, blue."""
    gains, black = (2.0, 1.0, 1.0, 1.5), (64, 68, 68, 72)
    return {
        "calibration": PLAIN, "phase": 0, "gains": gains, "levels": tuple((2112 - b) / (2112 - 64) * g for b, g in zip(black, gains, strict=True)),
        "camera": standards.camera(PLAIN.xyz_to_cam, (2.0, 1.0, 1.5, 1.0)), "cat": standards.adapted(standards.camera_white(PLAIN.xyz_to_cam, (2.0, 1.0, 1.5, 1.0))), "ev": 0.5,
    }


def _developed(spark, d) -> DataFrame:
    meta = Metadata(make="Maker", model="One", calibration=PLAIN)
    codes = rasters.events_codes(spark, d)
    mosaic = Frame(BayerDesc(rasters.events_extent(spark, d), Phase.RGGB, Response(meta.camera)), pointwise.normalize_raw(codes, PLAIN))
    dag, at = nodes.develop(mosaic, meta, {"chromatic-adaptation": {"illuminant": "as_shot"}, "exposure": {"ev": 0.5}}, "bayer-2x2-demosaic")
    return evaluate(dag, Context(spark), dag.output(at["sigmoid"])).frame.data


@query("flagship", oracles.flagship(_settings()))
def flagship(spark, d):
    """Gains, highlights, demosaic, camera matrix, adaptation, exposure, tone curve, counts of the toned channels."""
    toned = scopes.channels(_developed(spark, d))
    bin_of = F.floor(F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)) * 16).cast("int")
    return toned.groupBy("channel", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("export_tiff", oracles.encode("srgb", 65535))
def export_tiff(spark, d):
    """The pixels that are read back from the written file."""
    files = encode_images(rasters.events_rgb(spark, d), rasters.events_extent(spark, d), "tiff", depth="u16", compression="deflate", meta=Metadata(make="Maker", iso=100))
    return read_tiff(files)


@query("export_jpeg", 'SELECT 0::BIGINT AS image_id, count(*) AS pixels, max(event_id // 100) + 1 AS height, true AS close FROM events')
def export_jpeg(spark, d):
    """What is read back from the written file: its pixels, and whether their lightness is that of the encoded ones. The
    raster is noise, the worst case for shared chroma: 2.4 of 255 are lost on the mean, 3 are allowed."""
    rgb, extent = rasters.events_rgb(spark, d), rasters.events_extent(spark, d)
    back = read_jpegs(encode_images(rgb, extent, "jpeg", quality=95, subsampling="420", meta=Metadata(make="Maker", iso=100)))
    light = lambda name: (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias(name)
    both = back.select("image_id", "row", "col", light("got")).join(pointwise.encode_profile(rgb, "srgb", "u8").select("image_id", "row", "col", light("want")), highlights.KEY)
    sums = both.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), (F.max("row") + 1).cast("long").alias("height"), F.avg(F.abs(F.col("got") - F.col("want"))).alias("off"))
    return sums.select("image_id", "pixels", "height", (F.col("off") < 3).alias("close"))


@query("bound_source", "SELECT 0::BIGINT AS image_id, CAST(i // 3 AS INTEGER) AS \"row\", CAST(i % 3 AS INTEGER) AS col, CAST(i AS DOUBLE) / 4 AS v FROM range(6) t(i)")
def bound_source(spark, d):
    return rasters.bound_mosaic(spark, [i / 4 for i in range(6)], Extent(3, 2), Phase.RGGB, Camera("", "")).data


# The steps and settings of the template project, the registered kinds in their order, and what searches find.
TEMPLATE = (
    (0, "bayer-raw", '{"path": null}', True), (1, "bayer-site-gains", "{}", True), (2, "highlights-opposed", '{"threshold": 0.98}', True), (3, "rcd-demosaic", "{}", True),
    (4, "camera-to-color-rgb", "{}", True), (5, "chromatic-adaptation", '{"illuminant": "as_shot"}', True), (6, "orientation", '{"orientation": "from_metadata"}', True),
    (7, "exposure", '{"ev": 0.0}', True), (8, "sigmoid", '{"contrast": 1.5, "preserve_hue": 0.0, "skew": -0.2}', True),
    (9, "export-tiff", '{"black_point_compensation": true, "compression": {"deflate": {"level": "balanced"}}, "depth": "u16", "intent": "relative", "path": null, "profile": "srgb"}', True),
)
KINDS = (
    ("bayer-raw", "Bayer RAW", "io,bayer-raw"), ("reduce-bayer", "Reduce Bayer", "bayer-raw,geometry"), ("reduce-rgb", "Reduce RGB", "geometry"),
    ("bayer-site-gains", "Bayer site gains", "input-transform,bayer-raw,color"), ("highlights-opposed", "Highlights: opposed", "bayer-raw,recovery"),
    ("bayer-2x2-demosaic", "Demosaic: 2x2", "bayer-raw,demosaic"), ("rcd-demosaic", "Demosaic: RCD", "bayer-raw,demosaic"),
    ("camera-to-color-rgb", "Camera to color RGB", "input-transform,color"), ("chromatic-adaptation", "Chromatic adaptation", "color"), ("orientation", "Orientation", "geometry"),
    ("exposure", "Exposure", "color,look"), ("sigmoid", "Sigmoid", "look,tonemap"), ("export-tiff", "Export TIFF", "io,output-transform"), ("export-jpeg", "Export JPEG", "io,output-transform"),
    ("preview", "Preview", "view"), ("histogram", "Histogram", "view,scope"), ("waveform", "Waveform", "view,scope"), ("vectorscope", "Vectorscope", "view,scope"),
)
FOUND = (
    ("re", "reduce-bayer reduce-rgb exposure preview highlights-opposed"), ("bayer", "bayer-raw bayer-site-gains reduce-bayer bayer-2x2-demosaic rcd-demosaic highlights-opposed"),
    ("scope", "vectorscope histogram waveform"), ("rgb", "camera-to-color-rgb reduce-rgb"),
)


@query("project_roundtrip", oracles.rows("place, kind, parameters, same", *TEMPLATE))
def project_roundtrip(spark, d):
    text = project.to_json(nodes.raw_template())
    again = project.to_json(project.from_json(text, nodes.REGISTRY)[0])
    rows = [(i, n["kind"], json.dumps(n["parameters"], sort_keys=True), text == again) for i, n in enumerate(json.loads(again)["nodes"])]
    return spark.createDataFrame(rows, "place int, kind string, parameters string, same boolean")


@query("registry_kinds", oracles.rows("kind, name, tags", *KINDS))
def registry_kinds(spark, d):
    return spark.createDataFrame([(k.id, k.name, list(k.tags)) for k in nodes.REGISTRY.kinds.values()], "kind string, name string, tags array<string>").select("kind", "name", F.array_join("tags", ",").alias("tags"))


@query("node_search", oracles.rows("text, place, kind", *((text, i, kind) for text, kinds in FOUND for i, kind in enumerate(kinds.split()))))
def node_search(spark, d):
    rows = [(text, i, k.id) for text in ("re", "bayer", "scope", "rgb") for i, k in enumerate(nodes.REGISTRY.search(text))]
    return spark.createDataFrame(rows, "text string, place int, kind string")
