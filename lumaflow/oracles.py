"""DuckDB forms of the registered queries, written against the tables on their own terms.

Matrices and curve constants in them come from `standards`, not from the functions that the queries use. Literals go in
as the same doubles; results are rounded as the queries round theirs."""

from __future__ import annotations

import numpy as np

from lumaflow import standards


def lit(x: float) -> str:
    return f"'{float(x)!r}'::DOUBLE"


def rounded(*names: str) -> str:
    return ", ".join(f'round({n}, 6) + 0.0 AS {n}' for n in names)


def place(key: str, width: int = 100) -> str:
    return f'0::BIGINT AS image_id, CAST({key} // {width} AS INTEGER) AS "row", CAST({key} % {width} AS INTEGER) AS col'


HEIGHT = "(SELECT count(*) // 100 FROM events)"
MOSAIC = f"(SELECT {place('event_id')}, CAST(value AS DOUBLE) / 128 AS v FROM events)"
CODES = f"(SELECT {place('event_id')}, CAST(floor(CAST(value AS DOUBLE) * 16) AS INTEGER) AS code FROM events)"
EVENTS_RGB = f"(SELECT {place('event_id')}, CAST(value AS DOUBLE) / 128 AS r, (event_id % 97) / 97.0::DOUBLE AS g, (user_id % 53) / 53.0::DOUBLE AS b FROM events)"
BAG = '(SELECT CAST(l_suppkey AS BIGINT) AS image_id, CAST(l_orderkey AS INTEGER) AS "row", CAST(l_linenumber AS INTEGER) AS col, CAST(l_extendedprice AS DOUBLE) / 105000 AS r, CAST(l_quantity AS DOUBLE) / 50 AS g, CAST(l_discount AS DOUBLE) * 10 AS b FROM lineitem)'
_AT = 'CAST(embedding[(i + {k}) % len(embedding) + 1] AS DOUBLE)'
SIGNED = '(SELECT 0::BIGINT AS image_id, CAST(vec_id AS INTEGER) AS "row", CAST(i AS INTEGER) AS col, ' + ", ".join(f"{_AT.format(k=k)} AS {c}" for k, c in enumerate("rgb")) + " FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"
IMAGES = '(SELECT CAST(vec_id AS BIGINT) AS image_id, CAST(i // 8 AS INTEGER) AS "row", CAST(i % 8 AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) + 0.6::DOUBLE AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))'
KEYS = 'image_id, "row", col'


def site(values, row: str = '"row"', col: str = "col") -> str:
    v = [lit(x) for x in values]
    return f"CASE {row} % 2 * 2 + {col} % 2 WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} WHEN 2 THEN {v[2]} ELSE {v[3]} END"


def cfa(phase: int, row: str = '"row"', col: str = "col") -> str:
    y, x = f"(({row} + {phase // 2}) % 2)", f"(({col} + {phase}) % 2)"
    return f"CAST(CASE WHEN {y} = {x} THEN 2 * {y} ELSE 1 END AS INTEGER)"


def combine(row, names=("r", "g", "b")) -> str:
    return " + ".join(f"{lit(w)} * {n}" for w, n in zip(row, names, strict=True))


def normalize_raw(c) -> str:
    black = site([c.black + c.channel_black[c.cfa[i // 2][i % 2]] for i in range(4)])
    _, width, values = c.pattern
    pattern = f"CASE (\"row\" % {c.pattern[0]}) * {width} + col % {width} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END" if values else "0.0::DOUBLE"
    return f"SELECT {KEYS}, round((code - ({black} + {pattern})) / {lit(c.range)}, 6) + 0.0 AS v FROM {CODES}"


def site_gains(gains) -> str:
    return f"SELECT {KEYS}, round(v * {site(gains)}, 6) + 0.0 AS v FROM {MOSAIC}"


def site_levels(cfa: str, black: str, maximum: int, gains: str) -> str:
    """Levels by site from a filter pattern and lists by colour, all as written in the query's calibration."""
    colour = f"({cfa})[site + 1]"
    return f"SELECT CAST(site AS INTEGER) AS site, round(({maximum} - ({black})[{colour} + 1]) / {maximum}.0::DOUBLE * ({gains})[{colour} + 1], 6) AS level FROM range(4) t(site)"


def rows(names: str, *values: tuple) -> str:
    """A table of literals."""
    shown = lambda x: str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else f"{x}::INTEGER"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, v)) + ")" for v in values) + f") t({names})"


def cfa_color(phases) -> str:
    return " UNION ALL ".join(f'SELECT {p} AS phase, "row", col, {cfa(p)} AS color FROM (SELECT CAST(i // 16 AS INTEGER) AS "row", CAST(i % 16 AS INTEGER) AS col FROM range(256) t(i))' for p in phases)


def reduce_bayer(f: int, source: str = MOSAIC) -> str:
    if f == 1:
        return f"SELECT {KEYS}, round(v, 6) + 0.0 AS v FROM {source}"
    o = lambda c: f'CAST({c} // {2 * f} * 2 + {c} % 2 AS INTEGER)'
    w, h = max(100 // (2 * f) * 2, 2), f"greatest({HEIGHT} // {2 * f} * 2, 2)"
    inner = f'SELECT image_id, {o(chr(34) + "row" + chr(34))} AS "row", {o("col")} AS col, v FROM {source}'
    return f'SELECT {KEYS}, round(avg(v), 6) + 0.0 AS v FROM ({inner}) WHERE "row" < {h} AND col < {w} GROUP BY ALL'


def demosaic_2x2(phase: int, source: str = MOSAIC, width: str = "100", height: str = HEIGHT, decimals: int | None = 6) -> str:
    c = cfa(phase)
    part = lambda k, w="1": f"sum(CASE WHEN {c} = {k} THEN v * {w} END)"
    shown = (lambda x: f"round({x}, {decimals}) + 0.0") if decimals else (lambda x: x)
    return f'SELECT image_id, CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, {shown(part(0))} AS r, {shown(part(1, "0.5::DOUBLE"))} AS g, {shown(part(2))} AS b FROM {source} WHERE "row" < {height} // 2 * 2 AND col < {width} // 2 * 2 GROUP BY 1, 2, 3'


def transform(m, source: str = BAG) -> str:
    return f"SELECT {KEYS}, " + ", ".join(f"round({combine(row)}, 6) + 0.0 AS {n}" for row, n in zip(m, "rgb", strict=True)) + f" FROM {source}"


def exposure(ev: float, source: str = BAG) -> str:
    return f"SELECT {KEYS}, " + ", ".join(f"round({n} * {lit(2.0**ev)}, 6) + 0.0 AS {n}" for n in "rgb") + f" FROM {source}"


def sigmoid(contrast: float, skew: float, hue: float, source: str, decimals: int | None = 6) -> str:
    k = standards.tone_curve(contrast, skew)
    h = lit(hue)
    z = lambda w: f"({lit(k['log_exposure'])} - {lit(k['film'])} * ln({w}))"
    curve = lambda w: f"CASE WHEN {w} > 0 THEN exp({lit(-k['paper'])} * (greatest({z(w)}, 0.0::DOUBLE) + ln(1 + exp(-abs({z(w)}))))) ELSE 0.0::DOUBLE END"
    shown = (lambda x: f"round({x}, {decimals}) + 0.0") if decimals else (lambda x: x)
    by = lambda name, a, b, c: f"CASE {name} WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
    return f"""
WITH s0 AS (SELECT *, greatest((r + g + b) / 3, 0.0::DOUBLE) AS av, least(r, g, b) AS mn FROM {source}),
s1 AS (SELECT {KEYS}, {", ".join(f"CASE WHEN mn < 0 THEN greatest(av + av / (av - mn) * ({c} - av), 0.0::DOUBLE) ELSE {c} END AS {c}" for c in "rgb")} FROM s0),
s2 AS (SELECT {KEYS}, {", ".join(f"{combine(row)} AS w{i}" for i, row in enumerate(k["inset"]))} FROM s1),
s3 AS (SELECT *, {", ".join(f"{curve(f'w{i}')} AS m{i}" for i in range(3))},
  CAST(w1 < w0 AS INTEGER) + CAST(w2 < w0 AS INTEGER) AS p0, CAST(w0 <= w1 AS INTEGER) + CAST(w2 < w1 AS INTEGER) AS p1, CAST(w0 <= w2 AS INTEGER) + CAST(w1 <= w2 AS INTEGER) AS p2 FROM s2),
s4 AS (SELECT *, {", ".join(f"CASE WHEN p0 = {n} THEN {x}0 WHEN p1 = {n} THEN {x}1 ELSE {x}2 END AS {x}{name}" for x in "wm" for n, name in enumerate(("lo", "mid", "hi")))} FROM s3),
s5 AS (SELECT *, CASE WHEN whi > wlo THEN (wmid - wlo) / (whi - wlo) ELSE 0.0::DOUBLE END AS f FROM s4),
s6 AS (SELECT *, (1 - {h}) * mmid + {h} * (mlo + (mhi - mlo) * f) AS naive, CASE WHEN wlo + wmid > 0 THEN 2 * wlo / (wlo + wmid) ELSE 0.0::DOUBLE END AS blend FROM s5),
s7 AS (SELECT *, blend * (mlo + mmid + mhi) + (1 - blend) * (mlo + naive + mhi) AS e FROM s6),
s8 AS (SELECT *, CASE WHEN naive <= mmid THEN ((1 - {h}) * mmid + {h} * (f * mhi + (1 - f) * (e - mhi))) / (1 + {h} * (1 - f)) ELSE ((1 - {h}) * mmid + {h} * (mlo * (1 - f) + f * (e - mlo))) / (1 + {h} * f) END AS nm FROM s7),
s9 AS (SELECT *, CASE WHEN naive <= mmid THEN e - mhi - nm ELSE mlo END AS a0, nm AS a1, CASE WHEN naive <= mmid THEN mhi ELSE e - mlo - nm END AS a2 FROM s8),
s10 AS (SELECT {KEYS}, {", ".join(f"{by(f'p{i}', 'a0', 'a1', 'a2')} AS c{i}" for i in range(3))} FROM s9)
SELECT {KEYS}, {", ".join(f"{shown(combine(row, ('c0', 'c1', 'c2')))} AS {n}" for row, n in zip(k["outset"], "rgb", strict=True))} FROM s10"""


def orientation(o: int, source: str = EVENTS_RGB, width: str = "100", height: str = HEIGHT) -> str:
    x = f"{width} - 1 - col" if o in (2, 3, 7, 8) else "col"
    y = f'{height} - 1 - "row"' if o in (3, 4, 6, 7) else '"row"'
    row, col = (y, x) if o < 5 else (x, y)
    return f'SELECT image_id, CAST({row} AS INTEGER) AS "row", CAST({col} AS INTEGER) AS col, {rounded("r", "g", "b")} FROM {source}'


def orientation_from_metadata() -> str:
    o = "(image_id % 8 + 1)"
    x, y = f"CASE WHEN {o} IN (2, 3, 7, 8) THEN 7 - col ELSE col END", f'CASE WHEN {o} IN (3, 4, 6, 7) THEN 7 - "row" ELSE "row" END'
    return f'SELECT image_id, CAST(CASE WHEN {o} < 5 THEN {y} ELSE {x} END AS INTEGER) AS "row", CAST(CASE WHEN {o} < 5 THEN {x} ELSE {y} END AS INTEGER) AS col, round(v, 6) + 0.0 AS v FROM {IMAGES}'


def reduce_rgb(f: int) -> str:
    return f'SELECT image_id, CAST("row" // {f} AS INTEGER) AS "row", CAST(col // {f} AS INTEGER) AS col, ' + ", ".join(f"round(avg({n}), 6) + 0.0 AS {n}" for n in "rgb") + f" FROM {EVENTS_RGB} GROUP BY 1, 2, 3"


def _edges(low: float, high: float) -> str:
    return "[" + ", ".join(lit(e) for e in standards.bin_edges(low, high)) + "]"


def _bin(low: float, high: float, v: str = "v") -> str:
    return f"CAST(greatest(CASE WHEN isnan({v}) THEN 0 ELSE len(list_filter({_edges(low, high)}, lambda e: e <= {v})) END, 1) - 1 AS INTEGER)"


def _channels(source: str, keep: str = "image_id") -> str:
    return "(" + " UNION ALL ".join(f"SELECT {keep}, {i} AS channel, {n} AS v FROM {source}" for i, n in enumerate("rgb")) + ")"


def histogram(low: float, high: float, source: str = BAG) -> str:
    return f"""
WITH c AS (SELECT image_id, channel, {_bin(low, high)} AS bin, count(*) AS n FROM {_channels(source)} GROUP BY 1, 2, 3),
grid AS (SELECT i.image_id, CAST(k.range AS INTEGER) AS channel, CAST(b.range AS INTEGER) AS bin FROM (SELECT DISTINCT image_id FROM {source}) i, range(3) k, range(256) b)
SELECT grid.image_id, grid.channel, grid.bin, coalesce(c.n, 0)::BIGINT AS n FROM grid LEFT JOIN c USING (image_id, channel, bin)"""


def waveform(low: float, high: float) -> str:
    source = EVENTS_RGB
    return f"""
WITH c AS (SELECT image_id, channel, CAST(255 - {_bin(low, high)} AS INTEGER) AS y, x, count(*) AS n FROM {_channels(source, "image_id, CAST(col * 256 // 100 AS INTEGER) AS x")} GROUP BY 1, 2, 3, 4),
grid AS (SELECT i.image_id, CAST(k.range AS INTEGER) AS channel, CAST(y.range AS INTEGER) AS y, CAST(x.range AS INTEGER) AS x FROM (SELECT DISTINCT image_id FROM {source}) i, range(3) k, range(256) y, range(256) x)
SELECT grid.image_id, grid.channel, grid.y, grid.x, coalesce(c.n, 0)::BIGINT AS n FROM grid LEFT JOIN c USING (image_id, channel, y, x)"""


def vectorscope_counts(source: str) -> str:
    u, v = standards.white_uv()
    m = standards.to_xyz("rec2020")
    clean = ", ".join(f"CASE WHEN NOT isnan({n}) AND {n} > 0 THEN {n} ELSE 0.0::DOUBLE END AS {n}" for n in "rgb")
    bin_of = lambda t: f"least(greatest(floor(({t}) * 256), 0), 255)"
    return f"""
SELECT image_id, CAST(CASE WHEN r = g AND g = b THEN 128 ELSE {bin_of(f"0.5::DOUBLE - 9 * y / d + {lit(v)}")} END AS INTEGER) AS y,
       CAST(CASE WHEN r = g AND g = b THEN 128 ELSE {bin_of(f"0.5::DOUBLE + 4 * x / d - {lit(u)}")} END AS INTEGER) AS x, count(*) AS n
FROM (SELECT *, x + 15 * y + 3 * z AS d FROM (SELECT *, {combine(m[0])} AS x, {combine(m[1])} AS y, {combine(m[2])} AS z
  FROM (SELECT image_id, r / p AS r, g / p AS g, b / p AS b FROM (SELECT *, greatest(r, g, b) AS p FROM (SELECT image_id, {clean} FROM {source})) WHERE p > 0)))
GROUP BY 1, 2, 3"""


def vectorscope(source: str) -> str:
    return f"""
WITH c AS ({vectorscope_counts(source)}),
grid AS (SELECT i.image_id, CAST(y.range AS INTEGER) AS y, CAST(x.range AS INTEGER) AS x FROM (SELECT DISTINCT image_id FROM {source}) i, range(256) y, range(256) x)
SELECT grid.image_id, grid.y, grid.x, coalesce(c.n, 0)::BIGINT AS n FROM grid LEFT JOIN c USING (image_id, y, x)"""


def density(counts: str, log: bool, keys: str) -> str:
    level = "ln(1 + n)" if log else "CAST(n AS DOUBLE)"
    return f"SELECT image_id, {keys}, n, round({level} / greatest(max({level}) OVER (PARTITION BY image_id), 1.0::DOUBLE), 6) AS density FROM ({counts})"


def vectorscope_colors(source: str) -> str:
    u, v = standards.white_uv()
    power, scale, offset, toe, end = standards.CURVES["srgb"]
    back = np.linalg.inv(standards.to_xyz("srgb"))
    coded = lambda x: f"CASE WHEN {x} <= {lit(end)} THEN {x} * {lit(toe)} ELSE {lit(scale)} * pow({x}, {lit(power)}) - {lit(offset)} END"
    return f"""
WITH d AS (SELECT *, ln(1 + n) / greatest(max(ln(1 + n)) OVER (PARTITION BY image_id), 1.0::DOUBLE) AS density, (x + 0.5::DOUBLE) / 256 - 0.5::DOUBLE + {lit(u)} AS u, 0.5::DOUBLE - (y + 0.5::DOUBLE) / 256 + {lit(v)} AS v FROM ({vectorscope(source)})),
xyz AS (SELECT *, 9 * u / (4 * v) AS big_x, 1.0::DOUBLE AS big_y, (12 - 3 * u - 20 * v) / (4 * v) AS big_z FROM d WHERE v > 0),
lin AS (SELECT image_id, y, x, density, {", ".join(f"greatest({combine(row, ('big_x', 'big_y', 'big_z'))}, 0.0::DOUBLE) AS {n}" for row, n in zip(back, "rgb", strict=True))} FROM xyz),
top AS (SELECT *, greatest(r, g, b, {lit(1e-12)}) AS p FROM lin)
SELECT image_id, y, x, {", ".join(f"round(({coded(f'({n} / p)')}) * density, 6) + 0.0 AS {n}" for n in "rgb")} FROM top"""


def auto_exposure(source: str) -> str:
    w = standards.to_xyz("rec2020")[1]
    return f"SELECT image_id, round(m, 6) AS mean, CASE WHEN m > 0 AND isfinite(m) THEN round(log2({lit(standards.GREY)} / m), 6) END AS ev FROM (SELECT image_id, avg({combine(w)}) AS m FROM {source} GROUP BY 1)"


def soft_proof(profile: str, check: bool = False) -> str:
    m, back = standards.between("rec2020", profile), standards.between(profile, "rec2020")
    clip = "(SELECT *, " + ", ".join(f"least(greatest(d{i}, 0.0::DOUBLE), 1.0::DOUBLE) AS c{i}" for i in range(3)) + f" FROM (SELECT *, {', '.join(f'{combine(row)} AS d{i}' for i, row in enumerate(m))} FROM {EVENTS_RGB}))"
    outside = "least(d0, d1, d2) < '-0.001'::DOUBLE OR greatest(d0, d1, d2) >= '1.001'::DOUBLE"
    shown = [f"round({combine(row, ('c0', 'c1', 'c2'))}, 6) + 0.0" for row in back]
    if check:
        shown = [f"CASE WHEN {outside} THEN {x}::DOUBLE ELSE {s} END" for s, x in zip(shown, ("0.0", "1.0", "1.0"), strict=True)]
    return f"SELECT {KEYS}, " + ", ".join(f"{s} AS {n}" for s, n in zip(shown, "rgb", strict=True)) + f" FROM {clip}"


def encode(profile: str, most: int) -> str:
    m, (power, scale, offset, toe, end) = standards.between("rec2020", profile), standards.CURVES[profile]
    coded = lambda v: f"CASE WHEN {v} <= {lit(end)} THEN {v} * {lit(toe)} ELSE {lit(scale)} * pow({v}, {lit(power)}) - {lit(offset)} END"
    clip = f"(SELECT *, {', '.join(f'least(greatest({combine(row)}, 0.0::DOUBLE), 1.0::DOUBLE) AS c{i}' for i, row in enumerate(m))} FROM {EVENTS_RGB})"
    return f"SELECT {KEYS}, " + ", ".join(f"CAST(floor(({coded(f'c{i}')}) * {most} + 0.5::DOUBLE) AS INTEGER) AS {n}" for i, n in enumerate("rgb")) + f" FROM {clip}"


def display() -> str:
    m, (power, scale, offset, toe, end) = standards.between("rec2020", "srgb"), standards.CURVES["srgb"]
    coded = lambda v: f"sign({v}) * CASE WHEN abs({v}) <= {lit(end)} THEN abs({v}) * {lit(toe)} ELSE {lit(scale)} * pow(abs({v}), {lit(power)}) - {lit(offset)} END"
    clip = f"(SELECT {KEYS}, {', '.join(f'least(greatest({n}, 0.0::DOUBLE), 1.0::DOUBLE) AS {n}' for n in 'rgb')} FROM {EVENTS_RGB})"
    moved = f"(SELECT {KEYS}, {', '.join(f'{combine(row)} AS c{i}' for i, row in enumerate(m))} FROM {clip})"
    return f"SELECT {KEYS}, " + ", ".join(f"round({coded(f'c{i}')}, 6) + 0.0 AS {n}" for i, n in enumerate("rgb")) + f" FROM {moved}"


def curve_samples(contrast: float, skew: float) -> str:
    k = standards.tone_curve(contrast, skew)
    z = f"({lit(k['log_exposure'])} - {lit(k['film'])} * ln(v))"
    return f"SELECT CAST(i AS INTEGER) AS i, round(exp({lit(-k['paper'])} * (greatest({z}, 0.0::DOUBLE) + ln(1 + exp(-abs({z}))))), 6) AS value FROM (SELECT i, {lit(standards.GREY)} * pow(2.0::DOUBLE, 16.0::DOUBLE * i / 128 - 8) AS v FROM range(129) t(i))"


def highlight_steps(levels, threshold: float, phase: int, source: str = MOSAIC) -> str:
    """Common table expressions of the highlight stages, by neighbour joins."""
    clip = site([v * threshold for v in levels])
    h = HEIGHT
    others = lambda: "CASE color WHEN 0 THEN cbrt(m1) + cbrt(m2) WHEN 1 THEN cbrt(m0) + cbrt(m2) ELSE cbrt(m0) + cbrt(m1) END"
    mean = lambda k: f"coalesce(sum(CASE WHEN n.color = {k} AND n.v > 0 THEN n.v WHEN n.color = {k} THEN 0.0::DOUBLE END), 0.0::DOUBLE) / greatest(count(CASE WHEN n.color = {k} THEN 1 END), 1) AS m{k}"
    return f"""
px AS (SELECT *, {cfa(phase)} AS color, {clip} AS clip FROM {source}),
hot AS (SELECT *, v >= clip AS hot, CAST("row" // 3 AS INTEGER) AS cell_row, CAST(col // 3 AS INTEGER) AS cell_col FROM px),
mask AS (SELECT image_id, cell_row, cell_col, CAST(bit_or(CAST(1 << color AS INTEGER)) AS INTEGER) AS mask FROM hot WHERE hot GROUP BY 1, 2, 3),
off AS (SELECT CAST(a.range - 3 AS INTEGER) AS dy, CAST(b.range - 3 AS INTEGER) AS dx FROM range(7) a, range(7) b WHERE NOT (abs(a.range - 3) = 3 AND abs(b.range - 3) = 3)),
near AS (SELECT image_id, cell_row + dy AS cell_row, cell_col + dx AS cell_col, CAST(bit_or(mask) AS INTEGER) AS mask FROM mask, off
  WHERE cell_row + dy BETWEEN 0 AND ({h} + 2) // 3 - 1 AND cell_col + dx BETWEEN 0 AND 33 GROUP BY 1, 2, 3),
step3 AS (SELECT CAST(a.range - 1 AS INTEGER) AS dy, CAST(b.range - 1 AS INTEGER) AS dx FROM range(3) a, range(3) b),
refs AS (SELECT image_id, "row", col, pow(0.5::DOUBLE * ({others()}), 3) AS reference FROM (
  SELECT p.image_id, p."row", p.col, p.color, {", ".join(mean(k) for k in range(3))} FROM px p, step3 s JOIN px n ON n.image_id = p.image_id AND n."row" = p."row" + s.dy AND n.col = p.col + s.dx GROUP BY 1, 2, 3, 4)),
elig AS (SELECT hot.*, refs.reference, NOT hot AND v > 0.2::DOUBLE * clip AND v < clip AND (coalesce(near.mask, 0) & (1 << color)) <> 0 AS eligible
  FROM hot JOIN refs USING (image_id, "row", col) LEFT JOIN near USING (image_id, cell_row, cell_col)),
chroma AS (SELECT image_id, color, count(*) AS n, CASE WHEN count(*) > 100 THEN sum(v - reference) / count(*) ELSE 0.0::DOUBLE END AS chroma FROM elig WHERE eligible GROUP BY 1, 2),
fixed AS (SELECT image_id, "row", col, CASE WHEN hot THEN greatest(v, reference + coalesce(chroma, 0.0::DOUBLE)) ELSE v END AS v FROM elig LEFT JOIN chroma USING (image_id, color))"""


def highlights(what: str, levels, threshold: float, phase: int) -> str:
    end = {
        "mask": "SELECT * FROM mask",
        "dilate": "SELECT * FROM near",
        "reference": 'SELECT image_id, "row", col, round(reference, 6) AS reference FROM refs',
        "chroma": "SELECT image_id, color, n, round(chroma, 6) + 0.0 AS chroma FROM chroma",
        "opposed": 'SELECT image_id, "row", col, round(v, 6) + 0.0 AS v FROM fixed',
    }[what]
    return f"WITH {highlight_steps(levels, threshold, phase)} {end}"


def supplier_gains() -> str:
    """All images, with gains by image from the supplier table where it has a row, demosaiced, metered by image."""
    w = standards.to_xyz("rec2020")[1]
    gain = "CASE WHEN s_suppkey IS NULL THEN 1.0::DOUBLE ELSE CASE \"row\" % 2 * 2 + col % 2 WHEN 0 THEN 1.0::DOUBLE + image_id % 7 / 10.0::DOUBLE WHEN 3 THEN 1.0::DOUBLE + image_id % 5 / 10.0::DOUBLE ELSE 1.0::DOUBLE END END"
    gained = f"(SELECT {KEYS}, v * {gain} AS v FROM {IMAGES} LEFT JOIN (SELECT s_suppkey FROM supplier) ON s_suppkey = image_id)"
    rgb = demosaic_2x2(0, gained, "8", "8", None)
    return f"SELECT image_id, round(avg({combine(w)}), 6) AS mean, round(log2({lit(standards.GREY)} / avg({combine(w)})), 6) AS ev FROM ({rgb}) GROUP BY 1"


def flagship(s) -> str:
    """The whole development chain down to histogram counts by bin."""
    c = s["calibration"]
    gains = s["gains"]
    steps = highlight_steps(s["levels"], 0.98, s["phase"], f"(SELECT {KEYS}, (code - {site([c.black + c.channel_black[c.cfa[i // 2][i % 2]] for i in range(4)])}) / {lit(c.range)} * {site(gains)} AS v FROM {CODES})")
    rgb = demosaic_2x2(s["phase"], "fixed", "100", HEIGHT, None)
    moved = "SELECT " + KEYS + ", " + ", ".join(f"{combine(row)} AS {n}" for row, n in zip(s["camera"], "rgb", strict=True)) + f" FROM ({rgb})"
    adapted = "SELECT " + KEYS + ", " + ", ".join(f"{combine(row)} AS {n}" for row, n in zip(s["cat"], "rgb", strict=True)) + f" FROM ({moved})"
    exposed = f"SELECT {KEYS}, " + ", ".join(f"{n} * {lit(2.0 ** s['ev'])} AS {n}" for n in "rgb") + f" FROM ({adapted})"
    toned = sigmoid(1.5, -0.2, 0.0, "exposed", None).strip().removeprefix("WITH ")
    head, _, tail = toned.rpartition("\nSELECT ")
    body = f"{steps}, exposed AS ({exposed}), {head}, toned AS (SELECT {tail})"
    return f"WITH {body} SELECT channel, CAST(floor(least(greatest(v, 0.0::DOUBLE), 1.0::DOUBLE) * 16) AS INTEGER) AS bin, count(*) AS n FROM {_channels('toned')} GROUP BY 1, 2"
