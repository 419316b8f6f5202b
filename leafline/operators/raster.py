"""From probability maps to boxes: threshold, dilation, components, statistics, rotated rectangles. Maps are long tables (page, y, x, p)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.geometry import LINE_HEIGHT, UNCLIP


def dilated(px: DataFrame, width: int | Column, height: int | Column, threshold: float = 0.3) -> DataFrame:
    """page, y, x of set pixels (score above the threshold) and their right, lower and diagonal neighbours inside the map, whose size may be columns of px."""
    spread = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (0, 1) for dx in (0, 1)]))
    size = lambda v: F.lit(v) if isinstance(v, int) else v
    near = px.where(F.col("p") > threshold).select("page", size(width).alias("_w"), size(height).alias("_h"), spread.alias("_c"))
    return near.where((F.col("_c.x") < F.col("_w")) & (F.col("_c.y") < F.col("_h"))).select("page", "_c.y", "_c.x").distinct()


def label(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """8-connected components of pixels; each is named by its first pixel in raster order (y * 2**20 + x)."""
    code = y.astype(np.int64) << 20 | x
    order = np.argsort(code)
    code = code[order]
    name = np.arange(len(code))
    links = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        to = code + (dy << 20) + dx
        at = np.minimum(np.searchsorted(code, to), len(code) - 1)
        hit = np.flatnonzero(code[at] == to)
        links.append(np.column_stack([hit, at[hit]]))
    a, b = np.concatenate(links).T
    while True:
        low = np.minimum(name[a], name[b])
        before = name.copy()
        np.minimum.at(name, a, low)
        np.minimum.at(name, b, low)
        np.minimum.at(name, before, name)
        name = name[name]
        if (name == before).all():
            break
    out = np.empty(len(code), np.int64)
    out[order] = code[name]
    return out


def components(mask: DataFrame) -> DataFrame:
    """Adds comp. One map at a time: a map is bounded by its page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(comp=label(pdf["y"].to_numpy(), pdf["x"].to_numpy()))[["page", "y", "x", "comp"]]

    return mask.groupBy("page").applyInPandas(run, "page long, y long, x long, comp long")


def statistics(parts: DataFrame, px: DataFrame, least: int = 3) -> DataFrame:
    """Bounding box, size and mean score of components at least 3 pixels wide and high; scores are those of the undilated map on the component's pixels."""
    scored = parts.join(px, ["page", "y", "x"], "left")
    out = scored.groupBy("page", "comp").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n"), (F.sum(F.coalesce("p", F.lit(0.0))) / F.count("*")).alias("score"))
    return out.where((F.col("x2") - F.col("x1") + 1 >= least) & (F.col("y2") - F.col("y1") + 1 >= least))


def box_scores(boxes: DataFrame, px: DataFrame) -> DataFrame:
    """Replaces score by the mean of the undilated map over the bounding box, where missing pixels are 0."""
    p = px.select(F.col("page").alias("_page"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("p").alias("_p"))
    inside = (F.col("page") == F.col("_page")) & F.col("_y").between(F.col("y1"), F.col("y2")) & F.col("_x").between(F.col("x1"), F.col("x2"))
    kept = [c for c in boxes.columns if c != "score"]
    total = boxes.join(p, inside, "left").groupBy(*kept).agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias("_sum"))
    return total.select(*kept, (F.col("_sum") / ((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1))).alias("score"))


def polygon(points: DataFrame, keys: list[str], place: str = "i") -> DataFrame:
    """Signed area and perimeter of polygons given as rows (x, y) in order."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(place), F.col("x"), F.col("y"))))
    grouped = points.groupBy(*keys).agg(seq.alias("_v"))

    def edge(i, f):
        v = F.col("_v")
        return f(F.get(v, i), F.get(v, (i + 1) % F.size(v)))

    def total(f):
        return F.aggregate(F.sequence(F.lit(0), F.size("_v") - 1), F.lit(0.0), lambda s, i: s + edge(i, f))

    return grouped.select(*keys, (total(lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")) / 2).alias("area"), total(lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])).alias("perimeter"))


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without points on its edges; up to three points come back as they are, in their order."""
    if len(p) <= 3:
        return p
    p = p[np.lexsort((p[:, 1], p[:, 0]))]

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def signed_area(poly: np.ndarray) -> float:
    after = np.roll(poly, -1, 0)
    return float((poly[:, 0] * after[:, 1] - after[:, 0] * poly[:, 1]).sum()) / 2


def offset(poly: np.ndarray, distance: float) -> np.ndarray:
    """The polygon, of either orientation, with every edge moved outwards; edges in one line meet halfway between their starts."""
    turn = 1.0 if signed_area(poly) >= 0 else -1.0
    step = np.roll(poly, -1, 0) - poly
    length = np.hypot(step[:, 0], step[:, 1])
    length[length == 0] = 1.0
    start = poly + np.column_stack([step[:, 1], -step[:, 0]]) * (turn * distance / length)[:, None]
    before, step_before = np.roll(start, 1, 0), np.roll(step, 1, 0)
    den = step_before[:, 0] * step[:, 1] - step_before[:, 1] * step[:, 0]
    flat = np.abs(den) < 1e-9
    t = ((start - before)[:, 0] * step[:, 1] - (start - before)[:, 1] * step[:, 0]) / np.where(flat, 1, den)
    return np.where(flat[:, None], (before + start) / 2, before + step_before * t[:, None])


def least_rectangle(poly: np.ndarray) -> np.ndarray:
    """The rectangle of least area along an edge of a hull; the first edge wins ties. Four corners in order."""
    best, least = poly[[0, 0, 0, 0]].astype(float), np.inf
    for a, b in zip(poly, np.roll(poly, -1, 0), strict=True):
        d = np.hypot(*(b - a)) or 1.0
        u = (b - a) / d
        axes = np.array([u, [-u[1], u[0]]])
        c = (poly - a) @ axes.T
        (x1, y1), (x2, y2) = np.minimum(0, c.min(0)), np.maximum(0, c.max(0))
        if (x2 - x1) * (y2 - y1) < least:
            least, best = (x2 - x1) * (y2 - y1), a + np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]) @ axes
    return best


def corners(rect: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: a long side on top, starting at its smaller x."""
    sides = np.hypot(*(np.roll(rect, -1, 0) - rect).T)
    i = 0 if sides[0] >= sides[1] else 1
    a, b = (i, (i + 1) % 4) if rect[i][0] <= rect[(i + 1) % 4][0] else ((i + 1) % 4, i)
    other = {i: (i - 1) % 4, (i + 1) % 4: (i + 2) % 4}
    return rect[[a, b, other[b], other[a]]]


def quad_of(p: np.ndarray, unclip: float = UNCLIP) -> np.ndarray | None:
    """Pixels to a quad: hull, moved outwards by area * unclip / perimeter, its least rectangle, corners in order; None for a hull without area."""
    p = hull(p)
    size, around = abs(signed_area(p)), np.hypot(*(np.roll(p, -1, 0) - p).T).sum()
    return corners(least_rectangle(hull(offset(p, size * unclip / around)))) if size > 0 and around > 0 else None


def rotated_boxes(parts: DataFrame, unclip: float = UNCLIP) -> DataFrame:
    """points (eight numbers) for each component, a page at a time. Degenerate hulls go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "y", "x"], kind="stable")
        comp, p = pdf["comp"].to_numpy(), pdf[["x", "y"]].to_numpy(float)
        first = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]]))
        quads = [quad_of(q, unclip) for q in np.split(p, first[1:])]
        kept = [(pdf["page"].iloc[0], c, q.reshape(-1).tolist()) for c, q in zip(comp[first].tolist(), quads, strict=True) if q is not None]
        return pd.DataFrame(kept, columns=["page", "comp", "points"]).astype({"page": "int64", "comp": "int64"})

    return parts.groupBy("page").applyInPandas(run, "page long, comp long, points array<double>")


def sample(pixels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Colours at places between pixels, in floating point; x and y are inside the raster."""
    h, w = pixels.shape[:2]
    left, up = np.floor(x).astype(int), np.floor(y).astype(int)
    right, down = np.minimum(left + 1, w - 1), np.minimum(up + 1, h - 1)
    c = pixels[..., :3].astype(float)
    fx, fy = (x - left)[..., None], (y - up)[..., None]
    above = c[up, left] + (c[up, right] - c[up, left]) * fx
    below = c[down, left] + (c[down, right] - c[down, left]) * fx
    return above + (below - above) * fy


def resize(pixels: np.ndarray, width: int, height: int, bgr: bool = False) -> np.ndarray:
    """Bilinear resize of (h, w, 4) bytes to three float32 planes in [-1, 1]; place i of n comes from i * size / n."""
    h, w = pixels.shape[:2]
    y, x = np.meshgrid(np.arange(height) * (h / height), np.arange(width) * (w / width), indexing="ij")
    mixed = sample(pixels, x, y).astype(np.float32).astype(float)
    return ((mixed / 255 - 0.5) / 0.5).astype(np.float32)[..., ::-1 if bgr else 1].transpose(2, 0, 1)


def _opaque(colours: np.ndarray) -> np.ndarray:
    return np.concatenate([colours, np.full((*colours.shape[:2], 1), 255, np.uint8)], axis=2)


def crop(pixels: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A width x height raster from (x, y) on; places outside hold the nearest edge pixel. Opaque."""
    h, w = pixels.shape[:2]
    rows, columns = np.clip(np.arange(y, y + height), 0, h - 1), np.clip(np.arange(x, x + width), 0, w - 1)
    return _opaque(pixels[rows][:, columns, :3])


def crop_quad(pixels: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """Samples a quad (four corners from the top left on) into a width x height raster whose corners are the quad's; places outside hold the nearest edge pixel. Opaque."""
    u, v = (np.arange(width) / max(1, width - 1))[None, :, None], (np.arange(height) / max(1, height - 1))[:, None, None]
    tl, tr, br, bl = np.asarray(quad, float).reshape(4, 2)
    above, below = tl + (tr - tl) * u, bl + (br - bl) * u
    p = above + (below - above) * v
    h, w = pixels.shape[:2]
    colours = sample(pixels, np.clip(p[..., 0], 0, w - 1), np.clip(p[..., 1], 0, h - 1))
    return _opaque(np.rint(colours).astype(np.uint8))


def pixels_of(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


TENSOR = "tensor binary, tensor_width int, tensor_height int"


def _mapped(rows: DataFrame, kernel, drop: list[str], adds: str) -> DataFrame:
    """rows without drop and with what kernel(row) returns; a row at a time, as each holds a raster."""
    kept = [f for f in rows.schema.fields if f.name not in drop]
    names = [a.strip().split(" ")[0] for a in adds.split(",")]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame([[*[getattr(row, f.name) for f in kept], *kernel(row)]], columns=[*[f.name for f in kept], *names])

    return rows.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [adds]))


def tensors(rasters: DataFrame) -> DataFrame:
    """rasters (data, width, height, to_width, to_height, ...) resized and normalised: tensor (float32, three planes of red, green, blue) instead of data."""
    return _mapped(rasters, lambda r: (resize(pixels_of(r.data, r.width, r.height), r.to_width, r.to_height).tobytes(), r.to_width, r.to_height), ["data"], TENSOR)


def line_tensors(rasters: DataFrame, plan: DataFrame, line_height: int = LINE_HEIGHT) -> DataFrame:
    """One tensor (blue, green, red) for each line of plan (page, points, warp, crop_x .. crop_height, width, ...) from the raster of its page (page, data, width, height)."""
    pages = rasters.select("page", "data", F.col("width").alias("page_w"), F.col("height").alias("page_h"))

    def kernel(r):
        px = pixels_of(r.data, r.page_w, r.page_h)
        cut = crop_quad(px, np.asarray(r.points), r.crop_width, r.crop_height) if r.warp else crop(px, r.crop_x, r.crop_y, r.crop_width, r.crop_height)
        return resize(cut, r.width, line_height, bgr=True).tobytes(), r.width, line_height

    return _mapped(plan.join(pages, "page"), kernel, ["data", "page_w", "page_h"], TENSOR)
