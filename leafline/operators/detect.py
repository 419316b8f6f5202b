"""From probability maps to detected boxes, and from boxes to what recognition is to read: the steps of raster and suppress, composed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions import geometry as G
from leafline.functions.text import is_garbage
from leafline.operators import decode, raster, suppress
from leafline.session import cut
from leafline.sources.files import infer

#: Defaults of detection, the ratio of sides from which a quad's tilt counts, the tilt up to which a quad is read upright.
THRESHOLD, BOX_THRESHOLD, LEAST_SIZE, MOST_TILT, ELONGATED, UPRIGHT = 0.3, 0.5, 3, 30, 1.5, 1.5
#: Crop modes: upright boxes, tilted quads, quads that are read upright when they nearly are.
BOXES, QUADS, MIXED = 0, 1, 2


def boxes(px: DataFrame, maps: DataFrame, mode: int = MIXED, threshold: float = THRESHOLD, box_threshold: float = BOX_THRESHOLD, least: int = LEAST_SIZE, most_tilt: float = MOST_TILT) -> DataFrame:
    """page, comp, points (eight numbers), x1, y1, x2, y2 (before growing), score of the boxes on each page.

    px (page, y, x, p) are maps of scores, pixels that are missing have 0; maps (page, map_w, map_h, width, height,
    scale_x, scale_y) has one row for each page: sizes of map and page, and the map's scale. In mode BOXES the mean of the
    whole bounding box decides and points are its corners; in the others the mean of the component's pixels does, points
    are its grown rotated rectangle, and elongated ones that lean too far go (most_tilt below 90).
    """
    sized = px.join(maps.select("page", "map_w", "map_h"), "page")
    parts = raster.components(raster.dilated(sized, F.col("map_w"), F.col("map_h"), threshold))
    found = raster.statistics(parts, px, least)
    if mode == BOXES:
        found = raster.box_scores(found, px)
    found = found.where(F.col("score") >= box_threshold).join(maps, "page")
    across, down = (F.col("scale_x"), F.col("width")), (F.col("scale_y"), F.col("height"))
    raw = [G.on_page(F.col("x1"), *across).alias("x1"), G.on_page(F.col("y1"), *down).alias("y1"), G.on_page(F.col("x2") + 1, *across).alias("x2"), G.on_page(F.col("y2") + 1, *down).alias("y2")]
    if mode == BOXES:
        grown = G.upright_box(G.box(), F.col("scale_x"), F.col("scale_y"), F.col("width"), F.col("height"))
        return found.select("page", "comp", G.corners_of(grown).alias("points"), *raw, "score")
    quads = raster.rotated_boxes(parts.join(found.select("page", "comp"), ["page", "comp"], "left_semi"))
    if most_tilt < 90:
        q = F.col("points")
        elongated = (G.side(q, 1) > 0) & (G.side(q, 1) >= F.lit(ELONGATED) * G.side(q, 3))
        quads = quads.where(~(elongated & (G.quad_tilt(q) > most_tilt)))
    points = F.transform("points", lambda v, i: F.when(i % 2 == 0, G.on_page(v, *across)).otherwise(G.on_page(v, *down)))
    return found.join(quads, ["page", "comp"]).select("page", "comp", points.alias("points"), *raw, "score")


def detect(px: DataFrame, maps: DataFrame, **options) -> DataFrame:
    """boxes() without contained and overlapping ones."""
    return suppress.suppress(boxes(px, maps, **options), key="comp")


def page_boxes(rasters: DataFrame, load: Callable, limit: int = G.LONG_SIDE, **options) -> DataFrame:
    """Detection of whole pages: rasters (page, data, width, height) resized, scored by a model, turned to boxes. load() makes the model in each task: a function from tensors to rows (page, map_w, map_h, y, x, p)."""
    w, h = G.detection_size(F.col("width"), F.col("height"), limit)
    sized = rasters.select("page", "data", "width", "height", w.cast("int").alias("to_width"), h.cast("int").alias("to_height"))
    px = cut(infer(raster.tensors(sized), load, "page long, map_w long, map_h long, y long, x long, p double"), "score-maps")
    scales = sized.select("page", "width", "height", (F.col("to_width") / F.col("width")).alias("scale_x"), (F.col("to_height") / F.col("height")).alias("scale_y"))
    maps = px.groupBy("page").agg(F.max("map_w").alias("map_w"), F.max("map_h").alias("map_h")).join(scales, "page")
    return detect(px.select("page", "y", "x", "p"), maps, **options)


def read(rasters: DataFrame, found: DataFrame, load: Callable, dictionary: DataFrame, mode: int = MIXED) -> DataFrame:
    """found (page, comp, points, ...) with text, without lines that are too small or read as garbage. load() makes the model in each task: a function from tensors to rows (page, comp, t, scores)."""
    plan = reading_plan(found, mode)
    steps = infer(raster.line_tensors(rasters, plan), load, "page long, comp long, t long, scores array<double>")
    named = steps.withColumn("seq_id", F.struct("page", "comp"))
    texts = decode.decode(cut(named.select("seq_id", "t", "scores"), "class-scores"), dictionary)
    return found.join(texts.select("seq_id.page", "seq_id.comp", "text"), ["page", "comp"]).where(~is_garbage(F.col("text")))


def reading_plan(quads: DataFrame, mode: int = MIXED) -> DataFrame:
    """What recognition reads of each quad (points): adds warp (sampled along the quad, else copied upright from crop_x, crop_y), crop_width, crop_height and width (scaled to the line height). Quads under two pixels go."""
    q = F.col("points")
    across, down = G.round_half_up(G.side(q, 1)).cast("long"), G.round_half_up(G.side(q, 3)).cast("long")
    around = G.quad_box(q)
    warp = F.lit(mode == QUADS) if mode != MIXED else G.quad_tilt(q, long_side=True) > UPRIGHT
    whole = F.lit(mode == MIXED) & ~warp
    plan = quads.withColumns({
        "warp": warp,
        "crop_x": F.when(whole, around["x1"]).otherwise(F.get(q, F.lit(0))),
        "crop_y": F.when(whole, around["y1"]).otherwise(F.get(q, F.lit(1))),
        "crop_width": F.when(whole, around["x2"] - around["x1"]).otherwise(across),
        "crop_height": F.when(whole, around["y2"] - around["y1"]).otherwise(down),
    }).where((across >= 2) & (down >= 2))
    plan = plan.where((F.col("crop_width") >= 2) & (F.col("crop_height") >= 2))
    return plan.withColumn("width", G.recognition_width(F.col("crop_width").cast("double"), F.col("crop_height").cast("double")))
