"""Column expressions over boxes (x1, y1, x2, y2), page sizes and quads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of detection and recognition.
LONG_SIDE, LINE_HEIGHT, MIN_WIDTH, UNCLIP = 1536, 48, 4, 1.6


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")}


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def area(b: dict) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def intersection(a: dict, b: dict) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def union_area(a: dict, b: dict) -> Column:
    return area(a) + area(b) - intersection(a, b)


def scaled(x: Column, ratio: Column | float) -> Column:
    return round_half_up(x * ratio).cast("long")


def to_32(x: Column) -> Column:
    return (round_half_up(x / 32) * 32).cast("long")


def detection_size(width: Column, height: Column, limit: int = LONG_SIDE) -> tuple[Column, Column]:
    """Resized width and height: shrunk so that the long side fits, multiples of 32, at least 1."""
    ratio = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(width, height))
    return F.greatest(F.lit(1), to_32(width * ratio)), F.greatest(F.lit(1), to_32(height * ratio))


def recognition_width(width: Column, height: Column, line_height: int = LINE_HEIGHT) -> Column:
    """Width of a text line scaled to line_height."""
    return F.greatest(F.lit(MIN_WIDTH), F.ceil(F.lit(line_height) * (width / height))).cast("long")


def tilt(dx: Column, dy: Column) -> Column:
    """Degrees between a long axis and the horizontal, in [0, 90]."""
    deg = F.abs(F.degrees(F.atan2(dy, dx)))
    return F.least(deg, 180 - deg)


def padded(b: dict, width: Column, height: Column) -> dict[str, Column]:
    """The box with a tenth of its width and a quarter of its height added on each side, rounded, inside the page."""
    px, py = (b["x2"] - b["x1"]) * F.lit(0.1), (b["y2"] - b["y1"]) * F.lit(0.25)
    low = lambda x: F.greatest(F.lit(0).cast("long"), round_half_up(x).cast("long"))
    high = lambda x, most: F.least(most.cast("long"), round_half_up(x).cast("long"))
    return {"x1": low(b["x1"] - px), "y1": low(b["y1"] - py), "x2": high(b["x2"] + px, width), "y2": high(b["y2"] + py, height)}


def points_to_pixels(f: dict, sx: Column, sy: Column, width: Column, height: Column) -> dict[str, Column]:
    """A region in points (origin bottom left) as pixels (origin top left), rounded and clamped to the page."""

    def clamp(x: Column, most: Column) -> Column:
        return F.least(most, F.greatest(F.lit(0), round_half_up(x).cast("long")))

    return {"x1": clamp(f["x1"] * sx, width), "y1": clamp(height - f["y2"] * sy, height), "x2": clamp(f["x2"] * sx, width), "y2": clamp(height - f["y1"] * sy, height)}


def placement(b: dict, scale: Column, page_height: Column, text_width: Column, size_of: float = 1.0, descent: float = 0.2) -> Column:
    """Where invisible text fills a box, null for boxes under a point. Metrics are parameters: font size per box height, descent per size, text_width at size 1."""
    w, h = (b["x2"] - b["x1"]) * scale, (b["y2"] - b["y1"]) * scale
    size = F.greatest(h * size_of, F.lit(1.0))
    wide = text_width * size
    return F.when((w >= 1) & (h >= 1), F.struct((b["x1"] * scale).alias("x"), (page_height - b["y2"] * scale + size * descent).alias("y"), size.alias("font_size"), F.when(wide > 0, w / wide).otherwise(F.lit(1.0)).alias("sx")))


def on_page(x: Column, scale: Column, most: Column) -> Column:
    """A coordinate of the map on the page: scaled back, clamped, rounded."""
    return round_half_up(F.least((most - 1).cast("double"), F.greatest(F.lit(0.0), x * (1 / scale)))).cast("long")


def upright_box(b: dict, scale_x: Column, scale_y: Column, width: Column, height: Column, unclip: float = UNCLIP) -> dict[str, Column]:
    """A component's bounding box (pixels of the map, ends included), moved outwards by its area * unclip / perimeter, on the page."""
    w, h = b["x2"] - b["x1"] + 1, b["y2"] - b["y1"] + 1
    grow = w * h * F.lit(unclip) / (2 * (w + h))
    return {"x1": on_page(b["x1"] - grow, scale_x, width), "y1": on_page(b["y1"] - grow, scale_y, height), "x2": on_page(b["x2"] + 1 + grow, scale_x, width), "y2": on_page(b["y2"] + 1 + grow, scale_y, height)}


def corners_of(b: dict) -> Column:
    """The corners of an upright box as eight numbers, from the top left on, clockwise."""
    return F.array(b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"], b["x1"], b["y2"])


def side(q: Column, corner: int) -> Column:
    """Length of the side of a quad (eight numbers) from its first corner to another."""
    return F.hypot((F.get(q, F.lit(2 * corner)) - F.get(q, F.lit(0))).cast("double"), (F.get(q, F.lit(2 * corner + 1)) - F.get(q, F.lit(1))).cast("double"))


def quad_tilt(q: Column, long_side: bool = False) -> Column:
    """Degrees between a quad's top side, or the longer one of its top and left sides, and the horizontal."""
    top = tilt(F.get(q, F.lit(2)) - F.get(q, F.lit(0)), F.get(q, F.lit(3)) - F.get(q, F.lit(1)))
    left = tilt(F.get(q, F.lit(6)) - F.get(q, F.lit(0)), F.get(q, F.lit(7)) - F.get(q, F.lit(1)))
    return F.when(side(q, 1) >= side(q, 3), top).otherwise(left) if long_side else top


def quad_box(q: Column) -> dict[str, Column]:
    """The upright box around a quad."""
    xs, ys = F.filter(q, lambda _, i: i % 2 == 0), F.filter(q, lambda _, i: i % 2 == 1)
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def pixel_to_point(pixels: Column, points: Column, page_points: Column) -> Column:
    """Points of a pixel: the page's width in points (as rendered, else the document's) by its width in pixels; a half for pages without width."""
    return F.when(pixels > 0, F.coalesce(F.nullif(points, F.lit(0).cast("double")), page_points) / pixels).otherwise(F.lit(0.5))
