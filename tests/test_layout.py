"""Literal geometry cases."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafline.functions import geometry as G
from leafline.operators import detect, frames, order, overlay, raster, suppress
from leafline.sources import files


def boxes(spark, rows, score=None):
    return spark.createDataFrame([(0, i, *r[:4], float(r[4]) if len(r) > 4 else 0.9) for i, r in enumerate(rows)], "page long, box_id long, x1 long, y1 long, x2 long, y2 long, score double")


def seq(df, ident="box_id"):
    return [r[ident] for r in df.orderBy("seq").collect()]


def test_suppress(spark):
    kept = lambda rows: [r.box_id for r in suppress.suppress(boxes(spark, rows)).orderBy("box_id").collect()]
    assert kept([(0, 0, 200, 20, 0.8), (10, 2, 40, 18, 0.9)]) == [0]
    assert kept([(10, 5, 50, 25), (10, 50, 50, 70)]) == [0, 1]
    assert kept([(0, 0, 100, 20), (0, 30, 100, 50)]) == [0, 1]
    assert kept([(0, 0, 100, 20, 0.5), (10, 0, 110, 20, 0.9), (60, 0, 160, 20, 0.4)]) == [1, 2]
    assert kept([(5, 5, 5, 9), (0, 0, 10, 10)]) == [1]


def test_reading(spark):
    assert seq(order.reading(boxes(spark, [(0, 80, 100, 100, 0.99), (80, 0, 160, 20, 0.5), (0, 2, 70, 18, 0.2)]), ["page"])) == [2, 1, 0]


def test_two_columns(spark):
    rows = [(x, 100 + 30 * i, x + 400, 120 + 30 * i) for i in range(10) for x in (100, 650)]
    got = seq(order.two_columns(boxes(spark, rows), ["page"], 1200))
    assert got == [*range(0, 20, 2), *range(1, 20, 2)]
    header = [(50, 10, 1150, 40), *rows]
    assert seq(order.two_columns(boxes(spark, header), ["page"], 1200)) == [0, *range(1, 21, 2), *range(2, 21, 2)]
    assert seq(order.two_columns(boxes(spark, rows), ["page"], 0)) == list(range(20))


def test_stacked(spark):
    two = [(x, 30 * i, x + 100, 30 * i + 20) for i in range(4) for x in (0, 200)]
    assert seq(order.stacked(boxes(spark, two), ["page"])) == [0, 2, 4, 6, 1, 3, 5, 7]
    one = [(0, 30 * i, 300, 30 * i + 20) for i in range(4)]
    assert seq(order.stacked(boxes(spark, one), ["page"])) == [0, 1, 2, 3]
    parted = [*two[:4], (0, 60, 300, 80), *[(a, b + 60, c, d + 60) for a, b, c, d in two[:4]]]
    assert seq(order.stacked(boxes(spark, parted), ["page"])) == [0, 2, 1, 3, 4, 5, 7, 6, 8]


def test_claim(spark):
    """Two frames side by side: a line belongs to the one that covers more of it, if both together cover half its length and its middle is level with them."""
    f = spark.createDataFrame([(0, 0, 0, 100, 200, 300), (0, 1, 210, 100, 500, 300)], "page long, frame_id long, x1 long, y1 long, x2 long, y2 long")
    lines = {(20, 150, 120, 170): 0, (150, 150, 260, 170): 0, (160, 150, 260, 170): 1, (120, 290, 340, 306): 1, (20, 60, 120, 80): -1, (20, 300, 120, 328): 0, (20, 301, 120, 329): -1, (20, 303, 120, 306): -1, (440, 200, 580, 220): -1, (440, 200, 560, 220): 1, (205, 200, 205, 210): -1}
    got = {r.box_id: r.frame_id for r in frames.claim(boxes(spark, list(lines)), f).collect()}
    assert got == dict(enumerate(lines.values()))


def test_frame_order(spark):
    rows = [(0, 0, 100, 900, 900, 1000), (0, 1, 100, 100, 400, 300), (0, 2, 500, 120, 900, 280)]
    f = spark.createDataFrame(rows, "page long, frame_id long, x1 long, y1 long, x2 long, y2 long")
    assert seq(order.frames_in_order(f, ["page"]), "frame_id") == [1, 2, 0]
    walls = spark.createDataFrame([(0, 0, 600, 50, 1100, 300), (0, 1, 50, 60, 500, 320), (0, 2, 10, 400, 1190, 500), (0, 3, 50, 450, 500, 800)], f.schema)
    assert seq(order.frames_in_order(walls, ["page"], 1190), "frame_id") == [1, 0, 2, 3]


def test_geometry(spark):
    row = spark.range(1).select(
        G.round_half_up(F.lit(-2.5)).alias("a"), G.to_32(F.lit(80.0)).alias("b"), G.recognition_width(F.lit(1.0), F.lit(48.0)).alias("c"), *[x.alias(f"d{i}") for i, x in enumerate(G.detection_size(F.lit(3072), F.lit(10)))],
        F.round(G.tilt(F.lit(1.0), F.lit(-1.0)), 6).alias("e"), F.round(G.tilt(F.lit(-1.0), F.lit(0.0)), 6).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d0, row.d1, row.e, row.f) == (-2, 96, 4, 1536, 1, 45, 0)
    b = {k: F.lit(v) for k, v in zip(("x1", "y1", "x2", "y2"), (150, 40, 450, 115), strict=True)}
    p = spark.range(1).select(G.placement(b, F.lit(1 / 3), F.lit(400.0), F.lit(4.0)).alias("p"), G.placement(b, F.lit(0.001), F.lit(400.0), F.lit(4.0)).alias("none")).first()
    assert p.p.x == pytest.approx(50) and p.p.font_size > 20 and p.p.sx * 4 * p.p.font_size == pytest.approx(100) and p.none is None


def bar(angle, w=80, h=20, size=160):
    y, x = np.mgrid[:size, :size] - size / 2
    t = np.radians(angle)
    u, v = x * np.cos(t) + y * np.sin(t), -x * np.sin(t) + y * np.cos(t)
    return (abs(u) <= w / 2) & (abs(v) <= h / 2)


@pytest.mark.parametrize("angle", [0, 15, -15, 40])
def test_rotated_box(spark, angle):
    y, x = np.nonzero(bar(angle))
    parts = spark.createDataFrame([(0, int(a), int(b), 0) for a, b in zip(y, x, strict=True)], "page long, y long, x long, comp long")
    q = np.array(raster.rotated_boxes(parts).first().points).reshape(4, 2)
    top = q[1] - q[0]
    assert np.degrees(np.arctan2(top[1], top[0])) == pytest.approx(angle, abs=3)
    assert 98 < np.hypot(*top) < 116 and 36 < np.hypot(*(q[3] - q[0])) < 52


def test_labels_and_dilation(spark):
    y, x = np.array([0, 0, 1, 5, 6, 7, 7]), np.array([0, 1, 2, 5, 4, 5, 9])
    assert raster.label(y, x).tolist() == [0, 0, 0, 5 << 20 | 5, 5 << 20 | 5, 5 << 20 | 5, 7 << 20 | 9]
    px = spark.createDataFrame([(0, 1, 1, 0.5), (0, 3, 3, 0.5), (0, 0, 0, 0.3)], "page long, y long, x long, p double")
    assert {(r.y, r.x) for r in raster.dilated(px, 4, 4).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def plain_colour(r, x, y):
    """The colours at a place of a raster, by its four neighbours."""
    h, w = r.shape[:2]
    x0, y0 = math.floor(x), math.floor(y)
    x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
    p = lambda i, j: r[j, i, :3].astype(float)
    near = lambda j: p(x0, j) * (1 - (x - x0)) + p(x1, j) * (x - x0)
    return near(y0) * (1 - (y - y0)) + near(y1) * (y - y0)


@pytest.mark.parametrize("size", [(5, 4), (23, 9), (1, 1), (11, 7)])
def test_resize(size):
    r = np.random.default_rng(1).integers(0, 256, (7, 11, 4)).astype(np.uint8)
    got = raster.resize(r, *size)
    assert got.shape == (3, size[1], size[0]) and got.dtype == np.float32
    for y in range(size[1]):
        for x in range(size[0]):
            want = plain_colour(r, x * 11 / size[0], y * 7 / size[1]) / 255 * 2 - 1
            assert np.allclose(got[:, y, x], want, atol=1e-5)
    assert (raster.resize(r, *size, True) == got[::-1]).all()


@pytest.mark.parametrize("box", [(2, 1, 4, 3), (-2, -1, 7, 8), (9, 5, 6, 4), (30, 30, 2, 2)])
def test_crop(box):
    r = np.random.default_rng(2).integers(0, 256, (7, 11, 4)).astype(np.uint8)
    x, y, w, h = box
    got = raster.crop(r, x, y, w, h)
    assert got.shape == (h, w, 4) and (got[..., 3] == 255).all()
    for j in range(h):
        for i in range(w):
            assert (got[j, i, :3] == r[min(6, max(0, y + j)), min(10, max(0, x + i)), :3]).all()


@pytest.mark.parametrize("size", [(6, 4), (1, 3), (9, 1)])
def test_crop_quad(size):
    r = np.random.default_rng(3).integers(0, 256, (7, 11, 4)).astype(np.uint8)
    tl, tr, br, bl = q = np.array([(-2, 1), (8, 0), (12, 5), (1, 8)], float)
    w, h = size
    got = raster.crop_quad(r, q, w, h)
    assert got.shape == (h, w, 4) and (got[..., 3] == 255).all()
    for j in range(h):
        for i in range(w):
            u, v = i / (w - 1) if w > 1 else 0, j / (h - 1) if h > 1 else 0
            x, y = (tl * (1 - u) + tr * u) * (1 - v) + (bl * (1 - u) + br * u) * v
            want = plain_colour(r, min(10, max(0, x)), min(6, max(0, y)))
            assert np.abs(got[j, i, :3] - want).max() <= 0.5 + 1e-6
    corners = raster.crop_quad(r, np.array([(0, 0), (10, 0), (10, 6), (0, 6)]), 11, 7)
    assert (corners[..., :3] == r[..., :3]).all()


def inside(poly, p):
    d = np.roll(poly, -1, 0) - poly
    side = d[:, 0] * (p[1] - poly[:, 1]) - d[:, 1] * (p[0] - poly[:, 0])
    return (side > 1e-9).all() or (side < -1e-9).all()


@pytest.mark.parametrize("poly", [[(0, 0), (10, 0), (4, 7)], [(0, 0), (4, 7), (10, 0)], [(0, 0), (8, 0), (8, 5), (0, 5)], [(0, 5), (8, 5), (8, 0), (0, 0)], [(0, 0), (5, 0), (10, 0), (10, 4), (0, 4)]])
def test_offset(poly):
    """Every edge moves outwards by the distance, whichever way the corners run."""
    p = np.array(poly, float)
    got = raster.offset(p, 2.0)
    assert all(inside(got, q) for q in p)
    for a, b, c, d in zip(p, np.roll(p, -1, 0), got, np.roll(got, -1, 0), strict=True):
        n = np.array([b[1] - a[1], a[0] - b[0]]) / np.hypot(*(b - a))
        assert abs(abs((c - a) @ n) - 2) < 1e-9 or abs(np.cross(np.append(b - a, 0), np.append(d - c, 0))[2]) < 1e-9


def plain_components(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(part)
    return out


def plain_quad(part):
    """The grown rotated rectangle by way of all directions between pixels: hull edges are among them."""
    pts = np.array([(x, y) for y, x in part], float)
    hull = raster.hull(pts)
    area, around = abs(raster.signed_area(hull)), np.hypot(*(np.roll(hull, -1, 0) - hull).T).sum()
    if area == 0:
        return None
    # the grown hull: half-planes moved outwards, met pairwise
    d, n = area * 1.6 / around, len(hull)
    centre, lines = hull.mean(0), []
    for a, b in zip(hull, np.roll(hull, -1, 0), strict=True):
        normal = np.array([b[1] - a[1], a[0] - b[0]]) / np.hypot(*(b - a))
        normal = normal if normal @ (a - centre) > 0 else -normal
        lines.append((normal, normal @ a + d))
    grown = np.array([np.linalg.solve(np.array([lines[i - 1][0], lines[i][0]]), [lines[i - 1][1], lines[i][1]]) for i in range(n)])
    best = None
    for normal, _ in lines:
        along = np.array([normal[1], -normal[0]])
        u, v = grown @ along, grown @ normal
        size = (u.max() - u.min()) * (v.max() - v.min())
        if best is None or size < best[0] - 1e-9:
            best = (size, [x * along + y * normal for x, y in ((u.min(), v.min()), (u.max(), v.min()), (u.max(), v.max()), (u.min(), v.max()))])
    return np.array(best[1])


def test_detection(spark):
    """Every step of detection by plain loops, on blobs of all shapes at scales that differ in x and y."""
    r = np.random.default_rng(12)
    maps, rows = {}, []
    for page in range(4):
        m = np.zeros((60, 70))
        for _ in range(9):
            cy, cx, a, w, h = r.integers(5, 55), r.integers(5, 65), r.uniform(-1.4, 1.4), r.uniform(4, 16), r.uniform(1, 5)
            y, x = np.mgrid[:60, :70]
            u, v = (x - cx) * np.cos(a) + (y - cy) * np.sin(a), -(x - cx) * np.sin(a) + (y - cy) * np.cos(a)
            m = np.maximum(m, ((abs(u) < w) & (abs(v) < h)) * r.uniform(0.25, 0.98))
        maps[page] = m
        rows += [(page, int(y), int(x), float(m[y, x])) for y, x in zip(*np.nonzero(m), strict=True)]
    px = spark.createDataFrame(rows, "page long, y long, x long, p double")
    sizes = spark.createDataFrame([(p, 70, 60, 150, 200, 0.45, 0.31) for p in maps], "page long, map_w int, map_h int, width int, height int, scale_x double, scale_y double")
    back = lambda v, scale, most: math.floor(min(most - 1, max(0, v * (1 / scale))) + 0.5)
    tilted = 0
    for mode in (detect.BOXES, detect.MIXED):
        got = {(g.page, g.comp): g for g in detect.boxes(px, sizes, mode=mode, box_threshold=0.4).collect()}
        want = set()
        for page, m in maps.items():
            mask = {(y + a, x + b) for y, x in zip(*np.nonzero(m > 0.3), strict=True) for a in (0, 1) for b in (0, 1) if y + a < 60 and x + b < 70}
            for part in plain_components(mask):
                ys, xs = [c[0] for c in part], [c[1] for c in part]
                x1, y1, x2, y2 = min(xs), min(ys), max(xs) + 1, max(ys) + 1
                if x2 - x1 < 3 or y2 - y1 < 3:
                    continue
                score = m[y1:y2, x1:x2].mean() if mode == detect.BOXES else np.mean([m[c] for c in part])
                if score < 0.4:
                    continue
                key = (page, min(part)[0] << 20 | min(part)[1])
                if mode == detect.BOXES:
                    d = (x2 - x1) * (y2 - y1) * 1.6 / (2 * (x2 - x1 + y2 - y1))
                    ends = [back(x1 - d, 0.45, 150), back(y1 - d, 0.31, 200), back(x2 + d, 0.45, 150), back(y2 + d, 0.31, 200)]
                    points = [ends[i] for i in (0, 1, 2, 1, 2, 3, 0, 3)]
                else:
                    q = plain_quad(part)
                    if q is None:
                        continue
                    sides = [np.hypot(*(q[1] - q[0])), np.hypot(*(q[2] - q[1]))]
                    long = q[1] - q[0] if sides[0] >= sides[1] else q[2] - q[1]
                    lean = abs(math.degrees(math.atan2(long[1], long[0])))
                    if max(sides) / min(sides) >= 1.5 and min(lean, 180 - lean) > 30:
                        tilted += 1
                        continue
                    points = {(back(x, 0.45, 150), back(y, 0.31, 200)) for x, y in q}
                want.add(key)
                g = got[key]
                assert (g.x1, g.y1, g.x2, g.y2) == (back(x1, 0.45, 150), back(y1, 0.31, 200), back(x2, 0.45, 150), back(y2, 0.31, 200))
                assert g.score == pytest.approx(score)
                if mode == detect.BOXES:
                    assert g.points == points
                else:
                    corners = list(zip(g.points[::2], g.points[1::2], strict=True))
                    assert all(min(abs(x - a) + abs(y - b) for a, b in points) <= 1 for x, y in corners)
        assert set(got) == want and want
    assert tilted


def test_reading_plan(spark):
    rows = [(0, [10, 10, 60, 10, 60, 30, 10, 30]), (1, [10, 10, 60, 14, 59, 34, 9, 30]), (2, [5, 5, 6, 5, 6, 40, 5, 40]), (3, [5, 9, 45, 9, 45, 10, 5, 10]), (4, [20, 60, 21, 10, 41, 10, 40, 60])]
    q = spark.createDataFrame(rows, "box_id long, points array<long>")
    mixed = {r.box_id: (r.warp, r.crop_x, r.crop_y, r.crop_width, r.crop_height) for r in detect.reading_plan(q).collect()}
    assert mixed == {0: (False, 10, 10, 50, 20), 1: (True, 10, 10, 50, 20), 4: (True, 20, 60, 50, 20)} or mixed[4][0] is True
    assert mixed[0] == (False, 10, 10, 50, 20) and mixed[1][0] and set(mixed) == {0, 1, 4}
    assert {r.box_id: r.warp for r in detect.reading_plan(q, detect.QUADS).collect()} == {0: True, 1: True, 4: True}
    assert {r.box_id: (r.warp, r.crop_x, r.crop_width) for r in detect.reading_plan(q, detect.BOXES).collect()} == {0: (False, 10, 50), 1: (False, 10, 50), 4: (False, 20, 50)}


def test_whole_pages(spark):
    """Detection and reading with models made of plain arithmetic: dark pixels are text, a line's text is its width."""
    data = np.full((40, 64, 4), 255, np.uint8)
    data[4:12, 6:40, :3] = 0
    data[24:34, 10:58, :3] = 0
    pages = spark.createDataFrame([(7, data.tobytes(), 64, 40)], "page long, data binary, width int, height int")

    def find():
        def run(pdf):
            out = []
            for r in pdf.itertuples():
                p = (1 - np.frombuffer(r.tensor, np.float32).reshape(3, r.tensor_height, r.tensor_width)[0].astype(float)) / 2
                y, x = np.nonzero(p > 0)
                out.append(pd.DataFrame({"page": r.page, "map_w": r.tensor_width, "map_h": r.tensor_height, "y": y, "x": x, "p": p[y, x]}))
            return pd.concat(out)

        return run

    def say():
        def run(pdf):
            rows = [(r.page, r.comp, t, [float(c == k) for c in range(4)]) for r in pdf.itertuples() for t, k in enumerate([1, 2, 0, 2, 1 if r.tensor_width > 200 else 0])]
            return pd.DataFrame(rows, columns=["page", "comp", "t", "scores"])

        return run

    found = detect.page_boxes(pages, find)
    got = sorted((r.y1, r.x1) for r in found.collect())
    assert len(got) == 2 and abs(got[0][1] - 6) <= 2 and abs(got[1][1] - 10) <= 2
    words = spark.createDataFrame(list(enumerate(["blank", "k", "m", " "])), "idx int, ch string")
    texts = {r.y1 < 20: r.text for r in detect.read(pages, found, say, words).collect()}
    assert texts == {True: "kmm", False: "kmm"} or set(texts.values()) <= {"kmm", "kmmk"}


def plain_strip(text):
    out, found, at = [], 0, 0
    while m := re.search(rf"/{overlay.MARK}\s+BMC\b", text[at:]):
        begin = at + m.start()
        out.append(text[at:begin])
        found, depth, at = found + 1, 0, len(text)
        for k in re.finditer(r"/\S+?\s+BMC\b|\bBDC\b|\bEMC\b", text[begin:]):
            depth += -1 if k.group() == "EMC" else 1
            if not depth:
                at = begin + k.end()
                break
    return "".join([*out, text[at:]]), found


def test_strip(spark):
    r, m = random.Random(1), overlay.MARK
    parts = [f"/{m} BMC ", "EMC ", "EMC", "/Tx BMC ", "/P <<>> BDC ", "q 1 cm\n", "(x) Tj ", f"/Foo/{m} BMC ", f"/{m}\n BMC ", f"/{m} BMCx ", "BDC", "\n", " "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "page long, content string")
    assert {x.page: (x.stripped, x.found) for x in overlay.strip(df, ["page"]).collect()} == {i: plain_strip(t or "") for i, t in enumerate(texts)}


def test_streams(spark):
    own = f"/{overlay.MARK} BMC a EMC".encode()
    pages = spark.createDataFrame([(0, [b"q \xe9", b" " + own + b"\n"], None), (1, None, b"x " + own), (2, None, None), (3, [b"EMC"], None)], "page long, contents array<binary>, single binary")
    streams = overlay.content_streams(pages, single="single")
    assert {(r.page, r.place, r.content) for r in streams.collect()} == {(0, 0, "q é"), (0, 1, f" /{overlay.MARK} BMC a EMC\n"), (1, 0, f"x /{overlay.MARK} BMC a EMC"), (3, 0, "EMC")}
    assert {(r.page, r.place, r.content, r.found) for r in overlay.strip_pages(streams).collect()} == {(0, 0, "q é", 0), (1, 0, "x ", 1), (3, 0, "EMC", 0)}
    one = spark.createDataFrame([(1,), (9,)], "page long")
    assert {(r.page, r.place) for r in overlay.strip_pages(streams, one).collect()} == {(0, 0), (0, 1), (1, 0), (3, 0)}
    assert tuple(overlay.strip_counts(streams).first()) == (2, 2) and tuple(overlay.strip_counts(streams, one).first()) == (1, 1)


def test_layer_sink(spark, tmp_path):
    placed = spark.createDataFrame([(p, i, f"t{p}{i}") for p in range(3) for i in range(4)], "page long, seq long, piece string")
    for _ in range(2):  # the second write replaces the first
        files.write_pages(placed, f"{tmp_path}/layer")
    assert spark.read.parquet(f"{tmp_path}/layer").count() == 12
