"""Named queries against plain versions on small tables, where rows and text beyond a prefix decide."""

import math
import re
from collections import Counter, defaultdict
from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq

from leafline.operators import order
from leafline.plans.queries import ALL
from leafline.sources import relations as R

LINES = ["", "plain words in a line", "a good start and then " + "x" * 60, "first twelve x" + "é" * 40, "ab 日本 cd — ef", "ascii only for a long while, then café", "- - - - - - - - - - - - -", "............text with dots"]


def garbage(t):
    t = t.strip()
    solid = t.replace(" ", "")
    run = max((len(list(g)) for _, g in groupby(t)), default=0)
    most = max((solid.count(c) for c in set(solid)), default=0)
    useful = len(re.findall(r"[0-9A-Za-z一-鿿]", t))
    return not t or (run >= 4 and 3 * run >= len(t)) or (len(solid) >= 6 and 2 * most >= len(solid)) or (useful < 2 and len(t) >= 4)


def test_whole_lines(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["\n".join(LINES), LINES[2]]}), tmp_path / "documents.parquet")
    lines = [(1, i, t) for i, t in enumerate(LINES)] + [(2, 0, LINES[2])]
    got = {(r.doc_id, r.line_no): r.garbage for r in ALL["garbage_text"](spark, str(tmp_path)).collect()}
    assert got == {(d, i): garbage(t) for d, i, t in lines}
    want = set()
    for d, i, t in lines:
        offset = 0
        for k, (latin, g) in enumerate(groupby(t, lambda c: c < "\x80")):
            piece = "".join(g)
            want.add((d, i, k, latin, piece, offset))
            offset += len(piece) * (5 if latin else 10)
    assert {tuple(r) for r in ALL["font_runs"](spark, str(tmp_path)).select("doc_id", "line_no", "run", "latin", "piece", "offset").collect()} == want


def by_page(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page].append(r)
    return out


def covered(spans):
    return len(set().union(*[range(a, b) for a, b in spans])) if spans else 0


def claimed(spark, small):
    """The frame of each box, over all frames of its page."""
    held, out = by_page(R.frames(spark, small)), {}
    for page, bs in by_page(R.boxes(spark, small)).items():
        for b in bs:
            slack, mid = max(4, b.y2 - b.y1), b.y1 + b.y2
            hit = [(min(b.x2, f.x2) - max(b.x1, f.x1), -f.frame_id, f) for f in held[page] if 2 * f.y1 - slack <= mid <= 2 * f.y2 + slack and min(b.x2, f.x2) > max(b.x1, f.x1)]
            enough = 2 * covered([(max(b.x1, f.x1), min(b.x2, f.x2)) for _, _, f in hit]) >= max(1, b.x2 - b.x1)
            out[page, b.box_id] = (max(hit)[2].frame_id if hit and enough else -1, b.score)
    return out


def test_all_frames_claim(spark, small):
    want = claimed(spark, small)
    assert max(f for f, _ in want.values()) > 6
    got = {n: ALL[n](spark, small).collect() for n in ("frame_claim", "frame_partition", "class_counts", "union_parts")}
    assert {(r.page, r.box_id): r.frame_id for r in got["frame_claim"]} == {k: f for k, (f, _) in want.items()}
    side = {k: "in" if f >= 0 else "out" for k, (f, _) in want.items()}
    at = {(r.page, r.box_id): (r.page, r.x1, r.y1) for r in R.boxes(spark, small).collect()}
    read = {(at[k], side[k]) for k, (_, score) in want.items() if score >= 0.1}
    marks = {(*k, c) for k, c in side.items()} | {(*k, "norec") for k, c in side.items() if (at[k], c) not in read}
    assert sorted((r.page, r.box_id, r.cls) for r in got["frame_partition"]) == sorted(marks)
    n = Counter((page, c) for page, _, c in marks)
    assert {r.page: (r.n_in, r.n_out, r.n_norec) for r in got["class_counts"]} == {p: (n[p, "in"], n[p, "out"], n[p, "norec"]) for p, _ in want}
    rank = {p: {k: i for i, k in enumerate(sorted((int(want[p, b][0] < 0), b) for q, b in want if q == p), 1)} for p, _ in want}
    assert {(r.page, r.box_id): (r.part, r.seq) for r in got["union_parts"]} == {(p, b): (part, i) for p, ks in rank.items() for (part, b), i in ks.items()}


def test_all_frames_order(spark, small):
    want = claimed(spark, small)
    place = {(r.page, r.frame_id): r.seq for r in order.frames_in_order(R.frames(spark, small), ["page"], R.WIDTH).collect()}
    pages = by_page(ALL["page_final_order"](spark, small))
    assert sum(map(len, pages.values())) == len(want)
    for page, rows in pages.items():
        rows.sort(key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
        assert all(r.frame_id == want[page, r.box_id][0] for r in rows)
        ranks = [place[page, r.frame_id] if r.frame_id >= 0 else 1 << 30 for r in rows]
        assert ranks == sorted(ranks)


def test_union_of_all_boxes(spark, small):
    want = {page: covered([(b.x1, b.x2) for b in bs]) for page, bs in by_page(R.boxes(spark, small)).items()}
    assert {r.page: r.covered for r in ALL["interval_union"](spark, small).collect()} == want


def test_upright_boxes(spark, small):
    """Score over the whole bounding box and ends behind its last pixel."""
    px = {(r.page, r.y, r.x): r.p for r in R.pixels(spark, small).collect()}
    want = {}
    for c in ALL["component_stats"](spark, small).collect():
        w, h = c.x2 - c.x1 + 1, c.y2 - c.y1 + 1
        score = sum(px.get((c.page, y, x), 0) for y in range(c.y1, c.y2 + 1) for x in range(c.x1, c.x2 + 1)) / (w * h)
        d = w * h * 1.6 / (2 * (w + h))
        back = lambda v, scale, most: math.floor(min(most - 1, max(0, v / scale)) + 0.5)
        if score >= 0.2000001:
            want[c.page, c.comp] = (back(c.x1 - d, 0.5, 90), back(c.y1 - d, 0.25, 180), back(c.x1 + w + d, 0.5, 90), back(c.y1 + h + d, 0.25, 180), round(score, 9))
    assert want and {(r.page, r.comp): (r.p0, r.p1, r.p4, r.p5, r.score) for r in ALL["upright_boxes"](spark, small).collect()} == want
