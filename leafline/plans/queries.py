"""Named queries: every operator over relations derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions import geometry as G
from leafline.functions import text as T
from leafline.operators import catalog, decode, detect, frames, jobs, order, overlay, raster, region, suppress
from leafline.session import cut, freed, load, scratch
from leafline.sources import files
from leafline.sources import relations as R

B = ["page", "box_id"]
#: Pixels of a page.
PAGE_HEIGHT = 1600
#: Least score of detected boxes: between thousandths, so that the order of a sum decides nothing.
SCORE = 0.2000001
ALL = {}


def query(f):
    ALL[f.__name__] = f
    return f


def _next(spark, sf):
    b = R.boxes(spark, sf)
    return b.join(b.select("page", (F.col("box_id") - 1).alias("box_id"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")]), B)


@query
def box_area_iou(s: SparkSession, sf: str) -> DataFrame:
    a, b = G.box(), G.box("o_")
    j = _next(s, sf)
    return j.select(*B, G.area(a).alias("area"), G.intersection(a, b).alias("common"), G.union_area(a, b).alias("either"))


@query
def containment_anti(s, sf):
    return suppress.drop_contained(R.boxes(s, sf)).select(*B, "score")


@query
def greedy_iou(s, sf):
    return suppress.greedy(R.boxes(s, sf)).select(*B, "score")


@query
def nms_order(s, sf):
    return order.reading(suppress.suppress(R.boxes(s, sf)), ["page"]).select(*B, "seq")


@query
def line_cluster(s, sf):
    return order.lines(R.boxes(s, sf), ["page"]).select(*B, "line")


@query
def reading_order(s, sf):
    return order.reading(R.boxes(s, sf), ["page"]).select(*B, "seq")


@query
def two_column_order(s, sf):
    return order.two_columns(R.boxes(s, sf), ["page"], R.WIDTH).select(*B, "seq")


@query
def gutter_search(s, sf):
    return order.gutters(R.blocks(s, sf), ["page"])


@query
def stacked_order(s, sf):
    return order.stacked(R.blocks(s, sf), ["page"]).select(*B, "seq")


@query
def frame_bands(s, sf):
    return order.frames_in_order(R.frames(s, sf), ["page"]).select("page", "frame_id", "seq")


@query
def frame_zones(s, sf):
    return order.frames_in_order(R.frames(s, sf), ["page"], R.WIDTH).select("page", "frame_id", "seq")


def _claimed(s, sf):
    return frames.claim(R.boxes(s, sf), R.frames(s, sf))


@query
def frame_claim(s, sf):
    return _claimed(s, sf).select(*B, "frame_id")


@query
def interval_union(s, sf):
    return frames.covered_lengths(R.boxes(s, sf).select("page", F.col("x1").alias("s"), F.col("x2").alias("e")), ["page"])


def _written(s, sf):
    """Claimed boxes that recognition returned."""
    return _claimed(s, sf).join(_read(s, sf).where("text is not null").select(*B), B, "left_semi")


@query
def frame_partition(s, sf):
    return region.marks(_claimed(s, sf), _written(s, sf))


@query
def class_counts(s, sf):
    return frame_partition(s, sf).groupBy("page").pivot("cls", ["in", "out", "norec"]).count().select("page", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("in", "out", "norec")])


@query
def page_final_order(s, sf):
    return frames.final_order(R.boxes(s, sf), R.frames(s, sf), R.WIDTH, True).select(*B, "frame_id", "seq")


@query
def column_backtrack(s, sf):
    return order.backtracks(order.reading(R.boxes(s, sf), ["page"]), ["page"])


def _read(s, sf, b=None):
    """Recognised lines: boxes with text, those of low score not returned."""
    b = R.boxes(s, sf) if b is None else b
    text = F.repeat(F.lit("ab "), ((F.col("x1") + F.col("box_id")) % 9).cast("int"))
    return b.withColumn("text", F.when(F.col("score") >= 0.1, text))


@query
def missed_anti(s, sf):
    read = _read(s, sf)
    return frames.missing(read, read.where("text is not null"), ["page", "x1", "y1"]).select(*B)


@query
def reread_merge(s, sf):
    read = catalog.first_per(_read(s, sf), ["page", "x1", "y1"], ["box_id"])
    again = read.where("box_id % 4 = 0").select("page", (F.col("x1") + F.col("box_id") % 2).alias("x1"), "y1", F.repeat(F.lit("z"), (F.col("box_id") % 13).cast("int")).alias("text"))
    again = catalog.first_per(again, ["page", "x1", "y1"], ["text"])
    return frames.reread(read.select("page", "x1", "y1", "text"), again, ["page", "x1", "y1"])


@query
def top8_suspects(s, sf):
    return frames.first_suspects(_read(s, sf)).select(*B)


@query
def rescue_pad_scale(s, sf):
    p = G.padded(G.box(), F.lit(R.WIDTH), F.lit(PAGE_HEIGHT))
    return R.boxes(s, sf).where("score < 0.1").select(*B, *[G.scaled(c, F.lit(2)).alias(f"p_{k}") for k, c in p.items()])


@query
def ctc_collapse(s, sf):
    return decode.characters(decode.emissions(R.steps(s, sf)), R.dictionary(s)).select("seq_id", "t", "cls", "ch")


@query
def ctc_spaces(s, sf):
    return decode.decode(R.steps(s, sf), R.dictionary(s))


@query
def garbage_text(s, sf):
    return R.text_lines(s, sf).select("doc_id", "line_no", T.is_garbage(F.col("text")).alias("garbage"))


@query
def char_share(s, sf):
    return R.text_lines(s, sf).select("doc_id", "line_no", T.most_frequent(F.col("text")).alias("most"))


@query
def max_run(s, sf):
    return R.text_lines(s, sf).select("doc_id", "line_no", T.longest_run(F.col("text")).alias("run"))


@query
def low_density(s, sf):
    return _read(s, sf).select(*B, T.is_sparse(F.col("text"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("sparse"))


@query
def font_runs(s, sf):
    runs = R.text_lines(s, sf).select("doc_id", "line_no", F.posexplode(T.font_runs(F.col("text"))).alias("run", "r")).select("doc_id", "line_no", "run", "r.latin", F.col("r.text").alias("piece"))
    return overlay.run_offsets(runs, ["doc_id", "line_no"], "run", F.length("piece") * F.when(F.col("latin"), 5).otherwise(10))


@query
def sanitize_log(s, sf):
    line = F.concat(F.lit("GET /x?user="), "user_id", F.lit("&"), F.element_at(F.array(*[F.lit(x) for x in ("token", "apiKey", "Password", "page", "mytoken")]), (F.col("event_id") % 5 + 1).cast("int")), F.lit("=v"), "event_id", F.lit(" done"))
    return load(s, sf, "events").select("event_id", T.masked(line).alias("line"))


@query
def log_ring(s, sf):
    e = load(s, sf, "events").select(F.col("event_id").alias("seq"), F.date_format("ts", "HH:mm:ss.SSS").alias("stamp"), F.substring(F.concat("event_type", F.lit(" "), "props"), 1, 46).alias("line"))
    return jobs.log_ring(e)


@query
def page_spec(s, sf):
    k = F.col("p_partkey")
    n = k.cast("string")
    spec = F.when(k % 6 == 0, F.concat(n, F.lit(","), (k % 9).cast("string"), F.lit("-"), (k % 4).cast("string"))).when(k % 6 == 1, F.concat(F.lit(" "), (k % 8).cast("string"), F.lit("~"), (k % 8 + 3).cast("string"), F.lit(" foo 2"))).when(k % 6 == 2, "").when(k % 6 == 3, "0,1,10,11,foo,2-2").when(k % 6 == 4, "7 - 9").otherwise("abc")
    return load(s, sf, "part").select("p_partkey", F.array_join(T.page_list(spec, F.when(k % 5 == 0, 0).otherwise(10).cast("long"), k % 10 + 1).cast("array<string>"), ",").alias("pages"))


@query
def page_select(s, sf):
    """Requested pages that exist, distinct and ascending; on documents of three to nine pages."""
    o = load(s, sf, "orders").select((F.col("o_orderkey") % 50).alias("doc"), (F.col("o_custkey") % 12 - 1).alias("page"))
    return o.where(F.col("page").between(0, F.col("doc") % 7 + 2)).distinct()


@query
def prefs_parse(s, sf):
    r = R.raw_settings(s, sf)
    return r.select("p_partkey", *[c.alias(n) for n, c in T.preferences({c: F.col(c) for c in r.columns[1:]}).items()])


@query
def det_resize_plan(s, sf):
    w, h = F.col("p_size") * 97 + 3, (F.col("p_partkey") * 31) % 2900 + 5
    rw, rh = G.detection_size(w, h)
    return load(s, sf, "part").select("p_partkey", rw.alias("width"), rh.alias("height"), (rw / w).alias("scale_x"), (rh / h).alias("scale_y"))


@query
def rec_resize_plan(s, sf):
    return R.boxes(s, sf).select(*B, G.recognition_width((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")).alias("width"))


@query
def tilt_filter(s, sf):
    """Quads whose long axis leans by 30 degrees at most, or that are nearly square."""
    dx, dy, short = F.col("x2") - F.col("x1"), F.col("y1") % 400 - 200, F.col("y2") - F.col("y1")
    b = R.boxes(s, sf).withColumns({"tilt": F.round(G.tilt(dx.cast("double"), dy.cast("double")), 6), "square": F.hypot(dx.cast("double"), dy.cast("double")) < 1.5 * short})
    return b.where("square or tilt <= 30").select(*B, "tilt")


@query
def threshold_dilate(s, sf):
    return raster.dilated(R.pixels(s, sf), R.MAP, R.MAP)


@query
def components(s, sf):
    return raster.components(threshold_dilate(s, sf))


@query
def component_stats(s, sf):
    return raster.statistics(components(s, sf), R.pixels(s, sf)).withColumn("score", F.round(F.col("score") * F.col("n") * 1000).cast("long").cast("double") / (F.col("n") * 1000))


@query
def hull_rect(s, sf):
    return raster.rotated_boxes(components(s, sf))


@query
def polygon_area(s, sf):
    p = load(s, sf, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("poly"), (F.col("l_partkey") % 12).alias("i")).agg(F.min("l_suppkey").alias("x"), F.max("l_linenumber").cast("long").alias("y"))
    return raster.polygon(p, ["poly"]).select("poly", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"))


@query
def placement(s, sf):
    b = _read(s, sf).where("trim(text) <> ''").withColumn("at", G.placement(G.box(), F.lit(0.5), F.lit(800.0), F.length("text") * 0.5))
    return b.where("at is not null").select(*B, *[F.round(f"at.{c}", 6).alias(c) for c in ("x", "y", "font_size", "sx")])


@query
def marker_strip(s, sf):
    return overlay.strip(R.contents(s, sf, overlay.MARK), ["page"])


@query
def page_restore(s, sf):
    c = R.contents(s, sf, overlay.MARK)
    source = c.where("page % 3 <> 0").withColumn("content", F.concat(F.lit("old "), F.col("page").cast("string")))
    return overlay.restore(c, source, F.col("page") % 2 == 1)


@query
def selection_resolve(s, sf):
    return catalog.resolve(R.items(s, sf), R.selection(s, sf)).select("id", "disposition")


@query
def siblings(s, sf):
    return catalog.siblings(R.items(s, sf))


def _requests(s, sf):
    return load(s, sf, "part").select((F.col("p_partkey") * 3 + 1).alias("id"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("title"))


@query
def attach(s, sf):
    return catalog.attach(_requests(s, sf), R.items(s, sf))


@query
def attach_parent(s, sf):
    return catalog.attach_with_parent(_requests(s, sf), R.items(s, sf))


@query
def annotation_bbox(s, sf):
    return R.annotations(s, sf).select("key", files.position_box(F.col("position")).alias("b")).where("b is not null").select("key", "b.x1", "b.y1", "b.x2", "b.y2")


@query
def page_regions(s, sf):
    """Regions of an item's current page, shown annotations before stored ones."""
    a = R.annotations(s, sf)
    current = a.select("item").distinct().withColumn("page", F.col("item") % 3)
    return files.regions(a.where("shown"), a, current)


@query
def job_transitions(s, sf):
    return jobs.transitions(R.log(s, sf)).select("job_id", "event_id", "before", "status", "valid")


@query
def job_states(s, sf):
    return jobs.states(R.log(s, sf))


@query
def serial_queue(s, sf):
    return jobs.serial_queue(R.queue(s, sf)).select("job_id", "queue", "start", "finish")


@query
def task_state(s, sf):
    return jobs.task_cards(R.cards(s, sf)).select("task_id", "percent", "message", F.expr(R.MICROS.format("started")).alias("started"), "final")


@query
def elapsed_format(s, sf):
    return load(s, sf, "events").select("event_id", T.elapsed(F.floor(F.col("value") * 20000).cast("long") - 3000).alias("elapsed"))


@query
def union_parts(s, sf):
    """Lines inside frames, then lines outside, numbered through."""
    c = _claimed(s, sf).withColumn("part", F.when(F.col("frame_id") >= 0, 0).otherwise(1))
    return c.select(*B, "part", F.row_number().over(Window.partitionBy("page").orderBy("part", "box_id")).alias("seq"))


@query
def text_index(s, sf):
    """Inverted index of the corpus: documents and occurrences of each term."""
    words = load(s, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    per = words.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"))


@query
def progress(s, sf):
    """Share of a job's pages done after each page."""
    w = Window.partitionBy("doc").orderBy("page")
    d = page_select(s, sf)
    return d.select("doc", "page", F.round(F.row_number().over(w) * 100.0 / F.count("*").over(Window.partitionBy("doc")), 6).alias("percent"))


@query
def frame_points(s, sf):
    """Frames in points to pixels at twice the scale; empty ones go."""
    f = R.frames(s, sf)
    p = G.points_to_pixels(G.box(), F.lit(2.0), F.lit(2.0), F.lit(2600), F.lit(3000))
    return f.select("page", "frame_id", *[c.alias(f"p_{k}") for k, c in p.items()]).where("p_x2 > p_x1 and p_y2 > p_y1")


@query
def clip_text(s, sf):
    return _read(s, sf).select(*B, T.clipped(F.coalesce("text", F.lit("")), F.col("x1"), F.col("x2"), F.lit(300), F.lit(900)).alias("piece"))


@query
def title_fallback(s, sf):
    i = R.items(s, sf)
    return i.select("id", T.escaped(T.title_or_file(F.when(F.col("id") % 5 != 0, F.concat("title", F.lit(" <&>"))), F.col("path"))).alias("title"))


@query
def message_lookup(s, sf):
    table = s.createDataFrame([("en", "view", "{0} views of {1}"), ("en", "click", "clicked {0}"), ("zh", "view", "{1}: {0}"), ("en", "error", "failed")], "lang string, key string, text string")
    e = load(s, sf, "events").select("event_id", "user_id", F.col("event_type").alias("key"), T.language(F.when(F.col("user_id") % 2 == 0, "ZH-cn").otherwise("de")).alias("lang"))
    return catalog.messages(e, table, ["event_id", "user_id"]).select("event_id", "lang", "text")


@query
def active_jobs(s, sf):
    """Requests that a running or queued job of the same attachment does not bar."""
    e = load(s, sf, "events")
    asked = e.select(F.col("event_id").alias("job_id"), (F.col("event_id") % 400).alias("attachment_id"))
    busy = jobs.states(R.log(s, sf)).select((F.col("job_id") * 3).alias("attachment_id"), "status")
    return jobs.accepted(asked, busy)


@query
def upright_boxes(s, sf):
    """Detection in mode BOXES."""
    b = detect.boxes(R.pixels(s, sf), R.maps(s, sf), mode=detect.BOXES, box_threshold=SCORE)
    return b.select("page", "comp", *[F.get("points", F.lit(i)).alias(f"p{i}") for i in (0, 1, 4, 5)], "x1", "y1", "x2", "y2", F.round("score", 9).alias("score"))


@query
def det_boxes(s, sf):
    """Detection in mode MIXED."""
    b = detect.boxes(R.pixels(s, sf), R.maps(s, sf), box_threshold=SCORE)
    return b.select("page", "comp", F.array_join(F.col("points").cast("array<string>"), ",").alias("points"), "x1", "y1", "x2", "y2", F.round("score", 9).alias("score"))


@query
def det_tensor(s, sf):
    """Cells of the tensors of small rasters, resized to five by four."""
    t = raster.tensors(R.rasters(s, sf).withColumns({"to_width": F.lit(5), "to_height": F.lit(4)}))
    cells = lambda batches: (_cells(pdf) for pdf in batches)
    return t.mapInPandas(cells, "page long, plane int, y int, x int, v double").withColumn("v", F.round("v", 5))


def _cells(pdf):
    import numpy as np
    import pandas as pd

    out = []
    for r in pdf.itertuples(index=False):
        v = np.frombuffer(r.tensor, np.float32).reshape(3, r.tensor_height, r.tensor_width)
        plane, y, x = (i.reshape(-1) for i in np.indices(v.shape))
        out.append(pd.DataFrame({"page": r.page, "plane": plane, "y": y, "x": x, "v": v.reshape(-1).astype(float)}))
    return pd.concat(out) if out else pd.DataFrame({"page": [], "plane": [], "y": [], "x": [], "v": []})


@query
def crop_lines(s, sf):
    """Cells of crops from small rasters, copied or sampled along a quad that leaves the raster."""
    page = F.col("page")
    quad = F.array(*[x.cast("long") for x in (page % 5 - 2, page % 3, page % 5 + 6, page % 3 + page % 4, page % 5 + 5, page % 4 + 6, page % 5 - 3, F.lit(6))])
    plan = detect.reading_plan(R.rasters(s, sf).select("page", quad.alias("points")))
    t = raster.line_tensors(R.rasters(s, sf), plan.withColumn("width", F.lit(6)).select("page", "points", "warp", "crop_x", "crop_y", "crop_width", "crop_height", "width"), line_height=4)
    cells = lambda batches: (_cells(pdf) for pdf in batches)
    return t.mapInPandas(cells, "page long, plane int, y int, x int, v double").withColumn("v", F.round("v", 5))


@query
def reading_plan(s, sf):
    """Crops of sheared quads."""
    return detect.reading_plan(R.quads(s, sf)).select(*B, "warp", "crop_x", "crop_y", "crop_width", "crop_height", "width")


def _plan(s, sf, b=None, f=None):
    """A plan's inputs: what recognition returns at first, of suspects and of rescued lines, for any box."""
    b, f = R.boxes(s, sf) if b is None else b, R.frames(s, sf) if f is None else f
    first = _read(s, sf, b).where("trim(text) <> '' and box_id % 7 <> 0").select(*B, "text")
    again = catalog.first_per(b.where("box_id % 2 = 0").select("page", "x1", "y1", F.repeat(F.lit("z"), (F.col("box_id") % 13).cast("int")).alias("text")), ["page", "x1", "y1"], ["text"])
    p = {k: G.scaled(c, F.lit(2)) for k, c in G.padded(G.box(), F.lit(R.WIDTH), F.lit(PAGE_HEIGHT)).items()}
    rescued = catalog.first_per(b.where("box_id % 3 > 0").select("page", p["x1"].alias("x1"), p["y1"].alias("y1"), F.concat(F.lit("r"), F.col("box_id").cast("string")).alias("text")), ["page", "x1", "y1"], ["text"])
    return b, f, first, again, rescued, R.WIDTH, PAGE_HEIGHT, 2.0


@query
def region_lines(s, sf):
    """The lines of pages with frames: first readings, second readings, rescues."""
    b, f, first, again, rescued, w, h, ratio = _plan(s, sf)
    return region.lines(frames.claim(b, f), first, again, rescued, F.lit(w), F.lit(h), F.lit(ratio)).select(*B, "origin", "text", "frame_id")


@query
def region_plan(s, sf):
    return region.plan(*_plan(s, sf), two_column=True).select(*B, "origin", "text", "frame_id", "seq")


#: Pages counted in one round, and rounds at most: each reads the tables once.
ROUND_PAGES, ROUNDS = 100_000, 4


@query
def region_counters(s, sf):
    """Pages do not touch each other: they are counted in rounds, so that tables between hold a part of the pages."""
    n = min(ROUNDS, -(-R.n_pages(s, sf) // ROUND_PAGES))
    return reduce(DataFrame.unionByName, [_counters(s, sf, F.pmod("page", F.lit(n)) == k) for k in range(n)])


def _counters(s: SparkSession, sf: str, some: Column) -> DataFrame:
    """Counters of some pages; of what it writes only these stay."""
    with scratch(s) as keep, freed(s):
        b, f = cut(R.boxes(s, sf).where(some), "counters-boxes"), cut(R.frames(s, sf).where(some), "counters-frames")
        b, f, first, again, rescued, w, h, ratio = _plan(s, sf, b, f)
        claimed = cut(frames.claim(b, f), "counters-claimed")
        return keep(region.counters(claimed, region.lines(claimed, first, again, rescued, F.lit(w), F.lit(h), F.lit(ratio))), "counters")


@query
def frame_fallback(s, sf):
    """Pages with frames of odd numbers, and those read whole."""
    drawn, whole = region.page_frames(R.boxes(s, sf).select("page").distinct(), R.frames(s, sf).where("page % 2 = 1"))
    return drawn.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)))


@query
def text_layer(s, sf):
    """Runs of a layer: pages of odd numbers have regions, every fifth page is not in the document."""
    text = F.when(F.col("box_id") % 4 == 0, F.concat("text", F.lit("é"), F.col("box_id").cast("string"))).otherwise(F.col("text"))
    lines = _read(s, sf).withColumn("text", text).withColumn("seq", (F.lit(1000) - F.col("box_id")).cast("int"))
    lines = lines.withColumns({"page_pixels": F.when(F.col("page") % 7 == 0, 0).otherwise(R.WIDTH), "page_points": F.when(F.col("page") % 3 == 0, 0.0).otherwise(F.lit(700.0))})
    pages = R.boxes(s, sf).select("page").distinct()
    document = pages.where("page % 5 > 0").withColumns({"width_pt": F.lit(612.0), "height_pt": F.lit(792.0)})
    got = overlay.layer(lines, document, pages.where("page % 2 = 1"), R.WIDTH, False)
    return got.select("page", "seq", "run", "latin", "piece", *[F.round(c, 6).alias(c) for c in ("x", "y", "font_size", "sx", "dx")])


@query
def strip_pages(s, sf):
    return overlay.strip_pages(R.streams(s, sf, overlay.MARK), load(s, sf, "pages").where("page_id % 3 > 0").select(F.col("page_id").alias("page")))


@query
def strip_counts(s, sf):
    return overlay.strip_counts(R.streams(s, sf, overlay.MARK))


@query
def total_boxes(s, sf):
    """Boxes over all pages, from pages that hold arrays of them."""
    return R.boxes(s, sf).groupBy("page").agg(F.collect_list("box_id").alias("boxes")).agg(F.sum(F.size("boxes")).cast("long").alias("n_boxes"))


@query
def managed_queue(s, sf):
    return jobs.managed_queue(R.requests(s, sf))


@query
def log_dropped(s, sf):
    return jobs.dropped(load(s, sf, "events"))


@query
def task_insert(s, sf):
    e = load(s, sf, "events")
    known = e.where("event_id % 4 = 0").groupBy((F.col("user_id") % 90).alias("task_id")).agg(F.min("event_id").alias("seq"))
    return jobs.insert_if_absent(known, e.select((F.col("user_id") % 130).alias("task_id"), F.col("event_id").alias("seq")))


@query
def any_active(s, sf):
    return jobs.any_active(jobs.states(R.log(s, sf)))


@query
def effective_options(s, sf):
    """A job's own options before the preferences of its library."""
    r = R.raw_settings(s, sf)
    typed = T.preferences({c: F.col(c) for c in r.columns[1:]})
    own = {"limit_side": F.when(F.col("p_partkey") % 2 == 0, 960), "crop_mode": F.when(F.col("p_partkey") % 3 == 0, 0)}
    return r.select("p_partkey", *[c.cast(k).alias(n) for (n, c), k in zip(T.effective(own, typed).items(), ("long", "double", "double", "long", "long", "long"), strict=True)])


@query
def form_values(s, sf):
    """Settings as forms read them."""
    r = R.raw_settings(s, sf)
    return r.select("p_partkey", T.clamped(F.col("det_thresh"), 0, 1, 0.3).alias("share"), T.clamped(F.col("max_rot"), 0, 90, 30).alias("degrees"), T.one_of(F.col("crop_mode"), (0, 1, 2), 2).alias("mode"), T.percent(F.when(F.abs("box_thresh") < 1000, F.col("box_thresh")), 40).alias("percent"))


@query
def selection_preview(s, sf):
    return catalog.preview(R.items(s, sf), R.selection(s, sf)).select("id")


@query
def job_names(s, sf):
    """Identifiers of new jobs and the page indexes they ask for."""
    e = load(s, sf, "events")
    asked = F.array(F.col("event_id") % 9 + 1, F.col("event_id") % 5 + 12)
    return e.select("event_id", T.job_name(F.floor(F.expr(R.MICROS.format("ts")) / 1000).cast("long"), F.col("event_id") % 10).alias("name"), F.array_join(T.page_indexes(asked).cast("array<string>"), ",").alias("pages"))


def queries() -> dict:
    return dict(ALL)
