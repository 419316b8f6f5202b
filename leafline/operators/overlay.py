"""Text layers of pages: stripping marked blocks from content streams, restoring pages, placing text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions import geometry as G
from leafline.functions.text import font_runs, trim
from leafline.operators import order

#: The name that marks a block as written by this engine.
MARK = "LeafLayer"
#: Metrics of the two fonts of a layer, at size 1: width of a character (ASCII, others), size by box height, descent.
METRICS = {"latin": (0.5, 1.0, 0.2), "other": (1.0, 1.0, 0.2)}
#: Fixed value: operators that open or close marked content in a stream.
MARKED = r"(/\S+?\s+BMC\b|\bBDC\b|\bEMC\b|\z)"


def strip(streams: DataFrame, keys: list[str], column: str = "content", mark: str = MARK) -> DataFrame:
    """keys, stripped and found: each stream without the blocks of the mark, and their number. keys name a stream; null is empty.

    Streams become rows of (text before, operator); depth is a running sum. A marked block ends behind the next operator
    that returns to the depth before it, or with the stream: a window over the rows of one stream and one depth finds it.
    Rows that the running maximum of ends covers go; so nested blocks go with the outer one.
    """
    own = rf"/{re.escape(mark)}\s+BMC\z"
    text = F.coalesce(F.col(column), F.lit(""))
    pair = lambda i: F.regexp_extract_all(text, F.lit("(?s)(.*?)" + MARKED), F.lit(i))
    rows = streams.select(*keys, F.posexplode(F.arrays_zip(pair(1).alias("gap"), pair(2).alias("op"))).alias("pos", "_t")).select(*keys, "pos", "_t.gap", "_t.op")
    in_order = Window.partitionBy(*keys).orderBy("pos")
    change = F.when(F.col("op") == "EMC", -1).when(F.col("op") == "", 0).otherwise(1)
    rows = rows.withColumns({"depth": F.sum(change).over(in_order), "opens": F.col("op").rlike(own)})
    # an opening row looks for the next row whose depth is the one before it; only closing operators go down
    meets = F.when(F.col("opens"), F.array(F.struct(F.col("depth"), F.lit(False).alias("o")), F.struct((F.col("depth") - 1).alias("depth"), F.lit(True).alias("o")))).otherwise(F.array(F.struct(F.col("depth"), F.lit(False).alias("o"))))
    level = rows.select("*", F.explode(meets).alias("_m")).withColumns({"_level": F.col("_m.depth"), "_o": F.col("_m.o")})
    later = Window.partitionBy(*keys, "_level").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ends = level.withColumn("end", F.min(F.when(~F.col("_o"), F.col("pos"))).over(later)).groupBy(*keys, "pos").agg(F.min("gap").alias("gap"), F.min("op").alias("op"), F.max(F.when(F.col("_o"), F.coalesce("end", F.lit(2**31 - 1)))).alias("end"))
    covered = F.coalesce(F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) >= F.col("pos")
    outer = ends.withColumn("covered", covered)
    begins = F.col("end").isNotNull() & ~F.col("covered")
    head = F.concat("gap", F.regexp_replace("op", own, ""))
    kept = F.when(F.col("covered"), F.lit("")).when(begins, head).otherwise(F.concat("gap", "op"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", kept.alias("x")))), lambda e: e["x"])
    return outer.groupBy(*keys).agg(F.array_join(pieces, "").alias("stripped"), F.count_if(begins).cast("int").alias("found"))


def content_streams(pages: DataFrame, page: str = "page", contents: str = "contents", single: str | None = None) -> DataFrame:
    """page, place, content: the streams of pages as ISO-8859-1 text. contents is an array of binary streams; single, if given, a column with one stream that stands where contents is null."""
    listed = F.col(contents) if single is None else F.coalesce(F.col(contents), F.when(F.col(single).isNotNull(), F.array(single)))
    return pages.select(page, F.posexplode(listed).alias("place", "_s")).select(page, "place", F.decode("_s", "ISO-8859-1").alias("content"))


def strip_pages(streams: DataFrame, targets: DataFrame | None = None, page: str = "page", mark: str = MARK) -> DataFrame:
    """page, place, content, found of the streams that stay: blocks go on the target pages (all if none are given), and so do streams that held blocks and are blank without them."""
    hit = streams if targets is None else streams.join(targets.select(page).distinct(), page, "left_semi")
    got = strip(hit, [page, "place"], mark=mark)
    changed = got.where("found > 0").select(page, "place", F.col("stripped").alias("_new"), "found")
    both = streams.join(changed, [page, "place"], "left")
    return both.where(F.col("found").isNull() | (trim(F.col("_new")) != "")).select(page, "place", F.coalesce("_new", "content").alias("content"), F.coalesce("found", F.lit(0)).alias("found"))


def strip_counts(streams: DataFrame, targets: DataFrame | None = None, page: str = "page", mark: str = MARK) -> DataFrame:
    """One row: blocks found and pages that held one."""
    hit = streams if targets is None else streams.join(targets.select(page).distinct(), page, "left_semi")
    per = strip(hit, [page, "place"], mark=mark).groupBy(page).agg(F.sum("found").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"), F.count_if(F.col("n") > 0).alias("pages_stripped"))


def restore(target: DataFrame, source: DataFrame, pages: Column, key: str = "page", value: str = "content") -> DataFrame:
    """Takes value from source on the pages that the condition names and both documents have; restored tells where."""
    s = source.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return target.join(s, (F.col(key) == F.col("_k")) & pages, "left").withColumns({value: F.coalesce("_v", value), "restored": F.col("_k").isNotNull()}).drop("_k", "_v")


def run_offsets(runs: DataFrame, keys: list[str], place: str, width: Column) -> DataFrame:
    """Adds offset: the widths of the runs before this one."""
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("offset", F.coalesce(F.sum(width).over(w), F.lit(0)))


def text_width(runs: Column, metrics: dict = METRICS) -> Column:
    """Width of font runs at size 1."""
    return F.aggregate(runs, F.lit(0.0), lambda s, r: s + F.length(r["text"]) * F.when(r["latin"], metrics["latin"][0]).otherwise(metrics["other"][0]))


def layer(lines: DataFrame, document: DataFrame, regions: DataFrame, width: int, two_column: bool, metrics: dict = METRICS) -> DataFrame:
    """The runs of an invisible text layer: page, seq, run, latin, piece, x, y, font_size, sx, dx.

    lines: page, box_id, x1 .. y2 (pixels), text, seq (their order if the page has regions), page_pixels, page_points
    (width as rendered; 0 if unknown). document: page, width_pt, height_pt; lines of other pages go. Pages without regions
    are put in reading order. Blank lines and boxes under a point go. Fonts are given by their metrics.
    """
    there = lines.join(document, "page")
    drawn = regions.select("page").distinct()
    own, plain = there.join(drawn, "page", "left_semi"), there.join(drawn, "page", "left_anti").drop("seq")
    sorted_ = order.two_columns(plain, ["page"], width) if two_column else order.reading(plain, ["page"])
    placed = own.unionByName(sorted_.select(*own.columns)).withColumn("text", trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    placed = placed.withColumns({"_runs": font_runs(F.col("text")), "_scale": G.pixel_to_point(F.col("page_pixels"), F.col("page_points"), F.col("width_pt"))})
    # one run of other characters makes their font decide the height
    mixed = F.exists("_runs", lambda r: ~r["latin"])

    def at(font: str) -> Column:
        return G.placement(G.box(), F.col("_scale"), F.col("height_pt"), text_width(F.col("_runs"), metrics), metrics[font][1], metrics[font][2])

    placed = placed.withColumn("_at", F.when(mixed, at("other")).otherwise(at("latin"))).where("_at is not null")
    runs = placed.select("page", "seq", "_at.*", F.posexplode("_runs").alias("run", "_r")).select("page", "seq", "run", "_r.latin", F.col("_r.text").alias("piece"), "x", "y", "font_size", "sx")
    wide = F.length("piece") * F.when(F.col("latin"), metrics["latin"][0]).otherwise(metrics["other"][0]) * F.col("font_size")
    return run_offsets(runs, ["page", "seq"], "run", wide).withColumnRenamed("offset", "dx")
