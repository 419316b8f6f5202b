"""Relations of the document domain derived from the driver's tables by integer arithmetic that every engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.session import load

WIDTH, MAP = 1400, 48
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
DICTIONARY = ["blank", "a", "b", "m", "1", "w", "é", " "]
#: Microseconds since 1970 of a timestamp without time zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
STATUS = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}


def n_pages(spark: SparkSession, sf_dir: str) -> int:
    """About 120 boxes a page; the count comes from file footers."""
    return max(1, load(spark, sf_dir, "lineitem").count() // 120)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages are numbered before the other columns are made: fewer are shuffled, and conditions on pages reach the table
    li = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n_pages(spark, sf_dir)).alias("page"), *LINE_KEY)
    li = li.withColumn("box_id", F.row_number().over(Window.partitionBy("page").orderBy(*LINE_KEY)).cast("long"))
    x1, y1 = (F.col("l_partkey") * 37) % 1000, (F.col("l_orderkey") * 53 + F.col("l_suppkey") * 17) % 1600
    return li.select(
        "page", "box_id",
        x1.alias("x1"), y1.alias("y1"), (x1 + 40 + (F.col("l_partkey") % 7) * 60).alias("x2"), (y1 + 10 + (F.col("l_quantity").cast("long") % 9) * 2).alias("y2"),
        ((F.round(F.col("l_extendedprice") * 100).cast("long") % 1000).cast("double") / 1000).alias("score"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes on sixteen times as many pages, so that gutters appear."""
    return boxes(spark, sf_dir).withColumn("page", F.col("page") * 16 + F.col("box_id") % 16)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % n_pages(spark, sf_dir)).alias("page"), "o_orderkey", "o_custkey")
    o = o.withColumn("frame_id", F.row_number().over(Window.partitionBy("page").orderBy("o_orderkey")).cast("long"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wall = k % 17 == 0
    x1, y1 = F.when(wall, 0).otherwise((c * 31) % 900).cast("long"), (k * 41 + c * 7) % 1500
    return o.select("page", "frame_id", x1.alias("x1"), y1.alias("y1"), F.when(wall, WIDTH).otherwise(x1 + 100 + (c % 8) * 100).cast("long").alias("x2"), (y1 + 40 + (k % 11) * 30).alias("y2"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores: an embedding is eight steps of eight classes, four embeddings a sequence."""
    e = load(spark, sf_dir, "embeddings")
    at = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = e.select("vec_id", "embedding", at.alias("i"))
    return rows.select(F.floor(F.col("vec_id") / 4).cast("long").alias("seq_id"), ((F.col("vec_id") % 4) * 8 + F.col("i")).cast("long").alias("t"), F.slice("embedding", F.col("i") * 8 + 1, F.lit(8)).alias("scores"))


def dictionary(spark: SparkSession) -> DataFrame:
    """idx, ch of DICTIONARY."""
    return spark.createDataFrame(list(enumerate(DICTIONARY)), "idx int, ch string")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    n = max(1, o.count() // 150)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = (F.round(F.col("o_totalprice") * 100).cast("long") % 1000).cast("double") / 1000
    return o.groupBy((k % n).alias("page"), (F.floor((k * 7919 + c * 31) / 13) % MAP).alias("y"), (F.floor((c * 104729 + k * 17) / 11) % MAP).alias("x")).agg(F.max(p).alias("p"))


#: Width and height of rasters().
RASTER_W, RASTER_H = 11, 7


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, data (RGBA, by arithmetic on page, place and channel), width, height."""
    page = F.col("page")
    value = lambda i: (page * 7 + F.floor(i / 4 / RASTER_W) * 31 + F.floor(i / 4) % RASTER_W * 17 + i % 4 * 5 + page * (F.floor(i / 4) % 5)) % 256
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4 * RASTER_W * RASTER_H - 1)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), ""))
    return load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 60).alias("page")).distinct().select("page", data.alias("data"), F.lit(RASTER_W).alias("width"), F.lit(RASTER_H).alias("height"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and scales of the maps of pixels()."""
    return pixels(spark, sf_dir).select("page").distinct().select("page", F.lit(MAP).alias("map_w"), F.lit(MAP).alias("map_h"), F.lit(90).alias("width"), F.lit(180).alias("height"), F.lit(0.5).alias("scale_x"), F.lit(0.25).alias("scale_y"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, box_id, points: boxes sheared by up to 40 pixels, some of no height."""
    lean = F.when(F.col("box_id") % 3 == 0, F.col("box_id") % 81 - 40).otherwise(0)
    low = F.when(F.col("box_id") % 11 == 0, F.col("y1") + F.col("box_id") % 4).otherwise(F.col("y2"))
    return boxes(spark, sf_dir).select("page", "box_id", F.array("x1", "y1", "x2", F.col("y1") + lean, "x2", low + lean, "x1", low).alias("points"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, type, shown, position: regions on pages 0 to 2 in every shape that drawing programs write."""
    k = F.col("o_orderkey")
    a, b, c, d = (x.cast("string") for x in (k % 90, F.col("o_custkey") % 70, k % 31 + 5, F.col("o_custkey") % 17 + 9))
    pair, one, two = F.concat_ws(",", a, b, c, d), F.concat_ws(",", a, b), F.concat_ws(",", c, d)
    page = F.concat(F.lit('{"pageIndex":'), (k % 3).cast("string"))
    shapes = [
        F.concat(page, F.lit(',"rects":[['), pair, F.lit("]]}")),
        F.concat(page, F.lit(',"paths":[['), pair, F.lit("],["), pair, F.lit(",1,2,7]]}")),
        F.concat(page, F.lit("}")),
        F.lit("not json"),
        F.concat(page, F.lit(',"paths":[{"points":['), one, F.lit('],"lines":[['), two, F.lit(']],"other":[900,900,901,901]}]}')),
        F.concat(page, F.lit(',"rects":[[[[['), one, F.lit("],["), two, F.lit("]]]]]}")),
        F.concat(page, F.lit(',"rects":[[[[[['), pair, F.lit("]]]]]]}")),
        F.concat(page, F.lit(',"rects":['), pair, F.lit('],"paths":[["x",1,2],[1],[null,5,6]]}')),
    ]
    shape = F.element_at(F.array(*shapes), (k % 8 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("image", "ink", "note")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(k.alias("key"), (k % 700).alias("item"), kind.alias("type"), (k % 700 % 2 == 0).alias("shown"), shape.alias("position"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to eight managed queues."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    kind = F.when(k % 401 == 0, "cancel_remaining").when(k % 17 == 0, "cancel").when(k % 23 == 0, "cancel_current").otherwise("enqueue")
    return e.select((F.col("user_id") % 8).alias("queue"), k.alias("seq"), F.floor(F.expr(MICROS.format("ts")) / 1000).cast("long").alias("at"), kind.alias("kind"), F.when(kind == "cancel", k - 8 * (k % 5)).otherwise(k).alias("job_id"), (k % 50).alias("target"), (F.floor(F.col("value")).cast("long") * 1000).alias("duration"), (k % 7 != 0).alias("good"))


def streams(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    """page, place, content: contents() and, on every other page, a stream of one marked block."""
    c = contents(spark, sf_dir, mark)
    block = c.where("page % 2 = 0").select("page", F.lit(1).alias("place"), F.lit(f" /{mark} BMC BT (own) Tj ET EMC\n").alias("content"))
    return c.select("page", F.lit(0).alias("place"), "content").unionByName(block)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events."""
    e = load(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    return e.select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    v = F.floor(F.col("value")).cast("long")
    status = F.when(F.col("event_id") % 29 == 0, "failed").when(F.col("event_id") % 31 == 0, "completed").otherwise("running")
    return e.select(F.col("user_id").alias("task_id"), "ts", "event_id", status.alias("status"), (v - 40).alias("percent"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")).alias("message"), F.when(F.col("event_type") == "click", "alloc").otherwise("other").alias("stage"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), (F.col("user_id") % 8).alias("queue"), F.floor(F.expr(MICROS.format("ts")) / 1000).cast("long").alias("arrival"), (F.floor(F.col("value")).cast("long") * 1000).alias("duration"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parent items, parts as attachments of them."""
    o, p = load(spark, sf_dir, "orders"), load(spark, sf_dir, "part")
    top = o.select((F.col("o_orderkey") * 2).alias("id"), (F.col("o_custkey") % 3).alias("library_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("is_attachment"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("path"), F.concat(F.lit("Item "), F.col("o_orderkey")).alias("title"))
    k = F.col("p_partkey")
    name = F.concat(F.lit("/files/"), k, F.when(k % 7 == 0, ".PDF").when(k % 11 == 0, ".txt").otherwise(".pdf"))
    child = p.select(
        (k * 2 + 1).alias("id"), (k % 3).alias("library_id"), F.when(k % 13 != 0, (F.floor(k / 4) * 2).cast("long")).alias("parent_id"), F.lit(True).alias("is_attachment"),
        F.when(k % 5 == 0, "application/pdf").alias("content_type"), F.when(k % 9 != 0, name).alias("path"), F.concat(F.lit("Part "), k, F.when(k % 4 == 1, " [ocr]").when(k % 4 == 2, " x[OCR]").otherwise("")).alias("title"),
    )
    return top.unionByName(child)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected ids: every item with an odd half, so parents and attachments both."""
    return items(spark, sf_dir).where(F.floor(F.col("id") / 2) % 2 == 1).select("id")


_NAN, _INF = float("nan"), float("inf")
#: Values of each setting as stored.
SETTINGS = [(None, 0, -5, 0.5, 1536, 2048.5, 1, _NAN, _INF), (None, 0, 30, 1, 0.255, 150, -2, 0.3, _NAN, -_INF, _INF), (40, None, 0, 0.4, 1, _NAN), (None, 0, 200, -5, 30.5, 45, _NAN, _INF, -_INF), (0, 1, 2, 3, None, 1.5, _NAN), (4, 2.5, 99, 0, None, 8, _INF, _NAN)]


def raw_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as stored: null, negative, zero, fractions, one, large numbers, none and infinity."""
    k = F.col("p_partkey")
    pick = lambda i, values: F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), ((k * i) % len(values) + 1).cast("int"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", pick(1, SETTINGS[0]).alias("limit_side"), pick(3, SETTINGS[1]).alias("det_thresh"), pick(5, SETTINGS[2]).alias("box_thresh"),
        pick(7, SETTINGS[3]).alias("max_rot"), pick(11, SETTINGS[4]).alias("crop_mode"), pick(13, SETTINGS[5]).alias("workers"),
    )


def contents(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    """Content streams with marked blocks: nested, repeated, unclosed or none."""
    k = F.col("page_id")
    n = k.cast("string")
    a, nested = F.concat(F.lit(f"/{mark} BMC BT ("), n, F.lit(") Tj ET EMC ")), F.concat(F.lit(f"/{mark} BMC /Tx BMC ("), n, F.lit(") /Sp <<>> BDC x EMC EMC y EMC "))
    text = F.concat(F.lit("q "), n, F.lit(" cm "), F.when(k % 5 == 1, a).when(k % 5 == 2, F.concat(nested, F.lit("/Im Do "), a)).when(k % 5 == 3, F.concat(a, F.lit(f"/Keep BMC k EMC /{mark} BMC open "))).otherwise(F.lit("/Keep BMC k EMC ")), F.lit("Q"))
    return load(spark, sf_dir, "pages").select(k.alias("page"), text.alias("content"))
