"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents twice, in a shuffled order that depends on a hash of the row only. An offered document
gets the virtual finish time (cumulative words of its source so far) / (the source's target): each source passes 1 just
when it has given its target. All offers, sorted by finish time, are taken until the total budget is reached.

Targets share the budget by weight; no target exceeds `most` times its source's size, and the excess is reshared among the
rest by weight (water filling, in closed form over the table of sources).

Cumulative sums run in two levels, over hash buckets of a source and inside a bucket, so a source that holds a third of
all rows is dealt over many tasks. The place where the budget ends is found by narrowing a histogram of finish times; only
the offers of the last narrow interval are ordered in one task, and documents with texts move only in mix().

Defined results: null text has size 0 and is never taken; null sources form the last source; repeated rows count each;
an empty table gives no rows; a source without words has target 0; other columns pass through mix() under any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm._text import batches, string_buffers, words
from leafline.session import cut, fresh, ship

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Identical rows that are offered side by side; a source's rows that are equal in identifier and all columns beyond this are spread like others.
PIECE = 64
#: A row that is repeated in more than one of so many rows of the table is hot in mix(); so there are fewer hot rows than this.
HOT = 1000
#: Rows of a source in a hash bucket, on average; offers that are ordered in one task at most (but for equal finish times).
BUCKET_ROWS, LAST_OFFERS, BINS = 2048, 20_000, 2048


def sizes(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The given columns and size, the number of words of each row's text."""
    ship(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("_text"))
    n = len(slim.columns) - 1
    names = slim.columns[:n]

    def run(it):
        for whole in it:
            for batch in batches(whole, "_text"):
                size = np.diff(words(*string_buffers(batch.column(n)))[2])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(size.astype(np.int64))], [*names, "size"])

    return slim.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:n]) + ", size long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n_rows -> with rank and target. One row per source, so plain windows do."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    t = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("_cap", most * F.col("source_size"))
    whole = Window.partitionBy()
    fill = Window.orderBy((F.col("_cap") / F.col("_w")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_budget", F.lit(share) * F.sum("source_size").over(whole))
    t = t.withColumn("_full", F.coalesce(F.sum("_cap").over(fill), F.lit(0))).withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(fill), F.lit(0)))
    # the water level if just the sources before this one are full; the first source that stays below it sets the level
    t = t.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_rest"))
    t = t.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")), "rank").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_set", F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), F.col("rank"), F.col("_level").alias("level")))).over(order)["level"])
    return t.select("source", "source_size", "n_rows", "rank", F.coalesce(F.col("_set") * F.col("_w"), F.col("_cap").cast("double")).alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, h (hash of the whole row), size, source_size, target, copies (how often it is taken), first_finish for every row."""
    rows = sizes(docs, [F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(*docs.columns).alias("h")], text)
    # identical rows become one row with their number, then pieces of it, each with a place of its own
    same = cut(rows.groupBy("key", "source", "h", "size").agg(F.count("*").alias("m")), "mix-sizes")
    pieces = same.select("key", "source", "h", "size", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PIECE))).alias("piece"))
    rows = pieces.withColumns({"c": F.least(F.lit(PIECE).cast("long"), F.col("m") - F.col("piece") * PIECE), "u": F.xxhash64(F.lit(seed), "key", "h", "piece")})
    totals = cut(targets(same.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_rows")), weights, share, most), "mix-targets")
    budget = totals.agg(F.sum("source_size")).first()[0] or 0
    # F.broadcast is for tables of one row per source up to this many; beyond that Spark chooses
    named = totals.withColumn("n_buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS)).withColumnRenamed("source", "_source")
    if totals.count() <= 10_000:
        named = F.broadcast(named)
    unit = F.shiftrightunsigned("u", 11) / F.lit(float(1 << 53))
    r = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", F.floor(unit * F.col("n_buckets"))).drop("_source", "n_rows", "n_buckets")
    words_ = F.col("size") * F.col("c")
    sums = r.groupBy("rank", "bucket").agg(F.sum(words_).alias("_s"))
    before = sums.select("rank", "bucket", (F.sum("_s").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("u", "key", "h", "piece").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_own", F.sum(words_).over(inside) - words_).join(before, ["rank", "bucket"])
    r = r.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    cumulated = F.col("_before") + F.col("_own") + F.col("_i") * F.col("size")
    r = r.withColumn("finish", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (e * F.col("source_size") + cumulated) / F.col("target")))
    r = cut(r.select("key", "h", "m", "piece", "source", "rank", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("finish")).alias("finish")), "mix-finish")
    last = _last_taken(r, share * budget)
    if last is None:
        copies = F.lit(0)
    else:
        at, rank = last
        copies = F.size(F.filter(F.coalesce("finish", F.array().cast("array<double>")), lambda f: (f < F.lit(at)) | ((f == F.lit(at)) & (F.col("rank") <= rank))))
    return r.select("key", "h", "m", "piece", "source", "size", "source_size", "target", copies.alias("copies"), F.element_at("finish", 1).alias("first_finish"), "finish")


def _last_taken(r: DataFrame, budget: float) -> tuple[float, int] | None:
    """(finish time, rank of the source) of the last offer that the budget holds. Inside a source finish times differ, so the pair names one offer."""
    offers = r.select("rank", "size", F.explode("finish").alias("f"))
    low, high = offers.agg(F.min("f"), F.max("f")).first()
    if low is None:
        return None
    taken, cond = 0, F.lit(True)
    while high > low:
        step = (high - low) / BINS
        inner = offers.where(cond)
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("f") - F.lit(low)) / F.lit(step))).cast("int")
        hist = inner.groupBy(bin_of.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).orderBy("b").collect()
        hit = None
        for x in hist:  # BINS rows at most
            if taken + x["s"] > budget:
                hit = x
                break
            taken += x["s"]
        if hit is None:
            last = offers.where(F.col("f") == F.lit(high)).agg(F.max("rank")).first()[0]
            return high, last
        low, high = hit["lo"], hit["hi"]
        cond = F.col("f").between(F.lit(low), F.lit(high))
        if hit["n"] <= LAST_OFFERS:
            break
    order = Window.orderBy("f", "rank").rowsBetween(Window.unboundedPreceding, 0)
    held = offers.where(cond).withColumn("c", F.sum("size").over(order) + F.lit(taken)).where(F.col("c") <= F.lit(budget)).agg(F.max(F.struct("f", "rank"))).first()[0]
    if held is not None:
        return held["f"], held["rank"]
    earlier = offers.where(F.col("f") < F.lit(low)).agg(F.max(F.struct("f", "rank"))).first()[0]
    return (earlier["f"], earlier["rank"]) if earlier else (low, -1)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The taken documents, repeats included, with all their columns, whatever their names, range-sorted by virtual finish time."""
    key, cols = options.get("key", "doc_id"), docs.columns
    own, h, at, salt, mine, hot_own, hot_h, n, copy = fresh(cols, "mix_key", "mix_h", "mix_at", "mix_salt", "mix_row", "hot_key", "hot_h", "hot_n", "mix_copy")
    p = plan(docs, **options).where("copies > 0").select(F.col("key").alias(own), F.col("h").alias(h), "m", "piece", F.slice("finish", F.lit(1), F.col("copies")).alias("finish"))
    # one row of the table stands for all that are identical; those of hot rows are dealt over copies of it
    total = docs.count()
    is_hot, dealt = F.col("m") * HOT > total, F.least(F.lit(HOT).cast("long"), F.ceil(F.col("m") / PIECE))
    hot = F.broadcast(p.where(is_hot).select(F.col(own).alias(hot_own), F.col(h).alias(hot_h), dealt.alias(n)).distinct())
    offers = p.withColumn(salt, F.when(is_hot, F.pmod("piece", dealt)).otherwise(F.lit(0).cast("long"))).select(own, h, salt, F.explode("finish").alias(at))
    one = docs.withColumn(mine, F.xxhash64(*cols)).dropDuplicates([key, mine])
    numbers = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n) - 1, F.lit(0).cast("long")))
    spread = one.join(hot, F.col(key).eqNullSafe(F.col(hot_own)) & (F.col(mine) == F.col(hot_h)), "left").select(*cols, mine, F.explode(numbers).alias(copy))
    out = spread.join(offers, F.col(key).eqNullSafe(F.col(own)) & (F.col(mine) == F.col(h)) & (F.col(copy) == F.col(salt))).select(*cols, at)
    return out.repartitionByRange(at).sortWithinPartitions(at).select(*cols)
