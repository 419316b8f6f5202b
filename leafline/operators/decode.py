"""Decoding class scores into text: collapse, dictionary lookup, recovery of spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters too wide to judge a gap by, the factor on the median gap, the least samples, the least space score.
WIDE, FACTOR, SAMPLES, SPACE = "mwMW", 1.55, 8, 0.1


def emissions(steps: DataFrame, seq: str = "seq_id") -> DataFrame:
    """steps (seq, t, scores) -> seq, t, cls of the steps that emit: the first largest class, neither blank (0) nor the previous step's."""
    best = steps.withColumn("cls", F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    last = F.lag("cls", 1, -1).over(Window.partitionBy(seq).orderBy("t"))
    return best.withColumn("_last", last).where("cls <> 0 and cls <> _last").drop("_last", "scores")


def characters(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ch from dictionary (idx, ch: one row for each class of a model, thousands); classes without a character are question marks."""
    table = dictionary.select(F.col("idx").cast("int").alias("cls"), F.nullif("ch", F.lit("")).alias("ch"))
    return found.join(F.broadcast(table), "cls", "left").withColumn("ch", F.coalesce("ch", F.lit("?")))


def space_class(dictionary: DataFrame) -> int:
    """The last class, the blank left out, that is a space; -1 without one."""
    last = dictionary.where("idx > 0 and ch = ' '").agg(F.max("idx")).first()[0]
    return -1 if last is None else last


def decode(steps: DataFrame, dictionary: DataFrame, seq: str = "seq_id") -> DataFrame:
    """seq and text; empty for sequences that emit nothing."""
    space = space_class(dictionary)
    found = characters(emissions(steps, seq), dictionary)
    w = Window.partitionBy(seq).orderBy("t")
    solid = F.ascii("ch").between(33, 126) & (F.length("ch") == 1)
    # the highest space score between two emissions: scores grouped by the last emission at or before a step
    after = steps.select(seq, "t", (F.get("scores", F.lit(space)) if space > 0 else F.lit(None)).cast("double").alias("p")).join(found.select(seq, "t", F.lit(1).alias("_e")), [seq, "t"], "left")
    after = after.withColumn("i", F.count("_e").over(w)).groupBy(seq, "i").agg(F.max("p").alias("p"))
    pairs = found.withColumn("i", F.row_number().over(w)).withColumn("_solid", solid)
    pairs = pairs.withColumns({"gap": F.when(F.col("_solid") & F.lag("_solid").over(w), F.col("t") - F.lag("t").over(w)), "_before": F.lag("ch").over(w)})
    gaps = F.array_sort(F.collect_list("gap"))
    cut = pairs.groupBy(seq).agg(F.when(F.count("gap") >= SAMPLES, F.element_at(gaps, (F.floor(F.count("gap") / 2) + 1).cast("int")) * FACTOR).alias("cut"))
    joined = pairs.join(cut, seq).join(after.select(seq, (F.col("i") + 1).alias("i"), "p"), [seq, "i"], "left")
    narrow = ~F.contains(F.lit(WIDE), F.col("ch")) & ~F.contains(F.lit(WIDE), F.col("_before"))
    hit = F.col("gap").isNotNull() & (F.coalesce(narrow & (F.col("gap") >= F.col("cut")), F.lit(False)) | F.coalesce(F.col("p") >= SPACE, F.lit(False)))
    piece = F.concat(F.when(hit, F.lit(" ")).otherwise(F.lit("")), F.col("ch"))
    texts = joined.groupBy(seq).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("x")))), lambda e: e["x"]), "").alias("text"))
    return steps.select(seq).distinct().join(texts, seq, "left").select(seq, F.coalesce("text", F.lit("")).alias("text"))
