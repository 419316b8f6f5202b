"""Token counts by an exact length histogram.

Documents are aggregated by encoded length (map-side partial sums, so a hot length or source costs one row a task).
Suffix sums over the histogram then answer every context limit: how many documents reach a limit, how many tokens lie in
them, and how many tokens remain if each document is truncated there. Suffix sums run in two levels, over blocks of
lengths and inside blocks, so no task holds the whole histogram.

Defined results: null or empty text has length 0; an empty table has an empty histogram; repeated rows count each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm._text import batches
from leafline.llm.bpe import encoder
from leafline.session import cut, ship

#: Lengths in a block of the two-level suffix sums.
BLOCK = 128


def lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One column n_tokens: the encoded length of every row's text, nothing else crossing back from Python."""
    ship(docs.sparkSession)

    def run(it):
        enc = encoder(path)
        for batch in it:
            for part in batches(batch, text, 4 << 20):
                values = [v or "" for v in part.column(0).to_pylist()]
                enc.warm(values)
                yield pa.record_batch([pa.array([sum(map(len, enc.parts(v))) // 4 for v in values], pa.int64())], ["n_tokens"])

    return docs.select(text).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """length, n_docs: exact counts."""
    return lengths.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds for each length L: docs_from (documents of L tokens or more), tokens_from (their tokens), n_tokens (tokens of documents of exactly L), truncated_total (tokens of all documents cut at L)."""
    # read by both levels: written once, so that texts are encoded once
    h = cut(hist, "length-histogram").select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("_block"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    wide = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    later = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(wide), F.lit(0)).alias("_later_d"),
        F.coalesce(F.sum("_t").over(wide), F.lit(0)).alias("_later_t"),
        F.coalesce(F.sum("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before_t"),
    )
    down = Window.partitionBy("_block").orderBy("length").rowsBetween(0, Window.unboundedFollowing)
    up = Window.partitionBy("_block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(later, "_block").select(
        "length", "n_docs", "n_tokens", (F.sum("n_docs").over(down) + F.col("_later_d")).alias("docs_from"), (F.sum("n_tokens").over(down) + F.col("_later_t")).alias("tokens_from"), (F.sum("n_tokens").over(up) + F.col("_before_t")).alias("_upto_t")
    )
    return out.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", (F.col("_upto_t") + F.col("length") * (F.col("docs_from") - F.col("n_docs"))).alias("truncated_total"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: total tokens with every document cut at limit, and how many documents are cut; any limit, present as a length or not."""
    return sums.agg(
        F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("n_cut")
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents do not exceed (null for no documents)."""
    total = sums.agg(F.sum("n_docs").alias("_n"))
    reached = sums.crossJoin(F.broadcast(total)).where((F.col("_n") - F.col("docs_from") + F.col("n_docs")) >= F.lit(q) * F.col("_n"))
    return reached.agg(F.min("length").alias("length"))
