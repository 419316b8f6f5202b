"""Exact dedup by composable polynomial fingerprints.

A text (A-Z lower-cased, null as empty) is a sequence of byte chunks; the fingerprint of a concatenation is
h(x + y) = h(x) * B**len(y) + h(y) for two moduli, so chunks are hashed apart and combined by length-shifted arithmetic.
Texts beyond HUGE bytes are split into rows of one chunk each, hashed in parallel and combined by a modular sum.

Rows with equal fingerprint and length are compared chunk by chunk: every chunk position of a group has one value iff the
least and the greatest chunk there are equal, which is aggregated map-side first, so a group of any size costs one
partial row for each task. Members of groups that fail the comparison are told apart by SHA-256 of the whole text.

Defined results: null equals empty; null identifiers are smaller than others; of rows that repeat the staying row, one
stays; other columns pass through dedup() under any name; an empty table gives no rows.

Skew: a group that holds more than a thousandth of all rows is met by broadcast (there are fewer than a thousand), so its
rows stay where they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm._text import LOWER, batches, string_buffers
from leafline.session import cut, fresh, ship

#: Two primes below 2**31 and a base for each: products fit 64 bits.
MODULI, BASES = (2147483647, 2147483629), (1000003019, 879190841)
CHUNK, HUGE = 1 << 16, 8 << 20
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL)


class Poly:
    """Polynomial hash of byte arrays modulo one prime."""

    def __init__(self, modulus: int, base: int):
        self.m, self.b = modulus, base % modulus
        powers = np.empty(CHUNK, np.uint64)
        p = 1
        for i in range(CHUNK - 1, -1, -1):
            powers[i] = p
            p = p * self.b % modulus
        self.powers = powers

    def chunk(self, data: np.ndarray) -> int:
        """At most CHUNK bytes; each byte counts one more than its value, so that leading zero bytes matter."""
        n = len(data)
        return int((data.astype(np.uint64) + np.uint64(1)) @ self.powers[CHUNK - n :] % np.uint64(self.m)) if n else 0

    def shift(self, h: int, n: int) -> int:
        return h * pow(self.b, n, self.m) % self.m

    def whole(self, data: np.ndarray) -> int:
        h = 0
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            h = (self.shift(h, len(part)) + self.chunk(part)) % self.m
        return h


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", moduli: tuple = MODULI, huge: int = HUGE) -> DataFrame:
    """row (a number for the row), key, size (bytes), f1, f2, sha256 of every row's normalised text; materialised in the shared folder."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    bases = BASES

    def short(it):
        polys = [Poly(m, b) for m, b in zip(moduli, bases, strict=True)]
        for whole in it:
            for batch in batches(whole):
                data, off = string_buffers(batch.column(1))
                data = LOWER[data]
                spans = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                cols = [batch.column(0), pa.array(np.diff(off)), *[pa.array([p.whole(s) for s in spans], pa.int64()) for p in polys], pa.array([hashlib.sha256(s).hexdigest() for s in spans], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "size", "f1", "f2", "sha256"])

    kind = slim.schema["key"].dataType.simpleString()
    long = F.octet_length("text") > huge
    small = slim.where(F.col("text").isNull() | ~long).mapInArrow(short, f"key {kind}, size long, f1 long, f2 long, sha256 string")

    def chunked(it):
        polys = [Poly(m, b) for m, b in zip(moduli, bases, strict=True)]
        for batch in it:
            out = [[], []]
            for raw, after in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                data = np.frombuffer(raw, np.uint8)
                for o, p in zip(out, polys, strict=True):
                    o.append(p.shift(p.whole(data), after))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *[pa.array(o, pa.int64()) for o in out]], ["key", "size", "sha256", "pos", "f1", "f2"])

    big = slim.where(long).select("key", F.to_binary(normal(F.col("text")), F.lit("utf-8")).alias("raw"))
    named = big.select("key", F.octet_length("raw").cast("long").alias("size"), F.sha2("raw", 256).alias("sha256"), "raw")
    step = 16 * CHUNK
    last = F.floor((F.col("size") - 1) / step)
    rows = named.select("key", "size", "sha256", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("raw"), (i * step + 1).cast("int"), F.lit(step)))).alias("pos", "part"))
    rows = rows.withColumn("after", F.greatest(F.lit(0), F.col("size") - (F.col("pos") + 1) * step))
    hashed = rows.repartition("sha256", "pos").mapInArrow(chunked, f"key {kind}, size long, sha256 string, pos int, f1 long, f2 long")
    one = hashed.groupBy("key", "size", "sha256", "pos").agg(F.min("f1").alias("f1"), F.min("f2").alias("f2"))
    combined = one.groupBy("key", "size", "sha256").agg((F.sum("f1") % moduli[0]).alias("f1"), (F.sum("f2") % moduli[1]).alias("f2")).withColumnsRenamed({"key": "_k", "sha256": "_s"}).drop("size")
    large = named.drop("raw").join(combined, F.col("key").eqNullSafe(F.col("_k")) & (F.col("sha256") == F.col("_s"))).select("key", "size", "f1", "f2", "sha256")
    return cut(small.unionByName(large).withColumn("row", F.monotonically_increasing_id()), "fingerprints")


#: A group of more rows than all rows divided by this is hot; so there are fewer hot groups than this, which are broadcast.
HOT = 1000
PRINT = ["size", "f1", "f2"]


def repeated(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups of several rows as size, f1, f2, n, last: the largest key and its row; those of them that are hot)."""
    many = cut(prints.groupBy(*PRINT).agg(F.count("*").alias("n"), F.max(F.struct("key", "row")).alias("last")).where("n > 1"), "repeated-prints")
    total = prints.count()
    return many, many.where(F.col("n") * HOT > total)


def by_group(rows: DataFrame, groups_: DataFrame, hot: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined with groups_ (one row each) so that no task gets a hot group whole: rows of hot groups, fewer than HOT, meet them by broadcast where they are; the others are shuffled."""
    there = F.broadcast(hot.select(*PRINT))
    at_once = rows.join(there, PRINT, "left_semi").join(F.broadcast(groups_.join(there, PRINT, "left_semi")), on, how)
    rest = rows.join(there, PRINT, "left_anti").join(groups_.join(there, PRINT, "left_anti"), on, how)
    return at_once.unionByName(rest)


def compared(docs: DataFrame, prints: DataFrame, many: DataFrame, hot: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """size, f1, f2 of groups of several rows whose texts are not all equal: chunkwise comparison of the texts themselves."""
    members = by_group(prints, many.select(*PRINT), hot, PRINT, "left_semi").select(F.col("key").alias("_key"), *PRINT, "sha256").distinct()
    texts = docs.select(F.col(key).alias("_k"), F.to_binary(normal(F.col(text)), F.lit("utf-8")).alias("raw"))
    texts = texts.withColumn("_size", F.octet_length("raw").cast("long"))
    joined = texts.join(members, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_size") == F.col("size")))
    step = 16 * CHUNK
    last = F.floor(F.greatest(F.lit(0), F.col("size") - 1) / step)
    chunks = joined.select(*PRINT, F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("raw"), (i * step + 1).cast("int"), F.lit(step)))).alias("pos", "part"))
    spread = chunks.groupBy(*PRINT, "pos").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    return spread.where("lo <> hi").select(*PRINT).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", moduli: tuple = MODULI, huge: int = HUGE) -> DataFrame:
    """For every row: key, keep_key (largest key of its group), group_size, kept, sha256."""
    prints = fingerprints(docs, key, text, moduli, huge)
    many, hot = repeated(prints)
    split = cut(compared(docs, prints, many, hot, key, text), "split-prints")
    if split.isEmpty():  # no two texts share a fingerprint by chance
        marked, agg, by = prints, many, PRINT
    else:
        there = by_group(prints, split.withColumn("_split", F.lit(True)), hot, PRINT, "left")
        marked = there.withColumn("sub", F.when(F.col("_split"), F.col("sha256")).otherwise(F.lit(""))).drop("_split")
        by = [*PRINT, "sub"]
        agg = marked.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.struct("key", "row")).alias("last")).where("n > 1")
    alone = F.col("n").isNull()
    return by_group(marked, agg, hot, by, "left").select(
        "key",
        F.when(alone, F.col("key")).otherwise(F.col("last.key")).alias("keep_key"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("last.row") == F.col("row"))).alias("kept"),
        "sha256",
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    own, sha, mine = fresh(docs.columns, "keep_key", "keep_sha", "sha")
    kept = groups(docs, key, text).where("kept").select(F.col("key").alias(own), F.col("sha256").alias(sha))
    named = docs.withColumn(mine, F.sha2(normal(F.col(text)), 256))
    stay = named.join(kept, F.col(key).eqNullSafe(F.col(own)) & (F.col(mine) == F.col(sha)), "left_semi")
    return stay.dropDuplicates([key, mine]).select(*docs.columns)
