"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the hashes of its distinct 5-word shingles (A-Z lower-cased). Two sets of sizes x and y reach the
similarity 0.75 only if they differ in at most U = floor((x + y) / 7) shingles.

Size bands. Interval k holds sizes from 2**k to 4/3 of 2**(k+1) - 1; the smaller set of a linked pair lies in the lower part
of one interval that holds both, so a set belongs to one or two intervals.

Segments. In an interval the hash range is cut into exact segments and, over its last eighth, into wider one-deletion
segments. A set's subset in a segment is indexed by a key of its content; a one-deletion segment is also indexed by the
keys of its subset with one shingle left out, so equal keys meet when the subsets differ by one shingle. An exact segment
without a common key costs a pair one difference at least, a one-deletion segment (of two shingles or more) two.

Allocation. Each set walks its non-empty segments in one order that all sets share: exact segments whose key is not
frequent, then one-deletion segments, then exact segments with frequent keys, and stops when the costs pass its own U. By
the pigeonhole principle two linked sets stop no earlier than at their first common key, so none is lost whatever counts
as frequent: the counts, taken over all documents in a first pass, only steer cost. If a set's segments cannot pass its U
(a few shingles in one segment), the interval gets twice as many segments, until all sets can.

Verification. Equal sets form one class (128-bit sum hash). Classes that share a key are paired with the least of them (the
center); profiles (parities of shingle counts by part of the hash range, a lower bound of the difference) refute most pairs, the others
are verified exactly on whole sets, components are formed, and only the pairs that still lie in different components are
compared in a second step, cluster by cluster (large ones in blocks): bounds by sizes, profiles and distances to the common
center refute pairs there before they leave the task. A group of copies costs a star, not all its pairs.

Defined results: null, empty or blank text has an empty set, is linked with nothing and is its own component; repeated rows
get one result each; null identifiers are never a component's name unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm._text import LOWER, batches, mix, owner, span_hashes, string_buffers, window_hashes, words
from leafline.llm.components import components
from leafline.session import cut, fresh, scratch, ship

U = np.uint64
SHINGLE = 5
#: Bytes of text that a task works on at a time; bytes of text for each bucket of keys, on average.
SLAB, BUCKET_BYTES = 3 << 20, 12 << 20
#: A key of more classes than this is frequent; so many of the most frequent keys at most are sent to the tasks (they steer cost, not results).
FREQUENT, MOST_FREQUENT = 16, 200_000
#: Share of the hash range (as 1/EIGHTH) for one-deletion segments, exact segments per shingle of the largest set, shingles per one-deletion segment.
EIGHTH, EXACT, WIDE = 8, 1.0, 32
#: Members of a cluster in a block at most, on average; smaller clusters are one block.
BLOCK = 2048
#: Parts of a profile for each shingle, at least (less than twice as many).
PARTS = 4
#: Parts that are counted at a time.
COUNTED = 1 << 19
REGION = U((1 << 32) - (1 << 32) // EIGHTH)


def sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, ascending and distinct within each text; where each text's begin, one more at the end)."""
    data = LOWER[data]
    starts, ends, first = words(data, off)
    h = span_hashes(data, starts, ends, 11)
    n_words = np.diff(first)
    n = len(n_words)
    win = window_hashes(h, SHINGLE)
    size = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, n_words > 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(begin[-1]), np.uint64)
    if len(win):
        doc = owner(first)
        inside = doc[: len(win)] == doc[SHINGLE - 1 :]
        out[np.repeat(n_words >= SHINGLE, size)] = win[inside]
    for k in range(1, SHINGLE):  # the whole sequence is one shingle
        few = np.flatnonzero(n_words == k)
        if len(few):
            out[begin[few]] = window_hashes(h, k, 0x1234567 + k)[first[few]]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][begin[:-1] < len(out)]] = True
    counted = np.concatenate([[0], np.cumsum(keep)])
    del n
    return out[keep], counted[begin]


def spread_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 between places."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[begin[1:]] - total[begin[:-1]]


def classes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 128-bit name for each set, as two uint64."""
    n = np.diff(begin).astype(np.uint64)
    return np.column_stack([mix(spread_sums(mix(h), begin) + n), mix(spread_sums(mix(h ^ U(0xA5A5A5A5DEADBEEF)), begin) ^ (n * U(0x9E3779B97F4A7C15)))])


def names(cls: np.ndarray) -> pa.Array:
    """Classes as 16-byte values."""
    raw = np.ascontiguousarray(cls.astype(">u8"))
    return pa.Array.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(raw)]).cast(pa.binary())


def highest(k: np.ndarray) -> np.ndarray:
    """The largest size in interval k."""
    return 4 * ((1 << (k + 1)) - 1) // 3


def parts(size: np.ndarray):
    """For the lower and the upper part of intervals: (texts, interval of each, most differences with any partner there)."""
    some = np.flatnonzero(size > 0)
    s = size[some]
    k = np.floor(np.log2(s)).astype(np.int64)
    yield some, k, (s + 4 * s // 3) // 7
    up = (k > 0) & (s <= highest(np.maximum(k - 1, 0)))
    yield some[up], k[up] - 1, (s[up] + (1 << k[up]) - 1) // 7


class Keys:
    """The keys of some texts in one part: their units (non-empty segments) in order, with costs and keys."""

    def __init__(self, h: np.ndarray, begin: np.ndarray, texts: np.ndarray, k: np.ndarray, extra: np.ndarray):
        size = begin[texts + 1] - begin[texts]
        at = np.repeat(begin[texts], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.tokens = tok = h[at]
        doc = np.repeat(np.arange(len(texts)), size)
        top = tok >> U(32)
        hi = highest(k).astype(np.float64)
        grow = extra[k]
        m0 = np.minimum(1 << 31, np.maximum(16, np.ceil(EXACT * hi)).astype(np.int64) << grow).astype(np.uint64)
        m1 = np.minimum(1 << 31, np.maximum(2, np.ceil(hi / WIDE)).astype(np.int64) << grow).astype(np.uint64)
        wide = top >= REGION
        seg = np.where(wide, (U(1) << U(40)) + (((top - np.minimum(top, REGION)) * U(EIGHTH) * m1[doc]) >> U(32)), (top * m0[doc]) >> U(32))
        new = np.ones(len(tok), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])
        self.first = np.flatnonzero(new)
        self.end = np.concatenate([self.first[1:], [len(tok)]])
        self.doc, self.wide, seg = doc[self.first], wide[self.first], seg[self.first]
        self.size = self.end - self.first
        self.mixed = mix(tok ^ U(0x51ED270B3A8F0C1D))
        bounds = np.concatenate([self.first, [len(tok)]])
        self.base = mix((seg + U(1)) * U(0x9E3779B97F4A7C15) + k[self.doc].astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        self.sum = spread_sums(self.mixed, bounds)
        self.key = mix(self.sum ^ self.base) + self.size.astype(np.uint64)
        self.cost = np.where(self.wide & (self.size > 1), 2, 1)
        self.n = len(texts)

    def chosen(self, most: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units until the costs pass most, texts whose units cannot)."""
        tier = np.where(self.wide, 1, 0)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, self.key), len(frequent) - 1)
            tier[~self.wide & (frequent[at] == self.key)] = 2
        take, spent = np.zeros(len(self.doc), bool), np.zeros(self.n, np.int64)
        for t in range(3):
            unit = np.flatnonzero(tier == t)
            if not len(unit):
                continue
            d, c = self.doc[unit], self.cost[unit]
            run = np.cumsum(c)
            lead = np.ones(len(unit), bool)
            lead[1:] = d[1:] != d[:-1]
            base = (run - c)[lead][np.cumsum(lead) - 1]
            take[unit[run - c - base + spent[d] <= most[d]]] = True
            spent += np.bincount(d, c, self.n).astype(np.int64)
        return np.flatnonzero(take), np.flatnonzero(spent <= most)

    def all_keys(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, texts) of units: of their subsets and, in one-deletion segments, of those with one shingle left out."""
        two = units[self.wide[units] & (self.size[units] > 1)]
        each = self.size[two]
        of = np.repeat(two, each)
        at = np.repeat(self.first[two], each) + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        less = mix((self.sum[of] - self.mixed[at]) ^ self.base[of]) + (self.size[of] - 1).astype(np.uint64)
        return np.concatenate([self.key[units], less]), np.concatenate([self.doc[units], self.doc[of]])


def profiles(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """A bit for each part of the hash range (64 or more of them, PARTS to a shingle at least), whether an odd number of a set's shingles fall into it.

    Two sets' profiles differ in no more bits than the sets in shingles, so they refute most pairs without the sets. Parts
    go by the low bits, so a profile folds to half its length by the exclusive or of its halves.
    """
    size = np.diff(begin)
    bits = np.maximum(6, np.ceil(np.log2(np.maximum(size, 1) * PARTS)).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    out: list[bytes] = []
    x = 0
    while x < len(size):  # so many texts at a time that the counts stay small
        y = max(x + 1, int(np.searchsorted(base, base[x] + COUNTED, "right")) - 1)
        doc = np.repeat(np.arange(x, y), size[x:y])
        place = (h[begin[x] : begin[y]] & ((U(1) << bits[doc].astype(np.uint64)) - U(1))).astype(np.int64) + (base[doc] - base[x])
        odd = (np.bincount(place, minlength=int(base[y] - base[x])) & 1).astype(bool)
        raw, ends = np.packbits(odd, bitorder="little").tobytes(), (base[x : y + 1] - base[x]) >> 3
        out += [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        x = y
    return out


def folded(x: np.ndarray, words_: int) -> np.ndarray:
    """Profiles (rows of uint64) at a shorter length."""
    return x if x.shape[-1] == words_ else np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, words_), axis=-2)


def gap(pa_: bytes, pb: bytes) -> int:
    """In how many bits two profiles differ: a lower bound of the sets' distance."""
    x, y = np.frombuffer(pa_, np.uint64), np.frombuffer(pb, np.uint64)
    short = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, short) ^ folded(y, short)).sum())


def distinct_texts(cls: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One text of each class with a set."""
    pick = np.unique(np.ascontiguousarray(cls).view("V16").reshape(-1), return_index=True)[1] if len(cls) else np.zeros(0, np.int64)
    return np.sort(pick[size[pick] > 0])


def _first_pass(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of three kinds: a text (key, class, size); a key that several classes of a slab share (frequent, n); an interval that needs more segments (interval, n doublings)."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    arrow_key = pa.int64() if kind == "bigint" else None

    def run(it):
        none = np.zeros(0, np.uint64)
        for whole in it:
            for batch in batches(whole, "text", SLAB):
                h, begin = sets(*string_buffers(batch.column(1)))
                cls, size = classes(h, begin), np.diff(begin)
                some = distinct_texts(cls, size)
                need, often = {}, []
                for texts, k, most in parts(size):
                    mine = np.isin(texts, some)
                    texts, k, most = texts[mine], k[mine], most[mine]
                    if not len(texts):
                        continue
                    units = Keys(h, begin, texts, k, np.zeros(64, np.int64))
                    take, short = units.chosen(most, none)
                    often.append(units.key[take[~units.wide[take]]])
                    grow = 0
                    while len(short):
                        grow += 1
                        for i in np.unique(k[short]).tolist():
                            need[i] = grow
                        texts, k, most = texts[short], k[short], most[short]
                        short = Keys(h, begin, texts, k, np.full(64, grow, np.int64)).chosen(most, none)[1]
                        if grow > 40:
                            raise ValueError("a set's shingles cannot be told apart")
                value, n = np.unique(np.concatenate(often) if often else none, return_counts=True)
                value, n = value[n > 1].view(np.int64), n[n > 1]
                rows, f, g = batch.num_rows, len(value), len(need)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0), pa.nulls(f + g, batch.column(0).type if arrow_key is None else arrow_key)]),
                        pa.concat_arrays([names(cls), pa.nulls(f + g, pa.binary())]),
                        pa.array([*size.tolist(), *n.tolist(), *need.values()], pa.int64()),
                        pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(value), pa.nulls(g, pa.int64())]),
                        pa.array([*[None] * (rows + f), *need], pa.int32()),
                        pa.concat_arrays([pa.array(profiles(h, begin), pa.binary()), pa.nulls(f + g, pa.binary())]),
                    ],
                    ["key", "cls", "n", "frequent", "interval", "profile"],
                )

    return cut(slim.mapInArrow(run, f"key {kind}, cls binary, n long, frequent long, interval int, profile binary"), "shingle-classes")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, all first bytes first: differences of sorted hashes then compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _pack(keys: np.ndarray, of: np.ndarray, cls: np.ndarray, size: np.ndarray) -> tuple[bytes, int]:
    """Entries (key, class) of one bucket."""
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    used, local = np.unique(of, return_inverse=True)
    raw = b"".join([np.array([len(keys), len(used)], "<i8").tobytes(), _planes(np.diff(keys, prepend=U(0))), _planes(local.astype("<u4")), cls[used].astype(">u8").tobytes(), size[used].astype("<i8").tobytes()])
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(blob: bytes, size: int):
    raw = pa.decompress(blob, size, codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    a, b, c = 16 + 8 * n, 16 + 12 * n, 16 + 12 * n + 16 * m
    return np.cumsum(_from_planes(raw[16:a], "<u8", n), dtype=np.uint64), _from_planes(raw[a:b], "<u4", n), np.frombuffer(raw, "V16", m, b), np.frombuffer(raw, "<i8", m, c)


def _second_pass(docs: DataFrame, text: str, frequent: np.ndarray, extra: np.ndarray, buckets: int) -> DataFrame:
    """bucket, size, blob: the entries of each slab for each bucket of keys."""

    def run(it):
        for whole in it:
            for batch in batches(whole, "text", SLAB):
                h, begin = sets(*string_buffers(batch.column(0)))
                cls, size = classes(h, begin), np.diff(begin)
                some = distinct_texts(cls, size)
                keys, of = [], []
                for texts, k, most in parts(size):
                    mine = np.isin(texts, some)
                    texts, k, most = texts[mine], k[mine], most[mine]
                    if len(texts):
                        units = Keys(h, begin, texts, k, extra)
                        take, short = units.chosen(most, frequent)
                        if len(short):
                            raise ValueError("an interval has too few segments")
                        got, doc = units.all_keys(take)
                        keys.append(got)
                        of.append(texts[doc])
                if not keys:
                    continue
                keys, of = np.concatenate(keys), np.concatenate(of)
                bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
                order = np.argsort(bucket.astype(np.int32), kind="stable")
                bucket, keys, of = bucket[order], keys[order], of[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows = [(int(bucket[a]), *_pack(keys[a:b], of[a:b], cls, size)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["bucket", "blob", "size"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, blob binary, size long")


def _stars(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: for every key of several classes, the least of them (the center) with each other class; distinct. Names are hashes, and all buckets agree on their order, so the keys of one group of near copies share few centers."""
    got = [_unpack(*x) for x in held]
    keys = np.concatenate([g[0] for g in got])
    # keys of one entry go first; only the rest gets class numbers
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    del order, same
    keys = keys[twice]
    edge = np.cumsum([0] + [len(g[0]) for g in got])
    named = np.concatenate([g[2][g[1][twice[a:b]]] for g, a, b in zip(got, edge[:-1], edge[1:], strict=True)])
    del got, twice
    table, gid = np.unique(named.view(">u8").reshape(-1, 2).copy().view([("a", ">u8"), ("b", ">u8")]).reshape(-1), return_inverse=True)
    order = np.lexsort((gid, keys))
    keys, gid = keys[order], gid[order]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (gid[1:] != gid[:-1])
    keys, gid = keys[keep], gid[keep]
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    center = gid[lead][np.cumsum(lead) - 1]
    pair = np.unique(center[~lead] * np.int64(len(table)) + gid[~lead])
    raw = table.view("V16")
    return raw[pair // len(table)], raw[pair % len(table)]


def _bytes16(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _met(sent: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of centers and other classes, from the buckets."""

    def run(it):
        held, now = [], None
        for batch in it:
            for b, blob, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != now and held:
                    yield pa.RecordBatch.from_arrays([_bytes16(x) for x in _stars(held)], ["a", "b"])
                    held = []
                now = b
                held.append((blob, n))
        if held:
            yield pa.RecordBatch.from_arrays([_bytes16(x) for x in _stars(held)], ["a", "b"])

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a binary, b binary").distinct()


def _set_table(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """cls, shingles (uint64 bytes) of the wanted classes, from one whole text each. wanted: cls, key."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    texts = slim.join(wanted.select(F.col("key").alias("_want")).distinct(), F.col("_key").eqNullSafe(F.col("_want")), "left_semi").select("text")

    def run(it):
        for whole in it:
            for batch in batches(whole, "text", SLAB):
                h, begin = sets(*string_buffers(batch.column(0)))
                raw = h.tobytes()
                yield pa.record_batch([names(classes(h, begin)), pa.array([raw[8 * a : 8 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())], ["cls", "shingles"])

    made = texts.mapInArrow(run, "cls binary, shingles binary")
    return cut(made.join(wanted.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _distances(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Adds d, the number of shingles in one set only, counted on whole sets."""
    ta, tb = table.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), table.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "sa", "sb")

    def run(it):
        for batch in it:
            out = []
            for ra, rb in zip(batch.column(2), batch.column(3), strict=True):
                z = np.concatenate([np.frombuffer(ra.as_buffer(), np.uint64), np.frombuffer(rb.as_buffer(), np.uint64)])
                z.sort(kind="stable")
                out.append(len(z) - 2 * int((z[1:] == z[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["a", "b", "d"])

    return cut(both.mapInArrow(run, "a binary, b binary, d long"), "shingle-distances")


def _bounded(pairs: DataFrame, faces: DataFrame) -> DataFrame:
    """Adds na, nb and low, a lower bound of the distance by sizes and profiles. faces: cls, n, profile."""
    fa, fb = faces.toDF("a", "na", "pa"), faces.toDF("b", "nb", "pb")
    both = pairs.select("a", "b").join(fb, "b").join(fa, "a").select("a", "b", "na", "nb", "pa", "pb")

    def run(it):
        for batch in it:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            low = [max(abs(x - y), gap(p, q)) for p, q, x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(low, pa.int64())], ["a", "b", "na", "nb", "low"])

    return cut(both.mapInArrow(run, "a binary, b binary, na long, nb long, low long"), "shingle-bounds")


def _compared(docs: DataFrame, key: str, text: str, pairs: DataFrame, faces: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, nb, low, d of pairs: bounds first, then the distance on whole sets, read only for classes that are left (d is null where the bound refutes the pair)."""
    bounds = _bounded(pairs, faces)
    near = bounds.where("7 * low <= na + nb")
    if near.isEmpty():
        return bounds.withColumn("d", F.lit(None).cast("long"))
    wanted = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    found = _distances(near, _set_table(docs, key, text, reps.join(wanted, "cls", "left_semi")))
    return bounds.join(found, ["a", "b"], "left")


def _cross(stars: DataFrame, labels: DataFrame, faces: DataFrame) -> DataFrame:
    """Pairs (a, b) in one cluster (classes with one center) but different components that no bound refutes.

    A cluster is one block, or it is dealt in blocks: those of its most frequent component against the others, and the
    others among themselves. Inside a block, or a pair of them, sizes, profiles and the distances to the center (the
    symmetric difference is a metric) refute pairs; only the rest leaves the task.
    """
    member = stars.select("a", "b", F.col("nb").alias("n"), F.coalesce("d", "low").alias("lo"), F.coalesce("d", F.col("na") + F.col("nb")).alias("hi"))
    placed = member.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    each = placed.groupBy("a", "label").agg(F.count("*").alias("k"))
    whole = each.groupBy("a").agg(F.sum("k").alias("t"), F.max(F.struct("k", "label")).alias("m")).select("a", "t", F.col("m.label").alias("major"), F.ceil(F.col("m.k") / BLOCK).alias("n_major"), (F.col("t") - F.col("m.k")).alias("rest"))
    mixed = whole.where("rest > 0").withColumn("n_rest", F.ceil(F.col("rest") / BLOCK)).drop("rest")
    # a pair of several clusters is compared in that of the least center
    centers = stars.groupBy("b").agg(F.array_sort(F.collect_list("a")).alias("centers"))
    rows = placed.join(mixed, "a").join(centers, "b").join(faces.select(F.col("cls").alias("b"), "profile"), "b").withColumn("is_major", F.col("label") == F.col("major"))
    own = F.pmod(F.xxhash64("b"), F.when(F.col("is_major"), F.col("n_major")).otherwise(F.col("n_rest")))
    rows = rows.withColumn("own", own)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    others = F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1)
    majors = F.sequence(F.lit(0).cast("long"), F.col("n_major") - 1)
    among = F.transform(others, lambda j: F.when(j >= F.col("own"), place(1, F.col("own"), j, 0)).otherwise(place(1, j, F.col("own"), 1)))
    dealt_out = F.when(F.col("is_major"), F.transform(others, lambda j: place(0, F.col("own"), j, 1))).otherwise(F.concat(F.transform(majors, lambda i: place(0, i, F.col("own"), 0)), among))
    places = F.when(F.col("t") <= BLOCK, F.array(place(2, F.lit(0), F.lit(0), 0))).otherwise(dealt_out)
    dealt = rows.select("a", "b", "n", "lo", "hi", "label", "is_major", "profile", "centers", F.explode(places).alias("p")).select("a", "p.kind", "p.i", "p.j", "p.side", "b", "n", "lo", "hi", "label", "is_major", "profile", "centers")

    def run(it):
        """Rows come sorted by block; one block, or pair of blocks, is held at a time."""
        held, now = [], None
        for batch in it:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[x] != now and held:
                    yield from _unrefuted(held, now)
                    held = []
                now = keys[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from _unrefuted(held, now)

    by = ["a", "kind", "i", "j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary")


def _unrefuted(held: list, block: tuple):
    """Of one block: rows (a, kind, i, j, side, b, n, lo, hi, label, is_major, profile, centers) to pairs of their classes that no bound refutes and whose least common center is the block's. Everything left is compared with everything right."""
    part = pa.Table.from_batches(held)
    side, n, lo, hi = (part.column(c).to_numpy() for c in ("side", "n", "lo", "hi"))
    major = part.column("is_major").to_numpy()
    _, kind, i, j = block
    one = kind == 2 or (kind == 1 and i == j)
    left = np.flatnonzero(~major) if one else np.flatnonzero(side == 0)
    right = np.arange(len(side)) if one else np.flatnonzero(side == 1)
    label = np.unique(np.array(part.column("label").to_pylist(), "S16"), return_inverse=True)[1]
    raw = part.column("profile").to_pylist()
    size = np.array([len(x) for x in raw])
    row, matrix = np.zeros(len(raw), np.int64), {}
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        row[at] = np.arange(len(at))
        matrix[w] = np.frombuffer(b"".join([raw[k] for k in at.tolist()]), np.uint64).reshape(len(at), w // 8)
    centers, center, out = part.column("centers"), block[0], [[], []]
    known: dict[int, set] = {}

    def of(k: int) -> set:
        if k not in known:
            known[k] = set(centers[k].as_py())
        return known[k]

    for x in left.tolist():
        y = right[major[right] | (right > x)] if one else right
        most = (n[x] + n[y]) // 7
        ok = (label[y] != label[x]) & (abs(n[x] - n[y]) <= most) & (lo[x] - hi[y] <= most) & (lo[y] - hi[x] <= most)
        y, most = y[ok], most[ok]
        if not len(y):
            continue
        near = np.ones(len(y), bool)
        mine = matrix[size[x]][row[x]]
        for w in np.unique(size[y]).tolist():
            at = np.flatnonzero(size[y] == w)
            short = min(w, int(size[x])) // 8
            near[at] = np.bitwise_count(folded(matrix[w][row[y[at]]], short) ^ folded(mine, short)).sum(1, dtype=np.int64) <= most[at]
        for z in y[near].tolist():
            if min(of(x) & of(z)) == center:
                out[0].append(x)
                out[1].append(z)
    if out[0]:
        b = part.column("b").to_pylist()
        pairs = [sorted((b[x], b[z])) for x, z in zip(*out, strict=True)]
        yield pa.record_batch([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, cls, n, component for every row; links between classes as a, b as far as they were needed to form components). Both are written to the shared folder, all tables between are removed."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return _joined(docs, key, text, keep)


def _joined(docs: DataFrame, key: str, text: str, keep) -> tuple[DataFrame, DataFrame]:
    first = _first_pass(docs, key, text)
    rows = first.where("cls is not null").select("key", "cls", "n")
    extra = np.zeros(64, np.int64)
    for r in first.where("interval is not null").groupBy("interval").agg(F.max("n").alias("n")).collect():  # 64 rows at most
        extra[r["interval"]] = r["n"]
    often = first.where("frequent is not null").groupBy("frequent").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "frequent").limit(MOST_FREQUENT)
    frequent = np.array([r[0] for r in often.select("frequent").collect()], np.int64).view(np.uint64)
    frequent.sort()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    met = cut(_met(_second_pass(docs, text, frequent, extra, max(12, -(-total // BUCKET_BYTES)))), "shingle-stars")
    reps = rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"))
    faces = first.where("n > 0 and profile is not null").dropDuplicates(["cls"]).select("cls", "n", "profile")
    stars = cut(_compared(docs, key, text, met, faces, reps), "shingle-stars-compared")
    links = stars.where("7 * d <= na + nb").select("a", "b")
    found = components(links, "star")
    # classes with one center, in different components, not compared yet
    seen = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(_cross(stars, found, faces).join(seen, ["a", "b"], "left_anti"), "shingle-cross")
    if not rest.isEmpty():
        more = _compared(docs, key, text, rest, faces, reps).where("7 * d <= na + nb").select("a", "b")
        more = cut(more, "shingle-more-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links, "all")
    named = rows.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.where("n > 0").groupBy("label").agg(F.min("key").alias("component"))
    out = named.join(least, "label", "left").select("key", "cls", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
    return keep(out, "shingle-components"), keep(links, "shingle-links")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document names its component: one of each group of near copies, with all columns, whatever their names. Documents without words all stay; of rows that repeat identifier and text, one stays."""
    out, _ = joined(docs, key, text)
    own, same = fresh(docs.columns, "stay", "same")
    stay = out.where(F.col("key").eqNullSafe(F.col("component"))).select(F.col("key").alias(own)).distinct()
    kept = docs.join(stay, F.col(key).eqNullSafe(F.col(own)), "left_semi")
    return kept.withColumn(same, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([key, same]).select(*docs.columns)
