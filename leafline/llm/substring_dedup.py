"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one text. Its minimiser is the least hash among its SEED-word grams (the leftmost
on ties). Consecutive windows that share one minimiser occurrence travel as one packed string, a super-k-mer, to the
bucket of the minimiser's hash, so a word travels about three times instead of WINDOW times, and equal windows always meet.
In a bucket the windows are sorted by hash; members of a run are compared byte by byte with its first, so counts are exact.

Skew: equal super-k-mers inside one slab of a task collapse before the shuffle (all but the earliest are known repeats), so
a group of copies of any size sends one string for each slab; a minimiser that stays frequent nevertheless, because its
neighbours differ, is dealt by window instead (its hash comes from an exact count over all data of those above a quarter
of a bucket's even share, and above one in MOST_HOT, so the list is bounded whatever the input).

Defined results: null text has no words; texts shorter than a window lose nothing; identifiers are integers (else a
TypeError), null ones count as the smallest;
rows that repeat identifier and text are one document and get one result each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leafline.llm._text import SPACE, batches, mix, owner, same_spans, span_hashes, string_buffers, window_hashes, words
from leafline.session import cut, ship

U = np.uint64
WINDOW, SEED = 20, 3
#: Bytes of text for each bucket, on average; bytes of text that a task packs at a time.
BUCKET_BYTES, SLAB = 3 << 20, 5 << 20
#: Hot minimisers at most: one holds more than this share of all super-k-mers, so at 100 TB a bucket has up to 300 MB besides its own.
MOST_HOT = 1_000_000
LEAST = -(1 << 63)


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts with one separator after each: (bytes, starts, ends, first word of each text)."""
    starts, ends, first = words(data, off)
    size = ends - starts
    stop = np.cumsum(size + 1)
    new_starts = stop - size - 1
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    solid = ~SPACE[data]
    place = np.ones(len(out), bool)
    place[stop - 1] = False
    out[place] = data[solid]
    return out, new_starts, stop - 1, first


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours, by doubling."""
    out, done = x, 1
    while done < k:
        step = min(done, k - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def super_kmers(h: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser hash) of runs of windows that share a minimiser occurrence."""
    none = np.zeros(0, np.int64)
    n = len(h) - window + 1
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    doc = owner(first)
    grams = window_hashes(h, seed)
    span = window - seed + 1
    # place of the gram in the low bits, modulo a power of two above the window: leftmost wins, occurrences differ
    bits = U((2 * window).bit_length())
    mask = (U(1) << bits) - U(1)
    keyed = (grams & ~mask) | (np.arange(len(grams), dtype=np.uint64) & mask)
    least = sliding_least(keyed, span)[:n]
    inside = doc[:n] == doc[window - 1 :]
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    live = np.flatnonzero(inside)
    count = np.diff(np.concatenate([np.searchsorted(live, at), [len(live)]]))
    return at, count, mix(least[at] & ~mask)


def repeats(data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans in ascending order of occurrence: (index of the first equal span, whether an earlier place has an equal span). rank: places; equal places are one occurrence."""
    n = len(start)
    order = np.argsort(hashes, kind="stable")
    sorted_h = hashes[order]
    new = np.ones(n, bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    lead = np.empty(n, np.int64)
    lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(lead != np.arange(n))
    same = (size[other] == size[lead[other]]) & same_spans(data, start[other], start[lead[other]], np.minimum(size[other], size[lead[other]]))
    if not same.all():  # different spans of one hash: tell them apart by their bytes
        clash = np.isin(hashes, hashes[other[~same]])
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(clash).tolist():
            lead[i] = known.setdefault(data[start[i] : start[i] + size[i]].tobytes(), i)
    return lead, rank[lead] < rank


def pack(data: np.ndarray, start: np.ndarray, stop: np.ndarray, docs: np.ndarray, at: np.ndarray) -> bytes:
    """A blob: count, text numbers' identifiers (two int64 each), first words, sizes, then the strings."""
    view = data.tobytes() if len(start) > 64 else None
    body = b"".join([view[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]) if view else b"".join([data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    head = np.int64(len(start)).tobytes() + np.ascontiguousarray(docs).tobytes() + at.astype("<i8").tobytes() + (stop - start).astype("<i8").tobytes()
    return pa.Codec("zstd", compression_level=4).compress(head + body, asbytes=True)


def unpack(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    docs = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    at = np.frombuffer(raw, np.int64, n, 8 + 16 * n)
    sizes = np.frombuffer(raw, np.int64, n, 8 + 24 * n)
    return docs, at, sizes, np.frombuffer(raw, np.uint8, offset=8 + 32 * n)


def _flag_rows(docs: np.ndarray, at: np.ndarray, count: np.ndarray) -> dict:
    """One row for each document: its flagged runs of windows as int64 pairs (first word, number)."""
    order = np.lexsort((at, docs[:, 1], docs[:, 0]))
    docs, pairs = docs[order], np.column_stack([at[order], count[order]]).astype("<i8")
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]).any(1)
    cuts = np.flatnonzero(new)
    ends = np.concatenate([cuts[1:], [len(docs)]])
    return {"doc": docs[cuts, 0], "version": docs[cuts, 1], "runs": [pairs[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]}


OUT = "bucket int, size long, blob binary, doc long, version long, runs binary"


def _emit(bucket=(), size=(), blob=(), doc=(), version=(), runs=()):
    n, m = len(bucket), len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*bucket, *[None] * m], pa.int32()),
            pa.array([*size, *[None] * m], pa.int64()),
            pa.array([*blob, *[None] * m], pa.binary()),
            pa.array([*[None] * n, *np.asarray(doc).tolist()], pa.int64()),
            pa.array([*[None] * n, *np.asarray(version).tolist()], pa.int64()),
            pa.array([*[None] * n, *runs], pa.binary()),
        ],
        ["bucket", "size", "blob", "doc", "version", "runs"],
    )


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])


def hot_minimisers(slim: DataFrame, window: int, seed: int, share: float) -> list[int]:
    """Minimiser hashes with more than the given share of all super-k-mers (at most 1 / share of them).

    Each slab reports those above the share there; one that is above it overall is above it in some slab.
    """

    def run(it):
        for whole in it:
            for batch in batches(whole, "text", SLAB):
                data, off = string_buffers(batch.column(2))
                data, starts, ends, first = normalised(data, off)
                m = super_kmers(span_hashes(data, starts, ends), first, window, seed)[2]
                value, n = np.unique(m, return_counts=True)
                often = n > max(1, share * len(m))
                yield pa.record_batch([pa.array([None, *value[often].view(np.int64).tolist()], pa.int64()), pa.array([len(m), *n[often].tolist()], pa.int64())], ["m", "n"])

    found = cut(slim.mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")), "hot-minimisers")
    total = found.where("m is null").first()
    if not total:
        return []
    return [r["m"] for r in found.where(F.col("m").isNotNull() & (F.col("n") > share * total["n"])).collect()]


def flagged(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents as doc, version, text; their runs of windows that come earlier elsewhere)."""
    ship(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"identifiers must be integers, not {docs.schema[key].dataType.simpleString()}")
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.col(text).alias("text"))
    if buckets is None:
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = max(12, -(-total // BUCKET_BYTES))
    hot = np.array(sorted(hot_minimisers(slim, window, seed, max(1 / (4 * buckets), 1 / MOST_HOT))), np.int64).view(np.uint64)

    def packed(it):
        for whole in it:
            for batch in batches(whole, "text", SLAB):
                keys = _keys(batch)
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                batch, keys = batch.take(pa.array(order)), keys[order]
                data, off = string_buffers(batch.column(2))
                data, starts, ends, first = normalised(data, off)
                h = span_hashes(data, starts, ends)
                at, count, least = super_kmers(h, first, window, seed)
                bucket = least
                if len(hot) and len(at):  # frequent minimisers travel by window
                    often = np.isin(least, hot)
                    one = np.repeat(at[often], count[often])
                    one += np.arange(len(one)) - np.repeat(np.cumsum(count[often]) - count[often], count[often])
                    at = np.concatenate([at[~often], one])
                    own = window_hashes(h, window, 0x2545F4914F6CDD1D)[one] if len(one) else np.zeros(0, np.uint64)
                    bucket = np.concatenate([least[~often], own])
                    count = np.concatenate([count[~often], np.ones(len(one), np.int64)])
                    again = np.argsort(at, kind="stable")
                    at, count, bucket = at[again], count[again], bucket[again]
                if not len(at):
                    continue
                begin, stop = starts[at], ends[at + count + window - 2]
                doc = np.searchsorted(first, at, "right") - 1
                in_doc = at - first[doc]
                # equal super-k-mers: one (the earliest) travels
                prefix = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * U(0x9E3779B97F4A7C15) ^ (h >> U(23)), out=prefix[1:])
                whole_h = mix(prefix[at + count + window - 1] - prefix[at] + mix(h[at]) * U(3) + mix(h[at + count + window - 2]) * U(5) + count.astype(np.uint64))
                # one place: same identifier and first word
                place = np.zeros(len(at), np.int64)
                place[1:] = np.cumsum((keys[doc[1:], 0] != keys[doc[:-1], 0]) | (in_doc[1:] != in_doc[:-1]))
                if (np.diff(keys[:, 0]) == 0).any():
                    place = np.unique(np.column_stack([keys[doc, 0], in_doc]), axis=0, return_inverse=True)[1].reshape(-1)
                    by = np.argsort(place, kind="stable")
                    at, count, bucket, begin, stop, doc, in_doc, whole_h, place = (x[by] for x in (at, count, bucket, begin, stop, doc, in_doc, whole_h, place))
                lead, later = repeats(data, begin, stop - begin, whole_h, place)
                drop = later | ((lead != np.arange(len(lead))) & (keys[doc] == keys[doc[lead]]).all(1))
                if later.any():
                    yield _emit(**_flag_rows(keys[doc[later]], in_doc[later], count[later]))
                go = np.flatnonzero(~drop)
                b = (mix(bucket[go]) % U(buckets)).astype(np.int64)
                by = np.argsort(b, kind="stable")
                go, b = go[by], b[by]
                cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                rows = {"bucket": b[cuts].tolist(), "blob": [], "size": []}
                for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)], strict=True):
                    g = go[x:y]
                    rows["size"].append(int(8 + 32 * len(g) + (stop[g] - begin[g]).sum()))
                    rows["blob"].append(pack(data, begin[g], stop[g], keys[doc[g]], in_doc[g]))
                yield _emit(**rows)

    def counted(it):
        """Rows come sorted by bucket; one bucket is held at a time."""
        held, now = [], None
        for batch in it:
            for b, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != now and held:
                    yield from _count(held, window)
                    held = []
                now = b
                held.append((blob, n))
        if held:
            yield from _count(held, window)

    sent = slim.mapInArrow(packed, OUT)
    # both kinds of rows leave the one pass over the texts together
    spread = sent.repartition(F.coalesce("bucket", F.hash("doc", "version"))).sortWithinPartitions("bucket")

    def reduce(it):
        def blobs():
            for batch in it:
                mask = pa.compute.is_valid(batch.column(0))
                local = batch.filter(pa.compute.invert(mask))
                if local.num_rows:
                    passed.append(local.select(["doc", "version", "runs"]))
                got = batch.filter(mask)
                if got.num_rows:
                    yield got.select(["bucket", "size", "blob"])

        import pyarrow.compute  # noqa: F401

        passed: list[pa.RecordBatch] = []
        for out in counted(blobs()):
            while passed:
                yield passed.pop()
            yield out
        yield from passed

    return slim, spread.mapInArrow(reduce, "doc long, version long, runs binary")


def _count(held: list, window: int):
    """Sorts the windows of one bucket and flags those that come earlier."""
    docs, at, sizes, body = (np.concatenate(x) for x in zip(*[unpack(*h) for h in held], strict=True))
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((docs[:, 1], at, docs[:, 0]))
    # super-k-mers in ascending place; the strings stay where they are
    off = np.concatenate([begin, [len(body)]])
    starts, ends, first = words(body, off)
    h = span_hashes(body, starts, ends)
    n_win = np.diff(first) - window + 1
    n_win, lead_word, docs, at = n_win[order], first[:-1][order], docs[order], at[order]
    owner_of = np.repeat(np.arange(len(n_win)), n_win)
    step = np.arange(len(owner_of)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    word = lead_word[owner_of] + step
    key, place = docs[owner_of], at[owner_of] + step
    win = window_hashes(h, window)[word]
    new = np.ones(len(word), bool)
    if not ((key[1:, 0] > key[:-1, 0]) | ((key[1:, 0] == key[:-1, 0]) & (place[1:] >= place[:-1]))).all():
        by = np.lexsort((place, key[:, 0]))
        word, key, place, win = word[by], key[by], place[by], win[by]
    new[1:] = (key[1:, 0] != key[:-1, 0]) | (place[1:] != place[:-1])
    begin, stop = starts[word], ends[word + window - 1]
    _, later = repeats(body, begin, stop - begin, win, np.cumsum(new))
    if later.any():
        rows = _flag_rows(key[later], place[later], np.ones(int(later.sum()), np.int64))
        yield pa.record_batch([pa.array(rows["doc"], pa.int64()), pa.array(rows["version"], pa.int64()), pa.array(rows["runs"], pa.binary())], ["doc", "version", "runs"])


def removed(n_words: int, runs: bytes, window: int) -> np.ndarray:
    """Which of a text's words lie in a flagged window."""
    edge = np.zeros(n_words + 1, np.int64)
    pairs = np.frombuffer(runs, "<i8").reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(n_words, pairs[:, 0] + pairs[:, 1] + window - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(docs, key, text, window, seed, buckets):
    slim, flags = flagged(docs, key, text, window, seed, buckets)
    runs = flags.groupBy("doc", "version").agg(F.collect_list("runs").alias("runs"))
    return slim.join(runs, ["doc", "version"], "left")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row."""

    def run(it):
        for whole in it:
            for batch in batches(whole, "text"):
                cols = [[], [], []]
                for kept, n in _kept(batch, window):
                    for c, x in zip(cols, (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                        c.append(x)
                yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc", "n_words", "n_removed", "kept_sha256"])

    out = _joined(docs, key, text, window, seed, buckets).mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.nullif("doc", F.lit(LEAST)).alias(key), "n_words", "n_removed", "kept_sha256")


def stripped(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """key and kept_text: the words that stay, joined by one space."""

    def run(it):
        for whole in it:
            for batch in batches(whole, "text"):
                yield pa.record_batch([batch.column(0), pa.array([b" ".join(kept).decode() for kept, _ in _kept(batch, window)], pa.string())], ["doc", "kept_text"])

    out = _joined(docs, key, text, window, seed, buckets).mapInArrow(run, "doc long, kept_text string")
    return out.select(F.nullif("doc", F.lit(LEAST)).alias(key), "kept_text")


def _kept(batch: pa.RecordBatch, window: int):
    at = batch.schema.get_field_index("text")
    runs = batch.column(batch.schema.get_field_index("runs")).to_pylist()
    for t, r in zip(batch.column(at).to_pylist(), runs, strict=True):
        w = (t or "").encode().split()
        if r:
            keep = ~removed(len(w), b"".join(r), window)
            yield [x for x, k in zip(w, keep.tolist(), strict=True) if k], len(w)
        else:
            yield w, len(w)
