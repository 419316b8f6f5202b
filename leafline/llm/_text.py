"""Vectorised text kernels over Arrow string buffers: words, hashes, counts. All work on UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def batches(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Slices of a batch whose texts hold about limit bytes at most (one longer text alone), so that memory stays bounded."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(string_buffers(batch.column(column))[1])
    first, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > first and total + s > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += s
    yield batch.slice(first, n - first)


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    before[:-1] = solid[1:]
    before[-1] = False
    inner = offsets[1:] - 1
    before[inner[inner >= 0]] = False
    ends = np.flatnonzero(solid & ~before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a fresh array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))
    at, left, live = starts, size, None
    if len(size) and size.min() == 0:
        live = np.flatnonzero(size > 0)
        at, left = starts[live], size[live]
    while len(at):
        v = lanes[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ v) * U(0xD6E8FEB86659FD93) + U(0x632BE59BD9B4E019))
        else:
            h[live] = mix((h[live] ^ v) * U(0xD6E8FEB86659FD93) + U(0x632BE59BD9B4E019))
        more = np.flatnonzero(left > 8)
        if len(more) == 0:
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        left = size[live] - done
        mask = np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (np.clip(left, 0, 7).astype(np.uint64) * U(8))) - U(1))
        bad = ((lanes[a[live] + done] ^ lanes[b[live] + done]) & mask) != 0
        out[live[bad]] = False
        live = live[~bad & (left > 8)]
        done += 8
    return out


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each span between offsets; no array of more than a byte for each flag is made."""
    out, some = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(flags[: offsets[-1]], offsets[some], dtype=np.int64)
    return out


def window_hashes(h: np.ndarray, k: int, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """For each i, a hash of h[i:i+k]; callers drop windows that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(seed))
    for j in range(k):
        out *= U(0x9E3779B97F4A7C15)
        out += h[j : j + n]
        if j % 2:
            out ^= out >> U(29)
    return mix(out)


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
