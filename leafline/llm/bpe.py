"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each pre-token starts as single bytes. The leaves of the tree hold, for each live symbol, the rank of the pair that it
forms with its right neighbour (infinity where the pair has no merge); the root yields the leftmost lowest rank, so one
merge costs a few point updates of logarithmic depth, and a pre-token of n bytes O(n log n) whatever its shape. Pre-tokens
repeat, so each Python worker keeps a bounded cache of encoded ones.

Defined results: a null or empty text has no tokens; special-token strings in a text become their ids, as the library's
defaults have it; decoding joins the tokens' bytes and replaces invalid UTF-8. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leafline.llm._text import batches
from leafline.session import ship

#: The public byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
#: Pre-tokens kept per worker, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 16
#: Texts beyond this many characters are pre-tokenised piecewise.
LONG_TEXT = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankTree:
    """Minimum over leaves of rank * 2**shift + position: the root is the leftmost lowest rank."""

    __slots__ = ("half", "shift", "tree")

    def __init__(self, ranks: list[int]):
        n = max(1, len(ranks))
        half = 1 << (n - 1).bit_length()
        self.half, self.shift = half, half.bit_length()
        tree = [NONE] * (2 * half)
        for i, r in enumerate(ranks):
            if r < NONE:
                tree[half + i] = (r << self.shift) | i
        for i in range(half - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def put(self, i: int, rank: int) -> None:
        tree = self.tree
        key = (rank << self.shift) | i if rank < NONE else NONE
        i += self.half
        if tree[i] == key:
            return
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            if b < a:
                a = b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1

    def best(self) -> int:
        """Position of the leftmost lowest rank, or -1."""
        key = self.tree[1]
        return -1 if key >= NONE else key & ((1 << self.shift) - 1)


class Encoder(dict):
    """A byte-level BPE vocabulary; as a dict, the bounded cache from pre-token to its ids (little-endian uint32 bytes)."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        raw = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items() if all(c in alphabet for c in token)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw |= {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.first = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[(vocab[a], vocab[b])] = (rank, vocab[a + b])
        order = sorted((a * len(self.bytes_of) + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.keys, self.rank_of, self.id_of = (np.array(x, np.int64) for x in zip(*order, strict=True))
        self.findall, self.finditer = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def merged(self, ids: list[int]) -> list[int]:
        """Applies merges until no pair has one."""
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        tree = RankTree([merges.get(p, (NONE,))[0] for p in itertools.pairwise(ids)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.best()) >= 0:
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NONE)
            if k < n:
                before[k] = i
                tree.put(i, merges.get((ids[i], ids[k]), (NONE,))[0])
            else:
                tree.put(i, NONE)
            if (p := before[i]) >= 0:
                tree.put(p, merges.get((ids[p], ids[i]), (NONE,))[0])
        return [x for x in ids if x >= 0]

    def __missing__(self, piece: str) -> bytes:
        first = self.first
        return np.array(self.merged([first[b] for b in piece.encode()]), "<u4").tobytes()

    def fill(self, pieces: set[str]) -> None:
        """Encodes the short pre-tokens that the cache lacks, those of like length together in one forest of trees."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = [p for p in pieces if p not in self]
        raw = [p.encode() for p in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], [0, 1, 3, 5, 9, 17, 33, 65])
        for lo, hi, half in zip(bounds[1:-1].tolist(), bounds[2:].tolist(), (2, 4, 8, 16, 32, 64), strict=True):
            for at in range(lo, hi, 1 << 16):
                rows = order[at : min(hi, at + (1 << 16))].tolist()
                for r, ids in zip(rows, self.forest([raw[r] for r in rows], size[rows], half), strict=True):
                    self[new[r]] = ids

    def forest(self, raw: list[bytes], size: np.ndarray, half: int) -> list[bytes]:
        """Ids of byte strings of up to half bytes: their segment trees side by side, each round one merge in every tree that has one."""
        n, shift = len(raw), np.uint64(8)
        none = np.uint64(NONE)
        ids = np.zeros((n, half + 1), np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        ids[row, col] = np.array(self.first)[flat]
        after = np.broadcast_to(np.arange(1, half + 2), (n, half + 1)).copy()
        before = np.broadcast_to(np.arange(-1, half), (n, half + 1)).copy()
        tree = np.full((n, 2 * half), none, np.uint64)
        pairs = col < size[row] - 1
        r, c = row[pairs], col[pairs]
        rank = self.ranks(ids[r, c], ids[r, c + 1])[0]
        tree[r, half + c] = np.where(rank < NONE, (rank.astype(np.uint64) << shift) | c.astype(np.uint64), none)
        level = half // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.ones((n, half + 1), bool)
        live[np.arange(half + 1) >= size[:, None]] = False

        def put(r, leaf, key):
            node = leaf + half
            tree[r, node] = key
            while half >> 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def update(r, a, b):
            rank = self.ranks(ids[r, a], ids[r, b])[0]
            put(r, a, np.where(rank < NONE, (rank.astype(np.uint64) << shift) | a.astype(np.uint64), none))

        act = np.flatnonzero(tree[:, 1] < none)
        while len(act):
            i = (tree[act, 1] & np.uint64(255)).astype(np.int64)
            j = after[act, i]
            ids[act, i] = self.ranks(ids[act, i], ids[act, j])[1]
            live[act, j] = False
            k = after[act, j]
            after[act, i] = k
            inner = j < half
            put(act[inner], j[inner], none) if inner.any() else None
            more = k < size[act]
            if more.any():
                before[act[more], k[more]] = i[more]
                update(act[more], i[more], k[more])
            if not more.all():
                put(act[~more], i[~more], none)
            left = before[act, i]
            has = left >= 0
            if has.any():
                update(act[has], left[has], i[has])
            act = act[tree[act, 1] < none]
        counts = live.sum(1)
        out, ends = ids[live].astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NONE where there is no merge) and the ids they merge to."""
        key = a * len(self.bytes_of) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE), self.id_of[at]

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.findall(text)
            return
        found = (m.group() for m in self.finditer(text))
        while part := list(itertools.islice(found, 100_000)):
            yield part

    def plain(self, text: str) -> Iterator[bytes]:
        for part in self.pieces(text):
            if len(text) > LONG_TEXT:
                self.fill({p for p in part if len(p) <= CACHE_CHARS})
            yield b"".join(map(self.__getitem__, part))

    def warm(self, texts: list[str]) -> None:
        """Fills the cache for texts together; those of more than LONG_TEXT fill it themselves, part by part."""
        found: set[str] = set()
        for t in texts:
            if t and len(t) <= LONG_TEXT:
                found.update(self.findall(t))
        self.fill({p for p in found if len(p) <= CACHE_CHARS})

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian uint32 bytes, in parts of bounded size."""
        if self.special and any(s in text for s in self.special):
            for x in self.split(text):
                if x in self.special:
                    yield self.special[x].to_bytes(4, "little")
                elif x:
                    yield from self.plain(x)
        elif text:
            yield from self.plain(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.parts(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids (binary, little-endian uint32) and n_tokens to every row; other columns pass through."""
    return _map(docs, path, text, _ids, "ids binary, n_tokens long")


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded (string) for a column of ids as encode() makes it; null ids give an empty text."""
    return _map(docs, path, ids, _decoded, "decoded string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: encodes each text, decodes the ids, and hashes both part by part."""
    return _map(docs, path, text, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(enc: Encoder, text) -> tuple:
    raw = b"".join(enc.parts(text))
    return raw, len(raw) // 4


def _decoded(enc: Encoder, raw) -> tuple:
    return (enc.decode(np.frombuffer(raw or b"", "<u4").tolist()),)


def _digests(enc: Encoder, text) -> tuple:
    import codecs

    n, ids, out, utf8 = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    for part in enc.parts(text):
        n += len(part) // 4
        ids.update(part)
        joined = b"".join(map(enc.bytes_of.__getitem__, np.frombuffer(part, "<u4").tolist()))
        out.update(utf8.decode(joined).encode())
    out.update(utf8.decode(b"", True).encode())
    return n, ids.hexdigest(), out.hexdigest()


def _map(docs: DataFrame, path: str, column: str, kernel, adds: str) -> DataFrame:
    """Row-wise kernel over one column; the names it adds replace columns of the same name."""
    ship(docs.sparkSession)
    new = [x.strip().split(" ") for x in adds.split(",")]
    names = {n for n, _ in new} - {column}
    keep = [c for c in docs.columns if c not in names]
    slim = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep] + [f"`{n}` {t}" for n, t in new])
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(it):
        enc = encoder(path)
        for batch in it:
            at = batch.schema.get_field_index(column)
            for part in batches(batch, column, 4 << 20):
                values = part.column(at).to_pylist()
                empty = b"" if pa.types.is_binary(part.column(at).type) else ""
                if empty == "":
                    enc.warm(values)
                cols = list(zip(*[kernel(enc, v or empty) for v in values], strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, types[t]) for c, (_, t) in zip(cols, new, strict=True)]], [*part.schema.names, *[n for n, _ in new]])

    return slim.mapInArrow(run, schema)
