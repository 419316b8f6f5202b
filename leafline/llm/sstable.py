"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: prefix-compressed entries in zstd blocks, then a Bloom filter over the
keys, a sparse index (one entry for each block: last key, place, documents and tokens before it) and a fixed footer.
get() binary-searches the index, then the restart points inside one block.

Writing: documents are range-partitioned by identifier, each task encodes its range in order and rolls shards of bounded
size under names of their own; the manifest, written by Spark's committer, lists the shards of committed tasks only, so a
retried or speculative task leaves at most an unlisted file. Files go through pyarrow's file systems, to the shared
folder named by spark.checkpoint.dir.

Defined results: null or empty text has no ids before the end id; identifiers are integers (else a TypeError); null ones
sort first; rows that repeat an identifier are all kept, in the order of their texts' hashes; an empty table gives no shard.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leafline.llm._text import LOWER, batches, same_spans, span_hashes, string_buffers, words
from leafline.llm.bpe import byte_alphabet
from leafline.session import cut, ship, work_dir

MAGIC = b"LFSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
RESTART = 16
#: Marks that may follow a word: neither letters nor digits, and no part of a contraction or a special token.
MARKS = '!"#$%&()*+,-./:;=?@[]^_`{}~'
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 64 << 20, 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Order-preserving key: null first, then signed integers."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    h1, h2 = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(h1 + i * h2) % bits for i in range(BLOOM_HASHES)]


class Block:
    """A block under construction: prefix-compressed entries, restart points every RESTART entries."""

    def __init__(self):
        self.buf, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.buf))
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.buf += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1

    def bytes(self) -> bytes:
        raw = bytes(self.buf) + b"".join(struct.pack("<I", r) for r in self.restarts) + struct.pack("<II", len(self.restarts), self.n)
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        return struct.pack("<QI", len(raw), zlib.crc32(packed)) + packed


def open_block(raw: bytes) -> tuple[bytes, list[int], int]:
    """(entries, restart points, number of entries); raises on a damaged block."""
    size, crc = struct.unpack_from("<QI", raw)
    if zlib.crc32(raw[12:]) != crc:
        raise ValueError("damaged block")
    buf = pa.decompress(raw[12:], size, codec="zstd", asbytes=True)
    n_restarts, n = struct.unpack_from("<II", buf, len(buf) - 8)
    at = len(buf) - 8 - 4 * n_restarts
    return buf[:at], list(struct.unpack_from(f"<{n_restarts}I", buf, at)), n


def entries(buf: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """Entries from a restart point on."""
    key = b""
    while at < len(buf):
        shared, at = read_varint(buf, at)
        own, at = read_varint(buf, at)
        size, at = read_varint(buf, at)
        key = key[:shared] + buf[at : at + own]
        at += own
        yield key, buf[at : at + size]
        at += size


class ShardWriter:
    """Writes entries in key order to an open binary file; values are little-endian token ids of width bytes."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes, self.at, self.block = sink, width, block_bytes, 0, Block()
        self.index, self.keys, self.docs, self.tokens, self.began = [], [], 0, 0, (0, 0)

    def add(self, key: bytes, value: bytes) -> None:
        self.block.add(key, value)
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.block.buf) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block.n:
            raw = self.block.bytes()
            self.index.append((self.block.last, self.at, len(raw), *self.began))
            self.sink.write(raw)
            self.at += len(raw)
            self.block, self.began = Block(), (self.docs, self.tokens)

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[bloom_places(k, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        index = b"".join(varint(len(k)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        self.sink.write(packed + index + FOOTER.pack(self.at, len(packed), len(index), self.docs, self.tokens, self.width, MAGIC))
        self.sink.close()


class ShardReader:
    """Random and sequential access to one shard; holds the index and the filter, reads one block at a time."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - FOOTER.size)
        at, n_bloom, n_index, self.docs, self.tokens, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(at)
        raw = source.read(n_bloom + n_index)
        self.bits = struct.unpack_from("<Q", raw)[0]
        self.bloom = np.unpackbits(np.frombuffer(raw, np.uint8, n_bloom - 8, 8))
        self.index, i = [], n_bloom
        while i < len(raw):
            size, i = read_varint(raw, i)
            self.index.append((raw[i : i + size], *struct.unpack_from("<QQQQ", raw, i + size)))
            i += size + 32

    def read(self, entry) -> tuple[bytes, list[int], int]:
        self.source.seek(entry[1])
        return open_block(self.source.read(entry[2]))

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for e in self.index:
            yield from entries(self.read(e)[0])

    def get(self, key: bytes) -> bytes | None:
        """The first value of a key, or None."""
        if not all(self.bloom[p] for p in bloom_places(key, self.bits)):
            return None
        b = bisect.bisect_left(self.index, key, key=lambda e: e[0])
        if b == len(self.index):
            return None
        buf, restarts, _ = self.read(self.index[b])
        first = bisect.bisect_left(restarts, key, key=lambda r: next(entries(buf, r))[0])
        for k, v in entries(buf, restarts[max(0, first - 1)]):
            if k >= key:
                return v if k == key else None
        return None


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a URI or an absolute path."""
    if not re.match(r"\w+:", uri):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class ChunkEncoder:
    """Runs the tokenizers library on the distinct pieces of texts; a bounded cache from piece to ids.

    Only for vocabularies whose normaliser keeps ASCII white space apart and whose pre-tokeniser drops it, so that
    space-separated words are encoded alike alone and in their text, which lower-case words, part them from marks and end
    a word's last token in a suffix of its own. A piece is a lower-cased word of ASCII letters, the marks after it, or
    any other word as it is. Words of letters go to the library's BPE model directly, as normaliser and pre-tokeniser
    leave them alone; all others go through the whole tokenizer.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        self.kept: dict[bytes, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.bare = Tokenizer(self.tok.model)
        self.alphabet = {byte: char for char, byte in byte_alphabet().items()}
        size = self.tok.get_vocab_size()
        self.width = 2 if size < 1 << 16 else 4
        suffix = self.tok.model.end_of_word_suffix
        self.ends_word = np.array([bool(suffix) and (self.tok.id_to_token(i) or "").endswith(suffix) for i in range(size)])

    def fill(self, pieces: list[bytes]) -> None:
        """Encodes pieces that the cache lacks."""
        kept = self.kept
        split = {c: self.split(c) for c in pieces if not (c.isalpha() and c.isascii())}
        plain = {c for c in pieces if c not in split}
        other: set[bytes] = set()
        for parts in split.values():
            for x in parts:
                (plain if self.is_plain(x) else other).add(x)
        for group, run in ((plain, self.words), (other, self.whole)):
            new = [c for c in group if c not in kept]
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                kept.update(zip(part, run(part), strict=True))
        for c, parts in split.items():
            if len(parts) > 1 or parts[0] != c:
                kept[c] = b"".join(map(kept.__getitem__, parts))

    def words(self, part: list[bytes]) -> list[bytes]:
        """Ids of lower-case words of letters, by the BPE model alone; a token with the suffix ends a word."""
        named = [c.decode() if c.isascii() else c.decode("latin-1").translate(self.alphabet) for c in part]
        got = np.array(self.bare.encode_batch_fast([named], is_pretokenized=True, add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = (np.flatnonzero(self.ends_word[got]) + 1) * self.width
        if len(ends) != len(part):
            return self.whole(part)
        raw = got.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def whole(self, part: list[bytes]) -> list[bytes]:
        """Ids of pieces by the whole tokenizer."""
        got = self.tok.encode([c.decode() for c in part], is_pretokenized=True, add_special_tokens=False)
        raw = np.array(got.ids, f"<u{self.width}").tobytes()
        ends = np.searchsorted(np.array([-1 if w is None else w for w in got.word_ids], np.int64), np.arange(len(part)), "right") * self.width
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def is_plain(piece: bytes) -> bool:
        """A lower-case word of Latin letters that have one code point in either case."""
        text = piece.decode()
        return text.isalpha() and max(text) < "\u0180" and text.islower() and text.lower() == text and unicodedata.is_normalized("NFC", text)

    @staticmethod
    def split(chunk: bytes) -> tuple[bytes, ...]:
        """A word of letters and the marks after it, which the pre-tokeniser parts anyway; other chunks stay whole."""
        text = chunk.decode()
        core = text.rstrip(MARKS)
        if core.isalpha():
            low = core.lower()
            # letters that the normaliser parts into a letter and a mark would take the marks after the word along
            if len(low) == len(core) and max(low) < "\u0180" or unicodedata.normalize("NFC", core).lower().isalpha():
                word = (low if len(low) == len(core) and max(low) < "\u0180" else core).encode()
                return (word, text[len(core) :].encode()) if len(core) < len(text) else (word,)
        return (chunk,)

    def alone(self, chunk: bytes) -> bytes:
        """Ids of one chunk by the library itself."""
        return np.array(self.tok.encode(chunk.decode(), add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    @staticmethod
    def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with words of ASCII lower-cased, starts and ends of pieces, first piece of each text)."""
        starts, ends, first = words(data, off)
        if not len(starts):
            return data, starts, ends, first
        ascii_only = np.maximum.reduceat(data, starts) < 0x80
        angle = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # special tokens keep their case
        if len(angle):
            ascii_only[np.searchsorted(starts, angle, "right") - 1] = False
        norm = LOWER[data]
        raw = np.flatnonzero(~ascii_only)
        size = ends[raw] - starts[raw]
        at = np.repeat(starts[raw] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        norm[at] = data[at]
        last = np.maximum.accumulate(np.where(_MARK[data], np.int32(-1), np.arange(len(data), dtype=np.int32)))
        core = np.maximum(starts, last[ends - 1].astype(np.int64) + 1)
        letters = np.cumsum(_LETTER[data], dtype=np.int32)
        n_letters = letters[core - 1] - np.where(starts > 0, letters[starts - 1], 0)
        cut_off = ascii_only & (core > starts) & (core < ends) & (n_letters == core - starts)
        place = np.arange(len(starts)) + np.cumsum(cut_off) - cut_off
        p_start, p_end = np.empty(len(starts) + int(cut_off.sum()), np.int64), np.empty(len(starts) + int(cut_off.sum()), np.int64)
        p_start[place], p_end[place] = starts, np.where(cut_off, core, ends)
        p_start[place[cut_off] + 1], p_end[place[cut_off] + 1] = core[cut_off], ends[cut_off]
        return norm, p_start, p_end, np.concatenate([place, [len(p_start)]])[first]

    @staticmethod
    def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one span of each content, the number of each span's content), by hashes that are checked against the bytes."""
        seed = 0
        while True:
            _, one, of = np.unique(span_hashes(data, starts, ends, seed), return_index=True, return_inverse=True)
            size = ends - starts
            if (size == size[one][of]).all() and same_spans(data, starts, starts[one][of], size).all():
                return one, of
            seed += 1

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null as empty), little-endian."""
        data, off = string_buffers(texts)
        norm, starts, ends, first = self.pieces(data, off)
        if not len(starts):
            return [b""] * len(texts)
        one, of = self.distinct(norm, starts, ends)
        view = norm.tobytes()
        found = [view[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        if len(self.kept) > self.LIMIT:
            self.kept.clear()
        rare = {c for c in found if len(c) > 24 or b"<|" in c}
        self.fill([c for c in found if c not in self.kept and c not in rare])
        get = self.kept.__getitem__
        values = [self.alone(c) if c in rare else get(c) for c in found] if rare else list(map(get, found))
        flat = np.frombuffer(b"".join(values), f"<u{self.width}")
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        begin = np.cumsum(size) - size
        each = size[of]
        stop = np.cumsum(each)
        ids = flat[np.repeat(begin[of] - stop + each, each) + np.arange(int(stop[-1]))].tobytes()
        edge = (np.concatenate([[0], stop])[first] * self.width).tolist()
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


_KEPT: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _KEPT:
        _KEPT[path] = ChunkEncoder(path)
    return _KEPT[path]


def write(docs: DataFrame, path: str, out: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encodes every text with a tokenizers vocabulary file and writes shards below out in ascending key order.

    Returns the manifest: one row for each shard with path, place (partition and number within it), n_docs, n_tokens.
    """
    ship(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"identifiers must be integers, not {docs.schema[key].dataType.simpleString()}")
    named = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    # rows of one identifier are dealt by their texts' hashes, so one that many rows share fills no single task
    ordered = named.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").drop("h")

    def run(it):
        enc = chunk_encoder(path)
        fs, base = file_system(out)
        place, part, w = TaskContext.get().partitionId(), 0, None
        rows = {"path": [], "place": [], "part": [], "n_docs": [], "n_tokens": []}

        def close():
            w.close()
            for c, v in zip(rows, (name, place, part, w.docs, w.tokens), strict=True):
                rows[c].append(v)

        end = end_id.to_bytes(enc.width, "little")
        for whole in it:
            for batch in batches(whole, "t", 4 << 20):
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                    if w is None:
                        fs.create_dir(base, recursive=True)
                        name = f"{place:06d}-{part:05d}-{uuid.uuid4().hex[:8]}.sst"
                        w = ShardWriter(fs.open_output_stream(f"{base}/{name}"), enc.width, block_bytes)
                    w.add(key_of(doc_id), ids + end)
                    if w.at >= shard_bytes:
                        close()
                        w, part = None, part + 1
        if w is not None:
            close()
        yield pa.record_batch([pa.array(rows["path"], pa.string()), *[pa.array(rows[c], pa.int64()) for c in ("place", "part", "n_docs", "n_tokens")]], list(rows))

    return cut(ordered.mapInArrow(run, "path string, place long, part long, n_docs long, n_tokens long"), "sst-manifest")


def read(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document, read back from the shards.

    Only the manifest (a row for each shard of up to SHARD_BYTES) goes through one task, to number the shards' first ids.
    """
    ship(spark)
    order = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    spread = max(1, min(manifest.count(), 10_000))

    def run(it):
        fs, base = file_system(out)
        for batch in it:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = ShardReader(fs.open_input_file(f"{base}/{name}"))
                for e in r.index:
                    cols = ([], [], [], [])
                    for k, v in entries(r.read(e)[0]):
                        ids = np.frombuffer(v, f"<u{r.width}")
                        for c, x in zip(cols, (id_of(k), start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                            c.append(x)
                        start += len(ids)
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return shards.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(out: str, manifest_rows: list, doc_id: int) -> bytes | None:
    """The ids of one document by Bloom filter and binary search over the listed shards; None where absent."""
    fs, base = file_system(out)
    for m in manifest_rows:
        if (found := ShardReader(fs.open_input_file(f"{base}/{m['path']}")).get(key_of(doc_id))) is not None:
            return found
    return None


def fresh_dir(spark: SparkSession) -> str:
    return work_dir(spark, "sst")
