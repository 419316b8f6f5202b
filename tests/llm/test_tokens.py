import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafline.llm import bpe, sstable, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n):
    r = random.Random(2)
    letters = [*map(chr, range(1, 0x250)), "́", "क़", "İ", "σ", "一", "\U0001f600", " ", "\x85", "\xa0", " ", "\n", "'s", "'", "<|endoftext|>", "<|startoftext|>", "ab", "The ", ". ", "!!"]
    return ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_library():
    enc, lib = bpe.Encoder(BYTE), Tokenizer.from_file(BYTE)
    texts = [*odd_texts(1500), "a" * 3000, " " * 500, "ab" * 700, "", "<|endoftext|>"]
    enc.warm(texts[:700])
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == want
        assert enc.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_bpe_long_text(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    enc = bpe.Encoder(BYTE)
    text = " ".join(odd_texts(60))
    assert enc.encode(text) == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_rank_tree():
    r = random.Random(3)
    ranks = [r.choice([bpe.NONE, *range(6)]) for _ in range(37)]
    tree = bpe.RankTree(ranks)
    for _ in range(300):
        low = min(ranks)
        assert tree.best() == (ranks.index(low) if low < bpe.NONE else -1)
        i = r.randrange(37)
        ranks[i] = r.choice([bpe.NONE, *range(6)])
        tree.put(i, ranks[i])


def test_round_trip(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = bpe.round_trip(docs, BYTE)
    assert got.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))
    clash = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    back = bpe.decode(bpe.encode(clash, BYTE), BYTE).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.round_trip(empty, BYTE).count() == 0


def test_counts(docs, empty):
    enc = bpe.Encoder(BYTE)
    n = sorted(len(enc.encode(r.text or "")) for r in docs.collect())
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs, BYTE)))
    got = {r.length: r for r in sums.collect()}
    assert set(got) == set(n)
    for x, r in got.items():
        assert (r.n_docs, r.n_tokens, r.docs_from, r.tokens_from) == (n.count(x), x * n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x))
        assert r.truncated_total == sum(min(x, y) for y in n)
    for limit in (0, 5, 77, 10**9):
        r = token_counts.truncated_total(sums, limit).first()
        assert (r.total, r.n_cut) == (sum(min(limit, y) for y in n), sum(y > limit for y in n))
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        want = next(x for x in n if sum(y <= x for y in n) >= q * len(n))
        assert token_counts.quantile(sums, q).first().length == want
    none = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(empty, BYTE)))
    assert none.count() == 0 and token_counts.quantile(none, 0.5).first().length is None


def test_chunks_equal_library():
    enc, lib = sstable.ChunkEncoder(WORD), Tokenizer.from_file(WORD)
    texts = odd_texts(2500) + ["J\u030c. GRÜSSE, Straße! ſt İ, ŉab Å. ﬁne <|startoftext|> <|STARTOFTEXT|>x a'b' x2y, --- é, ẞ! ΣΑΣ", None, "", "It's a DOG's क़! xİ.\tend"]
    for t, ids in zip(texts, enc.encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("shard", [1 << 26, 1500])
def test_shards(spark, docs, empty, shard):
    lib, out = Tokenizer.from_file(WORD), sstable.fresh_dir(spark)
    manifest = sstable.write(docs, WORD, out, 2, shard_bytes=shard, block_bytes=700)
    got = sstable.read(spark, manifest, out).withColumn("crc", F.crc32("ids")).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at, texts = 0, {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(lib.encode(r.text or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == at
        at += r.n_tokens
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in texts[r.doc_id] and r.n_tokens == len(ids) and r.crc == zlib.crc32(bytes(r.ids))
    listed = manifest.collect()
    assert (len(listed) > 4) == (shard < 2000)
    for key in (0, 17, 60, 67):
        assert np.frombuffer(sstable.lookup(out, listed, key), "<u2").tolist() in texts[key]
    assert sstable.lookup(out, listed, 12345) is None
    none = sstable.fresh_dir(spark)
    assert sstable.read(spark, sstable.write(empty, WORD, none, 2), none).count() == 0


def test_damaged_block():
    b = sstable.Block()
    for i in range(50):
        b.add(sstable.key_of(i * 3), bytes([i]))
    raw = b.bytes()
    buf, restarts, n = sstable.open_block(raw)
    assert n == 50 and len(restarts) == 4
    assert [(sstable.id_of(k), v) for k, v in sstable.entries(buf)] == [(i * 3, bytes([i])) for i in range(50)]
    with pytest.raises(ValueError):
        sstable.open_block(raw[:-1] + bytes([raw[-1] ^ 1]))
