import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafline.llm import exact_dedup, ngram_join, substring_dedup
from leafline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies():
    """Chains and groups of edited texts around the threshold, of many sizes; passages that many share."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    passage, out = [word() for _ in range(70)], []
    for size in (5, 6, 7, 9, 12, 16, 25, 40, 80, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(5):
            t = list(base)
            for _ in range(r.randint(0, max(1, size // 24))):
                i = r.randrange(len(t))
                t[i : i + r.randint(0, 1)] = [word()] * r.randint(0, 2)
            out.append(t)
            base = t if r.random() < 0.5 else base
    for _ in range(25):
        out.append([word() for _ in range(r.randint(20, 80))] + passage + [word() for _ in range(r.randint(5, 60))])
    return [(1000 + i, " ".join(t).upper() if i % 7 == 0 else " ".join(t), "en", "s", 1) for i, t in enumerate(out)]


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if (least.get(find(i)) is not None or d is not None) else None
    return Counter((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("frequent", [64, 2])
def test_ngram_join(spark, docs, empty, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    table = docs.unionByName(spark.createDataFrame(near_copies(), docs.schema)).repartition(5)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got, links = ngram_join.joined(table)
    assert Counter((r.key, r.n, r.component) for r in got.collect()) == expected(rows)
    if frequent == 2:
        assert ngram_join.joined(empty)[0].count() == 0
        stay = ngram_join.representatives(table)
        assert stay.columns == table.columns
        want = {(d, t) for d, t in rows if (d, len(shingles(t)), d) in expected(rows)}
        assert Counter((r.doc_id, r.text) for r in stay.collect()) == Counter(want)


def test_pigeonhole_loses_no_pair():
    """Any two sets that reach the similarity share a key, also where segments are few and one-deletion segments are needed."""
    r = np.random.default_rng(4)
    for trial in range(300):
        n = int(r.integers(1, 60))
        base = r.integers(0, 2**63, n + 40, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        if trial % 3 == 0:
            base = base >> np.uint64(int(r.integers(0, 6)))  # crowded into few segments
        x = np.unique(base[:n])
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.15], base[n : n + int(r.integers(0, 1 + n // 4))]]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < 75 * (len(x) + len(y) - common):
            continue
        h, begin = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
        everything = np.zeros(0, np.uint64)
        for hot in (False, True):
            met, grow = False, np.zeros(64, np.int64)
            while True:
                short_any, keys = False, [set(), set()]
                for texts, k, most in ngram_join.parts(np.diff(begin)):
                    if not len(texts):
                        continue
                    units = ngram_join.Keys(h, begin, texts, k, grow)
                    frequent = np.sort(units.key) if hot else everything
                    take, short = units.chosen(most, frequent)
                    short_any |= bool(len(short))
                    got, doc = units.all_keys(take)
                    for t, d in enumerate(texts):
                        keys[d] |= set(got[doc == t].tolist())
                if not short_any:
                    break
                grow += 1
            met = bool(keys[0] & keys[1])
            assert met, (trial, hot, len(x), len(y), common)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200), (100, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got) == {*range(41), 100, 101, 103}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[101] == got[103] != got[0]


def brute_substring(rows, window=20):
    first, out = {}, Counter()
    docs = sorted({(d if d is not None else -(1 << 63), t) for d, t in rows}, key=lambda x: (x[0], x[1] or ""))
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    for d, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d if d is not None else -(1 << 63), i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(spark, docs, empty, hot, monkeypatch):
    if hot:
        real = substring_dedup.hot_minimisers
        monkeypatch.setattr(substring_dedup, "hot_minimisers", lambda s, w, k, share: real(s, w, k, 0.002))
    twice = " ".join(f"v{i}" for i in range(50))
    more = [(2000, twice + " mid " + twice, "en", "s", 1), (2001, "x " + twice.replace(" ", "\t"), "en", "s", 1), (2002, "é" * 3 + " a" * 60, "en", "s", 1)]
    table = docs.unionByName(spark.createDataFrame(near_copies() + more, docs.schema)).repartition(4)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = substring_dedup.digests(table, buckets=5 if hot else 40)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_substring(rows)
    if hot:
        assert substring_dedup.digests(empty).count() == 0
        text = {r.doc_id: r.kept_text for r in substring_dedup.stripped(table).collect()}
        assert text[2001] == "x"


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOW)].append(d)
    out = Counter()
    for t, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        stays = False
        for d in ids:
            kept = d == keep and not stays
            stays |= kept
            out[(d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"moduli": (3, 2), "huge": 200}])
def test_exact_dedup(docs, empty, options):
    """With tiny moduli unequal texts collide, and with a small bound most texts go in chunks."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.groups(docs, **options)
    assert Counter((r.key, r.keep_key, r.group_size, r.kept, r.sha256) for r in got.collect()) == brute_exact(rows)
    if not options:
        assert exact_dedup.groups(empty).count() == 0
        kept = exact_dedup.dedup(docs)
        assert kept.columns == docs.columns
        assert Counter((r.doc_id, hashlib.sha256((r.text or "").translate(LOW).encode()).hexdigest()) for r in kept.collect()) == Counter((x[0], x[4]) for x in brute_exact(rows) if x[3])


def test_fingerprints_compose():
    p = exact_dedup.Poly(exact_dedup.MODULI[0], exact_dedup.BASES[0])
    data = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)
    for cut in (0, 1, 65_536, 150_001):
        a, b = data[:cut], data[cut:]
        assert p.whole(data) == (p.shift(p.whole(a), len(b)) + p.whole(b)) % p.m
    assert p.whole(np.zeros(2, np.uint8)) != p.whole(np.zeros(3, np.uint8))


def set_of(r, base, change):
    """base with some elements exchanged."""
    s = sorted(base)
    gone = set(r.sample(s, min(change, len(s))))
    return {x for x in s if x not in gone} | {r.getrandbits(64) for _ in range(change)}


def test_profiles_bound_the_distance():
    r = random.Random(4)
    for size in (1, 7, 60, 63, 64, 65, 500):
        a = {r.getrandbits(64) for _ in range(size)}
        for change in (0, 1, size // 7 + 1, size):
            b = set_of(r, a, change) | {r.getrandbits(64) for _ in range(r.choice([0, size // 3]))}
            h = np.array([*sorted(a), *sorted(b)], np.uint64)
            pa_, pb = ngram_join.profiles(h, np.array([0, len(a), len(a) + len(b)]))
            low = ngram_join.gap(pa_, pb)
            assert low == ngram_join.gap(pb, pa_) <= len(a ^ b) and (low > 0 or a == b or len(a ^ b) % 2 == 0)


@pytest.mark.parametrize("block", [2048, 6])
def test_clusters_lose_no_link(spark, block, monkeypatch):
    """Every link inside a cluster between components comes out of the second step, once, however the cluster is dealt."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(block)
    base = {r.getrandbits(64) for _ in range(120)}
    others = [set_of(r, base, 22) for _ in range(4)]
    sets = [base] + [set_of(r, base, r.randint(0, 12)) for _ in range(14)] + [set_of(r, o, r.randint(0, 9)) for o in others for _ in range(6)]
    names = sorted(r.randbytes(16) for _ in sets)
    h = np.array([x for s in sets for x in sorted(s)], np.uint64)
    faces = spark.createDataFrame(list(zip(names, map(len, sets), ngram_join.profiles(h, np.concatenate([[0], np.cumsum([len(s) for s in sets])])), strict=True)), "cls binary, n long, profile binary")
    far = lambda i, j: 7 * len(sets[i] ^ sets[j]) > len(sets[i]) + len(sets[j])
    # two centers that share most members
    stars = [(names[c], names[i], len(sets[c]), len(sets[i]), ngram_join.gap(*ngram_join.profiles(np.array([*sorted(sets[c]), *sorted(sets[i])], np.uint64), np.array([0, len(sets[c]), len(sets[c]) + len(sets[i])]))), None if far(c, i) and i % 2 else len(sets[c] ^ sets[i])) for c in (0, 1) for i in range(c + 1, len(sets)) if i % 5 or c]
    table = spark.createDataFrame(stars, "a binary, b binary, na long, nb long, low long, d long")
    found = components(table.where("7 * d <= na + nb").select("a", "b"))
    label = {bytes(x.node): bytes(x.label) for x in found.collect()}
    got = Counter((bytes(x.a), bytes(x.b)) for x in ngram_join._cross(table, found, faces).collect())
    assert got and set(got.values()) == {1}
    members = {c: {s[1] for s in stars if s[0] == names[c]} for c in (0, 1)}
    for i in range(len(sets)):
        for j in range(i):
            a, b = names[j], names[i]
            if not far(i, j) and label.get(a, a) != label.get(b, b) and any({a, b} <= m for m in members.values()):
                assert (a, b) in got
