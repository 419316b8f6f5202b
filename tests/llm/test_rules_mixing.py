import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if wins[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_measures(docs):
    got = quality_rules.measured(docs, ["doc_id", "n_chars"]).toPandas()
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.itertuples()) == want


def test_bounds():
    assert quality_rules.binomial_cdf(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality_rules.binomial_cdf(3, 10, 0.3) == pytest.approx(0.6496107184)
    assert quality_rules.binomial_cdf(10, 10, 0.3) == 1
    n = quality_rules.needed_labels(1, 1, 0.02, 0.05)
    assert quality_rules.certified(0, n, 0.02, 0.05) and not quality_rules.certified(0, n - 1, 0.02, 0.05)
    good, bad = np.zeros(513, int), np.zeros(513, int)
    good[3], good[40], bad[200], bad[300] = 1000, 1, 5, 5
    assert quality_rules.choose(good, bad, 0.01, 0.05) == 199
    assert quality_rules.choose(good // 100, bad, 0.01, 0.05) is None


def test_verdicts(spark, docs, empty):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (" ###" * 9 if i % 10 == 0 else ""), "en" if i % 2 else "fr", "s", 1) for i in range(3000)]
    table = spark.createDataFrame(rows, docs.schema).unionByName(docs)
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(3000)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.verdicts(table, labels).collect() if r.doc_id is not None and r.doc_id >= 100}
    assert all(r.kept == (i % 10 != 0) for i, r in got.items())  # only bad ones have symbols, all of them
    kept = quality_rules.keep(table, labels)
    assert kept.columns == table.columns
    want = Counter(r.doc_id for r in quality_rules.verdicts(table, labels).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    none = labels.where("false")
    assert all(r.kept == (not r.base_failed) for r in quality_rules.verdicts(docs, none).collect())
    assert quality_rules.verdicts(empty, labels).count() == quality_rules.keep(empty, labels).count() == 0


def test_joint_verdict(spark, docs):
    """Strata of 250 good labels get a cutoff for all rules; one of 150 has none, and only the base rules reject there."""
    many = {"de": 250, "en": 250, "es": 250, "fr": 150}
    rows, marks = [], []
    for lang, n in many.items():
        for j in range(n + 40):
            i, bad = len(rows), j >= n
            # bad ones fail by different rules; one good one in fifty fails the base rules
            text = "short" if j % 50 == 0 and not bad else " ".join(f"w{i}x{k}" for k in range(30)) + ((" " + "!" * 30, " " + "#" * 200)[j % 2] if bad else " A")
            rows.append((i, text, lang, "s", 1))
            marks.append((i, int(not bad), 0))
    table = spark.createDataFrame(rows, docs.schema)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert quality_rules.needed_labels(4, 1) == 217
    got = {r.doc_id: r for r in quality_rules.verdicts(table, labels).collect()}
    for (i, text, lang, *_), (_, good, _) in zip(rows, marks, strict=True):
        assert got[i].kept == (text != "short" and (bool(good) or lang == "fr"))
    assert {r.doc_id for r in quality_rules.keep(table, labels).collect()} == {i for i, r in got.items() if r.kept}


def fill(caps, weights, budget):
    live, out = set(caps), dict.fromkeys(caps, 0.0)
    while live:
        rest, w = budget - sum(out[s] for s in caps if s not in live), sum(weights[s] for s in live)
        over = {s for s in live if rest * weights[s] / w > caps[s]}
        for s in live:
            out[s] = rest * weights[s] / w
        for s in over:
            out[s] = caps[s]
        if not over:
            return out
        live -= over
    return out


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_mixing(docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    got = mixing.plan(docs).collect()
    assert len(got) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += base(r.text)[0]
    order = sorted((s for s in size if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fill({s: 2 * size[s] for s in order}, weights, 1.5 * sum(size.values()))
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    assert all(abs(taken[s] - want[s]) <= most[s] + 1 for s in order)
    key = lambda rows: sorted((str(r.key), r.h, r.copies) for r in rows)
    assert key(mixing.plan(docs.repartition(5)).collect()) == key(got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan(empty).count() == mixing.mix(empty).count() == 0
    assert mixing.plan(docs.where(F.col("text").isNull())).where("copies > 0").count() == 0
