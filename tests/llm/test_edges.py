"""Clashing column names, repeated rows, hot groups, identifier types, and plain versions of what the other tests hold only by invariants."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafline.llm import bpe, exact_dedup, license_scan, mixing, ngram_join, quality_gam, quality_rules, sstable, substring_dedup
from tests.llm.test_rules_mixing import base, fill

#: Names that the operators use for columns of their own.
CLASHES = """key _key h _h u at _at size _size source_size target copies finish first_finish n m piece c rank bucket cls profile component label stay same sha _sha keep_key keep_sha sha256
 row last f1 f2 mix_key mix_h mix_at mix_salt mix_row rule_stratum rule_cutoff stratum cutoff _text raw kept failed base_failed n_words doc version runs k t licence similarity own_licence
 inherited_from dir holder holds near headers is_file _dir ids n_tokens decoded""".split()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


def own_values(rows, names=CLASHES):
    return all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in names)


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_names_dedup(docs, clashing):
    got = exact_dedup.dedup(clashing)
    assert got.columns == clashing.columns and own_values(rows := got.collect()) and ids(rows) == ids(exact_dedup.dedup(docs).collect())


def test_names_join(docs, clashing):
    got = ngram_join.representatives(clashing)
    assert got.columns == clashing.columns and own_values(rows := got.collect()) and ids(rows) == ids(ngram_join.representatives(docs).collect())


def test_names_rules(spark, docs, clashing):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality_rules.keep(clashing, labels)
    assert got.columns == clashing.columns and own_values(rows := got.collect()) and ids(rows) == ids(quality_rules.keep(docs, labels).collect())


def test_names_mix(clashing):
    got = mixing.mix(clashing)
    copies = Counter()
    for r in mixing.plan(clashing).collect():
        copies[r.key] += r.copies
    assert got.columns == clashing.columns and own_values(rows := got.collect()) and ids(rows) == Counter({k: n for k, n in copies.items() if n})


def test_names_tokens(docs, clashing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(clashing.limit(9), path), path)
    rows = got.collect()
    assert set(got.columns) == set(clashing.columns) and own_values(rows, [c for c in CLASHES if c not in ("ids", "n_tokens", "decoded")])
    assert all(r.decoded == (r.text or "") and r.n_tokens * 4 == len(r.ids) for r in rows)


def test_names_licences(docs, clashing):
    paths = lambda d: d.withColumn("path", F.concat(F.lit("a/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))))
    got = license_scan.scan(paths(clashing))
    rows = got.collect()
    assert own_values(rows, [c for c in CLASHES if c not in license_scan.ADDED])
    assert all(r[f"{c}_"] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in license_scan.ADDED)
    assert ids(rows) == ids(docs.collect()) and set(license_scan.ADDED) <= set(got.columns)


def test_names_others(spark, docs, clashing, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    scores = lambda d: Counter((r.key, round(r.score, 9)) for r in quality_gam.scores(d, labels).collect())
    assert scores(clashing) == scores(docs)
    removed = lambda d: Counter(tuple(r) for r in substring_dedup.digests(d, buckets=4).collect())
    assert removed(clashing) == removed(docs)
    out = sstable.fresh_dir(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert ids(sstable.read(spark, sstable.write(clashing, path, out, 2), out).collect()) == ids(docs.collect())


@pytest.mark.parametrize("kind", ["string", "double"])
def test_identifier_types(docs, kind):
    odd = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    with pytest.raises(TypeError):
        substring_dedup.digests(odd)
    with pytest.raises(TypeError):
        sstable.write(odd, public_tokenizers.path("word_bpe_49k.json"), "unused", 2)


def test_tied_identifiers(spark):
    """Rows of one identifier come in one order, whatever their partitions."""
    rows = [(7, f"text {i % 5}") for i in range(20)] + [(None, "a"), (None, "b"), (3, "c")]
    path, seen = public_tokenizers.path("word_bpe_49k.json"), []
    for n in (1, 4):
        out = sstable.fresh_dir(spark)
        got = sstable.read(spark, sstable.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), path, out, 2), out)
        seen.append([(r.doc_id, bytes(r.ids)) for r in got.orderBy("start").collect()])
    assert seen[0] == seen[1] and [x for x, _ in seen[0]] == [None, None, 3] + [7] * 20


def test_hot_copies(docs, spark, monkeypatch):
    """Groups above the bound meet by broadcast; results are the same."""
    many = docs.unionByName(spark.createDataFrame([(1000 + i, ("HOT text" if i % 2 else "hot TEXT") + " x" * (i % 3 == 0), "en", "s", 1) for i in range(90)], docs.schema))
    rows = lambda: Counter(tuple(r) for r in exact_dedup.groups(many).drop("row").collect())
    plain = rows()
    monkeypatch.setattr(exact_dedup, "HOT", 12)
    assert rows() == plain
    assert {n for _, _, n, _, _ in plain} >= {30, 60}


@pytest.mark.parametrize("piece,hot", [(64, 1000), (3, 4)])
def test_identical_rows(spark, docs, piece, hot, monkeypatch):
    """Rows that are all equal are offered one by one."""
    monkeypatch.setattr(mixing, "PIECE", piece)
    monkeypatch.setattr(mixing, "HOT", hot)
    same = spark.createDataFrame([(9999, "three words here", "en", "s9", 1)] * 200, docs.schema)
    table = docs.unionByName(same)
    got = mixing.plan(table).collect()
    assert len(got) == table.count()
    mine = [r for r in got if r.key == 9999]
    assert len(mine) == 200 and all(0 <= r.copies <= 2 for r in mine)
    taken = sum(r.copies * r.size for r in mine)
    assert abs(taken - mine[0].target) <= 4
    times = ids(mixing.mix(table).collect())
    want = Counter()
    for r in got:
        want[r.key] += r.copies
    assert times == Counter({k: n for k, n in want.items() if n})


def plain_copies(docs):
    """How often each (identifier, hash of the row) is taken: every offer in one list, sorted by virtual finish time and taken until the budget ends."""
    number = Counter()
    rows = []
    for r in docs.withColumn("h_", F.xxhash64(*docs.columns)).collect():
        name = (r.doc_id, r.h_)
        rows.append((r.source, *name, number[name] // mixing.PIECE, base(r.text)[0]))
        number[name] += 1
    places = docs.sparkSession.createDataFrame([(k, h, piece) for _, k, h, piece, _ in rows], "key long, h long, piece long").distinct()
    u = {(r.key, r.h, r.piece): r.u for r in places.withColumn("u", F.xxhash64(F.lit(7), "key", "h", "piece")).collect()}
    size, order = defaultdict(int), defaultdict(list)
    for s, k, h, piece, n in rows:
        size[s] += n
        order[s].append((u[k, h, piece], piece, (k, h), n))
    sources = sorted(s for s in order if s is not None) + [None] * (None in order)
    target = fill({s: 2 * size[s] for s in sources}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, 1.5 * sum(size.values()))
    offers = []
    for rank, s in enumerate(sources):
        run = 0
        # few rows are one bucket, ordered by their hash
        for _, _, name, n in sorted(order[s], key=lambda x: x[:2]):
            run += n
            if n:
                offers += [((e * size[s] + run) / target[s], rank, name, n) for e in (0, 1)]
    left, copies = 1.5 * sum(size.values()), Counter()
    for _, _, name, n in sorted(offers, key=lambda x: x[:2]):
        if n > left:
            break
        left -= n
        copies[name] += 1
    return copies


def test_mix_by_hand(docs):
    want = Counter()
    for r in mixing.plan(docs).collect():
        want[r.key, r.h] += r.copies
    assert Counter({k: n for k, n in want.items() if n}) == plain_copies(docs)


def upper_bound_holds(rejected, good, risk, delta):
    """Whether seeing so few rejections has a chance of delta at most if the rate were risk: the exact binomial test."""
    return sum(math.comb(good, i) * risk**i * (1 - risk) ** (good - i) for i in range(rejected + 1)) <= delta


def plain_steps(text):
    words, chars, symbols, dup, repeat = base(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    share = lambda a, b: min(512, 512 * a // max(1, b))
    upper = sum("A" <= c <= "Z" for c in text)
    return max(share(symbols, chars), share(dup, lines), share(repeat, words), share(upper, chars), share(text.count("!"), words), share(text.count("|"), words)), words < 10 or 100 * repeat > 20 * words


def plain_kept(rows, marks):
    """Whether each document (identifier, text, language) stays: cutoffs by going through all of them, and every document by the cutoff of its language. Returns cutoffs too."""
    steps = {i: plain_steps(t or "") for i, t, _ in rows}
    strata = {x[2] for x in rows if x[0] in marks}
    cutoffs = {}
    for lang in strata:
        held = {i: steps[i] for i, _, g in rows if g == lang and i in marks}
        good = [0 if failed else step for i, (step, failed) in held.items() if marks[i]]
        bad = [0 if failed else step for i, (step, failed) in held.items() if not marks[i]]
        best = None
        for cutoff in range(511, -1, -1):
            lost = sum(x > cutoff for x in good)
            if not good or lost > 0.02 * len(good) or not upper_bound_holds(lost, len(good), 0.02, 0.05 / len(strata)):
                break
            caught = sum(x > cutoff for x in bad)
            if caught and (best is None or caught > best[0]):
                best = (caught, cutoff)
        cutoffs[lang] = best[1] if best else None
    return {i: not steps[i][1] and (cutoffs.get(lang) is None or steps[i][0] <= cutoffs[lang]) for i, _, lang in rows}, cutoffs


def test_kept_by_hand(spark, docs):
    r = random.Random(3)
    rows, marks = [], {}
    for i in range(1300):
        good = r.random() < 0.8
        words = [f"w{i}x{k}" for k in range(r.randint(8, 40))]
        words = [w.upper() if r.random() < (0.05 if good else r.choice([0.05, 0.7])) else w for w in words]
        words += ["!" * r.randint(0, 2 if good else 9), "#" * r.randint(0, 3 if good else 60)]
        rows.append((i, " ".join(words), r.choice(["en", "fr"]) if i < 1250 else "xx", "s", 1))
        if r.random() < 0.9:
            marks[i] = int(good)
    want, cutoffs = plain_kept([x[:3] for x in rows], marks)
    assert cutoffs["xx"] is None and cutoffs["en"] is not None and cutoffs["fr"] is not None
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, docs.schema).repartition(3)
    assert {x.doc_id: x.kept for x in quality_rules.verdicts(table, labels).collect()} == want
    assert 0 < sum(not k for k in want.values()) < len(want)


def plain_features(text):
    """The features of one text, counted one by one."""
    text = text or ""
    words, chars, symbols, dup, repeat = base(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    w, c, n = max(1, words), max(1, chars), max(1, lines)
    lead = sum("A" <= a <= "Z" and "a" <= b <= "z" for a, b in zip(text, text[1:], strict=False))
    count = lambda s: sum(text.count(x) for x in s)
    return [math.log2(1 + words), chars / w, symbols / c, dup / n, repeat / w, sum("A" <= x <= "Z" for x in text) / c, text.count("!") / w, text.count("|") / w, sum("0" <= x <= "9" for x in text) / c, count(".?;:") / w, text.count(",") / w, sum(ord(x) > 127 for x in text) / c, words / n, lead / w]


def test_scores_by_hand(spark, docs):
    """Features counted plainly, and a score as a sum of single table entries."""
    labels = spark.createDataFrame([(i, i * 7 % 3 % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality_gam.train(quality_gam.featured(docs), labels)
    assert model.tables and model.pairs
    got = defaultdict(set)
    for r in quality_gam.scores(docs, labels).collect():
        got[r.key].add(round(r.score, 9))
    for r in docs.where("doc_id is not null").collect():
        x = plain_features(r.text)
        place = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, place, strict=True))
        small = [b * quality_gam.PAIR_BINS // (len(e) + 1) for b, e in zip(place, model.edges, strict=True)]
        total += sum(t[small[i], small[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert any(abs(1 / (1 + math.exp(-total)) - s) < 1e-6 for s in got[r.doc_id])


def test_sample_to_fit_on(spark, docs):
    """A bound on the hash lets enough rows through, and the least hashes among them are all the least."""
    rows = [(i, f"word{i} " * (1 + i % 9), "en", "s", 1) for i in range(900)]
    table = quality_gam.featured(spark.createDataFrame(rows, docs.schema))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    few, all_ = quality_gam.train(table, labels, most=40), quality_gam.train(table, labels, most=10_000)
    assert few.tables and all_.tables and np.isfinite(few.intercept)


def test_pipeline_of_odd_tables(spark, docs, empty, clashing, tmp_path):
    """Nulls, repeats, empty and long texts, clashing names and no rows pass every stage."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("empty", empty), ("names", clashing)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r.doc_id for r in quality_rules.verdicts(docs, labels).where("kept").collect()}
    assert rows and {r.doc_id for r in rows} <= kept and max(ids(rows).values()) <= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    named = corpus_pipeline.run(spark, f"{tmp_path}/names").collect()
    assert named and {r.doc_id for r in named} <= kept
