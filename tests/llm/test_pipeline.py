from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from leafline.session import load
from tests.llm.test_edges import plain_copies, plain_kept
from tests.llm.test_joins import LOW, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against a plain version, on all documents of the smallest scale."""
    docs = load(spark, SF, "documents")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing", "BPE"]
    marks = {}
    for m in load(spark, SF, "labels").collect():
        marks[m.doc_id] = min(m.quality, marks.get(m.doc_id, m.quality))
    kept, _ = plain_kept([(r["doc_id"], r["text"], r["lang"]) for r in rows], marks)
    rows = [r for r in rows if kept[r["doc_id"]]]
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality rules"](spark, docs, SF)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(r["doc_id"] for r in rows)
    last = {}
    for r in rows:
        key = (r["text"] or "").translate(LOW)
        last[key] = max(last.get(key, -1), r["doc_id"])
    rows = [r for r in rows if last[(r["text"] or "").translate(LOW)] == r["doc_id"]]
    docs = stages["exact dedup"](spark, docs, SF)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(r["doc_id"] for r in rows)
    sets, up = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r["doc_id"])
    stay = {min(g) for g in groups.values()}
    docs = stages["n-gram Jaccard join"](spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == stay and docs.count() == len(stay)
    copies = {k: n for (k, _), n in plain_copies(docs).items()}
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == Counter({k: c for k, c in copies.items() if c})
    out = stages["BPE"](spark, mixed, SF).collect()
    lib, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r["doc_id"]: r["text"] for r in rows}
    assert Counter(r.doc_id for r in out) == times
    assert all(r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids) for r in out)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50
