import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.llm import license_scan, quality_gam
from leafline.session import load


def test_trees():
    g, h = np.array([1, 1, -3, -3, 2, 2.0]), np.ones(6)
    t = quality_gam.tree(g, h, 3)
    assert t[0] == t[1] > 0 > t[2] == t[3] and t[4] == t[5] > t[0]
    table = np.zeros((8, 8))
    table[:3, 5:] = 4.0
    gain, v = quadrants = quality_gam.quadrants(table, np.ones((8, 8)))
    assert gain > 0 and v[0, 7] > v[7, 0] and len(quadrants) == 2


def test_pairs_learn_interactions():
    r = np.random.default_rng(0)
    x = r.random((6000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x[:4000], y[:4000])
    assert (1, 0) in m.pairs
    assert ((m.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = quality_gam.scores(load(spark, sf, "documents"), load(spark, sf, "labels"))
    held = got.where("held_out").join(load(spark, sf, "labels").withColumnRenamed("doc_id", "key"), "key").toPandas()
    y, s = held["quality"].to_numpy(), held["score"].to_numpy()
    order = s.argsort().argsort()
    auc = (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5
    assert len(held) > 500 and ((s >= 0.5) == y).mean() > 0.95 and auc > 0.95
    assert ((s >= 0.5) == (held["predicted"] == 1)).all()


def test_scores_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_gam.scores(docs, labels)
    assert got.count() == docs.count() and got.where("score between 0 and 1").count() == docs.count()
    assert quality_gam.scores(empty, labels).count() == 0
    assert all(r.score == pytest.approx(0.5) for r in quality_gam.scores(docs, labels.where("false")).collect())
    import zlib

    for r in got.where("key is not null").collect():
        assert r.held_out == (zlib.crc32(str(r.key).encode()) % 3 == 1)


def test_cosine(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "released under the mit license", "All rights reserved.", "nothing here", "", "Licensed under CC BY-NC 4.0. Thanks"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("i", license_scan.best(F.col("t")).alias("b")).orderBy("i").collect()
    idf, other = license_scan.weights()
    for r, line in zip(got, lines, strict=True):
        terms = license_scan.terms(line)
        v = {t: terms.count(t) * idf.get(t, other) for t in set(terms)}
        norm = sum(x * x for x in v.values()) ** 0.5
        cos = [round(sum(v.get(t, 0) * w for t, w in u.items()) / norm, 6) if norm else 0 for _, u in license_scan.vectors()]
        assert r.b.similarity == pytest.approx(max(cos), abs=2e-6) and -r.b.place == cos.index(max(cos))
    assert got[0].b.similarity == pytest.approx(1)


def test_inheritance(spark):
    mit, gpl = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[5][1]
    rows = [
        ("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/y.py", "code"), ("a/b/z.py", f"# {gpl}\ncode"), ("a/c/COPYING.txt", gpl), ("a/c/d/e/f.py", None), ("g/h.py", ""), ("top.py", "code"),
        (None, "code"), ("a/LICENSE.old", "nothing"), ("a/c/d/notes", "All rights reserved."), ("a/x.py", "code"), ("ab/x.py", "code"),
    ]
    files = spark.createDataFrame([(i, p, t, "kept") for i, (p, t) in enumerate(rows)], "i int, path string, text string, licence_note string")
    got = {r.i: r for r in license_scan.scan(files).collect()}
    assert len(got) == len(rows) and got[0].licence_note == "kept"
    want = {0: ("MIT", None), 1: ("MIT", "a"), 2: ("MIT", "a"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", None), 5: ("GPL-3.0", "a/c"), 6: (None, None), 7: (None, None), 8: (None, None), 9: ("MIT", "a"), 10: ("Proprietary", None), 11: ("MIT", "a"), 12: (None, None)}
    assert {i: (r.licence, r.inherited_from) for i, r in got.items()} == want
    root = spark.createDataFrame([("LICENSE", mit), ("p/q.py", "x"), ("r.py", "x")], "path string, text string")
    assert {(r.path, r.licence, r.inherited_from) for r in license_scan.scan(root).collect()} == {("LICENSE", "MIT", None), ("p/q.py", "MIT", ""), ("r.py", "MIT", "")}
    assert license_scan.scan(files.where("false")).count() == 0


def test_corpus_paths(docs):
    got = license_scan.scan(license_scan.corpus_paths(docs))
    assert got.count() == docs.count()


def test_licence_file_with_prose(spark):
    """A licence line among other text counts in a licence file as it does elsewhere, and is passed on."""
    prose = "The river rose early that year and the whole valley waited for the water to fall again.\nLicensed under the Apache License, Version 2.0.\nNobody had seen anything like it before."
    files = spark.createDataFrame([("a/LICENSE.1", prose), ("a/b/1.txt", "x"), ("c/2.txt", prose), ("d/LICENSE", "no cue at all"), ("d/3.txt", "x")], "path string, text string")
    got = {r.path: (r.licence, r.similarity, r.inherited_from) for r in license_scan.scan(files).collect()}
    assert got == {"a/LICENSE.1": ("Apache-2.0", 1.0, None), "a/b/1.txt": ("Apache-2.0", None, "a"), "c/2.txt": ("Apache-2.0", 1.0, None), "d/LICENSE": (None, None, None), "d/3.txt": (None, None, None)}


def test_real_licences(spark):
    """Whole licence files, wrapped headers and SPDX lines, as they are in repositories."""
    full = {n: "\n".join(textwrap.fill(x, 72) for x in t.replace("Copyright (c)", "Copyright (c) 2021 Jane Doe and others").split("\n")) for n, t in license_scan.FULL_TEXTS}
    bsd = Path("/usr/share/common-licenses/BSD")
    rows = [(f"{n}/LICENSE", t, n) for n, t in full.items()] + ([("regents/LICENSE", bsd.read_text(), "BSD-3-Clause")] if bsd.exists() else [])
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    rows += [("m/a.c", "/* " + mpl.replace("\n", "\n * ") + " */\nint x;", "MPL-2.0"), ("m/b.py", "# " + mpl.replace("\n", "\n# ") + "\nx = 1", "MPL-2.0"), ("m/c.xml", "<!--\n" + mpl + "\n-->\n<x/>", "MPL-2.0")]
    for i, e in enumerate(("MIT", "Apache-2.0", "GPL-3.0-or-later", "MIT OR Apache-2.0", "(GPL-2.0-only WITH Classpath-exception-2.0)")):
        rows.append((f"s/{i}.c", f"// SPDX-License-Identifier: {e}\nint x;", e))
    rows += [("n/LICENSE", "A contract of the parties of the first part about the use of the house and of the garden, to which no licence applies.", None), ("n/a.py", "# a comment\n# of two lines on permission bits\nx = 1", None)]
    got = {r.path: r.own_licence for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert got == {p: n for p, _, n in rows}


ODD = [
    "Prose before it.\nReleased under the MIT License.", "no cue", "SPDX-License-Identifier: ISC", "// SPDX-License-Identifier: ISC\nint x;" + " y" * 200,
    "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/." + "\nx" * 150,
    "Licensed under CC BY 4.0", "L\u0130CENSED under CC BY-SA 4.0", "Released under the MIT L\u212aicense", "", None, "All rights reserved.\n" + "long prose\n" * 40, "Released under the MIT License",
]


@pytest.mark.parametrize("data", ["odd", "small"])
def test_license_query_against_its_sql(spark, small, tmp_path, data):
    """Licence files with prose, SPDX lines, wrapped headers, slashes in sources and languages: as the SQL has them."""
    import duckdb

    from leafline.llm import oracles, queries

    if data == "odd":
        places = [("s", "en"), ("s", "en/0"), ("s/en", "x"), ("s", None), (None, ""), ("", "")]
        rows = [(i * len(places) + j, t, source, lang, 1) for i, t in enumerate(ODD) for j, (source, lang) in enumerate(places) if (i + j) % 4]
        spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path) if data == "odd" else small.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet{'/*.parquet' if data == 'odd' else ''}'")
    want = con.sql(oracles.OP9)
    got = queries.op9_license_scan(spark, at)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
