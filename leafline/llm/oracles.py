"""DuckDB SQL for the queries that SQL can express."""

from leafline.llm.license_scan import CUES, SIMILAR, TEMPLATES, TERM

#: A-Z lower-cased, null as empty.
_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256 FROM d JOIN g ON d.t = g.t
"""


#: Words as lists; RE2 reads the escapes.
_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_NORMAL)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS x FROM documents UNION SELECT r.d, e2.b FROM r JOIN e2 ON r.x = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(x) AS component_id FROM r GROUP BY d) m ON m.d = d.doc_id
"""

OP5 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="text")} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM v),
p AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM f WHERE k > 1)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT x.doc_id, count(p.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (p.i IS NULL) AS kept FROM x LEFT JOIN p ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CUE = " OR ".join(f"contains(lower({{t}}), '{c}')" for c in CUES)
OP9 = f"""
WITH tpl AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_literal(n)}, {_literal(t)})" for i, (n, t) in enumerate(TEMPLATES))}) v(place, name, body)),
tt AS (SELECT place, term, count(*) AS n FROM (SELECT place, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1 + {len(TEMPLATES)}) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT place, term, n * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT place, sqrt(sum(w * w)) AS norm FROM tw GROUP BY place),
d AS (
  SELECT doc_id, text, coalesce(source, '-') || '/' || coalesce(lang, '-') AS base,
    coalesce(length(text) <= 300 AND ({_CUE.format(t="text")}), false) AS f, coalesce({_CUE.format(t="text")}, false) AS cue FROM documents),
h AS (SELECT doc_id, text AS line FROM d WHERE f UNION SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d WHERE cue AND NOT f) WHERE {_CUE.format(t="line")}),
hl AS (SELECT DISTINCT line FROM h),
ht AS (SELECT line, term, count(*) AS n FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM hl) GROUP BY ALL),
hw AS (SELECT line, term, n * coalesce(idf, ln(1 + {len(TEMPLATES)}) + 1) AS w FROM ht LEFT JOIN idf USING (term)),
hn AS (SELECT line, sqrt(sum(w * w)) AS norm FROM hw GROUP BY line),
c AS (SELECT hw.line, tw.place, round(sum(hw.w * tw.w) / any_value(hn.norm) / any_value(tn.norm), 6) AS s FROM hw JOIN tw USING (term) JOIN hn ON hn.line = hw.line JOIN tn ON tn.place = tw.place GROUP BY hw.line, tw.place),
b AS (SELECT doc_id, s, place FROM h JOIN c USING (line) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, place) = 1),
o AS (SELECT d.doc_id, d.base, d.f, b.s AS similarity, tpl.name AS own_licence FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.s >= {SIMILAR} LEFT JOIN tpl ON tpl.place = b.place),
l AS (SELECT base, own_licence AS licence FROM o WHERE f AND own_licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY base ORDER BY similarity DESC, base || '/LICENSE.' || doc_id) = 1)
SELECT o.doc_id, CASE WHEN f THEN o.base || '/LICENSE.' || o.doc_id ELSE o.base || '/' || CAST(floor(o.doc_id / 1000) AS BIGINT) || '/' || o.doc_id || '.txt' END AS path,
  o.own_licence, o.similarity, coalesce(o.own_licence, l.licence) AS licence, CASE WHEN o.own_licence IS NULL AND l.licence IS NOT NULL THEN o.base END AS inherited_from
FROM o LEFT JOIN l ON l.base = o.base
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_ngram_join": OP2, "op5_substring_dedup": OP5, "op9_license_scan": OP9}
