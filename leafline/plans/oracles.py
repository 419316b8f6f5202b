"""DuckDB SQL for the named queries, written on its own from the operators' definitions."""

from __future__ import annotations

from leafline.operators.overlay import MARK
from leafline.sources.relations import DICTIONARY, MAP, RASTER_H, RASTER_W, STATUS, WIDTH
from leafline.sources.relations import SETTINGS as RAW_SETTINGS

P = "(SELECT greatest(1, count(*) // 120) FROM lineitem)"
BOXES = f"""boxes AS MATERIALIZED (SELECT page, row_number() OVER (PARTITION BY page ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS box_id,
  x1, y1, x1 + w AS x2, y1 + h AS y2, score FROM (SELECT *, l_orderkey % {P} AS page, (l_partkey * 37) % 1000 AS x1, (l_orderkey * 53 + l_suppkey * 17) % 1600 AS y1,
  40 + (l_partkey % 7) * 60 AS w, 10 + (CAST(l_quantity AS BIGINT) % 9) * 2 AS h, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score FROM lineitem))"""
BLOCKS = "blocks AS (SELECT page * 16 + box_id % 16 AS page, box_id, x1, y1, x2, y2, score FROM boxes)"
FRAMES = f"""frames AS MATERIALIZED (SELECT page, row_number() OVER (PARTITION BY page ORDER BY o_orderkey) AS frame_id, x1, y1, CASE WHEN wall THEN {WIDTH} ELSE x1 + 100 + (o_custkey % 8) * 100 END AS x2, y1 + 40 + (o_orderkey % 11) * 30 AS y2
  FROM (SELECT *, o_orderkey % {P} AS page, o_orderkey % 17 = 0 AS wall, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE (o_custkey * 31) % 900 END AS x1, (o_orderkey * 41 + o_custkey * 7) % 1500 AS y1 FROM orders))"""
READ = "rd AS (SELECT *, CASE WHEN score >= 0.1 THEN repeat('ab ', CAST((x1 + box_id) % 9 AS INTEGER)) END AS text FROM boxes)"
LINES = "tl AS (SELECT doc_id, i - 1 AS line_no, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
PIXELS = f"""px AS (SELECT page, y, x, max(p) AS p FROM (SELECT o_orderkey % (SELECT greatest(1, count(*) // 150) FROM orders) AS page, ((o_orderkey * 7919 + o_custkey * 31) // 13) % {MAP} AS y, ((o_custkey * 104729 + o_orderkey * 17) // 11) % {MAP} AS x,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS p FROM orders) GROUP BY ALL)"""
MASK = f"mask AS (SELECT DISTINCT page, y + dy AS y, x + dx AS x FROM px, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx) WHERE p > 0.3 AND y + dy < {MAP} AND x + dx < {MAP})"
PARTS = "reach AS (SELECT page, y, x, y * 1048576 + x AS c FROM mask UNION SELECT m.page, m.y, m.x, r.c FROM reach r JOIN mask m ON m.page = r.page AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND m.y * 1048576 + m.x > r.c), parts AS (SELECT page, y, x, min(c) AS comp FROM reach GROUP BY page, y, x)"
STEPS = "steps AS (SELECT vec_id // 4 AS seq_id, (vec_id % 4) * 8 + i AS t, embedding[i * 8 + 1:i * 8 + 8] AS scores FROM (SELECT *, unnest(range(0, 8)) AS i FROM embeddings))"
DICT = "[" + ", ".join(f"'{c}'" for c in DICTIONARY) + "]"
EMIT = f"""best AS (SELECT seq_id, t, list_position(scores, list_max(scores)) - 1 AS cls, CAST(scores[8] AS DOUBLE) AS sp FROM steps),
em AS (SELECT seq_id, t, cls, ({DICT})[cls + 1] AS ch FROM (SELECT *, lag(cls, 1, -1) OVER (PARTITION BY seq_id ORDER BY t) AS last FROM best) WHERE cls <> 0 AND cls <> last)"""
LOG = "jl AS (SELECT user_id AS job_id, ts, event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END AS status FROM events)"
ITEMS = """items AS (SELECT o_orderkey * 2 AS id, o_custkey % 3 AS library_id, CAST(NULL AS BIGINT) AS parent_id, false AS is_attachment, CAST(NULL AS VARCHAR) AS content_type, CAST(NULL AS VARCHAR) AS path, 'Item ' || o_orderkey AS title FROM orders
  UNION ALL SELECT p_partkey * 2 + 1, p_partkey % 3, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey // 4) * 2 END, true, CASE WHEN p_partkey % 5 = 0 THEN 'application/pdf' END,
    CASE WHEN p_partkey % 9 <> 0 THEN '/files/' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.PDF' WHEN p_partkey % 11 = 0 THEN '.txt' ELSE '.pdf' END END, 'Part ' || p_partkey || CASE p_partkey % 4 WHEN 1 THEN ' [ocr]' WHEN 2 THEN ' x[OCR]' ELSE '' END FROM part)"""
REQUESTS = "req AS (SELECT p_partkey * 3 + 1 AS id, 'T' || p_partkey AS title FROM part)"
IS_DOC = "coalesce(content_type = 'application/pdf', false) OR coalesce(regexp_matches(path, '(?i)\\.pdf$'), false)"
IS_DERIVED = "coalesce(regexp_matches(title, '(?i)(^|\\s)\\[OCR\\](\\s|$)'), false)"
AREA = "greatest(0, {p}x2 - {p}x1) * greatest(0, {p}y2 - {p}y1)"
COMMON = "greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"


def fold(name: str, src: str, keys: str, ident: str = "box_id", half_of: str = "least(r.y2 - r.y1, f.a2 - f.a1)") -> str:
    """CTEs that number lines: name has src's rows and line."""
    on = " AND ".join(f"r.{k} = f.{k}" for k in keys.split(", "))
    same = f"({half_of} > 0 AND 2 * (least(r.y2, f.a2) - greatest(r.y1, f.a1)) >= {half_of})"
    own = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY y1, x1, {ident}) AS rn FROM {src}),
{name}_f AS (SELECT {own}, r.{ident}, r.rn, 1 AS line, r.y1 AS a1, r.y2 AS a2 FROM {name}_r r WHERE rn = 1
  UNION ALL SELECT {own}, r.{ident}, r.rn, CASE WHEN {same} THEN f.line ELSE f.line + 1 END, CASE WHEN {same} THEN f.a1 ELSE r.y1 END, CASE WHEN {same} THEN f.a2 ELSE r.y2 END FROM {name}_f f JOIN {name}_r r ON {on} AND r.rn = f.rn + 1),
{name} AS (SELECT r.*, f.line FROM {name}_r r JOIN {name}_f f ON {on} AND r.{ident} = f.{ident})"""


def sided(name: str, src: str, keys: str, by: str, side: str, ident: str = "box_id") -> str:
    """CTEs that order src by segments, sides and lines: name has seq."""
    return f"""{name}_a AS (SELECT *, {side} AS side FROM {src}),
{name}_b AS (SELECT *, coalesce(sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM {name}_a),
{fold(name + "_l", name + "_b", keys + ", segment, side", ident)},
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY segment, side, line, x1, y1, {ident}) AS seq FROM {name}_l)"""


def gutters(name: str, src: str, keys: str) -> str:
    on = " AND ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    return f"""{name}_p AS (SELECT {keys}, count(*) AS n, max(x2) - min(x1) AS span, list_sort(list(y2 - y1))[count(*) // 2 + 1] AS med FROM {src} GROUP BY {keys}),
{name}_n AS (SELECT s.*, greatest(12, 2 * CASE WHEN med = 0 THEN 1 ELSE med END) AS fl, max(x2) OVER (PARTITION BY {", ".join("s." + k for k in keys.split(", "))} ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
  FROM {src} s JOIN {name}_p g ON {on} WHERE n >= 3 AND span > 0 AND 10 * (x2 - x1) <= 6 * span),
{name}_g AS (SELECT {keys}, (x1 + pe) / 2.0 AS gutter FROM {name}_n WHERE x1 - pe > fl QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY x1 - pe DESC, x1) = 1),
{name} AS (SELECT {", ".join("s." + k for k in keys.split(", "))}, gutter FROM {name}_p s LEFT JOIN {name}_g g ON {on})"""


def claimed(boxes: str = "boxes", frames: str = "frames") -> str:
    return f"""pr AS (SELECT b.page, b.box_id, f.frame_id, greatest(b.x1, f.x1) AS s, least(b.x2, f.x2) AS e FROM {boxes} b JOIN {frames} f ON b.page = f.page
  AND b.y1 + b.y2 BETWEEN 2 * f.y1 - greatest(4, b.y2 - b.y1) AND 2 * f.y2 + greatest(4, b.y2 - b.y1) AND least(b.x2, f.x2) > greatest(b.x1, f.x1)),
un AS (SELECT page, box_id, sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS covered FROM (SELECT *, max(e) OVER (PARTITION BY page, box_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM pr) GROUP BY page, box_id),
wn AS (SELECT page, box_id, frame_id FROM pr QUALIFY row_number() OVER (PARTITION BY page, box_id ORDER BY e - s DESC, frame_id) = 1),
cl AS (SELECT b.*, CASE WHEN 2 * covered >= greatest(1, x2 - x1) THEN wn.frame_id ELSE -1 END AS frame_id FROM {boxes} b LEFT JOIN wn USING (page, box_id) LEFT JOIN un USING (page, box_id))"""


TWO_COLUMN_SIDE = f"CASE WHEN 100 * (x2 - x1) >= 55 * {WIDTH} OR (2 * x1 < {WIDTH} AND 2 * x2 > {WIDTH} AND 10 * abs(x1 + x2 - {WIDTH}) <= {WIDTH}) THEN 2 WHEN x1 + x2 < {WIDTH} THEN 0 ELSE 1 END"
GUTTER_SIDE = "CASE WHEN gutter IS NULL OR x2 <= gutter THEN 0 WHEN x1 >= gutter THEN 1 ELSE 2 END"


def zones(name: str, src: str) -> str:
    """CTE with seq of frames in two-column order, by walking the sorted walls."""
    return f"""{name}_w AS (SELECT *, 100 * x1 <= 8 * {WIDTH} AND 100 * x2 >= 92 * {WIDTH} AS wall FROM {src}),
{name}_z AS (SELECT a.*, (SELECT count(*) FROM {name}_w w WHERE w.page = a.page AND w.wall AND CASE WHEN a.wall THEN (w.y1, w.x1, w.frame_id) < (a.y1, a.x1, a.frame_id) ELSE 2 * w.y1 < a.y1 + a.y2 END) AS zone FROM {name}_w a),
{name} AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY zone, CASE WHEN wall THEN 2 WHEN x1 + x2 < {WIDTH} THEN 0 ELSE 1 END, y1, x1, frame_id) AS seq FROM {name}_z)"""


def greedy(name: str, src: str) -> str:
    """CTEs that walk a page's boxes by falling score, carrying the kept ones: name has the kept boxes."""
    box = "{'i': r.box_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}"
    hit = f"len(list_filter(f.kept, lambda k: {AREA.format(p='r.')} + {AREA.format(p='k.')} - {COMMON.format(a='r.', b='k.')} > 0 AND 2 * ({COMMON.format(a='r.', b='k.')}) >= {AREA.format(p='r.')} + {AREA.format(p='k.')} - {COMMON.format(a='r.', b='k.')})) > 0"
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id) AS rn FROM {src}),
{name}_f AS (SELECT r.page, r.rn, r.box_id, true AS keep, [{box}] AS kept FROM {name}_r r WHERE rn = 1
  UNION ALL SELECT r.page, r.rn, r.box_id, NOT ({hit}), CASE WHEN {hit} THEN f.kept ELSE list_append(f.kept, {box}) END FROM {name}_f f JOIN {name}_r r ON r.page = f.page AND r.rn = f.rn + 1),
{name} AS (SELECT r.* EXCLUDE (rn) FROM {name}_r r JOIN {name}_f f ON r.page = f.page AND r.box_id = f.box_id WHERE f.keep)"""


CONTAINED = f"""kc AS (SELECT * FROM boxes a WHERE {AREA.format(p="a.")} > 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND {AREA.format(p="b.")} > {AREA.format(p="a.")} AND 10 * ({COMMON.format(a="a.", b="b.")}) >= 7 * ({AREA.format(p="a.")})))"""
FINAL = ", ".join(
    [
        BOXES, FRAMES, claimed(), zones("fo", "frames"), "ins AS (SELECT * FROM cl WHERE frame_id >= 0)", gutters("gi", "ins", "page, frame_id"),
        "ig AS (SELECT ins.*, gutter FROM ins JOIN gi USING (page, frame_id))", sided("so", "ig", "page, frame_id", "y1, box_id", GUTTER_SIDE), "outs AS (SELECT * FROM cl WHERE frame_id < 0)", sided("oo", "outs", "page", "y1, x1, box_id", TWO_COLUMN_SIDE),
    ]
)
TRIM = "regexp_replace({t}, '^[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+$', '', 'g')"
MOST = "coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split({t}, '')) AS c) WHERE c <> ' ' AND c <> '' GROUP BY c)), 0)"


def runs(src: str) -> str:
    """CTE rn_: longest run of one character in each row of src (doc_id, line_no, text), by islands."""
    return f"""ch AS (SELECT doc_id, line_no, i, text[i] AS c FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM {src})),
isl AS (SELECT doc_id, line_no, c, i - row_number() OVER (PARTITION BY doc_id, line_no, c ORDER BY i) AS g FROM ch),
rn_ AS (SELECT doc_id, line_no, max(n) AS run FROM (SELECT doc_id, line_no, c, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
mf_ AS (SELECT doc_id, line_no, max(n) AS most FROM (SELECT doc_id, line_no, c, count(*) AS n FROM ch WHERE c <> ' ' GROUP BY ALL) GROUP BY ALL)"""


def share(v: str, default: float) -> str:
    return f"CASE WHEN {v} IS NULL THEN {default} WHEN {v} >= 1 THEN {v} / 100 WHEN {v} > 0 THEN floor({v} * 100 + 0.5) / 100 ELSE 0.0 END"


def pick(i: int, values) -> str:
    return "CAST(([" + ", ".join("NULL" if v is None else f"CAST('{v}' AS DOUBLE)" for v in values) + f"])[p_partkey * {i} % {len(values)} + 1] AS DOUBLE)"


_PICKS = ", ".join(f"{pick(i, v)} AS {c}" for i, v, c in zip((1, 3, 5, 7, 11, 13), RAW_SETTINGS, "abcdef", strict=True))
#: Settings as stored, and without numbers that are not finite.
STORED = f"raw AS (SELECT p_partkey, {_PICKS} FROM part)"
SETTINGS = STORED + ", st AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in "abcdef") + " FROM raw)"
SPEC = """sp AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey || ',' || p_partkey % 9 || '-' || p_partkey % 4 WHEN 1 THEN ' ' || p_partkey % 8 || '~' || (p_partkey % 8 + 3) || ' foo 2' WHEN 2 THEN '' WHEN 3 THEN '0,1,10,11,foo,2-2' WHEN 4 THEN '7 - 9' ELSE 'abc' END AS spec,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 10 END AS n, p_partkey % 10 + 1 AS cur FROM part),
tk AS (SELECT p_partkey, n, unnest(CASE WHEN trim(spec) = '' THEN [CAST(cur AS VARCHAR)] ELSE regexp_split_to_array(trim(spec), '[,\\s]+') END) AS t FROM sp),
rg AS (SELECT p_partkey, n, CAST(regexp_extract(t, '^(\\d+)', 1) AS BIGINT) AS a, CAST(regexp_extract(t, '(\\d+)$', 1) AS BIGINT) AS b FROM tk WHERE regexp_matches(t, '^\\d+([-\\x{2013}~]\\d+)?$')),
pg AS (SELECT DISTINCT p_partkey, unnest(range(greatest(1, least(a, b)), CASE WHEN n > 0 THEN least(n, greatest(a, b)) ELSE greatest(a, b) END + 1)) AS p FROM rg)"""
#: Marked blocks by depth: tokens, running depth, the first return to zero.
_A = f"'/{MARK} BMC BT (' || page_id || ') Tj ET EMC '"
CONTENT = f"""ct AS (SELECT page_id AS page, 'q ' || page_id || ' cm ' || CASE page_id % 5 WHEN 1 THEN {_A} WHEN 2 THEN '/{MARK} BMC /Tx BMC (' || page_id || ') /Sp <<>> BDC x EMC EMC y EMC /Im Do ' || {_A}
  WHEN 3 THEN {_A} || '/Keep BMC k EMC /{MARK} BMC open ' ELSE '/Keep BMC k EMC ' END || 'Q' AS content FROM pages)"""
STRIP = f"""it AS (SELECT page, content AS rest, '' AS done, 0 AS found FROM ct
  UNION ALL SELECT page, substr(rest, close_at), done || substr(rest, 1, open_at - 1), found + 1 FROM (
    SELECT page, rest, done, found, open_at, coalesce((SELECT min(e) FROM (SELECT e, sum(d) OVER (ORDER BY e) AS depth FROM (
      SELECT open_at + instr_at AS e, d FROM (SELECT unnest(range(0, length(rest) - open_at + 2)) AS instr_at), (VALUES (1, 'BMC'), (1, 'BDC'), (-1, 'EMC')) v(d, w)
      WHERE substr(rest, open_at + instr_at - 3, 3) = w AND instr_at >= 3)) WHERE depth = 0), length(rest) + 1) AS close_at
    FROM (SELECT *, instr(rest, '/{MARK} BMC') AS open_at FROM it WHERE instr(rest, '/{MARK} BMC') > 0)))"""
#: Points of each readable shape of an annotation, by its key modulo 8; the others have none.
BBOX = """an AS (SELECT o_orderkey AS key, o_orderkey % 700 AS item, ['image', 'ink', 'note'][o_custkey % 3 + 1] AS type, o_orderkey % 700 % 2 = 0 AS shown, o_orderkey % 3 AS page, o_orderkey % 8 AS k,
  o_orderkey % 90 AS a, o_custkey % 70 AS b, o_orderkey % 31 + 5 AS c, o_custkey % 17 + 9 AS d FROM orders),
bb AS (SELECT *, CAST(least(a, c, CASE WHEN k = 1 THEN 1 ELSE a END) AS DOUBLE) AS x1, CAST(least(b, d, CASE WHEN k = 1 THEN 2 ELSE b END) AS DOUBLE) AS y1, CAST(greatest(a, c) AS DOUBLE) AS x2, CAST(greatest(b, d, CASE WHEN k = 1 THEN 2 ELSE b END) AS DOUBLE) AS y2 FROM an WHERE k IN (0, 1, 4, 5, 7))"""
ALLOWED = "(({b} = 'queued' AND {a} IN ('running', 'cancelled')) OR ({b} = 'running' AND {a} IN ('completed', 'failed', 'cancelled')))"
CARDS = """cd AS (SELECT user_id AS task_id, ts, event_id, CASE WHEN event_id % 29 = 0 THEN 'failed' WHEN event_id % 31 = 0 THEN 'completed' ELSE 'running' END AS status, CAST(floor(value) AS BIGINT) - 40 AS percent,
  CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS message, event_type = 'click' AS alloc FROM events),
lv AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN status <> 'running' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM cd) WHERE done = 0)"""


def oracle_sql() -> dict[str, str]:
    W = "WITH "
    R = "WITH RECURSIVE "
    o: dict[str, str] = {}
    o["box_area_iou"] = W + BOXES + f""" SELECT a.page, a.box_id, {AREA.format(p="a.")} AS area, {COMMON.format(a="a.", b="b.")} AS common, {AREA.format(p="a.")} + {AREA.format(p="b.")} - {COMMON.format(a="a.", b="b.")} AS either FROM boxes a JOIN boxes b ON a.page = b.page AND b.box_id = a.box_id + 1"""
    o["containment_anti"] = f"{W}{BOXES}, {CONTAINED} SELECT page, box_id, score FROM kc"
    o["greedy_iou"] = f"{R}{BOXES}, {greedy('gr', 'boxes')} SELECT page, box_id, score FROM gr"
    o["nms_order"] = f"{R}{BOXES}, {CONTAINED}, {greedy('gr', 'kc')}, {fold('ln', 'gr', 'page')} SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY line, x1, y1, box_id) AS seq FROM ln"
    o["line_cluster"] = f"{R}{BOXES}, {fold('ln', 'boxes', 'page')} SELECT page, box_id, line FROM ln"
    o["reading_order"] = f"{R}{BOXES}, {fold('ln', 'boxes', 'page')} SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY line, x1, y1, box_id) AS seq FROM ln"
    o["two_column_order"] = f"{R}{BOXES}, {sided('tc', 'boxes', 'page', 'y1, x1, box_id', TWO_COLUMN_SIDE)} SELECT page, box_id, seq FROM tc"
    o["gutter_search"] = f"{W}{BOXES}, {BLOCKS}, {gutters('gt', 'blocks', 'page')} SELECT page, gutter FROM gt"
    o["stacked_order"] = f"{R}{BOXES}, {BLOCKS}, {gutters('gt', 'blocks', 'page')}, bg AS (SELECT blocks.*, gutter FROM blocks JOIN gt USING (page)), {sided('st', 'bg', 'page', 'y1, box_id', GUTTER_SIDE)} SELECT page, box_id, seq FROM st"
    o["frame_bands"] = f"{R}{FRAMES}, {fold('bn', 'frames', 'page', 'frame_id', 'greatest(1, r.y2 - r.y1)')} SELECT page, frame_id, row_number() OVER (PARTITION BY page ORDER BY line, x1, y1, frame_id) AS seq FROM bn"
    o["frame_zones"] = f"{W}{FRAMES}, {zones('zn', 'frames')} SELECT page, frame_id, seq FROM zn"
    o["frame_claim"] = f"{W}{BOXES}, {FRAMES}, {claimed()} SELECT page, box_id, frame_id FROM cl"
    o["interval_union"] = f"{W}{BOXES} SELECT page, sum(greatest(0, x2 - greatest(x1, coalesce(pe, x1)))) AS covered FROM (SELECT *, max(x2) OVER (PARTITION BY page ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM boxes) GROUP BY page"
    marks = f"""sd AS (SELECT page, box_id, x1, y1, CASE WHEN frame_id >= 0 THEN 'in' ELSE 'out' END AS cls FROM cl), wr AS (SELECT DISTINCT page, x1, y1, cls FROM sd JOIN rd USING (page, box_id, x1, y1) WHERE text IS NOT NULL),
      mk AS (SELECT page, box_id, cls FROM sd UNION ALL SELECT page, box_id, 'norec' FROM sd s WHERE NOT EXISTS (SELECT 1 FROM wr WHERE wr.page = s.page AND wr.x1 = s.x1 AND wr.y1 = s.y1 AND wr.cls = s.cls))"""
    o["frame_partition"] = f"{W}{BOXES}, {FRAMES}, {READ}, {claimed()}, {marks} SELECT page, box_id, cls FROM mk"
    o["class_counts"] = f"{W}{BOXES}, {FRAMES}, {READ}, {claimed()}, {marks} SELECT page, " + ", ".join(f"count(*) FILTER (cls = '{c}') AS n_{c}" for c in ("in", "out", "norec")) + " FROM mk GROUP BY page"
    o["page_final_order"] = f"{R}{FINAL} SELECT page, box_id, frame_id, row_number() OVER (PARTITION BY page ORDER BY f, s) AS seq FROM (SELECT so.page, so.box_id, so.frame_id, fo.seq AS f, so.seq AS s FROM so JOIN fo ON fo.page = so.page AND fo.frame_id = so.frame_id UNION ALL SELECT page, box_id, frame_id, 1000000000, seq FROM oo)"
    o["column_backtrack"] = f"""{R}{BOXES}, {fold('ln', 'boxes', 'page')}, q AS (SELECT *, lag(y1 + y2) OVER w AS py, lag(x1 + x2) OVER w AS px FROM ln WINDOW w AS (PARTITION BY page ORDER BY line, x1, y1, box_id))
      SELECT page, count(*) FILTER (y1 + y2 >= py - 4 AND x1 + x2 < px - 2 * (x2 - x1)) AS backtracks FROM q GROUP BY page"""
    o["missed_anti"] = f"{W}{BOXES}, {READ} SELECT page, box_id FROM rd a WHERE NOT EXISTS (SELECT 1 FROM rd b WHERE b.text IS NOT NULL AND b.page = a.page AND b.x1 = a.x1 AND b.y1 = a.y1)"
    o["reread_merge"] = f"""{W}{BOXES}, {READ}, ra AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY page, x1, y1 ORDER BY box_id) = 1),
      ag AS (SELECT page, x1 + box_id % 2 AS x1, y1, repeat('z', CAST(box_id % 13 AS INTEGER)) AS text FROM ra WHERE box_id % 4 = 0), ab AS (SELECT * FROM ag QUALIFY row_number() OVER (PARTITION BY page, x1, y1 ORDER BY text) = 1),
      fr AS (SELECT * FROM ab WHERE text <> '') SELECT coalesce(ra.page, fr.page) AS page, coalesce(ra.x1, fr.x1) AS x1, coalesce(ra.y1, fr.y1) AS y1,
      CASE WHEN ra.text IS NULL OR coalesce(length(fr.text) > length(trim(ra.text)), false) THEN coalesce(fr.text, ra.text) ELSE ra.text END AS text FROM ra FULL JOIN fr ON ra.page = fr.page AND ra.x1 = fr.x1 AND ra.y1 = fr.y1"""
    sparse = "2 * length(trim(coalesce(text, ''))) * greatest(1, y2 - y1) < x2 - x1"
    o["top8_suspects"] = f"{W}{BOXES}, {READ} SELECT page, box_id FROM rd WHERE {sparse} QUALIFY row_number() OVER (PARTITION BY page ORDER BY box_id) <= 8"
    whole = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"
    tenth, quarter = "CAST(x2 - x1 AS DOUBLE) * CAST(0.1 AS DOUBLE)", "CAST(y2 - y1 AS DOUBLE) * CAST(0.25 AS DOUBLE)"
    pad = {"x1": f"greatest(0, {whole(f'x1 - {tenth}')})", "y1": f"greatest(0, {whole(f'y1 - {quarter}')})", "x2": f"least({WIDTH}, {whole(f'x2 + {tenth}')})", "y2": f"least(1600, {whole(f'y2 + {quarter}')})"}
    o["rescue_pad_scale"] = f"{W}{BOXES} SELECT page, box_id, " + ", ".join(f"{v} * 2 AS p_{k}" for k, v in pad.items()) + " FROM boxes WHERE score < 0.1"
    o["ctc_collapse"] = f"{W}{STEPS}, {EMIT} SELECT seq_id, t, cls, ch FROM em"
    o["ctc_spaces"] = f"""{W}{STEPS}, {EMIT}, e1 AS (SELECT *, row_number() OVER w AS i, length(ch) = 1 AND ascii(ch) BETWEEN 33 AND 126 AS solid, lag(ch) OVER w AS pch, lag(t) OVER w AS pt FROM em WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
      e2 AS (SELECT *, CASE WHEN solid AND length(pch) = 1 AND ascii(pch) BETWEEN 33 AND 126 THEN t - pt END AS gap FROM e1),
      ct AS (SELECT seq_id, CASE WHEN count(gap) >= 8 THEN list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] * CAST(1.55 AS DOUBLE) END AS cut FROM e2 GROUP BY seq_id),
      e3 AS (SELECT e2.*, cut, (SELECT max(sp) FROM best b WHERE b.seq_id = e2.seq_id AND b.t >= e2.pt AND b.t < e2.t) AS sp FROM e2 JOIN ct USING (seq_id))
      SELECT seq_id, coalesce(text, '') AS text FROM (SELECT DISTINCT seq_id FROM best) LEFT JOIN (SELECT seq_id, string_agg(CASE WHEN gap IS NOT NULL AND (coalesce(ch NOT IN ('m', 'w', 'M', 'W') AND pch NOT IN ('m', 'w', 'M', 'W') AND gap >= cut, false) OR coalesce(sp >= 0.1, false)) THEN ' ' ELSE '' END || ch, '' ORDER BY i) AS text FROM e3 GROUP BY seq_id) USING (seq_id)"""
    o["garbage_text"] = f"""{W}{LINES}, tr AS (SELECT doc_id, line_no, {TRIM.format(t="text")} AS text FROM tl), {runs("tr")}
      SELECT doc_id, line_no, coalesce(length(text) = 0 OR (run >= 4 AND 3 * run >= length(text)) OR (length(replace(text, ' ', '')) >= 6 AND 2 * most >= length(replace(text, ' ', ''))) OR (length(regexp_replace(text, '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) < 2 AND length(text) >= 4), true) AS garbage
      FROM tr LEFT JOIN rn_ USING (doc_id, line_no) LEFT JOIN mf_ USING (doc_id, line_no)"""
    o["char_share"] = f"{W}{LINES}, {runs('tl')} SELECT doc_id, line_no, coalesce(most, 0) AS most FROM tl LEFT JOIN mf_ USING (doc_id, line_no)"
    o["max_run"] = f"{W}{LINES}, {runs('tl')} SELECT doc_id, line_no, coalesce(run, 0) AS run FROM tl LEFT JOIN rn_ USING (doc_id, line_no)"
    o["low_density"] = f"{W}{BOXES}, {READ} SELECT page, box_id, {sparse} AS sparse FROM rd"
    o["font_runs"] = f"""{W}{LINES}, c AS (SELECT doc_id, line_no, i, text[i] AS c, ord(text[i]) < 128 AS latin FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM tl)),
      n AS (SELECT *, CASE WHEN lag(latin) OVER w = latin THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS run FROM n),
      r AS (SELECT doc_id, line_no, run, latin, string_agg(c, '' ORDER BY i) AS piece FROM g GROUP BY ALL)
      SELECT doc_id, line_no, run, latin, piece, coalesce(sum(length(piece) * CASE WHEN latin THEN 5 ELSE 10 END) OVER (PARTITION BY doc_id, line_no ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM r"""
    o["sanitize_log"] = "SELECT event_id, 'GET /x?user=' || user_id || '&' || CASE event_id % 5 WHEN 0 THEN 'token=***' WHEN 1 THEN 'apiKey=***' WHEN 2 THEN 'Password=***' WHEN 3 THEN 'page=v' || event_id ELSE 'mytoken=v' || event_id END || ' done' AS line FROM events"
    o["log_ring"] = "SELECT event_id AS seq, strftime(ts, '%H:%M:%S.%g') AS stamp, substr(event_type || ' ' || props, 1, 46) AS line FROM events ORDER BY event_id DESC LIMIT 2000"
    o["page_spec"] = f"{W}{SPEC} SELECT sp.p_partkey, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') AS pages FROM sp LEFT JOIN pg ON pg.p_partkey = sp.p_partkey GROUP BY sp.p_partkey"
    o["page_select"] = sel = "SELECT DISTINCT o_orderkey % 50 AS doc, o_custkey % 12 - 1 AS page FROM orders WHERE o_custkey % 12 - 1 BETWEEN 0 AND (o_orderkey % 50) % 7 + 2"
    o["prefs_parse"] = f"""{W}{SETTINGS} SELECT p_partkey, CAST(CASE WHEN a >= 1 THEN floor(a + 0.5) ELSE 1536 END AS BIGINT) AS limit_side, {share("b", 0.3)} AS det_thresh, {share("c", 0.4)} AS box_thresh,
      CAST(CASE WHEN d IS NULL THEN 30 ELSE least(90, greatest(0, floor(d + 0.5))) END AS BIGINT) AS max_rot, CAST(CASE WHEN e IN (0, 1, 2) THEN e ELSE 2 END AS BIGINT) AS crop_mode, CAST(CASE WHEN f >= 1 AND f = floor(f) THEN least(8, f) ELSE 4 END AS BIGINT) AS workers FROM st"""
    size = lambda v: f"greatest(1, CAST(floor({v} * least(CAST(1 AS DOUBLE), CAST(1536 AS DOUBLE) / greatest(w, h)) / 32 + 0.5) * 32 AS BIGINT))"
    o["det_resize_plan"] = f"SELECT p_partkey, {size('w')} AS width, {size('h')} AS height, {size('w')} / CAST(w AS DOUBLE) AS scale_x, {size('h')} / CAST(h AS DOUBLE) AS scale_y FROM (SELECT p_partkey, p_size * 97 + 3 AS w, (p_partkey * 31) % 2900 + 5 AS h FROM part)"
    o["rec_resize_plan"] = f"{W}{BOXES} SELECT page, box_id, greatest(4, CAST(ceil(48 * (CAST(x2 - x1 AS DOUBLE) / CAST(y2 - y1 AS DOUBLE))) AS BIGINT)) AS width FROM boxes"
    o["tilt_filter"] = f"""{W}{BOXES}, t AS (SELECT *, abs(degrees(atan2(CAST(y1 % 400 - 200 AS DOUBLE), CAST(x2 - x1 AS DOUBLE)))) AS deg, sqrt(CAST((x2 - x1) * (x2 - x1) + (y1 % 400 - 200) * (y1 % 400 - 200) AS DOUBLE)) < CAST(1.5 AS DOUBLE) * (y2 - y1) AS square FROM boxes)
      SELECT page, box_id, round(least(deg, 180 - deg), 6) AS tilt FROM t WHERE square OR round(least(deg, 180 - deg), 6) <= 30"""
    o["threshold_dilate"] = f"{W}{PIXELS}, {MASK} SELECT page, y, x FROM mask"
    o["components"] = f"{R}{PIXELS}, {MASK}, {PARTS} SELECT page, y, x, comp FROM parts"
    o["component_stats"] = f"""{R}{PIXELS}, {MASK}, {PARTS} SELECT page, comp, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS n, CAST(CAST(round(sum(coalesce(p, 0)) * 1000) AS BIGINT) AS DOUBLE) / CAST(count(*) * 1000 AS DOUBLE) AS score FROM parts LEFT JOIN px USING (page, y, x) GROUP BY page, comp
      HAVING max(x) - min(x) + 1 >= 3 AND max(y) - min(y) + 1 >= 3"""
    o["polygon_area"] = """WITH v AS (SELECT l_orderkey % 97 AS poly, l_partkey % 12 AS i, min(l_suppkey) AS x, max(l_linenumber) AS y FROM lineitem GROUP BY ALL),
      e AS (SELECT poly, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v FROM v WINDOW w AS (PARTITION BY poly ORDER BY i))
      SELECT poly, round(sum(CAST(x * v - u * y AS DOUBLE)) / 2, 4) AS area, round(sum(sqrt(CAST((u - x) * (u - x) + (v - y) * (v - y) AS DOUBLE))), 4) AS perimeter FROM e GROUP BY poly"""
    o["placement"] = f"""{W}{BOXES}, {READ}, m AS (SELECT *, CAST(x2 - x1 AS DOUBLE) / 2 AS w, CAST(y2 - y1 AS DOUBLE) / 2 AS h FROM rd WHERE trim(text) <> '')
      SELECT page, box_id, round(x1 / CAST(2 AS DOUBLE), 6) AS x, round(800 - y2 / CAST(2 AS DOUBLE) + greatest(h, 1) * CAST(0.2 AS DOUBLE), 6) AS y, round(greatest(h, 1), 6) AS font_size, round(w / (length(text) * CAST(0.5 AS DOUBLE) * greatest(h, 1)), 6) AS sx FROM m WHERE w >= 1 AND h >= 1"""
    o["marker_strip"] = f"{R}{CONTENT}, {STRIP} SELECT page, done || rest AS stripped, found FROM it QUALIFY row_number() OVER (PARTITION BY page ORDER BY found DESC) = 1"
    o["page_restore"] = f"{W}{CONTENT} SELECT page, CASE WHEN page % 3 <> 0 AND page % 2 = 1 THEN 'old ' || page ELSE content END AS content, page % 3 <> 0 AND page % 2 = 1 AS restored FROM ct"
    o["selection_resolve"] = f"""{W}{ITEMS}, ch AS (SELECT * FROM items WHERE (id // 2) % 2 = 1), c AS (SELECT * FROM ch WHERE is_attachment UNION SELECT * FROM items WHERE is_attachment AND parent_id IN (SELECT id FROM ch WHERE NOT is_attachment))
      SELECT id, CASE WHEN {IS_DERIVED} THEN 'skipped' WHEN coalesce(path, '') = '' THEN 'unavailable' ELSE 'job' END AS disposition FROM c WHERE {IS_DOC}"""
    o["siblings"] = f"""{W}{ITEMS}, a AS (SELECT *, {IS_DERIVED} AS der, {IS_DOC} AS doc FROM items WHERE is_attachment) SELECT x.id, min(y.id) FILTER (y.der) AS derived_sibling, min(y.id) FILTER (y.doc AND NOT y.der) AS source_sibling
      FROM a x LEFT JOIN a y ON x.parent_id = y.parent_id AND x.id <> y.id WHERE x.parent_id IS NOT NULL GROUP BY x.id"""
    o["attach"] = f"""{W}{ITEMS}, {REQUESTS} SELECT req.id, CASE WHEN i.parent_id IS NOT NULL THEN req.title || ' [OCR]' END AS title, i.parent_id, i.library_id,
      CASE WHEN i.id IS NULL THEN 'item_not_found' WHEN i.parent_id IS NULL THEN 'standalone_attachment' ELSE 'sibling_imported' END AS status FROM req LEFT JOIN items i ON i.id = req.id"""
    o["attach_parent"] = f"""{W}{ITEMS}, {REQUESTS} SELECT req.id, i.library_id, CASE WHEN i.id IS NULL THEN 'item_not_found' ELSE 'parent_created' END AS status,
      CASE WHEN i.id IS NOT NULL THEN (SELECT max(id) FROM items) + count(i.id) OVER (ORDER BY req.id) END AS parent_id, CASE WHEN i.id IS NOT NULL THEN req.title || ' [OCR]' END AS title FROM req LEFT JOIN items i ON i.id = req.id"""
    o["annotation_bbox"] = f"{W}{BBOX} SELECT key, x1, y1, x2, y2 FROM bb"
    o["page_regions"] = f"""{W}{BBOX}, av AS (SELECT DISTINCT item FROM an WHERE shown), us AS (SELECT * FROM bb WHERE shown UNION ALL SELECT * FROM bb WHERE item NOT IN (SELECT item FROM av))
      SELECT item, page, x1, y1, x2, y2 FROM us WHERE type IN ('image', 'ink') AND page = item % 3"""
    o["job_transitions"] = f"{W}{LOG}, b AS (SELECT *, lag(status, 1, 'queued') OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM jl) SELECT job_id, event_id, before, status, {ALLOWED.format(b='before', a='status')} AS valid FROM b"
    o["job_states"] = f"""{R}{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM jl), m AS (
      SELECT job_id, 0 AS rn, 'queued' AS s, 0 AS bad FROM (SELECT DISTINCT job_id FROM r) UNION ALL SELECT m.job_id, r.rn, CASE WHEN {ALLOWED.format(b="m.s", a="r.status")} THEN r.status ELSE m.s END, m.bad + CASE WHEN {ALLOWED.format(b="m.s", a="r.status")} THEN 0 ELSE 1 END FROM m JOIN r ON r.job_id = m.job_id AND r.rn = m.rn + 1)
      SELECT job_id, s AS status, bad AS rejected FROM m QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) = 1"""
    o["serial_queue"] = """WITH RECURSIVE q AS (SELECT event_id AS job_id, user_id % 8 AS queue, epoch_us(ts) // 1000 AS arrival, CAST(floor(value) AS BIGINT) * 1000 AS duration FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY arrival, job_id) AS rn FROM q),
      f AS (SELECT job_id, queue, rn, arrival AS start, arrival + duration AS finish FROM r WHERE rn = 1 UNION ALL SELECT r.job_id, r.queue, r.rn, greatest(r.arrival, f.finish), greatest(r.arrival, f.finish) + r.duration FROM f JOIN r ON r.queue = f.queue AND r.rn = f.rn + 1) SELECT job_id, queue, start, finish FROM f"""
    o["task_state"] = f"""{W}{CARDS} SELECT task_id, arg_max(least(100, percent), (ts, event_id)) FILTER (percent >= 0) AS percent, arg_max(message, (ts, event_id)) FILTER (trim(message) <> '') AS message, epoch_us(min(ts) FILTER (alloc)) AS started, max(status) FILTER (status <> 'running') AS final FROM lv GROUP BY task_id"""
    o["elapsed_format"] = """WITH s AS (SELECT event_id, greatest(0, CAST(floor((CAST(floor(value * 20000) AS BIGINT) - 3000) / CAST(1000 AS DOUBLE)) AS BIGINT)) AS s FROM events)
      SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || ' h ' || (s % 3600) // 60 || ' min ' || s % 60 || ' s' WHEN s >= 60 THEN s // 60 || ' min ' || s % 60 || ' s' ELSE s || ' s' END AS elapsed FROM s"""
    o["union_parts"] = f"{W}{BOXES}, {FRAMES}, {claimed()} SELECT page, box_id, CASE WHEN frame_id >= 0 THEN 0 ELSE 1 END AS part, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN frame_id >= 0 THEN 0 ELSE 1 END, box_id) AS seq FROM cl"
    o["text_index"] = "SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_words FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term"
    o["progress"] = f"SELECT doc, page, round(row_number() OVER (PARTITION BY doc ORDER BY page) * CAST(100 AS DOUBLE) / count(*) OVER (PARTITION BY doc), 6) AS percent FROM ({sel})"
    o["frame_points"] = f"{W}{FRAMES}, p AS (SELECT page, frame_id, least(2600, x1 * 2) AS p_x1, greatest(0, least(3000, 3000 - y2 * 2)) AS p_y1, least(2600, x2 * 2) AS p_x2, greatest(0, least(3000, 3000 - y1 * 2)) AS p_y2 FROM frames) SELECT * FROM p WHERE p_x2 > p_x1 AND p_y2 > p_y1"
    clip = lambda x: f"greatest(0.0, least(1.0, ({x} - x1) / CAST(x2 - x1 AS DOUBLE)))"
    o["clip_text"] = f"""{W}{BOXES}, {READ}, c AS (SELECT page, box_id, coalesce(text, '') AS text, {clip("greatest(x1, 300)")} AS a, {clip("least(x2, 900)")} AS b FROM rd)
      SELECT page, box_id, CASE WHEN b > a THEN trim(substr(text, CAST(floor(a * length(text) + 0.5) AS BIGINT) + 1, CAST(floor(b * length(text) + 0.5) - floor(a * length(text) + 0.5) AS BIGINT))) ELSE '' END AS piece FROM c"""
    o["title_fallback"] = f"{W}{ITEMS} SELECT id, replace(replace(CASE WHEN id % 5 <> 0 THEN title || ' <&>' ELSE string_split(path, '/')[-1] END, '&', '&amp;'), '<', '&lt;') AS title FROM items"
    o["message_lookup"] = """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'zh' ELSE 'en' END AS lang, CASE event_type WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN user_id || ': ' || event_id ELSE event_id || ' views of ' || user_id END
      WHEN 'click' THEN 'clicked ' || event_id WHEN 'error' THEN 'failed' ELSE event_type END AS text FROM events"""
    o["active_jobs"] = f"""{o["job_states"].rsplit("SELECT job_id, s AS status", 1)[0].rstrip()}, js AS (SELECT job_id, s AS status FROM m QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) = 1)
      SELECT min(event_id) AS job_id, event_id % 400 AS attachment_id FROM events WHERE event_id % 400 NOT IN (SELECT job_id * 3 FROM js WHERE status IN ('queued', 'running')) GROUP BY event_id % 400"""
    parts, by_comp = o["component_stats"].rsplit("SELECT page, comp, min(x)", 1)
    stats = parts.rstrip() + ", cs AS (SELECT page, comp, min(x)" + by_comp + ")"
    back = lambda x, scale, most: f"CAST(floor(least({most} - 1, greatest(0, ({x}) * (1 / CAST({scale} AS DOUBLE)))) + 0.5) AS BIGINT)"
    o["upright_boxes"] = f"""{stats}, bx AS (SELECT cs.page, comp, x1, y1, x2, y2, (SELECT coalesce(sum(p), 0) FROM px WHERE px.page = cs.page AND px.x BETWEEN x1 AND x2 AND px.y BETWEEN y1 AND y2) / CAST((x2 - x1 + 1) * (y2 - y1 + 1) AS DOUBLE) AS score FROM cs),
      g AS (SELECT *, (x2 - x1 + 1) * (y2 - y1 + 1) * CAST(1.6 AS DOUBLE) / (2 * (x2 - x1 + 1 + y2 - y1 + 1)) AS d FROM bx WHERE score >= CAST('0.2000001' AS DOUBLE))
      SELECT page, comp, {back("x1 - d", 0.5, 90)} AS p0, {back("y1 - d", 0.25, 180)} AS p1, {back("x2 + 1 + d", 0.5, 90)} AS p4, {back("y2 + 1 + d", 0.25, 180)} AS p5,
      {back("x1", 0.5, 90)} AS x1, {back("y1", 0.25, 180)} AS y1, {back("x2 + 1", 0.5, 90)} AS x2, {back("y2 + 1", 0.25, 180)} AS y2, round(score, 9) AS score FROM g"""
    w, h = RASTER_W, RASTER_H
    cell = lambda y, x: f"CAST((page * 7 + ({y}) * 31 + ({x}) * 17 + ch * 5 + page * ((({y}) * {w} + ({x})) % 5)) % 256 AS DOUBLE)"

    def mixed(src: str) -> str:
        """v of rows (page, ch, fx, fy): the colour there, by its four neighbours."""
        return f"""SELECT *, ({cell("y0", "x0")} + ({cell("y0", "xr")} - {cell("y0", "x0")}) * (fx - x0)) AS t, ({cell("yb", "x0")} + ({cell("yb", "xr")} - {cell("yb", "x0")}) * (fx - x0)) AS u
          FROM (SELECT *, least(x0 + 1, {w - 1}) AS xr, least(y0 + 1, {h - 1}) AS yb FROM (SELECT *, CAST(floor(fx) AS BIGINT) AS x0, CAST(floor(fy) AS BIGINT) AS y0 FROM {src}))"""

    scaled = lambda v: f"round(CAST(CAST(CAST({v} AS FLOAT) AS DOUBLE) / 255 * 2 - 1 AS DOUBLE), 5)"
    o["det_tensor"] = f"""WITH g AS (SELECT page, ch, y, x, x * ({w} / CAST(5 AS DOUBLE)) AS fx, y * ({h} / CAST(4 AS DOUBLE)) AS fy FROM (SELECT DISTINCT o_orderkey % 60 AS page FROM orders), range(3) c(ch), range(4) r(y), range(5) q(x)),
      m AS ({mixed("g")}) SELECT page, CAST(ch AS INTEGER) AS plane, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {scaled("t + (u - t) * (fy - y0)")} AS v FROM m"""
    q = lambda i: f"CAST(q[{i}] AS DOUBLE)"
    deg = lambda i: f"least(abs(degrees(atan2({q(i + 1)} - {q(2)}, {q(i)} - {q(1)}))), 180 - abs(degrees(atan2({q(i + 1)} - {q(2)}, {q(i)} - {q(1)}))))"
    length = lambda i: f"sqrt(({q(i)} - {q(1)}) * ({q(i)} - {q(1)}) + ({q(i + 1)} - {q(2)}) * ({q(i + 1)} - {q(2)}))"
    planned = lambda src: f"""pl AS (SELECT *, CASE WHEN warp THEN q[1] ELSE list_min([q[1], q[3], q[5], q[7]]) END AS crop_x, CASE WHEN warp THEN q[2] ELSE list_min([q[2], q[4], q[6], q[8]]) END AS crop_y,
      CASE WHEN warp THEN w ELSE list_max([q[1], q[3], q[5], q[7]]) - list_min([q[1], q[3], q[5], q[7]]) END AS crop_width, CASE WHEN warp THEN h ELSE list_max([q[2], q[4], q[6], q[8]]) - list_min([q[2], q[4], q[6], q[8]]) END AS crop_height
      FROM (SELECT *, CAST(floor({length(3)} + 0.5) AS BIGINT) AS w, CAST(floor({length(7)} + 0.5) AS BIGINT) AS h, CASE WHEN {length(3)} >= {length(7)} THEN {deg(3)} ELSE {deg(7)} END > 1.5 AS warp FROM {src}) WHERE w >= 2 AND h >= 2)"""  # noqa: E731
    o["reading_plan"] = f"""{W}{BOXES}, qd AS (SELECT page, box_id, [x1, y1, x2, y1 + lean, x2, low + lean, x1, low] AS q FROM (SELECT *, CASE WHEN box_id % 3 = 0 THEN box_id % 81 - 40 ELSE 0 END AS lean, CASE WHEN box_id % 11 = 0 THEN y1 + box_id % 4 ELSE y2 END AS low FROM boxes)), {planned("qd")}
      SELECT page, box_id, warp, crop_x, crop_y, crop_width, crop_height, greatest(4, CAST(ceil(48 * (CAST(crop_width AS DOUBLE) / CAST(crop_height AS DOUBLE))) AS BIGINT)) AS width FROM pl WHERE crop_width >= 2 AND crop_height >= 2"""
    o["crop_lines"] = f"""WITH pg AS (SELECT DISTINCT o_orderkey % 60 AS page FROM orders), qd AS (SELECT page, [page % 5 - 2, page % 3, page % 5 + 6, page % 3 + page % 4, page % 5 + 5, page % 4 + 6, page % 5 - 3, 6] AS q FROM pg), {planned("qd")},
      k AS (SELECT pl.*, ch, i, j FROM pl, range(3) c(ch), range(32) r(i), range(32) s(j) WHERE crop_width >= 2 AND crop_height >= 2 AND j < crop_width AND i < crop_height),
      uv AS (SELECT *, j / CAST(greatest(1, crop_width - 1) AS DOUBLE) AS u, i / CAST(greatest(1, crop_height - 1) AS DOUBLE) AS v FROM k),
      sm AS (SELECT *, CASE WHEN warp THEN {q(1)} + ({q(3)} - {q(1)}) * u ELSE crop_x + j END AS ax, CASE WHEN warp THEN {q(2)} + ({q(4)} - {q(2)}) * u ELSE crop_y + i END AS ay, {q(7)} + ({q(5)} - {q(7)}) * u AS ex, {q(8)} + ({q(6)} - {q(8)}) * u AS ey FROM uv),
      g AS (SELECT page, ch, i, j, crop_width, crop_height, greatest(0, least({w - 1}, CASE WHEN warp THEN ax + (ex - ax) * v ELSE ax END)) AS fx, greatest(0, least({h - 1}, CASE WHEN warp THEN ay + (ey - ay) * v ELSE ay END)) AS fy FROM sm),
      m AS ({mixed("g")}), cr AS (SELECT page, ch, i, j, crop_width, crop_height, round_even(t + (u - t) * (fy - y0), 0) AS v FROM m),
      z AS (SELECT page, ch, y, x, x * (crop_width / CAST(6 AS DOUBLE)) AS zx, y * (crop_height / CAST(4 AS DOUBLE)) AS zy, crop_width AS cw, crop_height AS chh FROM (SELECT DISTINCT page, ch, crop_width, crop_height FROM cr), range(4) r(y), range(6) s(x)),
      zz AS (SELECT *, CAST(floor(zx) AS BIGINT) AS x0, CAST(floor(zy) AS BIGINT) AS y0 FROM z), zn AS (SELECT *, least(x0 + 1, cw - 1) AS x1, least(y0 + 1, chh - 1) AS y1 FROM zz),
      f AS (SELECT zn.*, a.v AS va, b.v AS vb, c.v AS vc, d.v AS vd FROM zn JOIN cr a ON a.page = zn.page AND a.ch = zn.ch AND a.i = y0 AND a.j = x0 JOIN cr b ON b.page = zn.page AND b.ch = zn.ch AND b.i = y0 AND b.j = x1
        JOIN cr c ON c.page = zn.page AND c.ch = zn.ch AND c.i = y1 AND c.j = x0 JOIN cr d ON d.page = zn.page AND d.ch = zn.ch AND d.i = y1 AND d.j = x1)
      SELECT page, CAST(2 - ch AS INTEGER) AS plane, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {scaled("va + (vb - va) * (zx - x0) + ((vc + (vd - vc) * (zx - x0)) - (va + (vb - va) * (zx - x0))) * (zy - y0)")} AS v FROM f"""
    trimmed = "trim(coalesce(text, ''))"
    scaled_pad = ", ".join(f"{v} * 2 AS s_{k}" for k, v in pad.items())
    inputs = f"""{BOXES}, {FRAMES}, {READ}, {claimed()}, rf AS (SELECT page, box_id, text FROM rd WHERE trim(text) <> '' AND box_id % 7 <> 0),
      ra AS (SELECT page, x1, y1, repeat('z', CAST(box_id % 13 AS INTEGER)) AS text FROM boxes WHERE box_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY page, x1, y1 ORDER BY repeat('z', CAST(box_id % 13 AS INTEGER))) = 1),
      rs AS (SELECT page, s_x1, s_y1, 'r' || box_id AS text FROM (SELECT page, box_id, {scaled_pad} FROM boxes WHERE box_id % 3 > 0) QUALIFY row_number() OVER (PARTITION BY page, s_x1, s_y1 ORDER BY 'r' || box_id) = 1)"""
    # li: the lines, from first readings (rg), the last of a corner inside frames (la), suspects (su), second readings (re), rescues (sv)
    planned_lines = f"""{inputs}, rg AS (SELECT cl.*, rf.text FROM cl JOIN rf USING (page, box_id)),
      la AS (SELECT * FROM rg WHERE frame_id >= 0 QUALIFY row_number() OVER (PARTITION BY page, x1, y1 ORDER BY box_id DESC) = 1),
      su AS (SELECT cl.* FROM cl LEFT JOIN la USING (page, x1, y1) WHERE cl.frame_id >= 0 AND 2 * length({trimmed.replace("text", "la.text")}) * greatest(1, cl.y2 - cl.y1) < cl.x2 - cl.x1 QUALIFY row_number() OVER (PARTITION BY cl.page ORDER BY cl.box_id) <= 8),
      re AS (SELECT su.*, ra.text, la.box_id AS held FROM su JOIN ra USING (page, x1, y1) LEFT JOIN la USING (page, x1, y1) WHERE trim(ra.text) <> ''),
      ms AS (SELECT * FROM cl WHERE frame_id >= 0 AND NOT EXISTS (SELECT 1 FROM la WHERE la.page = cl.page AND la.x1 = cl.x1 AND la.y1 = cl.y1) UNION ALL
        SELECT * FROM cl WHERE frame_id < 0 AND NOT EXISTS (SELECT 1 FROM rg WHERE rg.frame_id < 0 AND rg.page = cl.page AND rg.x1 = cl.x1 AND rg.y1 = cl.y1)),
      tw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN frame_id >= 0 THEN 0 ELSE 1 END, box_id) AS place FROM ms) WHERE place <= 8),
      on1 AS (SELECT *, {scaled_pad} FROM tw QUALIFY row_number() OVER (PARTITION BY page, s_x1, s_y1 ORDER BY place) = 1),
      sv AS (SELECT on1.*, rs.text, la.box_id AS held FROM on1 JOIN rs USING (page, s_x1, s_y1) LEFT JOIN la USING (page, x1, y1)),
      bt AS (SELECT page, x1, y1, arg_max(text, length(text)) AS better FROM re WHERE held IS NOT NULL GROUP BY ALL), sw AS (SELECT page, x1, y1, any_value(text) AS swap FROM sv WHERE held IS NOT NULL GROUP BY ALL),
      li AS (SELECT rg.page, rg.box_id, rg.x1, rg.y1, rg.x2, rg.y2, rg.score, rg.frame_id, 0 AS origin, CASE WHEN la.box_id IS NULL THEN rg.text WHEN swap IS NOT NULL THEN swap WHEN length(better) > length(trim(rg.text)) THEN better ELSE rg.text END AS text
        FROM rg LEFT JOIN la USING (page, box_id) LEFT JOIN bt ON bt.page = rg.page AND bt.x1 = rg.x1 AND bt.y1 = rg.y1 LEFT JOIN sw ON sw.page = rg.page AND sw.x1 = rg.x1 AND sw.y1 = rg.y1
        UNION ALL SELECT page, box_id, x1, y1, x2, y2, score, frame_id, 1, text FROM re WHERE held IS NULL UNION ALL SELECT page, box_id, x1, y1, x2, y2, score, frame_id, 2, text FROM sv WHERE held IS NULL)"""
    o["region_lines"] = f"{W}{planned_lines} SELECT page, box_id, origin, text, frame_id FROM li"
    o["region_plan"] = f"""{R}{planned_lines}, ln AS (SELECT page, box_id * 4 + origin AS box_id, box_id AS box, origin, x1, y1, x2, y2, text, frame_id FROM li WHERE page IN (SELECT page FROM frames)), {zones("fo", "frames")},
      ins AS (SELECT * FROM ln WHERE frame_id >= 0), {gutters("gi", "ins", "page, frame_id")}, ig AS (SELECT ins.*, gutter FROM ins JOIN gi USING (page, frame_id)), {sided("so", "ig", "page, frame_id", "y1, box_id", GUTTER_SIDE)},
      outs AS (SELECT * FROM ln WHERE frame_id < 0), {sided("oo", "outs", "page", "y1, x1, box_id", TWO_COLUMN_SIDE)}
      SELECT page, box AS box_id, origin, text, frame_id, row_number() OVER (PARTITION BY page ORDER BY f, s) AS seq FROM (SELECT so.page, so.box, so.origin, so.text, so.frame_id, fo.seq AS f, so.seq AS s FROM so JOIN fo ON fo.page = so.page AND fo.frame_id = so.frame_id UNION ALL SELECT page, box, origin, text, frame_id, 1000000000, seq FROM oo)"""
    found = "EXISTS (SELECT 1 FROM li WHERE li.page = cl.page AND li.x1 = cl.x1 AND li.y1 = cl.y1 AND (li.frame_id >= 0) = (cl.frame_id >= 0))"
    o["region_counters"] = f"""{W}{planned_lines}, dc AS (SELECT page, frame_id >= 0 AS inside, {found} AS got FROM cl), kl AS (SELECT page, count(*) AS n_kept FROM li WHERE frame_id >= 0 GROUP BY page)
      SELECT page, count(*) AS n_detected, coalesce(any_value(n_kept), 0) AS n_kept, count(*) FILTER (inside AND NOT got) AS n_missed_in, count(*) FILTER (NOT inside AND NOT got) AS n_missed_out FROM dc LEFT JOIN kl USING (page) GROUP BY page"""
    o["frame_fallback"] = f"{W}{BOXES}, {FRAMES} SELECT DISTINCT page, page NOT IN (SELECT page FROM frames WHERE page % 2 = 1) AS whole FROM boxes"
    o["text_layer"] = f"""{R}{BOXES}, {READ}, lt AS (SELECT page, box_id, x1, y1, x2, y2, trim(coalesce(CASE WHEN box_id % 4 = 0 THEN text || 'é' || box_id ELSE text END, '')) AS text, CAST(1000 - box_id AS BIGINT) AS own, CASE WHEN page % 7 = 0 THEN 0 ELSE {WIDTH} END AS px, CASE WHEN page % 3 = 0 THEN 612 ELSE 700 END AS pt FROM rd WHERE page % 5 > 0),
      ev AS (SELECT * FROM lt WHERE page % 2 = 0), {fold("ln", "ev", "page")}, od AS (SELECT page, box_id, own AS seq FROM lt WHERE page % 2 = 1 UNION ALL SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY line, x1, y1, box_id) FROM ln),
      c AS (SELECT page, box_id, i, text[i] AS c, ord(text[i]) < 128 AS latin FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM lt)), n AS (SELECT *, CASE WHEN lag(latin) OVER w = latin THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY page, box_id ORDER BY i)),
      rr AS (SELECT page, box_id, run, latin, string_agg(c, '' ORDER BY i) AS piece FROM (SELECT *, sum(new) OVER (PARTITION BY page, box_id ORDER BY i) - 1 AS run FROM n) GROUP BY ALL),
      wd AS (SELECT page, box_id, sum(length(piece) * CASE WHEN latin THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS wide FROM rr GROUP BY ALL),
      pl AS (SELECT page, box_id, x1, y2, sc, (x2 - x1) * sc AS bw, (y2 - y1) * sc AS bh FROM (SELECT *, CASE WHEN px > 0 THEN CAST(pt AS DOUBLE) / px ELSE CAST(0.5 AS DOUBLE) END AS sc FROM lt)),
      p2 AS (SELECT *, greatest(bh, CAST(1 AS DOUBLE)) AS size FROM pl WHERE bw >= 1 AND bh >= 1)
      SELECT page, seq, run, latin, piece, round(x1 * sc, 6) AS x, round(792 - y2 * sc + size * CAST(0.2 AS DOUBLE), 6) AS y, round(size, 6) AS font_size, round(bw / (wide * size), 6) AS sx,
        round(coalesce(sum(length(piece) * CASE WHEN latin THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * size) OVER (PARTITION BY page, box_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS dx
      FROM rr JOIN p2 USING (page, box_id) JOIN wd USING (page, box_id) JOIN od USING (page, box_id)"""
    streams = f"""{CONTENT}, sm AS (SELECT page * 2 AS page, content FROM ct UNION ALL SELECT page * 2 + 1, ' /{MARK} BMC BT (own) Tj ET EMC' || chr(10) FROM ct WHERE page % 2 = 0), {STRIP.replace("FROM ct", "FROM sm")},
      fi AS (SELECT page // 2 AS page, page % 2 AS place, done || rest AS stripped, found FROM it QUALIFY row_number() OVER (PARTITION BY it.page ORDER BY found DESC) = 1)"""
    o["strip_pages"] = f"""{R}{streams} SELECT fi.page, CAST(place AS INTEGER) AS place, CASE WHEN fi.page % 3 > 0 AND found > 0 THEN stripped ELSE content END AS content, CASE WHEN fi.page % 3 > 0 THEN found ELSE 0 END AS found
      FROM fi JOIN sm ON sm.page = fi.page * 2 + place WHERE NOT (fi.page % 3 > 0 AND found > 0 AND trim(stripped, ' ' || chr(10)) = '')"""
    o["strip_counts"] = f"{R}{streams} SELECT sum(n) AS blocks, count(*) FILTER (n > 0) AS pages_stripped FROM (SELECT page, sum(found) AS n FROM fi GROUP BY page)"
    o["total_boxes"] = "SELECT count(*) AS n_boxes FROM lineitem"
    o["log_dropped"] = "SELECT greatest(0, count(*) - 2000) AS dropped FROM events"
    o["task_insert"] = """WITH k AS (SELECT user_id % 90 AS task_id, min(event_id) AS seq FROM events WHERE event_id % 4 = 0 GROUP BY ALL)
      SELECT task_id, seq FROM k UNION ALL SELECT user_id % 130, min(event_id) FROM events WHERE user_id % 130 NOT IN (SELECT task_id FROM k) GROUP BY ALL"""
    o["any_active"] = o["job_states"].rsplit("SELECT job_id, s AS status", 1)[0].rstrip() + ", js AS (SELECT s AS status FROM m QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) = 1) SELECT coalesce(bool_or(status IN ('queued', 'running')), false) AS active FROM js"
    typed = o["prefs_parse"].rsplit("SELECT p_partkey, CAST", 1)
    o["effective_options"] = f"{typed[0].rstrip()}, tp AS (SELECT p_partkey, CAST{typed[1]}) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 960 ELSE limit_side END AS limit_side, CAST(det_thresh AS DOUBLE) AS det_thresh, CAST(box_thresh AS DOUBLE) AS box_thresh, max_rot, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE crop_mode END AS crop_mode, workers FROM tp"
    o["form_values"] = f"""{W}{SETTINGS} SELECT p_partkey, CASE WHEN b IS NULL THEN CAST(0.3 AS DOUBLE) ELSE least(1.0, greatest(0.0, b)) END AS share, CASE WHEN d IS NULL THEN CAST(30 AS DOUBLE) ELSE least(90.0, greatest(0.0, d)) END AS degrees, CASE WHEN e IN (0, 1, 2) THEN e ELSE CAST(2 AS DOUBLE) END AS mode,
      CASE WHEN c IS NULL THEN CAST(40 AS DOUBLE) WHEN c > 0 AND c < 1 THEN floor(c * 100 + 0.5) ELSE c END AS percent FROM st"""
    o["selection_preview"] = f"""{W}{ITEMS}, ch AS (SELECT * FROM items WHERE (id // 2) % 2 = 1), c AS (SELECT * FROM ch WHERE is_attachment UNION SELECT * FROM items WHERE is_attachment AND parent_id IN (SELECT id FROM ch WHERE NOT is_attachment))
      SELECT id FROM c WHERE ({IS_DOC}) AND NOT {IS_DERIVED}"""
    o["job_names"] = "SELECT event_id, 'job-' || epoch_us(ts) // 1000 || '-' || event_id % 10 AS name, event_id % 9 || ',' || event_id % 5 + 11 AS pages FROM events"
    return o
