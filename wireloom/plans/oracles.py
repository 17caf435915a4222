"""SQL that gives the queries' rows in DuckDB."""

from __future__ import annotations

from wireloom.plans.bind import _LABELS, _ORDER, _PARTS
from wireloom.sinks.netlists import START
from wireloom.sources import domains

_CASES = lambda values, e: f"CASE {e} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
_SRC = f"src AS (SELECT l_orderkey AS drawing_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS INTEGER) AS idx, * FROM lineitem)"
_GOLD = _SRC + """,
gold AS (SELECT drawing_id, idx, CAST(l_partkey % 97 AS INTEGER) AS x0, CAST(l_suppkey * 13 % 61 AS INTEGER) AS y0,
  CAST(l_partkey % 97 + 20 + l_quantity AS INTEGER) AS x1, CAST(l_suppkey * 13 % 61 + 20 + 5 * l_linenumber AS INTEGER) AS y1, l_returnflag AS type FROM src)"""
_PRED = _GOLD + """,
moved AS (SELECT g.*, CAST(CASE WHEN l_partkey % 13 = 0 THEN 60 WHEN l_partkey % 11 = 0 THEN 10000 ELSE 4 * (l_partkey % 7 - 3) END AS INTEGER) AS dx,
  CAST(l_suppkey % 5 - 2 AS INTEGER) AS dy, l_partkey % 5 = 0 AS swap FROM gold g JOIN src s ON g.drawing_id = s.drawing_id AND g.idx = s.idx),
pred AS (SELECT drawing_id, idx, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1, CASE WHEN swap THEN 'X' ELSE type END AS type FROM moved)"""
_PAIRS = _PRED + """,
met AS (SELECT g.drawing_id, g.idx AS gi, p.idx AS pi, g.type AS gold_type, p.type AS pred_type,
  CAST((least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS DOUBLE) AS s,
  (g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS areas
  FROM gold g JOIN pred p ON g.drawing_id = p.drawing_id AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1),
pairs AS (SELECT *, s / (areas - s) AS iou FROM met WHERE s / (areas - s) >= 0.5)"""
_MATCH = "RECURSIVE " + _PAIRS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY iou DESC, gi, pi) AS rn FROM pairs),
walk AS (
  SELECT DISTINCT drawing_id, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS gs, CAST([] AS INTEGER[]) AS ps, FALSE AS ok, -1 AS gi, -1 AS pi, '' AS gold_type, '' AS pred_type FROM ranked
  UNION ALL
  SELECT r.drawing_id, r.rn, CASE WHEN f THEN list_append(gs, r.gi) ELSE gs END, CASE WHEN f THEN list_append(ps, r.pi) ELSE ps END, f, r.gi, r.pi, r.gold_type, r.pred_type
  FROM (SELECT w.gs, w.ps, r.*, NOT list_contains(w.gs, r.gi) AND NOT list_contains(w.ps, r.pi) AS f FROM walk w JOIN ranked r ON r.drawing_id = w.drawing_id AND r.rn = w.rn + 1) r),
won AS (SELECT drawing_id, gi, pi, gold_type, pred_type FROM walk WHERE ok)"""


def _rates(tp: str, fp: str, fn: str) -> str:
    p, r = f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END", f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END"
    # with precision p and recall r the harmonic mean is 2pr / (p + r)
    f1 = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END"
    return f"CAST({p} AS DOUBLE) AS precision, CAST({r} AS DOUBLE) AS recall, CAST({f1} AS DOUBLE) AS f1"


_DETECTION = f"""WITH {_MATCH},
each AS (SELECT g.drawing_id, n_gold, n_pred, coalesce(tp, 0) AS tp, coalesce(correct, 0) AS correct
  FROM (SELECT drawing_id, count(*) AS n_gold FROM gold GROUP BY 1) g JOIN (SELECT drawing_id, count(*) AS n_pred FROM pred GROUP BY 1) p USING (drawing_id)
  LEFT JOIN (SELECT drawing_id, count(*) AS tp, count(*) FILTER (gold_type = pred_type) AS correct FROM won GROUP BY 1) w USING (drawing_id)),
sums AS (SELECT coalesce(CAST(drawing_id AS VARCHAR), 'TOTAL') AS scope, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred - tp) AS BIGINT) AS fp,
  CAST(sum(n_gold - tp) AS BIGINT) AS fn, CAST(sum(correct) AS BIGINT) AS correct FROM each GROUP BY ROLLUP (drawing_id))
"""
_TOKENS = _GOLD + f""",
tokens AS (SELECT g.drawing_id, g.idx AS ord, {_CASES(_LABELS, 'l_partkey % 8')} || CAST(l_suppkey % 40 AS VARCHAR) || ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'K' AS text,
  CAST(g.x1 + l_partkey % 60 AS INTEGER) AS x0, CAST(g.y0 + l_suppkey % 30 AS INTEGER) AS y0, CAST(g.x1 + l_partkey % 60 + 30 AS INTEGER) AS x1, CAST(g.y0 + l_suppkey % 30 + 10 AS INTEGER) AS y1
  FROM gold g JOIN src s ON g.drawing_id = s.drawing_id AND g.idx = s.idx)"""
_NEAR = _TOKENS + """,
apart AS (SELECT g.drawing_id, g.idx, t.ord, t.text, CAST(greatest(t.x0 - g.x1, g.x0 - t.x1, 0) AS DOUBLE) AS dx, CAST(greatest(t.y0 - g.y1, g.y0 - t.y1, 0) AS DOUBLE) AS dy,
  (g.x0 + g.x1) / 2.0 - (t.x0 + t.x1) / 2.0 AS cx, (g.y0 + g.y1) / 2.0 - (t.y0 + t.y1) / 2.0 AS cy FROM gold g JOIN tokens t USING (drawing_id)),
near AS (SELECT * FROM (SELECT drawing_id, idx, ord, text, CASE WHEN dx = 0 AND dy = 0 THEN sqrt(cx * cx + cy * cy) ELSE sqrt(dx * dx + dy * dy) END AS distance FROM apart) WHERE distance <= 45)"""
_PARTED = _NEAR + """,
parted AS (SELECT drawing_id, idx, ord, distance, k AS part_ord, split_part(text, ' ', CAST(k AS INTEGER)) AS part FROM near, range(1, 3) r(k))"""
_HINTS = _SRC + f""",
hints AS (SELECT drawing_id, idx, CASE WHEN l_suppkey % 4 = 0 THEN 't' || CAST(l_partkey % 9 AS VARCHAR) || {_CASES(_PARTS, 'l_partkey % 6')}
  ELSE '= ae ' || lower({_CASES(_LABELS, 'l_suppkey % 8')}) || '-' || CAST(l_partkey % 9 AS VARCHAR) || ' 10K ?' END AS text FROM src)"""
_NORMAL = "replace(regexp_replace(upper(text), '[\\s\\-_.]+', '', 'g'), '$', 'S')"
_ELECTRONIC = domains.load("electronic")
_PREFIXES = "prefixes(prefix, class, score) AS (VALUES " + ", ".join(f"('{p}', '{c}', {w})" for p, cs in _ELECTRONIC.prefixes.items() for c, w in cs.items()) + ")"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches({_NORMAL}, '(?i){p}') THEN '{c}'" for p, c in _ELECTRONIC.families) + " END"
_MEMBERS = _SRC + ",\nmembers AS (SELECT drawing_id, CAST(l_suppkey % 3 AS INTEGER) AS net_ord, idx FROM src)"
_CONNECTED = _MEMBERS + """,
firsts AS (SELECT a.drawing_id, a.idx, b.idx AS other, min(a.net_ord) AS net_ord FROM members a JOIN members b ON a.drawing_id = b.drawing_id AND a.net_ord = b.net_ord AND a.idx <> b.idx GROUP BY 1, 2, 3)"""
_ID = "printf('SYM_%03d', {})".format
_SEARCH = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, l.vec_id, l.label, list_cosine_similarity(q.v, l.v) AS similarity FROM e q JOIN e l ON q.vec_id <> l.vec_id WHERE q.vec_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20)"""
_EVIDENCE = _SRC + """,
votes AS (
  SELECT drawing_id, idx, 0 AS so, 0 AS co, l_returnflag AS class, CAST(1.2 AS DOUBLE) * round(l_discount * 10, 3) AS v, round(l_discount * 10, 3) AS confidence FROM src
  UNION ALL SELECT drawing_id, idx, 1, 0, l_linestatus, CAST(0.9 AS DOUBLE) * (CAST(l_partkey % 10 AS DOUBLE) / 10), 0.9 FROM src
  UNION ALL SELECT drawing_id, idx, 1, 1, l_returnflag, CAST(0.9 AS DOUBLE) * (CAST(l_suppkey % 10 AS DOUBLE) / 10), 0.9 FROM src
  UNION ALL SELECT drawing_id, idx, 2, 0, CASE l_partkey % 3 WHEN 0 THEN 'N' ELSE 'Z' END, CAST(0.55 AS DOUBLE), 0.55 FROM src WHERE l_partkey % 3 < 2),
totals AS (SELECT drawing_id, idx, class, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(v AS DOUBLE) ORDER BY so, co)), lambda a, b: a + b) AS total, min(so * 10 + co) AS first FROM votes WHERE confidence > 0 GROUP BY 1, 2, 3),
fused AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(total) OVER w, 0) AS following FROM totals WINDOW w AS (PARTITION BY drawing_id, idx ORDER BY total DESC, first))"""
_SNAP = _MEMBERS + "," + _GOLD.split(",\n", 1)[1] + """,
ends AS (
  SELECT drawing_id, idx AS symbol_id, 0 AS idx, x0 AS x, CAST(floor((y0 + y1) / 2) AS INTEGER) AS y, CAST(180 AS DOUBLE) AS direction FROM gold
  UNION ALL SELECT drawing_id, idx, 1, x1, CAST(floor((y0 + y1) / 2) AS INTEGER), CASE WHEN type <> 'N' THEN CAST(0 AS DOUBLE) END FROM gold),
points AS (SELECT g.drawing_id, net_ord, x1 + 2 * net_ord + 3 + 2 * k AS px, CAST(floor((y0 + y1) / 2) AS INTEGER) + 2 * net_ord - 2 AS py FROM gold g JOIN members m USING (drawing_id, idx), range(0, 7) r(k)),
away AS (SELECT e.*, net_ord, sqrt(CAST((px - x) * (px - x) + (py - y) * (py - y) AS DOUBLE)) AS distance, degrees(atan2(CAST(py - y AS DOUBLE), CAST(px - x AS DOUBLE))) AS toward FROM ends e JOIN points p USING (drawing_id)),
turned AS (SELECT *, ((direction - toward) % 360 + 360) % 360 AS turn FROM away WHERE distance < CASE WHEN direction IS NULL THEN 13 ELSE 26 END),
snapped AS (SELECT drawing_id, symbol_id, idx, min({'distance': distance, 'net_ord': net_ord}) AS best FROM turned
  WHERE direction IS NULL OR distance = 0 OR least(turn, 360 - turn) <= 35 GROUP BY 1, 2, 3)"""
_PIXELS = """c AS (SELECT c_custkey AS drawing_id, c_custkey % 3 + 1 AS n, c_custkey % 5 + 3 AS arm, c_nationkey % 4 AS kind, c_custkey % 7 AS speck FROM customer),
j AS (SELECT *, unnest(range(1, n + 1)) AS j FROM c),
pixels AS (
  SELECT drawing_id, CAST(20 * j AS INTEGER) AS y, CAST(20 + k AS INTEGER) AS x FROM (SELECT *, unnest(range(-arm, arm + 1)) AS k FROM j) WHERE kind < 3 OR k >= j - 2
  UNION SELECT drawing_id, CAST(unnest(range(CASE WHEN kind = 2 THEN 20 ELSE 12 END, 20 * n + arm + 1)) AS INTEGER), 20 FROM c
  UNION SELECT drawing_id, CAST(2 AS INTEGER), 3 FROM c WHERE speck = 0 UNION SELECT drawing_id, CAST(20 * n + 30 AS INTEGER), 3 FROM c WHERE speck = 0 UNION SELECT drawing_id, 4, 3 FROM c WHERE speck = 1
  UNION SELECT drawing_id, y, x FROM c, (VALUES (3, 8), (3, 9), (4, 8), (4, 9)) v(y, x) WHERE speck = 3),
dots AS (SELECT drawing_id, 20 * j + 1 AS y, 19 AS x FROM j WHERE kind = 1 AND (drawing_id + j) % 2 = 0)"""
_REWIRED = _PIXELS + """,
near AS (SELECT a.drawing_id, a.y, a.x, b.y AS ny, b.x AS nx FROM pixels a JOIN pixels b ON a.drawing_id = b.drawing_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)),
branch AS (SELECT drawing_id, y, x FROM near GROUP BY 1, 2, 3 HAVING count(*) >= 3),
met AS (SELECT n.*, p.y IS NOT NULL AS p, q.y IS NOT NULL AS q FROM near n LEFT JOIN branch p USING (drawing_id, y, x) LEFT JOIN branch q ON q.drawing_id = n.drawing_id AND q.y = n.ny AND q.x = n.nx),
reach AS (SELECT drawing_id, y, x, y AS ry, x AS rx FROM branch UNION SELECT r.drawing_id, m.ny, m.nx, r.ry, r.rx FROM reach r JOIN met m ON m.drawing_id = r.drawing_id AND m.y = r.y AND m.x = r.x AND m.p AND m.q),
region AS (SELECT drawing_id, y, x, min({'y': ry, 'x': rx}) AS r FROM reach GROUP BY 1, 2, 3),
centre AS (SELECT drawing_id, r, CAST(trunc(avg(y)) AS INTEGER) AS cy, CAST(trunc(avg(x)) AS INTEGER) AS cx FROM region GROUP BY 1, 2),
arms AS (SELECT m.drawing_id, r, ny, nx, row_number() OVER (PARTITION BY m.drawing_id, r ORDER BY atan2(m.ny - m.y, m.nx - m.x), m.y, m.x, ny, nx) AS k, count(*) OVER (PARTITION BY m.drawing_id, r) AS n,
  row_number() OVER (PARTITION BY m.drawing_id, r ORDER BY m.y, m.x, ny, nx) AS o, atan2(m.ny - m.y, m.nx - m.x) AS angle FROM met m JOIN region USING (drawing_id, y, x) WHERE p AND NOT q),
solved AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(n, 0) < 4 OR EXISTS (SELECT 1 FROM dots d WHERE d.drawing_id = c.drawing_id AND abs(d.y - cy) <= 4 AND abs(d.x - cx) <= 4) AS star
  FROM centre c LEFT JOIN (SELECT DISTINCT drawing_id, r, n FROM arms) a USING (drawing_id, r)),
opposite AS (SELECT a.drawing_id, a.r, b.k FROM arms a JOIN arms b USING (drawing_id, r) WHERE a.k = 1 AND b.k > 1
  QUALIFY row_number() OVER (PARTITION BY a.drawing_id, a.r ORDER BY least(abs(a.angle - b.angle), 2 * pi() - abs(a.angle - b.angle)) DESC, b.o) = 1),
paired AS (SELECT a.drawing_id, a.r, ny, nx, a.k = 1 OR a.k = o.k AS one FROM arms a JOIN solved s USING (drawing_id, r) JOIN opposite o USING (drawing_id, r) WHERE NOT star AND s.n = 4),
edges AS (
  SELECT drawing_id, {'kind': 0, 'y': y, 'x': x} AS a, {'kind': 0, 'y': ny, 'x': nx} AS b FROM met WHERE NOT p AND NOT q
  UNION ALL SELECT drawing_id, {'kind': 1, 'y': cy, 'x': cx}, {'kind': 0, 'y': ny, 'x': nx} FROM solved JOIN arms USING (drawing_id, r) WHERE star
  UNION ALL SELECT u.drawing_id, {'kind': 0, 'y': u.ny, 'x': u.nx}, {'kind': 0, 'y': v.ny, 'x': v.nx} FROM paired u JOIN paired v USING (drawing_id, r) WHERE u.one = v.one AND (u.ny <> v.ny OR u.nx <> v.nx)),
nodes AS (SELECT drawing_id, {'kind': 0, 'y': y, 'x': x} AS v FROM pixels ANTI JOIN branch USING (drawing_id, y, x) UNION SELECT drawing_id, {'kind': 1, 'y': cy, 'x': cx} FROM solved WHERE star),
ways AS (SELECT drawing_id, a, b FROM edges UNION SELECT drawing_id, b, a FROM edges),
wide AS (SELECT drawing_id, v, v AS r FROM nodes UNION SELECT w.drawing_id, e.b, w.r FROM wide w JOIN ways e ON e.drawing_id = w.drawing_id AND e.a = w.v),
net AS (SELECT drawing_id, v, min(r) AS r FROM wide GROUP BY 1, 2),
numbered AS (SELECT drawing_id, v, dense_rank() OVER (PARTITION BY drawing_id ORDER BY r) - 1 AS net_ord FROM net)"""
_MERGE_STEP = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"
_HOURS = "hours AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events)"
_RUNS = _HOURS + """,
runs AS (SELECT user_id, min(hour) AS start, max(hour) AS stop, count(*) AS length FROM (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS island FROM hours) GROUP BY user_id, island)"""
_TEMPLATE = _GOLD + """,
template(k, name, tx, ty, ux, uy) AS (VALUES (0, 'B', 0, 50, 25, 50), (1, 'C', 75, 0, 75, 20), (2, 'E', 75, 99, 75, 99)),
flipped AS (SELECT g.drawing_id, g.idx, k, name, x0, y0, x1 - x0 AS w, y1 - y0 AS h, x0 % 4 AS q, CASE WHEN y0 % 2 = 1 THEN 99 - tx ELSE tx END AS tx, ty, CASE WHEN y0 % 2 = 1 THEN 99 - ux ELSE ux END AS ux, uy FROM gold g, template),
turned AS (SELECT *, CASE q WHEN 0 THEN tx WHEN 1 THEN 99 - ty WHEN 2 THEN 99 - tx ELSE ty END AS ax, CASE q WHEN 0 THEN ty WHEN 1 THEN tx WHEN 2 THEN 99 - ty ELSE 99 - tx END AS ay,
  CASE q WHEN 0 THEN ux WHEN 1 THEN 99 - uy WHEN 2 THEN 99 - ux ELSE uy END AS cx, CASE q WHEN 0 THEN uy WHEN 1 THEN ux WHEN 2 THEN 99 - uy ELSE 99 - ux END AS cy FROM flipped),
placed AS (SELECT drawing_id, idx, k, name, x0 + CAST(round_even(ax / 100.0 * w, 0) AS INTEGER) AS x, y0 + CAST(round_even(ay / 100.0 * h, 0) AS INTEGER) AS y,
  x0 + CAST(round_even(cx / 100.0 * w, 0) AS INTEGER) AS ux, y0 + CAST(round_even(cy / 100.0 * h, 0) AS INTEGER) AS uy FROM turned)"""


def _router(name: str) -> str:
    pack = domains.load(name)
    count = lambda p: f"len(list_filter(tokens, lambda t: regexp_matches(t, '{p}')))"
    return f"CAST({count('^(' + '|'.join(pack.prefixes) + ')[0-9]')} + {count('(' + '|'.join(pack.keywords) + ')')} AS INTEGER)"


_PRIMITIVES = _SRC + """,
prim AS (SELECT drawing_id AS symbol, idx, l_partkey % 4 AS kind, CAST(l_partkey % 13 AS DOUBLE) AS ax, CAST(l_suppkey % 11 AS DOUBLE) AS ay, CAST(l_partkey % 7 - 9 AS DOUBLE) AS bx, CAST(l_suppkey % 5 - 4 AS DOUBLE) AS uy,
  CAST(l_suppkey % 4 + 0.5 AS DOUBLE) AS radius, [1, 0, -1, 0][l_suppkey % 4 + 1] AS cosine, [0, 1, 0, -1][l_suppkey % 4 + 1] AS sine, CAST(l_linenumber * 1.27 AS DOUBLE) AS length FROM src),
reached AS (SELECT symbol, ax AS x, ay AS y FROM prim WHERE kind <> 1 UNION ALL SELECT symbol, bx, uy FROM prim WHERE kind IN (0, 2) UNION ALL SELECT symbol, ax - radius, ay - radius FROM prim WHERE kind = 1
  UNION ALL SELECT symbol, ax + radius, ay + radius FROM prim WHERE kind = 1 UNION ALL SELECT symbol, ax + cosine * length, ay + sine * length FROM prim WHERE kind = 3)"""
_PAGE = "page AS (SELECT c_custkey AS d, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, (x * x + 3 * y * (c_custkey % 7 + 1) + (x // 6) * (y // 5) * 29 + c_custkey * 11) % 256 AS v FROM customer, range(0, 20) r(y), range(0, 24) s(x))"

SQL: dict[str, str] = {
    "iou_theta_join": f"WITH {_PAIRS} SELECT drawing_id, gi, pi, iou FROM pairs",
    "eval_detection": f"{_DETECTION} SELECT scope, tp, fp, fn, correct, {_rates('tp', 'fp', 'fn')}, CAST(CASE WHEN tp > 0 THEN correct / tp ELSE 0 END AS DOUBLE) AS accuracy FROM sums",
    "report_export": f"{_DETECTION} SELECT scope, 'tp=' || tp || ' fp=' || fp || ' fn=' || fn || ' correct=' || correct AS line FROM sums",
    "confusion_pairs": f"WITH {_MATCH} SELECT gold_type, pred_type, count(*) AS n FROM won WHERE gold_type <> pred_type GROUP BY 1, 2",
    "eval_connectivity": f"""WITH {_MATCH},
m AS (SELECT drawing_id, l_suppkey % 3 AS n, (l_suppkey + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END) % 3 AS p, idx FROM src),
ge AS (SELECT a.drawing_id, least(x.pi, y.pi) AS a, greatest(x.pi, y.pi) AS b FROM m a JOIN m b ON a.drawing_id = b.drawing_id AND a.n = b.n AND a.idx < b.idx
  JOIN won x ON x.drawing_id = a.drawing_id AND x.gi = a.idx JOIN won y ON y.drawing_id = b.drawing_id AND y.gi = b.idx),
pe AS (SELECT a.drawing_id, a.idx AS a, b.idx AS b FROM m a JOIN m b ON a.drawing_id = b.drawing_id AND a.p = b.p AND a.idx < b.idx
  WHERE (a.drawing_id, a.idx) IN (SELECT (drawing_id, pi) FROM won) AND (b.drawing_id, b.idx) IN (SELECT (drawing_id, pi) FROM won)),
kinds AS (SELECT drawing_id, 'tp' AS kind FROM (SELECT * FROM ge INTERSECT SELECT * FROM pe) UNION ALL SELECT drawing_id, 'fn' FROM (SELECT * FROM ge EXCEPT SELECT * FROM pe)
  UNION ALL SELECT drawing_id, 'fp' FROM (SELECT * FROM pe EXCEPT SELECT * FROM ge)),
sums AS (SELECT coalesce(CAST(drawing_id AS VARCHAR), 'TOTAL') AS scope, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM kinds GROUP BY ROLLUP (drawing_id))
SELECT scope, tp, fp, fn, {_rates('tp', 'fp', 'fn')} FROM sums""",
    "micro_totals_rollup": f"""WITH said AS (SELECT lang, source, n_chars >= 500 AS p, quality = 1 AS g FROM documents JOIN labels USING (doc_id)),
sums AS (SELECT lang, source, CAST(grouping(lang, source) AS INTEGER) AS level, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM said GROUP BY ROLLUP (lang, source))
SELECT lang, source, level, tp, fp, fn, {_rates('tp', 'fp', 'fn')} FROM sums""",
    "box_overlap_pairs": f"""WITH {_GOLD}, p AS (SELECT a.drawing_id, a.idx AS i, b.idx AS j, CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE)
  / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS o, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1
  FROM gold a JOIN gold b ON a.drawing_id = b.drawing_id AND a.idx < b.idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT drawing_id, i, j, o AS overlap, x0, y0, x1, y1 FROM p WHERE o >= 0.5""",
    "box_gap_range_join": f"WITH {_NEAR} SELECT drawing_id, idx, ord, distance FROM near",
    "nearest_tokens_text": f"WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, idx ORDER BY distance, ord) AS k FROM near) SELECT drawing_id, idx, string_agg(text, ' ' ORDER BY k) AS text FROM k WHERE k <= 6 GROUP BY 1, 2",
    "first_value_token": f"WITH {_PARTED} SELECT drawing_id, idx, min({{'d': distance, 'o': ord, 'p': part_ord, 'part': part}}).part AS value FROM parted WHERE regexp_matches(part, '^[0-9]+([.][0-9]+)?[a-zA-Zµ]*$') GROUP BY 1, 2",
    "greedy_ids": f"""WITH RECURSIVE {_PARTED},
c AS (SELECT drawing_id, idx, part, row_number() OVER (PARTITION BY drawing_id ORDER BY distance, idx, ord, part_ord) AS rn FROM parted WHERE regexp_matches(part, '^[A-Za-z]{{1,4}}[0-9]{{1,3}}$')),
walk AS (SELECT DISTINCT drawing_id, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS ss, CAST([] AS VARCHAR[]) AS ids, FALSE AS ok, -1 AS idx, '' AS part FROM c
  UNION ALL SELECT r.drawing_id, r.rn, CASE WHEN f THEN list_append(ss, r.idx) ELSE ss END, CASE WHEN f THEN list_append(ids, r.part) ELSE ids END, f, r.idx, r.part
  FROM (SELECT w.ss, w.ids, c.*, NOT list_contains(w.ss, c.idx) AND NOT list_contains(w.ids, c.part) AS f FROM walk w JOIN c ON c.drawing_id = w.drawing_id AND c.rn = w.rn + 1) r)
SELECT drawing_id, idx, part AS id FROM walk WHERE ok""",
    "ocr_normalize": f"WITH {_HINTS} SELECT drawing_id, idx, text, {_NORMAL} AS normalized FROM hints",
    "designator_prefix_join": f"""WITH {_TOKENS}, {_PREFIXES}, w AS (SELECT drawing_id, ord, regexp_extract({_NORMAL}, '^([A-Z]+)[0-9]+', 1) AS letters FROM tokens)
SELECT drawing_id, ord, max({{'n': length(prefix), 'p': prefix}}).p AS prefix FROM w JOIN prefixes ON starts_with(letters, prefix) GROUP BY 1, 2""",
    "part_family_join": f"WITH {_HINTS} SELECT drawing_id, idx, {_FAMILY} AS family FROM hints",
    "text_prior_evidence": f"""WITH {_HINTS}, {_PREFIXES}, f AS (SELECT *, {_FAMILY} AS family FROM hints),
t AS (SELECT drawing_id, idx, k, split_part(text, ' ', CAST(k AS INTEGER)) AS text FROM f, range(1, 6) r(k) WHERE family IS NULL),
w AS (SELECT drawing_id, idx, k, regexp_extract({_NORMAL}, '^([A-Z]+)[0-9]+', 1) AS letters FROM t),
b AS (SELECT drawing_id, idx, min({{'k': k, 'n': -length(prefix), 'p': prefix}}).p AS prefix FROM w JOIN (SELECT DISTINCT prefix FROM prefixes) ON starts_with(letters, prefix) GROUP BY 1, 2)
SELECT drawing_id, idx, 'exact_part_number' AS level, family AS class, CAST(1 AS DOUBLE) AS score, CAST(0.95 AS DOUBLE) AS confidence FROM f WHERE family IS NOT NULL
UNION ALL SELECT drawing_id, idx, 'designator', class, CAST(score AS DOUBLE), CAST(0.55 AS DOUBLE) FROM b JOIN prefixes USING (prefix)""",
    "router_scores": f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(upper(coalesce(text, '')), '\\s+'), lambda x: regexp_replace(x, '[^A-Z0-9Ω°ΜµμΩ]', '', 'g')), lambda x: x <> '') AS tokens FROM documents),
s AS (SELECT doc_id, {_router('electronic')} AS electronic, {_router('pid')} AS pid FROM t)
SELECT doc_id, electronic, pid, CASE WHEN pid > electronic THEN 'pid' ELSE 'electronic' END AS domain FROM s""",
    "knn_neighbours": f"WITH {_SEARCH} SELECT query_id, rank, vec_id, label, round(similarity, 6) AS similarity FROM near",
    "knn_topk_classes": f"""WITH {_SEARCH}, b AS (SELECT query_id, label, max(round(similarity, 6)) AS similarity FROM near GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, label) AS INTEGER) AS rank FROM b) SELECT query_id, rank, label, similarity, similarity >= 0.62 AS above FROM r WHERE rank <= 3""",
    "fuse_evidence": f"""WITH {_EVIDENCE}, top AS (SELECT drawing_id, idx, min({{'r': rank, 'c': class}}).c AS class, max(CASE WHEN rank = 1 THEN total END) AS score,
  max(CASE WHEN rank = 1 THEN CASE WHEN total = 0 THEN 1 ELSE (total - following) / total END END) AS margin, string_agg(class, ',' ORDER BY rank) AS top FROM fused WHERE rank <= 3 GROUP BY 1, 2)
SELECT s.drawing_id, s.idx, coalesce(class, 'Unknown') AS class, round(coalesce(score, 0), 6) AS score, round(coalesce(margin, 1), 6) AS margin, coalesce(top, '') AS top FROM src s LEFT JOIN top t ON s.drawing_id = t.drawing_id AND s.idx = t.idx""",
    "ambiguous_group_routing": f"""WITH {_EVIDENCE}, h AS (SELECT drawing_id, idx, min({{'r': rank, 'c': class}}).c AS lead, count(*) FILTER (class IN ('Z', 'O')) AS z, count(*) FILTER (class IN ('A', 'N', 'R')) AS f FROM fused WHERE rank <= 3 GROUP BY 1, 2)
SELECT drawing_id, idx, CASE WHEN lead IN ('Z', 'O') OR z >= 2 THEN 'zero' ELSE 'flags' END AS route FROM h WHERE lead IN ('Z', 'O', 'A', 'N', 'R') OR z >= 2 OR f >= 2""",
    "template_instantiate": f"WITH {_TEMPLATE} SELECT drawing_id, idx, k, name, x, y, round(CASE WHEN x <> ux OR y <> uy THEN degrees(atan2(CAST(y - uy AS DOUBLE), CAST(x - ux AS DOUBLE))) END, 6) AS direction_deg FROM placed",
    "directional_snap": f"WITH {_SNAP} SELECT drawing_id, symbol_id, idx, best.net_ord AS net_ord, best.distance AS distance FROM snapped",
    "validate_findings": f"""WITH {_SNAP}, t AS (SELECT e.drawing_id, {_ID('e.symbol_id')} AS symbol_id, e.idx, printf('N%03d', s.best.net_ord) AS net_id FROM ends e LEFT JOIN snapped s ON e.drawing_id = s.drawing_id AND e.symbol_id = s.symbol_id AND e.idx = s.idx),
n AS (SELECT DISTINCT drawing_id, printf('N%03d', net_ord) AS net_id FROM points)
SELECT drawing_id, 'isolated' AS kind, symbol_id AS object_id, CAST(NULL AS INTEGER) AS idx FROM t GROUP BY drawing_id, symbol_id HAVING count(net_id) = 0
UNION ALL SELECT drawing_id, 'unattached', symbol_id, idx FROM t WHERE net_id IS NULL
UNION ALL SELECT drawing_id, 'low_confidence', {_ID('idx')}, NULL FROM src WHERE l_discount * 10 < 0.5
UNION ALL SELECT n.drawing_id, 'single_terminal', n.net_id, NULL FROM n LEFT JOIN t ON n.drawing_id = t.drawing_id AND n.net_id = t.net_id GROUP BY 1, 3 HAVING count(t.net_id) < 2""",
    "net_connections": f"WITH {_CONNECTED} SELECT drawing_id, {_ID('idx')} AS symbol_id, string_agg({_ID('other')}, ',' ORDER BY net_ord, {_ID('other')}) AS connections FROM firsts GROUP BY drawing_id, idx",
    "connected_components": """WITH RECURSIVE ends AS (SELECT o_custkey AS c, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1),
links AS (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL
  UNION ALL SELECT x.a, y.b FROM ends x JOIN ends y ON x.c = y.c + 3 WHERE x.c % 16 < 11),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
wide AS (SELECT a AS node, a AS r FROM ways UNION SELECT b, r FROM wide JOIN ways ON a = node)
SELECT node, min(r) AS root FROM wide GROUP BY 1""",
    "crossing_rewire": f"""WITH RECURSIVE {_REWIRED}
SELECT drawing_id, CAST(net_ord AS INTEGER) AS net_ord, count(*) AS nodes, CAST(sum(v.kind) AS BIGINT) AS junctions FROM numbered GROUP BY 1, 2 HAVING count(*) > 1""",
    "box_merge_fixpoint": f"""WITH RECURSIVE {_GOLD},
rows AS (SELECT s.drawing_id, s.idx, x0, y0, x1, y1, CASE WHEN l_partkey % 4 = 0 THEN 'ambiguous' ELSE 'symbol' END AS kind, CASE WHEN l_suppkey % 3 > 0 THEN l_returnflag END AS class,
  CASE WHEN l_suppkey % 5 > 0 THEN l_discount * 10 END AS confidence, CASE WHEN l_linenumber % 2 = 0 THEN 'synthetic_yolo' ELSE 'real_detector' END AS source FROM src s JOIN gold g ON g.drawing_id = s.drawing_id AND g.idx = s.idx),
steps AS (
  SELECT drawing_id, 0 AS step, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'kind': kind, 'class': class, 'confidence': confidence, 'source': source}} ORDER BY idx) AS boxes FROM rows GROUP BY 1
  UNION ALL
  SELECT drawing_id, step + 1, list_concat(list_concat(boxes[1:i - 1], [{{'x0': least(a.x0, b.x0), 'y0': least(a.y0, b.y0), 'x1': greatest(a.x1, b.x1), 'y1': greatest(a.y1, b.y1),
      'kind': CASE WHEN a.kind = b.kind THEN a.kind ELSE 'ambiguous' END, 'class': named.class, 'confidence': named.confidence,
      'source': CASE WHEN list_sort([a.source, b.source]) = ['real_detector', 'synthetic_yolo'] THEN 'synthetic_yolo+real_detector' ELSE better.source END}}]), list_concat(boxes[i + 1:j - 1], boxes[j + 1:]))
  FROM (SELECT *, CASE WHEN better.class IS NOT NULL THEN better WHEN a.class IS NOT NULL THEN a WHEN b.class IS NOT NULL THEN b ELSE better END AS named
    FROM (SELECT *, CASE WHEN coalesce(a.confidence, -1) >= coalesce(b.confidence, -1) THEN a ELSE b END AS better
      FROM (SELECT drawing_id, step, boxes, p.i AS i, p.j AS j, boxes[p.i] AS a, boxes[p.j] AS b
        FROM (SELECT s.drawing_id, s.step, any_value(s.boxes) AS boxes, min({{'i': i, 'j': j}}) AS p FROM steps s, unnest(range(1, len(s.boxes) + 1)) u(i), unnest(range(1, len(s.boxes) + 1)) v(j)
          WHERE i < j AND j <= len(boxes) AND {_MERGE_STEP.replace("a.", "boxes[i].").replace("b.", "boxes[j].")} GROUP BY 1, 2))))),
last AS (SELECT drawing_id, boxes FROM steps QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY step DESC) = 1)
SELECT drawing_id, CAST(k - 1 AS INTEGER) AS idx, boxes[k].x0 AS x0, boxes[k].y0 AS y0, boxes[k].x1 AS x1, boxes[k].y1 AS y1, boxes[k].kind AS kind, boxes[k].class AS class, boxes[k].confidence AS confidence, boxes[k].source AS source
FROM (SELECT drawing_id, boxes, unnest(range(1, len(boxes) + 1)) AS k FROM last)""",
    "degree_neighbors": f"WITH {_PIXELS} SELECT a.drawing_id, a.y, a.x, count(*) - 1 AS degree FROM pixels a JOIN pixels b ON a.drawing_id = b.drawing_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3",
    "runs_islands": f"WITH {_RUNS} SELECT user_id, start, stop, length FROM runs WHERE length >= 2",
    "longest_run": f"WITH {_RUNS} SELECT user_id, start, stop, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS k FROM runs) WHERE k = 1",
    "density_window": """WITH c AS (SELECT user_id % 24 AS x, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) % 24 AS y, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a.x, a.y, a.n, CAST(sum(b.n) AS BIGINT) AS around FROM c a JOIN c b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3""",
    "set_ops": """SELECT kind, k, count(*) AS n FROM (
  SELECT 'both' AS kind, * FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
  UNION ALL SELECT 'first', * FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
  UNION ALL SELECT 'second', * FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
  UNION ALL SELECT 'all', c_custkey FROM customer UNION ALL SELECT 'all', o_custkey FROM orders) GROUP BY 1, 2""",
    "json_sidecar": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "netlist_json": f"""WITH {_CONNECTED}, l AS (SELECT drawing_id, idx, string_agg('"' || {_ID('other')} || '"', ',' ORDER BY net_ord, {_ID('other')}) AS c FROM firsts GROUP BY 1, 2),
{_GOLD.split(",\n", 1)[1]}
SELECT g.drawing_id, '{{"symbols":[' || string_agg('{{"id":"' || {_ID('g.idx')} || '","type":"' || type || '","coordinates":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"connections":[' || coalesce(c, '') || ']}}', ',' ORDER BY g.idx) || ']}}' AS json
FROM gold g LEFT JOIN l ON g.drawing_id = l.drawing_id AND g.idx = l.idx GROUP BY 1""",
    "signature_hash": "SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, CAST(n_chars AS VARCHAR), text)) AS signature FROM documents",
    "graph_export": f"""WITH {_MEMBERS}, rows AS (
  SELECT drawing_id, 0 AS k, '<node id="' || {_ID('idx')} || '"><data key="kind">symbol</data><data key="label">' || l_returnflag || '</data></node>' AS line FROM src
  UNION ALL SELECT DISTINCT drawing_id, 0, '<node id="' || printf('N%03d', net_ord) || '"><data key="kind">net</data><data key="label"></data></node>' FROM members
  UNION ALL SELECT drawing_id, 1, '<edge source="' || {_ID('idx')} || '" target="' || printf('N%03d', net_ord) || '"/>' FROM members)
SELECT drawing_id, '{START}' || string_agg(line, '' ORDER BY k, line) || '</graph></graphml>' AS xml FROM rows GROUP BY 1""",
    "ocr_tokens": f"""WITH {_SRC}, r AS (SELECT drawing_id, idx AS ord, trim(CASE WHEN l_partkey % 7 = 0 THEN '  ' ELSE ' R' || l_linenumber || ' ' END) AS text,
  coalesce(TRY_CAST(CASE WHEN l_suppkey % 9 = 0 THEN 'n/a' WHEN l_suppkey % 9 = 1 THEN '-1' ELSE CAST(l_partkey % 101 AS VARCHAR) END AS DOUBLE), -1) / 100 AS confidence,
  l_partkey % 200 AS a, l_suppkey % 150 AS b, l_partkey % 200 + CAST(l_quantity AS INTEGER) + 1 AS c, l_suppkey % 150 + l_linenumber + 4 AS d, CAST(90 * (l_partkey % 4) AS INTEGER) AS orientation FROM src),
u AS (SELECT *, CASE orientation WHEN 0 THEN a WHEN 90 THEN b WHEN 180 THEN 300 - c ELSE 300 - d END AS x0, CASE orientation WHEN 0 THEN b WHEN 90 THEN 240 - c WHEN 180 THEN 240 - d ELSE a END AS y0,
  CASE orientation WHEN 0 THEN c WHEN 90 THEN d WHEN 180 THEN 300 - a ELSE 300 - b END AS x1, CASE orientation WHEN 0 THEN d WHEN 90 THEN 240 - a WHEN 180 THEN 240 - b ELSE c END AS y1 FROM r)
SELECT drawing_id, ord, text, CAST(floor(x0 / 3) AS INTEGER) AS x0, CAST(floor(y0 / 3) AS INTEGER) AS y0, CAST(floor(x1 / 3) AS INTEGER) AS x1, CAST(floor(y1 / 3) AS INTEGER) AS y1, confidence, orientation
FROM u WHERE text <> '' AND confidence >= 0""",
    "detection_boxes": f"""WITH {_SRC}, r AS (SELECT drawing_id, idx, (l_partkey % 150) - CAST(20.25 AS DOUBLE) AS x, (l_suppkey % 120) - CAST(20.5 AS DOUBLE) AS y, l_quantity AS w, CAST(l_linenumber * 5 AS DOUBLE) AS h FROM src),
c AS (SELECT drawing_id, idx, greatest(CAST(trunc(x - w / 2) AS INTEGER), 0) AS x0, greatest(CAST(trunc(y - h / 2) AS INTEGER), 0) AS y0, least(CAST(trunc(x + w / 2) AS INTEGER), 100) AS x1, least(CAST(trunc(y + h / 2) AS INTEGER), 80) AS y1 FROM r)
SELECT * FROM c WHERE x1 > x0 AND y1 > y0""",
    "response_keys": "SELECT substr(sha1(text || '|model|conf=0.35'), 1, 16) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "unmatched_symbols": f"""WITH {_MATCH}
SELECT drawing_id, 'golden' AS side, idx, type FROM gold g WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.drawing_id = g.drawing_id AND w.gi = g.idx)
UNION ALL SELECT drawing_id, 'predicted', idx, type FROM pred p WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.drawing_id = p.drawing_id AND w.pi = p.idx)""",
    "specialist_rules": f"""WITH {_SRC}, f AS (SELECT *, CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 6 END AS n FROM src)
SELECT drawing_id, idx, 'battery_capacitor' AS name, CASE WHEN n >= 4 THEN 'Battery' WHEN l_suppkey % 3 = 0 THEN 'Capacitor_Polarized' WHEN l_linenumber % 2 = 0 THEN 'Battery' ELSE 'Capacitor' END AS class, CAST(1 AS DOUBLE) AS score,
  CAST(CASE WHEN n >= 4 THEN 0.85 WHEN l_suppkey % 3 = 0 THEN 0.7 WHEN l_linenumber % 2 = 0 THEN 0.55 ELSE 0.6 END AS DOUBLE) AS confidence FROM f WHERE n >= 2
UNION ALL SELECT drawing_id, idx, 'bjt_potentiometer', unnest(CASE WHEN l_suppkey % 4 = 0 THEN ['BJT_NPN', 'BJT_PNP'] ELSE ['Potentiometer'] END), CAST(CASE WHEN l_suppkey % 4 = 0 THEN 0.5 ELSE 1 END AS DOUBLE),
  CAST(CASE WHEN l_suppkey % 4 = 0 THEN 0.75 ELSE 0.6 END AS DOUBLE) FROM src WHERE l_suppkey % 4 = 0 OR l_partkey % 2 = 0""",
    "arc_circles": f"""WITH {_GOLD}, p AS (SELECT drawing_id, idx, CAST(x0 AS DOUBLE) AS ax, CAST(y0 AS DOUBLE) AS ay, CAST(x1 AS DOUBLE) AS bx, CAST(y1 AS DOUBLE) AS uy, CAST(x1 AS DOUBLE) AS cx, CAST(y0 + idx % 3 AS DOUBLE) AS cy FROM gold),
m AS (SELECT *, (uy + cy) / 2 AS y FROM p), n AS (SELECT *, ((bx * bx - ax * ax) + (uy - y) * (uy - y) - (ay - y) * (ay - y)) / (2 * (bx - ax)) AS x FROM m)
SELECT drawing_id, idx, round(x, 6) AS x, round(y, 6) AS y, round(sqrt((bx - x) * (bx - x) + (uy - y) * (uy - y)), 6) AS radius FROM n""",
    "symbol_bounds": f"""WITH {_PRIMITIVES} SELECT symbol, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM reached GROUP BY 1""",
    "symbol_terminals": f"""WITH {_PRIMITIVES}, b AS (SELECT symbol, min(x) AS x0, max(y) AS y1 FROM reached GROUP BY 1)
SELECT symbol, idx AS ord, CAST(idx AS VARCHAR) AS number, CAST(trunc((ax - x0) * 20 + 12) AS INTEGER) AS x, CAST(trunc((y1 - ay) * 20 + 12) AS INTEGER) AS y FROM prim JOIN b USING (symbol) WHERE kind = 3""",
    "library_templates": """WITH p AS (SELECT p_partkey AS name, 20 + p_size AS w, 30 + p_partkey % 17 AS h FROM part),
e AS (SELECT name, w, h, 0 AS idx, 'A' AS terminal, 0 AS x, h // 2 AS y, 5 AS u, h // 2 AS v FROM p UNION ALL SELECT name, w, h, 1, 'B', w - 1, name % 20, w - 6, 3 FROM p),
f AS (SELECT name, w, h, idx, terminal, m AS mirrored, CASE WHEN m THEN w - 1 - x ELSE x END AS x, y, CASE WHEN m THEN w - 1 - u ELSE u END AS u, v FROM e, (VALUES (TRUE), (FALSE)) t(m)),
r AS (SELECT name, 0 AS turn, mirrored, idx, terminal, x / w AS tx, y / h AS ty, u / w AS bx, v / h AS "by" FROM f
  UNION ALL SELECT name, 90, mirrored, idx, terminal, (h - 1 - y) / h, x / w, (h - 1 - v) / h, u / w FROM f
  UNION ALL SELECT name, 180, mirrored, idx, terminal, (w - 1 - x) / w, (h - 1 - y) / h, (w - 1 - u) / w, (h - 1 - v) / h FROM f
  UNION ALL SELECT name, 270, mirrored, idx, terminal, y / h, (w - 1 - x) / w, v / h, (w - 1 - u) / w FROM f)
SELECT name, turn, mirrored, idx, terminal, round(tx, 9) AS tx, round(ty, 9) AS ty, round(bx, 9) AS bx, round("by", 9) AS "by" FROM r""",
    "probe_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
z AS (SELECT vec_id, k, list_dot_product(v, list_transform(range(0, 64), lambda j: CAST((k + 1) * (j + 3) % 11 - 5 AS DOUBLE))) + CAST(k + 1 AS DOUBLE) / 10 AS z FROM e, range(0, 4) r(k)),
p AS (SELECT vec_id, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x, z FROM z)
SELECT vec_id AS query_id, CAST(n AS INTEGER) AS rank, class, probability FROM (
  SELECT vec_id, substr('abcd', CAST(k + 1 AS INTEGER), 1) AS class, round(x / sum(x) OVER (PARTITION BY vec_id), 6) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS n FROM p) WHERE n <= 3""",
    "template_choice": f"""WITH {_SRC}, n AS (SELECT drawing_id, idx, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag ELSE 'X' END AS class, CAST(l_suppkey % 16 AS INTEGER) AS entry FROM src WHERE l_partkey % 3 = 0)
SELECT s.drawing_id, s.idx, l_returnflag AS class, coalesce(n.entry, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 8 END) AS entry
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS o FROM src) s LEFT JOIN n ON n.drawing_id = s.drawing_id AND n.idx = s.idx AND n.class = l_returnflag""",
    "node_link_json": f"""WITH {_MEMBERS}, nodes AS (SELECT drawing_id, {_ID('idx')} AS id, 'symbol' AS kind, l_returnflag AS label FROM src UNION SELECT drawing_id, printf('N%03d', net_ord), 'net', '' FROM members),
n AS (SELECT drawing_id, string_agg('{{"id":"' || id || '","kind":"' || kind || '","label":"' || label || '"}}', ',' ORDER BY id) AS n FROM nodes GROUP BY 1),
l AS (SELECT drawing_id, string_agg('{{"source":"' || {_ID('idx')} || '","target":"' || printf('N%03d', net_ord) || '"}}', ',' ORDER BY idx) AS l FROM members GROUP BY 1)
SELECT drawing_id, '{{"directed":false,"nodes":[' || n || '],"links":[' || l || ']}}' AS json FROM n JOIN l USING (drawing_id)""",
    "type_palette": f"""WITH {_SRC}, t AS (SELECT drawing_id, idx, CASE WHEN l_partkey % 10 = 0 THEN 'Unknown' ELSE l_returnflag || l_linestatus || l_linenumber END AS type FROM src),
d AS (SELECT drawing_id, type, row_number() OVER (PARTITION BY drawing_id ORDER BY type) - 1 AS k FROM (SELECT DISTINCT drawing_id, type FROM t))
SELECT t.drawing_id, idx, type, CASE WHEN type = 'Unknown' THEN '#ff0000' ELSE ['#5b9dff', '#9fd88a', '#f2b366', '#d78bf0', '#7ec1ff', '#ff8c5a', '#78c8a0', '#f08282'][k % 8 + 1] END AS colour FROM t JOIN d USING (drawing_id, type)""",
    "component_sizes": f"""WITH RECURSIVE {_SRC}, e AS (SELECT s.drawing_id, s.idx AS a, t.idx AS b FROM src s JOIN src t ON t.drawing_id = s.drawing_id AND t.idx = s.l_suppkey % 7 WHERE s.l_partkey % 3 > 0),
ways AS (SELECT * FROM e UNION SELECT drawing_id, b, a FROM e), wide AS (SELECT drawing_id, idx AS id, idx AS r FROM src UNION SELECT w.drawing_id, b, r FROM wide w JOIN ways e ON e.drawing_id = w.drawing_id AND e.a = w.id),
c AS (SELECT drawing_id, id, min(r) AS r FROM wide GROUP BY 1, 2), n AS (SELECT drawing_id, r, count(*) AS size FROM c GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY size DESC, r) - 1 AS INTEGER) AS part FROM n) SELECT c.drawing_id, id, part, size FROM c JOIN o USING (drawing_id, r)""",
    "otsu_levels": f"""WITH {_PAGE}, h AS (SELECT d, v, count(*) AS n FROM page GROUP BY 1, 2), t AS (SELECT d, unnest(range(0, 256)) AS v FROM (SELECT DISTINCT d FROM h)),
s AS (SELECT t.d, t.v, sum(coalesce(n, 0)) OVER w AS below, sum(coalesce(n, 0) * t.v) OVER w AS part, sum(coalesce(n, 0)) OVER (PARTITION BY t.d) AS total, sum(coalesce(n, 0) * t.v) OVER (PARTITION BY t.d) AS whole
  FROM t LEFT JOIN h ON h.d = t.d AND h.v = t.v WINDOW w AS (PARTITION BY t.d ORDER BY t.v ROWS UNBOUNDED PRECEDING)),
b AS (SELECT d, v, below, CASE WHEN below > 0 AND below < total THEN CAST(below AS DOUBLE) * (total - below) * power(CAST(part AS DOUBLE) / below - CAST(whole - part AS DOUBLE) / (total - below), 2) ELSE 0 END AS apart FROM s),
m AS (SELECT *, max(apart) OVER (PARTITION BY d) AS best FROM b)
SELECT d AS drawing_id, CAST(min(v) AS INTEGER) AS level, CAST(min(below) AS BIGINT) AS dark FROM m WHERE apart >= best * (1 - 1e-12) GROUP BY 1""",
    "morphology_pixels": f"""WITH {_PAGE}, ink AS (SELECT d, y, x FROM page WHERE v < 128),
er AS (SELECT i.d, i.y, i.x FROM page i WHERE NOT EXISTS (SELECT 1 FROM (VALUES (-1), (0), (1)) a(p), (VALUES (-1), (0), (1)) b(q), page o WHERE o.d = i.d AND o.y = i.y + p AND o.x = i.x + q AND o.v >= 128)),
lo AS (SELECT i.d, i.y, i.x FROM page i WHERE NOT EXISTS (SELECT 1 FROM (VALUES (-1), (0)) a(p), (VALUES (-1), (0), (1)) b(q), page o WHERE o.d = i.d AND o.y = i.y + p AND o.x = i.x + q AND o.v >= 128)),
op AS (SELECT DISTINCT l.d, l.y + p AS y, l.x + q AS x FROM lo l, (VALUES (-1), (0)) a(p), (VALUES (-1), (0), (1)) b(q)),
di AS (SELECT DISTINCT i.d, i.y + p AS y, i.x + q AS x FROM ink i, (VALUES (-1), (0)) a(p), (VALUES (-1), (0)) b(q))
SELECT o.d AS drawing_id, 'opened' AS kind, CAST(o.y AS INTEGER) AS y, CAST(o.x AS INTEGER) AS x FROM op o SEMI JOIN page USING (d, y, x) UNION ALL SELECT d, 'eroded', y, x FROM er
UNION ALL SELECT d, 'added', y, x FROM (SELECT * FROM di SEMI JOIN page USING (d, y, x)) ANTI JOIN ink USING (d, y, x)""",
    "ink_components": f"""WITH RECURSIVE {_PAGE}, ink AS (SELECT d, y, x, y * 1000 + x AS k FROM page WHERE v < 70),
near AS (SELECT a.d, a.k AS a, b.k AS b FROM ink a JOIN ink b ON a.d = b.d AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
wide AS (SELECT d, k, k AS r FROM ink UNION SELECT w.d, n.b, w.r FROM wide w JOIN near n ON n.d = w.d AND n.a = w.k), c AS (SELECT d, k, min(r) AS r FROM wide GROUP BY 1, 2)
SELECT d AS drawing_id, CAST(min(k % 1000) AS INTEGER) AS x0, CAST(min(k // 1000) AS INTEGER) AS y0, CAST(max(k % 1000) + 1 AS INTEGER) AS x1, CAST(max(k // 1000) + 1 AS INTEGER) AS y1, CAST(count(*) AS INTEGER) AS area FROM c GROUP BY d, r HAVING count(*) >= 3""",
    "wire_attachments": f"""WITH {_PAGE}, ink AS (SELECT d, y, x FROM page WHERE v < 90),
hit AS (SELECT DISTINCT d, 'top' AS side, x AS p FROM ink WHERE y BETWEEN 2 AND 5 AND x BETWEEN 7 AND 15 UNION SELECT DISTINCT d, 'bottom', x FROM ink WHERE y BETWEEN 13 AND 16 AND x BETWEEN 7 AND 15
  UNION SELECT DISTINCT d, 'left', y FROM ink WHERE x BETWEEN 3 AND 6 AND y BETWEEN 6 AND 12 UNION SELECT DISTINCT d, 'right', y FROM ink WHERE x BETWEEN 16 AND 19 AND y BETWEEN 6 AND 12),
runs AS (SELECT d, side, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY d, side ORDER BY p) AS g FROM hit) GROUP BY d, side, g HAVING count(*) >= 2)
SELECT d AS drawing_id, CAST(CASE side WHEN 'left' THEN 7 WHEN 'right' THEN 16 ELSE 7 + ((a - 7) + (b - 7)) // 2 END AS INTEGER) AS x, CAST(CASE side WHEN 'top' THEN 6 WHEN 'bottom' THEN 13 ELSE 6 + ((a - 6) + (b - 6)) // 2 END AS INTEGER) AS y,
  CAST(CASE side WHEN 'top' THEN 270 WHEN 'bottom' THEN 90 WHEN 'left' THEN 180 ELSE 0 END AS DOUBLE) AS direction_deg FROM runs""",
    "interpreted_pages": """WITH k AS (SELECT s_suppkey AS k, 10 + s_suppkey % 9 AS a, 90 + s_suppkey % 11 AS b, CASE WHEN s_suppkey % 2 = 0 THEN 'R' || (s_suppkey % 900) ELSE 'SYM_000' END AS id FROM supplier)
SELECT CAST(k AS VARCHAR) AS drawing_id, '{"symbols":[{"id":"' || id || '","type":"' || 'Tall' || '","coordinates":[' || a || ',20,' || (a + 20) || ',40],"connections":[' || CASE WHEN k % 3 > 0 THEN '"SYM_001"' ELSE '' END
  || ']},{"id":"SYM_001","type":"Wide","coordinates":[' || b || ',20,' || (b + 26) || ',36],"connections":[' || CASE WHEN k % 3 > 0 THEN '"' || id || '"' ELSE '' END || ']}]}' AS json FROM k""",
}
