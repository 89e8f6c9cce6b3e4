"""SQL of the queries, for another engine: written from the rules, not from the plans beside it.

An order is a graph, its lines are the vertices, and near pairs are edges; all
by whole numbers, so any SQL engine derives the same. // is whole-number division.
"""

from __future__ import annotations

# Shapes and their degrees, bounds of the ring, distances in pixels.
NODES = """nodes AS (SELECT l_orderkey AS crop,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS id,
  CAST((l_partkey * 37) % 397 AS INT) AS x, CAST((l_partkey * 101 + l_suppkey * 59) % 389 AS INT) AS y,
  CAST(5 + l_partkey % 4 AS INT) AS degree, CAST(10 + l_suppkey % 10 AS INT) AS radius,
  CASE l_partkey % 4 WHEN 0 THEN 'solid_dot' WHEN 1 THEN 'open_circle' WHEN 2 THEN 'square' ELSE 'triangle' END AS shape FROM lineitem)"""
EDGES = NODES + """, edges AS (SELECT a.crop, a.id AS u, b.id AS w, a.x AS ux, a.y AS uy, b.x AS wx, b.y AS wy FROM nodes a JOIN nodes b ON a.crop = b.crop AND a.id < b.id
  WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) BETWEEN 1 AND 44100),
 labels AS (SELECT o_orderkey AS crop, CAST(5 + o_custkey % 10 AS INT) AS ring FROM orders WHERE o_orderkey % 2 = 0)"""
SUMS = EDGES + """, v AS (SELECT crop, CAST(count(*) AS BIGINT) AS n_v, CAST(sum(degree) AS BIGINT) AS sum_d FROM nodes GROUP BY crop),
 e AS (SELECT crop, CAST(count(*) AS BIGINT) AS n_e FROM edges GROUP BY crop),
 g AS (SELECT v.crop, n_v, coalesce(n_e, 0) AS n_e, sum_d, sum_d - 2*coalesce(n_e, 0) AS e_att, sum_d - coalesce(n_e, 0) - 3*n_v + 3 AS implied_ring FROM v LEFT JOIN e ON v.crop = e.crop)"""
INNER = SUMS + """, ends AS (SELECT crop, u AS id FROM edges UNION ALL SELECT crop, w AS id FROM edges),
 d AS (SELECT n.crop, n.id, n.degree, n.shape, n.x, n.y, CAST(count(ends.id) AS BIGINT) AS deg_int FROM nodes n LEFT JOIN ends ON n.crop = ends.crop AND n.id = ends.id GROUP BY n.crop, n.id, n.degree, n.shape, n.x, n.y)"""
CROSS = EDGES + """, s AS (SELECT a.crop, a.u AS u1, a.w AS w1, b.u AS u2, b.w AS w2,
  sign((a.wx-a.ux)*(b.uy-a.uy) - (a.wy-a.uy)*(b.ux-a.ux)) * sign((a.wx-a.ux)*(b.wy-a.uy) - (a.wy-a.uy)*(b.wx-a.ux)) AS p,
  sign((b.wx-b.ux)*(a.uy-b.uy) - (b.wy-b.uy)*(a.ux-b.ux)) * sign((b.wx-b.ux)*(a.wy-b.uy) - (b.wy-b.uy)*(a.wx-b.ux)) AS q
  FROM edges a JOIN edges b ON a.crop = b.crop AND (a.u < b.u OR (a.u = b.u AND a.w < b.w)) AND a.u <> b.u AND a.u <> b.w AND a.w <> b.u AND a.w <> b.w),
 crossing AS (SELECT crop, u1, w1, u2, w2 FROM s WHERE p < 0 AND q < 0)"""
# Failures of two runs by the same tests: the baseline lacks some edges.
RUNS = INNER + """, base AS (SELECT crop, u, w FROM edges WHERE (u*3 + w*5 + crop) % 11 <> 0),
 be AS (SELECT crop, CAST(count(*) AS BIGINT) AS n_e FROM base GROUP BY crop), bends AS (SELECT crop, u AS id FROM base UNION ALL SELECT crop, w FROM base),
 bd AS (SELECT n.crop, n.id, n.degree, count(b.id) AS deg_int FROM nodes n LEFT JOIN bends b ON n.crop = b.crop AND n.id = b.id GROUP BY n.crop, n.id, n.degree),
 r AS (SELECT 'new' AS run, crop, implied_ring AS r, e_att FROM g UNION ALL SELECT 'base', v.crop, sum_d - coalesce(be.n_e, 0) - 3*n_v + 3, sum_d - 2*coalesce(be.n_e, 0) FROM v LEFT JOIN be ON v.crop = be.crop),
 fails AS (SELECT run, crop, CASE WHEN r > 14 THEN 'RING_TOO_LARGE' ELSE 'RING_TOO_SMALL' END AS tag FROM r WHERE r NOT BETWEEN 3 AND 14
  UNION ALL SELECT run, crop, 'NEGATIVE_ATTACHMENT' FROM r WHERE e_att < 0
  UNION ALL SELECT 'new', crop, 'DEGREE_OVERFLOW' FROM d WHERE deg_int > degree UNION ALL SELECT 'base', crop, 'DEGREE_OVERFLOW' FROM bd WHERE deg_int > degree
  UNION ALL SELECT run, r.crop, 'RING_MISMATCH' FROM r JOIN labels l ON r.crop = l.crop WHERE r <> ring),
 passing AS (SELECT g.crop, count(CASE WHEN f.run = 'new' THEN 1 END) AS new_bad, count(CASE WHEN f.run = 'base' THEN 1 END) AS base_bad FROM g LEFT JOIN fails f ON g.crop = f.crop GROUP BY g.crop)"""
GOLDEN = NODES + """, golden AS (SELECT crop, id, x + CAST((id*7 + crop) % 31 AS INT) - 15 AS gx, y + CAST((id*11 + crop) % 29 AS INT) - 14 AS gy, shape FROM nodes WHERE crop % 10 = 0)"""
#: Greedy pairs as a fold over the sorted candidates of a graph.
GOLDEN_FOLD = """c AS (SELECT g.crop, g.id AS gi, n.id AS di, (gx-n.x)*(gx-n.x) + (gy-n.y)*(gy-n.y) AS d2 FROM golden g JOIN nodes n ON g.crop = n.crop WHERE (gx-n.x)*(gx-n.x) + (gy-n.y)*(gy-n.y) <= 625),
 o AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY d2, gi, di) AS k FROM c),
 f AS (SELECT crop, CAST(0 AS BIGINT) AS k, [] :: INT[] AS gs, [] :: INT[] AS ds, CAST(NULL AS INT) AS gi, CAST(NULL AS INT) AS di, CAST(NULL AS INT) AS d2, false AS taken FROM (SELECT DISTINCT crop FROM c)
  UNION ALL SELECT o.crop, o.k, CASE WHEN list_contains(gs, o.gi) OR list_contains(ds, o.di) THEN gs ELSE list_append(gs, o.gi) END, CASE WHEN list_contains(gs, o.gi) OR list_contains(ds, o.di) THEN ds ELSE list_append(ds, o.di) END, o.gi, o.di, o.d2, NOT (list_contains(gs, o.gi) OR list_contains(ds, o.di)) FROM f JOIN o ON f.crop = o.crop AND o.k = f.k + 1)"""
GOLDEN_MATCH = "SELECT crop, gi, di, d2 FROM f WHERE taken"
SLOTS = """slots AS (SELECT o_orderkey AS crop, CAST(o_orderkey // 35 + 1 AS BIGINT) AS figure, CAST(o_orderkey % 35 + 1 AS BIGINT) AS position,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'D' END AS letter FROM orders)"""
BOXES = """boxes AS (SELECT c_custkey AS id, CAST(c_custkey * 97 % 3000 AS INT) AS x, CAST(c_custkey * 61 % 4000 AS INT) AS y, CAST(60 + c_custkey * 13 % 900 AS INT) AS w, CAST(60 + c_custkey * 29 % 900 AS INT) AS h, CAST(c_custkey % 50 AS INT) AS page FROM customer)"""


def _count(condition: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


RELATIONAL: dict[str, str] = {
    "implied_ring": f"WITH {SUMS} SELECT g.crop, n_v, n_e, sum_d, e_att, implied_ring, coalesce(l.ring, -1) AS labeled_ring, implied_ring BETWEEN 3 AND 14 AS in_range FROM g LEFT JOIN labels l ON g.crop = l.crop",
    "ring_summary": f"WITH {SUMS} SELECT implied_ring, CAST(count(*) AS BIGINT) AS crops, CAST(sum(n_v) AS BIGINT) AS vertices FROM g GROUP BY implied_ring",
    "identity_check": f"WITH {SUMS} SELECT crop, n_v + implied_ring AS v_total, n_e + e_att + implied_ring AS e_total, n_e + e_att + implied_ring = 3*(n_v + implied_ring) - implied_ring - 3 AS holds, '[VALID] V=' || (n_v + implied_ring) || ', E=' || (n_e + e_att + implied_ring) || ', E*=' || (3*(n_v + implied_ring) - implied_ring - 3) || ', r=' || implied_ring AS line FROM g",
    "attachment_legacy": f"WITH {SUMS} SELECT crop, e_att + implied_ring AS e_attachment FROM g WHERE implied_ring BETWEEN 3 AND 14",
    "ring_label_check": f"WITH {SUMS} SELECT g.crop, implied_ring - ring AS ring_delta, CASE WHEN implied_ring > ring THEN 'missed' WHEN implied_ring < ring THEN 'phantom' END AS verdict FROM g JOIN labels l ON g.crop = l.crop",
    "internal_degree": f"WITH {INNER} SELECT crop, id, deg_int FROM d",
    "degree_overflow": f"WITH {INNER} SELECT crop, id, deg_int, degree FROM d WHERE deg_int > degree",
    "degree_check": f"WITH {INNER} SELECT crop, bool_and(deg_int <= degree) AS ok FROM d GROUP BY crop",
    "attachment": f"WITH {INNER} SELECT crop, CAST(sum(degree - deg_int) AS BIGINT) AS total, CAST(min(degree - deg_int) AS BIGINT) AS least FROM d GROUP BY crop",
    "shape_degree_check": f"WITH {NODES}, o AS (SELECT shape, degree + CASE WHEN id % 5 = 4 THEN 1 ELSE 0 END AS degree FROM nodes) SELECT shape, CAST(count(*) AS BIGINT) AS n, {_count('''CASE shape WHEN 'solid_dot' THEN degree = 5 WHEN 'open_circle' THEN degree = 6 WHEN 'square' THEN degree = 7 ELSE degree >= 8 END''', 'consistent')} FROM o GROUP BY shape",
    "structural_failures": f"""WITH {EDGES}, faulty AS (SELECT crop, u, w FROM edges UNION ALL SELECT crop, u, w FROM edges WHERE crop % 97 = 0 AND u = 0 UNION ALL SELECT crop, u, u FROM edges WHERE crop % 101 = 0 UNION ALL SELECT crop, u, w + 100 FROM edges WHERE crop % 89 = 0 AND u = 0),
      dup AS (SELECT crop, least(u, w) AS lo, greatest(u, w) AS hi, count(*) - 1 AS n FROM faulty GROUP BY crop, least(u, w), greatest(u, w))
      SELECT crop, 'DUPLICATE_EDGE' AS tag, CAST(sum(n) AS BIGINT) AS n FROM dup WHERE n > 0 GROUP BY crop UNION ALL SELECT crop, 'SELF_LOOP', CAST(count(*) AS BIGINT) FROM faulty WHERE u = w GROUP BY crop
      UNION ALL SELECT f.crop, 'DANGLING_EDGE', CAST(count(*) AS BIGINT) FROM faulty f LEFT JOIN nodes n ON f.crop = n.crop AND f.w = n.id WHERE n.id IS NULL GROUP BY f.crop
      UNION ALL SELECT crop, 'DEGREE_TOO_SMALL', CAST(count(*) AS BIGINT) FROM nodes WHERE crop % 103 = 0 AND degree - 4 < 5 GROUP BY crop""",
    "crossing_edges": f"WITH {CROSS} SELECT crop, u1, w1, u2, w2 FROM crossing",
    "crossing_count_per_crop": f"WITH {CROSS} SELECT crop, CAST(count(*) AS BIGINT) AS crossings FROM crossing GROUP BY crop",
    "pair_candidates": f"WITH {NODES} SELECT a.crop, a.id AS i, b.id AS j FROM nodes a JOIN nodes b ON a.crop = b.crop AND a.id < b.id WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 44100 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) > (a.radius + b.radius + 12) * (a.radius + b.radius + 12)",
    "occluded_pairs": f"""WITH {NODES}, v AS MATERIALIZED (SELECT * FROM nodes), e AS MATERIALIZED (SELECT a.crop, a.id AS u, b.id AS w, a.x AS ux, a.y AS uy, b.x - a.x AS dx, b.y - a.y AS dy, a.radius + 4 AS ra, b.radius + 4 AS rb, CAST((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS BIGINT) AS l2 FROM v a JOIN v b ON a.crop = b.crop AND a.id < b.id),
      p AS (SELECT e.crop, e.u, e.w, k.radius AS rk, ra / sqrt(CAST(l2 AS DOUBLE)) AS t0, 1 - rb / sqrt(CAST(l2 AS DOUBLE)) AS t1, CAST((k.x-ux)*dx + (k.y-uy)*dy AS DOUBLE) / l2 AS t, CAST(dx*(k.y-uy) - dy*(k.x-ux) AS BIGINT) AS side, l2 FROM e JOIN v k ON e.crop = k.crop AND k.id <> e.u AND k.id <> e.w WHERE l2 BETWEEN 1 AND 44100)
      SELECT DISTINCT crop, u, w FROM p WHERE t0 < t1 AND t BETWEEN t0 AND t1 AND side * side < CAST(rk * rk AS BIGINT) * l2""",
    "proximity_suppression": f"WITH {NODES} SELECT c.crop, c.id FROM nodes c WHERE c.shape IN ('square', 'triangle') AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.crop = c.crop AND p.shape IN ('solid_dot', 'open_circle') AND (p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) < 625)",
    "bridge_edges": f"WITH {NODES}, loose AS (SELECT crop, id, CAST(id % 3 AS INT) AS owner, x, y FROM nodes) SELECT DISTINCT a.crop, least(a.owner, b.owner) AS u, greatest(a.owner, b.owner) AS w FROM loose a JOIN loose b ON a.crop = b.crop AND a.id < b.id AND a.owner <> b.owner WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 256",
    "hit_test": f"WITH {NODES}, probes AS (SELECT o_orderkey AS crop, CAST(o_custkey * 31 % 397 AS INT) AS px, CAST(o_custkey * 17 % 389 AS INT) AS py FROM orders), near AS (SELECT n.crop, n.id, px, py, (x-px)*(x-px) + (y-py)*(y-py) AS d2, row_number() OVER (PARTITION BY n.crop, px, py ORDER BY (x-px)*(x-px) + (y-py)*(y-py), n.id) AS k FROM nodes n JOIN probes p ON n.crop = p.crop) SELECT crop, px, py, id, d2 FROM near WHERE k = 1 AND d2 < 324",
    "rotation_system": f"WITH {EDGES}, darts AS (SELECT crop, u, w, ux, uy, wx, wy, u*1000 + w AS seq FROM edges UNION ALL SELECT crop, w, u, wx, wy, ux, uy, u*1000 + w FROM edges) SELECT crop, u, w, CAST(row_number() OVER (PARTITION BY crop, u ORDER BY atan2(wy-uy, wx-ux), seq) AS INT) AS place FROM darts",
    "outer_vertex": f"WITH {NODES}, o AS (SELECT crop, id, x, y, row_number() OVER (PARTITION BY crop ORDER BY x, y, id) AS k FROM nodes) SELECT crop, id, x, y FROM o WHERE k = 1",
    "failure_histogram": f"WITH {RUNS} SELECT run, tag, CAST(count(*) AS BIGINT) AS n FROM fails GROUP BY run, tag",
    "failure_tag_crops": f"WITH {RUNS} SELECT run, tag, CAST(count(DISTINCT crop) AS BIGINT) AS crops FROM fails GROUP BY run, tag",
    "run_histogram_diff": f"WITH {RUNS} SELECT tag, CAST(sum(CASE WHEN run = 'new' THEN 1 ELSE 0 END) AS BIGINT) AS new_count, CAST(sum(CASE WHEN run = 'base' THEN 1 ELSE 0 END) AS BIGINT) AS base_count FROM fails GROUP BY tag",
    "run_compare_summary": f"WITH {RUNS} SELECT CAST(count(*) AS BIGINT) AS crops, {_count('new_bad = 0', 'new_pass')}, {_count('base_bad = 0', 'base_pass')}, {_count('new_bad = 0 AND base_bad > 0', 'fixed')}, {_count('new_bad > 0 AND base_bad = 0', 'broken')} FROM passing",
    "run_fixed_broken": f"WITH {RUNS} SELECT crop, CASE WHEN new_bad = 0 THEN 'fixed' ELSE 'broken' END AS change FROM passing WHERE (new_bad = 0) <> (base_bad = 0)",
    "edge_set_difference": f"WITH {RUNS} SELECT e.crop, e.u, e.w, 'new' AS side FROM edges e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.crop = e.crop AND b.u = e.u AND b.w = e.w)",
    "edge_set_intersection": f"WITH {RUNS} SELECT crop, CAST(count(*) AS BIGINT) AS n FROM (SELECT crop, u, w FROM edges INTERSECT SELECT crop, u, w FROM base) t GROUP BY crop",
    "batch_summary": f"""WITH {RUNS}, n AS (SELECT * FROM fails WHERE run = 'new'), c AS (SELECT g.crop, l.ring, (SELECT count(*) FROM n WHERE n.crop = g.crop) AS bad FROM g LEFT JOIN labels l ON g.crop = l.crop)
      SELECT CAST(count(*) AS BIGINT) AS total, {_count('bad = 0', 'valid')}, {_count('bad = 0 AND ring IS NOT NULL', 'valid_labeled')}, CAST(0 AS BIGINT) AS no_nodes, (SELECT count(DISTINCT crop) FROM n WHERE tag = 'DEGREE_OVERFLOW') AS overflow, (SELECT count(DISTINCT crop) FROM n WHERE tag LIKE 'RING_TOO%') AS out_of_range,
      (SELECT count(DISTINCT crop) FROM n WHERE tag = 'RING_MISMATCH') AS mismatch, CAST(0 AS BIGINT) AS disconnected, CAST(0 AS BIGINT) AS nonplanar, CAST(0 AS BIGINT) AS errors, round(100.0 * CAST(sum(CASE WHEN bad = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS pct FROM c""",
    "triage_queue": f"""WITH {RUNS}, q AS (SELECT crop, new_bad, new_bad = 0 AND crop % 3 = 0 AS asked FROM passing) SELECT crop, CASE WHEN asked THEN 0 ELSE 1 END AS p, CAST(row_number() OVER (ORDER BY CASE WHEN asked THEN 0 ELSE 1 END, CASE WHEN asked THEN 0 ELSE new_bad END, crop) AS BIGINT) AS place FROM q WHERE new_bad > 0 OR asked""",
    "golden_candidates": f"WITH {GOLDEN} SELECT g.crop, g.id AS gi, n.id AS di, (gx-n.x)*(gx-n.x) + (gy-n.y)*(gy-n.y) AS d2 FROM golden g JOIN nodes n ON g.crop = n.crop WHERE (gx-n.x)*(gx-n.x) + (gy-n.y)*(gy-n.y) <= 625",
    "label_merge": f"WITH {SLOTS}, new AS (SELECT crop, 5 + CAST(crop % 11 AS INT) AS ring FROM slots WHERE crop % 4 = 0), old AS (SELECT o_orderkey AS crop, 5 + CAST(o_custkey % 10 AS INT) AS ring FROM orders WHERE o_orderkey % 6 = 0) SELECT coalesce(n.crop, o.crop) AS crop, coalesce(o.ring, n.ring) AS ring, o.ring IS NOT NULL AND n.ring IS NOT NULL AND o.ring <> n.ring AS conflict FROM new n FULL JOIN old o ON n.crop = o.crop",
    "annotation_enrich": f"WITH {SLOTS}, a AS (SELECT o_orderkey AS crop, CASE WHEN o_orderkey % 5 = 0 THEN 'D' END AS reducibility FROM orders WHERE o_orderkey % 2 = 0) SELECT a.crop, CASE WHEN a.reducibility IS NULL THEN s.letter ELSE a.reducibility END AS reducibility, s.figure, s.position, 'Table U ' || s.figure || '-' || s.position AS figure_ref FROM a LEFT JOIN slots s ON a.crop = s.crop",
    "census_progress": f"WITH {EDGES}, h AS (SELECT CASE WHEN ring <= 8 THEN '<=8' ELSE CAST(ring AS VARCHAR(9)) END AS bucket, count(*) AS n FROM labels GROUP BY 1), want AS (SELECT * FROM (VALUES ('<=8', 7), ('9', 8), ('10', 35), ('11', 89), ('12', 334), ('13', 701), ('14', 660)) t(bucket, expected)) SELECT w.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(expected AS BIGINT) AS expected FROM want w LEFT JOIN h ON w.bucket = h.bucket",
    "index_rank": f"WITH {SLOTS} SELECT crop, CAST(row_number() OVER (ORDER BY figure, position, crop) AS BIGINT) AS place, letter FROM slots WHERE crop % 7 <> 0",
    "index_report": f"WITH {SLOTS}, o AS (SELECT *, crop % 11 = 0 AS missing, CASE WHEN crop % 4 = 0 THEN NULL WHEN crop % 9 = 0 THEN position + 1 ELSE position END AS seen FROM slots) SELECT CAST(count(*) AS BIGINT) AS occupied, {_count('missing', 'missing')}, CAST(count(seen) AS BIGINT) AS checked, {_count('seen <> position', 'disagree')}, CAST(count(letter) AS BIGINT) AS letters FROM o",
    "slot_assignment": f"WITH {BOXES}, c AS (SELECT k, 300 + 600*k AS cx FROM (VALUES (0), (1), (2), (3), (4)) t(k)), near AS (SELECT id, c.k AS col, row_number() OVER (PARTITION BY id ORDER BY abs(2*x + w - 2*cx), c.k) AS place FROM boxes JOIN c ON true) SELECT id, col FROM near WHERE place = 1",
    "box_filter_reading_order": f"WITH {BOXES} SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY y // 100, x, id) AS BIGINT) AS place FROM boxes WHERE w*h > 8000 AND w*h < 1000000 AND h >= 150 AND 5*w > 2*h AND 2*w < 5*h",
    "crop_padding": f"WITH {BOXES} SELECT id, greatest(0, x-10) AS x0, greatest(0, y-10) AS y0, least(3000, x+w+10) AS x1, least(4000, y+h+10) AS y1 FROM boxes",
    "pruned_nodes": f"WITH {INNER}, kept AS (SELECT crop, id FROM d WHERE id % 4 <> 3 OR deg_int >= 2) SELECT crop, id, CAST(row_number() OVER (PARTITION BY crop ORDER BY id) - 1 AS INT) AS new_id FROM kept",
    "ladder_select": f"WITH {SUMS}, tries AS (SELECT crop, 0 AS attempt, implied_ring BETWEEN 3 AND 14 AS ok FROM g UNION ALL SELECT crop, 1, implied_ring - 3 BETWEEN 3 AND 14 FROM g UNION ALL SELECT crop, 2, implied_ring + 3 BETWEEN 3 AND 14 FROM g) SELECT crop, coalesce(min(CASE WHEN ok THEN attempt END), 0) AS attempt FROM tries GROUP BY crop",
    "signed_area": f"WITH {NODES}, r AS (SELECT crop, x, y, coalesce(lead(x) OVER (PARTITION BY crop ORDER BY id), first_value(x) OVER (PARTITION BY crop ORDER BY id)) AS nx, coalesce(lead(y) OVER (PARTITION BY crop ORDER BY id), first_value(y) OVER (PARTITION BY crop ORDER BY id)) AS ny FROM nodes) SELECT crop, CAST(sum(x*ny - nx*y) AS BIGINT) AS doubled FROM r GROUP BY crop",
    "detection_projection": f"WITH {NODES} SELECT 'page' || lpad(CAST(crop % 1000 AS VARCHAR(9)), 3, '0') || '_cell' || CAST(crop AS VARCHAR(20)) AS config, id, degree, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, shape FROM nodes",
    "pruned_edges": f"WITH {INNER}, kept AS (SELECT crop, id, CAST(row_number() OVER (PARTITION BY crop ORDER BY id) - 1 AS INT) AS new_id FROM d WHERE id % 4 <> 3 OR deg_int >= 2) SELECT e.crop, a.new_id AS u, b.new_id AS w FROM edges e JOIN kept a ON e.crop = a.crop AND e.u = a.id JOIN kept b ON e.crop = b.crop AND e.w = b.id",
    "edge_hit": f"""WITH {EDGES}, probes AS (SELECT o_orderkey AS crop, CAST(o_custkey * 31 % 397 AS INT) AS px, CAST(o_custkey * 17 % 389 AS INT) AS py FROM orders),
      t AS (SELECT e.*, px, py, greatest(0.0, least(1.0, CAST((px-ux)*(wx-ux) + (py-uy)*(wy-uy) AS DOUBLE) / ((wx-ux)*(wx-ux) + (wy-uy)*(wy-uy)))) AS t FROM edges e JOIN probes p ON e.crop = p.crop),
      a AS (SELECT crop, px, py, u, w, round(power(px - ux - t*(wx-ux), 2) + power(py - uy - t*(wy-uy), 2), 6) AS d2 FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY crop, px, py ORDER BY d2, u, w) AS k FROM a) SELECT DISTINCT crop, px, py, u, w, d2 FROM k WHERE k = 1 AND d2 < 100""",
    "spaced_nodes": f"""WITH RECURSIVE {NODES}, f AS (SELECT crop, -1 AS id, CAST([] AS INT[]) AS xs, CAST([] AS INT[]) AS ys, false AS taken FROM (SELECT DISTINCT crop FROM nodes)
      UNION ALL SELECT n.crop, n.id, CASE WHEN far THEN list_append(xs, n.x) ELSE xs END, CASE WHEN far THEN list_append(ys, n.y) ELSE ys END, far FROM (SELECT n.*, f.xs, f.ys, len(list_filter(range(len(f.xs)), lambda k: (f.xs[k+1]-n.x)*(f.xs[k+1]-n.x) + (f.ys[k+1]-n.y)*(f.ys[k+1]-n.y) < 90*90)) = 0 AS far FROM f JOIN nodes n ON f.crop = n.crop AND n.id = f.id + 1) n)
      SELECT crop, id FROM f WHERE taken""",
    "golden_score": f"""WITH RECURSIVE {GOLDEN}, {GOLDEN_FOLD}, gold AS (SELECT * FROM golden UNION ALL SELECT DISTINCT -crop - 1, 0, 0, 0, 'square' FROM golden WHERE crop % 50 = 0), m AS ({GOLDEN_MATCH}),
      n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM nodes WHERE crop % 10 = 0) AS found, (SELECT count(*) FROM golden) AS wanted, (SELECT count(*) FROM m JOIN golden g ON m.crop = g.crop AND m.gi = g.id JOIN nodes n ON m.crop = n.crop AND m.di = n.id WHERE g.shape = n.shape) AS ok),
      e AS (SELECT a.crop, a.id AS u, b.id AS w FROM nodes a JOIN nodes b ON a.crop = b.crop AND a.id < b.id WHERE a.crop % 10 = 0 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) BETWEEN 1 AND 44100), r AS (SELECT * FROM e WHERE (u*3 + w*5 + crop) % 11 <> 0),
      x AS (SELECT r.crop, least(a.gi, b.gi) AS u, greatest(a.gi, b.gi) AS w, a.gi IS NOT NULL AND b.gi IS NOT NULL AS matched FROM r LEFT JOIN m a ON r.crop = a.crop AND r.u = a.di LEFT JOIN m b ON r.crop = b.crop AND r.w = b.di),
      y AS (SELECT DISTINCT crop, u, w FROM x WHERE matched), z AS (SELECT (SELECT count(*) FROM y JOIN e USING (crop, u, w)) AS tp, (SELECT count(*) FROM y) + (SELECT count(*) FROM x WHERE NOT matched) AS found, (SELECT count(*) FROM e) AS wanted)
      SELECT (SELECT count(DISTINCT crop) FROM gold) AS crops, (SELECT count(DISTINCT crop) FROM gold WHERE crop < 0) AS missing, n.tp AS tp_n, n.found - n.tp AS fp_n, n.wanted - n.tp AS fn_n, n.ok AS shape_ok, n.tp AS shape_n, z.tp AS tp_e, z.found - z.tp AS fp_e, z.wanted - z.tp AS fn_e,
      round(n.tp / n.found, 6) AS p_n, round(n.tp / n.wanted, 6) AS r_n, round(z.tp / z.found, 6) AS p_e, round(z.tp / z.wanted, 6) AS r_e, round(n.ok / n.tp, 6) AS shapes FROM n, z""",
}


# Words on pages and slots of pages; figures of a grid of five by seven.
WORDS = """words AS (SELECT CAST(c_custkey % 20 AS INT) AS page, CAST(c_custkey AS BIGINT) AS ord, CAST(c_custkey * 37 % 1000 AS INT) AS cx, CAST(c_custkey * 53 % 1400 AS INT) AS cy,
  CASE c_custkey % 6 WHEN 0 THEN 'I' || CAST(c_custkey % 10 AS VARCHAR(4)) WHEN 1 THEN CAST(c_custkey % 60 AS VARCHAR(4)) WHEN 2 THEN 'c' WHEN 3 THEN 'D' WHEN 4 THEN '#' || CAST(c_custkey % 7 AS VARCHAR(4)) ELSE 'see' END AS token FROM customer),
 fixed AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9iIlLoO#]{1,2}$') THEN try_cast(replace(translate(token, 'iIlLoO', '111100'), '#', '') AS INT) END AS number FROM words),
 classed AS (SELECT page, ord, cx, cy, token, CASE WHEN number BETWEEN 1 AND 35 THEN number END AS number, CASE WHEN regexp_matches(token, '^[cCdD]$') THEN upper(token) END AS letter FROM fixed)"""
GRID = """cells AS (SELECT CAST(n_nationkey % 20 AS INT) AS page, CAST(r_regionkey AS INT) AS col, CAST(n_nationkey % 7 AS INT) AS line, CAST(r_regionkey * 200 AS INT) AS sx, CAST(n_nationkey % 7 * 200 AS INT) AS sy FROM nation, region WHERE n_nationkey < 20)"""
# A pixel a line: ink where v > 128.
PIXELS = """pixels AS (SELECT CAST(l_suppkey AS INT) AS crop, CAST(l_partkey * 7 % 24 AS INT) AS y, CAST(l_orderkey * 11 % 24 AS INT) AS x, CAST(max((l_partkey * 31 + l_orderkey * 17) % 256) AS INT) AS v FROM lineitem GROUP BY l_suppkey, l_partkey * 7 % 24, l_orderkey * 11 % 24),
 ink AS (SELECT crop, y, x FROM pixels WHERE v > 128),
 marks AS (SELECT k AS node, CAST(5 + 7 * k AS INT) AS cx, CAST(19 - 7 * k AS INT) AS cy, CAST(3 + k AS INT) AS radius FROM (VALUES (0), (1), (2)) t(k))"""
RING = "ring AS (SELECT * FROM (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, 1), (4, 1, 1), (5, 1, 0), (6, 1, -1), (7, 0, -1)) t(k, dy, dx))"

INDEX: dict[str, str] = {
    "token_classes": f"WITH {WORDS} SELECT ord, token, number, letter FROM classed",
    "slot_rectangles": f"WITH {GRID} SELECT page, page - 13 AS figure, line * 5 + col + 1 AS position, sx, sy, 200 AS w, 200 AS h FROM cells",
    "words_in_slots": f"""WITH {WORDS}, {GRID}, hit AS (SELECT c.page, c.line, c.col, w.ord, w.number, w.letter, w.token, abs(w.cx - c.sx) AS d FROM cells c JOIN classed w ON c.page = w.page WHERE w.cy BETWEEN c.sy + 60 AND c.sy + 280 AND w.cx BETWEEN c.sx - 80 AND c.sx + 280),
      n AS (SELECT page, line, col, number, row_number() OVER (PARTITION BY page, line, col ORDER BY d, ord) AS k FROM hit WHERE number IS NOT NULL), l AS (SELECT page, line, col, letter, row_number() OVER (PARTITION BY page, line, col ORDER BY ord DESC) AS k FROM hit WHERE letter IS NOT NULL)
      SELECT c.page, c.line, c.col, n.number, l.letter, n.number = c.line * 5 + c.col + 1 AS agrees FROM cells c LEFT JOIN n ON c.page = n.page AND c.line = n.line AND c.col = n.col AND n.k = 1 LEFT JOIN l ON c.page = l.page AND c.line = l.line AND c.col = l.col AND l.k = 1""",
    "cross_references": f"WITH {WORDS}, {GRID} SELECT c.page, c.line, c.col FROM cells c WHERE (c.page = 17 AND c.line * 5 + c.col + 1 = 3) OR EXISTS (SELECT 1 FROM classed w WHERE w.page = c.page AND lower(w.token) = 'see' AND w.cx BETWEEN c.sx AND c.sx + 200 AND w.cy BETWEEN c.sy AND c.sy + 200)",
    "slot_boxes": f"WITH {BOXES} SELECT page, x // 600 AS col, y // 600 AS line, max(id) AS box, count(*) > 1 AS collides FROM boxes GROUP BY page, x // 600, y // 600",
    "merge_counters": f"WITH {SLOTS}, t AS (SELECT n.crop, 5 + n.crop % 11 AS ring, 5 + o.o_custkey % 10 AS known FROM slots n LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 = 0) o ON n.crop = o.o_orderkey WHERE n.crop % 4 = 0) SELECT {_count('ring BETWEEN 6 AND 14', 'ok')}, {_count('ring NOT BETWEEN 6 AND 14', 'rejected')}, {_count('ring BETWEEN 6 AND 14 AND ring <> known', 'conflicts')} FROM t",
    "disc_ink": f"WITH {PIXELS} SELECT p.crop, m.node, CAST(count(*) AS BIGINT) AS pixels, {_count('v > 128', 'ink')}, CAST(sum(v) AS BIGINT) AS brightness FROM pixels p JOIN marks m ON (p.x - m.cx)*(p.x - m.cx) + (p.y - m.cy)*(p.y - m.cy) <= m.radius * m.radius GROUP BY p.crop, m.node",
    "rectangle_ink": f"WITH {PIXELS} SELECT p.crop, m.node, CAST(count(*) AS BIGINT) AS ink FROM ink p JOIN marks m ON p.x >= m.cx - m.radius AND p.x < m.cx + m.radius AND p.y >= m.cy - m.radius AND p.y < m.cy + m.radius GROUP BY p.crop, m.node",
    "erased_discs": f"WITH {PIXELS} SELECT p.crop, p.y, p.x FROM ink p WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE (p.x - m.cx)*(p.x - m.cx) + (p.y - m.cy)*(p.y - m.cy) <= (m.radius + 4)*(m.radius + 4))",
    "stroke_touches": f"WITH {PIXELS} SELECT p.crop, p.x % 7 AS stroke, m.node, min((p.x - m.cx)*(p.x - m.cx) + (p.y - m.cy)*(p.y - m.cy)) AS d2 FROM ink p JOIN marks m ON true GROUP BY p.crop, p.x % 7, m.node, m.radius HAVING min((p.x - m.cx)*(p.x - m.cx) + (p.y - m.cy)*(p.y - m.cy)) <= (m.radius + 8)*(m.radius + 8)",
    "crossing_numbers": f"""WITH {PIXELS}, {RING}, a AS (SELECT p.crop, p.y, p.x, r.k, CASE WHEN q.x IS NULL THEN 0 ELSE 1 END AS lit FROM (SELECT i.crop, i.y, i.x, r.k, i.y + r.dy AS ny, i.x + r.dx AS nx FROM ink i JOIN ring r ON true) p JOIN ring r ON p.k = r.k LEFT JOIN ink q ON q.crop = p.crop AND q.y = p.ny AND q.x = p.nx),
      b AS (SELECT crop, y, x, lit, coalesce(lead(lit) OVER (PARTITION BY crop, y, x ORDER BY k), first_value(lit) OVER (PARTITION BY crop, y, x ORDER BY k)) AS ahead FROM a) SELECT crop, y, x, {_count('lit = 0 AND ahead = 1', 'crossings')} FROM b GROUP BY crop, y, x""",
    "dilated_pixels": f"WITH {PIXELS}, {RING}, spread AS (SELECT crop, y, x, v FROM pixels UNION ALL SELECT p.crop, CAST(p.y + r.dy AS INT), CAST(p.x + r.dx AS INT), p.v FROM pixels p JOIN ring r ON true) SELECT crop, y, x, max(v) AS v FROM spread GROUP BY crop, y, x",
    "labels_to_json": "SELECT o_orderkey AS crop, '\"' || CAST(o_orderkey AS VARCHAR(20)) || '\": ' || CAST(max(5 + o_custkey % 10) AS VARCHAR(20)) AS line FROM orders GROUP BY o_orderkey",
}

CONNECTED_SQL = f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT crop, u, w FROM edges UNION ALL SELECT crop, w, u FROM edges),
 reach AS (SELECT crop, 0 AS id FROM nodes WHERE id = 0 UNION SELECT r.crop, b.w FROM reach r JOIN both_ways b ON r.crop = b.crop AND r.id = b.u),
 n AS (SELECT crop, count(*) AS c FROM nodes GROUP BY crop), m AS (SELECT crop, count(*) AS c FROM reach GROUP BY crop)
 SELECT n.crop, n.c = m.c AS connected FROM n JOIN m ON n.crop = m.crop"""
FACE_COUNTS_SQL = f"""WITH RECURSIVE {EDGES}, darts AS (SELECT crop, u, w, ux, uy, wx, wy, u*1000 + w AS seq FROM edges UNION ALL SELECT crop, w, u, wx, wy, ux, uy, u*1000 + w FROM edges),
 turn AS (SELECT crop, u, w, coalesce(lead(w) OVER (PARTITION BY crop, u ORDER BY atan2(wy-uy, wx-ux), seq), first_value(w) OVER (PARTITION BY crop, u ORDER BY atan2(wy-uy, wx-ux), seq)) AS nxt FROM darts),
 step AS (SELECT d.crop, d.u, d.w, t.u AS nu, t.nxt AS nw FROM darts d JOIN turn t ON t.crop = d.crop AND t.u = d.w AND t.w = d.u),
 walk AS (SELECT crop, u AS su, w AS sw, u, w FROM darts UNION SELECT k.crop, k.su, k.sw, s.nu, s.nw FROM walk k JOIN step s ON k.crop = s.crop AND k.u = s.u AND k.w = s.w),
 face AS (SELECT crop, su, sw, min(u*1000 + w) AS least FROM walk GROUP BY crop, su, sw)
 SELECT f.crop, CAST(count(DISTINCT least) AS BIGINT) AS faces FROM face f JOIN ({CONNECTED_SQL}) c ON f.crop = c.crop WHERE c.connected GROUP BY f.crop"""
GOLDEN_MATCH_SQL = f"WITH RECURSIVE {GOLDEN}, {GOLDEN_FOLD} {GOLDEN_MATCH}"

#: Faces by their least darts, the outer one, and what the layers of the battery say of connected graphs with edges.
_FACES = f"""WITH RECURSIVE {INNER}, darts AS (SELECT crop, u, w, ux, uy, wx, wy, u*1000 + w AS seq FROM edges UNION ALL SELECT crop, w, u, wx, wy, ux, uy, u*1000 + w FROM edges),
 turn AS (SELECT crop, u, w, coalesce(lead(w) OVER (PARTITION BY crop, u ORDER BY atan2(wy-uy, wx-ux), seq), first_value(w) OVER (PARTITION BY crop, u ORDER BY atan2(wy-uy, wx-ux), seq)) AS nxt FROM darts),
 step AS (SELECT d.crop, d.u, d.w, t.u AS nu, t.nxt AS nw FROM darts d JOIN turn t ON t.crop = d.crop AND t.u = d.w AND t.w = d.u),
 walk AS (SELECT crop, u AS su, w AS sw, u, w FROM darts UNION SELECT k.crop, k.su, k.sw, s.nu, s.nw FROM walk k JOIN step s ON k.crop = s.crop AND k.u = s.u AND k.w = s.w),
 con AS ({CONNECTED_SQL.replace("WITH RECURSIVE " + EDGES + ", both_ways", "WITH RECURSIVE both_ways")}),
 face AS (SELECT k.crop, su, sw, min(k.u*1000 + k.w) AS least FROM walk k JOIN con ON k.crop = con.crop AND con.connected GROUP BY k.crop, su, sw),
 low AS (SELECT crop, id FROM (SELECT crop, id, row_number() OVER (PARTITION BY crop ORDER BY x, y, id) AS k FROM nodes) t WHERE k = 1),
 mark AS (SELECT crop, u, w FROM (SELECT d.crop, d.u, d.w, row_number() OVER (PARTITION BY d.crop ORDER BY atan2(wy-uy, wx-ux) DESC, seq DESC) AS k FROM darts d JOIN low ON d.crop = low.crop AND d.u = low.id) t WHERE k = 1),
 outside AS (SELECT f.crop, f.least FROM face f JOIN mark m ON f.crop = m.crop AND f.su = m.w AND f.sw = m.u),
 sizes AS (SELECT crop, least, count(*) AS n FROM face GROUP BY crop, least),
 outer_walk AS (SELECT f.crop, f.su AS id, count(*) AS visits FROM face f JOIN outside o ON f.crop = o.crop AND f.least = o.least GROUP BY f.crop, f.su),
 free AS (SELECT d.crop, d.id, d.degree - d.deg_int AS a, coalesce(o.visits, 0) AS visits FROM d JOIN outside x ON d.crop = x.crop LEFT JOIN outer_walk o ON d.crop = o.crop AND d.id = o.id),
 walks AS (SELECT s.crop, count(*) AS faces, (SELECT sum(visits) FROM outer_walk o WHERE o.crop = s.crop) AS outer_walk_len FROM sizes s GROUP BY s.crop),
 ringed AS (SELECT w.crop, faces, outer_walk_len, (SELECT sum(a) FROM free f WHERE f.crop = w.crop) - outer_walk_len AS ring_walk FROM walks w)"""
FACE_WALKS_SQL = f"{_FACES} SELECT crop, CAST(faces AS BIGINT) AS faces, CAST(outer_walk_len AS BIGINT) AS outer_walk_len, CAST(ring_walk AS BIGINT) AS ring_walk FROM ringed"
LAYERS_SQL = f"""{_FACES}, ins AS (SELECT a.crop FROM edges a JOIN edges b ON a.crop = b.crop AND (a.u < b.u OR (a.u = b.u AND a.w < b.w)) AND a.u <> b.u AND a.u <> b.w AND a.w <> b.u AND a.w <> b.w JOIN con ON a.crop = con.crop AND con.connected
  WHERE sign((a.wx-a.ux)*(b.uy-a.uy) - (a.wy-a.uy)*(b.ux-a.ux)) * sign((a.wx-a.ux)*(b.wy-a.uy) - (a.wy-a.uy)*(b.wx-a.ux)) < 0 AND sign((b.wx-b.ux)*(a.uy-b.uy) - (b.wy-b.uy)*(a.ux-b.ux)) * sign((b.wx-b.ux)*(a.wy-b.uy) - (b.wy-b.uy)*(a.wx-b.ux)) < 0),
 l AS (SELECT crop, 'DISCONNECTED' AS tag FROM con WHERE NOT connected UNION ALL SELECT crop, 'DEGREE_OVERFLOW' FROM d WHERE deg_int > degree UNION ALL SELECT crop, 'NEGATIVE_ATTACHMENT' FROM g WHERE e_att < 0
  UNION ALL SELECT crop, 'RING_TOO_SMALL' FROM g WHERE implied_ring < 3 UNION ALL SELECT crop, 'RING_TOO_LARGE' FROM g WHERE implied_ring > 14 UNION ALL SELECT g.crop, 'RING_MISMATCH' FROM g JOIN labels b ON g.crop = b.crop WHERE implied_ring <> ring
  UNION ALL SELECT crop, 'GEOM_EDGE_CROSSING' FROM ins UNION ALL SELECT s.crop, 'NONTRIANGULAR_INTERIOR_FACE' FROM sizes s JOIN outside o ON s.crop = o.crop WHERE s.least <> o.least AND s.n <> 3
  UNION ALL SELECT crop, 'INTERIOR_VERTEX_ATTACHED' FROM free WHERE visits = 0 AND a <> 0 UNION ALL SELECT crop, 'BOUNDARY_ATTACHMENT_DEFICIT' FROM free WHERE visits > 0 AND a < visits
  UNION ALL SELECT r.crop, 'RING_WALK_MISMATCH' FROM ringed r JOIN g ON r.crop = g.crop WHERE ring_walk <> implied_ring)
 SELECT l.crop, tag, CAST(count(*) AS BIGINT) AS n, CAST(max(ring_walk) AS BIGINT) AS ring_walk FROM l LEFT JOIN ringed r ON l.crop = r.crop GROUP BY l.crop, tag"""
INDEX["words_in_slots"] = INDEX["words_in_slots"].replace("c.sy + 60 AND", "c.sy - 60 AND")

_FULL = f"{PIXELS}, grid AS (SELECT crop, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT crop FROM pixels) c, range(24) AS a(y), range(24) AS b(x)), full_image AS (SELECT g.crop, g.y, g.x, coalesce(p.v, 0) AS v FROM grid g LEFT JOIN pixels p ON g.crop = p.crop AND g.y = p.y AND g.x = p.x), mask AS (SELECT crop, y, x, v > 128 AS on_ink FROM full_image)"
_DISC5 = "disc AS (SELECT dy, dx FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx) WHERE abs(dy) < 2 OR dx = 0)"


def _spread(table: str, shape: str, pick: str) -> str:
    """Values of a table under a shape of offsets."""
    return f"SELECT p.crop, p.y, p.x, {pick}(q.v) AS v FROM {table} p, {shape} s JOIN {table} q ON q.crop = p.crop AND q.y = p.y + s.dy AND q.x = p.x + s.dx GROUP BY p.crop, p.y, p.x"


_OFFSETS = "near AS (SELECT dy, dx FROM range(-1, 2) AS a(dy), range(-1, 2) AS b(dx))"
_MARKS3 = "m3 AS (SELECT k AS node, 5 + 7*k AS cx, 19 - 7*k AS cy, 3 + k AS r FROM range(3) AS t(k))"
_BLUR = "taps AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-(d*d) / (2 * 5.0 * 5.0)) AS w FROM range(-15, 16) AS t(d)) u)"


def _points(reach: str, n: int) -> str:
    place = lambda c, f: f"least(23, greatest(0, CAST(trunc(round({c} + {reach} * {f}(2 * pi() * k / {n}), 9)) AS INT)))"
    return f"SELECT i.crop, m.node, count(*) FILTER (WHERE f.v > 128) AS n FROM (SELECT DISTINCT crop FROM pixels) i, m3 m, range({n}) AS t(k) JOIN full_image f ON f.crop = i.crop AND f.y = {place('m.cy', 'sin')} AND f.x = {place('m.cx', 'cos')} GROUP BY i.crop, m.node"


INDEX |= {
    "median_pixels": f"WITH {_FULL}, {_OFFSETS} SELECT p.crop, p.y, p.x, CAST(quantile_disc(q.v, 0.5) AS INT) AS v FROM full_image p, near s JOIN full_image q ON q.crop = p.crop AND q.y = least(23, greatest(0, p.y + s.dy)) AND q.x = least(23, greatest(0, p.x + s.dx)) GROUP BY p.crop, p.y, p.x",
    "ink_pixels": f"""WITH {_FULL}, {_BLUR}, rows_done AS (SELECT p.crop, p.y, p.x, sum(q.v * t.w) AS v FROM full_image p, taps t JOIN full_image q ON q.crop = p.crop AND q.x = p.x AND q.y = least(23, greatest(0, p.y + t.d)) GROUP BY p.crop, p.y, p.x),
      blurred AS (SELECT p.crop, p.y, p.x, sum(q.v * t.w) AS v FROM rows_done p, taps t JOIN rows_done q ON q.crop = p.crop AND q.y = p.y AND q.x = least(23, greatest(0, p.x + t.d)) GROUP BY p.crop, p.y, p.x)
      SELECT f.crop, f.y, f.x, CASE WHEN f.v <= round_even(b.v, 0) - 8 THEN 255 ELSE 0 END AS v FROM full_image f JOIN blurred b ON f.crop = b.crop AND f.y = b.y AND f.x = b.x""",
    "eroded_pixels": f"WITH {_FULL}, {_OFFSETS} {_spread('full_image', 'near', 'min')}",
    "closed_pixels": f"WITH {_FULL}, {_DISC5}, wide AS ({_spread('full_image', 'disc', 'max')}) {_spread('wide', 'disc', 'min')}",
    "local_maxima": f"WITH {_FULL}, {_DISC5} {_spread('full_image', 'disc', 'max')}",
    "component_pixels": f"""WITH RECURSIVE {_FULL}, {_OFFSETS}, lit AS (SELECT crop, y, x, y*24 + x AS k FROM mask WHERE on_ink), pairs AS (SELECT a.crop, a.k, b.k AS other FROM lit a, near s JOIN lit b ON a.crop = b.crop AND b.y = a.y + s.dy AND b.x = a.x + s.dx),
      reach AS (SELECT crop, k, k AS root FROM lit UNION SELECT p.crop, p.other, r.root FROM reach r JOIN pairs p ON p.crop = r.crop AND p.k = r.k WHERE p.other > r.root),
      roots AS (SELECT crop, k, min(root) AS root FROM reach GROUP BY crop, k), linked AS (SELECT r.crop, r.k, r.root FROM roots r),
      step AS (SELECT crop, k, root FROM linked), named AS (SELECT crop, k, dense_rank() OVER (PARTITION BY crop ORDER BY root) AS v FROM step)
      SELECT m.crop, m.y, m.x, CAST(coalesce(n.v, 0) AS INT) AS v FROM mask m LEFT JOIN named n ON m.crop = n.crop AND n.k = m.y*24 + m.x""",
    "distance_pixels": f"WITH {_FULL} SELECT a.crop, a.y, a.x, CAST(CASE WHEN a.on_ink THEN min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) ELSE 0 END AS INT) AS v FROM mask a JOIN mask b ON a.crop = b.crop AND NOT b.on_ink GROUP BY a.crop, a.y, a.x, a.on_ink",
    "rim_ink": f"WITH {_FULL}, {_MARKS3}, rim AS ({_points('m.r', 24)}), wide AS ({_points('(1.5 * m.r)', 8)}) SELECT rim.crop, rim.node, rim.n AS rim, wide.n AS radial FROM rim JOIN wide ON rim.crop = wide.crop AND rim.node = wide.node",
    "disc_shares": f"WITH {_FULL}, {_MARKS3} SELECT f.crop, m.node, round(avg(CASE WHEN f.v > 128 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CAST(f.v AS DOUBLE)), 6) AS mean FROM full_image f JOIN m3 m ON (f.x-m.cx)*(f.x-m.cx) + (f.y-m.cy)*(f.y-m.cy) <= m.r*m.r GROUP BY f.crop, m.node",
    "point_clusters": f"""WITH RECURSIVE {NODES}, f AS (SELECT crop, -1 AS id, CAST([] AS INT[]) AS sx, CAST([] AS INT[]) AS sy, CAST([] AS INT[]) AS n FROM (SELECT DISTINCT crop FROM nodes)
      UNION ALL SELECT crop, id, CASE WHEN home IS NULL THEN list_append(sx, x) ELSE list_transform(sx, lambda v, k: CASE WHEN k = home THEN v + x ELSE v END) END, CASE WHEN home IS NULL THEN list_append(sy, y) ELSE list_transform(sy, lambda v, k: CASE WHEN k = home THEN v + y ELSE v END) END, CASE WHEN home IS NULL THEN list_append(n, 1) ELSE list_transform(n, lambda v, k: CASE WHEN k = home THEN v + 1 ELSE v END) END
      FROM (SELECT p.crop, p.id, p.x, p.y, f.sx, f.sy, f.n, list_filter(range(1, len(f.n) + 1), lambda k: power(p.x - f.sx[k] / f.n[k], 2) + power(p.y - f.sy[k] / f.n[k], 2) <= 14400)[1] AS home FROM f JOIN nodes p ON p.crop = f.crop AND p.id = f.id + 1) q),
      e AS (SELECT f.* FROM f JOIN (SELECT crop, max(id) AS id FROM nodes GROUP BY crop) l ON f.crop = l.crop AND f.id = l.id) SELECT crop, CAST(k AS INT) AS place, CAST(trunc(sx[k+1] / n[k+1]) AS INT) AS x, CAST(trunc(sy[k+1] / n[k+1]) AS INT) AS y FROM e, unnest(range(len(n))) AS u(k)""",
    "edit_rings": """WITH RECURSIVE k AS (SELECT l_suppkey AS crop, l_partkey % 4 IN (1, 3) AS up, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 1000000 + l_partkey * 10 + l_linenumber, CASE l_partkey % 4 WHEN 1 THEN '+' WHEN 3 THEN '=' ELSE '-' END) AS i FROM lineitem),
      f AS (SELECT DISTINCT crop, CAST(0 AS BIGINT) AS i, 6 AS ring FROM k UNION ALL SELECT k.crop, k.i, greatest(3, f.ring + CASE WHEN up THEN 1 ELSE -1 END) FROM f JOIN k ON k.crop = f.crop AND k.i = f.i + 1) SELECT f.crop, f.ring FROM f JOIN (SELECT crop, max(i) AS i FROM k GROUP BY crop) m ON f.crop = m.crop AND f.i = m.i""",
    "edit_shapes": """SELECT l_orderkey AS crop, CAST(l_partkey % 3 * 100 AS INT) AS x, CAST(l_suppkey % 2 * 100 AS INT) AS y, CASE (count(*) - 1) % 4 WHEN 0 THEN 'solid_dot' WHEN 1 THEN 'open_circle' WHEN 2 THEN 'square' ELSE 'triangle' END AS shape, CAST(5 + (count(*) - 1) % 4 AS INT) AS degree FROM lineitem GROUP BY l_orderkey, l_partkey % 3, l_suppkey % 2""",
    "run_files": """SELECT 'page' || lpad(CAST(s_suppkey % 90 AS VARCHAR), 3, '0') || '_cell' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END || '.png' AS crop, CAST(s_suppkey % 90 AS INT) AS page, CAST(s_suppkey % 4 + 1 AS INT) AS node_count, CAST(s_suppkey % 4 + 1 AS INT) AS n_nodes, CAST(s_suppkey % 4 AS INT) AS n_edges,
      CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE -1 END AS labeled_ring, s_suppkey % 2 = 0 AS euler_valid, 'é "note"' AS validation_note, CASE WHEN s_suppkey % 2 = 1 THEN 'A: x|B: ' || s_suppkey ELSE '' END AS failures, CAST(30 * (s_suppkey % 4) * (s_suppkey % 4 + 1) // 2 AS INT) AS xs FROM supplier""",
    "canonical_files": """WITH s AS (SELECT *, 'page' || lpad(CAST(s_suppkey % 90 AS VARCHAR), 3, '0') || '_cell' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS id FROM supplier) SELECT id || '.json' AS file_name, id, CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE -1 END AS ring_size, CAST(s_suppkey % 4 + 1 AS INT) AS n_vertices, CAST(s_suppkey % 4 AS INT) AS n_edges, CAST(s_suppkey % 50 AS DOUBLE) AS y0,
      CASE WHEN s_suppkey % 5 = 0 THEN 'cv+hitl' ELSE 'cv' END AS extraction, s_suppkey % 5 = 0 AS human_corrected, 'Part II PDF, page ' || (s_suppkey % 90) AS source_document FROM s""",
    "label_files": "SELECT 'crop ' || s_suppkey AS crop, CAST(5 + s_suppkey % 10 AS INT) AS ring FROM supplier",
    "index_files": "SELECT 'crop ' || (s_suppkey % 40) AS crop, CAST(-max(s_suppkey) AS INT) AS rank, CAST(max(s_suppkey) AS INT) AS figure, CAST(max(s_suppkey) % 35 AS INT) AS position FROM supplier WHERE s_suppkey % 7 > 0 GROUP BY s_suppkey % 40",
    "golden_files": "SELECT 'page' || lpad(CAST(s_suppkey % 90 AS VARCHAR), 3, '0') || '_cell' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END || '.png' AS crop, CAST(5 + s_suppkey % 10 AS INT) AS ring, CAST(s_suppkey % 4 + 1 AS INT) AS n_nodes, CAST(s_suppkey % 4 AS INT) AS n_edges, 'by hand' AS provenance FROM supplier",
    "crop_files": "SELECT 'page' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '_cell' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 3, '0') || '.png' AS crop, CAST(n_nationkey AS INT) AS page, 4 AS height, 16 AS bytes, CAST(n_nationkey AS INT) AS first FROM nation WHERE n_nationkey >= 14",
    "gated_saves": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'saved' ELSE 'rejected' END AS fate FROM supplier",
    "queue_pointers": "SELECT s_suppkey, 'junction' AS kind, 2 AS x, CAST(s_suppkey AS INT) AS y FROM supplier UNION ALL SELECT s_suppkey, 'junction', CAST(s_suppkey AS INT), 7 FROM supplier",
    "node_gates": """WITH p AS (SELECT p_partkey, (p_partkey % 101) / 100.0 AS share, p_partkey % 4 AS n, 10 + p_partkey % 9 AS radius, (p_partkey * 7 % 101) / 100.0 AS rim, 100 + p_partkey * 3 % 156 AS centre, 300 + p_partkey * 11 % 5000 AS area, 60 + p_partkey % 300 AS length, 3 + p_partkey % 3 AS corners FROM part)
      SELECT p_partkey, share >= 0.65 AND (n >= 2 OR (radius >= 14 AND n = 1)) AS solid, share >= 0.5 AS weak_solid, centre >= 160 AND n >= 2 AND rim >= 0.45 AS circle, centre >= 140 AND rim >= 0.35 AS weak_circle, CASE WHEN area < 400 OR area > 5000 OR 4 * pi() * area / (length * length) >= 0.72 THEN NULL WHEN corners = 3 THEN 'triangle' WHEN corners = 4 THEN 'square' END AS polygon FROM p""",
    "slot_occupancy": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 5 = 0 THEN false ELSE c_custkey * 37 % 8000 >= 4000 END AS occupied FROM customer",
    "word_places": "WITH p AS (SELECT CAST(c_custkey AS INT) AS page, 2.0 * (c_custkey % 7 + c_custkey % 13) AS x, 2.0 * (c_custkey % 11 + c_custkey % 17) AS y FROM customer) SELECT page, CAST(0.5 * x - 2.0 * y + 1.0 AS DOUBLE) AS cx, CAST(2.0 * x + 0.5 * y - 3.0 AS DOUBLE) AS cy FROM p",
}
