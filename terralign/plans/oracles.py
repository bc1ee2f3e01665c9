"""DuckDB statements for the registered queries: same column names, results and rounding."""

from __future__ import annotations

import math

from terralign.functions import projection

PX = """px AS (SELECT vec_id AS id, CAST(vec_id // 20 AS INT) AS "row", CAST(vec_id % 20 AS INT) AS col, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ix AS (SELECT *, CASE WHEN abs(v[41] + v[11]) > 1e-12 THEN (v[41] - v[11]) / (v[41] + v[11]) ELSE 0 END AS ndvi, list_sum(v) AS band_sum FROM px),
valid AS (SELECT * FROM ix WHERE ndvi > 0 AND band_sum > 1e-5)"""
UNIT = """, u AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS w FROM px)"""
LONG = """, long AS (SELECT id, "row", col, b AS band, v[b + 1] AS x FROM px, range(64) t(b)),
stats AS (SELECT band, avg(x) AS mean, stddev_pop(x) AS std FROM long GROUP BY band)"""
POINTS = """pts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 97 AS DOUBLE) AS z FROM part),
loc AS (SELECT *, CAST(floor((y - 8.5) * 2.5 / (2.5 * 0.075)) AS INT) AS "row", CAST(floor(x * 0.075 / (2.5 * 0.075)) AS INT) AS col FROM pts)"""
QUERYPTS = """, q AS (SELECT * FROM pts WHERE id % 20 = 0),
d AS (SELECT q.id, p.id AS nbr, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz FROM q JOIN pts p ON p.id <> q.id),
k AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2, row_number() OVER (PARTITION BY id ORDER BY dx * dx + dy * dy + dz * dz, nbr) AS rank FROM d)"""
TELE = """s AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS s, value AS power, CAST(user_id AS DOUBLE) AS util, event_type AS kind, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS day FROM events),
ph AS (SELECT DISTINCT day, n AS name, CAST(day * 86400 + a AS DOUBLE) AS "start", CAST(day * 86400 + a + 43200 AS DOUBLE) AS stop FROM s, (VALUES ('load', 0), ('idle', 43200)) k(n, a))"""
TIMES = """t AS (SELECT event_type AS stage, CAST(user_id % 10 AS INT) AS rep, CASE WHEN event_id % 2 = 0 THEN 'fwd' ELSE 'rev' END AS round, value AS ms, event_id, user_id FROM events)"""
TOTALS = TIMES + ", tot AS (SELECT stage, rep, sum(ms) AS t FROM t GROUP BY stage, rep)"


def _match(pixels: str, radius: int) -> str:
    return f""", c AS (SELECT p.id, q."row", q.col, list_dot_product(p.w, q.w) AS cosine, sqrt(CAST((q."row" - p."row") ** 2 + (q.col - p.col) ** 2 AS DOUBLE)) AS dist
FROM u p JOIN u q ON abs(p."row" - q."row") <= {radius} AND abs(p.col - q.col) <= {radius} WHERE p.id <> q.id AND {pixels}),
s AS (SELECT *, cosine - 0.2 * dist / 5 AS spatial FROM c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, "row", col) AS n FROM s) WHERE n = 1),
best2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY spatial DESC, "row", col) AS n FROM s) WHERE n = 1),
odd AS (SELECT id FROM px)"""


VALID = "q.id IN (SELECT id FROM valid)"
ANY = "true"


def z(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


PATCH = """, cells AS (SELECT c."row", c.col, b AS band, (dr + 1) * 3 + dc + 1 AS slot, coalesce({value}, 0) AS x
FROM valid c CROSS JOIN (VALUES (-1), (0), (1)) a(dr) CROSS JOIN (VALUES (-1), (0), (1)) e(dc) CROSS JOIN range(64) t(b)
LEFT JOIN long l ON l."row" = c."row" + dr AND l.col = c.col + dc AND l.band = b LEFT JOIN stats st ON st.band = b)"""



def _utm() -> str:
    """The inverse projection step by step: constants of WGS 84 and of the series, then five Newton steps for the latitude."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = projection._series(n)[1]
    sums = {
        k: " ".join(f"- ({b!r}) * {a}({2 * j} * x) * {h}({2 * j} * y)" for j, b in enumerate(beta, 1))
        for k, (a, h) in {"xi": ("sin", "cosh"), "eta": ("cos", "sinh")}.items()
    }
    steps = ""
    for k in range(5):
        sigma, guess = f"sinh({e!r} * atanh({e!r} * t / sqrt(1 + t * t)))", "t * sqrt(1 + s * s) - s * sqrt(1 + t * t)"
        steps += f""", s{k} AS (SELECT *, {sigma} AS s FROM t{k}), g{k} AS (SELECT *, {guess} AS g FROM s{k}),
t{k + 1} AS (SELECT k, lon, c, t + (c - g) / sqrt(1 + g * g) * (1 + {1 - e * e!r} * t * t) / ({1 - e * e!r} * sqrt(1 + t * t)) AS t FROM g{k})"""
    return f"""WITH a AS (SELECT c_custkey AS k, (1000.0::DOUBLE * (c_custkey % 9000)) / {0.9996 * radius!r} AS x, (30 * c_acctbal) / {0.9996 * radius!r} AS y FROM customer),
b AS (SELECT k, x {sums['xi']} AS xi, y {sums['eta']} AS eta FROM a),
t0 AS (SELECT k, degrees(atan2(sinh(eta), cos(xi))) + 15 AS lon, sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi)) AS c, c AS t FROM b){steps}
SELECT k AS c_custkey, round(lon, 8) + 0.0 AS lon, round(degrees(atan(t)), 8) + 0.0 AS lat FROM t5"""


ORACLES: dict[str, str] = {
    "utm_lonlat": _utm(),
    "encode_linear": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256) / 256) AS v FROM embeddings) SELECT vec_id, "
    + ", ".join(f"CASE WHEN vec_id % 7 <> 3 THEN list_dot_product(v, list_transform(range(64), lambda i: CAST((7 * i + {3 * j}) % 11 - 5 AS DOUBLE))) END AS f{j}" for j in range(8)) + " FROM v",
    "ndvi_mask": f"WITH {PX} SELECT id, {z('ndvi')} AS ndvi, {z('band_sum')} AS band_sum, CAST(ndvi > 0 AND band_sum > 1e-5 AS INT) AS valid FROM ix",
    "valid_count": f"WITH {PX} SELECT (SELECT count(*) FROM px) AS n_pixels, (SELECT count(*) FROM valid) AS n_valid",
    "pixel_affine": f"""WITH f AS (SELECT c_custkey, ((c_custkey - 12.0) * 25.0 - (c_acctbal + 500.0) * -0.5) / (25.0 * 4.0 - 1.5 * -0.5) AS fr, ((c_acctbal + 500.0) * 4.0 - (c_custkey - 12.0) * 1.5) / (25.0 * 4.0 - 1.5 * -0.5) AS fc FROM customer)
SELECT c_custkey, {z('fr')} AS frow, {z('fc')} AS fcol, CAST(floor(fr) AS BIGINT) AS "row", CAST(floor(fc) AS BIGINT) AS col, CAST(floor(fr) >= 0 AND floor(fr) < 400 AND floor(fc) >= 0 AND floor(fc) < 300 AS INT) AS inside FROM f""",
    "geotransform_check": "SELECT c_custkey, CAST(6.25 AS DOUBLE) AS det FROM customer",
    "l2_normalize": f"WITH {PX}{UNIT} SELECT id, {z('w[1]')} AS v0, {z('w[64]')} AS v63, {z('list_sum(w)')} AS v_sum FROM u",
    "paired_cosine": f"""WITH {PX}, o AS (SELECT id, v, list_transform(v, lambda x: round(x, 1)) AS w FROM px)
SELECT id, {z('list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-12) * (sqrt(list_dot_product(w, w)) + 1e-12))')} AS cosine, {z('list_max(list_transform(range(1, 65), lambda i: abs(v[i] - w[i])))')} AS max_abs FROM o""",
    "lower_bound_ratio": "SELECT p_partkey, CAST(CAST(round(p_retailprice * 100) AS BIGINT) // p_size AS DOUBLE) / 100 AS ratio FROM part",
    "layer_classify": "SELECT CASE WHEN p_name LIKE 'red%' THEN 'warm' WHEN p_name LIKE 'blue%' THEN 'cold' WHEN p_name LIKE '%widget%' THEN 'part' WHEN p_name LIKE '%ring' THEN 'round' ELSE 'other' END AS grp, count(*) AS n FROM part GROUP BY 1",
    "name_tags": "SELECT c_custkey, c_mktsegment AS batch, CAST(c_nationkey AS VARCHAR) AS date, 'a+' || c_custkey AS sid, c_mktsegment || '_' || c_nationkey || '_a_' || c_custkey AS tag, '/data/' || c_mktsegment || '/' || c_nationkey || '/a+' || c_custkey || '/raster.dat' AS path FROM customer",
    "band_stats": f"WITH {PX}{LONG} SELECT CAST(band AS INT) AS band, {z('mean')} AS mean, {z('std')} AS std FROM stats",
    "standardize": f"WITH {PX}{LONG} SELECT id, CAST(band AS INT) AS band, {z('(x - mean) / (std + 1e-8)')} AS z FROM long JOIN stats USING (band)",
    "patch3x3": f"""WITH {PX}{LONG}{PATCH.format(value='l.x')}
SELECT "row", col, CAST(count(*) AS INT) AS n, {z('sum(x)')} AS total, {z('sum(CASE WHEN band = 0 THEN x ELSE 0 END)')} AS band0, CAST(count(*) FILTER (x = 0) AS INT) AS n_zero FROM cells GROUP BY "row", col""",
    "fused_patch": f"""WITH {PX}{LONG}{PATCH.format(value='(l.x - st.mean) / (st.std + 1e-8)')}
SELECT "row", col, {z('sum(x * ((band * 9 + slot) % 7))')} AS weighted FROM cells GROUP BY "row", col""",
    "eligible_points": f'WITH {PX}, {POINTS} SELECT l.id, l."row", l.col FROM loc l JOIN valid v ON l."row" = v."row" AND l.col = v.col',
    "sample_points": f"""WITH {PX}, {POINTS} SELECT l.id, l."row", l.col FROM loc l JOIN valid v ON l."row" = v."row" AND l.col = v.col ORDER BY md5('20260617:' || l.id), l.id LIMIT 50""",
    "split_samples": "SELECT split, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 100 THEN 'calibration' WHEN row_number() OVER (ORDER BY vec_id) <= 150 THEN 'validation' ELSE 'rest' END AS split FROM embeddings) GROUP BY split",
    "window_cover": f'WITH {PX}, {POINTS} SELECT "row", col FROM valid v WHERE EXISTS (SELECT 1 FROM loc l WHERE abs(l."row" - v."row") <= 1 AND abs(l.col - v.col) <= 1)',
    "pixel_index": f'WITH {PX} SELECT "row", col, row_number() OVER (ORDER BY "row", col) - 1 AS idx FROM valid',
    "window_match": f'WITH {PX}{UNIT}{_match(VALID, 5)} SELECT id, "row", col, {z("cosine")} AS cosine, {z("dist")} AS displacement FROM odd LEFT JOIN best USING (id)',
    "window_match_multi": f'WITH {PX}{UNIT}{_match(ANY, 5)} SELECT id, a."row", a.col, {z("a.cosine")} AS cosine, {z("a.dist")} AS displacement, b."row" AS row2, b.col AS col2, {z("b.spatial")} AS score2 FROM odd LEFT JOIN best a USING (id) LEFT JOIN best2 b USING (id)',
    "match_margin": f"""WITH {PX}{UNIT}{_match(VALID, 1)}, two AS (SELECT id, max(cosine) FILTER (n = 1) AS a, max(cosine) FILTER (n = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC) AS n FROM c) GROUP BY id)
SELECT id, {z('a')} AS top1, {z('b')} AS top2, {z('a - b')} AS margin FROM odd LEFT JOIN two USING (id)""",
    "match_agreement": f"""WITH {PX}{UNIT}{_match(ANY, 5)} SELECT count(*) AS n, {z('avg(CAST(a."row" = b."row" AND a.col = b.col AS INT))')} AS agreement, {z('avg(a.dist - b.dist)')} AS mean_gap, {z('median(a.dist - b.dist)')} AS median_gap FROM odd LEFT JOIN best a USING (id) LEFT JOIN best2 b USING (id)""",
    "spectrum_error": f"""WITH {PX}{UNIT}{_match(ANY, 5)}, e AS (SELECT list_max(list_transform(range(1, 65), lambda i: abs(t.v[i] - m.v[i]))) AS e FROM best b JOIN px t ON t.id = b.id JOIN px m ON m."row" = b."row" AND m.col = b.col)
SELECT count(*) AS n, {z('avg(e)')} AS mean, {z('median(e)')} AS median FROM e""",
    "variant_report": f"""WITH {PX}{UNIT}{_match(VALID, 1)}, px2 AS (SELECT id, "row", col, list_transform(v, lambda x: round(x, 2)) AS v FROM px),
u2 AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS w FROM px2),
c2 AS (SELECT p.id, q."row", q.col, list_dot_product(p.w, q.w) AS cosine, sqrt(CAST((q."row" - p."row") ** 2 + (q.col - p.col) ** 2 AS DOUBLE)) AS dist
FROM u2 p JOIN u2 q ON abs(p."row" - q."row") <= 1 AND abs(p.col - q.col) <= 1 WHERE p.id <> q.id AND {VALID}),
s2 AS (SELECT *, cosine - 0.2 * dist / 5 AS spatial FROM c2),
other AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, "row", col) AS n, row_number() OVER (PARTITION BY id ORDER BY spatial DESC, "row", col) AS m FROM s2),
runs AS (SELECT 'plain' AS variant, px.id, a."row" AS r1, a.col AS c1, a.dist AS d1, a.cosine AS k1, b."row" AS r2, b.col AS c2, b.dist AS d2 FROM px LEFT JOIN best a USING (id) LEFT JOIN (SELECT * FROM other WHERE n = 1) b USING (id)
UNION ALL SELECT 'spatial', px.id, a."row", a.col, a.dist, a.cosine, b."row", b.col, b.dist FROM px LEFT JOIN best2 a USING (id) LEFT JOIN (SELECT * FROM other WHERE m = 1) b USING (id)),
e AS (SELECT runs.*, CASE WHEN t.v IS NOT NULL AND m.v IS NOT NULL THEN list_max(list_transform(range(1, 65), lambda i: abs(t.v[i] - m.v[i]))) END AS e FROM runs JOIN px t ON t.id = runs.id LEFT JOIN px m ON m."row" = r1 AND m.col = c1)
SELECT variant, count(*) AS n, count(*) FILTER (r1 IS NULL) AS n_none, {z('avg(CAST(r1 IS NOT DISTINCT FROM r2 AND c1 IS NOT DISTINCT FROM c2 AS INT))')} AS agreement,
{z('avg(d1)')} AS displacement_mean, {z('avg(abs(d1 - d2))')} AS displacement_gap, {z('avg(k1)')} AS cosine_mean, {z('avg(e)')} AS error_mean, {z('median(e)')} AS error_median FROM e GROUP BY variant""",
    "near_tie_check": f"""WITH {PX}{UNIT}{_match(ANY, 5)}, two AS (SELECT id, max(cosine) FILTER (n = 1) - max(cosine) FILTER (n = 2) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC) AS n FROM c) GROUP BY id),
x AS (SELECT coalesce(m < 0.06, false) AS near FROM best a JOIN best2 b USING (id) LEFT JOIN two USING (id) WHERE a."row" <> b."row" OR a.col <> b.col)
SELECT count(*) AS n, count(*) FILTER (near) AS n_near, CAST(coalesce(bool_and(near), true) AS INT) AS all_near FROM x""",
    "knn_canonical": f"WITH {POINTS}{QUERYPTS} SELECT id, CAST(rank AS INT) AS rank, nbr, {z('d2')} AS d2 FROM k WHERE rank <= 15",
    "knn_offsets": f"WITH {POINTS}{QUERYPTS} SELECT id, CAST(rank - 1 AS INT) AS k, {z('dx')} AS dx, {z('dy')} AS dy, {z('dz')} AS dz FROM k WHERE rank <= 15",
    "knn_ties": f"""WITH {POINTS}{QUERYPTS}, n AS (SELECT id, rank, d2, lead(d2) OVER (PARTITION BY id ORDER BY rank) AS e FROM k WHERE rank <= 16),
f AS (SELECT id, coalesce(bool_or(d2 = e) FILTER (rank < 15), false) OR coalesce(bool_or(d2 = 0) FILTER (rank = 1), false) AS a, coalesce(bool_or(d2 = e) FILTER (rank = 14), false) AS l, coalesce(bool_or(d2 = e) FILTER (rank = 15), false) AS b FROM n GROUP BY id),
o AS (SELECT id, nbr, d2, row_number() OVER (PARTITION BY id ORDER BY d2, nbr DESC) AS rank FROM k),
x AS (SELECT id, list(nbr ORDER BY rank) AS l, list(nbr ORDER BY nbr) AS s FROM k WHERE rank <= 15 GROUP BY id),
y AS (SELECT id, list(nbr ORDER BY rank) AS l, list(nbr ORDER BY nbr) AS s FROM o WHERE rank <= 15 GROUP BY id)
SELECT count(*) AS n_queries, count(*) FILTER (a) AS n_inside, count(*) FILTER (f.l) AS n_at_last, count(*) FILTER (b) AS n_at_cut, count(*) FILTER (x.s <> y.s) AS n_set_changed, count(*) FILTER (x.l <> y.l) AS n_order_changed FROM f JOIN x USING (id) JOIN y USING (id)""",
    "bbox": f"WITH {POINTS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts",
    "nearest_linf": f"""WITH {PX}, l AS (SELECT p.id, q.id AS other, list_max(list_transform(range(1, 65), lambda i: abs(p.v[i] - q.v[i]))) AS d FROM px p JOIN px q ON p.id % 20 = 0 AND p.id <> q.id)
SELECT id, other, {z('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS n FROM l) WHERE n = 1""",
    "accuracy_report": f"""WITH {PX}, t AS (SELECT v, list_transform(v, lambda x: round(x, 2)) AS w FROM px),
e AS (SELECT list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-12) * (sqrt(list_dot_product(w, w)) + 1e-12)) AS c, list_transform(range(1, 65), lambda i: abs(v[i] - w[i])) AS d, list_dot_product(v, v) AS r2 FROM t)
SELECT count(*) AS n, {z('avg(c)')} AS mean_cosine, {z('min(c)')} AS min_cosine, {z('max(list_max(d))')} AS max_abs, {z('sum(list_sum(d)) / sum(len(d))')} AS mean_abs, {z('sqrt(sum(list_dot_product(d, d))) / sqrt(sum(r2))')} AS relative_l2 FROM e""",
    "rank_agreement": f"""WITH {PX}, t AS (SELECT id, list_transform(v, lambda x: round(x, 2)) AS w, v FROM px),
n AS (SELECT id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v, list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) + 1e-12)) AS w FROM t),
a AS (SELECT id, other FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY list_dot_product(p.v, q.v) DESC, q.id) AS k FROM n p JOIN n q ON p.id <> q.id) WHERE k = 1),
b AS (SELECT id, other FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY list_dot_product(p.w, q.w) DESC, q.id) AS k FROM n p JOIN n q ON p.id <> q.id) WHERE k <= 5)
SELECT count(*) AS n, {z('avg(CAST(b.id IS NOT NULL AS INT))')} AS agreement FROM a LEFT JOIN b ON a.id = b.id AND a.other = b.other""",
    "margin_stats": f"""WITH {PX}{UNIT}, k AS (SELECT id, s, n FROM (SELECT p.id, list_dot_product(p.w, q.w) AS s, row_number() OVER (PARTITION BY p.id ORDER BY list_dot_product(p.w, q.w) DESC) AS n FROM u p JOIN u q ON p.id <> q.id) WHERE n <= 2),
m AS (SELECT id, max(s) - min(s) AS m FROM k GROUP BY id HAVING count(*) = 2)
SELECT count(*) AS n, {z('avg(m)')} AS mean, {z('median(m)')} AS median, {z('quantile_cont(m, 0.1)')} AS p10, {z('min(m)')} AS least FROM m""",
    "bit_equality": f"""WITH {PX}, b AS (SELECT id, "row", CASE WHEN id % 3 = 0 THEN col + 1 ELSE col END AS col, v FROM px WHERE id % 50 <> 7),
j AS (SELECT px."row" IS DISTINCT FROM b."row" AS r, px.col IS DISTINCT FROM b.col AS c, px.v IS DISTINCT FROM b.v AS s FROM px JOIN b USING (id)),
m AS (SELECT (SELECT count(*) FROM px) - (SELECT count(*) FROM b) AS missing)
SELECT 'row' AS name, count(*) AS n_both, (SELECT missing FROM m) AS n_missing, count(*) FILTER (r) AS n_differing, 0 AS equal FROM j
UNION ALL SELECT 'col', count(*), (SELECT missing FROM m), count(*) FILTER (c), 0 FROM j
UNION ALL SELECT 'spectrum', count(*), (SELECT missing FROM m), count(*) FILTER (s), 0 FROM j""",
    "differing_elements": f"""WITH {PX}, t AS (SELECT id, list_transform(v, lambda x: round(x, 1)) AS a, list_transform(v, lambda x: round(x * 1.01, 1)) AS b FROM px)
SELECT id, CAST(len(list_filter(range(1, 65), lambda i: a[i] IS DISTINCT FROM b[i])) AS INT) AS n_differing, 1 AS same_members, {z('list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))')} AS max_abs FROM t""",
    "threshold_gate": f"""WITH {PX}, m AS (SELECT * FROM (VALUES ('fp32', 6, 0.999, 1e-4), ('fp16', 2, 0.999999, NULL), ('int8', 1, NULL, NULL)) x(mode, digits, least_cosine, most_abs)),
t AS (SELECT mode, least_cosine, most_abs, v, list_transform(v, lambda x: round(x, digits)) AS w FROM px, m),
g AS (SELECT mode, any_value(least_cosine) AS lc, any_value(most_abs) AS ma, min(list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-12) * (sqrt(list_dot_product(w, w)) + 1e-12))) AS c, max(list_max(list_transform(range(1, 65), lambda i: abs(v[i] - w[i])))) AS e FROM t GROUP BY mode)
SELECT mode, {z('c')} AS min_cosine, {z('e')} AS max_abs, CAST(coalesce(c >= lc, true) AND coalesce(e <= ma, true) AS INT) AS passed, CAST(lc IS NULL AND ma IS NULL AS INT) AS report_only FROM g""",
    "declared_ratio": f"SELECT p_partkey, {z('p_retailprice / p_size')} AS ratio FROM part",
    "latency_stats": f"WITH {TIMES} SELECT stage, count(*) AS n, {z('avg(ms)')} AS mean, {z('quantile_cont(ms, 0.5)')} AS p50, {z('quantile_cont(ms, 0.95)')} AS p95, {z('quantile_cont(ms, 0.99)')} AS p99, {z('64000 / avg(ms)')} AS per_second FROM t GROUP BY stage",
    "stage_medians": f"WITH {TIMES} SELECT round, stage, {z('median(ms)')} AS median, {z('min(ms)')} AS least FROM t GROUP BY round, stage",
    "sum_of_medians": f"WITH {TIMES}, m AS (SELECT round, stage, median(ms) AS m FROM t GROUP BY round, stage) SELECT round, {z('sum(m)')} AS with_io, round(sum(m) FILTER (stage NOT IN ('view', 'error')), 6) + 0.0 AS without_io FROM m GROUP BY round",
    "median_of_run_totals": f"WITH {TIMES}, m AS (SELECT round, rep, sum(ms) AS m FROM t GROUP BY round, rep) SELECT round, {z('median(m)')} AS median, count(*) AS n_runs FROM m GROUP BY round",
    "phase_energy": f"""WITH {TELE}, p AS (SELECT name, "start", stop, avg(power) AS p, max(power) AS top, avg(util) AS u, count(*) AS n FROM ph JOIN s ON s.s >= "start" + 1 AND s.s <= stop - 1 GROUP BY name, "start", stop),
i AS (SELECT avg(p) AS idle FROM p WHERE name = 'idle')
SELECT CAST("start" AS BIGINT) AS "start", n AS n_samples, {z('p')} AS mean_power, {z('top')} AS max_power, {z('u')} AS mean_util, {z('p * 43200 / 100')} AS joules, {z('(p - idle) * 43200 / 100')} AS joules_above_idle, {z('100 / 43200.0 / p')} AS per_second_watt FROM p, i WHERE name <> 'idle'""",
    "window_expand_join": f"""WITH {TELE} SELECT name, CAST("start" AS BIGINT) AS "start", count(*) AS n, {z('avg(power)')} AS mean_power FROM ph JOIN s ON s.s >= "start" - 1 AND s.s <= stop + 1 GROUP BY name, "start" """,
    "busy_union": f"""WITH {TELE}, c AS (SELECT day, kind, greatest(s, day * 86400.0) AS a, least(s + power, day * 86400.0 + 86400) AS b, CAST(s >= day * 86400 AND s + power <= day * 86400 + 86400 AS INT) AS whole FROM s),
o AS (SELECT *, max(b) OVER (PARTITION BY day, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE a < b),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY day, kind ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
i AS (SELECT day, kind, island, max(b) - min(a) AS len, sum(b - a) AS total, sum(whole) AS whole FROM n GROUP BY day, kind, island)
SELECT day, kind, {z('sum(len)', 4)} AS busy, {z('sum(total)', 4)} AS total, count(*) AS n_islands, CAST(sum(whole) AS BIGINT) AS n_whole FROM i GROUP BY day, kind""",
    "telemetry_parse": f"""SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) // 1000000 - 28800 AS BIGINT) AS t, CAST(user_id AS INT) AS ram_mb, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS INT) END AS power_mw, {z('value')} AS tj, 5 AS util_pct FROM events WHERE event_id % 7 <> 0""",
    "log_scrape": f"SELECT event_id, {z('value')} AS p50, CAST(user_id AS INT) AS sm_mhz, {z('value')} AS power_w FROM events",
    "temperature_max": f"WITH {TELE} SELECT day, round(max(CASE WHEN kind = 'error' THEN power END), 6) + 0.0 AS tj_max, count(*) FILTER (kind = 'error') AS n FROM s GROUP BY day",
    "cold_start": f"WITH {TOTALS} SELECT stage, {z('median(t)')} AS median, {z('min(t)')} AS least, {z('max(t)')} AS most, count(*) AS n, {z('arg_min(t, rep)')} AS first, {z('arg_max(t, rep)')} AS last FROM tot GROUP BY stage",
    "histogram": "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand",
    "near_optimal_pick": "WITH b AS (SELECT *, min(p_retailprice) OVER (PARTITION BY p_type) AS m FROM part) SELECT p_type, p_retailprice, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice, p_partkey) AS n FROM b WHERE p_retailprice <= m * 1.05) WHERE n = 1",
    "group_ffill": f"WITH {TIMES}, g AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN stage END AS g FROM t) SELECT user_id, event_id, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g",
    "prev_config_diff": f"WITH {TOTALS}, l AS (SELECT *, lag(t) OVER (PARTITION BY stage ORDER BY rep) AS p FROM tot) SELECT stage, rep, {z('p')} AS previous, {z('t - p')} AS diff FROM l",
    "speedup_vs_first": f"WITH {TOTALS} SELECT stage, rep, {z('t')} AS t, {z('first_value(t) OVER (PARTITION BY stage ORDER BY rep) / t')} AS speedup FROM tot",
    "greedy_prefix": f"WITH {TOTALS}, o AS (SELECT stage, rep, round(t, 2) AS t FROM tot), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY stage ORDER BY t DESC, rep) AS INT) AS rank, coalesce(sum(t) OVER (PARTITION BY stage ORDER BY t DESC, rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) SELECT stage, rep, rank, {z('t')} AS t FROM w WHERE before < 5000",
    "pairwise_build_diff": f"WITH {TOTALS} SELECT stage, count(*) AS n, {z('stddev_pop(t)')} AS std, {z('max(t) - min(t)')} AS range, 1 AS all_there FROM tot GROUP BY stage",
    "runner_overhead": f"""WITH {TIMES}, m AS (SELECT stage, median(ms) FILTER (round = 'fwd') AS a, median(ms * 0.8) FILTER (round = 'rev') AS b FROM t GROUP BY stage)
SELECT stage, {z('a')} AS wall, {z('b')} AS device, {z('a - b')} AS overhead, {z('(a - b) / a')} AS share, CAST((a - b) / a > 0.2 AS INT) AS recommended FROM m""",
    "rounds_agree": f"""WITH {TIMES}, m AS (SELECT stage, rep, avg(ms) FILTER (round = 'fwd') AS f, avg(ms) FILTER (round = 'rev') AS r FROM t GROUP BY stage, rep)
SELECT stage, rep, {z('f')} AS fwd, {z('r')} AS rev, {z('(f + r) / 2')} AS mean, {z('abs(f - r) / abs(f)')} AS relative, CAST(coalesce(abs(f - r) / abs(f) < 0.05, false) AS INT) AS agrees FROM m""",
    "layout_rows": "SELECT c_custkey AS key, 'balance' AS variant, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer",
    "deterministic_runs": f"WITH {TIMES}, c AS (SELECT stage, rep, count(*) AS n FROM t GROUP BY stage, rep) SELECT stage, count(DISTINCT n) AS n_counts, CAST(bool_and(n > 100) AS INT) AS all_busy, CAST(count(DISTINCT n) = 1 AS INT) AS same FROM c GROUP BY stage",
    "accuracy_report_full": f"""WITH {PX}, t AS (SELECT id, v AS a, list_transform(v, lambda x: round(x, 2)) AS b FROM px),
n AS (SELECT id, list_transform(a, lambda x: x / (sqrt(list_dot_product(a, a)) + 1e-12)) AS v, list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-12)) AS w FROM t),
a AS (SELECT id, other FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY list_dot_product(p.v, q.v) DESC, q.id) AS k FROM n p JOIN n q ON p.id <> q.id) WHERE k = 1),
b AS (SELECT id, other, k FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY list_dot_product(p.w, q.w) DESC, q.id) AS k FROM n p JOIN n q ON p.id <> q.id) WHERE k <= 5),
g AS (SELECT avg(CAST(coalesce(k <= 1, false) AS INT)) AS top_1, avg(CAST(coalesce(k <= 5, false) AS INT)) AS top_5 FROM a LEFT JOIN b ON a.id = b.id AND a.other = b.other),
e AS (SELECT list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-12) * (sqrt(list_dot_product(w, w)) + 1e-12)) AS c, list_transform(range(1, 65), lambda i: abs(v[i] - w[i])) AS d, list_dot_product(v, v) AS r2 FROM n),
s AS (SELECT count(*) AS n, {z('avg(c)')} AS mean_cosine, {z('min(c)')} AS min_cosine, {z('max(list_max(d))')} AS max_abs, {z('sum(list_sum(d)) / sum(len(d))')} AS mean_abs, {z('sqrt(sum(list_dot_product(d, d))) / sqrt(sum(r2))')} AS relative_l2 FROM e)
SELECT s.*, {z('top_1')} AS top_1, {z('top_5')} AS top_5 FROM s, g""",
    "build_max_abs": f"""WITH {PX}, b AS (SELECT d AS build, id, list_transform(v, lambda x: round(x, d)) AS v FROM px, (VALUES (1), (2), (3)) k(d))
SELECT p.build AS a, q.build AS b, count(*) AS n, {z('max(list_max(list_transform(range(1, 65), lambda i: abs(p.v[i] - q.v[i]))))')} AS max_abs FROM b p JOIN b q ON p.id = q.id AND p.build < q.build GROUP BY p.build, q.build""",
    "unknown_names": "SELECT DISTINCT event_type || '_' || (user_id % 7) AS name FROM events WHERE user_id % 7 = 3 OR event_type LIKE 'view%'",
    "patch_verdict": f"WITH {PX} SELECT id, CAST(id % 11 <> 0 AND list_max(list_transform(v, lambda x: abs(x - round(x, 4)))) <= 4e-5 AS INT) AS passed FROM px",
    "l2_above": f"""WITH {PX}, s AS (SELECT id, list_transform(v, lambda x: x * CASE WHEN id % 3 = 0 THEN 0.0 ELSE 1.0 END) AS v FROM px),
u AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 0.5)) AS w FROM s) SELECT id, {z('w[1]')} AS v0, {z('list_sum(w)')} AS v_sum FROM u""",
    "nearest_norm": f"""WITH {PX}, n AS (SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS x FROM px)
SELECT id, nbr, {z('gap')} AS gap FROM (SELECT p.id, q.id AS nbr, abs(q.x - p.x) AS gap, row_number() OVER (PARTITION BY p.id ORDER BY (q.x - p.x) * (q.x - p.x), q.id) AS k FROM n p JOIN n q ON p.id % 20 = 0 AND p.id <> q.id) WHERE k = 1""",
    "idle_window": f"""WITH {TELE}, a AS (SELECT DISTINCT s AS "start" FROM s WHERE id % 10 = 0)
SELECT {z('"start"')} AS "start", count(*) AS n, {z('avg(power)')} AS mean_power FROM a JOIN s ON s.s >= "start" AND s.s < "start" + 3600 GROUP BY a."start" """,
    "rounds_all_agree": f"""WITH {TIMES}, m AS (SELECT stage, rep, avg(ms) FILTER (round = 'fwd') AS f, avg(ms) FILTER (round = 'rev') AS r FROM t GROUP BY stage, rep),
a AS (SELECT stage, coalesce(abs(f - r) / abs(f) < 0.1, false) AS ok FROM m) SELECT stage, count(*) AS n, count(*) FILTER (ok) AS n_agree, CAST(bool_and(ok) AS INT) AS all_agree FROM a GROUP BY stage""",
    "config_ratio": f"""WITH {TIMES}, p AS (SELECT stage, rep, round, avg(ms) AS v FROM t GROUP BY stage, rep, round), m AS (SELECT stage, rep, avg(v) AS m FROM p GROUP BY stage, rep)
SELECT m.stage, CAST(m.rep AS VARCHAR) AS rep, {z('m.m')} AS mean, {z('b.m / m.m')} AS ratio FROM m LEFT JOIN m b ON b.stage = m.stage AND b.rep = 0""",
    "overhead_vs_benchmark": f"""WITH {TIMES}, w AS (SELECT stage, median(1000 * ms / 64) AS w FROM t GROUP BY stage)
SELECT w.stage, {z('w')} AS wall_us, {z('w - us')} AS overhead_us, {z('w / us')} AS ratio FROM w LEFT JOIN (VALUES ('view', 100.0), ('click', 200.0)) b(stage, us) ON b.stage = w.stage""",
    "finite_gap": f"WITH {TIMES}, x AS (SELECT stage, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN ms END AS x FROM t) SELECT stage, count(x) AS n, {z('avg(x)')} AS mean, {z('median(x)')} AS median FROM x GROUP BY stage",
}
