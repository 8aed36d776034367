"""The registered queries as SQL on the given tables, written independently of the operators."""

from __future__ import annotations

POINTS = """v AS (SELECT vec_id AS point_id, label,
    embedding::DOUBLE[] AS f,
    4 * (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + (embedding[3] > 0)::INT AS octant
  FROM embeddings),
vl AS (SELECT point_id, label, octant, unnest(generate_series(0, 63))::INT AS dim, unnest(f) AS x FROM v)"""

POINTS64 = """p AS (SELECT vec_id AS point_id, label AS cluster_id,
    unnest(generate_series(0, 63))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"""

SEED_STATES = """ss AS (SELECT octant AS cluster_id, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q
  FROM vl WHERE label < 2 GROUP BY 1, 2)"""

ASSIGNED = """md AS (SELECT vl.point_id, ss.cluster_id,
    sqrt(sum(((x - s / n) / sqrt(q / n - (s / n) * (s / n))) ^ 2)) AS distance
  FROM vl JOIN ss USING (dim) WHERE label >= 2 GROUP BY 1, 2),
near AS (SELECT point_id, min(distance) AS distance, arg_min(cluster_id, distance) AS nearest FROM md GROUP BY 1),
asg AS (SELECT point_id, distance,
    CASE WHEN distance >= sqrt({deviations} * {deviations} * 64) THEN -1 ELSE nearest END AS cluster_id FROM near)"""

TRACKS = """t AS (SELECT vec_id, label, n_nationkey AS nk, n_regionkey + 1 AS root, label % 5 + 1 AS second
  FROM embeddings JOIN nation ON vec_id % 25 = n_nationkey),
tracks AS (SELECT vec_id::VARCHAR AS track_id, CASE WHEN label < 2 THEN 'small' ELSE 'large' END AS subset,
    label % 3 = 0 AND root <> second AS two, label, nk, root, second FROM t),
tg AS (SELECT track_id, label, unnest(CASE WHEN two THEN [100 + nk, root, second] ELSE [100 + nk, root] END)::VARCHAR AS genre_id
  FROM tracks),
counts AS (SELECT CASE WHEN label <= 7 THEN label END AS cluster_id, r_name AS genre_title, count(*) AS count
  FROM tg JOIN region ON genre_id = (r_regionkey + 1)::VARCHAR GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, genre_title)::INT AS rank FROM counts),
shares AS (SELECT *, count / sum(count) OVER (PARTITION BY cluster_id) AS portion FROM ranked WHERE rank <= 3)"""

RATINGS = """e AS (SELECT user_id::INT AS user_id, (props::JSON ->> 'k')::INT AS item_id, event_id,
    (1 + least(4, floor(value / 25)))::INT AS rating FROM events),
ratings AS (SELECT user_id, item_id, arg_max(rating, event_id) AS rating FROM e GROUP BY 1, 2),
parts AS (SELECT *, (user_id::BIGINT * 7919 + item_id::BIGINT * 104729) % 10 AS bucket FROM ratings),
train AS (SELECT user_id, item_id, rating FROM parts WHERE bucket >= 1 AND item_id % 37 <> 5),
test AS (SELECT user_id, item_id, rating FROM parts WHERE bucket < 1)"""

MODEL = """um AS (SELECT user_id, avg(rating) AS user_mean FROM train GROUP BY 1),
im AS (SELECT item_id, avg(rating) AS item_mean, count(*) AS n FROM train GROUP BY 1),
mu AS (SELECT avg(rating) AS mu FROM train),
us AS (SELECT count(DISTINCT user_id) AS users FROM ratings),
placed AS (SELECT user_id, item_id, rating, item_id % 5 AS block, user_mean + item_mean - mu AS base
  FROM train JOIN um USING (user_id) JOIN im USING (item_id), mu),
asked AS (SELECT user_id, item_id, rating AS true_rating, item_id % 5 AS block, user_mean + item_mean - mu AS base
  FROM test JOIN um USING (user_id) JOIN im USING (item_id), mu),
cells AS (SELECT u.user_id, im.item_id, coalesce(t.rating, 0) - item_mean AS c
  FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN im LEFT JOIN train t ON t.user_id = u.user_id AND t.item_id = im.item_id),
norms AS (SELECT item_id, sqrt(sum(c * c)) AS norm FROM cells GROUP BY 1),
sims AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.c * b.c) / (any_value(na.norm) * any_value(nb.norm)) AS similarity
  FROM cells a JOIN cells b ON a.user_id = b.user_id AND a.item_id % 5 = b.item_id % 5 AND a.item_id <> b.item_id
  JOIN norms na ON na.item_id = a.item_id JOIN norms nb ON nb.item_id = b.item_id GROUP BY 1, 2),
predicted AS (SELECT a.user_id, a.item_id, a.true_rating,
    any_value(a.base) + sum(similarity * (r.rating - r.base)) / sum(similarity) AS predicted_rating
  FROM asked a JOIN placed r ON a.user_id = r.user_id AND a.block = r.block
  JOIN sims ON i = a.item_id AND j = r.item_id GROUP BY 1, 2, 3)"""


def _scan_near(source: str, eps: float) -> str:
    """DBSCAN of ``source (point_id, f)``: closure of the core points' graph."""
    return f"""near_ AS (SELECT a.point_id AS p, b.point_id AS q FROM {source} a JOIN {source} b
    ON list_distance(a.f, b.f) <= {eps}),
core_ AS (SELECT p FROM near_ GROUP BY p HAVING count(*) >= 5),
link_ AS (SELECT p, q FROM near_ WHERE p IN (SELECT p FROM core_) AND q IN (SELECT p FROM core_)),
reach_ AS (SELECT p, p AS q FROM core_ UNION SELECT r.p, l.q FROM reach_ r JOIN link_ l ON r.q = l.p),
lab_ AS (SELECT q AS p, min(p) AS label FROM reach_ GROUP BY q),
edge_ AS (SELECT n.p, min(l.label) AS label FROM near_ n JOIN lab_ l ON n.q = l.p GROUP BY 1),
scan AS (SELECT s.point_id, coalesce(lab_.label, edge_.label, -1) AS label FROM {source} s
  LEFT JOIN lab_ ON lab_.p = s.point_id LEFT JOIN edge_ ON edge_.p = s.point_id)"""


def _matrix(value: str, source: str) -> str:
    cells = [f"round(coalesce(sum({value}) FILTER (cluster_id IS NULL), 0), 6) AS c_none"]
    cells += [f"round(coalesce(sum({value}) FILTER (cluster_id = {c}), 0), 6) AS c_{c}" for c in range(8)]
    return f"SELECT genre_title, {', '.join(cells)} FROM {source} GROUP BY 1"


def _metrics(points: str) -> str:
    """Metrics of ``points (k, cluster_id, point_id, f)`` with 64 dimensions each."""
    return f"""pl AS (SELECT k, cluster_id, point_id, unnest(generate_series(0, 63)) AS dim, unnest(f) AS x FROM {points}),
cen AS (SELECT k, cluster_id, dim, avg(x) AS c FROM pl GROUP BY 1, 2, 3),
rad AS (SELECT k, cluster_id, count(*) AS n, max(d) AS radius FROM
  (SELECT k, cluster_id, point_id, sqrt(sum((x - c) * (x - c))) AS d FROM pl JOIN cen USING (k, cluster_id, dim) GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
dia AS (SELECT a.k, a.cluster_id, max(list_distance(a.f, b.f)) AS diameter FROM {points} a
  JOIN {points} b ON a.k = b.k AND a.cluster_id = b.cluster_id AND a.point_id <= b.point_id GROUP BY 1, 2),
met AS (SELECT k, cluster_id, n, radius, diameter, n / (radius * radius) AS density_r, n / (diameter * diameter) AS density_d
  FROM rad JOIN dia USING (k, cluster_id))"""


#: Merges that the SQL of a loop has room for, each a few common tables; the tables of the smallest two sizes need fewer.
STEPS = 110


def _ward(k: int) -> str:
    """The cheapest merge, one after the other, until ``k`` clusters are left."""
    parts = ["w0 AS MATERIALIZED (SELECT min(vec_id) AS id, count(*) AS n, embedding::DOUBLE[] AS c, list(vec_id) AS m FROM embeddings WHERE label < 2 GROUP BY embedding)"]
    for i in range(STEPS):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT a.id AS lo, b.id AS hi, a.n * b.n / (a.n + b.n) * list_distance(a.c, b.c) ^ 2 AS cost
            FROM w{i} a JOIN w{i} b ON a.id < b.id WHERE (SELECT count(*) FROM w{i}) > {k} ORDER BY cost, lo, hi LIMIT 1)""")
        parts.append(f"""w{i + 1} AS MATERIALIZED (SELECT id, n, c, m FROM w{i} WHERE id NOT IN (SELECT lo FROM p{i}) AND id NOT IN (SELECT hi FROM p{i})
            UNION ALL SELECT lo, a.n + b.n, list_transform(list_zip(a.c, b.c), lambda z: (a.n * z[1] + b.n * z[2]) / (a.n + b.n)), list_concat(a.m, b.m)
            FROM p{i} JOIN w{i} a ON a.id = lo JOIN w{i} b ON b.id = hi)""")
    return f"""WITH {", ".join(parts)}
        SELECT unnest(m) AS point_id, (dense_rank() OVER (ORDER BY id) - 1)::INT AS cluster_id FROM w{STEPS}"""


def _merge_passes(sets: str, alpha: float) -> str:
    """The first pair in list order that fits, one after the other; a pass ends when none is left, and its merged sets join the next."""
    spread = "list_avg(list_transform(list_zip(s, q), lambda z: z[2] / n - (z[1] / n) * (z[1] / n)))"
    both = """list_avg(list_transform(list_zip(a.s, b.s, a.q, b.q), lambda z: (z[3] + z[4]) / (a.n + b.n) - ((z[1] + z[2]) / (a.n + b.n)) * ((z[1] + z[2]) / (a.n + b.n))))"""
    parts = [
        sets, "g0 AS MATERIALIZED (SELECT 0 AS g)",
        f"""l0 AS MATERIALIZED (SELECT 0 AS gen, row_number() OVER (ORDER BY set_key) AS ord, n, s, q, {spread} AS v, [set_key] AS m FROM (
            SELECT set_key, any_value(n) AS n, list(s ORDER BY dim) AS s, list(q ORDER BY dim) AS q FROM cs GROUP BY set_key))"""]
    for i in range(STEPS):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT a.gen AS ga, a.ord AS oa, b.gen AS gb, b.ord AS ob FROM l{i} a JOIN l{i} b ON a.gen < b.gen OR (a.gen = b.gen AND a.ord < b.ord)
            WHERE a.gen <= (SELECT g FROM g{i}) AND b.gen <= (SELECT g FROM g{i}) AND {both} < {alpha} * greatest(a.v, b.v) ORDER BY ga, oa, gb, ob LIMIT 1)""")
        parts.append(f"""n{i} AS MATERIALIZED (SELECT (SELECT g FROM g{i}) + 1 AS gen, {1000 + i} AS ord, a.n + b.n AS n, list_transform(list_zip(a.s, b.s), lambda z: z[1] + z[2]) AS s,
            list_transform(list_zip(a.q, b.q), lambda z: z[1] + z[2]) AS q, list_concat(a.m, b.m) AS m FROM p{i} JOIN l{i} a ON a.gen = ga AND a.ord = oa JOIN l{i} b ON b.gen = gb AND b.ord = ob)""")
        parts.append(f"""l{i + 1} AS MATERIALIZED (SELECT l.* FROM l{i} l WHERE NOT EXISTS (SELECT 1 FROM p{i} WHERE (gen = ga AND ord = oa) OR (gen = gb AND ord = ob))
            UNION ALL SELECT gen, ord, n, s, q, {spread} AS v, m FROM n{i})""")
        parts.append(f"""g{i + 1} AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM p{i}) = 0 AND (SELECT max(gen) FROM l{i}) > g THEN g + 1 ELSE g END AS g FROM g{i})""")
    return f"""WITH {", ".join(parts)} SELECT unnest(m) AS old_key, list_min(m) AS first_name, n::BIGINT AS n FROM l{STEPS}"""


def statements(deviations: float, eps: float, alpha: float, ks: list[int], max_bytes: int) -> dict[str, str]:
    assigned = f"{POINTS}, {SEED_STATES}, {ASSIGNED.format(deviations=deviations)}"
    label_points = "lp AS (SELECT vec_id AS point_id, label AS cluster_id, embedding::DOUBLE[] AS f FROM embeddings)"
    labelings = f"""{label_points}, lk AS (SELECT unnest({ks}) AS k),
kp AS (SELECT k, (cluster_id % k)::INT AS cluster_id, point_id, f FROM lp, lk)"""
    middles = f"{POINTS64}, cen AS (SELECT cluster_id, dim, avg(x) AS c FROM p GROUP BY 1, 2), pc AS (SELECT * FROM p JOIN cen USING (cluster_id, dim))"
    split = f"WITH {RATINGS}"
    sets = f"""{POINTS}, cs AS (SELECT label || '/' || octant AS set_key, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q
  FROM vl GROUP BY 1, 2)"""
    out = {
        "csv_multiline_scan": """SELECT p_partkey::VARCHAR AS part_key,
            p_name || chr(10) || '"' || p_brand || '", ' || p_type AS description FROM part""",
        "csv_header_scan": """SELECT (r_regionkey + 1)::VARCHAR AS genre_id, '0' AS parent, r_name AS title FROM region
            UNION ALL SELECT (100 + n_nationkey)::VARCHAR, (n_regionkey + 1)::VARCHAR, n_name FROM nation""",
        "tsv_ratings_scan": f"{split} SELECT user_id, item_id, rating FROM ratings",
        "flatten_header_features": """SELECT p_partkey::VARCHAR AS track_id, p_size::DOUBLE AS "size-mean-01",
            p_retailprice::DOUBLE AS "price-kurtosis-02", TRY_CAST(p_name AS DOUBLE) AS "name-mode-03" FROM part""",
        "flatten_header_tracks": """SELECT p_partkey::VARCHAR AS track_id, p_brand AS "set-subset",
            p_name || chr(10) || '"' || p_type || '"' AS "track-None" FROM part""",
        "cluster_membership": "SELECT vec_id::VARCHAR AS track_id, label AS cluster_id FROM embeddings WHERE label <= 7",
        "ratings_typed": f"{split} SELECT user_id, item_id, rating FROM ratings",
        "subset_filter": f"WITH {TRACKS} SELECT track_id, subset FROM tracks WHERE subset = 'small'",
        "subset_semi_join": f"WITH {POINTS64} SELECT point_id::VARCHAR AS track_id, round(sqrt(sum(x * x)), 6) AS norm FROM p WHERE cluster_id < 2 GROUP BY 1",
        "subset_anti_join": f"WITH {POINTS64} SELECT point_id::VARCHAR AS track_id, round(sqrt(sum(x * x)), 6) AS norm FROM p WHERE cluster_id >= 2 GROUP BY 1",
        "vector_table": """SELECT p_partkey AS point_id, unnest([0, 1]) AS dim,
            round(unnest([p_size::DOUBLE, p_retailprice]), 6) AS x FROM part""",
        "root_genres": "SELECT r_regionkey + 1 AS genre_no, (r_regionkey + 1)::VARCHAR AS genre_id, r_name AS title FROM region ORDER BY 1",
        "genre_colors": """SELECT (r_regionkey + 1)::VARCHAR AS genre_id, r_name AS title,
            '#' || lpad(((r_regionkey + 1) * 4321)::VARCHAR, 6, '0') AS genre_color FROM region""",
        "null_root_portion": f"WITH {TRACKS} SELECT round(avg(two::INT), 6) AS portion FROM tracks",
        "json_array_explode": f"WITH {TRACKS} SELECT track_id, genre_id FROM tg",
        "genre_counts": f"WITH {TRACKS} SELECT * FROM counts",
        "genre_count_map": f"WITH {TRACKS} SELECT * FROM counts",
        "genre_matrix": f"WITH {TRACKS}, c2 AS (SELECT r_name AS genre_title, cluster_id, count FROM region LEFT JOIN counts ON r_name = genre_title) "
        + _matrix("count", "c2").replace("round(", "(").replace(", 6)", ")::BIGINT"),
        "top3_genres": f"WITH {TRACKS} SELECT cluster_id, genre_title, count, rank FROM ranked WHERE rank <= 3",
        "top3_genre_portions": f"WITH {TRACKS} SELECT cluster_id, genre_title, rank, round(portion, 6) AS portion FROM shares",
        "top3_portion_matrix": f"WITH {TRACKS} {_matrix('portion', 'shares')}",
        "array_center": f"WITH {POINTS64}, m AS (SELECT point_id, avg(x) AS m FROM p GROUP BY 1) SELECT point_id, dim, round(x - m, 6) AS x FROM p JOIN m USING (point_id)",
        "array_dot": f"WITH {middles} SELECT point_id, round(sum(x * c), 6) AS dot FROM pc GROUP BY 1",
        "euclid_distance": f"WITH {middles} SELECT point_id, round(sqrt(sum((x - c) * (x - c))), 6) AS distance FROM pc GROUP BY 1",
        "array_pearson": f"WITH {middles} SELECT point_id, round(corr(x, c), 6) AS similarity FROM pc GROUP BY 1",
        "array_get": "SELECT vec_id AS point_id, round(embedding[(vec_id % 70 + 1)::INT]::DOUBLE, 6) AS x FROM embeddings",
        "cluster_summary": f"WITH {POINTS64} SELECT cluster_id, dim, count(*) AS n, round(sum(x), 6) AS s, round(sum(x * x), 6) AS q FROM p GROUP BY 1, 2",
        "cluster_stats": f"""WITH {POINTS64} SELECT cluster_id, dim, round(avg(x), 6) AS centroid, round(var_pop(x), 6) AS variance,
            round(stddev_pop(x), 6) AS std FROM p GROUP BY 1, 2""",
        "cluster_merge": f"WITH {POINTS} SELECT octant AS cluster_id, dim, count(*) AS n, round(sum(x), 6) AS s, round(sum(x * x), 6) AS q FROM vl GROUP BY 1, 2",
        "membership_overlap": f"WITH {TRACKS} SELECT track_id::BIGINT AS point_id, 2::BIGINT AS sets FROM tracks WHERE two AND label <= 7",
        "label_centroids": f"WITH {POINTS64} SELECT cluster_id, count(*) AS n, dim, round(avg(x), 6) AS x FROM p GROUP BY cluster_id, dim",
        "hash_split": f"{split} SELECT user_id, item_id, CASE WHEN bucket < 1 THEN 'test' ELSE 'train' END AS part FROM parts",
        "chunk_assign": f"""SELECT vec_id AS point_id,
            ((vec_id * 7919) % (SELECT 1 + count(*) // ({max_bytes} // 520) FROM embeddings))::INT AS chunk FROM embeddings""",
        "mahalanobis_matrix": f"WITH {assigned} SELECT point_id, cluster_id, round(distance, 6) AS distance FROM md",
        "bfr_assign": f"WITH {assigned} SELECT point_id, cluster_id, round(distance, 6) AS distance FROM asg",
        "bfr_absorb": f"""WITH {assigned}, took AS (SELECT a.cluster_id, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q
            FROM asg a JOIN vl USING (point_id) WHERE a.cluster_id <> -1 GROUP BY 1, 2)
            SELECT cluster_id, dim, sum(n)::BIGINT AS n, round(sum(s), 6) AS s, round(sum(q), 6) AS q
            FROM (SELECT * FROM ss UNION ALL SELECT * FROM took) GROUP BY 1, 2""",
        "eps_join": f"WITH RECURSIVE {POINTS}, {_scan_near('v', eps)} SELECT point_id, point_id IN (SELECT p FROM core_) AS core FROM v",
        "dbscan": f"WITH RECURSIVE {POINTS}, {_scan_near('v', eps)} SELECT * FROM scan",
        "bfr_leftover": f"""WITH RECURSIVE {assigned}, o AS (SELECT point_id, f FROM v JOIN asg USING (point_id) WHERE cluster_id = -1),
            {_scan_near('o', eps)} SELECT point_id, CASE WHEN label = -1 THEN 'retained' ELSE 'compression' END AS set_kind, label FROM scan""",
        "cs_merge_candidates": f"""WITH {sets}, mv AS (SELECT set_key, avg(q / n - (s / n) * (s / n)) AS v FROM cs GROUP BY 1),
            un AS (SELECT a.set_key AS lo, b.set_key AS hi,
                avg((a.q + b.q) / (a.n + b.n) - ((a.s + b.s) / (a.n + b.n)) * ((a.s + b.s) / (a.n + b.n))) AS v
              FROM cs a JOIN cs b ON a.dim = b.dim AND a.set_key < b.set_key GROUP BY 1, 2),
            ok AS (SELECT lo, hi FROM un JOIN mv x ON x.set_key = lo JOIN mv y ON y.set_key = hi WHERE un.v < {alpha} * greatest(x.v, y.v)),
            ends AS (SELECT lo AS set_key, lo, hi FROM ok UNION ALL SELECT hi, lo, hi FROM ok)
            SELECT set_key, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY set_key ORDER BY lo, hi) AS nth FROM ends) WHERE nth = 1""",
        "cs_merge": _merge_passes(sets, alpha),
        "ward_seed": _ward(8),
        "cs_fold": f"""WITH {sets}, {SEED_STATES},
            d AS (SELECT set_key, cluster_id, sum((cs.s / cs.n - ss.s / ss.n) ^ 2) AS d FROM cs JOIN ss USING (dim) GROUP BY 1, 2),
            goal AS (SELECT set_key, arg_min(cluster_id, d) AS cluster_id FROM d GROUP BY 1)
            SELECT cluster_id, dim, sum(n)::BIGINT AS n, round(sum(s), 6) AS s, round(sum(q), 6) AS q FROM
            (SELECT * FROM ss UNION ALL SELECT cluster_id, dim, n, s, q FROM cs JOIN goal USING (set_key)) GROUP BY 1, 2""",
        "cluster_radius": f"""WITH {label_points}, kp AS (SELECT 0 AS k, * FROM lp), {_metrics('kp')}
            SELECT cluster_id, n, round(radius, 6) AS radius, round(density_r, 6) AS density_r FROM met""",
        "cluster_diameter": f"""WITH {label_points}, kp AS (SELECT 0 AS k, * FROM lp), {_metrics('kp')}
            SELECT cluster_id, n, round(diameter, 6) AS diameter, round(density_d, 6) AS density_d FROM met""",
        "quality_fixed": f"""WITH {labelings}, {_metrics('kp')} SELECT k, cluster_id, n, round(radius, 6) AS radius,
            round(diameter, 6) AS diameter, round(density_r, 6) AS density_r, round(density_d, 6) AS density_d FROM met""",
        "quality_zscores": f"""WITH {labelings}, {_metrics('kp')},
            su AS (SELECT k, avg(density_r) AS avg_density_r, avg(density_d) AS avg_density_d,
              var_samp(density_r) AS var_density_r, var_samp(density_d) AS var_density_d FROM met GROUP BY 1),
            lo AS (UNPIVOT su ON avg_density_r, avg_density_d, var_density_r, var_density_d INTO NAME metric VALUE value)
            SELECT metric, k, round(value, 6) AS value,
              round((value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric), 6) AS z FROM lo""",
        "distinct_users": f"{split} SELECT count(DISTINCT user_id) AS users FROM ratings",
        "cf_user_means": f"{split} SELECT user_id, round(avg(rating), 6) AS user_mean FROM train GROUP BY 1",
        "cf_item_means": f"{split} SELECT item_id, round(avg(rating), 6) AS item_mean FROM train GROUP BY 1",
        "cf_global_mean": f"{split} SELECT round(avg(rating), 6) AS mu FROM train",
        "cf_baselines": f"{split}, {MODEL} SELECT user_id, item_id, round(base, 6) AS baseline FROM asked",
        "cf_candidates": f"""{split}, {MODEL} SELECT a.user_id, a.item_id, a.block AS cluster_id, count(*) AS neighbours,
            round(sum(r.rating - r.base), 6) AS deviation
            FROM (SELECT user_id, item_id, item_id % 5 AS block FROM test WHERE item_id IN (SELECT item_id FROM im)) a
            JOIN placed r ON a.user_id = r.user_id AND a.block = r.block GROUP BY 1, 2, 3""",
        "cf_similarity": f"""{split}, {MODEL}, pairs AS (SELECT DISTINCT least(a.item_id, r.item_id) AS lo, greatest(a.item_id, r.item_id) AS hi
              FROM asked a JOIN placed r ON a.user_id = r.user_id AND a.block = r.block)
            SELECT lo, hi, round(similarity, 6) AS similarity FROM pairs JOIN sims ON i = lo AND j = hi""",
        "cf_predict": f"{split}, {MODEL} SELECT user_id, item_id, true_rating, round(predicted_rating, 6) AS predicted_rating FROM predicted",
        "cf_rmse": f"""{split}, {MODEL}, k AS (SELECT count(*) AS known FROM test WHERE item_id IN (SELECT item_id FROM train)),
            p AS (SELECT count(predicted_rating) AS predicted, sum((true_rating - predicted_rating) ^ 2) AS sse FROM predicted)
            SELECT predicted, known, round(sqrt(sse / predicted), 6) AS rmse, round(sqrt(sse / known), 6) AS rmse_reference FROM p, k""",
        "cf_coverage": f"""{split} SELECT count(*) AS test_pairs, count(*) FILTER (item_id NOT IN (SELECT item_id FROM train)) AS untested,
            round(avg((item_id NOT IN (SELECT item_id FROM train))::INT), 6) AS untested_share FROM test""",
        "cf_cluster_sizes": f"{split} SELECT item_id % 5 AS cluster_id, count(DISTINCT item_id) AS items FROM train GROUP BY 1",
        "cf_item_vectors": f"{split} SELECT item_id, user_id, rating::DOUBLE AS rating FROM train",
    }
    return out
