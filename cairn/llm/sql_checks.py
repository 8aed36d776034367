"""The registered text queries' answers as DuckDB SQL, where SQL can say them, over tables whose keys are unique."""

from __future__ import annotations

from cairn.llm import ns_clusters, phrases

_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_GOOD}
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""

NEAR_VECTOR = f"""
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_GOOD}
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.norm > 0 AND b.norm > 0
    WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] / a.norm) * (z[2] / b.norm))) >= 0.93
), reach AS (
    SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON l.a = r.other
), least AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, e.vec_id) AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept
FROM embeddings AS e LEFT JOIN counts ON a = e.vec_id LEFT JOIN least ON node = e.vec_id
"""

LINE_CHUNKS = r"""
WITH texts AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
numbered AS MATERIALIZED (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM texts),
filled AS (
    SELECT doc_id, i, line, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM numbered WHERE trim(line, ' ') <> ''
), runs AS MATERIALIZED (
    SELECT f.doc_id, i AS pos, after AS upto, array_to_string(lines[i + 1:after + 1], chr(10)) AS run FROM filled AS f JOIN texts AS t ON t.doc_id = f.doc_id WHERE after IS NOT NULL
    UNION ALL SELECT doc_id, i, i, line FROM filled WHERE length(line) - length(replace(line, ' ', '')) + 1 >= 50
), firsts AS (
    SELECT run, doc_id AS d, pos AS p, upto AS u FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos, upto) AS nth FROM runs) AS ordered WHERE nth = 1
), later AS (
    SELECT doc_id, pos + CASE WHEN d = doc_id AND u = pos AND p < pos THEN 1 ELSE 0 END AS start, upto
    FROM runs JOIN firsts ON firsts.run = runs.run WHERE NOT (d = doc_id AND p = pos AND u = upto)
), gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(start, upto + 1)) AS i FROM later),
stretches AS (
    SELECT doc_id, count(*) AS n FROM gone AS g WHERE NOT EXISTS (SELECT 1 FROM gone AS h WHERE h.doc_id = g.doc_id AND h.i = g.i - 1) GROUP BY doc_id
), kept AS (
    SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.i) AS rest FROM numbered AS n LEFT JOIN gone AS g ON g.doc_id = n.doc_id AND g.i = n.i WHERE g.i IS NULL GROUP BY n.doc_id
)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text, CAST(coalesce(n, 0) AS INTEGER) AS chunks_removed
FROM documents AS o LEFT JOIN kept AS k ON k.doc_id = o.doc_id LEFT JOIN stretches AS s ON s.doc_id = o.doc_id
"""

NEAR_TEXT = r"""
WITH RECURSIVE texts AS MATERIALIZED (
    SELECT min(doc_id) AS node, text, list_filter(string_split_regex(text, '[\x00-\x20]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL GROUP BY text
), shingles AS MATERIALIZED (
    SELECT DISTINCT node, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0) AS places
), sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node),
links AS (SELECT a, b FROM common AS c JOIN sizes AS x ON x.node = a JOIN sizes AS y ON y.node = b WHERE 10 * c.n >= 8 * (x.n + y.n - c.n)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reach AS r JOIN ways AS w ON w.a = r.other),
least AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
classes AS (SELECT text, coalesce(low, t.node) AS class_id FROM texts AS t LEFT JOIN least AS l ON l.node = t.node)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_id, d.doc_id) = d.doc_id AS kept FROM documents AS d LEFT JOIN classes AS c ON c.text = d.text
"""

ORACLE_SQL: dict[str, str] = {
    "op5_top_k": TOP_K,
    "op7_line_chunks": LINE_CHUNKS,
    "op9_near_text": NEAR_TEXT,
    "op10_near_vector": NEAR_VECTOR,
    "op12_phrases": phrases.ORACLE_SQL,
    "op13_ns_clusters": ns_clusters.ORACLE_SQL,
}
