"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from . import knn_join, simhash_dedup, substring_dedup


def op4(window: int = substring_dedup.WINDOW) -> str:
    return f"""
WITH toks AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(t[i + 1 : i + {window}], ' ')) AS h FROM toks, LATERAL (SELECT unnest(range(0, len(t) - {window} + 1)) AS i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) >= 2),
hit AS (SELECT doc_id, i FROM win SEMI JOIN rep USING (h)),
brk AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {window} THEN 0 ELSE 1 END AS b FROM hit),
grp AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM brk)
SELECT doc_id, min(i) AS start_token, max(i) + {window} AS end_token FROM grp GROUP BY doc_id, g
"""


def op8(radius: int = simhash_dedup.RADIUS, min_jaccard: float = simhash_dedup.MIN_JACCARD) -> str:
    ones = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
    return f"""
WITH RECURSIVE words AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(lower(text), '\\s+')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS w FROM documents) WHERE w <> ''),
hashed AS (SELECT doc_id, w, ('0x' || left(md5(w), 16))::UBIGINT AS h FROM words),
prints AS (SELECT doc_id, {ones} AS fp, list_sort(list(w)) AS ws FROM hashed GROUP BY doc_id),
keyed AS (SELECT fp, ws, min(doc_id) AS least FROM prints GROUP BY ALL),
close AS (SELECT a.least AS a, b.least AS b, len(list_intersect(a.ws, b.ws)) AS common, len(a.ws) + len(b.ws) AS total FROM keyed a JOIN keyed b ON a.least <> b.least AND bit_count(xor(a.fp, b.fp)) <= {radius}),
near AS (SELECT a, b FROM close WHERE common >= {min_jaccard} * (total - common)),
reach(a, b) AS (SELECT least, least FROM keyed UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
known AS (SELECT k.ws, (SELECT min(b) FROM reach WHERE reach.a = k.least) AS class_id, (SELECT count(*) FROM near WHERE near.a = k.least) AS links FROM keyed k)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.links, 0) AS links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN prints p USING (doc_id) LEFT JOIN known k USING (ws)
"""


def op5(k: int = knn_join.K) -> str:
    return f"""
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS r FROM pairs)
SELECT vec_id, r::INT AS rank, neighbor_id, round(d, 6) AS distance FROM ranked WHERE r <= {k}
"""


ORACLES: dict[str, str] = {"op4_substring_dedup": op4(), "op5_voronoi_knn": op5(), "op8_simhash_dedup": op8()}
