"""The corpus operators as queries over the documents of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tracelake.llm.centroids import op12_centroid_clusters
from tracelake.llm.decontam import op1_decontamination
from tracelake.llm.langid import op4_language_id
from tracelake.llm.mixing import op6_source_mixing
from tracelake.llm.neardup import op10_near_duplicates
from tracelake.llm.pii import op9_personal_data
from tracelake.llm.quality import op7_quality
from tracelake.llm.secrets_scan import op8_secrets
from tracelake.llm.telephony import op3_telephony_audio
from tracelake.llm.tokenbin import op2_token_planes
from tracelake.llm.tokencount import op11_token_counts
from tracelake.llm.toxicity import op5_toxicity
from tracelake.llm.vectorcodes import op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontamination, op2_token_planes, op3_telephony_audio, op4_language_id, op5_toxicity, op6_source_mixing, op7_quality, op8_secrets, op9_personal_data, op10_near_duplicates, op11_token_counts, op12_centroid_clusters, op13_vector_codes)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}'), lambda x: x <> '')"


_BENCHMARK_WORDS = _words(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SHINGLE_WORDS = _words(r"[\x20\x09-\x0D]+")

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCHMARK_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di),
hit AS (SELECT doc_id, dg.n, i, item FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
pos AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON d.doc_id = c.node LEFT JOIN n ON d.doc_id = n.doc_id"""


_SQUARED = "CAST(coalesce(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT)"


def _finite(scale: int) -> str:
    return f"""SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)"""


def _lloyd(rounds: int, per: str = "") -> str:
    """Rounds over points (r, [p,] x) from entries c0 ([p,] j, c), fewer than 1024; a{rounds} has each point's entry and distance."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""m{k} AS MATERIALIZED (SELECT r, {per} x, min(1024 * {_SQUARED} + j) AS best FROM points JOIN c{k} {"USING (p)" if per else "ON true"} GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT r, {per} x, best % 1024 AS j, best // 1024 AS d FROM m{k})""")
        if k < rounds:
            out.append(f"""u{k} AS (SELECT {per} j, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT {per} j, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL),
n{k} AS (SELECT {per} j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM u{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT {per} j, coalesce(e, c) AS c FROM c{k} LEFT JOIN n{k} USING ({per} j))""")
    return ",\n".join(out)


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT * FROM ({_finite(256)}) WHERE len(q) = 64),
points AS (SELECT r, q AS x FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS j, q AS c FROM kept QUALIFY j < 40),
{_lloyd(5)},
s AS (SELECT j, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a5) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN kept USING (r) JOIN c5 USING (j) JOIN s USING (j)"""

OP13_SQL = f"""
WITH kept AS MATERIALIZED ({_finite(1024)}),
points AS MATERIALIZED (SELECT r, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS x FROM kept, (SELECT unnest(range(4)) AS p)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS j FROM kept QUALIFY j < 256),
c0 AS MATERIALIZED (SELECT p, j, x AS c FROM f JOIN points USING (r)),
{_lloyd(4, "p,")},
v AS (SELECT r, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM c4) AS codebooks_sha256
FROM v JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others use hashes, models or codecs and are tested against brute force."""
    return {"op1_decontamination": OP1_SQL, "op10_near_duplicates": OP10_SQL, "op12_centroid_clusters": OP12_SQL, "op13_vector_codes": OP13_SQL}
