"""DuckDB SQL of those corpus queries that SQL can express."""

from __future__ import annotations

from ledgerbeam.llm.chat import ORACLE_OP6
from ledgerbeam.llm.chat_repair import ORACLE_OP13
from ledgerbeam.llm.lexical_search import ORACLE_OP11
from ledgerbeam.llm.licenses import ORACLE_OP12

_VECTORS = """v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, label, sqrt(list_dot_product(e, e)) AS norm FROM v)"""
_COSINE = "greatest(-1.0, least(1.0, list_dot_product(a.e, b.e) / (a.norm * b.norm)))"

OP4 = f"""
WITH {_VECTORS}, s AS (
  SELECT a.vec_id AS query_id, b.vec_id, {_COSINE} AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = f"""
WITH RECURSIVE {_VECTORS}, l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE {_COSINE} >= 0.98
), reach AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT x, min(y) AS least FROM reach GROUP BY 1), k AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(least, e.vec_id))::BIGINT AS component_id,
  e.vec_id = least(e.vec_id, coalesce(least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN k ON k.x = e.vec_id
"""

#: Texts as hexadecimal digits, two for each byte; one string from each start that leaves 100 bytes. Blocks keep
#: substr() short; md5 stands for the string.
OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (
  SELECT doc_id, 256 * k AS base, substr(h, 512 * k + 1, 710) AS part
  FROM (SELECT doc_id, h, unnest(range(0, (greatest(0, length(h) // 2 - 99) + 255) // 256)) AS k FROM d)),
w AS (
  SELECT doc_id, base + p AS p, md5_number(substr(part, 2 * p + 1, 200)) AS s
  FROM (SELECT doc_id, base, part, unnest(range(0, least(256, length(part) // 2 - 99))) AS p FROM blocks)),
again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM w)
  WHERE nth > 1),
marked AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS fresh FROM again),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY 1, 2),
gaps AS (
  SELECT s.doc_id, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS a, a AS b FROM spans s
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY 1),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN removed ON removed.doc_id = d.doc_id
"""

ORACLES = {
    "op4_nearest_vectors": OP4,
    "op5_vector_dedup": OP5,
    "op6_format_chats": ORACLE_OP6,
    "op9_suffix_dedup": OP9,
    "op11_rank_documents": ORACLE_OP11,
    "op12_scan_licenses": ORACLE_OP12,
    "op13_repair_chats": ORACLE_OP13,
}
