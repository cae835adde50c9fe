"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from ..session import query
from . import bpe, chunk_dedup, language, line_dedup, mixing, near_dup, quality, suffix_dedup, token_counts, top_k

_QUERIES = {
    "op1_chunk_dedup": chunk_dedup.op1_chunk_dedup,
    "op2_suffix_array": suffix_dedup.op2_suffix_array,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_language": language.op6_language,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_quality": quality.op9_quality,
    "op10_top_k": top_k.op10_top_k,
}


def queries() -> dict:
    return {name: query(run) for name, run in _QUERIES.items()}


_SQL = {
    "op10_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
