"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_format
from .decontaminate import OP6_SQL, op6_decontaminate
from .jpeg import op3_media_columns
from .langid import op4_language_id
from .licenses import op2_license_scan
from .lines import op1_line_dedup
from .pieces import op8_sentencepiece
from .quality import op10_quality
from .simhash import op5_simhash_near_dedup
from .substrings import op7_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_license_scan, op3_media_columns, op4_language_id, op5_simhash_near_dedup,
        op6_decontaminate, op7_substring_dedup, op8_sentencepiece, op9_chat_format, op10_quality,
    )
}

# 13-word windows, the same windows in smaller documents, and the words they cover.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM d, LATERAL unnest(range(1, len(w) - 11)) AS u(i)
), m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (h) WHERE doc_id > least),
s AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce((SELECT string_agg(w[k], ' ' ORDER BY k) FROM unnest(range(1, len(w) + 1)) AS u(k) WHERE NOT list_contains(ps, k)), '') END) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL = {"op6_decontaminate": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op9_chat_format": OP9_SQL}
