"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.balancing import op10_mix
from marginalia.llm.decontamination import op13_decontamination
from marginalia.llm.hostquality import op7_host_rules
from marginalia.llm.imatch import op8_imatch
from marginalia.llm.langid import op6_language
from marginalia.llm.licenses import op3_licenses
from marginalia.llm.neardup import op4_neardup
from marginalia.llm.negatives import op12_hard_negatives
from marginalia.llm.periodic import op11_periodic_runs
from marginalia.llm.pii import op2_pii
from marginalia.llm.pieces import op5_pieces
from marginalia.llm.resharding import op9_reshard
from marginalia.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_neardup": op4_neardup,
    "op5_pieces": op5_pieces,
    "op6_language": op6_language,
    "op7_host_rules": op7_host_rules,
    "op8_imatch": op8_imatch,
    "op9_reshard": op9_reshard,
    "op10_mix": op10_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_decontamination": op13_decontamination,
}

ORACLE: dict[str, str] = {
    "op7_host_rules": r"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
      grams AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
      again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
      covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
      c AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
      f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_symbols > 0.5 * greatest(n_words, 1) OR n_dup_lines > 0.3 * greatest(n_lines, 1) OR word_chars < 2.0 * greatest(n_words, 1) OR word_chars > 15.0 * greatest(n_words, 1) AS strict_failed FROM c),
      h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR strict_failed)::DOUBLE AS k FROM f GROUP BY source),
      m AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, var_pop(k / n) AS v, avg(1 / n) AS u FROM h),
      p AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * u, 1e-9) - 1, 1.0), 1000.0) AS s FROM m),
      r AS (SELECT source, (k + m * s) / (n + s) AS host_rate, least(greatest((m * s) / s / ((k + m * s) / (n + s)), 1.0), 2.0) AS width FROM h, p)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (
        n_symbols > 0.5 * width * greatest(n_words, 1) OR n_dup_lines > 0.3 * width * greatest(n_lines, 1)
        OR word_chars / greatest(n_words, 1) < 2.0 / width OR word_chars / greatest(n_words, 1) > 15.0 * width) AS kept, round(host_rate, 6) AS host_rate
      FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source""",
    "op13_decontamination": r"""WITH ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
      bs AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
      bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT item, ws, least(len(ws), 10) AS n FROM bs WHERE len(ws) > 0))),
      dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM ws, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
      hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw USING (w)),
      words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
      items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
      FROM ws LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op12_hard_negatives": r"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
        FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
      p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
      n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
      SELECT * FROM n WHERE rank <= 5""",
}
