"""DuckDB statements that compute the catalogue's results independently.

They build the notes of the vault from the ``documents`` table and derive the
expected chunks, links and edits from how those notes are laid out.
"""

from __future__ import annotations

NL = "chr(10)"
VAULT = rf"""
l AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, {NL}),
  lambda x: trim(regexp_replace(regexp_replace(x, '[^\p{{L}}\p{{N}} ,]', ' ', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
base AS (SELECT doc_id, lang, source, ls, source || '/' || lang || '/doc-' || doc_id || '.md' AS path,
  list_transform(ls, lambda x, i: '## Part ' || (i-1) || {NL} || {NL} || x || ' [[doc-' || ((doc_id*31 + (i-1)*17) % 997) || ']]' || {NL}) AS ps FROM l),
vault AS (SELECT *, '---' || {NL} || 'title: Doc ' || doc_id || {NL} || 'lang: ' || lang || {NL} || '---' || {NL} || {NL} AS front,
  '# Doc ' || doc_id || {NL} || {NL} || array_to_string(ps, {NL}) AS body,
  '---' || {NL} || 'title: Doc ' || doc_id || {NL} || 'lang: ' || lang || {NL} || '---' || {NL} || {NL}
  || '# Doc ' || doc_id || {NL} || {NL} || array_to_string(ps, {NL}) AS content FROM base),
parts AS (SELECT doc_id, path, i, x, 'doc-' || ((doc_id*31 + i*17) % 997) AS link FROM
  (SELECT doc_id, path, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM base)),
chunks AS (SELECT doc_id, path, CAST(i AS INTEGER) AS chunk_idx, 'Doc ' || doc_id || ' — Part ' || i || {NL} || x || ' [[' || link || ']]' AS text, x, link FROM parts)"""

LINES = """
lines AS (SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
  CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line FROM documents) WHERE text <> '')"""

def workflow(name: str) -> str:
    """CTEs up to ``final``: the last place of each user under the moves of ``name``."""
    return f"""
ev AS (SELECT user_id, event_id, ts, {name} AS name,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
moves(name, f, t) AS (VALUES ('search','idle','exploring'), ('open_note','exploring','editing'), ('refine','exploring','exploring'),
    ('reset','exploring','idle'), ('save','editing','reviewing'), ('back','editing','exploring'), ('reset','editing','idle'),
    ('done','reviewing','idle'), ('open_note','reviewing','editing'), ('search','reviewing','exploring')),
walk AS (SELECT ev.user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS name,
    'idle' AS from_place, 'idle' AS to_place, true AS accepted FROM ev WHERE ev.k = 1
  UNION ALL
  SELECT ev.user_id, ev.k, ev.event_id, ev.name, walk.to_place, CASE WHEN ev.name = 'hard_reset' THEN 'idle' ELSE coalesce(moves.t, walk.to_place) END, moves.t IS NOT NULL
  FROM walk JOIN ev ON ev.user_id = walk.user_id AND ev.k = walk.k + 1
  LEFT JOIN moves ON moves.name = ev.name AND moves.f = walk.to_place),
clear AS (SELECT user_id, max(k) FILTER (k = 0 OR name = 'hard_reset') AS k0 FROM walk GROUP BY user_id),
final AS (SELECT user_id, max_by(to_place, k) AS final_place, count(*) FILTER (k > k0 AND accepted) AS n_ok,
    count(*) FILTER (k > k0 AND NOT accepted) AS n_rejected FROM walk JOIN clear USING (user_id) GROUP BY user_id)"""


MOVES = """CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'open_note'
    WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'reset' END"""
WORKFLOW = workflow(MOVES)
WORKFLOW_ALL = workflow(f"""CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'refine' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'back'
    WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'hard_reset' ELSE {MOVES} END""")


def scores(source: str, scope: str, ids: str, query: str) -> str:
    """CTEs up to ``scored``: matching rows with tfidf, proximity and blended score."""
    terms = query.split()
    unique = list(dict.fromkeys(terms))
    slot = {t: i for i, t in enumerate(unique)}
    counts = ", ".join(f"len(list_filter(t, lambda z: z = '{t}')) AS c{i}" for i, t in enumerate(unique))
    dfs = ", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in range(len(unique)))
    some = " OR ".join(f"c{i} > 0" for i in range(len(unique)))
    tfidf = " + ".join(
        f"(c{slot[t]}::DOUBLE / nt) * CASE WHEN d{slot[t]} > 0 THEN ln(n::DOUBLE / d{slot[t]}) ELSE 0 END" for t in terms
    )
    same = f"{scope}, {ids}" if ids else scope
    using = f"({same})"
    gaps, joins, total = [], [], []
    for i, (a, b) in enumerate(zip(terms, terms[1:])):
        gaps.append(
            f"g{i} AS (SELECT {same}, min(abs(a.p - b.p)) AS g{i} FROM pos a JOIN pos b USING {using} WHERE a.w = '{a}' AND b.w = '{b}' GROUP BY ALL)"
        )
        joins.append(f"LEFT JOIN g{i} USING {using}")
        total.append(f"g{i}")
    wanted = ", ".join(f"'{t}'" for t in unique)
    if total:
        avg = f"(({' + '.join(total)})::DOUBLE / {len(total)})"
        prox = f"CASE WHEN {avg} > 0 THEN 1 / {avg} ELSE 0 END"
    else:
        prox = "0::DOUBLE"
    gap_sql = "".join(f"{g},\n" for g in gaps)
    return f"""
tok AS (SELECT {same}, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM {source}),
cnt AS (SELECT *, len(t) AS nt, {counts} FROM tok),
st AS (SELECT {scope}, count(*) AS n, {dfs} FROM cnt GROUP BY {scope}),
pos AS (SELECT * FROM (SELECT {same}, unnest(t) AS w, unnest(range(len(t))) AS p FROM cnt WHERE {some}) WHERE w IN ({wanted})),
{gap_sql}raw AS (SELECT cnt.*, {tfidf} AS tfidf, {prox} AS prox FROM cnt JOIN st USING ({scope}) {' '.join(joins)} WHERE {some}),
scored AS (SELECT *, 0.7::DOUBLE * CASE WHEN mt = 0 THEN 0 ELSE tfidf / mt END
  + (1 - 0.7::DOUBLE) * CASE WHEN mp = 0 THEN 0 ELSE prox / mp END AS score
  FROM (SELECT *, max(tfidf) OVER (PARTITION BY {scope}) AS mt, max(prox) OVER (PARTITION BY {scope}) AS mp FROM raw))"""


WC = r"len(regexp_extract_all(text, '[^\s]+'))::INTEGER"
FOUND = f"path, chunk_idx, round(score, 6) AS score, {WC} AS word_count, md5(text) AS text_md5"


def vault_scores(query: str, where: str = "") -> str:
    source = f"scope_chunks AS (SELECT * FROM chunks {where})"
    return f"WITH {VAULT}, {source}, {scores('scope_chunks', 'path', 'chunk_idx', query)}, hits AS (SELECT scored.*, text FROM scored JOIN chunks USING (path, chunk_idx) WHERE score >= 0.01)"


def hybrid(k: int, prefix: str = "", prefilter: str = "") -> str:
    pool = max(3 * k, 20)
    return f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
v AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, text,
  list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS sim FROM embeddings JOIN documents ON vec_id = doc_id, q),
pool AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM v WHERE starts_with(path, '{prefilter}') ORDER BY sim DESC, doc_id LIMIT {pool}),
pool2 AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM pool WHERE starts_with(path, '{prefix}')),
c AS (SELECT *, len(t) AS nt, len(list_filter(t, lambda z: z = 'the')) AS c0, len(list_filter(t, lambda z: z = 'of')) AS c1 FROM pool2),
s AS (SELECT count(*) AS n, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM c),
x AS (SELECT doc_id, r, sim, CASE WHEN nt = 0 THEN 0 ELSE c0::DOUBLE / nt * CASE WHEN d0 > 0 THEN ln(n::DOUBLE / d0) ELSE 0 END
  + c1::DOUBLE / nt * CASE WHEN d1 > 0 THEN ln(n::DOUBLE / d1) ELSE 0 END END AS lex FROM c, s),
y AS (SELECT doc_id, r, sim / max(sim) OVER () AS vs, CASE WHEN max(lex) OVER () = 0 THEN 0 ELSE lex / max(lex) OVER () END AS lx FROM x)
SELECT doc_id, round(0.6::DOUBLE * vs + (1 - 0.6::DOUBLE) * lx, 6) AS score, round(vs, 6) AS vector_score, round(lx, 6) AS lexical_score
FROM y ORDER BY 0.6::DOUBLE * vs + (1 - 0.6::DOUBLE) * lx DESC, r LIMIT {k}"""


DOC_PATH = "source || '/' || lang || '/doc-' || doc_id || '.md'"
LABEL_NOTES = f"""label_notes AS (SELECT CASE WHEN quality = 1 THEN {DOC_PATH} ELSE 'new/' || {DOC_PATH} END AS path,
  'Label ' || toxic AS content FROM labels JOIN documents USING (doc_id))"""
EDGES = f"""
edges AS (SELECT coalesce(lower(regexp_replace(t.path, '\\.md$', '')), link) AS target_key, p.path AS source_path,
  CAST(10 + 4 * p.i AS INTEGER) AS line_number,
  replace(substr(v.content, greatest(off - 30, 0) + 1, off + len(link) + 4 + 30 - greatest(off - 30, 0)), {NL}, ' ') AS context,
  'wikilink' AS link_type
 FROM (SELECT *, instr((SELECT content FROM vault v2 WHERE v2.path = parts.path), '## Part ' || i || {NL}) - 1
     + len('## Part ' || i) + 2 + len(x) + 1 AS off FROM parts) p
 JOIN vault v ON v.path = p.path
 LEFT JOIN (SELECT path, 'doc-' || doc_id AS name FROM base) t ON t.name = p.link)"""
BACKLINKS = f"WITH {VAULT}, {EDGES}, e AS (SELECT * FROM edges WHERE target_key <> lower(regexp_replace(source_path, '\\.md$', '')))"

HREFS = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS i FROM pages)"""


def patched(first: str, others: str = "ps[2:]") -> str:
    """A note whose first part is rewritten to ``first``."""
    return f"""WITH {VAULT} SELECT path, md5(front || '# Doc ' || doc_id || {NL} || {NL} || array_to_string(list_concat([{first}], {others}), {NL})) AS content_md5,
      CAST(NULL AS VARCHAR) AS error_code FROM vault"""


BATCH = f"""WITH {VAULT},
ops AS (SELECT doc_id // 10 AS batch_id, CAST(doc_id % 10 AS INTEGER) AS seq, doc_id, CASE WHEN doc_id % 41 = 5 THEN 'gone.md' ELSE path END AS path,
  CASE doc_id % 4 WHEN 0 THEN 'line_replace' WHEN 1 THEN 'string_replace' WHEN 2 THEN 'append' ELSE 'frontmatter_set' END AS action,
  front, body, content, ps, lang FROM vault),
done AS (SELECT batch_id, seq, path, action,
  CASE WHEN doc_id % 41 = 5 THEN 'Note not found: gone.md'
       WHEN action = 'line_replace' AND doc_id % 20 = 16 THEN 'Freeform edit failed: endLine 1000000 exceeds file length (' || len(string_split(content, {NL})) || ' lines)'
       WHEN action = 'string_replace' AND doc_id % 23 = 7 THEN 'Freeform edit failed: Search string not found: "no such text"' END AS error,
  CASE action WHEN 'line_replace' THEN replace(front || body, {NL} || '# Doc ' || doc_id || {NL}, {NL} || 'Edited' || {NL})
    WHEN 'string_replace' THEN CASE WHEN doc_id % 3 = 0 THEN replace(content, 'Doc', 'Edited')
       ELSE '---' || {NL} || 'title: Edited' || substr(content, len('---title: Doc') + 2) END
    WHEN 'append' THEN front || '# Doc ' || doc_id || {NL} || {NL} || array_to_string(list_concat([ps[1] || {NL} || 'Edited' || {NL}], ps[2:]), {NL})
    ELSE '---' || {NL} || 'title: Doc ' || doc_id || {NL} || 'lang: ' || lang || {NL} || 'status: ok' || {NL} || '---' || {NL} || {NL} || body END AS after
  FROM ops),
stopped AS (SELECT *, min(seq) FILTER (error IS NOT NULL) OVER (PARTITION BY batch_id) AS stop FROM done),
results AS (SELECT batch_id, seq, path, action, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
  CASE WHEN error IS NULL THEN md5(after) END AS content_md5 FROM stopped WHERE stop IS NULL OR seq <= stop)"""

MICROS = "epoch_us(ts)"
FUZZY = """WITH q(query) AS (VALUES ('smal rign'), ('BLUE wigdet'), ('hot gaer'), ('zzz')),
c AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
m AS (SELECT query, p_name, k, levenshtein(lower(query), lower(p_name)) AS d,
  1 - levenshtein(lower(query), lower(p_name))::DOUBLE / greatest(len(query), len(p_name)) AS s FROM q, c)"""

ORACLE: dict[str, str] = {
    "list_notes": f"SELECT {DOC_PATH} AS path FROM documents",
    "list_notes_dir": f"SELECT {DOC_PATH} AS path FROM documents WHERE source = 'src1' AND lang = 'en'",
    "note_stat": f"WITH {VAULT} SELECT path, CAST(strlen(content) AS BIGINT) AS size_bytes FROM vault",
    "read_note": f"""WITH {VAULT} SELECT path, md5(content) AS content_md5, CAST(NULL AS VARCHAR) AS error_code FROM vault
        UNION ALL SELECT 'missing/doc-' || doc_id || '.md', NULL, 'NOTE_NOT_FOUND' FROM labels""",
    "vault_files": f"WITH {VAULT} SELECT path, CAST(strlen(content) AS BIGINT) AS size_bytes, md5(content) AS content_md5 FROM vault",
    "vault_errors": """SELECT 'file' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'folder', count(DISTINCT (source, lang)) FROM documents
        UNION ALL SELECT 'error', count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'NOTE_UNREADABLE', count(*) FROM labels JOIN documents USING (doc_id) WHERE toxic = 1""",
    "missing_notes": f"SELECT 'gone/' || {DOC_PATH} AS path FROM documents JOIN labels USING (doc_id) WHERE quality <> 1",
    "safe_paths": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '/' || lang || '/doc-' || doc_id || '.md'
        WHEN 1 THEN source || '/' || lang || '/doc-' || doc_id || '.md' WHEN 3 THEN source || '/' || lang || ' ' || doc_id || '.md' END AS path,
        CASE doc_id % 5 WHEN 2 THEN 'PATH_TRAVERSAL' WHEN 4 THEN 'INVALID_NOTE_PATH' END AS error_code FROM documents""",
    "bulk_read_items": f"""WITH {VAULT},
items AS (SELECT doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN 'missing/doc-' || doc_id || '.md' ELSE path END AS path,
  CASE WHEN doc_id % 11 = 0 THEN 'Nope' WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'Part 1' ELSE 'part 0' END AS heading,
  doc_id % 7 = 0 AS gone, content, ps FROM vault),
r AS (SELECT *, CASE WHEN gone THEN NULL WHEN heading IS NULL THEN content WHEN heading = 'Part 1' THEN ps[2] WHEN heading = 'part 0' THEN ps[1] END AS got FROM items)
SELECT pos, path, heading, md5(got) AS content_md5, got IS NOT NULL AS found, CASE WHEN gone THEN 'Note not found: ' || path
  WHEN got IS NULL THEN 'Heading "' || heading || '" not found in ' || path END AS error FROM r""",
    "create_conflicts": f"""WITH {LABEL_NOTES} SELECT path, CASE WHEN starts_with(path, 'new/') THEN NULL ELSE 'NOTE_ALREADY_EXISTS' END AS error_code FROM label_notes""",
    "note_upsert": f"""WITH {VAULT}, {LABEL_NOTES} SELECT path, md5(content) AS content_md5 FROM vault WHERE path NOT IN (SELECT path FROM label_notes)
        UNION ALL SELECT path, md5(content) FROM label_notes""",
    "note_delete": f"WITH {LABEL_NOTES} SELECT {DOC_PATH} AS path FROM documents WHERE {DOC_PATH} NOT IN (SELECT path FROM label_notes)",
    "create_from_template": f"""SELECT 'customers/' || c_custkey || '.md' AS path,
        CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' THEN '# ' || c_name || {NL} || {NL} || 'From ' || n_name || ', segment ' || c_mktsegment
          || ', ' || c_name || ' {{{{unknown}}}}' || {NL} END AS content,
        CASE WHEN c_acctbal < 0 THEN 'NOTE_ALREADY_EXISTS' WHEN c_mktsegment = 'MACHINERY' THEN 'NOTE_NOT_FOUND' END AS error_code
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "template_render": """SELECT c_custkey, c_name || ' has $1 {{c_name}} in ' || c_name || ' {{ nothing }} {{ bad key }} #' || c_custkey AS text FROM customer""",
    "chunk_vault": f"""WITH {VAULT} SELECT path, chunk_idx, 'Doc ' || doc_id || ' > Part ' || chunk_idx AS trail, {WC} AS word_count,
        CAST(8 + 4 * chunk_idx AS INTEGER) AS start_line, CAST(10 + 4 * chunk_idx AS INTEGER) AS end_line, md5(text) AS text_md5 FROM chunks""",
    "note_outline": f"""WITH {VAULT} SELECT path, 1 AS idx, 1 AS depth, 'Doc ' || doc_id AS title FROM vault
        UNION ALL SELECT path, CAST(2 + 2 * i AS INTEGER), 2, 'Part ' || i FROM parts""",
    "heading_paths": f"""WITH {VAULT} SELECT path, 6 AS line, 1 AS depth, 'Doc ' || doc_id AS title, 'Doc ' || doc_id AS trail FROM vault
        UNION ALL SELECT path, CAST(8 + 4 * i AS INTEGER), 2, 'Part ' || i, 'Doc ' || doc_id || ' > Part ' || i FROM parts""",
    "read_section": f"WITH {VAULT} SELECT path, len(ps) > 3 AS found, md5(coalesce(ps[4], '')) AS content_md5 FROM vault",
    "frontmatter_get": f"SELECT {DOC_PATH} AS path, 'Doc ' || doc_id AS title, lang FROM documents",
    "frontmatter_set": f"""WITH {VAULT} SELECT path, md5('---' || {NL} || 'title: Doc ' || doc_id || {NL} || 'lang: x-' || lang || {NL} || 'status: done' || {NL}
        || '---' || {NL} || {NL} || body) AS content_md5, CAST(NULL AS VARCHAR) AS error_code FROM vault""",
    "tokenize_counts": """SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM
        (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents)""",
    "word_counts": f"SELECT doc_id, {WC} AS word_count FROM documents",
    "term_frequencies": f"""WITH {LINES}, t AS (SELECT doc_id, line, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM lines)
        SELECT doc_id, line, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda z: z = 'the'))::DOUBLE / len(t) END, 6) AS tf FROM t""",
    "document_frequency": f"""WITH {LINES}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM lines),
        q(term) AS (VALUES ('of'), ('the'), ('and')) SELECT doc_id, count(*) AS n, term, count(*) FILTER (list_contains(t, term)) AS df FROM t, q GROUP BY doc_id, term""",
    "tfidf_note_scope": f"WITH {LINES}, {scores('lines', 'doc_id', 'line', 'the of')} SELECT doc_id, line, round(tfidf, 6) AS score FROM scored",
    "tfidf_corpus_scope": f"WITH {LINES}, one AS (SELECT 1 AS scope, * FROM lines), {scores('one', 'scope', 'doc_id, line', 'the of')} SELECT doc_id, line, round(tfidf, 6) AS score FROM scored",
    "proximity_scores": f"WITH {LINES}, {scores('lines', 'doc_id', 'line', 'the of')} SELECT doc_id, line, round(prox, 6) AS score FROM scored WHERE prox > 0",
    "blended_line_scores": f"WITH {LINES}, {scores('lines', 'doc_id', 'line', 'the of')} SELECT doc_id, line, round(score, 6) AS score FROM scored WHERE round(score, 6) >= 0.01",
    "rounded_scores": "SELECT l_orderkey, l_linenumber, floor((l_extendedprice * l_discount / 7.0::DOUBLE - 100.0::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS score FROM lineitem",
    "fragments_per_note": f"{vault_scores('the of')} SELECT {FOUND} FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_idx) <= 5",
    "fragments_one_term": f"{vault_scores('the')} SELECT {FOUND} FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_idx) <= 5",
    "vault_search": f"{vault_scores('of the and')} SELECT {FOUND} FROM hits ORDER BY hits.score DESC, path, chunk_idx LIMIT 20",
    "vault_search_dir": f"""{vault_scores('the of', "WHERE starts_with(path, 'src1/')")} SELECT {FOUND} FROM hits ORDER BY hits.score DESC, path, chunk_idx LIMIT 20""",
    "vault_search_all": f"{vault_scores('of the and')} SELECT {FOUND} FROM hits",
    "conversation_search": f"""WITH {scores('conversations', 'conv_id', 'turn', 'of the and')}
        SELECT conv_id, turn, round(score, 6) AS score FROM scored WHERE scored.score >= 0.01 ORDER BY scored.score DESC, conv_id, turn LIMIT 20""",
    "cosine_all": """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""",
    "vector_topk": """SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 20""",
    "vector_topk_per_label": """WITH s AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT label, rank, vec_id, round(s, 6) AS sim FROM r WHERE rank <= 3""",
    "hybrid_search": hybrid(10),
    "hybrid_search_dir": hybrid(20, prefix="src1"),
    "hybrid_search_prefilter": hybrid(10, prefilter="src1/"),
    "vector_upsert": """WITH n AS (SELECT 'v' || (vec_id * 2) AS doc_path, unnest([0, 1]) AS chunk_idx, list_transform(embedding, lambda x: -x) AS e FROM embeddings),
        v AS (SELECT 'v' || vec_id AS doc_path, 0 AS chunk_idx, embedding AS e FROM embeddings WHERE 'v' || vec_id NOT IN (SELECT doc_path FROM n) UNION ALL SELECT * FROM n)
        SELECT doc_path, chunk_idx, md5(array_to_string(list_transform(e, lambda x: CAST(CAST(floor(x::DOUBLE * 1e6) AS BIGINT) AS VARCHAR)), ',')) AS vector_md5, 64 AS n FROM v""",
    "vector_delete": "SELECT 'v' || vec_id AS doc_path, 0 AS chunk_idx FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "vector_pad_truncate": """SELECT vec_id, dims, dims AS n, round(list_sum(embedding[1:dims]::DOUBLE[]), 6) AS total
        FROM embeddings, (SELECT unnest([48, 80]) AS dims)""",
    "index_size": f"WITH {VAULT} SELECT count(DISTINCT path) AS documents, count(*) AS chunks FROM chunks",
    "point_ids": f"""WITH {VAULT}, h AS (SELECT path, chunk_idx, sha256(path || '::' || chunk_idx) AS s FROM chunks)
        SELECT path, chunk_idx, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-' || substr(s, 21, 12) AS point_id FROM h""",
    "embedded_index": f"""WITH {VAULT} SELECT path AS doc_path, chunk_idx, 'Doc ' || doc_id || ' > Part ' || chunk_idx AS chunk_id, 64 AS n, 1.0::DOUBLE AS norm FROM chunks""",
    "index_incremental": f"""WITH {VAULT}, {LABEL_NOTES} SELECT path AS doc_path, chunk_idx, 'Doc ' || doc_id || ' > Part ' || chunk_idx AS chunk_id,
        md5(text) AS text_md5, 16 AS n FROM chunks WHERE path NOT IN (SELECT path FROM label_notes)
        UNION ALL SELECT path, 0, 'root', md5(content), 16 FROM label_notes WHERE content = 'Label 0'""",
    "index_reindexed": f"""WITH {VAULT}, {LABEL_NOTES} SELECT path AS doc_path, chunk_idx, 'Doc ' || doc_id || ' > Part ' || chunk_idx AS chunk_id,
        md5(text) AS text_md5, 16 AS n FROM chunks WHERE path NOT IN (SELECT path FROM label_notes)
        UNION ALL SELECT path, 0, 'root', md5(content), 16 FROM label_notes WHERE content = 'Label 0'""",
    "wikilinks": f"""WITH {VAULT}, {EDGES}, w AS (SELECT source_path, line_number, context FROM edges)
        SELECT source_path AS path, link AS target, line_number AS line, context FROM w JOIN parts ON path = source_path AND line_number = 10 + 4 * i""",
    "wikilink_names": f"WITH {VAULT} SELECT path, string_agg(link, ' ' ORDER BY i) AS names FROM parts GROUP BY path",
    "wikilink_resolve": f"""WITH {VAULT} SELECT link AS target, b.path AS resolved, count(*) AS n FROM parts
        LEFT JOIN base b ON 'doc-' || b.doc_id = link GROUP BY ALL""",
    "partial_resolve": f"""WITH d AS (SELECT *, {DOC_PATH} AS path FROM documents),
        t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(lang, 2) || '/doc-' || doc_id || '#top'
          ELSE source || '/' || upper(lang) || '/doc-' || (doc_id + 1) || '.md' END AS target,
          CASE WHEN doc_id % 2 = 0 THEN substr(lang, 2) || '/doc-' || doc_id || '.md'
          ELSE source || '/' || lang || '/doc-' || (doc_id + 1) || '.md' END AS suffix FROM documents)
        SELECT t.doc_id, target, min(d.path) AS resolved FROM t LEFT JOIN d ON ends_with(d.path, suffix) GROUP BY ALL""",
    "backlinks": f"{BACKLINKS} SELECT * FROM e",
    "backlinks_of_labelled": f"""{BACKLINKS} SELECT target_key, source_path, line_number FROM e
        WHERE target_key IN (SELECT lower(regexp_replace({DOC_PATH}, '\\.md$', '')) FROM documents JOIN labels USING (doc_id))""",
    "backlink_counts": f"{BACKLINKS} SELECT target_key, count(*) AS n FROM e GROUP BY 1",
    "backlink_index_size": f"{BACKLINKS} SELECT count(DISTINCT target_key) AS targets FROM e",
    "backlinks_updated": f"""WITH {VAULT}, lab AS (SELECT b.doc_id, b.path, toxic = 1 AS gone, toxic <> 1 AND quality = 1 AS fresh FROM labels JOIN base b USING (doc_id)),
        best AS (SELECT 'doc-' || b.doc_id AS name, CASE WHEN fresh THEN 'aaa/doc-' || b.doc_id || '.md' ELSE b.path END AS path FROM base b LEFT JOIN lab USING (doc_id) WHERE NOT coalesce(gone, false)),
        src AS (SELECT p.path AS source_path, p.link, CAST(10 + 4 * i AS INTEGER) AS line_number FROM parts p LEFT JOIN lab USING (doc_id) WHERE coalesce(fresh, true)
          UNION ALL SELECT CASE WHEN fresh THEN 'aaa/doc-' || doc_id || '.md' ELSE path END, 'doc-' || doc_id % 10, 1 FROM lab WHERE NOT gone),
        k AS (SELECT lower(coalesce(regexp_replace(best.path, '\\.md$', ''), link)) AS target_key, source_path, line_number FROM src LEFT JOIN best ON name = link)
        SELECT *, 'wikilink' AS link_type FROM k WHERE target_key <> lower(regexp_replace(source_path, '\\.md$', ''))""",
    "orphan_notes": f"{BACKLINKS} SELECT path FROM base WHERE lower(regexp_replace(path, '\\.md$', '')) NOT IN (SELECT target_key FROM e)",
    "html_links": f"WITH {HREFS} SELECT page_id, 'pages' || url AS target FROM hrefs",
    "markdown_links": f"""WITH {HREFS} SELECT 'site/' || page_id || '.md' AS path, url, 'site' || url AS target, CAST(3 + i AS INTEGER) AS line,
        CAST(8 + 7 + sum(len(url) + 16) OVER (PARTITION BY page_id ORDER BY i) - (len(url) + 16) AS INTEGER) AS off FROM hrefs""",
    "overview_folders": """SELECT source AS path, '.' AS parent_path, 1 AS depth, CAST(0 AS BIGINT) AS file_count FROM documents GROUP BY source
        UNION ALL SELECT source || '/' || lang, source, 2, count(*) FROM documents GROUP BY source, lang""",
    "overview_depth_one": """WITH f AS (SELECT CASE WHEN user_id % 9 = 0 THEN '.' ELSE event_type END AS path, ts FROM events WHERE user_id % 9 <> 1)
        SELECT path, CASE WHEN path = '.' THEN NULL ELSE '.' END AS parent_path, CASE WHEN path = '.' THEN 0 ELSE 1 END AS depth,
        count(*) AS file_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_modified FROM f GROUP BY path""",
    "overview_tree": """WITH f AS (SELECT source AS a, source || '/' || lang AS b, source || '/' || lang || '/g' || doc_id % 11 AS c FROM documents),
        c AS (SELECT a, b, c, '{"path":"' || c || '","depth":3,"file_count":' || count(*) || ',"children":[]}' AS node FROM f GROUP BY a, b, c),
        b AS (SELECT a, b, '{"path":"' || b || '","depth":2,"file_count":0,"children":[' || string_agg(node, ',' ORDER BY c) || ']}' AS node FROM c GROUP BY a, b)
        SELECT a AS path, '{"path":"' || a || '","depth":1,"file_count":0,"children":[' || string_agg(node, ',' ORDER BY b) || ']}' AS tree FROM b GROUP BY a""",
    "overview_total": "SELECT count(*) AS total_files FROM documents",
    "fuzzy_best": f"""{FUZZY} SELECT query, p_name AS match, CAST(d AS INTEGER) AS distance, round(s, 6) AS similarity FROM m WHERE s >= 0.6
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, k) = 1""",
    "fuzzy_all": f"{FUZZY} SELECT query, p_name AS match, CAST(d AS INTEGER) AS distance, round(s, 6) AS similarity FROM m WHERE s >= 0.5",
    "fuzzy_join": """WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS query FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS match FROM documents),
        m AS (SELECT query, match, levenshtein(query, match) AS d FROM q JOIN c ON abs(len(query) - len(match)) <= 0.2 * greatest(len(query), len(match)) + 1e-9)
        SELECT query, match, CAST(d AS INTEGER) AS distance, floor((1 - d::DOUBLE / greatest(len(query), len(match))) * 1e6 + 0.5000001) / 1e6 AS similarity FROM m
        WHERE 1 - d::DOUBLE / greatest(len(query), len(match)) >= 0.8 - 1e-9""",
    "string_replace_first": """SELECT doc_id, CASE WHEN contains(text, 'the') THEN md5(substr(text, 1, instr(text, 'the') - 1) || '<$1>' || substr(text, instr(text, 'the') + 3)) END AS content_md5,
        CASE WHEN NOT contains(text, 'the') THEN 'Freeform edit failed: Search string not found: "the"' END AS error FROM documents""",
    "string_replace_all": """SELECT doc_id, CASE WHEN contains(text, 'the') THEN md5(replace(text, 'the', '<$1>')) END AS content_md5,
        CASE WHEN NOT contains(text, 'the') THEN 'Freeform edit failed: Search string not found: "the"' END AS error FROM documents""",
    "line_replace": f"""WITH d AS (SELECT doc_id, string_split(text, {NL}) AS ls, CAST(doc_id % 9 AS INTEGER) AS e FROM documents)
        SELECT doc_id, CASE WHEN e <= len(ls) AND e >= 2 THEN md5(array_to_string(list_concat(ls[1:1], ['new' || {NL} || 'lines'], ls[e+1:]), {NL})) END AS content_md5,
        CASE WHEN e > len(ls) THEN 'Freeform edit failed: endLine ' || e || ' exceeds file length (' || len(ls) || ' lines)'
             WHEN e < 2 THEN 'Freeform edit failed: startLine (2) must be <= endLine (' || e || ')' END AS error FROM d""",
    "patch_append": patched(f"ps[1] || {NL} || 'Added *text*.' || {NL}"),
    "patch_prepend": patched(f"'## Part 0' || {NL} || {NL} || 'Added *text*.' || {NL} || {NL} || ls[1] || ' [[doc-' || ((doc_id*31) % 997) || ']]' || {NL}"),
    "patch_replace": patched(f"'## Part 0' || {NL} || {NL} || 'Added *text*.' || {NL}"),
    "patch_document": f"WITH {VAULT} SELECT path, md5(front || 'First words.' || {NL} || {NL} || body) AS content_md5, CAST(NULL AS VARCHAR) AS error_code FROM vault",
    "patch_document_append": f"WITH {VAULT} SELECT path, md5(rtrim(content, {NL}) || {NL} || {NL} || 'Last words.' || {NL}) AS content_md5, CAST(NULL AS VARCHAR) AS error_code FROM vault",
    "patch_document_replace": f"SELECT {DOC_PATH} AS path, md5('Only ' || {DOC_PATH} || {NL}) AS content_md5, CAST(NULL AS VARCHAR) AS error_code FROM documents",
    "patch_found_block": f"""WITH {VAULT}, m(operation, middle) AS (VALUES ('append', 'Marked *text* ^b-1' || {NL} || {NL} || 'Added.'), ('prepend', 'Added.' || {NL} || {NL} || 'Marked *text* ^b-1'), ('replace', 'Added.'))
        SELECT path, operation, CASE WHEN doc_id % 5 <> 0 THEN md5(rtrim(content, {NL}) || {NL} || {NL} || middle || {NL} || {NL} || 'Tail words' || {NL}) END AS content_md5,
        CASE WHEN doc_id % 5 = 0 THEN 'BLOCK_NOT_FOUND' END AS error_code FROM vault, m""",
    "patch_missing_block": f"SELECT {DOC_PATH} AS path, CAST(NULL AS VARCHAR) AS content, 'BLOCK_NOT_FOUND' AS error_code FROM documents",
    "diff_preview": f"SELECT {DOC_PATH} AS path, 2 AS added, 0 AS removed FROM documents",
    "diff_lines": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(text, chr(10))[2] AS x FROM documents WHERE text LIKE '%' || chr(10) || '%'),
        e AS (SELECT path, x, 'Edited ' || reverse(x) AS y FROM t WHERE x <> 'Edited ' || reverse(x))
        SELECT path, '-' AS kind, 2 AS line_number, md5(x) AS text_md5 FROM e UNION ALL SELECT path, '+', 2, md5(y) FROM e""",
    "batch_edit": f"{BATCH} SELECT * FROM results",
    "batch_summary": f"""{BATCH} SELECT batch_id, (SELECT count(*) FROM ops o WHERE o.batch_id = r.batch_id) AS total_requested,
        count(*) FILTER (status = 'success') AS total_succeeded, count(*) FILTER (status = 'error') AS total_failed,
        min(seq) FILTER (status = 'error') AS stopped_at FROM results r GROUP BY batch_id""",
    "debounce_events": f"""WITH e AS (SELECT user_id, {MICROS} AS us, lead({MICROS}) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events)
        SELECT user_id, us AS last_micros FROM e WHERE nx IS NULL OR nx - us > 3600000000""",
    "queue_dedup": f"SELECT user_id, min({MICROS}) AS first_micros FROM events GROUP BY user_id",
    "queue_entries": f"""WITH e AS (SELECT user_id, {MICROS} AS us, lead({MICROS}) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events WHERE event_type <> 'error')
        SELECT user_id, us + 3600000000 AS at_micros, 'change' AS kind FROM e WHERE nx IS NULL OR nx - us > 3600000000
        UNION ALL SELECT user_id, {MICROS}, 'unlink' FROM events WHERE event_type = 'error'""",
    "workflow_fold": f"WITH RECURSIVE {WORKFLOW} SELECT * FROM final",
    "workflow_history": f"WITH RECURSIVE {WORKFLOW} SELECT user_id, event_id, name, from_place, to_place, accepted FROM walk WHERE k > 0",
    "workflow_hints": f"""WITH RECURSIVE {WORKFLOW} SELECT user_id, final_place, CASE final_place WHEN 'idle' THEN 'search' WHEN 'exploring' THEN 'open_note,refine,reset'
        WHEN 'editing' THEN 'save,back,reset' ELSE 'done,open_note,search' END AS transitions, CASE final_place WHEN 'idle' THEN 3 ELSE 4 END AS n_actions,
        CASE final_place WHEN 'editing' THEN 4 ELSE 1 END AS n_tool_hints FROM final""",
    "debounce_stream": f"""WITH e AS (SELECT user_id, {MICROS} AS us, lag({MICROS}) OVER (PARTITION BY user_id ORDER BY ts) AS pv FROM events),
        g AS (SELECT *, sum(CASE WHEN pv IS NULL OR us - pv > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM e)
        SELECT user_id, max(us) AS last_micros, count(*) AS n_events FROM g GROUP BY user_id, s""",
    "queue_stream": f"""WITH e AS (SELECT user_id, {MICROS} AS us, lead({MICROS}) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events WHERE event_type <> 'error')
        SELECT user_id, us + 3600000000 AS at_micros, 'change' AS kind FROM e WHERE nx IS NULL OR nx - us > 3600000000
        UNION ALL SELECT user_id, {MICROS}, 'unlink' FROM events WHERE event_type = 'error'""",
    "workflow_stream": f"WITH RECURSIVE {WORKFLOW} SELECT * FROM final",
    "workflow_stream_all": f"""WITH RECURSIVE {WORKFLOW_ALL} SELECT *, CASE final_place WHEN 'idle' THEN 'search' WHEN 'exploring' THEN 'open_note,refine,reset'
        WHEN 'editing' THEN 'save,back,reset' ELSE 'done,open_note,search' END AS available FROM final""",
    "vault_changes": f"""WITH m AS (SELECT {DOC_PATH} AS path, quality, toxic FROM documents JOIN labels USING (doc_id))
        SELECT path, 'unlink' AS kind, CAST(1 AS BIGINT) AS step FROM m WHERE toxic = 1 UNION ALL SELECT 'moved/' || path, 'add', 1 FROM m WHERE toxic = 1
        UNION ALL SELECT path, 'change', 1 FROM m WHERE toxic = 0 AND quality = 1""",
}


def half_up(sql: str) -> str:
    """Spell ``round(x, 6)`` out as arithmetic, since engines round exact halves differently."""
    start = sql.find("round(")
    if start < 0:
        return sql
    depth, end = 0, start + 5
    while end < len(sql):
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        if depth == 0:
            break
        end += 1
    inner = sql[start + 6 : end].removesuffix(", 6")
    return f"{sql[:start]}(floor(({half_up(inner)}) * 1e6::DOUBLE + 0.5000001::DOUBLE) / 1e6::DOUBLE){half_up(sql[end + 1 :])}"


ORACLE = {name: half_up(sql) for name, sql in ORACLE.items()}
