"""Expected results as SQL over the source tables.

They state what the derivation rules imply; none follows the job plans.
"""

from __future__ import annotations

# -- intake --------------------------------------------------------------------

_STATUS = """CASE WHEN event_id % 7 = 0 THEN 401
    WHEN event_type IN ('click', 'error') THEN 200
    WHEN event_id % 11 = 0 THEN 400
    WHEN event_id % 3 = 2 THEN 200
    ELSE 202 END"""

_JOBS = f"""
SELECT user_id AS installation_id,
       concat('org', user_id % 5, '/repo', user_id % 20) AS repo_full_name,
       concat('org', user_id % 5) AS owner,
       concat('repo', user_id % 20) AS repo_name,
       event_id AS pr_number,
       md5(concat('h', event_id)) AS head_sha,
       md5(concat('b', event_id)) AS base_sha,
       left(md5(concat('h', event_id)), 8) AS short_sha
FROM events WHERE {_STATUS} = 202
"""

# -- diffs ---------------------------------------------------------------------

_DOC_LINES = """
WITH split AS (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), pieces AS (
    SELECT doc_id, unnest(parts) AS t, unnest(range(len(parts))) AS i FROM split
), k AS (
    SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
           count(*) OVER (PARTITION BY doc_id) AS n
    FROM pieces WHERE t <> ''
), lines AS (
    SELECT concat('org/repo', (doc_id // 4) % 20) AS repo_full_name,
           doc_id // 4 AS pr_number, CAST(doc_id % 4 AS INTEGER) AS file_idx,
           doc_id, t, k, n, (k - 1) // 10 AS h,
           (k + 2) // 4 AS added_before, (k + 1) // 4 AS removed_before,
           CASE k % 4 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'context' END AS line_type
    FROM k
), numbered AS (
    SELECT *,
           CASE WHEN line_type = 'added' THEN 0 ELSE k - added_before + 5 * h END AS old_line,
           CASE WHEN line_type = 'removed' THEN 0 ELSE k - removed_before + 5 * h END AS new_line,
           k + h + 1 AS diff_pos
    FROM lines
)
"""

_DOC_FILE = """concat('dir', doc_id % 7, '/f', doc_id, '.', CASE doc_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'py'
    WHEN 2 THEN 'TS' WHEN 3 THEN 'md' WHEN 4 THEN 'yaml' ELSE 'zzz' END)"""

_DIFF_FILES = f"""
SELECT concat('org/repo', (doc_id // 4) % 20) AS repo_full_name,
       doc_id // 4 AS pr_number, CAST(doc_id % 4 AS INTEGER) AS file_idx,
       {_DOC_FILE} AS path,
       CASE WHEN doc_id % 9 = 0 THEN ''
            WHEN doc_id % 13 <> 5 AND doc_id % 17 = 3 THEN concat('old/f', doc_id)
            ELSE {_DOC_FILE} END AS old_path,
       CASE WHEN doc_id % 9 <> 0 AND doc_id % 13 = 5 THEN ''
            ELSE CASE doc_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript'
                 WHEN 3 THEN 'markdown' WHEN 4 THEN 'yaml' ELSE '' END END AS language,
       doc_id % 9 = 0 AS is_new,
       doc_id % 9 <> 0 AND doc_id % 13 = 5 AS is_delete
FROM documents
"""

_DIFF_SUMMARY = f"""
{_DOC_LINES}
SELECT concat('org/repo', (d.doc_id // 4) % 20) AS repo_full_name,
       d.doc_id // 4 AS pr_number, CAST(d.doc_id % 4 AS INTEGER) AS file_idx,
       coalesce((max(k) + 9) // 10, 0) AS hunks,
       count(*) FILTER (WHERE line_type = 'added') AS added
FROM documents d LEFT JOIN numbered USING (doc_id) GROUP BY d.doc_id
"""

# -- rules ---------------------------------------------------------------------

# Expected findings per template: number, rule, severity, reported line, the
# other line that also counts as changed, and the condition on the file.
# Lines count from 1 within the template.
_EXPECTED = """
(0, 'panic-outside-main', 'warning', 7, 7, 'library'),
(0, 'os-exit-in-library', 'error', 10, 10, 'library'),
(1, 'empty-error-catch', 'error', 5, 5, ''),
(1, 'empty-error-catch', 'error', 7, 7, ''),
(1, 'empty-error-catch', 'error', 12, 12, ''),
(2, 'mutex-copied-by-value', 'error', 6, 6, ''),
(2, 'mutex-copied-by-value', 'error', 7, 7, ''),
(2, 'mutex-copied-by-value', 'error', 9, 9, ''),
(2, 'mutex-copied-by-value', 'error', 10, 10, ''),
(2, 'mutex-copied-by-value', 'error', 12, 12, ''),
(3, 'fmt-sprintf-in-println', 'info', 9, 9, ''),
(3, 'fmt-sprintf-in-println', 'info', 10, 10, ''),
(3, 'reflect-deepequal-primitives', 'info', 14, 14, ''),
(3, 'reflect-deepequal-primitives', 'info', 14, 14, ''),
(3, 'reflect-deepequal-primitives', 'info', 17, 17, ''),
(4, 'todo-comment', 'info', 3, 3, ''),
(4, 'todo-comment', 'info', 5, 5, ''),
(4, 'todo-comment', 'info', 6, 6, ''),
(4, 'todo-comment', 'info', 11, 11, ''),
(5, 'context-not-propagated', 'warning', 9, 9, ''),
(5, 'context-not-propagated', 'warning', 12, 12, ''),
(5, 'context-not-propagated', 'warning', 19, 19, ''),
(5, 'context-not-propagated', 'warning', 28, 28, ''),
(6, 'naked-return', 'warning', 5, 5, ''),
(6, 'naked-return', 'warning', 8, 8, ''),
(6, 'naked-return', 'warning', 22, 22, ''),
(7, 'missing-cancel', 'error', 6, 6, ''),
(7, 'missing-cancel', 'error', 10, 10, ''),
(8, 'deferred-close-in-a-loop', 'warning', 8, 8, ''),
(8, 'time-after-in-loop', 'warning', 15, 15, ''),
(8, 'time-after-in-loop', 'warning', 15, 15, ''),
(8, 'time-after-in-loop', 'warning', 22, 22, ''),
(9, 'goroutine-loop-capture', 'warning', 5, 5, 'old'),
(9, 'goroutine-loop-capture', 'warning', 5, 5, 'old'),
(9, 'goroutine-loop-capture', 'warning', 12, 12, 'old'),
(9, 'goroutine-loop-capture', 'warning', 16, 16, 'old'),
(9, 'goroutine-loop-capture', 'warning', 16, 16, 'old'),
(9, 'goroutine-loop-capture', 'warning', 18, 18, 'old'),
(10, 'unreachable-code-after-return', 'warning', 6, 6, ''),
(10, 'unreachable-code-after-return', 'warning', 7, 7, ''),
(10, 'unreachable-code-after-return', 'warning', 19, 19, ''),
(10, 'unreachable-code-after-return', 'warning', 22, 22, ''),
(11, 'ineffective-assignment', 'warning', 4, 5, ''),
(11, 'ineffective-assignment', 'warning', 10, 11, ''),
(11, 'ineffective-assignment', 'warning', 16, 17, ''),
(11, 'ineffective-assignment', 'warning', 16, 17, ''),
(12, 'ineffective-assignment', 'warning', 4, 6, ''),
(12, 'ineffective-assignment', 'warning', 15, 20, ''),
(12, 'ineffective-assignment', 'warning', 16, 17, ''),
(13, 'struct-tag-duplicate', 'warning', 5, 5, ''),
(13, 'struct-tag-malformed', 'error', 6, 6, ''),
(13, 'struct-tag-malformed', 'error', 7, 7, ''),
(13, 'struct-tag-malformed', 'error', 8, 8, ''),
(13, 'struct-tag-malformed', 'error', 9, 9, ''),
(13, 'struct-tag-duplicate', 'warning', 10, 10, ''),
(13, 'struct-tag-malformed', 'error', 12, 12, ''),
(15, 'panic-outside-main', 'warning', 11, 11, 'library'),
(16, 'struct-tag-duplicate', 'warning', 4, 4, ''),
(16, 'deferred-close-in-a-loop', 'warning', 10, 10, ''),
(16, 'deferred-close-in-a-loop', 'warning', 13, 13, ''),
(16, 'deferred-close-in-a-loop', 'warning', 16, 16, ''),
(16, 'naked-return', 'warning', 19, 19, '')
"""

_GO_FOUND = f"""
WITH expected(template, rule, severity, line, other, needs) AS (VALUES {_EXPECTED}
), files AS (
    SELECT p_partkey AS k, p_size, (p_partkey // 5) % 18 AS template,
           concat('org', p_partkey % 5, '/mod', p_partkey % 20) AS repo_full_name,
           CASE p_partkey % 5 WHEN 0 THEN concat('cmd/p', p_partkey, '/main.go')
                WHEN 1 THEN concat('pkg/p', p_partkey, '.go')
                WHEN 2 THEN concat('pkg/p', p_partkey, '_test.go')
                WHEN 3 THEN concat('internal/p', p_partkey, '.go')
                ELSE concat('vendor/v/p', p_partkey, '.go') END AS path
    FROM part
), found AS (
    SELECT repo_full_name, k AS pr_number, path, rule, severity, p_size,
           CAST(line + 1 AS BIGINT) AS line, CAST(line + 2 AS BIGINT) AS diff_pos
    FROM files JOIN expected USING (template)
    WHERE ((line + 1 + k) % 2 = 0 OR (other + 1 + k) % 2 = 0)
      AND (needs <> 'library' OR k % 5 NOT IN (0, 2))
      AND (needs <> 'old' OR p_size % 10 < 7)
)
"""
_FLAT = "repo_full_name, pr_number, path, rule, severity, line, diff_pos"

_ENABLED = """(p_size % 5 IN (0, 3) OR path NOT LIKE 'vendor/%')
  AND NOT (p_size % 5 = 1 AND rule = 'panic-outside-main')
  AND NOT (p_size % 5 = 2 AND rule = 'os-exit-in-library')
  AND NOT (p_size % 5 = 4 AND rule = 'empty-error-catch')"""


def _rules(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"{_GO_FOUND} SELECT {_FLAT} FROM found WHERE rule IN ({listed})"


# -- model answers ----------------------------------------------------------------

_ITEMS = """
WITH items AS (
    SELECT l_orderkey AS k, concat('org/shop', l_orderkey % 7) AS repo_full_name, l_orderkey AS pr_number,
           concat('orders/o', l_orderkey, '.go') AS path,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                l_extendedprice, l_discount, lower(l_returnflag)) - 1 AS INTEGER) AS item_idx,
           CAST(l_linenumber AS BIGINT) AS line, lower(l_returnflag) AS category,
           concat('[', lower(l_returnflag), '] item ', l_partkey) AS message,
           concat('item ', l_partkey) AS untagged,
           concat('supplier ', l_suppkey) AS explanation,
           CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('fix(', l_partkey, ')') END AS suggested_fix,
           l_discount
    FROM lineitem
), scored AS (
    SELECT *, CASE WHEN k % 5 = 1 THEN 0.75 ELSE l_discount * 10 END AS confidence,
           CASE WHEN k % 5 = 1 THEN 'inline' WHEN line % 3 = 0 THEN 'drop' WHEN line % 3 = 1 THEN 'inline'
                ELSE 'summary' END AS decision
    FROM items WHERE k % 5 <> 2 AND k % 35 <> 3
), reviewed AS (
    SELECT repo_full_name, pr_number, path, item_idx, concat('llm-', category) AS rule,
           CASE WHEN confidence >= 0.85 THEN 'error' WHEN confidence >= 0.7 THEN 'warning' ELSE 'info' END AS severity,
           message, untagged, line,
           CASE WHEN decision = 'inline' AND line % 2 = 0 THEN line + 1 ELSE 0 END AS diff_pos,
           CAST(confidence AS DOUBLE) AS confidence, suggested_fix
    FROM scored WHERE decision <> 'drop'
), embedded AS (
    SELECT *, concat('[', rule, '] ', message, '. Fix: ', suggested_fix) AS embedding_text FROM reviewed
), known AS (
    SELECT *, concat('rule-', category) AS rule,
           CASE WHEN line % 2 = 0 THEN concat('[rule]  ', message, '  ') ELSE explanation END AS known_message,
           CASE WHEN line % 2 = 0 THEN line + 1 ELSE 0 END AS diff_pos
    FROM items WHERE k % 5 <> 2
)
"""

_FENCE = "concat('Source file:', chr(10), '```go', chr(10), 'package o', k, chr(10), '```', chr(10))"
_FILE = "concat('File: ', path, chr(10), chr(10))"

_PROMPTS = f"""
{_ITEMS}, files AS (SELECT DISTINCT k, path FROM items
), known_text AS (
    SELECT k, string_agg(concat('- line ', line, ': [', rule, '] ', known_message, chr(10)), '' ORDER BY item_idx) AS known_list,
           string_agg(concat('- [llm-', category, '] ', message, ' (PR #', line, ', file: old.go)', chr(10)), '' ORDER BY item_idx) AS past_list,
           string_agg(concat('- line ', line, ': [', category, '] ', message, chr(10)), '' ORDER BY item_idx) AS listed,
           string_agg(concat('- line ', line, ': [', category, '] ', message, chr(10), '  explanation: ', explanation,
               chr(10), '  suggested_fix: ', suggested_fix, chr(10)), '' ORDER BY item_idx) AS full_list
    FROM known GROUP BY k
), texts AS (
    SELECT k AS pr_number, 'detector' AS stage, concat({_FILE},
        CASE WHEN known_list IS NULL THEN concat('Known static findings: none.', chr(10), chr(10))
             ELSE concat('Known static findings, not to be repeated:', chr(10), known_list, chr(10),
                         'Similar findings of earlier pull requests, for context:', chr(10), past_list, chr(10)) END,
        {_FENCE}) AS t
    FROM files LEFT JOIN known_text USING (k)
    UNION ALL
    SELECT k, 'suggester', concat({_FILE}, 'Candidates:', chr(10), listed, chr(10), {_FENCE})
    FROM files JOIN known_text USING (k)
    UNION ALL
    SELECT k, 'reviewer', concat('Candidates with fixes:', chr(10), full_list) FROM known_text
)
"""

# -- reviews ------------------------------------------------------------------------

_REVIEWS = f"""
{_ITEMS}, merged AS (
    SELECT repo_full_name, pr_number, path, 0 AS stream, item_idx, line, diff_pos,
           CASE WHEN line % 2 = 0 THEN message ELSE known_message END AS body
    FROM known
    UNION ALL
    SELECT repo_full_name, pr_number, path, 1, item_idx, line, diff_pos,
           concat(untagged, chr(10), chr(10), '*Confidence: ', CAST(floor(confidence * 100) AS BIGINT), '%*',
                  CASE WHEN suggested_fix = '' THEN '' ELSE concat(chr(10), chr(10), '**Suggested Fix:**', chr(10),
                       '```go', chr(10), suggested_fix, chr(10), '```') END)
    FROM reviewed
), grouped AS (
    SELECT repo_full_name, pr_number,
           string_agg(CASE WHEN diff_pos > 0 THEN concat(path, '|', diff_pos, '|', body) END, chr(10)
                      ORDER BY stream, item_idx) AS comments,
           string_agg(CASE WHEN diff_pos = 0 AND stream = 0 THEN body
                           WHEN diff_pos = 0 THEN concat('`', path, '` line ', line, ': ', body) END, chr(10)
                      ORDER BY stream, item_idx) AS notes,
           count(*) FILTER (WHERE diff_pos > 0) AS n_comments,
           count(*) FILTER (WHERE stream = 0) AS n_rule,
           count(*) FILTER (WHERE stream = 1) AS n_model
    FROM merged GROUP BY repo_full_name, pr_number
)
"""

_REVIEW_TEXTS = f"""
{_REVIEWS}
SELECT repo_full_name, pr_number, 'REQUEST_CHANGES' AS event,
       concat('## Automated review', chr(10), chr(10), CASE WHEN notes IS NULL THEN ''
           ELSE concat('### Additional findings', chr(10), notes, chr(10)) END) AS body,
       coalesce(comments, '') AS comments
FROM grouped
"""

# -- history ------------------------------------------------------------------------

_HISTORY = """
WITH history AS (
    SELECT vec_id, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, concat('repo', label) AS repo,
           CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings
)
"""

_SIMILAR = f"""{_HISTORY}, pairs AS (
    SELECT q.id AS query_id, h.id, 1 - list_cosine_similarity(q.v, h.v) AS d
    FROM history q JOIN history h ON q.repo = h.repo AND h.vec_id < q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS distance FROM ranked WHERE rank <= 5"""


ORACLES: dict[str, str] = {
    "delivery_status": f"SELECT event_id AS delivery_id, CAST({_STATUS} AS INTEGER) AS status FROM events",
    "review_jobs": _JOBS,
    "stream_jobs": _JOBS,
    "diff_lines": f"""
{_DOC_LINES}, spans AS (
    SELECT doc_id, h, min(k) AS first_k, count(*) AS size,
           min(k - added_before + 5 * h) AS old_start, min(k - removed_before + 5 * h) AS new_start,
           count(*) FILTER (WHERE line_type <> 'added') AS old_lines,
           count(*) FILTER (WHERE line_type <> 'removed') AS new_lines
    FROM numbered GROUP BY doc_id, h
)
SELECT repo_full_name, pr_number, file_idx, CAST(h AS INTEGER) AS hunk_idx, old_start, old_lines, new_start,
       new_lines, line_type, concat('x', t) AS content, old_line, new_line, diff_pos
FROM numbered JOIN spans USING (doc_id, h)
""",
    "diff_files": _DIFF_FILES,
    "diff_summary": _DIFF_SUMMARY,
    "added_lines": f"""{_DOC_LINES}
SELECT repo_full_name, pr_number, file_idx, new_line, concat('x', t) AS content
FROM numbered WHERE line_type = 'added'""",
    "changed_lines": f"""{_DOC_LINES}
SELECT repo_full_name, pr_number, file_idx, new_line AS line FROM numbered WHERE line_type = 'added'""",
    "line_positions": f"""{_DOC_LINES}
SELECT repo_full_name, pr_number, file_idx, new_line AS line, diff_pos FROM numbered WHERE line_type <> 'removed'""",
    "library_panics": _rules("panic-outside-main"),
    "rules_local": _rules(
        "mutex-copied-by-value",
        "error-ignored",
        "empty-error-catch",
        "os-exit-in-library",
        "panic-outside-main",
        "fmt-sprintf-in-println",
        "reflect-deepequal-primitives",
        "todo-comment",
    ),
    "rules_scoped": _rules(
        "context-not-propagated",
        "naked-return",
        "deferred-close-in-a-loop",
        "time-after-in-loop",
        "goroutine-loop-capture",
    ),
    "rules_statements": _rules("missing-cancel", "unreachable-code-after-return", "ineffective-assignment"),
    "struct_tags": _rules("struct-tag-malformed", "struct-tag-duplicate"),
    "enabled_findings": f"{_GO_FOUND} SELECT {_FLAT} FROM found WHERE {_ENABLED}",
    "go_versions": """
SELECT concat('org', p_partkey % 5, '/mod', p_partkey % 20) AS repo_full_name, p_partkey AS pr_number,
       concat('1.', 15 + p_size % 10) AS go_version, p_size % 10 >= 7 AS recent
FROM part""",
    "excluded_files": r"""
WITH p AS (SELECT page_id AS pr_number, regexp_extract(url, '^\w+://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT * FROM p WHERE NOT (path = 'fr' OR path LIKE 'fr/%') AND path NOT LIKE '%.html'
  AND NOT regexp_full_match(path, 'en/[^/]7[^/]*')""",
    "model_overrides": """
SELECT concat('org', p_partkey % 5, '/mod', p_partkey % 20) AS repo_full_name, p_partkey AS pr_number,
       CASE WHEN p_size % 5 IN (1, 2, 4) AND p_size % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider,
       CASE WHEN p_size % 5 IN (1, 2, 4) AND p_size % 4 = 1 THEN 'large' ELSE 'small' END AS model
FROM part""",
    "stage_candidates": f"""{_ITEMS}
SELECT repo_full_name, pr_number, path, item_idx, category, line, message FROM items WHERE k % 5 <> 2""",
    "stage_failures": f"""{_ITEMS}
SELECT DISTINCT repo_full_name, pr_number, path, CASE WHEN k % 5 = 2 THEN 'detector' ELSE 'reviewer' END AS failed_stage
FROM items WHERE k % 5 = 2 OR k % 35 = 3""",
    "reviewed_findings": f"""{_ITEMS}
SELECT repo_full_name, pr_number, path, item_idx, rule, severity, message, line, diff_pos, confidence, suggested_fix,
       CAST(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER) AS severity_ordinal
FROM reviewed""",
    "embedding_texts": f"{_ITEMS} SELECT pr_number, item_idx, embedding_text FROM embedded",
    "query_text": f"""{_ITEMS}
SELECT i.k AS pr_number, CASE WHEN max(m) IS NULL THEN max(i.path) ELSE concat(max(i.path), ': ', max(m)) END AS query_text
FROM items i LEFT JOIN (SELECT k, string_agg(known_message, '; ' ORDER BY item_idx) AS m FROM known GROUP BY k) t USING (k)
GROUP BY i.k""",
    "stage_prompts": f"""{_PROMPTS}
SELECT pr_number, stage, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM texts""",
    "live_answers": f"""{_PROMPTS}
SELECT pr_number, concat('orders/o', pr_number, '.go') AS path, stage, CAST(1 AS INTEGER) AS attempt,
       concat('suggester ', length(t)) AS content, CAST(NULL AS VARCHAR) AS error
FROM texts WHERE stage = 'suggester'""",
    "similar_topk": _SIMILAR,
    "similar_topk_cells": _SIMILAR,
    "nearest_global": f"""{_HISTORY}
SELECT id, repo, round(1 - list_cosine_similarity(v, list_transform(range(64), lambda i: ((i % 7) - 3) / 10.0::DOUBLE)), 6) AS distance
FROM history ORDER BY 1 - list_cosine_similarity(v, list_transform(range(64), lambda i: ((i % 7) - 3) / 10.0::DOUBLE)), id LIMIT 5""",
    "history_roundtrip": """
SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, concat('repo', label) AS repo,
       concat('pkg/f', vec_id % 11, '.go') AS file_path, concat('llm-kind', vec_id % 3) AS rule,
       concat('finding ', vec_id) AS message, vec_id AS pr_number, CAST(len(embedding) AS INTEGER) AS dims,
       round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length,
       1700000000 + vec_id AS created_s
FROM embeddings""",
    "saved_findings": f"""{_ITEMS}
SELECT regexp_replace(repo_full_name, '^.*/', '') AS repo, path AS file_path, rule, message, pr_number,
       CAST(length(embedding_text) AS DOUBLE) AS first_value, TRUE AS has_id
FROM embedded WHERE length(embedding_text) % 5 <> 0""",
    "review_bodies": _REVIEW_TEXTS,
    "reviews_written": _REVIEW_TEXTS,
    "review_counts": f"{_REVIEWS} SELECT repo_full_name, pr_number, n_comments, n_rule, n_model FROM grouped",
    "two_revisions": f"""{_GO_FOUND}, heads AS (
    SELECT k, unnest([md5(concat('h', k)), md5(concat('again', md5(concat('h', k))))]) AS commit_id FROM files)
SELECT repo_full_name, pr_number, commit_id, count(*) AS n_comments, count(*) AS n_rule
FROM found JOIN heads ON k = pr_number GROUP BY repo_full_name, pr_number, commit_id""",
    "model_filters": f"""{_GO_FOUND}
SELECT repo_full_name, k AS pr_number, path, CAST(file_idx AS INTEGER) AS file_idx, 'llm-logic' AS rule, 'error' AS severity,
       CAST(1 AS BIGINT) AS line, CAST(0 AS BIGINT) AS diff_pos
FROM (SELECT *, unnest(CASE WHEN k % 3 = 0 THEN [0, 3] ELSE [0] END) AS file_idx FROM files)
WHERE p_size % 5 IN (0, 3) OR path NOT LIKE 'vendor/%'""",
    "model_pipeline": f"""{_GO_FOUND}, known AS (
    SELECT concat('mod', p_partkey % 20) AS repo, count(*) AS n FROM part WHERE p_partkey % 10 = 0 GROUP BY ALL)
SELECT repo_full_name, k AS pr_number, path,
       concat('llm-', CASE WHEN p_size % 5 IN (1, 2, 4) AND p_size % 2 = 0 THEN 'alpha' ELSE 'beta' END, '-',
              CASE WHEN p_size % 5 IN (1, 2, 4) AND p_size % 4 = 1 THEN 'large' ELSE 'small' END) AS rule,
       CASE WHEN k % 5 = 0 THEN 'warning' ELSE 'error' END AS severity,
       concat(least(coalesce(n, 0), 5), ' similar') AS message, CAST(1 AS BIGINT) AS line,
       CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS diff_pos,
       CAST(CASE WHEN k % 5 = 0 THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence
FROM files LEFT JOIN known ON repo = concat('mod', k % 20)
WHERE p_size % 5 IN (0, 3) OR path NOT LIKE 'vendor/%'""",
    "stream_reviews": f"""{_GO_FOUND}
SELECT repo_full_name, pr_number, md5(concat('h', pr_number)) AS head_sha, 'REQUEST_CHANGES' AS event,
       count(*) AS n_comments, count(*) AS n_rule, CAST(0 AS BIGINT) AS n_model
FROM found WHERE {_ENABLED} GROUP BY repo_full_name, pr_number""",
    "review_payloads": f"""SELECT repo_full_name, pr_number,
       CASE WHEN comments = '' THEN 'body,event' ELSE 'body,comments,event' END AS keys, event, body,
       CASE WHEN comments <> '' THEN comments END AS comments
FROM ({_REVIEW_TEXTS})""",
    "both_streams": f"""{_GO_FOUND}, models AS (
    SELECT repo_full_name, k AS pr_number, 1 AS model, CAST(0 AS BIGINT) AS diff_pos FROM files
    WHERE p_size % 5 IN (0, 3) OR path NOT LIKE 'vendor/%')
SELECT repo_full_name, pr_number, md5(concat('h', pr_number)) AS commit_id, count(*) FILTER (diff_pos > 0) AS n_comments,
       count(*) FILTER (model = 0) AS n_rule, count(*) FILTER (model = 1) AS n_model, CAST(sum(diff_pos) AS BIGINT) AS positions
FROM (SELECT repo_full_name, pr_number, 0 AS model, diff_pos FROM found WHERE {_ENABLED} UNION ALL FROM models)
GROUP BY repo_full_name, pr_number""",
    "stream_retries": f"""{_GO_FOUND}, n AS (SELECT pr_number, count(*) AS n_rule FROM found WHERE {_ENABLED} GROUP BY pr_number)
SELECT repo_full_name, k AS pr_number, md5(concat('h', k)) AS head_sha,
       CASE WHEN k % 7 = 0 THEN 'dead' ELSE 'reviewed' END AS status, CAST(CASE WHEN k % 7 = 0 THEN 4 END AS INTEGER) AS buried_after,
       CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE coalesce(n_rule, 0) END AS BIGINT) AS n_rule
FROM files LEFT JOIN n ON k = pr_number""",
    "stream_history": f"""{_GO_FOUND}, read AS (
    SELECT *, concat('mod', k % 20) AS repo, (k // 20) % 2 AS half FROM files WHERE p_size % 5 IN (0, 3) OR path NOT LIKE 'vendor/%'),
known AS (SELECT repo, count(*) AS n FROM read WHERE half = 0 GROUP BY repo)
SELECT repo, k AS pr_number, path AS file_path, 'llm-seen' AS rule,
       concat(CASE WHEN half = 0 THEN 0 ELSE least(coalesce(n, 0), 5) END, ' similar') AS message
FROM read LEFT JOIN known USING (repo)""",
    "strict_answers": """SELECT o_orderkey AS pr_number, o_orderkey % 8 IN (0, 2, 6, 7) AS ok,
       CAST(CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 0 END AS INTEGER) AS n_items,
       CASE WHEN o_orderkey % 8 IN (0, 2, 6) THEN CAST(o_orderkey AS BIGINT) END AS first_line,
       CASE WHEN o_orderkey % 8 = 2 THEN 'm' END AS second_message
FROM orders""",
    "cached_answers": f"""{_PROMPTS}
SELECT pr_number, CASE WHEN pr_number % 11 <> 0 THEN concat('suggester ', length(t)) END AS content,
       CASE WHEN pr_number % 11 = 0 THEN 'ValueError: no answer' END AS error,
       CAST(CASE WHEN pr_number % 11 <> 0 THEN 1 WHEN pr_number % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS calls
FROM texts WHERE stage = 'suggester'""",
    "unparseable_files": """SELECT p_partkey AS pr_number, 'panic-outside-main' AS rule, CAST(5 AS BIGINT) AS line
FROM part WHERE p_partkey % 13 IN (0, 7, 12)""",
    "delivery_limits": f"""SELECT event_id AS delivery_id,
       CAST(CASE WHEN event_id % 2 = 1 THEN 400 ELSE {_STATUS} END AS INTEGER) AS status FROM events""",
    "added_rule": """SELECT p_partkey AS pr_number, 'panic-outside-main' AS rule, 'warning' AS severity, CAST(5 AS BIGINT) AS line
FROM part WHERE p_partkey % 13 IN (0, 7, 12)
UNION ALL SELECT p_partkey, 'channel-read', 'info', CAST(4 AS BIGINT) FROM part WHERE p_partkey % 13 = 7""",
}
