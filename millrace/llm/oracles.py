"""SQL for DuckDB for the training-data queries that it can express over whole tables.

DuckDB has no NFKC folding; the forms that the tables hold (full-width signs) are translated one by one.
"""

from __future__ import annotations

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_SPACE = r"\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}"


def _words(text: str) -> str:
    plain = rf"regexp_replace(translate({text}, '{_WIDE}', '{_NARROW}'), '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g')"
    return rf"regexp_extract_all(lower({plain}), '[\p{{L}}\p{{N}}]+')"


def _triples(name: str, rows: str, key: str, text: str) -> str:
    """CTEs name_w(id, w), name_t(id, t) of distinct triples and name_n(id, n)."""
    return f"""{name}_w AS MATERIALIZED (SELECT DISTINCT {key} AS id, {_words(text)} AS w FROM {rows} WHERE {text} IS NOT NULL),
    {name}_t AS MATERIALIZED (SELECT DISTINCT id, t FROM (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM {name}_w)),
    {name}_n AS MATERIALIZED (SELECT id, count(*) AS n FROM {name}_t GROUP BY id)"""


_OVERLAP = f"""WITH {_triples('e', 'eval_row', 'eval_id', 'problem')}, {_triples('g', 'grpo', 'problem_id', 'problem')},
    met AS (SELECT e_t.id AS a, g_t.id AS b, count(*) AS k FROM e_t JOIN g_t USING (t) GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT a, b FROM met JOIN e_n ON e_n.id = a JOIN g_n ON g_n.id = b WHERE k / (e_n.n + g_n.n - k) >= 0.5)"""


def _near(name: str, rows: str, key: str, text: str) -> str:
    return f"""(WITH {_triples(name, rows, key, text)},
    met AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM {name}_t x JOIN {name}_t y ON x.t = y.t AND x.id < y.id GROUP BY ALL)
    SELECT a, b FROM met JOIN {name}_n p ON p.id = a JOIN {name}_n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.5)"""


def _groups(name: str, rows: str, key: str, text: str) -> str:
    return f"""(WITH RECURSIVE {_triples(name, rows, key, text)},
    sets AS (SELECT id, md5(string_agg(t, '|' ORDER BY t)) AS s FROM {name}_t GROUP BY id), members AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM sets),
    r_t AS MATERIALIZED (SELECT * FROM {name}_t WHERE id IN (SELECT rep FROM members)),
    met AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM r_t x JOIN r_t y ON x.t = y.t AND x.id < y.id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM met JOIN {name}_n p ON p.id = a JOIN {name}_n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.5),
    ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b)
    SELECT id, rep, coalesce((SELECT min(least(r.a, r.b)) FROM reach r WHERE r.a = rep), rep) AS group_id FROM members)"""


_CHAT = "(SELECT sft_id, array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(coalesce(m.role, ''))) <> 'system'), lambda m: coalesce(m.content, '')), chr(10)) AS said FROM sft)"

_LEAK = f"""WITH {_triples('e', 'eval_row', 'eval_id', 'problem')}, {_triples('d', 'documents', 'doc_id', 'text')},
    met AS (SELECT e_t.id AS a, d_t.id AS b, count(*) AS k FROM e_t JOIN d_t USING (t) GROUP BY ALL)"""

# Joining rank by rank is the same as joining the least rank again and again, as no merge makes a pair of a lower rank.
_RUNS = rf"' ?[\p{{L}}\p{{Nl}}\p{{No}}]+| ?\p{{Nd}}{{1,3}}| ?[^\p{{L}}\p{{N}}_{_SPACE}]+|[{_SPACE}]+|_+'"
_TOKENS = rf"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, {_RUNS})) AS piece FROM documents),
    ranked AS (SELECT list({{'t': '', 'a': chr(1) || left_piece || chr(2) || chr(1) || right_piece || chr(2), 'b': chr(1) || left_piece || right_piece || chr(2)}} ORDER BY merge_rank) AS m FROM tokenizer_merge),
    pieces AS (SELECT DISTINCT piece FROM runs), split AS (SELECT piece, regexp_replace(piece, '(?s)(.)', chr(1) || '\1' || chr(2), 'g') AS t FROM pieces),
    joined AS (SELECT piece, list_reduce(list_prepend({{'t': t, 'a': '', 'b': ''}}, m), lambda x, y: {{'t': replace(x.t, y.a, y.b), 'a': '', 'b': ''}}).t AS t FROM split, ranked),
    counted AS MATERIALIZED (SELECT piece, length(t) - length(replace(t, chr(2), '')) AS n FROM joined),
    tokens AS (SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN counted USING (piece) GROUP BY d.doc_id)"""


def _cleaned(x: str) -> str:
    return rf"coalesce(nullif(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), ''), '(missing)')"


_KEYS = f"""(SELECT doc_id, {_cleaned('subset')} AS subset, {_cleaned('source')} AS source, coalesce(nullif(regexp_split_to_array({_cleaned('lang')}, '[-_]')[1], 'und'), '(missing)') AS language,
    {_cleaned("regexp_extract(meta, '[''" + '"' + "]domain[''" + '"' + "]\\s*:\\s*[''" + '"' + "]([^''" + '"' + "]*)[''" + '"' + "]', 1)")} AS domain FROM documents)"""

ORACLES: dict[str, str] = {
    "p1_found": f"{_OVERLAP} SELECT a AS eval_id, b AS problem_id FROM pairs",
    "p1_split_source": f"""{_OVERLAP}, starts AS (SELECT DISTINCT a, b, i FROM pairs JOIN (SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM e_w) e ON e.id = a JOIN g_t ON g_t.id = b AND g_t.t = w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
    inside AS (SELECT DISTINCT a, b, unnest([i, i + 1, i + 2]) AS p FROM starts), covered AS (SELECT a, b, count(*) / any_value(len(w)) AS c FROM inside JOIN e_w ON e_w.id = a GROUP BY a, b),
    g AS (SELECT problem_id, min(CASE WHEN source IS NULL OR trim(source) = '' THEN '(missing)' ELSE lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) END) AS source FROM grpo GROUP BY 1)
    SELECT lower(trim(split)) AS split, g.source, count(*) AS n_pairs, count(DISTINCT a) AS n_eval, count(DISTINCT b) AS n_problems, avg(c) AS mean_coverage
    FROM covered JOIN eval_row ON eval_id = a JOIN g ON problem_id = b GROUP BY 1, 2""".replace("\\\\s", "\\s"),
    "p2_found": rf"""SELECT doc_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[{_SPACE}.!?;:,。！？；：，]'), lambda x: length(x))) > 4000 THEN 'forced' ELSE 'natural' END AS cut_kind
    FROM documents WHERE length(text) > 4000""",
    "p2_rebuilt": "SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS digest, true AS legal FROM documents WHERE length(text) > 4000",
    "p5_kept": "SELECT DISTINCT trim(subset) AS subset, true AS repeats_kept, true AS share_kept, 0::BIGINT AS n_wrong FROM mix_target WHERE target_share > 0",
    "p7_kept": f"{_TOKENS} SELECT doc_id, n_tokens, true AS fills_kept FROM tokens",
    "p3_found": f"SELECT 'documents' AS table_name, a AS id_a, b AS id_b FROM {_near('d', 'documents', 'doc_id', 'text')} UNION ALL SELECT 'sft', a, b FROM {_near('s', _CHAT, 'sft_id', 'said')}",
    "p3_groups": f"SELECT 'documents' AS table_name, id, rep, group_id FROM {_groups('d', 'documents', 'doc_id', 'text')} UNION ALL SELECT 'sft', id, rep, group_id FROM {_groups('s', _CHAT, 'sft_id', 'said')}",
    "p6_doc_tokens": f"{_TOKENS} SELECT doc_id, n_tokens FROM tokens",
    "p6_token_budget": f"""{_TOKENS}, keyed AS (SELECT * FROM tokens JOIN {_KEYS} USING (doc_id)),
    cells AS (SELECT 'subset' AS dimension, subset AS value, n_tokens FROM keyed UNION ALL SELECT 'source', source, n_tokens FROM keyed UNION ALL SELECT 'language', language, n_tokens FROM keyed UNION ALL SELECT 'domain', domain, n_tokens FROM keyed)
    SELECT dimension, value, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens FROM cells GROUP BY dimension, value""",
    "p8_coverage": f"{_LEAK} SELECT a AS eval_id, b AS doc_id, k::INTEGER AS covered, n::INTEGER AS n_query, k / n AS coverage FROM met JOIN e_n ON e_n.id = a WHERE k / n >= 0.5",
    "p8_found": f"{_LEAK} SELECT a AS eval_id, b AS doc_id FROM met JOIN e_n ON e_n.id = a WHERE k / n >= 0.5",
}
