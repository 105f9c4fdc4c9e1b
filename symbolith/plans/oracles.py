"""SQL that DuckDB runs on the same tables, by query."""

from __future__ import annotations

from symbolith.functions import security, text

PATH = r"regexp_replace(regexp_replace(replace(trim(rel_path), '\', '/'), '/(\./|/)*', '/', 'g'), '^(\./+|/)+', '')"
BASE = "list_extract(string_split(path, '/'), -1)"
EXTENSION = rf"lower(regexp_extract({BASE}, '^.+(\.[^.]*)$', 1))"
LANGUAGE = "CASE extension " + " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in text.LANGUAGE_BY_EXTENSION.items()) + " END"
FILES = f"""
raw AS (SELECT repo, {PATH} AS path, content, is_symlink, file_id, fetched_at FROM source_files WHERE repo IS NOT NULL AND rel_path IS NOT NULL),
once AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY fetched_at DESC, file_id DESC) AS rn FROM raw),
named AS (SELECT repo, path, content, is_symlink, file_id AS file_seq, {EXTENSION} AS extension FROM once WHERE rn = 1),
files AS (SELECT repo, path, extension, {LANGUAGE} AS language, sha256(content) AS content_hash, strlen(content) AS size_bytes, content, file_seq, is_symlink FROM named)"""
SYMBOLS = """
seen AS (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY seen_at DESC, symbol_seq DESC) AS rn FROM code_symbols WHERE repo IS NOT NULL AND id IS NOT NULL),
symbols AS (SELECT * FROM seen WHERE rn = 1)"""
FIRST = """
old_seen AS (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY seen_at, symbol_seq) AS rn FROM code_symbols WHERE repo IS NOT NULL AND id IS NOT NULL),
early AS (SELECT * FROM old_seen WHERE rn = 1)"""
STORED = r"""
last AS (SELECT repo, min(snapshot_no) AS snapshot_no FROM index_snapshots WHERE complete GROUP BY repo),
delivered AS (SELECT i.*, row_number() OVER (PARTITION BY repo, snapshot_no, shard ORDER BY delivered_at DESC, delivery_id DESC) AS rn FROM index_snapshots i JOIN last USING (repo, snapshot_no) WHERE complete),
entries AS (SELECT repo, unnest(map_entries(file_hashes)) AS e FROM delivered WHERE rn = 1),
stored AS (SELECT repo, regexp_replace(e.key, '^(\./+|/)+', '') AS path, max(lower(regexp_replace(e.value, '^(sha256|SHA256):', ''))) AS digest FROM entries GROUP BY 1, 2)"""
CHANGES = f"""{FILES}, {STORED},
changes AS (SELECT * FROM (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path,
  CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'deleted' WHEN o.digest <> n.content_hash THEN 'changed' END AS change
  FROM stored o FULL JOIN (SELECT * FROM files WHERE content IS NOT NULL) n ON o.repo = n.repo AND o.path = n.path) WHERE change IS NOT NULL)"""


def any_glob(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{text.glob_to_regex(p, True)}')" for p in patterns) + ")"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


PARTS = "string_split(path, '/')"
SECRET = f"({any_glob(BASE, security.SECRET_FILES)} OR {any_glob('path', security.SECRET_FILES)})"
REASON = rf"""CASE WHEN regexp_matches(trim(path), '^([/\\]|[A-Za-z]:)') OR list_contains(string_split(replace(path, '\', '/'), '/'), '..') THEN 'path_traversal'
 WHEN coalesce(is_symlink, false) THEN 'symlink_escape' WHEN size_bytes > 4096 THEN 'file_too_large' WHEN content IS NULL THEN 'unreadable' WHEN {SECRET} THEN 'secret_file'
 WHEN substr(extension, 2) IN ({listed(security.BINARY_EXTENSIONS)}) THEN 'binary_extension' END"""
ENTRY = f"(len(list_filter({PARTS}, lambda p: p IN ({listed(security.SKIPPED_ENTRIES)}) OR (p LIKE '.%' AND p <> '.github'))) > 0)"
IGNORED = r"""(CASE WHEN regexp_matches(path, '^api/(.*/)?chunk[^/]*(/|$)') THEN true WHEN regexp_matches(path, '^core/[^/]*\.jsx(/|$)') THEN false
 WHEN regexp_matches(path, '(^|/)[^/]*\.jsx(/|$)') THEN true WHEN regexp_matches(path, '(^|/)modules/') THEN true ELSE false END)"""
SKIP = f"""CASE WHEN {ENTRY} THEN 'skip_pattern' WHEN {IGNORED} THEN 'gitignore' WHEN {any_glob(BASE, security.SKIPPED_FILES)} THEN 'skip_pattern'
 WHEN language IS NULL THEN 'no_language' WHEN ({REASON}) IS NOT NULL THEN 'excluded' END"""
PRIORITY = f"(list_extract({PARTS}, 1) IN ({listed(security.PRIORITY_FOLDERS)}) AND contains(path, '/'))"
LINES = "lines AS (SELECT repo, path, file_seq, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT repo, path, file_seq, string_split(content, chr(10)) AS l FROM files))"
TOLD = r"""told AS (SELECT *, trim(regexp_replace(split_part(trim(docstring), chr(10), 1), '^[/*#\s]+', '')) AS dl FROM symbols),
cut AS (SELECT *, CASE WHEN instr(dl, '.') > 1 THEN left(dl, instr(dl, '.')) ELSE dl END AS dc FROM told)"""
DOC = "CASE WHEN length(dc) > 10 THEN left(dc, 120) END"
SIGNATURE = "upper(left(kind, 1)) || lower(substr(kind, 2)) || ' ''' || name || ''': ' || left(signature, 80)"
SLICE = "encode(f.content)[s.byte_offset + 1 : s.byte_offset + s.byte_length]"
RANGED = "FROM symbols s JOIN files f ON s.repo = f.repo AND s.file = f.path WHERE f.content IS NOT NULL AND byte_offset >= 0 AND byte_length >= 0"


def searched(query: str, where: str = "true", limit: int = 50) -> str:
    q = query.lower()
    holds = lambda c: f"contains(lower(coalesce({c}, '')), '{q}')"
    return f"""WITH {SYMBOLS}, scored AS (SELECT repo, id, name, kind, (CASE WHEN lower(coalesce(name, '')) = '{q}' THEN 20 WHEN starts_with(lower(coalesce(name, '')), '{q}') THEN 15 WHEN {holds("name")} THEN 10
 WHEN {holds("qualified_name")} THEN 8 WHEN {holds("signature")} THEN 6 WHEN {holds("summary")} THEN 5
 WHEN coalesce(len(list_filter(keywords, lambda k: contains(lower(k), '{q}'))) > 0, false) THEN 3 WHEN {holds("docstring")} THEN 1 ELSE 0 END)::BIGINT AS score
 FROM symbols WHERE {where}) SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, name, repo, id LIMIT {limit}"""


ORACLES: dict[str, str] = {
    "search_symbols_exact": searched("ColdSlice"),
    "search_symbols_prefix": searched("merge"),
    "search_symbols_substring": searched("Ledger", limit=100),
    "search_symbols_kind": searched("file", "kind = 'class'"),
    "search_symbols_language": searched("load", "language = 'python'"),
    "search_symbols_glob": searched("e", r"regexp_matches(file, 'src/.*\.ts')"),
    "search_symbols_empty": searched("", limit=100),
    "language_of_file": f"WITH {FILES} SELECT repo, path, extension, language FROM files",
    "exclude_reason": f"WITH {FILES} SELECT repo, path, {REASON} AS reason FROM files",
    "skip_counts": f"""WITH {FILES}, s AS (SELECT {SKIP} AS reason FROM files)
SELECT r.reason, count(s.reason) AS files FROM (SELECT unnest(['no_language', 'excluded', 'gitignore', 'skip_pattern']) AS reason) r LEFT JOIN s ON r.reason = s.reason GROUP BY 1""",
    "discover_priority_cap": f"""WITH {FILES}, s AS (SELECT repo, path, {PRIORITY} AS priority, row_number() OVER (PARTITION BY repo ORDER BY {PRIORITY} DESC, path) AS place FROM files WHERE ({SKIP}) IS NULL)
SELECT * FROM s WHERE place <= 50""",
    "binary_content": f"""WITH {FILES} SELECT coalesce(contains(left(content, 8192), chr(0)), false) AS "binary", count(*) AS files FROM files GROUP BY 1""",
    "detect_changes": f"WITH {CHANGES} SELECT repo, path, change FROM changes",
    "files_to_process": f"WITH {CHANGES} SELECT repo, path, size_bytes FROM files f WHERE EXISTS (FROM changes c WHERE c.repo = f.repo AND c.path = f.path AND c.change <> 'deleted')",
    "merge_symbols": f"""WITH {CHANGES}, {SYMBOLS}, {FIRST}
SELECT repo, file, id, 'first' AS seen FROM early s WHERE NOT EXISTS (FROM changes c WHERE c.repo = s.repo AND c.path = s.file AND c.change <> 'added')
UNION ALL SELECT repo, file, id, 'last' FROM symbols s WHERE EXISTS (FROM changes c WHERE c.repo = s.repo AND c.path = s.file AND c.change <> 'deleted')""",
    "processed_languages": f"WITH {CHANGES} SELECT repo, language, count(*) AS files FROM files f WHERE EXISTS (FROM changes c WHERE c.repo = f.repo AND c.path = f.path AND c.change <> 'deleted') GROUP BY 1, 2",
    "failed_runs": f"WITH {FILES}, {SYMBOLS} SELECT DISTINCT repo FROM files f WHERE content IS NOT NULL AND NOT EXISTS (FROM symbols s WHERE s.repo = f.repo)",
    "merge_file_hashes": f"WITH {FILES}, {STORED} SELECT f.repo, f.path, f.content_hash AS digest, coalesce(s.digest = f.content_hash, false) AS kept FROM files f LEFT JOIN stored s ON f.repo = s.repo AND f.path = s.path WHERE f.content IS NOT NULL",
    "disambiguate_overloads": f"""WITH {SYMBOLS}, b AS (SELECT repo, id, file, symbol_seq, file || '::' || qualified_name || '#' || kind AS base_id FROM symbols),
c AS (SELECT *, count(*) OVER (PARTITION BY repo, file, base_id) AS n_same, row_number() OVER (PARTITION BY repo, file, base_id ORDER BY symbol_seq, id) AS n FROM b)
SELECT repo, id, base_id, CASE WHEN n_same > 1 THEN base_id || '~' || n ELSE base_id END AS own_id, n_same FROM c""",
    "line_offsets": f"""WITH {FILES}, {LINES}
SELECT repo, path, line::BIGINT AS line, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, strlen(text)::BIGINT AS bytes FROM lines""",
    "symbol_source_bytes": f"WITH {FILES}, {SYMBOLS} SELECT s.repo, s.id, sha256({SLICE}) AS source_hash {RANGED}",
    "verify_hash": f"""WITH {FILES}, {SYMBOLS}, v AS (SELECT s.repo, CASE WHEN s.content_hash <> '' AND octet_length({SLICE}) > 0 THEN sha256({SLICE}) = lower(s.content_hash) END AS content_verified {RANGED})
SELECT repo, content_verified, count(*) AS symbols FROM v GROUP BY 1, 2""",
    "search_text": f"WITH {FILES}, {LINES} SELECT repo, path, line::BIGINT AS line, left(text, 200) AS text FROM lines WHERE contains(lower(text), 'retention limit') ORDER BY file_seq, line LIMIT 100",
    "search_text_glob": rf"WITH {FILES}, {LINES} SELECT repo, path, line::BIGINT AS line, left(text, 200) AS text FROM lines WHERE contains(lower(text), 'return') AND regexp_matches(path, 'core/.*\.go') ORDER BY file_seq, line LIMIT 200",
    "search_text_all": f"WITH {FILES}, {LINES} SELECT repo, path, line::BIGINT AS line, text FROM lines WHERE contains(lower(text), 'todo')",
    "search_text_grouped": f"WITH {FILES}, {LINES} SELECT repo, path, count(*) AS matches, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM lines WHERE contains(lower(text), 'fixme') GROUP BY 1, 2",
    "files_searched": f"""WITH {FILES}, {LINES}, m AS (SELECT file_seq FROM lines WHERE contains(lower(text), 'retention limit') ORDER BY file_seq, line LIMIT 100), l AS (SELECT max(file_seq) AS last, count(*) AS n FROM m)
SELECT count(*) FILTER (coalesce(n < 100, true) OR file_seq <= last) AS files_searched, max(n >= 100) AS truncated FROM files, l""",
    "get_symbols_batch": f"WITH {SYMBOLS} SELECT r.repo, r.symbol_seq AS pos, r.parent AS symbol_id, s.name, s.kind FROM symbols r JOIN symbols s ON r.repo = s.repo AND r.parent = s.id",
    "get_symbols_errors": f"WITH {SYMBOLS} SELECT r.repo, r.symbol_seq AS pos, r.parent AS symbol_id FROM symbols r WHERE r.parent IS NOT NULL AND NOT EXISTS (FROM symbols s WHERE r.repo = s.repo AND r.parent = s.id)",
    "get_symbol_context": f"""WITH {FILES}, {SYMBOLS},
j AS (SELECT s.repo, s.id, s.line, s.end_line, string_split(f.content, chr(10)) AS l FROM symbols s LEFT JOIN (FROM files WHERE content IS NOT NULL) f ON s.repo = f.repo AND s.file = f.path),
k AS (SELECT *, coalesce(len(l), 0) AS n, least(greatest(coalesce(line, 1), 1), coalesce(len(l), 0) + 1) AS a FROM j),
m AS (SELECT *, greatest(least(coalesce(end_line, line, 1), n), a - 1) AS z FROM k)
SELECT repo, id, CASE WHEN a > 1 THEN coalesce(array_to_string(l[greatest(1, a - 2) : a - 1], chr(10)), '') ELSE '' END AS context_before,
  CASE WHEN z < n THEN coalesce(array_to_string(l[z + 1 : z + 2], chr(10)), '') ELSE '' END AS context_after FROM m""",
    "repo_languages": f"WITH {SYMBOLS} SELECT repo, lower(language) AS language, count(*) AS symbols FROM symbols GROUP BY 1, 2",
    "repo_kinds": f"WITH {SYMBOLS} SELECT repo, kind, count(*) AS symbols FROM symbols GROUP BY 1, 2",
    "repo_top_dirs": f"""WITH {FILES}, c AS (SELECT repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir, count(*) AS file_count FROM files GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_count DESC, dir) AS n FROM c) SELECT repo, dir, file_count FROM r WHERE n <= 20""",
    "file_languages": f"WITH {SYMBOLS} SELECT repo, file, count(*) AS symbols, arg_max(language, (symbol_seq, id)) AS language FROM symbols GROUP BY 1, 2",
    "list_repos": f"""WITH {FILES}, {SYMBOLS}, r AS (SELECT repo, max(version) AS version FROM repos WHERE repo IS NOT NULL GROUP BY 1)
SELECT r.repo, r.version, coalesce(f.n, 0) AS file_count, coalesce(s.n, 0) AS symbol_count FROM r LEFT JOIN (SELECT repo, count(*) AS n FROM files GROUP BY 1) f USING (repo) LEFT JOIN (SELECT repo, count(*) AS n FROM symbols GROUP BY 1) s USING (repo)""",
    "resolve_short_name": "SELECT short_name, CASE WHEN count(*) = 1 THEN min(repo) END AS repo, count(*) AS candidates FROM (SELECT DISTINCT repo, split_part(repo, '/', -1) AS short_name FROM repos WHERE repo IS NOT NULL) GROUP BY 1",
    "docstring_summary": f"WITH {SYMBOLS}, {TOLD} SELECT repo, id, {DOC} AS summary FROM cut",
    "signature_summary": f"WITH {SYMBOLS} SELECT repo, id, {SIGNATURE} AS summary FROM symbols",
    "summary_tiers": f"""WITH {SYMBOLS}, {TOLD}, t AS (SELECT repo, id, CASE WHEN trim(summary) <> '' THEN summary END AS given, {DOC} AS doc, {SIGNATURE} AS made FROM cut)
SELECT repo, id, CASE WHEN given IS NOT NULL THEN 'given' WHEN doc IS NOT NULL THEN 'docstring' ELSE 'signature' END AS tier, coalesce(given, doc, made) AS summary FROM t""",
    "summary_prompts": f"""WITH {SYMBOLS}, n AS (SELECT repo, file, kind, qualified_name, signature, docstring, row_number() OVER (PARTITION BY repo, file ORDER BY symbol_seq, id) - 1 AS pos FROM symbols)
SELECT repo, file, floor(pos / 20)::BIGINT AS batch, '{text.PROMPT_HEAD}' || chr(10) || chr(10) || string_agg(coalesce((pos % 20 + 1) || '. [' || kind || '] ' || qualified_name || chr(10) || '   Signature: ' || coalesce(signature, '') || chr(10) || '   '
  || CASE WHEN coalesce(docstring, '') <> '' THEN 'Docstring: ' || left(docstring, 200) ELSE '' END, ''), chr(10) || chr(10) ORDER BY pos) AS prompt FROM n GROUP BY 1, 2, 3""",
    "padded_answers": r"""WITH a AS (SELECT doc_id, doc_id % 5 + 1 AS k, list_filter(string_split(regexp_replace(text, '\n- ', chr(10) || '12. ', 'g'), chr(10)), lambda x: regexp_matches(x, '^\s*\d+\.')) AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, l, unnest(generate_series(1, k)) AS n FROM a) SELECT doc_id, n::BIGINT AS n, coalesce(trim(regexp_replace(l[n], '^\d+\.\s*', '')), '') AS answer FROM n""",
    "batch_bytes": f"""WITH {FILES}, {SYMBOLS}, w AS (SELECT s.repo, s.file, s.byte_length FROM symbols s WHERE EXISTS (FROM symbols r WHERE r.repo = s.repo AND r.parent = s.id)),
h AS (SELECT repo, file, sum(byte_length) AS b FROM w GROUP BY 1, 2)
SELECT h.repo, count(*) AS files, sum(f.size_bytes)::BIGINT AS raw_bytes, sum(h.b)::BIGINT AS symbol_bytes FROM h JOIN files f ON h.repo = f.repo AND h.file = f.path GROUP BY 1""",
    "raw_bytes": f"""WITH {FILES}, m AS (SELECT *, contains(lower(content), 'todo') AS met FROM files)
SELECT repo, sum(size_bytes)::BIGINT AS all_bytes, coalesce(sum(size_bytes) FILTER (met), 0)::BIGINT AS met_bytes, count(*) FILTER (met) AS met_files FROM m GROUP BY 1""",
    "search_response": f"""WITH {SYMBOLS}, t AS (SELECT kind, count(*) AS n FROM symbols GROUP BY 1), m AS (SELECT kind, count(*) AS n FROM ({searched("merge", limit=10**9)}) GROUP BY 1)
SELECT t.kind, t.n AS total_indexed, least(coalesce(m.n, 0), 50)::BIGINT AS count, coalesce(m.n, 0) >= 50 AS truncated FROM t LEFT JOIN m ON t.kind = m.kind""",
    "payload_bytes": f"""WITH {SYMBOLS} SELECT repo, id, strlen(to_json({{'id': id, 'name': coalesce(name, ''), 'kind': coalesce(kind, ''), 'line': coalesce(line, 0)}})::VARCHAR)::BIGINT AS bytes FROM symbols""",
    "parse_numbered_response": r"""WITH a AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\n- ', chr(10) || '12. ', 'g'), chr(10)), lambda x: regexp_matches(x, '^\s*\d+\.')) AS l FROM documents)
SELECT doc_id, generate_subscripts(l, 1)::BIGINT AS n, trim(regexp_replace(unnest(l), '^\d+\.\s*', '')) AS answer FROM a""",
    "tokens_saved": f"WITH {FILES}, {SYMBOLS} SELECT s.repo, s.file, sum(floor(greatest(0, f.size_bytes - s.byte_length) / 4))::BIGINT AS tokens_saved FROM symbols s JOIN files f ON s.repo = f.repo AND s.file = f.path GROUP BY 1, 2",
    "savings_running_total": """WITH s AS (SELECT event_id, user_id, ts, floor(value * 4)::BIGINT AS saved FROM events)
SELECT event_id, user_id, saved, (sum(saved) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM s WHERE saved > 0""",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 10 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM n GROUP BY user_id, burst""",
    "duplicate_content": f"WITH {FILES} SELECT content_hash, count(*) AS files, count(DISTINCT repo) AS repos, min(path) AS first_path FROM files WHERE content <> '' GROUP BY 1 HAVING count(*) > 1",
    "repository_urls": """SELECT repo, unnest(['https://github.com/' || repo, 'https://github.com/' || repo || '.git', 'git@github.com:' || repo || '.git', 'github.com/' || repo || '/', repo]) AS url, repo AS parsed
FROM (SELECT DISTINCT repo FROM repos WHERE repo IS NOT NULL)""",
    "fetched_content": f"WITH {FILES} SELECT repo, path, CASE WHEN content = '' THEN 'empty' ELSE 'ok' END AS fetch_status, content_hash FROM files WHERE content IS NOT NULL",
    "body_addresses": f"WITH {FILES} SELECT repo, path, 'repos/' || repo || '/contents/' || array_to_string(list_transform({PARTS}, lambda x: url_encode(x)), '/') AS address FROM files",
    "repo_tree": f"""WITH {FILES}, k AS (SELECT repo, path, language, size_bytes AS size, {PRIORITY} AS priority FROM files WHERE language IS NOT NULL AND size_bytes <= 512000 AND NOT {any_glob(BASE, security.SKIPPED_FILES)} AND NOT {SECRET}
  AND NOT list_has_any({PARTS}, ['node_modules', 'vendor', '.git', 'dist', 'build', '__pycache__', '.cache', 'target', 'coverage', '.nyc_output', '.next', '.nuxt']) AND substr(extension, 2) NOT IN ({listed(security.BINARY_EXTENSIONS)})),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, path) AS n FROM k) SELECT repo, path, language, size::BIGINT AS size, priority FROM r WHERE n <= 50""",
    "indexed_files": f"WITH {FILES} SELECT repo, path, language, content_hash, size_bytes::BIGINT AS size_bytes FROM files WHERE ({SKIP}) IS NULL AND content IS NOT NULL",
    "snapshot_round_trip": f"WITH {SYMBOLS} SELECT repo, id, name, kind, line, docstring, parent, len(decorators)::BIGINT AS decorators, content_hash FROM symbols",
    "streamed_files": f"""WITH {FILES}, f AS (SELECT repo, path AS whole, language, content_hash, content, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM files)
SELECT repo, whole AS path, language, content_hash FROM f WHERE content IS NOT NULL AND language IS NOT NULL AND NOT {ENTRY}""",
    "watched_without": f"""WITH {FILES}, f AS (SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM files WHERE contains(path, '/')),
x AS (SELECT DISTINCT split_part(path, '/', 1) AS name FROM f WHERE lower(left(path, 1)) <= 'c')
SELECT repo, path AS folder FROM f WHERE NOT {ENTRY} AND NOT EXISTS (FROM x WHERE list_contains(string_split(f.path, '/'), x.name))""",
    "parsed_confirmed": f"""WITH {FILES}, {SYMBOLS}
SELECT DISTINCT s.repo, s.file, s.name, s.kind, s.line, s.end_line, s.byte_offset {RANGED} AND byte_length > 0 AND s.content_hash <> '' AND octet_length({SLICE}) > 0 AND sha256({SLICE}) = lower(s.content_hash)""",
    "watched_folders": f"WITH {FILES}, f AS (SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM files WHERE contains(path, '/')) SELECT repo, path AS folder FROM f WHERE NOT {ENTRY}",
}
TREE = f"""WITH {FILES}, {SYMBOLS}, c AS (SELECT repo, file, count(*) AS n FROM symbols GROUP BY 1, 2),
leaves AS (SELECT f.repo, f.path, 'file' AS type, f.language, coalesce(c.n, 0) AS symbol_count FROM files f LEFT JOIN c ON f.repo = c.repo AND f.path = c.file),
folders AS (SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS path FROM (SELECT repo, string_split(path, '/') AS p, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS i FROM files)),
nodes AS (FROM leaves UNION ALL SELECT repo, path, 'dir', NULL, 0 FROM folders)
SELECT repo, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent, {BASE} AS name, type, (len({PARTS}) - 1)::BIGINT AS depth, language, symbol_count FROM nodes"""
ORACLES["file_tree"] = TREE
ORACLES["file_tree_prefix"] = f"SELECT repo, path, type, depth FROM ({TREE}) WHERE path = 'src' OR starts_with(path, 'src/')"
ORACLES["file_tree_order"] = f"""SELECT repo, path, type, array_to_string(list_concat(list_transform(({PARTS})[1 : len({PARTS}) - 1], lambda x: '0' || x), [CASE type WHEN 'dir' THEN '0' ELSE '1' END || name]), chr(1)) AS sort_key FROM ({TREE})"""
FOREST = f"""WITH RECURSIVE {SYMBOLS},
linked AS (SELECT c.repo, c.id, c.file, p.id AS parent FROM symbols c LEFT JOIN symbols p ON c.repo = p.repo AND c.parent = p.id AND {{same}}),
walk AS (SELECT repo, id, file, id AS root, 0::BIGINT AS depth FROM linked WHERE parent IS NULL UNION ALL SELECT l.repo, l.id, l.file, w.root, w.depth + 1 FROM walk w JOIN linked l ON l.repo = w.repo AND l.parent = w.id)"""
ORACLES["file_outline"] = f"""WITH RECURSIVE {SYMBOLS},
linked AS (SELECT c.repo, c.id, c.file, c.symbol_seq, p.id AS parent FROM symbols c LEFT JOIN symbols p ON c.repo = p.repo AND c.parent = p.id AND c.file = p.file WHERE c.file IS NOT NULL),
walk AS (SELECT repo, id, file, id AS root, 0::BIGINT AS depth, [(symbol_seq, id)] AS trail FROM linked WHERE parent IS NULL
UNION ALL SELECT l.repo, l.id, l.file, w.root, w.depth + 1, list_append(w.trail, (l.symbol_seq, l.id)) FROM walk w JOIN linked l ON l.repo = w.repo AND l.file = w.file AND l.parent = w.id)
SELECT repo, file, id, root, depth, row_number() OVER (PARTITION BY repo, file ORDER BY trail) - 1 AS preorder FROM walk"""
ORACLES["p3_paths"] = f"""WITH RECURSIVE {SYMBOLS},
linked AS (SELECT c.repo, c.id, p.id AS parent, coalesce(c.name, '') AS name, c.language, c.qualified_name FROM symbols c LEFT JOIN symbols p ON c.repo = p.repo AND c.parent = p.id),
walk AS (SELECT repo, id, id AS root, 0::BIGINT AS depth, [name] AS names FROM linked WHERE parent IS NULL
UNION ALL SELECT l.repo, l.id, w.root, w.depth + 1, list_append(w.names, l.name) FROM walk w JOIN linked l ON l.repo = w.repo AND l.parent = w.id),
pairs AS (SELECT l.repo, l.parent AS id, l.id AS below FROM linked l JOIN walk w ON w.repo = l.repo AND w.id = l.id WHERE l.parent IS NOT NULL
UNION ALL SELECT p.repo, l.parent, p.below FROM pairs p JOIN linked l ON l.repo = p.repo AND l.id = p.id WHERE l.parent IS NOT NULL),
n AS (SELECT repo, id, count(*) AS n FROM pairs GROUP BY 1, 2),
caught AS (SELECT repo, id, parent FROM linked l WHERE NOT EXISTS (FROM walk w WHERE w.repo = l.repo AND w.id = l.id)),
up AS (SELECT repo, id, parent AS above FROM caught UNION SELECT u.repo, u.id, c.parent FROM up u JOIN caught c ON c.repo = u.repo AND c.id = u.above)
SELECT l.repo, l.id, w.root, w.depth, CASE WHEN w.id IS NULL THEN CASE WHEN EXISTS (FROM up u WHERE u.repo = l.repo AND u.id = l.id AND u.above = l.id) THEN 'on' ELSE 'below' END WHEN w.depth = 0 THEN 'root' ELSE 'inner' END AS place,
  CASE WHEN lower(l.language) IN ('rust', 'rs', 'go', 'golang', 'c', 'c99', 'cpp') THEN array_to_string(w.names, '::') ELSE array_to_string(w.names, '.') END AS path, l.qualified_name, CASE WHEN w.id IS NOT NULL THEN coalesce(n.n, 0) END AS descendants
FROM linked l LEFT JOIN walk w ON w.repo = l.repo AND w.id = l.id LEFT JOIN n ON n.repo = l.repo AND n.id = l.id"""
ORACLES["p3_found"] = (
    FOREST.format(same="true")
    + """,
caught AS (SELECT repo, id, parent FROM linked l WHERE NOT EXISTS (FROM walk w WHERE w.repo = l.repo AND w.id = l.id)),
up AS (SELECT repo, id, parent AS above FROM caught UNION SELECT u.repo, u.id, c.parent FROM up u JOIN caught c ON c.repo = u.repo AND c.id = u.above)
SELECT repo, id, CASE WHEN EXISTS (FROM up u WHERE u.repo = c.repo AND u.id = c.id AND u.above = c.id) THEN 'on' ELSE 'below' END AS place FROM caught c"""
)
ORACLES["p3_descendants"] = (
    FOREST.format(same="true")
    + """,
pairs AS (SELECT l.repo, l.parent AS id, l.id AS descendant, 1::BIGINT AS distance FROM linked l JOIN walk w ON w.repo = l.repo AND w.id = l.id WHERE l.parent IS NOT NULL
UNION ALL SELECT p.repo, l.parent, p.descendant, p.distance + 1 FROM pairs p JOIN linked l ON l.repo = p.repo AND l.id = p.id WHERE l.parent IS NOT NULL)
SELECT repo, id, descendant, distance FROM pairs"""
)
STATES = r"""
d AS (SELECT *, row_number() OVER (PARTITION BY repo, snapshot_no, shard ORDER BY delivered_at DESC, delivery_id DESC) AS rn FROM index_snapshots WHERE complete),
f AS (SELECT repo, snapshot_no, 'file' AS record_type, regexp_replace(e.key, '^(\./+|/)+', '') AS record_key, max(lower(regexp_replace(e.value, '^(sha256|SHA256):', ''))) AS h
      FROM (SELECT repo, snapshot_no, unnest(map_entries(file_hashes)) AS e FROM d WHERE rn = 1) GROUP BY 1, 2, 3, 4),
y AS (SELECT repo, snapshot_no, 'symbol' AS record_type, id AS record_key, arg_max(lower(regexp_replace(content_hash, '^(sha256|SHA256):', '')), (delivered_at, lower(regexp_replace(content_hash, '^(sha256|SHA256):', '')))) AS h FROM symbol_snapshots GROUP BY 1, 2, 3, 4),
a AS (SELECT * FROM f UNION ALL SELECT * FROM y)"""
ORACLES["p6_found"] = f"""WITH {STATES},
n AS (SELECT repo, snapshot_no, lead(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS next_no FROM (SELECT repo, snapshot_no FROM index_snapshots UNION SELECT repo, snapshot_no FROM symbol_snapshots)),
o AS (SELECT a.*, n.next_no FROM a JOIN n USING (repo, snapshot_no) WHERE n.next_no IS NOT NULL),
w AS (SELECT a.* FROM a JOIN n ON a.repo = n.repo AND a.snapshot_no = n.next_no)
SELECT coalesce(w.repo, o.repo) AS repo, coalesce(w.snapshot_no, o.next_no) AS snapshot_no, coalesce(w.record_type, o.record_type) AS record_type, coalesce(w.record_key, o.record_key) AS record_key,
       CASE WHEN o.repo IS NULL THEN 'added' WHEN w.repo IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM o FULL JOIN w ON o.repo = w.repo AND o.next_no = w.snapshot_no AND o.record_type = w.record_type AND o.record_key = w.record_key
WHERE o.repo IS NULL OR w.repo IS NULL OR o.h <> w.h
"""
ORACLES["p6_intervals"] = f"""WITH {STATES},
n AS (SELECT repo, snapshot_no, row_number() OVER (PARTITION BY repo ORDER BY snapshot_no) AS ordinal FROM (SELECT repo, snapshot_no FROM index_snapshots UNION SELECT repo, snapshot_no FROM symbol_snapshots)),
b AS (SELECT a.*, n.ordinal, coalesce(lag(n.ordinal) OVER w = n.ordinal - 1 AND lag(coalesce(a.h, '')) OVER w = coalesce(a.h, ''), false) AS goes_on FROM a JOIN n USING (repo, snapshot_no)
  WINDOW w AS (PARTITION BY a.repo, a.record_type, a.record_key ORDER BY n.ordinal)),
i AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY repo, record_type, record_key ORDER BY ordinal) AS island FROM b)
SELECT repo, record_type, record_key, max(coalesce(h, '')) AS digest, min(snapshot_no) AS valid_from, max(snapshot_no) AS valid_to FROM i GROUP BY repo, record_type, record_key, island"""
