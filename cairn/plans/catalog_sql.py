"""DuckDB SQL for the queries of the catalogue, written against the input tables alone."""

from __future__ import annotations

from cairn.functions.text import STOPWORDS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def _terms(text: str) -> str:
    words = f"regexp_split_to_array(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '[\\x09-\\x0d [:punct:]]+')"
    return f"list_filter({words}, lambda w: strlen(w) BETWEEN 2 AND 64 AND w NOT IN ({_STOP}))"


_T = f"t AS (SELECT doc_id, {_terms('text')} AS t FROM documents)"
_TOK = _T + ", k AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS position FROM t)"
_E = "e AS (SELECT doc_id AS entry_id, '/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS content, CAST(strlen(coalesce(text, '')) AS BIGINT) AS original_size, sha256(coalesce(text, '')) AS sha256 FROM documents)"
_P = "p AS (SELECT page_id AS entry_id, '/' || regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path, CASE WHEN regexp_extract(url, '^[^:]*://([^?#]*)', 1) LIKE '%/' THEN 'Directory' ELSE 'File' END AS type, CAST(strlen(html) AS BIGINT) AS original_size FROM pages)"
_PARTS = "list_filter(string_split({0}, '/'), lambda x: x NOT IN ('', '.', '..'))"
_NORM = "'/' || array_to_string(" + _PARTS + ", '/')"
_PARENT = "coalesce(nullif(regexp_extract({0}, '^(.*)/[^/]*$', 1), ''), '/')"
_CHUNKS = "c AS (SELECT entry_id, i AS ordinal, CAST(i * {0} AS BIGINT) AS chunk_offset, substr(hex(content), CAST(i * {0} * 2 + 1 AS BIGINT), {0} * 2) AS h FROM (SELECT *, unnest(range(0, CAST((original_size + {0} - 1) // {0} AS BIGINT))) AS i FROM e)), ch AS (SELECT entry_id, CAST(ordinal AS INTEGER) AS ordinal, chunk_offset, CAST(length(h) // 2 AS BIGINT) AS chunk_size, sha256(unhex(h)) AS sha256 FROM c)"
_J = "j AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'BeginCheckpoint' WHEN 'view' THEN 'CreateEntry' WHEN 'click' THEN 'UpdateEntry' WHEN 'purchase' THEN 'Commit' WHEN 'error' THEN 'Abort' ELSE 'DeleteEntry' END AS type, user_id AS entry_id, props AS data FROM events)"
_M = "('BeginCheckpoint', 'EndCheckpoint', 'Commit', 'Abort')"
_INC = _J + f""", s AS (SELECT *, sum(CASE WHEN type = 'BeginCheckpoint' THEN 1 WHEN type IN ('EndCheckpoint', 'Commit', 'Abort') THEN -1 ELSE 0 END) OVER (ORDER BY seq) AS s FROM j),
d AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY seq)) AS BIGINT) AS depth FROM s), i AS (SELECT seq, type, entry_id, depth FROM d WHERE depth > 0 AND type NOT IN {_M})"""
_R = _J + f""", m AS (SELECT *, last_value(CASE WHEN type IN {_M} THEN type END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark,
  first_value(CASE WHEN type IN ('EndCheckpoint', 'Commit', 'Abort') THEN type END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM j),
r AS (SELECT *, coalesce(mark = 'BeginCheckpoint' AND type NOT IN {_M}, false) AS applied FROM m)"""
_N = """n AS (SELECT path, entry_id, original_size AS size, sha256 FROM e),
b AS (SELECT path, entry_id, size, sha256 AS checksum, [entry_id, entry_id + 1] AS block_ids FROM n WHERE entry_id % 7 <> 0),
g AS (SELECT path, entry_id, CAST(size + CASE WHEN entry_id % 3 = 0 THEN 10 ELSE 0 END AS BIGINT) AS size, CASE WHEN entry_id % 3 = 0 THEN sha256(sha256 || '+') ELSE sha256 END AS checksum,
  CASE WHEN entry_id % 3 = 0 THEN [entry_id, entry_id + 2] ELSE [entry_id, entry_id + 1] END AS block_ids FROM n WHERE entry_id % 5 <> 0),
d AS (SELECT * FROM (SELECT coalesce(b.path, g.path) AS path, b.size AS old_size, g.size AS new_size, b.block_ids AS old_blocks, g.block_ids AS g_blocks,
  CASE WHEN b.path IS NULL THEN 'Added' WHEN g.path IS NULL THEN 'Deleted' WHEN b.checksum <> g.checksum OR b.size <> g.size THEN 'Modified' END AS action FROM b FULL JOIN g ON b.path = g.path) WHERE action IS NOT NULL)"""
_ENT = """h AS (SELECT entry_id, unnest(regexp_extract_all(hex(content), '..')) AS byte FROM e), hn AS (SELECT entry_id, byte, count(*) AS n FROM h GROUP BY 1, 2),
ha AS (SELECT entry_id, sum(n) AS t, sum(n * log2(n)) AS s, sum(CASE WHEN byte <> '00' THEN n ELSE 0 END) AS nz FROM hn GROUP BY 1),
hv AS (SELECT e.entry_id, e.original_size AS size, round(CASE WHEN coalesce(t, 0) = 0 THEN 0e0 ELSE log2(t) - s / t END, 6) + 0e0 AS entropy, coalesce(nz, 0) AS nz FROM e LEFT JOIN ha USING (entry_id)),
en AS (SELECT entry_id, size, entropy, CASE WHEN nz = 0 THEN 'ZeroFilled' WHEN entropy < 5 THEN 'LowEntropyText' WHEN entropy < 6.8e0 THEN 'StructuredBinary' WHEN entropy < 7.85e0 THEN 'HighEntropyCompressed' ELSE 'EncryptedUniform' END AS class FROM hv)"""


def _varint(x: str) -> str:
    """The hex digits of a non-negative number's varint."""
    groups = f"CAST(greatest(1, ceil(length(ltrim(bin({x}), '0')) / 7e0)) AS BIGINT)"
    return f"array_to_string(list_transform(range(0, {groups}), lambda i: printf('%02x', (({x}) >> CAST(7 * i AS BIGINT)) & 127 | CASE WHEN i < {groups} - 1 THEN 128 ELSE 0 END)), '')"


_PAY = _J + f""", y AS (SELECT *, CASE WHEN type IN ('CreateEntry', 'UpdateEntry') THEN {_varint('entry_id')} || lower(hex(coalesce(data, ''))) WHEN type = 'DeleteEntry' THEN {_varint('entry_id')} ELSE '' END AS raw FROM j)"""
_REC = _R + f""", z AS (SELECT count(*) FILTER (type NOT IN {_M}) AS n, count(*) FILTER (applied AND seq % 13 = 0) AS failed FROM r),
  q AS (SELECT CAST(sum(step) OVER (ORDER BY seq) AS BIGINT) AS s, seq, type FROM (SELECT *, CASE WHEN type = 'BeginCheckpoint' THEN 1 WHEN type IN ('EndCheckpoint', 'Commit', 'Abort') THEN -1 ELSE 0 END AS step FROM j)),
  qd AS (SELECT *, s - least(0, min(s) OVER (ORDER BY seq)) AS depth FROM q), o AS (SELECT count(*) AS c FROM qd WHERE depth > 0 AND type NOT IN {_M})"""
_LINE = "rpad('  {0}:', {2}, ' ') || {1} || chr(10)"
_BAR = "'[' || rpad(repeat('=', CAST(floor(least(greatest({0}, 0e0), 1e0) * 30 + 0.5e0) AS INTEGER)), 30, '-') || '] ' || printf('%.1f%%', least(greatest({0}, 0e0), 1e0) * 100)"
_BYTES = "CASE WHEN {0} < 1024 THEN CAST({0} AS VARCHAR) || ' B' WHEN {0} < 1048576 THEN printf('%.2f KB', {0} / 1024e0) WHEN {0} < 1073741824 THEN printf('%.2f MB', {0} / 1048576e0) ELSE printf('%.2f GB', {0} / 1073741824e0) END"


def _bm25(terms: list[str], where: str, tail: str, k1: str = "1.2e0", b: str = "0.75e0") -> str:
    stats = ", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS df{i}" for i, w in enumerate(terms))
    score = " + ".join(f"CASE WHEN tf{i} = 0 OR idf{i} <= 0 THEN 0e0 ELSE idf{i} * tf{i} * ({k1} + 1e0) / (tf{i} + {k1} * (1e0 - {b} + {b} * dl / av)) END" for i in range(len(terms)))
    tfs = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    idfs = ", ".join(f"CASE WHEN df{i} = 0 THEN 0e0 ELSE ln(1e0 + greatest(0e0, (n - df{i} + 0.5e0) / (df{i} + 0.5e0))) END AS idf{i}" for i in range(len(terms)))
    found = " + ".join(f"CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END" for i in range(len(terms)))
    names = ", ".join(f"CASE WHEN tf{i} > 0 THEN '{w}' END" for i, w in enumerate(terms))
    return f"""WITH {_T}, c AS (SELECT count(*) AS n, avg(len(t)) AS av, {stats} FROM t), x AS (SELECT doc_id, len(t) AS dl, {tfs} FROM t), w AS (SELECT *, {idfs} FROM c),
    s AS (SELECT doc_id, round({score}, 6) AS score, array_to_string(list_filter([{names}], lambda m: m IS NOT NULL), ' ') AS matched_terms, {found} AS found FROM x, w)
    SELECT doc_id, score, matched_terms FROM s WHERE found > 0 AND {where} {tail}"""


SQL = {
    "tokenize_stats": f"WITH {_T} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM t",
    "tokenize_offsets": f"""WITH r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([\\x09-\\x0d [:punct:]]+|[^\\x09-\\x0d [:punct:]]+)') AS runs FROM documents),
        u AS (SELECT doc_id, unnest(runs) AS x, generate_subscripts(runs, 1) AS i FROM r),
        o AS (SELECT doc_id, x, i, CAST(sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(x) AS BIGINT) AS byte_offset FROM u),
        k AS (SELECT doc_id, i, byte_offset, CAST(strlen(x) AS BIGINT) AS byte_length, translate(x, '{_UP}', '{_LOW}') AS term FROM o WHERE NOT regexp_matches(x, '^[\\x09-\\x0d [:punct:]]'))
        SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, byte_offset, byte_length FROM k WHERE strlen(term) BETWEEN 2 AND 64 AND term NOT IN ({_STOP})""",
    "term_frequencies": f"WITH {_TOK} SELECT doc_id, term, count(*) AS tf FROM k GROUP BY 1, 2",
    "document_frequency": f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total_tf FROM k GROUP BY 1",
    "postings": f"WITH {_TOK} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM k GROUP BY 1, 2",
    "posting_deltas": f"WITH {_TOK}, l AS (SELECT doc_id, term, max(position) AS m, sum(position) AS s FROM k GROUP BY 1, 2) SELECT doc_id, count(*) AS terms, CAST(sum(m) AS BIGINT) AS last_positions, CAST(sum(s) AS BIGINT) AS all_positions FROM l GROUP BY 1",
    "corpus_stats": f"WITH {_TOK} SELECT (SELECT count(*) FROM t) AS total_documents, CAST(count(*) AS BIGINT) AS total_tokens, count(DISTINCT term) AS total_terms, round(count(*) / (SELECT count(*) FROM t), 6) AS average_length FROM k",
    "bm25_search": _bm25(["theaea", "onlyhe", "atshsh"], "score >= 0", "ORDER BY score DESC, doc_id LIMIT 10"),
    "bm25_all_terms": _bm25(["theaea", "onlyhe"], "found = 2", ""),
    "bm25_min_score": _bm25(["theaea", "onlyhe", "atshsh"], "score >= 2.5e0", ""),
    "bm25_scan": _bm25(["theaea", "onlyhe", "atshsh"], "score >= 0", "ORDER BY score DESC, doc_id LIMIT 20", "2e0", "0.5e0"),
    "tokenize_by_white_space": f"""WITH k AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x09-\\x0d ]+'), lambda w: strlen(w) BETWEEN 2 AND 64 AND w <> 'theaea' AND w NOT IN ({_STOP}))) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total_tf FROM k GROUP BY 1""",
    "remove_and_reindex": f"WITH k AS (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT doc_id, unnest({_terms("translate(text, '" + _LOW + "', '" + _UP + "')")}) FROM documents WHERE lang = 'de'), g AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY 1, 2) SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens FROM g GROUP BY 1",
    "find_by_id": f"WITH {_P} SELECT * FROM p WHERE entry_id = 42",
    "find_by_path": f"WITH {_E} SELECT entry_id, path FROM e WHERE path = '/en/src7/7'",
    "find_by_prefix": f"WITH {_P} SELECT entry_id, path FROM p WHERE starts_with(path, '/blog.')",
    "find_by_type": f"WITH {_P} SELECT entry_id, path, type FROM p WHERE type = 'Directory'",
    "glob_match": f"WITH {_P} SELECT entry_id, path FROM p WHERE path GLOB '*.example.???/en/*'",
    "existing_paths": f"WITH {_E}, w AS (SELECT doc_id, '/en/' || source || '/' || CAST(doc_id AS VARCHAR) AS path FROM labels JOIN documents USING (doc_id)) SELECT doc_id, path FROM w WHERE path IN (SELECT path FROM e)",
    "normalize_paths": f"WITH {_P}, m AS (SELECT *, '/./' || replace(path, '/', '//') || '/../' AS messy FROM p) SELECT entry_id, {_NORM.format('messy')} AS normalized, CAST(len({_PARTS.format('messy')}) AS INTEGER) AS depth, {_PARENT.format('path')} AS parent, string_split(path, '/')[-1] AS name FROM m",
    "path_depth_histogram": f"WITH {_P} SELECT CAST(len({_PARTS.format('path')}) AS INTEGER) AS depth, count(*) AS entries FROM p GROUP BY 1",
    "list_directory": f"WITH {_E} SELECT DISTINCT path, 3 AS depth, true AS is_leaf FROM e WHERE starts_with(path, '/en/src7/')",
    "tree_nodes": f"""WITH {_P}, q AS (SELECT {_PARTS.format('path')} AS a FROM p), x AS (SELECT '/' || array_to_string(a, '/') AS path, true AS leaf FROM q
        UNION ALL SELECT '/' || array_to_string(a[1:k], '/'), false FROM (SELECT a, unnest(range(0, greatest(len(a), 1))) AS k FROM q))
        SELECT path, CAST(len({_PARTS.format('path')}) AS INTEGER) AS depth, bool_and(leaf) AS is_leaf FROM x GROUP BY 1, 2""",
    "directory_rollup": f"WITH {_E}, q AS (SELECT original_size, {_PARTS.format('path')} AS a FROM e), x AS (SELECT '/' || array_to_string(a[1:k], '/') AS dir, original_size FROM (SELECT a, original_size, unnest(range(0, greatest(len(a), 1))) AS k FROM q)) SELECT dir, count(*) AS entries, CAST(sum(original_size) AS BIGINT) AS bytes FROM x GROUP BY 1",
    "tree_preorder": f"""WITH {_P}, q AS (SELECT {_PARTS.format('path')} AS a FROM p), x AS (SELECT a FROM q UNION SELECT a[1:k] FROM (SELECT a, unnest(range(0, greatest(len(a), 1))) AS k FROM q))
        SELECT row_number() OVER (ORDER BY array_to_string(a, chr(1))) - 1 AS position, '/' || array_to_string(a, '/') AS path FROM x""",
    "remove_subtree": f"WITH {_E} SELECT {_PARENT.format('path')} AS dir, count(*) AS entries FROM e WHERE NOT (path = '/en/src1' OR starts_with(path, '/en/src1/')) GROUP BY 1",
    "upsert_entries": f"WITH {_E} SELECT entry_id, CASE WHEN entry_id % 4 = 0 THEN path || '.v2' ELSE path END AS path, CASE WHEN entry_id % 4 = 0 THEN original_size * 2 ELSE original_size END AS original_size FROM e UNION ALL SELECT -entry_id, path, original_size FROM e WHERE entry_id % 50 = 1",
    "validate_catalogue": f"WITH {_E} SELECT count(*) AS entries, count(DISTINCT entry_id) AS ids, count(DISTINCT path) AS paths, count(*) = count(DISTINCT entry_id) AS valid FROM e",
    "ordered_range_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400 ORDER BY o_orderkey",
    "unix_modes": "SELECT CAST(l_partkey % 512 AS INTEGER) AS mode, CAST(l_partkey % 512 AS INTEGER) AS back, (l_partkey % 512) & 256 <> 0 AS owner_read, (l_partkey % 512) & 2 <> 0 AS other_write, (l_linenumber + l_suppkey % 16) & 5 <> 0 AS flagged, count(*) AS n FROM lineitem GROUP BY ALL",
    "find_block": f"WITH {_E}, l AS (SELECT entry_id, original_size, CAST(sum(original_size) OVER (ORDER BY entry_id) - original_size AS BIGINT) AS o FROM e) SELECT o_orderkey, o_orderkey * 137 AS at, entry_id AS block_id, o_orderkey * 137 - o AS within FROM orders JOIN l ON o_orderkey * 137 >= o AND o_orderkey * 137 < o + original_size",
    "read_spans": f"WITH {_E} SELECT entry_id, CASE WHEN original_size >= 164 THEN lower(substr(hex(content), 201, 128)) END AS span, CASE WHEN original_size < 164 THEN 'InvalidOffset' END AS error FROM e",
    "fixed_chunks": f"WITH {_E}, {_CHUNKS.format(1024)} SELECT * FROM ch",
    "chunk_dedup_ratio": f"WITH {_E}, {_CHUNKS.format(256)}, u AS (SELECT sha256, max(chunk_size) AS s, count(*) AS n FROM ch GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * s) AS BIGINT) AS logical_bytes, CAST(sum(s) AS BIGINT) AS stored_bytes, round(sum(s) / sum(n * s), 6) AS dedup_ratio FROM u",
    "unique_chunks": f"WITH {_E}, {_CHUNKS.format(1024)} SELECT sha256, max(chunk_size) AS chunk_size, count(*) AS ref_count, min(entry_id) AS first_entry FROM ch GROUP BY 1",
    "missing_chunks": f"""WITH {_E}, {_CHUNKS.format(64)}, e2 AS (SELECT item_id AS entry_id, text AS content, strlen(text) AS s FROM benchmark),
        c2 AS (SELECT entry_id, CAST(i AS INTEGER) AS ordinal, sha256(unhex(substr(hex(content), CAST(i * 128 + 1 AS BIGINT), 128))) AS sha256 FROM (SELECT *, unnest(range(0, CAST((s + 63) // 64 AS BIGINT))) AS i FROM e2))
        SELECT sha256, entry_id, ordinal FROM c2 WHERE sha256 NOT IN (SELECT sha256 FROM ch)""",
    "register_chunks": f"WITH {_E}, {_CHUNKS.format(1024)}, x AS (SELECT sha256, chunk_size FROM ch UNION ALL SELECT sha256(text), CAST(strlen(text) AS BIGINT) FROM benchmark WHERE strlen(text) BETWEEN 1 AND 1024) SELECT sha256, max(chunk_size) AS chunk_size FROM x GROUP BY 1",
    "cdc_chunks": f"WITH {_E} SELECT entry_id, original_size AS bytes, true AS starts, true AS bounded, true AS dense FROM e WHERE original_size > 0",
    "exact_duplicates": f"WITH {_E} SELECT sha256, count(*) AS copies, min(entry_id) AS first_entry, (count(*) - 1) * max(original_size) AS wasted_bytes FROM e GROUP BY 1 HAVING count(*) > 1",
    "integrity_check": f"WITH {_E} SELECT count(*) AS entries, count(*) FILTER (entry_id % 9 <> 0) AS intact, count(*) FILTER (entry_id % 9 = 0) AS damaged FROM e",
    "hex_digests": f"WITH {_E} SELECT entry_id, sha256(path || content) AS digest, true AS round_trip FROM e",
    "byte_entropy": f"WITH {_E}, {_ENT} SELECT * FROM en",
    "entropy_classes": f"WITH {_E}, {_ENT} SELECT class, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM en GROUP BY 1",
    "entropy_bar": f"""WITH {_E}, {_ENT}, o AS (SELECT *, row_number() OVER (ORDER BY entry_id) - 1 AS ordinal, count(*) OVER () AS n FROM en), c AS (SELECT unnest(range(0, 40)) AS c)
        SELECT string_agg(CASE class WHEN 'ZeroFilled' THEN '.' WHEN 'LowEntropyText' THEN 'T' WHEN 'StructuredBinary' THEN 'B' WHEN 'HighEntropyCompressed' THEN 'C' ELSE 'E' END, '' ORDER BY c) AS bar FROM c JOIN o ON ordinal = c * n // 40""",
    "fragmentation": """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 1000 + l_partkey % 300 AS BIGINT) AS o, CAST(l_quantity * 20 AS BIGINT) AS s FROM lineitem),
        g AS (SELECT *, lag(o + s) OVER (PARTITION BY l_orderkey ORDER BY o, s) AS x FROM b),
        a AS (SELECT l_orderkey, CAST(sum(greatest(coalesce(o - x, 0), 0)) AS BIGINT) AS gaps, max(o + s) - min(o) AS span, count(*) AS blocks FROM g GROUP BY 1)
        SELECT *, round(CASE WHEN blocks <= 1 OR span <= 0 THEN 0e0 ELSE least(1e0, gaps / span) END, 6) AS fragmentation FROM a""",
    "fragmentation_total": f"""WITH {_E}, w AS (SELECT *, original_size + CASE WHEN entry_id % 4 = 0 THEN 512 ELSE 0 END AS v FROM e), b AS (SELECT entry_id, CAST(sum(v) OVER (ORDER BY entry_id) - v AS BIGINT) AS o, original_size AS s FROM w),
        g AS (SELECT *, lag(o + s) OVER (ORDER BY entry_id) AS x FROM b), a AS (SELECT CAST(sum(greatest(coalesce(o - x, 0), 0)) AS BIGINT) AS gaps, max(o + s) - min(o) AS span, count(*) AS blocks FROM g)
        SELECT *, round(CASE WHEN blocks <= 1 OR span <= 0 THEN 0e0 ELSE least(1e0, gaps / span) END, 6) AS fragmentation FROM a""",
    "storage_summary": f"""WITH {_E}, {_CHUNKS.format(1024)}, u AS (SELECT max(chunk_size) AS s, count(*) AS n FROM ch GROUP BY sha256), a AS (SELECT CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(n * s) AS BIGINT) AS logical_bytes, CAST(sum(s) AS BIGINT) AS stored_bytes FROM u),
        h AS (SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events)
        SELECT *, round(logical_bytes / stored_bytes, 6) AS compression_ratio, round((1 - stored_bytes / logical_bytes) * 100, 6) AS savings_percent, round(CASE WHEN hits + misses = 0 THEN 0e0 ELSE hits / (hits + misses) END, 6) AS hit_ratio FROM a, h""",
    "inspect_archive": f"WITH {_E}, {_ENT} SELECT en.*, e.path, CAST(sum(e.original_size) OVER (ORDER BY e.entry_id) - e.original_size AS BIGINT) AS \"offset\" FROM en JOIN e USING (entry_id)",
    "tier_statistics": "SELECT CASE WHEN o_orderstatus = 'O' THEN 'HotMemory' ELSE 'ColdDisk' END AS tier, count(*) AS blocks, CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes FROM orders GROUP BY 1",
    "formatted_sizes": """WITH s AS (SELECT p_partkey, CAST(floor(pow(3e0, p_partkey % 27)) AS BIGINT) + 1 AS size, least(greatest((p_size - 5) / 40e0, 0e0), 1e0) AS f FROM part)
        SELECT p_partkey, size, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024e0) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576e0)
          WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824e0) ELSE printf('%.2f TB', size / 1099511627776e0) END AS formatted,
          '[' || rpad(repeat('=', CAST(floor(f * 20 + 0.5e0) AS INTEGER)), 20, '-') || '] ' || printf('%.1f%%', f * 100) AS bar FROM s""",
    "json_report": f"WITH {_E}, s AS (SELECT {_PARENT.format(_PARENT.format('path'))} AS archive, count(*) AS entries, CAST(sum(original_size) AS BIGINT) AS bytes FROM e GROUP BY 1) SELECT '{{\"archive\":\"' || archive || '\",\"entries\":' || entries || ',\"bytes\":' || bytes || '}}' AS report FROM s",
    "snapshot_delta": f"WITH {_E}, {_N} SELECT path, action, coalesce(old_size, -1) AS old_size, coalesce(new_size, -1) AS new_size, CASE action WHEN 'Added' THEN array_to_string(g_blocks, ',') WHEN 'Modified' THEN array_to_string(list_filter(g_blocks, lambda x: NOT list_contains(old_blocks, x)), ',') ELSE '' END AS new_blocks FROM d",
    "delta_summary": f"""WITH {_E}, {_N} SELECT count(*) FILTER (action = 'Added') AS added, count(*) FILTER (action = 'Modified') AS modified, count(*) FILTER (action = 'Deleted') AS deleted,
        CAST(sum(CASE action WHEN 'Added' THEN new_size WHEN 'Modified' THEN greatest(new_size - old_size, 0) ELSE 0 END) AS BIGINT) AS added_bytes, CAST(sum(CASE action WHEN 'Deleted' THEN old_size WHEN 'Modified' THEN greatest(old_size - new_size, 0) ELSE 0 END) AS BIGINT) AS deleted_bytes FROM d""",
    "reused_blocks": f"WITH {_E}, {_N}, r AS (SELECT path, list_filter(g_blocks, lambda x: list_contains(old_blocks, x)) AS l FROM d WHERE action = 'Modified') SELECT path, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ordinal, unnest(l) AS block_id FROM r",
    "apply_patch": f"WITH {_E}, {_N} SELECT path, entry_id, size, checksum, array_to_string(block_ids, ',') AS block_ids FROM g",
    "latest_manifest": "SELECT CAST(conv_id AS VARCHAR) AS path, CAST(arg_max(strlen(text), turn) AS BIGINT) AS size, max(turn) AS turn FROM conversations GROUP BY 1",
    "manifest_stats": f"WITH {_E}, {_N} SELECT count(*) AS nodes, CAST(sum(size) AS BIGINT) AS total_size FROM g",
    "journal_analyze": f"""WITH {_INC}, a AS (SELECT count(*) AS entries, count(*) FILTER (type = 'BeginCheckpoint') AS begins, count(*) FILTER (type = 'EndCheckpoint') AS ends, count(*) FILTER (type = 'Commit') AS commits, count(*) FILTER (type = 'Abort') AS aborts, count(*) FILTER (type NOT IN ('BeginCheckpoint', 'EndCheckpoint')) AS replayed FROM j)
        SELECT *, (SELECT count(*) FROM i) AS skipped, entries = 0 OR (begins = ends AND commits + aborts > 0) AS success, CAST(CASE WHEN entries = 0 THEN 0 ELSE entries // 10000 + 1 END AS BIGINT) AS estimated_seconds FROM a""",
    "journal_incomplete": f"WITH {_INC} SELECT * FROM i",
    "journal_replay": f"WITH {_R} SELECT seq, type, applied FROM r",
    "journal_committed_only": f"WITH {_R} SELECT seq, type, entry_id FROM r WHERE applied AND nxt = 'Commit'",
    "replayed_state": f"WITH {_R} SELECT entry_id, max(seq) AS last_seq, count(*) AS operations, arg_max(type, seq) AS last_type FROM r WHERE applied GROUP BY 1",
    "journal_status": f"WITH {_J} SELECT max(seq) AS current_sequence, arg_max(type, seq) FILTER (type IN {_M}) AS last_marker, arg_max(type, seq) FILTER (type IN {_M}) IN ('BeginCheckpoint', 'Abort') AS needs_recovery FROM j",
    "journal_invalid_begins": f"WITH {_J}, m AS (SELECT *, lag(type) OVER (ORDER BY seq) AS before FROM j WHERE type IN {_M}) SELECT seq FROM m WHERE type = 'BeginCheckpoint' AND before = 'BeginCheckpoint'",
    "journal_positions": f"WITH {_J} SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS position FROM j WHERE type <> 'CreateEntry'",
    "journal_verify": f"WITH {_J} SELECT count(*) AS entries, count(*) FILTER (seq % 100 = 0) AS damaged FROM j",
    "stream_replay": f"""WITH {_J}, l AS (SELECT *, entry_id % 50 AS log FROM j), s AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY seq) - 1 AS q, last_value(CASE WHEN type IN {_M} THEN type END IGNORE NULLS) OVER (PARTITION BY log ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM l)
        SELECT log, count(*) AS applied, max(q) AS last_seq FROM s WHERE mark = 'BeginCheckpoint' AND type NOT IN {_M} GROUP BY 1""",
    "windowed_event_counts": "WITH w AS (SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM w GROUP BY 1",
    "metadata_merge": "WITH s AS (SELECT event_id, event_type, user_id, coalesce(json_extract_string(props, '$.k'), '-') AS k FROM events) SELECT event_id, 'k=' || k || ';type=' || event_type || ';user=' || user_id AS merged, k, CAST(NULL AS VARCHAR) AS none, 3 AS n FROM s",
    "metadata_edit": "SELECT event_id, '=e;type=x' AS edited, false AS valid, true AS own_valid, true AS has_user FROM events",
    "tag_operations": """WITH d AS (SELECT doc_id, [lang, source, lang] AS t FROM documents) SELECT doc_id, array_to_string(CASE WHEN list_contains(t, 'en') THEN t ELSE list_append(t, 'en') END, ',') AS added,
        array_to_string(CASE WHEN list_contains(t, 'en') THEN t[2:] ELSE t END, ',') AS removed, list_contains(t, 'src1') AS has FROM d""",
    "zigzag_varints": """WITH v AS (SELECT o_orderkey, CAST((o_orderkey - 7500) * CAST(pow(10e0, o_orderkey % 12) AS BIGINT) AS BIGINT) AS value FROM orders)
        SELECT o_orderkey, value, CASE WHEN value >= 0 THEN 2 * value ELSE -2 * value - 1 END AS zigzag, value AS back, CAST(greatest(1, ceil(length(ltrim(bin(abs(value)), '0')) / 7e0)) AS INTEGER) AS bytes FROM v""",
    "varint_roundtrip": f"""WITH v AS (SELECT l_orderkey, l_partkey * 1000003 AS x FROM lineitem), h AS (SELECT *, {_varint('x')} AS h FROM v)
        SELECT l_orderkey, string_agg(h, '' ORDER BY x) AS raw, arg_min(h, x) AS first, CAST(sum(x) AS BIGINT) AS total, min(x) AS first_value, CAST(length(arg_min(h, x)) // 2 AS INTEGER) AS first_size FROM h GROUP BY 1""",
    "compressed_blocks": f"""WITH {_E}, b AS (SELECT entry_id, unnest(range(0, CAST((original_size + 511) // 512 AS BIGINT))) AS i, original_size AS n FROM e), c AS (SELECT entry_id, least(512, n - i * 512) AS s FROM b)
        SELECT c.entry_id, count(*) AS blocks, CAST(sum(s + (s >> 8) + ((131072 - s) >> 11)) AS BIGINT) AS bound, true AS within, any_value(e.sha256) AS sha256, CAST(NULL AS VARCHAR) AS error FROM c JOIN e USING (entry_id) GROUP BY 1""",
    "size_bounds": """WITH s AS (SELECT p_partkey, CAST(floor(pow(3e0, p_partkey % 19)) AS BIGINT) AS size FROM part)
        SELECT *, size AS none, size + size // 255 + 16 AS lz4, size + size // 4096 + size // 16384 + size // 33554432 + 13 AS zlib, size + size // 256 + CASE WHEN size < 131072 THEN (131072 - size) // 2048 ELSE 0 END AS zstd FROM s""",
    "block_frames": f"""WITH {_E}, h AS (SELECT *, printf('%016x', original_size) AS x FROM e), p AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: substr(x, 15 - 2 * CAST(i AS BIGINT), 2)), '') AS le FROM h)
        SELECT entry_id, '4e42' || le || le || '00000000000000' AS header, entry_id % 4 = 0 OR (entry_id % 4 = 2 AND original_size > 0) AS is_frame,
          CASE entry_id % 4 WHEN 1 THEN 'invalid block sync' WHEN 2 THEN CASE WHEN original_size > 0 THEN 'block data truncated' ELSE 'block header truncated' END WHEN 3 THEN 'block header truncated' END AS error,
          CASE WHEN entry_id % 4 = 0 THEN original_size END AS original_size, CASE WHEN entry_id % 4 = 0 THEN 'none' END AS algorithm, CASE WHEN entry_id % 4 = 0 THEN sha256 END AS sha256 FROM p""",
    "block_store": f"""WITH {_E}, v AS (SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 'v2:' || content ELSE content END AS c, entry_id % 7 = 0 AS gone FROM e)
        SELECT entry_id AS block_id, CASE WHEN NOT gone THEN CAST(strlen(c) AS BIGINT) END AS size, CASE WHEN NOT gone THEN sha256(c) END AS sha256, CASE WHEN gone THEN 'NotFound' END AS error FROM v
        UNION ALL SELECT -entry_id - 1, NULL, NULL, 'NotFound' FROM e WHERE entry_id % 50 = 0""",
    "journal_payloads": f"WITH {_PAY} SELECT seq, type, raw, CASE WHEN type IN ('CreateEntry', 'UpdateEntry', 'DeleteEntry') THEN entry_id END AS entry_id, CASE WHEN type IN ('CreateEntry', 'UpdateEntry') THEN coalesce(data, '') END AS data FROM y",
    "journal_written": f"""WITH {_J}, q AS (SELECT seq AS request, CASE WHEN type = 'Commit' AND seq % 5 = 0 THEN 'EndCheckpoint' ELSE type END AS type FROM j),
        o AS (SELECT *, coalesce(last_value(CASE WHEN type IN {_M} THEN type END IGNORE NULLS) OVER (ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'BeginCheckpoint', false) AS open FROM q),
        r AS (SELECT *, CASE WHEN (type = 'BeginCheckpoint' AND open) OR (type = 'EndCheckpoint' AND NOT open) THEN 'InvalidOperation' END AS error FROM o),
        x AS (SELECT *, unnest(CASE WHEN type = 'Commit' AND open THEN ['EndCheckpoint', 'Commit'] ELSE [type] END) AS t, generate_subscripts(CASE WHEN type = 'Commit' AND open THEN ['EndCheckpoint', 'Commit'] ELSE [type] END, 1) AS k FROM r)
        SELECT request, CASE WHEN error IS NULL THEN CAST(count(*) FILTER (error IS NULL) OVER (ORDER BY request, k ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) END AS seq, t AS type, error FROM x""",
    "journal_recovery": f"""WITH {_REC}, s AS (SELECT unnest(['Automatic', 'BestEffort', 'Manual']) AS strategy), u AS (SELECT strategy, n - failed AS replayed, c + CASE WHEN strategy = 'BestEffort' THEN failed ELSE 0 END AS skipped, CASE WHEN strategy = 'BestEffort' THEN 0 ELSE failed END AS corrupt FROM s, z, o)
        SELECT *, true AS success, strategy = 'Automatic' AS cleared, 'Recovery complete: ' || replayed || ' replayed, ' || skipped || ' skipped, ' || corrupt || ' corrupt' AS summary FROM u""",
    "journal_recovery_errors": f"WITH {_R} SELECT seq, type FROM r WHERE applied AND seq % 13 = 0",
    "snapshot_catalog": f"""WITH {_E}, {_N} SELECT * FROM (SELECT 1 AS snapshot_id, 0 AS parent_id, 'base' AS label, false AS current, count(*) AS nodes, CAST(sum(size) AS BIGINT) AS total_size FROM b
        UNION ALL SELECT 10, 1, 'reconstructed_snap_10', true, count(*), CAST(sum(size) AS BIGINT) FROM g UNION ALL SELECT 11, 1, 'again', false, count(*), CAST(sum(size) AS BIGINT) FROM b)""",
    "scalar_encodings": """SELECT event_id, lower(hex(event_type[3:5] || '-' || event_type)) AS joined, CASE WHEN event_id * 1000000007::HUGEINT * 9000000000::HUGEINT <= 9223372036854775807 THEN CAST(event_id * 1000000007::HUGEINT * 9000000000::HUGEINT AS BIGINT) END AS size,
        epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) % 1000000 * 1000 AS nanos, true AS same, user_id % 3 < 1 OR (user_id % 3 = 1 AND event_id < 500) AS before FROM events""",
    "compress_roundtrip": f"WITH {_E} SELECT entry_id, sha256 AS none, sha256 AS lz4, sha256 AS zlib, sha256 AS zstd FROM e",
    "aes_roundtrip": f"WITH {_E} SELECT entry_id, sha256 AS opened_sha256, original_size + 28 AS sealed_size, sha256(path)[1:24] AS iv, CAST(NULL AS VARCHAR) AS wrong_key_sha256 FROM e",
}

_D = f"""{SQL['fragmentation_total'].replace('SELECT *, round', 'SELECT round').replace('WITH ', '', 1)}"""
_STATS = f"""WITH fr AS (WITH {_D}), en AS (SELECT * FROM ({SQL['entropy_bar']})), di AS (SELECT * FROM ({SQL['chunk_dedup_ratio'].replace('256', '1024').replace('sha1024', 'sha256')})),
    dd AS (SELECT count(*) AS entries, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS raw FROM documents),
    ev AS (SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS pending FROM events),
    v AS (SELECT entries, raw, stored_bytes AS packed, unique_chunks AS blocks, round(raw / stored_bytes, 6) AS ratio, round(CASE WHEN raw >= stored_bytes THEN (1 - stored_bytes / raw) * 100 ELSE 0 END, 6) AS saved, fr.fragmentation AS frag, hits, misses, round(hits / (hits + misses), 6) AS hit, done, pending, bar FROM dd, di, ev, fr, en)"""
_RULE = "repeat('=', 80) || chr(10)"
SQL["dashboard_text"] = f"""{_STATS} SELECT {_RULE} || '  Inspection Dashboard | Target: documents' || chr(10) || {_RULE} || chr(10) || '--- Storage & Compression Metrics ---' || chr(10)
    || {_LINE.format('Total Entries', 'entries', 24)} || {_LINE.format('Uncompressed Size', _BYTES.format('raw'), 24)} || {_LINE.format('Compressed Size', _BYTES.format('packed'), 24)} || {_LINE.format('Compression Ratio', "printf('%.2f:1', ratio)", 24)}
    || {_LINE.format('Space Savings', "printf('%.1f%%', saved)", 24)} || {_LINE.format('Savings Gauge', _BAR.format('(saved / 100e0)'), 24)} || {_LINE.format('Active Blocks', 'blocks', 24)} || {_LINE.format('Fragmentation Index', "printf('%.4f', frag)", 24)}
    || chr(10) || '--- Cache Subsystem ---' || chr(10) || {_LINE.format('Cache Hits', 'hits', 24)} || {_LINE.format('Cache Misses', 'misses', 24)} || {_LINE.format('Hit Ratio Gauge', _BAR.format('hit'), 24)}
    || chr(10) || '--- Archive Block Entropy Heatmap ---' || chr(10) || '  [' || bar || ']' || chr(10) || '  Legend: [.] Zero  [T] Text  [B] Binary  [C] Compressed  [E] Encrypted' || chr(10)
    || chr(10) || '--- Journal & Transaction State ---' || chr(10) || {_LINE.format('Committed Transactions', 'done', 26)} || {_LINE.format('Pending Transactions', 'pending', 26)}
    || {_LINE.format('Journal Status', "CASE WHEN pending > 0 THEN 'WAL DIRTY / ROLL-FORWARD READY' ELSE 'CLEAN / SYNCHRONIZED' END", 26)} || chr(10) || {_RULE} AS report FROM v"""
SQL["dashboard_json"] = f"""{_STATS} SELECT '{{"archive":"documents","metrics":{{"totalEntries":' || entries || ',"uncompressedBytes":' || raw || ',"compressedBytes":' || packed || ',"compressionRatio":' || printf('%.4f', ratio) || ',"spaceSavingsPercent":' || printf('%.2f', saved)
    || ',"activeBlocks":' || blocks || ',"fragmentationIndex":' || printf('%.4f', frag) || ',"cacheHits":' || hits || ',"cacheMisses":' || misses || ',"cacheHitRatio":' || printf('%.4f', hit) || ',"journalCommittedTx":' || done || ',"journalPendingTx":' || pending
    || '}},"entropySamplesCount":' || entries || '}}' AS report FROM v"""
