"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from treeloom.plans.catalog import NOW, RATIO
from treeloom.plans.store import THRESHOLD


def key(otype: int, length: str, body: str) -> str:
    """A key in hex with SHA-256 as the digest."""
    digits = f"printf('%x', CAST({length} AS BIGINT))"
    even = f"(CASE WHEN length({digits}) % 2 = 1 THEN '0' ELSE '' END || {digits})"
    size = f"(length({even}) // 2)"
    return f"(printf('%02x', CAST({otype} * 16 + {size} - 1 AS INTEGER)) || {even} || substr(sha256({body}), 1, CAST(2 * (31 - {size}) AS INTEGER)))"


FILES = f"files AS (SELECT doc_id, source, lang, CAST(doc_id AS VARCHAR) AS name, CAST(strlen(text) AS BIGINT) AS size, {key(0, 'strlen(text)', 'text')} AS key FROM documents)"
SPLIT = "split AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents)"
LINES = f"{SPLIT}, lines AS (SELECT doc_id, ord, line, CAST(strlen(line) AS BIGINT) AS size, {key(0, 'strlen(line)', 'line')} AS key FROM split)"
NODE = key(1, "length", "body")
LEAF = key(2, "strlen(body) + below", "body")
TREE = f"""{LINES},
node0 AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS length, string_agg(key, ',' ORDER BY ord) AS body FROM lines GROUP BY doc_id),
nodes AS (SELECT doc_id, {NODE} AS key, length FROM node0),
tfiles AS (SELECT d.doc_id, d.source, d.lang, CAST(d.doc_id AS VARCHAR) AS name, n.key, n.length FROM documents d JOIN nodes n USING (doc_id)),
lang0 AS (SELECT source, lang, CAST(sum(length) AS BIGINT) AS below, string_agg(name || '=' || key, ',' ORDER BY name) AS body FROM tfiles GROUP BY ALL),
langs AS (SELECT source, lang, {LEAF} AS key, CAST(strlen(body) + below AS BIGINT) AS length FROM lang0),
source0 AS (SELECT source, CAST(sum(length) AS BIGINT) AS below, string_agg(lang || '=' || key, ',' ORDER BY lang) AS body FROM langs GROUP BY ALL),
sources AS (SELECT source, {LEAF} AS key, CAST(strlen(body) + below AS BIGINT) AS length FROM source0),
root0 AS (SELECT CAST(sum(length) AS BIGINT) AS below, string_agg(source || '=' || key, ',' ORDER BY source) AS body FROM sources),
root AS (SELECT {LEAF} AS key FROM root0),
edges AS (SELECT l.key AS parent, f.key AS child FROM tfiles f JOIN langs l USING (source, lang)
  UNION SELECT s.key, l.key FROM langs l JOIN sources s USING (source)
  UNION SELECT r.key, s.key FROM sources s, root r
  UNION SELECT n.key, l.key FROM lines l JOIN nodes n USING (doc_id)),
two AS (SELECT key FROM sources WHERE source IN ('src1', 'src2'))"""
INDEX = f"""{FILES},
firsts AS (SELECT key, min(doc_id) AS ord, max(size) AS slen, row_number() OVER (ORDER BY min(doc_id)) AS rn FROM files GROUP BY key),
fold AS (SELECT CAST(1 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS segment_id, CAST(0 AS INTEGER) AS pos, CAST(8 AS BIGINT) AS off
  UNION ALL SELECT f.rn + 1, CASE WHEN f.off + 46 + x.slen >= {THRESHOLD} THEN f.segment_id + 1 ELSE f.segment_id END,
    CASE WHEN f.off + 46 + x.slen >= {THRESHOLD} THEN 0 ELSE f.pos + 1 END, CASE WHEN f.off + 46 + x.slen >= {THRESHOLD} THEN 8 ELSE f.off + 46 + x.slen END
  FROM fold f JOIN firsts x ON x.rn = f.rn),
idx AS (SELECT x.ord, x.key, x.slen, f.segment_id, f.pos, f.off FROM firsts x JOIN fold f USING (rn)),
segs0 AS (SELECT segment_id, CAST(sum(slen + 46) + 8 AS BIGINT) AS body_bytes, count(*) AS keys FROM idx GROUP BY ALL),
segs AS (SELECT segment_id, segment_id < (SELECT max(segment_id) FROM segs0) AS sealed, body_bytes, keys, CAST(body_bytes + keys * 44 AS BIGINT) AS file_bytes FROM segs0),
live AS (SELECT DISTINCT key FROM files WHERE doc_id % 2 = 0),
scored AS (SELECT i.segment_id, count(l.key) AS live_keys, count(*) - count(l.key) AS dead_keys,
  CAST(coalesce(sum(CASE WHEN l.key IS NOT NULL THEN slen + 46 END), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(CASE WHEN l.key IS NULL THEN slen + 46 END), 0) AS BIGINT) AS dead_bytes
  FROM idx i LEFT JOIN live l USING (key) GROUP BY ALL),
victims AS (SELECT s.* FROM scored s JOIN segs g USING (segment_id) WHERE g.sealed AND dead_keys > 0 AND dead_bytes >= {RATIO} * (live_bytes + dead_bytes)),
copied AS (SELECT i.key, i.segment_id, i.off, i.slen FROM idx i JOIN victims USING (segment_id) JOIN live USING (key))"""


def runs(items: str, sequence: str, order: str) -> str:
    """Runs over items(sequence, order, hit): MinRun 2, MaxRun 32."""
    return f"""{items}, numbered AS (SELECT {sequence}, {order}, hit, row_number() OVER (PARTITION BY {sequence} ORDER BY {order}) AS rn FROM items),
folded AS (SELECT {sequence}, {order}, rn, CAST(0 AS BIGINT) AS run, 1 AS n, hit FROM numbered WHERE rn = 1
  UNION ALL SELECT x.{sequence}, x.{order}, x.rn, CASE WHEN f.n >= 32 OR f.n >= 2 AND f.hit THEN f.run + 1 ELSE f.run END,
    CASE WHEN f.n >= 32 OR f.n >= 2 AND f.hit THEN 1 ELSE f.n + 1 END, x.hit
  FROM folded f JOIN numbered x ON x.{sequence} = f.{sequence} AND x.rn = f.rn + 1)"""


HIT = "substr(sha256({}), 2, 1) IN ('0', '8')"
LINE_ITEMS = f"{SPLIT}, items AS (SELECT doc_id, ord, {HIT.format('line')} AS hit FROM split)"
DIR_ITEMS = f"items AS (SELECT source || '/' || lang AS dir, CAST(doc_id AS VARCHAR) AS name, {HIT.format('CAST(doc_id AS VARCHAR)')} AS hit FROM documents)"
LEAVES = runs(DIR_ITEMS, "dir", "name") + ", leaves0 AS (SELECT dir, run, max(name) AS hi, count(*) AS n FROM folded GROUP BY ALL), leaves AS (SELECT *, lag(hi) OVER (PARTITION BY dir ORDER BY run) AS lo FROM leaves0)"
CURRENT = f"""log AS (SELECT event_id AS seq, ts, event_type || '/' || CAST(user_id % 20 AS VARCHAR) AS name, CAST(user_id AS VARCHAR) AS "user", event_type = 'error' AS gone, {key(0, 'event_id', 'CAST(event_id AS VARCHAR)')} AS key FROM events),
current AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) = 1), standing AS (SELECT * FROM current WHERE NOT gone)"""
SIZES = "sizes AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * l_orderkey * l_partkey * l_linenumber AS BIGINT) AS n FROM lineitem)"
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def scaled(digits: int, least: float) -> str:
    cases = " ".join(f"WHEN n >= {least!r} * power(1024.0, {p - 1}) THEN printf('%.{digits}f {UNITS[p - 1]}', n / power(1024.0, {p}))" for p in range(6, 0, -1))
    return f"CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' {cases} END"


def human(n: str) -> str:
    """One decimal, promoted at 1023.95."""
    return HUMAN1.replace("n /", f"{n} /").replace("n <", f"{n} <").replace("CAST(n", f"CAST({n}")


def clock(s: str) -> str:
    return f"CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END"


HUMAN1 = "CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' " + " ".join(f"WHEN n / power(1024.0, {p}) < 1023.95 THEN printf('%.1f {UNITS[p - 1]}', n / power(1024.0, {p}))" for p in range(1, 6)) + " ELSE printf('%.1f EiB', n / power(1024.0, 6)) END"
MTIME = "CASE WHEN t > now OR t < now - INTERVAL 6 MONTH THEN strftime(t, '%b') || ' ' || lpad(CAST(day(t) AS VARCHAR), 2, ' ') || '  ' || strftime(t, '%Y') ELSE strftime(t, '%b') || ' ' || lpad(CAST(day(t) AS VARCHAR), 2, ' ') || ' ' || strftime(t, '%H:%M') END"


def triple(shift: int, special: int, letter: str) -> str:
    return f"CASE WHEN m & {4 << shift} <> 0 THEN 'r' ELSE '-' END || CASE WHEN m & {2 << shift} <> 0 THEN 'w' ELSE '-' END || CASE WHEN m & {special} <> 0 THEN CASE WHEN m & {1 << shift} <> 0 THEN '{letter}' ELSE '{letter.upper()}' END WHEN m & {1 << shift} <> 0 THEN 'x' ELSE '-' END"


MODE = f"CASE m & {0o170000} WHEN {0o100000} THEN '-' WHEN {0o040000} THEN 'd' WHEN {0o120000} THEN 'l' WHEN {0o060000} THEN 'b' WHEN {0o020000} THEN 'c' WHEN {0o010000} THEN 'p' WHEN {0o140000} THEN 's' ELSE '?' END || {triple(6, 0o4000, 's')} || {triple(3, 0o2000, 's')} || {triple(0, 0o1000, 't')}"
REACH = "reach AS (SELECT key, 0 AS depth FROM two UNION SELECT e.child, r.depth + 1 FROM reach r JOIN edges e ON e.parent = r.key)"


def verdict(at_sign: bool) -> str:
    return f"CASE WHEN strlen(n) = 0 THEN 'empty' WHEN strlen(n) > 1024 THEN 'too long' {'' if at_sign else chr(39).join(['WHEN contains(n, ', '@', ') THEN ', 'at sign', ' '])} WHEN regexp_matches(n, '[\\x00-\\x1f\\x7f]') THEN 'control character' ELSE 'ok' END"


SQL = {
    "dedup_by_directory": f"WITH {FILES}, k AS (SELECT '/' || source || '/' || lang AS path, key, count(*) AS n, max(size) AS size FROM files GROUP BY ALL) SELECT path, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(n * size) AS BIGINT) AS bytes, count(*) AS unique_blobs, CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(size) AS DOUBLE) / CAST(sum(n * size) AS DOUBLE) AS dedup_ratio FROM k GROUP BY path",
    "key_build": f"WITH {FILES} SELECT doc_id, key FROM files",
    "key_fields": f"WITH {FILES}, h AS (SELECT doc_id, key, size, CAST(('0x' || substr(key, 2, 1)) AS INTEGER) % 8 + 1 AS ls FROM files) SELECT doc_id, 0 AS otype, 'Blob' AS type_name, CAST(ls AS INTEGER) AS length_size, size AS length, substr(key, 3 + 2 * ls) AS hash FROM h",
    "key_validate": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'length' WHEN 1 THEN 'reserved bit' WHEN 2 THEN 'reserved type' WHEN 3 THEN 'non-canonical length' ELSE 'ok' END AS verdict FROM nation",
    "blob_dedup_stats": f"WITH {FILES}, s AS (SELECT DISTINCT key FROM files WHERE doc_id % 7 = 0), k AS (SELECT key, count(*) AS n, max(size) AS u FROM files GROUP BY key) SELECT count(*) FILTER (s.key IS NULL) AS stored, CAST(sum(n) - count(*) FILTER (s.key IS NULL) AS BIGINT) AS deduped, CAST(sum(u) FILTER (s.key IS NULL) AS BIGINT) AS bytes_stored FROM k LEFT JOIN s USING (key)",
    "chunk_dedup_stats": f"WITH {LINES}, k AS (SELECT key, count(*) AS n, max(size) AS u FROM lines GROUP BY key) SELECT count(*) AS stored, CAST(sum(n) - count(*) AS BIGINT) AS deduped, CAST(sum(u) AS BIGINT) AS bytes_stored FROM k",
    "missing_keys_ordered": f"WITH {FILES} SELECT doc_id AS ord, key FROM files WHERE key NOT IN (SELECT f.key FROM files f JOIN labels USING (doc_id))",
    "has_semi": f"WITH {FILES} SELECT doc_id FROM files WHERE key IN (SELECT f.key FROM files f JOIN labels USING (doc_id))",
    "has_outside_segment": f"WITH RECURSIVE {INDEX} SELECT doc_id FROM files WHERE key IN (SELECT key FROM idx WHERE segment_id <> 0)",
    "dir_listing": f"WITH {FILES} SELECT source, lang, name, size, key FROM files",
    "built_dir_listing": f"WITH {FILES} SELECT source, lang, name, size, key FROM files",
    "dir_page_after": f"WITH {FILES} SELECT name, size FROM files WHERE source = 'src0' AND lang = 'en' AND name > '3' ORDER BY name LIMIT 10",
    "dir_page_more_flag": f"WITH {FILES}, d AS (SELECT name FROM files WHERE source = 'src0' AND lang = 'en') SELECT name, (SELECT count(*) FROM d) > 5 AS more FROM d ORDER BY name LIMIT 5",
    "lookup_entry": f"WITH {FILES} SELECT name, size, key FROM files JOIN labels USING (doc_id) WHERE source = 'src1' AND lang = 'en'",
    "separator_range_lookup": f"WITH RECURSIVE {LEAVES} SELECT f.dir, f.name, f.run FROM folded f WHERE f.name IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
    "resolve_paths": f"WITH {TREE} SELECT doc_id AS id, CASE WHEN doc_id % 5 <= 1 THEN key END AS key, CASE doc_id % 5 WHEN 2 THEN 'not found' WHEN 3 THEN 'invalid path' WHEN 4 THEN 'not a directory' END AS error FROM tfiles",
    "parse_spec": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'ref' ELSE 'key' END AS kind, CASE WHEN o_orderkey % 4 < 2 THEN 'n' || CAST(o_orderkey % 13 AS VARCHAR) ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS name, CASE o_orderkey % 4 WHEN 1 THEN 'a/b@c' WHEN 3 THEN 'x/y' ELSE '' END AS path FROM orders",
    "dir_footprint_rollup": f"WITH {FILES} SELECT CASE WHEN grouping(source) = 1 THEN '/' WHEN grouping(lang) = 1 THEN '/' || source ELSE '/' || source || '/' || lang END AS path, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM files GROUP BY ROLLUP (source, lang)",
    "file_size_from_key": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents",
    "tree_edges": f"WITH {TREE} SELECT parent, child FROM edges",
    "reachable_from_refs": f"WITH RECURSIVE {TREE}, {REACH} SELECT key, min(depth) AS depth FROM reach GROUP BY key",
    "check_complete_missing": f"WITH RECURSIVE {TREE}, stored AS (SELECT child AS key FROM edges WHERE substr(child, 64, 1) <> '0' UNION SELECT key FROM two), held AS (SELECT * FROM edges WHERE parent IN (SELECT key FROM stored)), r AS (SELECT key FROM two UNION SELECT e.child FROM r JOIN held e ON e.parent = r.key) SELECT key FROM r WHERE key NOT IN (SELECT key FROM stored)",
    "why_key": f"WITH RECURSIVE {TREE}, up AS (SELECT key FROM lines WHERE doc_id = 1 UNION SELECT e.parent FROM up JOIN edges e ON e.child = up.key) SELECT 'ref/' || source AS name FROM sources WHERE key IN (SELECT key FROM up)",
    "unreferenced_objects": f"WITH RECURSIVE {TREE}, {REACH} SELECT DISTINCT child AS key FROM edges WHERE child NOT IN (SELECT key FROM reach)",
    "live_union_grey": f"WITH {FILES} SELECT DISTINCT key FROM files WHERE doc_id % 2 = 0 OR doc_id % 9 = 1",
    "export_manifest": f"WITH {FILES} SELECT DISTINCT source || '/' AS path, CAST(0 AS BIGINT) AS size, {0o755} AS mode, 'dir' AS kind FROM files UNION ALL SELECT DISTINCT source || '/' || lang || '/', 0, {0o755}, 'dir' FROM files UNION ALL SELECT source || '/' || lang || '/' || name, size, CASE WHEN doc_id % 2 = 0 THEN {0o644} ELSE {0o600} END, 'file' FROM files",
    "file_content_concat": "SELECT doc_id, sha256(coalesce(text, '')) AS sha, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents",
    "store_readback": f"WITH t AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents) SELECT {key(0, 'strlen(t)', 't')} AS key, CAST(strlen(t) AS BIGINT) AS ulen, true AS sound, sha256(t) AS sha FROM t",
    "scrub_faults": "SELECT doc_id, 'record checksum' AS why FROM documents WHERE doc_id % 13 = 0",
    "reference_roundtrip": f'WITH {CURRENT} SELECT seq, name, "user", key, true AS same, true AS unsigned FROM log',
    "staged_header_roundtrip": "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, 'conv/' || CAST(conv_id AS VARCHAR) AS ref, CAST(turn AS BIGINT) AS at, true AS same, coalesce(role, '') AS role FROM conversations",
    "refs_latest_wins": f'WITH {CURRENT} SELECT name, seq, "user", key FROM standing',
    "refs_list_lines": f"WITH {CURRENT} SELECT name, name || ' ' || key || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || CASE WHEN \"user\" <> '' THEN ' ' || \"user\" ELSE '' END AS line FROM standing",
    "ref_name_validation": f"WITH x AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN c_name || '@x' WHEN 2 THEN c_name || chr(7) WHEN 3 THEN repeat(c_name, 100) WHEN 4 THEN 'a//' || c_name ELSE c_name END AS n FROM customer) SELECT c_custkey, {verdict(False)} AS as_name, {verdict(True)} AS as_user FROM x",
    "segment_assignment": f"WITH RECURSIVE {INDEX} SELECT ord, key, segment_id, pos, off FROM idx",
    "segment_liveness": f"WITH RECURSIVE {INDEX} SELECT segment_id, live_keys, dead_keys, live_bytes, dead_bytes FROM scored",
    "gc_status": f"WITH RECURSIVE {INDEX} SELECT segment_id, body_bytes, keys, live_keys, CAST(dead_bytes AS DOUBLE) / CAST(live_bytes + dead_bytes AS DOUBLE) AS garbage FROM segs JOIN scored USING (segment_id) WHERE sealed",
    "gc_victims": f"WITH RECURSIVE {INDEX} SELECT segment_id, dead_keys, dead_bytes FROM victims",
    "gc_copy_set": f"WITH RECURSIVE {INDEX} SELECT key, segment_id, off, slen FROM copied",
    "gc_cycle_stats": f"WITH RECURSIVE {INDEX} SELECT (SELECT count(*) FROM segs WHERE sealed) AS scanned, (SELECT count(*) FROM victims) AS compacted, (SELECT CAST(coalesce(sum(file_bytes), 0) AS BIGINT) FROM segs JOIN victims USING (segment_id)) AS freed_bytes, (SELECT count(*) FROM copied) AS copied_records, (SELECT CAST(coalesce(sum(slen + 46), 0) AS BIGINT) FROM copied) AS copied_bytes",
    "index_order": f"WITH {FILES} SELECT DISTINCT key, CAST('0x' || substr(key, 63, 2) AS INTEGER) AS last_byte FROM files",
    "index_fanout": f"WITH {FILES}, b AS (SELECT DISTINCT key, CAST('0x' || substr(key, 63, 2) AS INTEGER) AS last_byte FROM files) SELECT CAST(r.range AS INTEGER) AS last_byte, (SELECT count(*) FROM b WHERE b.last_byte <= r.range) AS entries FROM range(256) r",
    "sort_by_location": f"WITH RECURSIVE {INDEX} SELECT f.doc_id AS ord, f.key, i.segment_id, i.off FROM files f LEFT JOIN (SELECT * FROM idx WHERE segment_id < 5) i USING (key)",
    "stored_size": f"WITH RECURSIVE {INDEX} SELECT f.doc_id AS ord, i.slen FROM files f LEFT JOIN (SELECT * FROM idx WHERE segment_id < 5) i USING (key)",
    "item_runs": f"WITH RECURSIVE {runs(LINE_ITEMS, 'doc_id', 'ord')} SELECT doc_id, ord, run FROM folded",
    "dir_leaf_runs": f"WITH RECURSIVE {LEAVES} SELECT dir, run, hi, n FROM leaves",
    "index_levels": f"""WITH RECURSIVE {LEAVES}, up0 AS (SELECT dir, run AS leaf, {HIT.format('hi')} AS hit, run + 1 AS rn FROM leaves),
up AS (SELECT dir, rn, CAST(0 AS BIGINT) AS run, 1 AS n, hit FROM up0 WHERE rn = 1 UNION ALL SELECT x.dir, x.rn, CASE WHEN f.n >= 32 OR f.n >= 2 AND f.hit THEN f.run + 1 ELSE f.run END, CASE WHEN f.n >= 32 OR f.n >= 2 AND f.hit THEN 1 ELSE f.n + 1 END, x.hit FROM up f JOIN up0 x ON x.dir = f.dir AND x.rn = f.rn + 1)
SELECT dir, count(*) AS leaves, max(run) + 1 AS nodes FROM up GROUP BY dir""",
    "ignore_filter": f"WITH {FILES} SELECT doc_id, source || '/' || lang || '/' || name AS path FROM files WHERE NOT CASE WHEN lang = 'fr' THEN true WHEN source = 'src1' THEN false ELSE name LIKE '%9' END",
    "scan_totals": f"WITH {FILES} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files WHERE doc_id % 10 <> 0",
    "mode_string": f"WITH x AS (SELECT o_orderkey, CAST(list_extract([{0o100000}, {0o040000}, {0o120000}, {0o060000}, {0o020000}, {0o010000}, {0o140000}, 0], CAST(o_orderkey % 8 + 1 AS BIGINT)) + (o_orderkey * 7) % 4096 AS BIGINT) AS m FROM orders) SELECT o_orderkey, {MODE} AS mode FROM x",
    "human_bytes": f"WITH {SIZES} SELECT l_orderkey, l_linenumber, {HUMAN1} AS shown FROM sizes",
    "human_bytes2": f"WITH {SIZES} SELECT l_orderkey, l_linenumber, {scaled(2, 1024.0)} AS shown FROM sizes",
    "format_duration": "WITH x AS (SELECT o_orderkey, greatest(CAST(round(o_totalprice - 1000) AS BIGINT), 0) AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS shown FROM x",
    "format_mtime": f"WITH x AS (SELECT o_orderkey, o_orderdate AS t, TIMESTAMP '1998-01-15 12:00:00' AS now FROM orders) SELECT o_orderkey, {MTIME} AS shown FROM x",
    "progress_bar": "WITH x AS (SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest(l_quantity * 2.5 - 10, 0.0), 100.0) / 100 * 20) AS INTEGER) AS f FROM lineitem) SELECT l_orderkey, l_linenumber, '[' || repeat(chr(9608), f) || repeat(chr(9617), 20 - f) || ']' AS bar FROM x",
    "listing_lines": f"WITH {FILES}, x AS (SELECT name, CAST(doc_id % 1200 AS VARCHAR) AS uid, CAST(size AS VARCHAR) AS size, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1690000000 + doc_id * 40000) AS t, TIMESTAMP '{NOW}' AS now FROM files) SELECT name, '-rw-r--r-- ' || lpad(uid, (SELECT max(length(uid)) FROM x)::INTEGER, ' ') || ' 100 ' || lpad(size, (SELECT max(length(size)) FROM x)::INTEGER, ' ') || ' ' || {MTIME} || ' ' || name AS line FROM x",
    "percentile_element": "SELECT l_returnflag, list_extract(list_sort(list(l_extendedprice)), CAST(1 + least(count(*) - 1, floor(count(*) * 0.5)) AS BIGINT)) AS p50, list_extract(list_sort(list(l_extendedprice)), CAST(1 + least(count(*) - 1, floor(count(*) * 0.95)) AS BIGINT)) AS p95 FROM lineitem GROUP BY l_returnflag",
    "bench_windows": 'SELECT CAST(o_orderkey // 100 AS BIGINT) AS "window", count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1',
    "bench_classes": "SELECT o_orderkey % 10 < 3 AS kept, count(*) AS refs, CAST(sum(CASE WHEN o_orderkey % 10 < 3 THEN 100 ELSE 30 END) AS BIGINT) AS mib FROM orders GROUP BY 1",
    "throttle_owed": "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey * 1000003 AS n, l_suppkey + 1000 AS r FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(n // r * 1000000000 + (n % r) * 1000000000 // r AS BIGINT) AS ns FROM x",
    "unsafe_names": "SELECT p_partkey, p_partkey % 5 <= 1 AS entry, p_partkey % 7 <= 1 AS path FROM part",
    "inbox_pending": "SELECT conv_id % 10 AS root, count(DISTINCT conv_id) AS pending FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1",
    "length_audit": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS told, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents WHERE doc_id % 11 = 0",
    "record_roundtrip": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS ulen, true AS same, sha256(coalesce(text, '')) AS sha FROM documents",
    "pack_stream": f"WITH t AS (SELECT coalesce(text, '') AS t FROM documents) SELECT {key(0, 'strlen(t)', 't')} AS key, CAST(strlen(t) AS BIGINT) AS ulen, sha256(t) AS sha, CAST(NULL AS VARCHAR) AS error FROM t",
    "cdc_reassembled": "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha, true AS within FROM pages WHERE strlen(html) > 0",
    "cbor_dirleaf_roundtrip": f"WITH {FILES} SELECT CAST(doc_id // 8 AS BIGINT) AS leaf, CAST(sum(size) AS BIGINT) AS below, true AS same, string_agg(name || '=' || key, ',' ORDER BY name) AS entries FROM files GROUP BY 1",
    "inbox_stream": "SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, CASE WHEN conv_id % 10 = 3 THEN 0 ELSE count(*) END AS objects, CASE WHEN conv_id % 10 = 3 THEN 'truncated before the end marker' END AS error FROM conversations GROUP BY conv_id",
    "progress_lines": f"""WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey * 3000 AS BIGINT) AS d, CAST(30000000 AS BIGINT) AS t, o_orderkey / 8.0 AS s FROM orders),
y AS (SELECT *, CASE WHEN s > 0 THEN d / s ELSE 0.0 END AS rate, least(d / t * 100, 100.0) AS pct, CAST(round(s) AS BIGINT) AS e FROM x),
z AS (SELECT *, CAST(floor((t - d) / nullif(rate, 0)) AS BIGINT) AS l FROM y)
SELECT k AS o_orderkey, 'ingest ' || printf('%5.1f', pct) || '% [' || repeat(chr(9608), CAST(trunc(pct / 100 * 16) AS INTEGER)) || repeat(chr(9617), 16 - CAST(trunc(pct / 100 * 16) AS INTEGER)) || ']  ' || {human('d')} || '/' || {human('t')} || '  ' || {human('CAST(floor(rate) AS BIGINT)')} || '/s  elapsed ' || {clock('e')}
 || '  eta ' || CASE WHEN d > 0 AND d < t AND rate > 0 THEN {clock('l')} ELSE '--:--' END || '  files ' || CAST(k AS VARCHAR) || '/10000' || CASE WHEN d >= t THEN '  finalizing' || chr(8230) ELSE '' END AS line FROM z""",
}
