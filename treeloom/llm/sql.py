"""DuckDB SQL of the queries that SQL can express over whole tables.

The others are compared with brute-force versions in the tests: sharding (iterative), extraction (a
parser), the ledger (positions of regular expressions), packing (a tokenizer), the classifier and
banded alignment have no SQL here."""

WORDS = r"[^\x20\x09-\x0D]+"

#: Words by document; {text} is an expression over documents.
NUMBERED = """words AS (SELECT doc_id, regexp_extract_all({text}, '""" + WORDS + """') AS w FROM documents),
windows AS (SELECT doc_id, w, len(w) AS n, CAST(unnest(range(1, len(w) - {width} + 2)) AS BIGINT) AS p FROM words),
grams AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + {width} - 1), ' ') AS g FROM windows)"""

SQL: dict[str, str] = {
    "op4_minhash_bayes": "WITH RECURSIVE "
    + NUMBERED.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", width=4)
    + """, sets AS (SELECT DISTINCT doc_id, g FROM grams UNION SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.c, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.c, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)""",
    "op8_count_min": "WITH "
    + NUMBERED.format(text="coalesce(text, '')", width=13)
    + """, firsts AS (SELECT g, min(doc_id) AS lo FROM grams GROUP BY g),
starts AS (SELECT doc_id, list(p) AS starts FROM grams JOIN firsts USING (g) WHERE doc_id > lo GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM starts)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM words w LEFT JOIN kept k USING (doc_id)""",
    # runs of three lines, and of fewer that hold 13 words; each but its first place goes, and blank lines within
    "op9_winnowed_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM l),
n AS (SELECT doc_id, ord, s, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn, greatest(len(regexp_extract_all(s, '""" + WORDS + """')), strlen(s) // 8) AS size FROM t WHERE s <> ''),
a AS (SELECT *, lead(s) OVER w AS s2, lead(s, 2) OVER w AS s3, lead(size) OVER w AS size2 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY rn)),
runs AS (SELECT doc_id, rn, 1 AS k, s AS x FROM a WHERE size >= 13 UNION ALL SELECT doc_id, rn, 2, s || chr(10) || s2 FROM a WHERE s2 IS NOT NULL AND size + size2 >= 13
  UNION ALL SELECT doc_id, rn, 3, s || chr(10) || s2 || chr(10) || s3 FROM a WHERE s3 IS NOT NULL),
later AS (SELECT doc_id, rn, k FROM runs QUALIFY row_number() OVER (PARTITION BY k, x ORDER BY doc_id, rn) > 1),
gone AS (SELECT DISTINCT doc_id, rn FROM (SELECT doc_id, unnest(range(rn, rn + k)) AS rn FROM later)),
marked AS (SELECT n.doc_id, n.ord, g.rn IS NOT NULL AS gone FROM n LEFT JOIN gone g USING (doc_id, rn)),
each AS (SELECT t.doc_id, t.ord, t.line, m.gone AS own, last_value(m.gone IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY t.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
  first_value(m.gone IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY t.ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM t LEFT JOIN marked m USING (doc_id, ord)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM each WHERE NOT coalesce(own, coalesce(before, false) AND coalesce(behind, false)) GROUP BY doc_id),
empty AS (SELECT doc_id FROM marked GROUP BY doc_id HAVING bool_and(gone))
SELECT d.doc_id, k.text FROM documents d LEFT JOIN kept k USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM empty)""",
    "op10_no_random_access": """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
