"""SQL for DuckDB that gives the rows of the numbered queries that SQL can express, by plain listing of all windows or pairs."""

from __future__ import annotations

from . import conversation_repair, mixing, spelling_groups

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD, _BLANK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
ok AS MATERIALIZED (SELECT * FROM v WHERE len(x) > 0 AND NOT list_contains(list_transform(x, lambda c: c IS NULL OR NOT isfinite(c)), true) AND list_contains(list_transform(x, lambda c: c <> 0), true)),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS root FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
t AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark),
i AS (SELECT item_id, least(13, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda p: array_to_string(ws[p : p + least(13, len(ws)) - 1], ' '))) AS k FROM t WHERE len(ws) > 0),
l AS (SELECT DISTINCT n FROM i),
w AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p : p + n - 1], ' '))) AS k FROM d, l WHERE len(ws) >= n),
m AS MATERIALIZED (SELECT doc_id, w.n, p, k FROM w SEMI JOIN i ON w.n = i.n AND w.k = i.k),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT m.doc_id, i.item_id::VARCHAR AS item FROM m JOIN i ON m.n = i.n AND m.k = i.k) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p : p + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, list(doc_id) AS ids FROM s GROUP BY g HAVING count(*) > 1),
o AS MATERIALIZED (SELECT doc_id, g FROM s SEMI JOIN f USING (g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
r AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id"""

SUFFIXES = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(range(0, length(x) // 2 - 199)) AS p, unnest(list_transform(range(0, length(x) // 2 - 199), lambda p: hash(substr(x, 2 * p + 1, 400)))) AS k FROM d WHERE length(x) >= 400),
m AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
b AS (SELECT *, CASE WHEN p - lag(p) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b),
s AS (SELECT doc_id, g, min(p) AS lo, max(p) + 200 AS hi FROM g GROUP BY ALL),
k AS (SELECT s.doc_id, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) || any_value(substr(x, 2 * last + 1)) AS kept, count(*) AS n_spans, sum(hi - lo) AS n_removed
  FROM (SELECT *, coalesce(lag(hi) OVER o, 0) AS prev, max(hi) OVER (PARTITION BY doc_id) AS last FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY lo)) s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

RECOMPRESSION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, unnest(list_transform(range(1, len(ws) - 11), lambda p: array_to_string(ws[p : p + 12], ' '))) AS k FROM d WHERE len(ws) >= 13),
m AS (SELECT w.doc_id, p FROM w JOIN (SELECT k, min(doc_id) AS first FROM w GROUP BY k) USING (k) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM m),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": EMBEDDINGS,
    "op2_decontaminate": DECONTAMINATION,
    "op5_jaccard_join": JACCARD,
    "op7_suffix_dedup": SUFFIXES,
    "op8_mix": mixing.ORACLE,
    "op9_recompression_dedup": RECOMPRESSION,
    "op11_spelling_groups": spelling_groups.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
}
