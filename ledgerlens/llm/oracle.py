"""DuckDB SQL of the queries that SQL can express; the others are tested
against brute-force versions."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: crc32 of the decimal conv_id before its last xor, bit by bit
_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
        "lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: xor(v >> 1, (v & 1) * 3988292384)))")

SQL = {
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE {_USABLE}),
u AS (SELECT vec_id, e, list_dot_product(e, e) AS s FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      AND list_dot_product(a.e, b.e) / sqrt(a.s * b.s) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.node = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.node""",
    "op5_line_dedup": f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> h.holder, false) AS lost FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op9_top_k_search": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE {_USABLE}),
p AS (SELECT a.vec_id AS query_id, b.vec_id,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p) WHERE place <= 5""",
    "op11_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (d)""",
    "op12_prefix_trie": f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS source, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN o ON o.conv_id = c.source WHERE pos < h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE pos >= h),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, pos) AS turns FROM r GROUP BY conv_id),
s AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM s),
n AS (SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ended FROM p GROUP BY ALL),
k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(prefix[depth].text, '[ \\t-\\r]+'), lambda w: w <> '')) END AS saved
      FROM n LEFT JOIN k USING (prefix)),
a AS (SELECT prefix, saved, CAST(n_children = 0 AS BIGINT) AS leaf, unnest(range(depth + 1)) AS up FROM m),
t AS (SELECT prefix[1:up] AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ended, '')) AS ends_sha256
FROM m JOIN t USING (prefix) LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.prefix = m.prefix[1:m.depth - 1]""",
}
