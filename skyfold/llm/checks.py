"""SQL that says the same as the queries, where it can: plain, over whole tables and texts."""

from __future__ import annotations

from skyfold.llm.exact_dedup import LOWER, UPPER

_WORDS = r"'[^\x20\x09-\x0D]+'"
_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

CHECKS: dict[str, str] = {
    "op4_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) ws FROM documents),
 wi AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws)-19)) i FROM w)),
 rp AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) rn FROM wi) WHERE rn > 1),
 cv AS (SELECT DISTINCT doc_id, i + j p FROM rp, range(20) r(j)),
 kp AS (SELECT a.doc_id, a.p, a.word, cv.p IS NOT NULL gone FROM (SELECT doc_id, unnest(generate_series(1, len(ws))) p, unnest(ws) word FROM w) a LEFT JOIN cv ON cv.doc_id = a.doc_id AND cv.p = a.p),
 ag AS (SELECT doc_id, count(*) FILTER (gone) n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') kept FROM kp GROUP BY 1)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN ag USING (doc_id)""",
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_WORDS}) ws FROM documents),
 sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+3], ' ') END s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws)-3, 1))) i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
 pr AS (SELECT a.doc_id a, b.doc_id b, count(*) both_have FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 ln AS MATERIALIZED (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
 te AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
 lab AS (WITH RECURSIVE cc(d, c) USING KEY (d) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, min(x.c) FROM cc x JOIN te e ON e.a = x.d JOIN recurring.cc r ON r.d = e.b WHERE x.c < r.c GROUP BY e.b) SELECT * FROM cc)
 SELECT w.doc_id, coalesce(n.n, 0) n_shingles, lab.c component_id FROM w LEFT JOIN n USING (doc_id) JOIN lab ON lab.d = w.doc_id""",
    "op10_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER g keep_id, count(*) OVER g group_size, doc_id = max(doc_id) OVER g kept, sha256(t) text_sha256
 FROM (SELECT doc_id, {_FOLDED} t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op12_suffix_dedup": """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n FROM documents),
 wi AS (SELECT doc_id, i, md5(substr(h, 2*i-1, 800)) k FROM (SELECT doc_id, h, unnest(generate_series(1, n-399)) i FROM b)),
 rp AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) c FROM wi) WHERE c > 1),
 st AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END new FROM rp),
 isl AS (SELECT doc_id, min(i) s, max(i) + 399 e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) g FROM st) GROUP BY doc_id, g),
 pc AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 a, s - 1 z FROM isl UNION ALL SELECT b.doc_id, coalesce(max(e), 0) + 1, any_value(n) FROM b LEFT JOIN isl USING (doc_id) GROUP BY b.doc_id),
 kp AS (SELECT doc_id, string_agg(substr(h, 2*a-1, 2*(z-a+1)), '' ORDER BY a) FILTER (z >= a) kept FROM pc JOIN b USING (doc_id) GROUP BY 1),
 ct AS (SELECT doc_id, CAST(sum(e-s+1) AS BIGINT) n_removed, count(*) n_spans FROM isl GROUP BY 1)
 SELECT b.doc_id, CAST(n AS BIGINT) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 FROM b LEFT JOIN kp USING (doc_id) LEFT JOIN ct USING (doc_id)""",
    "op13_conversation_trie": """WITH RECURSIVE cb(i, k, v) AS (SELECT i, 0, i FROM range(256) q(i) UNION ALL SELECT i, k+1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM cb WHERE k < 8),
 ct AS MATERIALIZED (SELECT i, v FROM cb WHERE k = 8), ids AS (SELECT DISTINCT conv_id c FROM conversations WHERE conv_id IS NOT NULL),
 cr(c, s, j, crc) AS (SELECT c, CAST(c AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM ids UNION ALL SELECT c, s, j+1, xor(crc >> 8, v) FROM cr JOIN ct ON i = xor(crc, CAST(ascii(substr(s, j, 1)) AS BIGINT)) & 255 WHERE j <= length(s)),
 hd AS MATERIALIZED (SELECT c, c - c%5 o, xor(crc, 4294967295) % 9 h FROM cr WHERE j > length(s)),
 rk AS MATERIALIZED (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 r, coalesce(role, '') role, coalesce(text, '') t FROM conversations WHERE conv_id IS NOT NULL),
 tk AS (SELECT hd.c, r + 1 d, role, t FROM hd JOIN rk ON rk.c = hd.o AND r < h), nb AS (SELECT c, count(*) n FROM tk GROUP BY 1),
 rb AS (SELECT * FROM tk UNION ALL SELECT hd.c, r - h + coalesce(nb.n, 0) + 1, role, t FROM hd JOIN rk ON rk.c = hd.c AND r >= h LEFT JOIN nb ON nb.c = hd.c),
 pre AS MATERIALIZED (SELECT c, d, md5(string_agg(md5(length(role) || ':' || role || t), '') OVER (PARTITION BY c ORDER BY d)) k, octet_length(encode(t)) b FROM rb UNION ALL SELECT c, 0, '', 0 FROM ids),
 ln AS (SELECT c, max(d) m FROM pre GROUP BY 1),
 nd AS MATERIALIZED (SELECT d, k, count(*) n, min(c) least, max(b) b, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = m), '') ends FROM pre JOIN ln USING (c) GROUP BY 1, 2),
 pa AS MATERIALIZED (SELECT nd.d, nd.k, p.k pk, q.least up FROM nd JOIN pre p ON p.c = nd.least AND p.d = nd.d - 1 JOIN nd q ON q.d = p.d AND q.k = p.k),
 ch AS (SELECT d - 1 d, pk k, count(*) n_children FROM pa GROUP BY 1, 2),
 nc AS MATERIALIZED (SELECT nd.*, coalesce(n_children, 0) n_children FROM nd LEFT JOIN ch USING (d, k)),
 su AS (SELECT a.d, a.k, sum((x.n - 1) * x.b) saved, count(*) FILTER (x.n_children = 0) leaves FROM nc x JOIN pre a ON a.c = x.least AND a.d <= x.d GROUP BY 1, 2)
 SELECT nc.least conv_id, CAST(nc.d AS BIGINT) AS "depth", up parent_conv_id, nc.n n_convs, nc.n_children, leaves n_leaves, CAST(saved AS BIGINT) saved_tokens, sha256(nc.ends) ends_sha256 FROM nc JOIN su USING (d, k) LEFT JOIN pa USING (d, k)""",
}
