"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import align, decontam, html_text, language, licenses, packing, quality, rules, secret_scan, simhash, tokens, trie, urls

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_url_filters": urls.op4_url_filters,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_secret_scans": secret_scan.op9_secret_scans,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_language_id": language.op11_language_id,
    "op12_cross_tokenizer_alignment": align.op12_cross_tokenizer_alignment,
    "op13_conversation_prefix_trie": trie.op13_conversation_prefix_trie,
}

#: Windows of ten words, by equality of the whole window.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM iw),
dw AS (
  SELECT doc_id, p, l, array_to_string(w[p : p + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens WHERE len(w) >= l)),
m AS (SELECT doc_id, p, dw.l AS l, item_id FROM dw JOIN iw USING (win) WHERE dw.l = iw.l),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM m)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

URL_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT n, rh || rp AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
    FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""

#: The polynomial of CRC-32, bit by bit; nodes are named by the digests of their turns, joined.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, md5(length(r) || ':' || r || x) AS k, strlen(x) AS nb, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(length(r) || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: list_prepend(ascii(s)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
b AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(o.n, 0)) AS head, least(c.h, coalesce(o.n, 0)) + greatest(c.n - c.h, 0) AS d FROM c LEFT JOIN c o ON o.conv_id = c.base),
r AS (
  SELECT b.conv_id, d, pos AS i, k, nb FROM b JOIN t ON t.conv_id = b.base AND pos <= h
  UNION ALL SELECT b.conv_id, d, pos - h + head, k, nb FROM b JOIN t ON t.conv_id = b.conv_id AND pos > h
  UNION ALL SELECT conv_id, d, 0, '', 0 FROM b),
p AS (SELECT conv_id, d, i, nb, list(k) OVER (PARTITION BY conv_id ORDER BY i) AS ks FROM r),
x AS (SELECT conv_id, d, i, nb, array_to_string(ks, '') AS id, array_to_string(ks[: -2], '') AS up FROM p),
m AS (
  SELECT id, i AS depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(nb) AS nb,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = i), '')) AS ends_sha256 FROM x GROUP BY ALL),
k AS (SELECT up, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY up),
v AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k ON k.up = m.id),
s AS (
  SELECT a.id, a.depth, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.nb) AS saved_tokens
  FROM v JOIN x ON x.conv_id = v.conv_id AND x.i <= v.depth JOIN m a ON a.id = x.id AND a.depth = x.i GROUP BY ALL)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.id = v.id AND s.depth = v.depth LEFT JOIN v u ON v.depth > 0 AND u.id = v.up AND u.depth = v.depth - 1
"""

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": URL_SQL,
    "op6_benchmark_decontamination": DECONTAMINATION_SQL,
    "op11_language_id": language.op11_language_id,
    "op12_cross_tokenizer_alignment": align.op12_cross_tokenizer_alignment,
    "op13_conversation_prefix_trie": TRIE_SQL,
}
