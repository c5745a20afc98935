"""SQL of the operators on repeated strings, for DuckDB; both build every window, so they suit small tables."""

SQL = {
    "op4_suffix_dedup": r"""
        WITH b AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        win AS (SELECT doc_id, unnest(range(0, n - 399)) AS a, unnest(list_transform(range(0, n - 399), lambda a: md5(substr(h, 2 * a + 1, 800)))) AS k
                FROM b WHERE n >= 400),
        rep AS (SELECT doc_id, a FROM (SELECT doc_id, a, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
        marked AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 400 THEN 0 ELSE 1 END AS first FROM rep),
        numbered AS (SELECT doc_id, a, sum(first) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM marked),
        spans AS (SELECT doc_id, span, min(a) AS s, max(a) + 400 AS e FROM numbered GROUP BY doc_id, span),
        cut AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before, e FROM spans),
        parts AS (SELECT b.doc_id, any_value(n) AS n, any_value(h) AS h, sum(e - s) AS removed, count(s) AS k, max(e) AS last,
                         string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head
                  FROM b LEFT JOIN cut ON cut.doc_id = b.doc_id GROUP BY b.doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, k::BIGINT AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM parts""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS a,
                       unnest(list_transform(range(1, len(ws) - 18), lambda a: array_to_string(ws[a:a + 19], ' '))) AS k
                FROM w WHERE len(ws) >= 20),
        later AS (SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS p FROM later),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}
