"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


_ALNUM = _words("text", "[0-9a-z\\x{80}-\\x{10FFFF}]+")
_SPACE = _words("text", "[^ \\t\\n\\v\\f\\r]+")

SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
own AS (SELECT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS t FROM (SELECT *, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM own),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m),
found AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS t FROM places),
hits AS (SELECT doc_id, k, own.m, item_id FROM found JOIN own USING (t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT doc_id, k, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items x USING (doc_id)
""",
    "op7_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m, d.doc_id), d.doc_id) AS component_id, coalesce(least(m, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
""",
    "op9_suffix_array": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS INT), 200) AS t FROM (SELECT *, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
firsts AS (SELECT t, min((doc_id, p)) AS f, count(*) AS n FROM windows GROUP BY t HAVING count(*) > 1),
again AS (SELECT doc_id, p FROM windows JOIN firsts USING (t) WHERE (doc_id, p) <> f),
starts AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * from_ + 1 AS INT), CAST(2 * (coalesce(to_, length(h) // 2) - from_) AS INT)), '' ORDER BY from_) AS k FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS r FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(r, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
""",
}
