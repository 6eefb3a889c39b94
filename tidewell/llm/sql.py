"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({lowered("text")}, '{TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all({lowered("text")}, '{TERM}')) AS term FROM benchmark),
r AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
f AS (SELECT item_id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
      FROM r JOIN p USING (term) JOIN w USING (term) JOIN n ON n.doc_id = p.doc_id, s GROUP BY item_id, p.doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""


def components(words: int, kept: bool) -> str:
    """Components of documents whose sets of shingles of so many words have a Jaccard similarity of 0.8 or more."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([{joined} FOR i IN range(1, len(w) - {words - 2})]) END AS s FROM t),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS k, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
e AS (SELECT k, n, unnest(s) AS x FROM c),
l AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
y AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a),
m AS (SELECT a AS k, min(b) AS least FROM r GROUP BY a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(m.least, g.doc_id) AS component_id{", g.doc_id = coalesce(m.least, g.doc_id) AS kept" if kept else ""}
FROM g LEFT JOIN c ON len(g.s) > 0 AND list_sort(g.s) = c.s LEFT JOIN m ON m.k = c.k
"""


PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lowered("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten([[w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)] FOR k IN [1, 2, 3, 4]])) AS w FROM w),
f AS (SELECT lang, w, count(*) AS f FROM g GROUP BY lang, w),
c AS (SELECT lang, w, f AS a FROM f WHERE f >= 30 AND len(w) > 1),
k AS (SELECT c.lang, c.w, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:]),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest(flatten([[w[i:i + m - 1] FOR i IN range(1, len(w) - m + 2)] FOR m IN range(2, len(w))])) AS part FROM c) GROUP BY lang, part),
o AS (SELECT s.*, array_to_string(s.w, ' ') AS phrase FROM s LEFT JOIN i ON i.lang = s.lang AND i.part = s.w WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""


ORACLE_SQL: dict[str, str] = {
    "op8_jaccard_components": components(5, False),
    "op11_phrases": PHRASES,
    "op12_bottomk_components": components(4, True),
    "op13_ranked_search": RANKED,
}
