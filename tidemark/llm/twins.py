"""SQL twins, for DuckDB, of the registered queries on manifests and spelling variants."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase


def crc32(data: str) -> str:
    """SQL for the CRC-32 of a list of bytes: each byte is mixed in, then eight shifts follow."""
    steps = f"flatten(list_transform({data}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295], {steps}), lambda c, e:
        CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


def utf8_bytes(text: str) -> str:
    """SQL for the UTF-8 bytes of a text, not empty, of code points up to U+07FF."""
    return f"""flatten(list_transform(string_split({text}, ''), lambda x: CASE
        WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
        ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))"""


def leaf(text: str) -> str:
    fields = (f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in fields)})"


def side(name: str, keys: str, rows: str) -> str:
    """SQL for the digests of a node's run before or after it."""
    return f"""coalesce(string_agg(hash, '') OVER (
        PARTITION BY {keys}, pos // 8 ORDER BY pos ROWS BETWEEN {rows}), '') AS {name}"""


BEFORE, AFTER = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
LOWER = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"

OP11_SQL = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, lang, {leaf('text')} AS leaf,
           CASE WHEN {crc32(utf8_bytes('doc_id::VARCHAR'))} % 3 = 0 THEN {leaf(LOWER)} ELSE {leaf('text')} END AS current
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM rows
), nodes AS (  -- n is the number of nodes of the level
    SELECT lang, 0 AS level, pos, leaf AS hash, n FROM leaves
    UNION ALL
    SELECT lang, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8
    FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n
), subroots AS (
    SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS langs
    FROM nodes WHERE n = 1
), upper_nodes AS (
    SELECT 0 AS level, place AS pos, subroot AS hash, langs AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8
    FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 8, n
), sides AS (
    SELECT lang, level, pos, n, {side('l', 'lang, level', BEFORE)}, {side('r', 'lang, level', AFTER)} FROM nodes
), upper_sides AS (
    SELECT level, pos, n, {side('l', 'level', BEFORE)}, {side('r', 'level', AFTER)} FROM upper_nodes
), walk AS (  -- each leaf on its way up: through its language's tree, then through that of the languages
    SELECT lang, pos AS leaf_pos, false AS upper, 0 AS level, pos, current AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT w.lang, w.leaf_pos, x.upper, x.level, x.pos, x.node, x.proof
    FROM walk w
    LEFT JOIN sides s ON NOT w.upper AND s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.pos = w.pos
    LEFT JOIN subroots b ON NOT w.upper AND b.lang IS NOT DISTINCT FROM w.lang
    LEFT JOIN upper_sides u ON w.upper AND u.level = w.level AND u.pos = w.pos,
    LATERAL (
        SELECT w.upper OR s.n = 1 AS upper,
               CASE WHEN NOT w.upper AND s.n = 1 THEN 0 ELSE w.level + 1 END AS level,
               CASE WHEN NOT w.upper AND s.n = 1 THEN b.place ELSE w.pos // 8 END AS pos,
               CASE WHEN w.upper THEN sha256(u.l || w.node || u.r) WHEN s.n = 1 THEN w.node
                    ELSE sha256(s.l || w.node || s.r) END AS node,
               CASE WHEN w.upper THEN w.proof || u.l || u.r WHEN s.n = 1 THEN w.proof
                    ELSE w.proof || s.l || s.r END AS proof
    ) x
    WHERE NOT w.upper OR u.n > 1
)
SELECT v.doc_id, v.leaf, b.subroot, t.hash AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root,
       w.node = t.hash AS verified
FROM leaves v
JOIN subroots b ON b.lang IS NOT DISTINCT FROM v.lang
JOIN upper_nodes t ON t.n = 1
JOIN walk w ON w.lang IS NOT DISTINCT FROM v.lang AND w.leaf_pos = v.pos AND w.upper AND w.level = t.level
"""

# Words are near if one is the other without a letter, or both are equal but for the letter at one place.
OP13_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), hashed AS (
    SELECT run, c, {crc32(utf8_bytes("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h
    FROM (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL)
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word,
           sum(c)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
), cut AS (
    SELECT word, n, p, word[: p - 1] || word[p + 1 :] AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), shorter AS (
    SELECT DISTINCT c.word AS a, c.n AS a_n, w.word AS b, w.n AS b_n FROM cut c JOIN words w ON w.word = c.rest
), near AS (
    SELECT a, a_n, b, b_n FROM shorter
    UNION ALL SELECT b, b_n, a, a_n FROM shorter
    UNION ALL SELECT DISTINCT x.word, x.n, y.word, y.n FROM cut x JOIN cut y ON x.p = y.p AND x.rest = y.rest AND x.word <> y.word
), best AS (
    SELECT a AS word, count(*) AS n_near, first(b ORDER BY b_n DESC, b) AS form, max(b_n) AS form_n FROM near GROUP BY a
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
           CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL
    SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.*, c.at AS root
FROM formed f JOIN chain c USING (word) JOIN formed l ON l.word = c.at AND l.form IS NULL
"""
