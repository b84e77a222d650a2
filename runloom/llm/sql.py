"""The queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from runloom.llm import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def quoted(texts: list[str]) -> str:
    return ", ".join("'" + text.replace("'", "''") + "'" for text in texts)


ORACLE: dict[str, str] = {}

ORACLE["op4_top_k"] = """
WITH sound AS (
    SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(coalesce(list_sum([coalesce(p[1] * p[2], 0) FOR p IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5
"""

ORACLE["op2_ngram_join"] = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 75 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))
), reach AS (
    SELECT x AS doc_id, x AS other FROM links
    UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM words LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Each five hex digits are four characters.
_QUADS = " || ".join(
    f"substr('{BASE32}', (('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {shift}) % 32 + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
ORACLE["op6_warc"] = f"""
WITH payloads AS (
    SELECT page_id, url, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), newest AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM payloads)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_QUADS} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, url
FROM newest
"""

ORACLE["op8_quality_rules"] = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{WORD}')] AS lines
    FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS times FROM (
        SELECT doc_id, unnest(range(len(w) - 2)) AS i, unnest([x[1] || ' ' || x[2] || ' ' || x[3] FOR x IN list_zip(w, w[2:], w[3:])][:-3]) AS three
        FROM texts WHERE len(w) >= 3)
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(3) o(k) WHERE times > 1 GROUP BY doc_id
), line_rules AS (
    SELECT doc_id, sum(chars) AS chars, sum(chars) FILTER (NOT fails AND NOT contains(substr(digits, line_no, {2 * rules.MENU_LINES - 1}), '{"1" * rules.MENU_LINES}')) AS kept_chars
    FROM (
        SELECT *, '{"0" * (rules.MENU_LINES - 1)}' || string_agg(entry, '' ORDER BY line_no) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
               || '{"0" * (rules.MENU_LINES - 1)}' AS digits
        FROM (
            SELECT doc_id, line_no, length(line) AS chars,
                   (seps >= {rules.NAV_SEPARATORS} AND length(line) <= seps * {rules.NAV_CHARS})
                   OR symbols * 100 > length(line) * {rules.MAX_SYMBOL_PERCENT}
                   OR (length(line) <= {rules.BOILERPLATE_CHARS} AND regexp_matches(lower(line), '{rules.BOILERPLATE}'))
                   OR NOT (regexp_matches(last, '{rules.ENDINGS}') AND NOT regexp_matches(last, '{rules.NO_ENDINGS}')) AS fails,
                   CASE WHEN length(line) <= {rules.MENU_CHARS} AND len(regexp_extract_all(line, '{WORD}')) <= {rules.MENU_WORDS}
                        AND NOT (regexp_matches(last, '{rules.PUNCTUATION}') AND NOT regexp_matches(last, '{rules.NO_ENDINGS}')) THEN '1' ELSE '0' END AS entry
            FROM (SELECT doc_id, line, line_no,
                         len(regexp_extract_all(line, '{rules.SEPARATORS}'))
                           + greatest(0, len(regexp_extract_all(line, '»')) - len(regexp_extract_all(line, '«'))) AS seps,
                         length(line) - length(regexp_replace(line, '{rules.SYMBOLS}', '', 'g')) AS symbols,
                         right(rtrim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), 1) AS last
                  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM texts))))
    GROUP BY doc_id
), measured AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '{rules.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
           coalesce(chars, 0) AS chars, (coalesce(chars, 0) - coalesce(kept_chars, 0))::BIGINT AS lost_chars
    FROM texts LEFT JOIN repeated r USING (doc_id) LEFT JOIN line_rules USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words)
         AND lost_chars * 100 <= chars * {rules.MAX_LOST_PERCENT} AS kept,
       lost_chars
FROM measured
"""

#: crc32 of a short text: per byte an exclusive or, then eight shifts (the entries -1).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split({text}, '')])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295::BIGINT)"""


def crc32(text: str) -> str:
    return _CRC.format(text=text)


ORACLE["op11_conversation_trie"] = f"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), plan AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, any_value({crc32("conv_id::VARCHAR")}) % 9 AS h FROM own GROUP BY conv_id
), rebuilt AS (
    SELECT p.conv_id, o.i AS place, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.base AND o.i <= p.h
    UNION ALL
    SELECT p.conv_id, o.i - p.h + least(p.h, coalesce(b.n, 0)), o.role, o.text
    FROM plan p JOIN own o ON o.conv_id = p.conv_id AND o.i > p.h LEFT JOIN plan b ON b.conv_id = p.base
), lists AS (
    SELECT p.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY place) FILTER (place IS NOT NULL), []) AS t,
           list(octet_length(encode(text)) ORDER BY place) FILTER (place IS NOT NULL) AS bytes
    FROM plan p LEFT JOIN rebuilt r USING (conv_id) GROUP BY p.conv_id
), prefixes AS (
    SELECT conv_id, d, coalesce(array_to_string(t[1:d], ''), '') AS path, coalesce(bytes[d], 0) AS bytes, d = len(t) AS is_end
    FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM lists)
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
    FROM prefixes GROUP BY path, d
), children AS (SELECT substr(path, 1, 64 * (d - 1)) AS up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.up = n.path),
subtrees AS (
    SELECT substr(path, 1, 64 * e) AS top, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n_children = 0) AS leaves
    FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_nodes) GROUP BY top
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s ON s.top = n.path LEFT JOIN nodes p ON n.d > 0 AND p.path = substr(n.path, 1, 64 * (n.d - 1))
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _levels(prefix: str, count: int) -> str:
    """CTEs {prefix}0..{prefix}{count}: the nodes of each level with the digests before and after them in their run."""
    parts = []
    for k in range(count + 1):
        if k:
            parts.append(f"""{prefix}{k}_bare AS (
    SELECT g, i // 16 AS i, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n,
           CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
    FROM {prefix}{k - 1}_bare o GROUP BY g, o.i // 16, n)""")
        parts.append(f"""{prefix}{k} AS (
    SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM {prefix}{k}_bare)""")
    return ",\n".join(parts)


def _climb(start: str, source: str, prefix: str, count: int, place: str) -> str:
    """CTEs {start}0..{start}{count}: `node` and `proof` of the rows of `source`, level by level."""
    parts = [f"{start}0 AS (SELECT * FROM {source})"]
    for k in range(count):
        parts.append(f"""{start}{k + 1} AS (
    SELECT s.* REPLACE (CASE WHEN l.n > 1 THEN sha256(l.before || s.node || l.after) ELSE s.node END AS node,
                        s.proof || CASE WHEN l.n > 1 THEN l.before || l.after ELSE '' END AS proof)
    FROM {start}{k} s JOIN {prefix}{k} l ON l.g = s.{"g" if prefix == "l" else "everything"} AND l.i = s.{place} // {16**k})""")
    return ",\n".join(parts)


#: Levels of the largest group and of the groups: up to 16 ** 6 rows and 16 ** 3 groups.
ORACLE["op12_merkle_manifest"] = f"""
WITH rows AS (
    SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf,
           CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0
                THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claimed
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows
), l0_bare AS (SELECT g, i, n, leaf AS h FROM placed),
{_levels("l", 6)},
t0_bare AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h, g AS name FROM l6),
{_levels("t", 3)},
starts AS (SELECT p.*, p.claimed AS node, '' AS proof, '' AS everything, t.i AS group_at, t.h AS subroot FROM placed p JOIN t0_bare t ON t.name = p.g),
{_climb("a", "starts", "l", 6, "i")},
{_climb("b", "a6", "t", 3, "group_at")}
SELECT doc_id, leaf, subroot, t3.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t3.h AS verified FROM b3, t3
"""
