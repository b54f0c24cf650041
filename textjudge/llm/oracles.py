"""DuckDB texts of the operators that SQL can express but not in a few lines."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit (fixed value: the reversed polynomial)."""
    byte = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: {bits}))"


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tower(name: str, start: str, group: str) -> str:
    """Levels of digests, 16 to one, and the runs of siblings on each level."""
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT {group}, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
        FROM {name} WHERE n > 1 GROUP BY {group}, level, idx // 16, n
    ), {name}_runs AS (
        SELECT {group}, level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM {name} WHERE n > 1 GROUP BY {group}, level, idx // 16
    )"""


def _climb(name: str, start: str, runs: str, group: str) -> str:
    around = "ds[1:(c.idx % 16)::INT]", "ds[(c.idx % 16)::INT + 2:]"
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT c.doc_id, c.source, c.leaf, c.level + 1, c.idx // 16, (c.n + 15) // 16,
               sha256(array_to_string(list_concat({around[0]}, [c.folded], {around[1]}), '')),
               c.proof || array_to_string(list_concat({around[0]}, {around[1]}), '')
        FROM {name} c JOIN {runs} r ON {group} AND r.level = c.level AND r.run = c.idx // 16 WHERE c.n > 1
    )"""


MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, {_leaf('text')} AS leaf,
        CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(_SMALL)} END AS tampered FROM documents)
), {_tower('lower_', "SELECT source, 0 AS level, idx, leaf AS digest, n FROM leaves", 'source')},
tops AS MATERIALIZED (
    SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM lower_ WHERE n = 1
), {_tower('upper_', "SELECT 0 AS one, 0 AS level, idx, digest, n FROM tops", 'one')},
{_climb('inner_', "SELECT doc_id, source, leaf, 0 AS level, idx, n, coalesce(tampered, leaf) AS folded, '' AS proof FROM leaves",
        'lower__runs', 'r.source IS NOT DISTINCT FROM c.source')},
{_climb('outer_', '''SELECT doc_id, i.source, leaf, 0 AS level, t.idx, t.n, folded, proof
         FROM inner_ i JOIN tops t ON t.source IS NOT DISTINCT FROM i.source WHERE i.n = 1''', 'upper__runs', 'true')}
SELECT doc_id, leaf, t.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM outer_ o JOIN tops t ON t.source IS NOT DISTINCT FROM o.source, (SELECT digest AS root FROM upper_ WHERE n = 1)
WHERE o.n = 1
"""

TRIE = f"""
WITH turns AS (
    SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), original AS (
    SELECT conv_id, list(said ORDER BY p) AS said, {crc32('conv_id::VARCHAR')} % 6 AS h FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h::INT], []), c.said[c.h::INT + 1:]) AS said
    FROM original c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
    SELECT conv_id, d, said[1:d] AS node, d = len(said) AS ends FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
    SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
           (count(*) - 1) * coalesce(length(node[d].t), 0) AS saved
    FROM prefixes GROUP BY node, d
), children AS (
    SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), whole AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.node
), sums AS (
    SELECT node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole) GROUP BY 1
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.node = w.node LEFT JOIN nodes p ON w.depth > 0 AND p.node = w.node[1:w.depth - 1]
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NEAR = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, {_WORDS} AS w FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM docs WHERE len(w) >= 5
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), links AS MATERIALIZED (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
    SELECT doc_id, doc_id AS root FROM documents
    UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
