"""SQL twins of the conversation operators."""

from __future__ import annotations

#: A table of the CRC-32 polynomial's remainders, and the checksum of an ASCII text by it.
CRC_TABLE = """tab AS (SELECT list(v ORDER BY n) AS tb FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)))"""


def crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295)"


TRIE = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS s FROM t GROUP BY c),
h AS (SELECT c, s, c - c % 5 AS b, {crc("CAST(c AS VARCHAR)")} % 9 AS h FROM o, tab),
w AS (SELECT h.c, list_concat(coalesce(list_slice(o.s, 1, h.h), []), coalesce(list_slice(h.s, h.h + 1, len(h.s)), [])) AS s FROM h LEFT JOIN o ON o.c = h.b),
p AS (SELECT c, d, list_slice(s, 1, d) AS p, d = len(s) AS e FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM w)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN e THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
j AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p AND n.d = k.d),
u AS (SELECT list_slice(p, 1, a) AS p, a AS d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT p, unnest(range(0, d + 1)) AS a, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].x) ELSE 0 END AS saved FROM j) GROUP BY 1, 2)
SELECT j.conv_id, CAST(j.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, j.n_convs, CAST(j.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, j.ends_sha256
FROM j JOIN u ON j.p = u.p AND j.d = u.d LEFT JOIN n q ON q.d = j.d - 1 AND q.p = list_slice(j.p, 1, j.d - 1)
"""


def add(cost: str, initials: str, rest: str) -> str:
    """A written (cost, initials) with edits before it: six digits, so that texts compare as pairs do."""
    return f"lpad(CAST(CAST(left({rest}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{initials}' || substr({rest}, 7)"


FOLLOW = {0: 2, 1: 2, 2: 3, 3: 2}


def direct(state: int) -> str:
    """The best that may be done with row i itself from ``state``, before insertions."""
    fit = f"k = {FOLLOW[state]}" + (" OR k = 1" if state == 0 else "")
    keep = "CASE k WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END"
    drop, rerole = add("3", "D", f"v{state}"), add("2 + cut", "R", f"v{FOLLOW[state]}")
    return f"CASE WHEN gone THEN {drop} WHEN {fit} THEN least({drop}, {rerole}, {add('cut', 'K', f'({keep})')}) ELSE least({drop}, {rerole}) END AS w{state}"


def inserted(state: int) -> str:
    one, two = FOLLOW[state], FOLLOW[FOLLOW[state]]
    return f"least(w{state}, {add('2', 'I', f'w{one}')}, {add('4', 'II', f'w{two}')}) AS v{state}"


REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS z FROM conversations, tab),
d AS (SELECT c, turn, CASE WHEN z = 4 THEN 'user' ELSE r END AS r, CASE z WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(range(CASE WHEN z = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE z <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS i, left(r, 1) AS a FROM d),
f AS (SELECT *, NOT regexp_matches(x, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 AS again, NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') AS short, lag(a) OVER (PARTITION BY c ORDER BY i) AS b FROM i),
s AS (SELECT c, i, r, x, a, blank OR again AS gone, CASE WHEN short THEN 1 ELSE 0 END AS cut, CASE a WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS k FROM f),
g AS (SELECT c, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count_if(blank) AS blank, count_if(NOT blank AND again) AS duplicate, count_if(NOT blank AND NOT again AND short) AS truncated,
  count_if(b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY c),
v AS (SELECT c, n + 1 AS i, '000000' AS v0, '000004II' AS v1, '000002I' AS v2, '000000' AS v3 FROM g
  UNION ALL SELECT c, i, {", ".join(inserted(x) for x in range(4))} FROM (SELECT v.c, s.i, {", ".join(direct(x) for x in range(4))} FROM v JOIN s ON s.c IS NOT DISTINCT FROM v.c AND s.i = v.i - 1)),
best AS (SELECT c, CAST(left(v0, 6) AS BIGINT) AS cost, substr(v0, 7) AS audit FROM v WHERE i = 1),
e AS (SELECT c, j, substr(audit, j, 1) AS l FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
m AS (SELECT c, j, l, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER w AS q FROM e WINDOW w AS (PARTITION BY c ORDER BY j)),
y AS (SELECT m.c, j, l, q, r, x, max(CASE WHEN q = 1 AND l = 'K' AND a = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.c) AS sys FROM m LEFT JOIN s ON s.c IS NOT DISTINCT FROM m.c AND s.i = m.i WHERE l <> 'D'),
t AS (SELECT c, sha256(string_agg(CASE WHEN l = 'K' THEN r WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE x END, chr(10) ORDER BY j)) AS h FROM y GROUP BY c)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) z LEFT JOIN g ON g.c IS NOT DISTINCT FROM z.conv_id LEFT JOIN best ON best.c IS NOT DISTINCT FROM z.conv_id LEFT JOIN t ON t.c IS NOT DISTINCT FROM z.conv_id
"""
