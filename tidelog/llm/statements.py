"""DuckDB SQL of the resampling, conversation and set-join queries: each by other means than its operator."""

from __future__ import annotations

#: The polynomial of CRC-32 and its first remainder.
_POLY, _ONES = 3988292384, 4294967295
#: The 256 remainders of CRC-32, made of the polynomial bit by bit.
_CRC_TABLE = f"""SELECT [list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, {_POLY}::UBIGINT) ELSE r >> 1 END) FOR i IN range(256)] AS rest"""


def crc32(text: str) -> str:
    """CRC-32 of a string expression's UTF-8, with the remainders in a column ``rest``."""
    bytes_ = f"[CAST('0x' || hex(encode({text}))[2 * k + 1 : 2 * k + 2] AS UBIGINT) FOR k IN range(strlen({text}))]"
    return f"xor(list_reduce(list_prepend({_ONES}::UBIGINT, {bytes_}), lambda a, b: xor(rest[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), {_ONES}::UBIGINT)"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Features of every document, without collapsing copies; CRC-32 of each distinct feature; all scores by one sort.
OP11_SQL = rf"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}
), d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all({LOWER}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM benchmark
), df AS (
  SELECT row, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM d
), bf AS (
  SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM b
), hashed AS MATERIALIZED (
  SELECT f, CAST({crc32("f")} % 10000 AS INTEGER) AS bucket FROM (SELECT DISTINCT f FROM df UNION SELECT f FROM bf), crc
), have AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket
), want AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM have) + 10000)::DOUBLE
                                      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM want) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000))::INTEGER AS bucket) LEFT JOIN have USING (bucket) LEFT JOIN want USING (bucket)
), weighed AS (
  SELECT row, count(*) AS n, sum(g) AS total FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CAST(coalesce((total - ((total % n) + n) % n) / n, 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN weighed USING (row)
), ranked AS (
  SELECT *, weight + noise AS score, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) END AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank FROM ranked
"""

#: The damage; then from the last turn on the least (cost, audit) from each state, where every step is one letter with the
#: insertions before it and the strings themselves decide ties.
_STEP = {
    "x": [("", "s"), ("", "u"), ("I", "a")],
    "s": [("", "u"), ("I", "a")],
    "u": [("", "a"), ("I", "u")],
    "a": [("", "u"), ("I", "a")],
}


def _from_state(q: str) -> str:
    """The best of what one turn and all after it can be made of, from the state ``q``: a struct of cost and audit."""
    options = [f"{{'c': 2 + g.{q}.c, 'a': 'D' || g.{q}.a}}"]
    for inserts, r in _STEP[q]:
        price = 5 * len(inserts)
        keep = f"CASE WHEN stay AND own = '{r}' THEN {{'c': {price} + extra + g.{r}.c, 'a': '{inserts}K' || g.{r}.a}} END"
        rerole = f"CASE WHEN stay AND own <> '{r}' THEN {{'c': {price} + 1 + extra + g.{r}.c, 'a': '{inserts}R' || g.{r}.a}} END"
        options += [keep] if r == "s" else [keep, rerole]
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


OP12_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}
), t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM t)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '[\x{{20}}\x{{09}}-\x{{0D}}]+$', '') AS body
  FROM damaged
), told AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS own, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS next
  FROM placed
), turn_row AS MATERIALIZED (
  SELECT conv_id, i, role, text, own, fault NOT IN ('blank', 'duplicate') AS stay, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM told
), counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE next IS NOT NULL AND role[1] || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
), g(conv_id, i, x, s, u, a) AS (
  SELECT conv_id, n, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 10::BIGINT, 'a': 'II'}}, {{'c': 5::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}} FROM counted
  UNION ALL
  SELECT g.conv_id, g.i - 1, {", ".join(_from_state(q) for q in "xsua")}
  FROM g JOIN turn_row r ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i
), done AS (SELECT conv_id, x.c AS cost, x.a AS audit FROM g WHERE i = 0
), letter AS (
  SELECT conv_id, unnest(range(1, len(audit) + 1)) AS p, unnest(string_split(audit, '')) AS e FROM done WHERE audit <> ''
), step AS (
  SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS k
  FROM letter WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), emitted AS (
  SELECT step.conv_id, k, e, role, text, max(CASE WHEN k = 1 AND e = 'K' AND own = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY step.conv_id) AS lead_system
  FROM step LEFT JOIN turn_row r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.i = step.i AND e <> 'I' WHERE e <> 'D'
), fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - lead_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS repaired
  FROM emitted GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted ON c.conv_id IS NOT DISTINCT FROM counted.conv_id
LEFT JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN fixed ON c.conv_id IS NOT DISTINCT FROM fixed.conv_id
"""

#: Every pair of documents that share a shingle, counted; components by reachability.
OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x{{20}}\x{{09}}-\x{{0D}}]+') AS w FROM documents
), s AS (
  SELECT row, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE [concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) FOR i IN range(1, len(w) - 3)] END) AS x FROM d
), class AS (SELECT list_sort(x) AS x, min(row) AS node FROM s GROUP BY ALL
), token AS (SELECT node, unnest(x) AS t FROM class
), link AS (
  SELECT a, b FROM (SELECT p.node AS a, q.node AS b, count(*) AS c FROM token p JOIN token q ON p.t = q.t AND p.node <> q.node GROUP BY ALL)
  JOIN class p ON p.node = a JOIN class q ON q.node = b WHERE 100 * c >= 80 * (len(p.x) + len(q.x) - c)
), reach(node, root) AS (SELECT node, node FROM class UNION SELECT link.b, reach.root FROM reach JOIN link ON reach.node = link.a
), of AS (
  SELECT d.row, d.doc_id, len(s.x) AS n, c.node, r.root FROM d JOIN s USING (row) JOIN class c ON list_sort(s.x) = c.x
  JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON c.node = r.node
)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM of
"""
