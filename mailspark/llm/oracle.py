"""DuckDB SQL of the tree and conversation queries, by plain recursion."""

from __future__ import annotations


def _crc32(key: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, c: {bits}), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# lv: every node of both trees; a node's run is numbered pos // 3. f: a leaf's way up, one level a step.
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
    {_leaf("CASE WHEN " + _crc32('doc_id::VARCHAR') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other
  FROM documents),
p AS (SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (
  SELECT g, 0 AS l, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL
  SELECT g, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM lv WHERE n > 1 GROUP BY g, l, pos // 3),
sub AS (SELECT g, h AS subroot, l AS height FROM lv WHERE n = 1),
top AS (
  SELECT 0 AS l, g AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY l, pos // 3),
nodes AS (SELECT g, l, pos, h, n FROM lv WHERE n > 1
  UNION ALL SELECT s.g, s.height + t.l, t.pos, t.h, t.n FROM top t, sub s WHERE t.n > 1),
runs AS (SELECT g, l, pos // 3 AS run, list(h ORDER BY pos) AS kids FROM nodes GROUP BY g, l, pos // 3),
f AS (
  SELECT p.g, p.pos AS start, doc_id, leaf, p.pos, 0 AS l, other AS h, '' AS proof, height FROM p JOIN sub USING (g)
  UNION ALL
  SELECT f.g, start, doc_id, leaf, CASE WHEN f.l + 1 = height THEN f.g ELSE place // 3 END, f.l + 1,
    sha256(list_aggregate(list_concat(kids[:own - 1], [f.h], kids[own + 1:]), 'string_agg', '')),
    proof || coalesce(list_aggregate(list_concat(kids[:own - 1], kids[own + 1:]), 'string_agg', ''), ''), height
  FROM (SELECT *, CASE WHEN l = height THEN g ELSE pos END AS place,
          CASE WHEN l = height THEN g ELSE pos END % 3 + 1 AS own FROM f) f
  JOIN runs r ON r.g = f.g AND r.l = f.l AND r.run = place // 3),
ends AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY g, start ORDER BY l DESC) = 1)
SELECT doc_id, leaf, subroot, h2.h AS root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = h2.h AS verified
FROM ends e JOIN sub USING (g), (SELECT h FROM top WHERE n = 1) h2"""

# States 1 to 4: nothing yet, after system, after user, after assistant. c: cost to go from each.
_KEPT = ("CASE WHEN i = 's' AND {s} = 1 THEN 2 WHEN i = 'u' AND {s} <> 3 THEN 3 WHEN i = 'a' AND {s} = 3 THEN 4 END")


def _base(state: int) -> str:
    """Cheapest way over a row without an insert before it."""
    kept = _KEPT.format(s=state)
    return (f"least(3 + c.c[{state}], CASE WHEN r.must THEN 9999999 ELSE r.t + 2 + c.c[{(3, 3, 4, 3)[state - 1]}] END, "
            f"CASE WHEN r.must THEN 9999999 ELSE coalesce(r.t + c.c[{kept}], 9999999) END)")


REPAIR_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations),
names AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
dam AS (SELECT k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw JOIN names ON raw.conv_id IS NOT DISTINCT FROM names.conv_id,
    LATERAL (SELECT unnest(range(CASE WHEN hit = 0 THEN 0 WHEN hit = 3 THEN 2 ELSE 1 END)))),
placed AS (SELECT *, left(role, 1) AS i,
    row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(role || ':' || text)) AS p FROM dam),
judged AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY k, role, text ORDER BY p) > 1 AS again,
    regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$') AS cut,
    lag(i) OVER (PARTITION BY k ORDER BY p) || i AS pair FROM placed),
r AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT again THEN 1 ELSE 0 END AS t FROM judged),
counts AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(t) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k),
back AS (
  SELECT k, n + 1 AS p, [0, 4, 2, 0] AS c FROM counts
  UNION ALL
  SELECT k, p, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
  FROM (SELECT r.k, r.p, [{', '.join(_base(s) for s in (1, 2, 3, 4))}] AS b FROM back c JOIN r ON r.k = c.k AND r.p = c.p - 1)),
walk AS (
  SELECT k, 1::BIGINT AS p, 1 AS s, '' AS audit, '' AS body, 0 AS n FROM names
  UNION ALL
  SELECT k, CASE WHEN e = 'I' THEN p ELSE p + 1 END,
    CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nxt END, audit || e,
    CASE WHEN e = 'D' THEN body ELSE body || CASE WHEN n > 0 THEN chr(10) ELSE '' END
      || CASE WHEN e = 'K' THEN role WHEN nxt = 3 THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN e = 'I' THEN '' ELSE text END END,
    n + CASE WHEN e = 'D' THEN 0 ELSE 1 END
  FROM (SELECT *, CASE WHEN 3 + c2[s] = c1[s] THEN 'D' WHEN 2 + c1[nxt] = c1[s] THEN 'I'
          WHEN NOT must AND t + c2[kept] = c1[s] THEN 'K' WHEN NOT must AND 2 + t + c2[nxt] = c1[s] THEN 'R' END AS e
        FROM (SELECT w.*, a.c AS c1, b.c AS c2, role, text, must, t, {_KEPT.format(s='s')} AS kept, [3, 3, 4, 3][s] AS nxt
              FROM walk w JOIN back a ON a.k = w.k AND a.p = w.p LEFT JOIN back b ON b.k = w.k AND b.p = w.p + 1
              LEFT JOIN r ON r.k = w.k AND r.p = w.p))
  WHERE e IS NOT NULL),
ends AS (SELECT k, audit, body FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(audit) DESC) = 1),
firsts AS (SELECT k, c[1] AS cost FROM back WHERE p = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM names LEFT JOIN counts USING (k) LEFT JOIN firsts USING (k) LEFT JOIN ends USING (k)"""
