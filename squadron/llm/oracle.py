"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from squadron.llm import licenses, quality_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


ORACLE: dict[str, str] = {}

ORACLE["op3_near_dedup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, seen) AS (
  SELECT a, a FROM (SELECT DISTINCT a FROM l)
  UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_PLAIN = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op5_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format(x=_lower("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN.format(x=_lower("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
f AS (SELECT doc_id, item_id, i, bw.m AS m FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.x, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_STRIP = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLE["op9_line_dedup"] = f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM x),
k AS (SELECT *, {_lower(_STRIP)} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_LINE = r"regexp_matches(x, '[^\x20\x09-\x0D]')"
_BOUNDS = " AND ".join(f"{name} >= {low}" if most is None else f"{name} <= {most}" if low is None
                       else f"{name} BETWEEN {low} AND {most}" for name, low, most in quality_rules.THRESHOLDS)
ORACLE["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF {_LINE}] AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[j:j + 2] FOR j IN range(1, len(w) - 1)]) AS k FROM d
      WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len([x FOR x IN w IF lower(x) IN ({_STOP})]) AS n_stop, len(ls) AS n_lines,
         len([x FOR x IN ls IF regexp_matches(x, '^\s*[-*•·]')]) AS n_bullet,
         len([x FOR x IN ls IF regexp_matches(x, '(\.\.\.|…)\s*$')]) AS n_ellipsis
  FROM d LEFT JOIN c USING (doc_id)),
q AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
         CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_words_per_word,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_lines_per_line,
         CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END AS bullet_lines_per_line,
         CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_lines_per_line FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_BOUNDS} AS kept FROM q
"""

_SPELLED = "x"
for _a, _b in licenses.EQUIVALENT:
    _SPELLED = f"replace({_SPELLED}, '{_a}', '{_b}')"
_CANONICAL = (rf"[y FOR y IN [trim(regexp_replace({_SPELLED}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) FOR x IN "
              rf"string_split(lower(text), chr(10)) IF NOT regexp_matches(x, "
              rf"'^\s*(copyright|\(c\)|©|all rights reserved)')] IF y <> '']")
_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.KNOWN)
ORACLE["op7_licenses"] = f"""
WITH known AS (
  SELECT sha256(array_to_string(ls, ' ')) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_CANONICAL} AS ls FROM (VALUES {_KNOWN}) v(license_id, text)) GROUP BY 1),
d AS (SELECT doc_id, coalesce({_CANONICAL}, []) AS ls FROM documents),
w AS (SELECT doc_id, CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END AS digest FROM d),
h AS (SELECT l.doc_id, count(*) AS n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
      FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM d) l JOIN known k USING (digest) GROUP BY l.doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(h.n, 0) AS n_notices, coalesce(h.ids, '') AS notices
FROM w LEFT JOIN known k USING (digest) LEFT JOIN h USING (doc_id)
"""

# Hexadecimal digits are single bytes, so a byte window is a substring of 400 of them.
ORACLE["op4_suffix_dedup"] = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k
      FROM (SELECT doc_id, h, unnest(range(CAST(length(h) / 2 AS BIGINT) - 199)) AS i FROM d WHERE length(h) >= 400)),
s AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM s),
r AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before,
             row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM u),
k AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a)
             || max(CASE WHEN back = 1 THEN substr(h, CAST(2 * b + 1 AS BIGINT)) ELSE '' END) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

# CRC-32 bit by bit: a byte is xored in, then eight steps (-1) shift it out.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1]
  FOR x IN string_split({x}, '')])), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)
  ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
_FIELD = "coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x=c) for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
_UP = """SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM {t} WHERE n > 1 GROUP BY tree, level, i // 3, n"""
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format(t="text")} AS leaf,
         CASE WHEN {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0
              THEN {_LEAF.format(t="replace(text, chr(10), '')")} ELSE {_LEAF.format(t="text")} END AS claimed
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY tree) AS n FROM d),
a(tree, level, i, n, h) AS (SELECT tree, 0, i, n, leaf FROM p UNION ALL {_UP.format(t="a")}),
s AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n
      FROM a WHERE n = 1),
b(tree, level, i, n, h) AS (SELECT 0, 0, i, n, subroot FROM s UNION ALL {_UP.format(t="b")}),
deep AS (SELECT tree, max(level) AS below FROM a GROUP BY tree),
below AS (
  SELECT x.doc_id, x.leaf, y.level,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i // CAST(3 ** y.level AS BIGINT)), '') AS l,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i // CAST(3 ** y.level AS BIGINT)), '') AS r
  FROM p x JOIN a y ON x.tree = y.tree AND y.n > 1 AND y.i // 3 = x.i // CAST(3 ** y.level AS BIGINT) // 3
  GROUP BY x.doc_id, x.leaf, y.level),
over_ AS (
  SELECT x.source AS tree, y.level,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i // CAST(3 ** y.level AS BIGINT)), '') AS l,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i // CAST(3 ** y.level AS BIGINT)), '') AS r
  FROM s x JOIN b y ON y.n > 1 AND y.i // 3 = x.i // CAST(3 ** y.level AS BIGINT) // 3
  GROUP BY x.source, y.level),
path AS (
  SELECT doc_id, leaf, level, l, r FROM below
  UNION ALL SELECT p.doc_id, p.leaf, deep.below + o.level, o.l, o.r FROM p JOIN deep USING (tree) JOIN over_ o USING (tree)),
proof AS (SELECT doc_id, leaf, list(l ORDER BY level) AS l, list(r ORDER BY level) AS r,
                 sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY doc_id, leaf),
f(doc_id, leaf, level, h) AS (
  SELECT doc_id, leaf, 0, claimed FROM p
  UNION ALL SELECT f.doc_id, f.leaf, f.level + 1, sha256(proof.l[f.level + 1] || f.h || proof.r[f.level + 1])
  FROM f JOIN proof USING (doc_id, leaf) WHERE f.level < len(proof.l)),
e AS (SELECT doc_id, leaf, max_by(h, level) AS folded_root FROM f GROUP BY doc_id, leaf),
root AS (SELECT h FROM b WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.h AS root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256,
       e.folded_root, e.folded_root = root.h AS verified
FROM p JOIN s ON s.source = p.tree CROSS JOIN root JOIN e USING (doc_id, leaf) LEFT JOIN proof USING (doc_id, leaf)
"""
