"""DuckDB SQL twins of the operators' queries, where SQL can express them.

Each twin takes another road than the operator: all pairs that share a shingle,
all windows, sums over the matches of plain patterns.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _either(word: str) -> str:
    """A pattern for the letters of ``word`` in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = ("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
           + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")

_OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[k] || ' ' || w[k + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM d WHERE len(w) > 1)
      UNION SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * both_n >= 80 * (u.n + v.n - both_n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""

_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
m AS (SELECT r, doc_id, source, kind, pat, regexp_extract_all(text, pat, 0) AS found, string_split_regex(text, pat) AS gaps
      FROM d, (VALUES (0, '{_ASSIGN}'), (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]' || repeat('[0-9a-f]', 31) || '+'),
                      (3, repeat('[A-Za-z0-9_-]', 23) || '[A-Za-z0-9_-]+')) AS k(kind, pat)
      WHERE regexp_matches(text, pat)),
x AS (SELECT r, doc_id, source, kind, pat, i, found[i] AS m, length(gaps[i]) AS gap FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
y AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM x),
z AS (SELECT r, doc_id, source, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN kind = 0 THEN regexp_extract(m, pat, 2) ELSE m END AS v FROM y),
base AS (SELECT * FROM z WHERE (kind = 0 AND length(v) >= 8) OR (kind = 1 AND length(v) >= 16) OR (kind = 2 AND length(v) >= 32)),
opaque AS (SELECT * FROM z WHERE kind = 3 AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND regexp_matches(v, '[A-Za-z]')
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = z.r AND b.s < z.e AND z.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
own AS (SELECT v, count(DISTINCT source) AS owners FROM every GROUP BY v),
kept AS (SELECT every.*, own.owners <= 2 AS live, list_extract(['assign', 'access', 'hex', 'opaque'], kind + 1) || ':' || s || ':' || e AS t
         FROM every JOIN own USING (v) WHERE kind < 3 OR own.owners <= 2),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind) AS spans,
      count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM bk),
dk AS (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n),
h AS (SELECT doc_id, k, x.n, item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM dk) x JOIN bw ON bw.n = x.n AND bw.g = x.g),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""

_OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least_id FROM x GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM x JOIN f USING (g) WHERE least_id < doc_id),
word AS (SELECT doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, bit by bit (the polynomial is a fixed value)."""
    digits = f"hex(encode({text}))"
    nibble = "(strpos('0123456789ABCDEF', substr(h, {at}, 1)) - 1)"
    # bit i of the message: of byte i // 8 the bit of value 2 ** (i % 8); its low half is the second digit
    bits = f"list_transform(range(0, 4 * length(h)), lambda i: ({nibble.format(at='2 * (i // 8) + 2 - (i % 8) // 4')} >> (i % 4)) & 1)"
    return (f"(SELECT xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
            f" FROM (SELECT {digits} AS h))")


_OP11 = f"""
WITH RECURSIVE r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
c AS (SELECT w, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM r),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
p AS (SELECT x.word AS a, y.word AS b FROM g x JOIN g y ON x.less = y.less AND x.k = y.k AND x.word <> y.word
      UNION SELECT g.word, v.word FROM g JOIN v ON g.less = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.less = v.word),
b AS (SELECT a AS word, count(*) AS n_near, max(v.n) AS best_n FROM p JOIN v ON v.word = p.b GROUP BY a),
f AS (SELECT b.word, min(p.b) AS form, any_value(best_n) AS form_n FROM b JOIN v ON v.word = b.word JOIN p ON p.a = b.word JOIN v y ON y.word = p.b
      WHERE y.n = best_n AND best_n >= 2 * v.n GROUP BY b.word),
t AS (SELECT word, word AS root FROM v UNION SELECT t.word, f.form FROM t JOIN f ON f.word = t.root)
SELECT v.word, f.form, t.root, v.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM v JOIN t ON t.word = v.word LEFT JOIN f ON f.word = v.word LEFT JOIN b ON b.word = v.word
WHERE t.root NOT IN (SELECT word FROM f)
"""

_OP12 = f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS INT) AS h FROM o),
s AS (SELECT h.conv_id, coalesce(b.l[1:h.h], []) || h.l[h.h + 1:] AS l FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
q AS (SELECT conv_id, len(l) AS length, d, CASE WHEN d = 0 THEN [] ELSE l[1:d] END AS p FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM s)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
      FROM q GROUP BY d, p),
u AS (SELECT x.d, x.p, x.conv_id, x.n_convs, x.ends_sha256, y.conv_id AS parent_conv_id, CASE WHEN x.d = 0 THEN [] ELSE x.p[1:x.d - 1] END AS pp
      FROM n x LEFT JOIN n y ON y.d = x.d - 1 AND y.p = CASE WHEN x.d <= 1 THEN [] ELSE x.p[1:x.d - 1] END),
k AS (SELECT d, pp, count(*) AS n_children FROM u WHERE d > 0 GROUP BY d, pp),
w AS (SELECT u.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN u.d = 0 THEN 0 ELSE (u.n_convs - 1) * length(u.p[u.d].t) END AS own
      FROM u LEFT JOIN k ON k.d = u.d + 1 AND k.pp = u.p),
a AS (SELECT i, CASE WHEN i = 0 THEN [] ELSE p[1:i] END AS ap, own, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w)),
z AS (SELECT i, ap, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM a GROUP BY i, ap)
SELECT w.conv_id, w.d AS depth, w.parent_conv_id, w.n_convs, w.n_children, z.n_leaves, CAST(z.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN z ON z.i = w.d AND z.ap = w.p
"""

_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size,
                  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 16) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS most, list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1) AS weight FROM s),
f AS (SELECT *, CAST(sum(most) OVER o AS BIGINT) AS most_upto, CAST(sum(weight) OVER o AS BIGINT) AS weight_upto, CAST(sum(weight) OVER () AS BIGINT) AS weights,
             1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM w
      WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, most_upto + most * (weights - weight_upto) / weight <= budget AS stops FROM f),
v AS (SELECT (max(budget) - coalesce(CAST(sum(most) FILTER (stops) AS BIGINT), 0)) / CAST(sum(weight) FILTER (NOT stops) AS BIGINT) AS level FROM g),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(most AS DOUBLE) ELSE weight * (SELECT level FROM v) END AS target FROM g),
x AS (SELECT d.r, d.doc_id, d.size, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.r) AS BIGINT) - d.size AS start
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       greatest(0, least(size, CAST(floor(target - start) AS BIGINT))) + greatest(0, least(size, CAST(floor(target - source_size - start) AS BIGINT))) AS taken
FROM x
"""

ORACLE: dict[str, str] = {"op2_minhash_dedup": _OP2, "op6_secrets": _OP6, "op7_decontamination": _OP7, "op9_substring_dedup": _OP9,
                          "op11_spelling_variants": _OP11, "op12_prefix_trie": _OP12, "op13_source_mix": _OP13}
