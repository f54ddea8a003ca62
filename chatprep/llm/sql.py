"""DuckDB SQL of the queries that SQL can express."""

OP3 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls,
         row_number() OVER () AS rid
  FROM documents),
g AS (
  SELECT rid, i, row(ws[i], ws[i + 1], ws[i + 2]) AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (10 * n_symbols > n_words OR 100 * n_upper > 30 * word_chars) AS kept
FROM m
"""

OP7 = r"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS rid, page_id, url, coalesce(html, '') AS html,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         CASE WHEN contains(url, '://') THEN substr(url, 1, instr(url, '://') - 1) ELSE '' END AS scheme
  FROM pages),
h AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path,
         regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g') AS body
  FROM p),
t AS (
  SELECT rid, regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) AS to_url
  FROM (SELECT rid, unnest(regexp_extract_all(body, '(?is)<link\b[^>]*>')) AS tag FROM h)
  WHERE regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical')
  UNION ALL
  SELECT rid, regexp_extract(tag, '(?i)url\s*=\s*[''"]?([^"''\s>]+)', 1)
  FROM (SELECT rid, unnest(regexp_extract_all(body, '(?is)<meta\b[^>]*>')) AS tag FROM h)
  WHERE regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh')),
e AS (
  SELECT regexp_replace(h.url, '#.*$', '') AS a,
         regexp_replace(CASE WHEN contains(to_url, '://') THEN to_url
              WHEN starts_with(to_url, '//') THEN scheme || ':' || to_url
              WHEN starts_with(to_url, '/') THEN scheme || '://' || regexp_extract(rest, '^[^/?#]*') || to_url
              ELSE scheme || '://' || regexp_extract(rest, '^[^/?#]*') || regexp_replace(coalesce(nullif(path, ''), '/'), '[^/]*$', '') || to_url END, '#.*$', '') AS b
  FROM t JOIN h USING (rid) WHERE to_url <> '' AND scheme <> ''),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT a AS node, a AS seen FROM u
  UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.seen),
nodes AS (
  SELECT node, CASE WHEN contains(node, '://') THEN substr(node, instr(node, '://') + 3) ELSE '' END AS rest
  FROM (SELECT DISTINCT seen AS node FROM reach)),
rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT node, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT node, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM nodes)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY node),
alias AS (
  SELECT r.node, bool_or(j.verdict = 'block') AND NOT bool_or(j.verdict = 'allow') AS blocked
  FROM reach r JOIN judged j ON j.node = r.seen GROUP BY r.node),
own AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, own.rule AS rule,
       coalesce(own.verdict, CASE WHEN alias.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN own USING (rid) LEFT JOIN alias ON alias.node = regexp_replace(h.url, '#.*$', '')
"""


def _op9() -> str:
    """The templates of the operator as a VALUES list; every step in plain SQL."""
    from chatprep.llm.license_scan import (BAND, BASE_TEMPLATES, MAX_STRETCH, MIN_COVER, MORE_TEMPLATES,
                                           PHRASE_GRAMS)

    values = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, '{t.text.replace(chr(39), chr(39) * 2)}')"
                       for i, t in enumerate(BASE_TEMPLATES + MORE_TEMPLATES))

    def words(x: str) -> str:
        low = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"[x FOR x IN regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"

    return f"""
WITH tpl(tpl, label, base, body) AS (VALUES {values}),
tw AS (SELECT tpl, label, base, {words('body')} AS ws FROM tpl),
tg AS (SELECT tpl, label, base, len(ws) - 2 AS n_grams, i - 1 AS tpos, row(ws[i], ws[i + 1], ws[i + 2]) AS g
       FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM tw)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS ws FROM documents),
dg AS (SELECT rid, i - 1 AS pos, row(ws[i], ws[i + 1], ws[i + 2]) AS g
       FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
v AS (SELECT rid, tpl, label, base, n_grams, pos - tpos AS diag, min(pos) AS lo, max(pos) AS hi, list(tpos) AS tp
      FROM dg JOIN tg USING (g) GROUP BY ALL),
n AS (SELECT *, CASE WHEN n_grams > {PHRASE_GRAMS} AND diag - lag(diag) OVER (PARTITION BY rid, tpl ORDER BY diag)
                <= {BAND} THEN 0 ELSE 1 END AS fresh FROM v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tpl ORDER BY diag) AS span FROM n),
m AS (SELECT rid, tpl, label, base, n_grams, span, min(lo) AS first, max(hi) + 2 AS last,
             len(list_distinct(flatten(list(tp)))) AS held FROM s GROUP BY ALL),
f AS (SELECT *, held / n_grams AS cover FROM m
      WHERE CASE WHEN n_grams <= {PHRASE_GRAMS} THEN held = n_grams
                 ELSE held / n_grams >= {MIN_COVER} AND last - first + 1 <= {MAX_STRETCH} * (n_grams + 2) END),
p AS (SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word,
             max(first) FILTER (base) AS last_word,
             array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score
      FROM f GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN p USING (rid)
"""


OP9 = _op9()

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
b AS (
  SELECT item_id,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS body
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS body
  FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
hit AS (SELECT rid, i, size, body FROM dw WHERE body IN (SELECT body FROM bw)),
w AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT rid, i, unnest(range(0, size)) AS j FROM hit) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (body)) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN it USING (rid)
"""

OP5 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, row_number() OVER () AS rid FROM pages),
k AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
         row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, rid) AS r,
         CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
         + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r > 1 THEN first END AS refers_to
FROM k
"""


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of a forest over ``{name}0(tree, idx, h, n)``: ``{name}_run{k}``, the runs of level k with
    their hashes in order, and ``{name}{k}``, the nodes of level k."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_run{k} AS (
  SELECT tree, n, idx >> 4 AS up, list(h ORDER BY idx) AS hs FROM {name}{k}
  WHERE (n + {16 ** k - 1}) >> {4 * k} > 1 GROUP BY ALL),
{name}{k + 1} AS (SELECT tree, up AS idx, sha256(array_to_string(hs, '')) AS h, n FROM {name}_run{k})""")
    out.append(f"{name}_root AS (" + " UNION ALL ".join(
        f"SELECT tree, n, h FROM {name}{k} WHERE (n + {16 ** k - 1}) >> {4 * k} = 1"
        + (f" AND (n + {16 ** (k - 1) - 1}) >> {4 * (k - 1)} > 1" if k else "") for k in range(levels + 1)) + ")")
    return ",\n".join(out)


def _path_sql(name: str, source: str, place: str, levels: int) -> str:
    """CTEs that carry (sibs, cur) of ``source`` up the forest, from the leaf at ``place``."""
    out, last = [], source
    for k in range(levels):
        at = f"(({place} >> {4 * k}) & 15)"
        out.append(f"""{source}_{name}{k} AS (
  SELECT x.* REPLACE (
    CASE WHEN r.hs IS NULL THEN sibs ELSE sibs || array_to_string(r.hs[1:{at}], '') || array_to_string(r.hs[{at} + 2:], '') END AS sibs,
    CASE WHEN r.hs IS NULL THEN cur ELSE sha256(array_to_string(r.hs[1:{at}], '') || cur || array_to_string(r.hs[{at} + 2:], '')) END AS cur)
  FROM {last} x LEFT JOIN {name}_run{k} r ON r.tree = x.{name}_tree AND r.up = {place} >> {4 * (k + 1)})""")
        last = f"{source}_{name}{k}"
    return ",\n".join(out)


#: Levels of either tree that the comparison's SQL spells out: 16^6 leaves in a group, as many groups.
_LEVELS = 6
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP13 = rf"""
WITH d AS (
  SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
         sha256({_LEAF} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low,
         coalesce(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 5 = 0, false) AS bad
  FROM documents),
p AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM d),
g0 AS (SELECT tree, pos AS idx, leaf AS h, n FROM p),
{_tree_sql("g", _LEVELS)},
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree = 'n' DESC, encode(substr(tree, 2))) - 1 AS rank, count(*) OVER () AS m FROM g_root),
t0 AS (SELECT 't' AS tree, rank AS idx, h, m AS n FROM s),
{_tree_sql("t", _LEVELS)},
x AS (
  SELECT doc_id, leaf, s.h AS subroot, t_root.h AS root, pos, rank, p.tree AS g_tree, 't' AS t_tree, '' AS sibs,
         CASE WHEN bad THEN low ELSE leaf END AS cur
  FROM p JOIN s ON s.tree = p.tree CROSS JOIN t_root),
{_path_sql("g", "x", "pos", _LEVELS)},
y AS (SELECT * FROM x_g{_LEVELS - 1}),
{_path_sql("t", "y", "rank", _LEVELS)}
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM y_t{_LEVELS - 1}
"""

OP11 = r"""
WITH e AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
