"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .license_scan import SHARED, TELLING, TEMPLATES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = "(VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(kind, h, p)"
_HOST = _LOWER.format("regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)")
_PATH = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = f"CASE WHEN contains({{0}}, '://') THEN {_LOWER.format("regexp_extract({0}, '(?s)^(.*?://[^/?#]*)', 1)")} || regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1) ELSE regexp_extract({{0}}, '(?s)^([^#]*)', 1) END"

# Links are resolved where they are absolute or begin with a slash; the pages hold no others, nor these.
OP1 = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)))) AS link
  FROM pages WHERE url IS NOT NULL),
links AS (
  SELECT url AS src, CASE
    WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*://') THEN replace(link, '&amp;', '&')
    WHEN NOT contains(url, '://') THEN NULL
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || replace(link, '&amp;', '&')
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {_HOST.format("url")} || replace(link, '&amp;', '&') END AS dst
  FROM tags),
edges AS (SELECT {_NODE.format("src")} AS a, {_NODE.format("dst")} AS b FROM links WHERE dst IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
ruled AS (
  SELECT u, max_by(kind, length(h || p)) AS verdict, max_by(h || p, length(h || p)) AS rule
  FROM (SELECT b AS u FROM reach UNION SELECT url FROM pages WHERE url IS NOT NULL) x, {_RULES}
  WHERE ({_HOST.format("u")} = h OR ends_with({_HOST.format("u")}, '.' || h)) AND starts_with({_PATH.format("u")}, p) GROUP BY u),
classes AS (
  SELECT reach.a AS node, min(reach.b) AS alias_class, bool_or(verdict = 'allow') AS allows, bool_or(verdict = 'block') AS blocks
  FROM reach LEFT JOIN ruled ON u = reach.b GROUP BY reach.a)
SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path, rule,
  coalesce(verdict, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict, alias_class
FROM pages LEFT JOIN ruled ON u = url LEFT JOIN classes ON node = {_NODE.format("url")}
"""

#: The same with redirects from some pages to the next, a table derived from the pages.
_REDIRECTED = "FROM links WHERE dst IS NOT NULL UNION ALL SELECT {} FROM pages p JOIN pages q ON q.page_id = p.page_id + 1 WHERE {})"
OP1_REDIRECTS, OP1_CHAINS = (OP1.replace("FROM links WHERE dst IS NOT NULL)", _REDIRECTED.format(f"{_NODE.format('p.url')}, {_NODE.format('q.url')}", which)) for which in ("p.page_id % 3 = 0", "p.page_id % 10 <> 9"))

#: Words and verdicts of the line-frequency rules; ``{docs}`` is the table.
LINE_VERDICTS = f"""
SELECT row_id, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_words >= 10 AND 100 * left_words >= 30 * n_words AS kept, left_words
FROM (
  SELECT d.*, CAST(n_words - coalesce(gone, 0) AS BIGINT) AS left_words, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words
  FROM (
    SELECT row_id, doc_id, source, text, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols
    FROM rows_) d
  LEFT JOIN (SELECT row_id, sum(words) AS gone FROM lines_ JOIN frequent USING (line) WHERE lines_.source IS NOT DISTINCT FROM frequent.source GROUP BY row_id) g USING (row_id)
  LEFT JOIN (SELECT row_id, sum(n - 1) AS dup FROM (SELECT row_id, raw, count(*) AS n FROM lines_ GROUP BY ALL) GROUP BY row_id) u USING (row_id)
  LEFT JOIN (
    SELECT row_id, count(DISTINCT pos + k) AS rep
    FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, gram) AS n FROM grams), (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY row_id) r USING (row_id))
"""

LINE_TABLES = f"""
rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines_ AS (
  SELECT row_id, source, text, raw, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS words, array_to_string(regexp_extract_all({_LOWER.format("raw")}, '[^\\x20\\x09-\\x0D]+'), ' ') AS line
  FROM (SELECT row_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM rows_) WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
frequent AS (
  SELECT l.source, line FROM lines_ l JOIN (SELECT source, count(DISTINCT coalesce(text, '')) AS nd FROM rows_ GROUP BY source) s ON l.source IS NOT DISTINCT FROM s.source
  GROUP BY l.source, line, nd HAVING count(DISTINCT text) > greatest(20, nd * 0.02)),
grams AS (SELECT row_id, pos, w[pos:pos + 4] AS gram FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS pos FROM rows_))
"""

OP6 = f"WITH {LINE_TABLES} SELECT * EXCLUDE (row_id) FROM ({LINE_VERDICTS})"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_TOKENS = f"regexp_extract_all({_LOWER.format('{0}')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TELLS = f"array_to_string(list_sort(list_filter(list_distinct({{0}}), lambda x: x IN ({', '.join(map(_quoted, TELLING))}))), ' ')"
OP7 = f"""
WITH t(license, body, shared) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(b)}, {b in SHARED})" for n, b in TEMPLATES)}),
templates AS (SELECT license, shared, {_TELLS.format("w")} AS k, {_GRAMS.format("w")} AS g FROM (SELECT license, shared, {_TOKENS.format("body")} AS w FROM t)),
rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
lines_ AS (SELECT row_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_),
blocks AS (
  SELECT row_id, string_agg(part, chr(10) ORDER BY pos) AS part
  FROM (SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS block FROM (SELECT *, {_TOKENS.format("part")} AS w FROM lines_)) WHERE len(w) > 0
  GROUP BY row_id, block HAVING count(*) > 1),
sentences AS (SELECT row_id, unnest(string_split_regex(part, '[.!?][ \t]+')) AS part FROM lines_ WHERE regexp_matches(part, '[.!?][ \t]+')),
units AS (SELECT row_id, part FROM lines_ UNION ALL SELECT * FROM blocks UNION ALL SELECT row_id, text FROM rows_ WHERE contains(text, chr(10)) UNION ALL SELECT * FROM sentences),
bags AS (SELECT row_id, u, {_TELLS.format("w")} AS k, {_GRAMS.format("w")} AS g FROM (SELECT row_id, row_number() OVER () AS u, {_TOKENS.format("part")} AS w FROM units) WHERE len(w) BETWEEN 2 AND 100000),
scored AS (
  SELECT row_id, u, license, shared, len(t.g) AS size, 2.0::DOUBLE * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS dice
  FROM bags b JOIN templates t ON len(b.g) * 2 <= len(t.g) * 3 AND len(t.g) * 2 <= len(b.g) * 3 AND b.k = t.k),
nearest AS (SELECT row_id, u, max(dice) AS dice, arg_min(size, (-dice, -size, license)) AS size, arg_min(license, (-dice, -size, license)) AS license, arg_min(shared, (-dice, -size, license)) AS shared FROM scored WHERE dice >= 0.8 GROUP BY row_id, u),
kept AS (SELECT *, shared = min(shared) OVER (PARTITION BY row_id) AS counts FROM nearest),
matched AS (SELECT *, max(dice) FILTER (counts) OVER (PARTITION BY row_id) AS top FROM kept),
best AS (
  SELECT row_id, count(DISTINCT u) AS units, arg_min(dice, (-size, -dice, license)) FILTER (counts AND dice >= top - 0.05) AS dice, arg_min(license, (-size, -dice, license)) FILTER (counts AND dice >= top - 0.05) AS license
  FROM matched GROUP BY row_id)
SELECT doc_id, license, coalesce(dice, 0.0::DOUBLE) AS dice, CAST(coalesce(units, 0) AS INTEGER) AS units FROM rows_ LEFT JOIN best USING (row_id)
"""

def _crc(hex_bytes: str) -> str:
    """CRC-32 of the bytes of a hexadecimal string, with the table ``crc_table``."""
    parts = f"list_transform(range(1, length({hex_bytes}) // 2 + 1), lambda i: CAST('0x' || substr({hex_bytes}, 2 * i - 1, 2) AS UBIGINT))"
    return f"CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], {parts}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) AS BIGINT)"


def _jump(shards: int, name: str) -> str:
    """The recursive steps of the jump hash, on 64-bit keys kept in 128 bits."""
    step = "(k * 2862933555777941757 + 1) % 18446744073709551616"
    return f"""{name}_steps(row_id, k, b, j) AS (SELECT row_id, CAST(key AS HUGEINT), -1::BIGINT, 0::BIGINT FROM d UNION ALL
  SELECT row_id, n, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((n // 8589934592) + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT row_id, j, {step} AS n FROM {name}_steps WHERE j < {shards})),
{name} AS (SELECT row_id, CAST(max(b) AS INTEGER) AS s FROM {name}_steps GROUP BY row_id)"""


OP2 = f"""
WITH RECURSIVE crc_steps(i, n, c) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM crc_steps WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE n = 8),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE doc_id END, 0) AS key, hex(encode(coalesce(text, ''))) AS x, hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))) AS y FROM documents),
{_jump(40, "now")},
{_jump(41, "grown")},
sized AS (SELECT row_id, doc_id, CAST(length(x) // 2 + 16 AS BIGINT) AS size, CASE WHEN x = '' THEN 0 ELSE {_crc("x")} END AS text_crc32, CASE WHEN y = '' THEN 0 ELSE {_crc("y")} END AS spread FROM d, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, now.s AS shard, row_number() OVER (PARTITION BY now.s ORDER BY spread, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown.s AS grown_shard FROM sized JOIN now USING (row_id) JOIN grown USING (row_id)
"""

_SPLIT = f"regexp_extract_all(regexp_replace({_LOWER.format('text')}, '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[^\\x20\\x09-\\x0D]+')"
# Of 13 tokens with two changed, or as few as 8 with one, three in a row agree: plain trigrams find every overlap.
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_SPLIT} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
items AS (SELECT row_number() OVER () AS b_id, item_id, w FROM (SELECT item_id, {_SPLIT} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)) WHERE len(w) > 0),
b AS (SELECT * FROM items WHERE len(w) >= 8),
dw AS (SELECT row_id, p, w[p:p + 2] AS k FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
bw AS (SELECT b_id, p, w[p:p + 2] AS k FROM (SELECT b_id, w, unnest(range(1, len(w) - 1)) AS p FROM b)),
hits AS (SELECT DISTINCT row_id, b_id, dw.p - bw.p AS shift FROM dw JOIN bw USING (k)),
laid AS (SELECT row_id, b_id, shift, j, dww[j + shift] = bww[j] AS eq, least(13, len(bww)) AS win
  FROM (SELECT row_id, b_id, shift, d.w AS dww, b.w AS bww, unnest(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1)) AS j FROM hits JOIN d USING (row_id) JOIN b USING (b_id))),
summed AS (SELECT *, sum(CAST(eq AS INTEGER)) OVER w AS upto, row_number() OVER w AS n FROM laid WINDOW w AS (PARTITION BY row_id, b_id, shift ORDER BY j)),
good AS (SELECT e.row_id, e.b_id, e.shift, e.j - e.win + 1 AS lo, e.j AS hi FROM summed e LEFT JOIN summed s ON s.row_id = e.row_id AND s.b_id = e.b_id AND s.shift = e.shift AND s.n = e.n - e.win WHERE e.n >= e.win AND 5 * (e.upto - coalesce(s.upto, 0)) >= 4 * e.win),
spans AS (SELECT l.row_id, l.b_id, l.shift, count(*) AS overlap FROM laid l WHERE EXISTS (SELECT 1 FROM good g WHERE g.row_id = l.row_id AND g.b_id = l.b_id AND g.shift = l.shift AND l.j BETWEEN g.lo AND g.hi) GROUP BY ALL),
short AS (
  SELECT row_id, b_id, n AS overlap FROM (SELECT row_id, n, w[p:p + n - 1] AS k FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT len(w) AS n FROM items WHERE len(w) < 8)))
  JOIN (SELECT b_id, w AS k FROM items WHERE len(w) < 8) USING (k)),
best AS (SELECT row_id, list(DISTINCT item_id ORDER BY item_id) AS item_ids, CAST(max(overlap) AS INTEGER) AS longest_overlap FROM (SELECT row_id, b_id, overlap FROM spans UNION ALL SELECT * FROM short) JOIN items USING (b_id) GROUP BY row_id)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, coalesce(longest_overlap, 0) AS longest_overlap FROM d LEFT JOIN best USING (row_id)
"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
starts AS (SELECT row_id, doc_id, p, substr(x, 2 * p - 1, 100) AS s FROM (SELECT *, unnest(range(1, length(x) // 2 - 48)) AS p FROM d)),
gone AS (SELECT row_id, p FROM (SELECT row_id, doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM starts) WHERE first_doc < doc_id),
spans AS (
  SELECT row_id, min(p) AS lo, max(p) + 49 AS hi
  FROM (SELECT *, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY p) AS span FROM (SELECT *, lag(p, 1, -1000) OVER (PARTITION BY row_id ORDER BY p) AS before FROM gone))
  GROUP BY row_id, span),
gaps AS (
  SELECT row_id, lag(hi, 1, 0) OVER (PARTITION BY row_id ORDER BY lo) + 1 AS a, lo - 1 AS b FROM spans
  UNION ALL SELECT row_id, max(hi) + 1, 1000000000 FROM spans GROUP BY row_id),
kept AS (SELECT row_id, string_agg(substr(x, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) AS k FROM gaps JOIN d USING (row_id) GROUP BY row_id),
sums AS (SELECT row_id, count(*) AS n, sum(hi - lo + 1) AS bytes FROM spans GROUP BY row_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN sums USING (row_id) LEFT JOIN kept USING (row_id)
"""

ORACLE_SQL = {"redirect_classes": OP1_REDIRECTS, "redirect_chains": OP1_CHAINS, "op2_jump_sharding": OP2, "op4_spaced_seed_decontamination": OP4, "op5_suffix_array_dedup": OP5, "op7_license_dice": OP7, "op1_redirect_url_filter": OP1, "op6_line_frequency_quality": OP6}
