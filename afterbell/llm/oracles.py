"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from afterbell.llm.mixing import TOPICS, WORDS_PER_HIT
from afterbell.llm.secrets import KINDS, LEAST_DISTINCT, PLACEHOLDER


def _crc_table() -> str:
    """The CRC-32 remainders of the 16 half bytes (reflected polynomial EDB88320)."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return ", ".join(out)


def _topic_sql() -> str:
    """The topic with most hits, the first of equals, if it has one in so many words."""
    counts = ", ".join(f"len(regexp_extract_all(low, '{p}'))" for _, p in TOPICS)
    names = ", ".join(f"'{t}'" for t, _ in TOPICS)
    return f"CASE WHEN list_max([{counts}]) > 0 AND list_max([{counts}]) * {WORDS_PER_HIT} >= n_tokens THEN [{names}][list_position([{counts}], list_max([{counts}]))] ELSE 'prose' END"


def _tempered_sql(dim: str) -> str:
    return f"{dim}s AS (SELECT {dim}, pow(sum(n), 0.7) / sum(pow(sum(n), 0.7)) OVER () AS t{dim} FROM cells GROUP BY {dim} HAVING sum(n) > 0)"


#: Raking as a recursive query: step k meets the marginal of dimension k mod 3.
MIXING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, lower(coalesce(text, '')) AS low, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7:' || coalesce(text, '')), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE AS chance FROM documents),
r AS (SELECT * EXCLUDE (low), {_topic_sql()} AS t FROM d),
cells AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS n FROM r GROUP BY ALL),
{_tempered_sql("s")}, {_tempered_sql("l")}, {_tempered_sql("t")},
start AS (SELECT cells.*, coalesce(ts, 0) AS ts, coalesce(tl, 0) AS tl, coalesce(tt, 0) AS tt, n / sum(n) OVER () AS w0 FROM cells LEFT JOIN ss USING (s) LEFT JOIN ls USING (l) LEFT JOIN ts USING (t)),
rake AS (
  SELECT 0 AS k, *, w0 AS w FROM start
  UNION ALL
  SELECT k + 1, s, l, t, n, ts, tl, tt, w0, CASE WHEN sum(w) OVER g > 0 THEN w * CASE k % 3 WHEN 0 THEN ts WHEN 1 THEN tl ELSE tt END / sum(w) OVER g ELSE w END
  FROM rake WHERE k < 300 WINDOW g AS (PARTITION BY CASE k % 3 WHEN 0 THEN s WHEN 1 THEN l ELSE t END)),
f AS (SELECT s, l, t, n, CASE WHEN n > 0 THEN w / w0 ELSE 1 END AS factor FROM rake WHERE k = 300),
p AS (SELECT *, CASE WHEN n > 0 THEN least(1, factor / (SELECT max(factor) FROM f WHERE n > 0)) ELSE 1 END AS p FROM f)
SELECT doc_id, s AS source, l AS lang, t AS topic, n_tokens, round(factor, 6) AS factor, round(CASE WHEN n_tokens > 0 THEN p ELSE 1 END, 6) AS probability, chance < CASE WHEN n_tokens > 0 THEN p ELSE 1 END AS selected
FROM r JOIN p USING (s, l, t)
"""

SHARDING = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size,
         row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS rn,
         sum(CAST(strlen(coalesce(text, '')) AS BIGINT) + 1) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
         sum(CAST(strlen(coalesce(text, '')) AS BIGINT) + 1) OVER () AS total
  FROM documents),
s AS (
  SELECT *, CAST(least(7, ((2 * (upto - size) + size) * 8) // (2 * total)) AS INTEGER) AS shard FROM d)
SELECT doc_id, size,
  CAST(xor(list_reduce(
    list_prepend(4294967295::BIGINT,
      list_transform(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''),
        lambda c: CAST(greatest(strpos('0123456789ABCDEF', c), 1) - 1 AS BIGINT))),
    lambda a, b: xor(a >> 4, [{_crc_table()}][(xor(a, b) & 15) + 1])), 4294967295::BIGINT) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard,
  CAST(rn - min(rn) OVER (PARTITION BY shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


def _kind_sql(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, rn, {rank} AS rank, '{kind}' AS kind, u.i AS i,
         list_sum(list_transform(pieces[1:u.i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:u.i - 1], lambda x: length(x))), 0) AS start,
         length(whole[u.i]) AS len, val[u.i] AS value
  FROM (SELECT doc_id, source, rn, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}', 0) AS whole,
               regexp_extract_all(t, '{p}', {group}) AS val FROM docs WHERE regexp_matches(t, '{p}')) m,
       LATERAL (SELECT unnest(range(1, len(m.whole) + 1)) AS i) u
  WHERE length(val[u.i]) >= {least}"""


SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
c AS ({" UNION ALL ".join(_kind_sql(*k, i) for i, k in enumerate(KINDS))}),
f AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repos FROM c GROUP BY value),
j AS (
  SELECT c.*, owners <= 1 AND repos <= 10 AS few,
    regexp_matches(value, '[0-9]') AND NOT regexp_matches(lower(value), '{PLACEHOLDER}')
      AND len(list_distinct(string_split(value, ''))) >= {LEAST_DISTINCT} AS looks
  FROM c JOIN f USING (value)),
s AS (
  SELECT rn, rank, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + len AS VARCHAR) AS span, start, false AS extra, few, looks FROM j
  UNION ALL
  SELECT rn, {len(KINDS)}, 'live:' || CAST(start AS VARCHAR) || ':' || CAST(start + len AS VARCHAR), start, true, few, looks FROM j WHERE few AND looks),
a AS (
  SELECT rn, string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE NOT extra) AS base,
    (SELECT string_agg(u.span, ',' ORDER BY u.start, u.rank) FROM (SELECT DISTINCT rn, span, start, rank FROM s) u WHERE u.rn = s.rn) AS spans,
    count(*) FILTER (WHERE NOT extra AND few AND looks) AS n_live, count(*) FILTER (WHERE NOT extra AND NOT few) AS n_example,
    count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex
  FROM s GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN a USING (rn)
"""


NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT len(e) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
u AS (SELECT v.* FROM v, n WHERE len(e) = n.n),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM u q, u c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


#: Every window by its digest, flagged windows to spans, spans cut out.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT rn, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT rn, i, md5(b[i:i + 199]) AS h FROM n, LATERAL (SELECT unnest(range(1, n - 198)) AS i) r WHERE n >= 200),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT rn, i AS a FROM w SEMI JOIN r USING (h)),
g AS (SELECT rn, a, CASE WHEN a > lag(a) OVER (PARTITION BY rn ORDER BY a) + 200 THEN 1 ELSE 0 END AS fresh FROM s),
k AS (SELECT rn, a, sum(fresh) OVER (PARTITION BY rn ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM g),
x AS (SELECT rn, min(a) AS a, max(a) + 199 AS z FROM k GROUP BY rn, k),
l AS (SELECT rn, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends, sum(z - a + 1) AS gone FROM x GROUP BY rn)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(starts), 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN starts IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(starts) + 1),
    lambda j: b[(CASE WHEN j = 0 THEN 1 ELSE ends[j] + 1 END):(CASE WHEN j = len(starts) THEN n ELSE starts[j + 1] - 1 END)]), lambda p, q: p || q) END) AS kept_sha256
FROM n LEFT JOIN l USING (rn)
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))),
    lambda a, b: xor(a >> 4, [{_crc_table()}][(xor(a, b) & 15) + 1])), 4294967295::BIGINT)"""


#: Near words by the strings around each place, chains of forms by recursion.
VARIANTS = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]{{6,}}')) AS w FROM documents),
seeded AS (SELECT w, count(*) AS n, {_crc_sql("id || w")} AS h FROM runs GROUP BY id, w),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM seeded),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i) u),
near AS (
  SELECT x.word, y.word AS v, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON y.word = x.a || x.z
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON y.word = x.a || x.z),
best AS (SELECT word, count(*) AS n_near, list(v ORDER BY m DESC, v)[1] AS v, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN v END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS place FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.place AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed last ON last.word = c.place AND last.form IS NULL
"""

#: Base 32 of a hex digest: its bits, five at a time.
_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
_FIVES = ", ".join(f"'{i:05b}'" for i in range(32))
WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: [{_BITS}][strpos('0123456789abcdef', c)]), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_position([{_FIVES}], substr(bits, i * 5 + 1, 5)) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN least END AS refers_to
FROM b
"""

#: Every kept term of every group, without occurrences too.
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
found AS (SELECT rn, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT rn) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS HUGEINT) AS p FROM grid WINDOW s AS (PARTITION BY lang, source)),
q AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) WINDOW s AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING, "op2_secret_scan": SECRETS, "op4_source_mixing": MIXING, "op6_repeated_bytes": REPEATS, "op10_neighbours": NEIGHBOURS, "op11_spelling_variants": VARIANTS, "op12_warc": WARC, "op13_source_divergence": DIVERGENCE}
