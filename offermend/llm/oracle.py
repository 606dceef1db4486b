"""DuckDB SQL for the operators that SQL can express."""

SPACE = r"[\x20\x09-\x0D]"

EXACT_DEDUP = rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""

#: The same apportionment by enumeration: every party's quotients are listed and the highest taken.
MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM sized GROUP BY source),
weighed AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, (2 * source_size)::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, docs, ordinal, least(cap, max(level) OVER () * w) AS target FROM levels),
seats AS (SELECT round(sum(target) / 16)::BIGINT AS m FROM targets),
quotients AS (
  SELECT ordinal, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, ordinal, k) AS place
  FROM targets, unnest(range(0, (target / 16)::BIGINT + 40)) AS u(k) WHERE target > 0),
quotas AS (SELECT ordinal, count(*) AS quota FROM quotients, seats WHERE place <= m GROUP BY ordinal),
plan AS (SELECT t.*, coalesce(quota, 0) AS quota, ceil(docs / 256.0)::BIGINT AS shards FROM targets t LEFT JOIN quotas q USING (ordinal)),
dealt AS (
  SELECT d.doc_id, d.size, d.h, p.source_size, p.target, p.ordinal, p.quota, ('0x' || substr(d.h, 1, 8))::BIGINT % p.shards AS shard
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
sums AS (SELECT ordinal, shard, quota, sum(size)::DOUBLE AS words FROM dealt GROUP BY ALL),
shares AS (
  SELECT ordinal, shard, row_number() OVER (PARTITION BY ordinal ORDER BY words / (2 * k + 1) DESC, shard, k) AS place, quota
  FROM sums, unnest(range(0, (3 * words / 16)::BIGINT + 40)) AS u(k) WHERE words > 0),
won AS (SELECT ordinal, shard, count(*) AS seats FROM shares WHERE place <= quota GROUP BY ALL),
blocks AS (
  SELECT s.ordinal, s.shard, ceil(words / 16)::BIGINT AS blocks, least(coalesce(seats, 0), 2 * ceil(words / 16)::BIGINT) AS seats
  FROM sums s LEFT JOIN won USING (ordinal, shard)),
runs AS (
  SELECT *, CASE WHEN blocks > 0 THEN seats // blocks ELSE 0 END AS copies,
    ('0x' || substr(md5('mix-1:' || ordinal || ':' || shard), 1, 8))::BIGINT % greatest(blocks, 1) AS first_block FROM blocks),
placed AS (
  SELECT d.*, r.copies, r.blocks * 16 AS span, r.first_block * 16 AS low, (r.first_block + r.seats - r.copies * r.blocks) * 16 AS high,
    sum(d.size) OVER (PARTITION BY d.ordinal, d.shard ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM dealt d JOIN runs r USING (ordinal, shard))
SELECT doc_id, size, source_size, target,
  (copies * size + greatest(0, least(high - pos, size)) - greatest(0, least(low - pos, size)) + greatest(0, least(high - span - pos, size)))::BIGINT AS taken
FROM placed
"""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on,
    regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+(?::[0-9]*)?/([^/?#]+)', 1) AS seg FROM pages),
pages_k AS (
  SELECT page_id, fetched_on, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, CASE WHEN seg <> '' THEN host || '/' || seg ELSE '' END AS path FROM parts),
keys AS (
  SELECT page_id, fetched_on, 'domain' AS kind, 1 AS rank, domain AS key FROM pages_k
  UNION ALL SELECT page_id, fetched_on, 'host', 2, host FROM pages_k
  UNION ALL SELECT page_id, fetched_on, 'path', 3, path FROM pages_k),
listed AS (SELECT *, md5(kind || ':' || key) AS h FROM (SELECT DISTINCT kind, key FROM keys WHERE key <> '')),
dated AS (
  SELECT kind, key, ('0x' || substr(h, 9, 4))::INTEGER % 3 AS a, DATE '2024-01-01' + ('0x' || substr(h, 5, 4))::INTEGER % 300 AS d,
    ('0x' || substr(h, 13, 4))::INTEGER % 120 + 1 AS lift, ('0x' || substr(h, 17, 4))::INTEGER % 200 + 122 AS again
  FROM listed WHERE ('0x' || substr(h, 1, 4))::INTEGER % 4 = 0),
spells AS (
  SELECT kind, key, CASE WHEN a = 0 THEN 'allow' ELSE 'block' END AS verdict, d AS since, d + lift AS until FROM dated
  UNION ALL SELECT kind, key, 'block', d + again, NULL FROM dated),
hits AS (
  SELECT k.page_id, s.kind, s.key, s.verdict, s.since, row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC) AS place
  FROM keys k JOIN spells s ON k.kind = s.kind AND k.key = s.key AND k.fetched_on >= s.since AND (s.until IS NULL OR k.fetched_on < s.until))
SELECT p.page_id, p.fetched_on, p.host, CASE WHEN h.verdict = 'block' THEN 'block' ELSE 'keep' END AS verdict, h.kind AS matched_kind, h.key AS matched_key, h.since AS listed_since
FROM pages_k p LEFT JOIN hits h ON p.page_id = h.page_id AND h.place = 1
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owned AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(o.owner <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN owned o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut
), totals AS (
  SELECT lang, count(*) AS n FROM starts GROUP BY lang
), counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM counts WHERE k > 1
), marks AS (
  SELECT c.lang, c.phrase, c.k, c.f, c.j, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_phrases AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[s:s + n - 1], ' ') AS phrase, c.f, n
  FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 2) c, (SELECT unnest([2, 3, 4]) AS n), (SELECT unnest([1, 2, 3, 4]) AS s)
  WHERE n < k AND s + n - 1 <= k
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = x.lang AND i.phrase = x.phrase AND 100 * i.f >= 100 * x.f)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(phrase)) AS rank, phrase, f AS a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
