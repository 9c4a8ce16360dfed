"""SQL of the training-data queries that SQL can express, for another engine."""

from __future__ import annotations

from .jaccard import N, PERCENT
from .mixing import BLOCKS, F44, F45, LEAST_BLOCK, MAX_EPOCHS, MOST_BLOCK, MOST_SLOTS, WEIGHTS
from .sharding import N_SHARDS

WORDS = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {N - 1}], ' ') FOR i IN range(1, len(w) - {N - 2})] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)
), r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM d GROUP BY source
), c AS (
  SELECT *, {MAX_EPOCHS} * words AS cap, sum(words) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS w, coalesce(sum({MAX_EPOCHS} * words) OVER before, 0) AS used
  FROM s WINDOW before AS (ORDER BY {MAX_EPOCHS} * words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, words, least(CAST(cap AS DOUBLE), (SELECT max((total - used) / w) FROM c WHERE (total - used) / w * weight <= cap) * weight) AS target FROM c
), g AS (
  SELECT source, words, target, CAST(floor(target + 1e-6) AS BIGINT) AS quota FROM t
), n AS (
  SELECT greatest(total // {MOST_SLOTS}, least({MOST_BLOCK}, greatest({LEAST_BLOCK}, low // {BLOCKS})), 1) AS block, total, greatest(1, ceil(total / greatest(total // {MOST_SLOTS}, least({MOST_BLOCK}, greatest({LEAST_BLOCK}, low // {BLOCKS})), 1))) AS slots
  FROM (SELECT CAST(sum(quota) AS BIGINT) AS total, min(quota) AS low FROM g WHERE quota > 0)
), i AS (
  SELECT g.*, block, slots, CAST(sum(quota) OVER named AS BIGINT) AS hi, total FROM g, n WINDOW named AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)
), k AS (
  SELECT slot, slot % {F45} * {F44} % {F45} AS u FROM (SELECT unnest(range(CAST(slots AS BIGINT))) AS slot FROM n)
), hit AS (
  SELECT slot, source, words, block, block AS full_ FROM k JOIN i ON quota > 0 AND u >= ceil((hi - quota) / total * {F45}) AND u < ceil(hi / total * {F45})
), every AS (
  SELECT * FROM hit UNION ALL SELECT CAST(slots AS BIGINT), source, words, block, least(quota, block) FROM i WHERE quota > 0 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.source IS NOT DISTINCT FROM i.source)
), b AS (
  SELECT *, least(full_, {MAX_EPOCHS} * words - rank * block) AS length FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM every)
), e AS (SELECT source, max(rank * block + length) AS reach FROM b WHERE length > 0 GROUP BY source), o AS (
  SELECT d.*, g.words, g.target, coalesce(e.reach, 0) AS reach,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id || ':' || d.size), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, o.words AS source_size, target, o.source, CASE WHEN size > 0 THEN b.slot END AS first_slot,
  CAST({" + ".join(f"greatest(0, least(place + {e} * o.words + size, reach) - (place + {e} * o.words))" for e in range(MAX_EPOCHS))} AS BIGINT) AS taken
FROM o LEFT JOIN b ON b.source IS NOT DISTINCT FROM o.source AND b.rank = place // b.block AND b.length > 0 AND place < reach
"""

#: the checksum is a fold of the text's bytes over a table of 256 steps
SHARDS = f"""
WITH RECURSIVE b(v, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8
), steps AS (SELECT list(c ORDER BY v) AS t FROM b WHERE k = 8), d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || h[2 * i + 1 : 2 * i + 2]) AS BIGINT) FOR i IN range(len(h) // 2)]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), steps
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('shards:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d
), p AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1) / (2 * n), md5('shards:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * {N_SHARDS} // total AS INTEGER) AS shard,
  CAST(p - (p * {N_SHARDS} // total * total + {N_SHARDS - 1}) // {N_SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""
