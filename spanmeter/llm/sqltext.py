"""SQL for the operators which SQL can express, written another way than the operators."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT e.b, p.r FROM reach p JOIN edges e ON e.a = p.id WHERE p.r < e.b),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept
FROM documents d JOIN least l ON l.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

LINE_QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g
  FROM w WHERE len(w) >= 3),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows)
          WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
lines AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols
  FROM split),
judged AS (
  SELECT *, symbols * 100 > chars * 10
    OR (n >= 4 AND NOT regexp_matches(line, '[.!?…。！？:;]([''")\]»”’]*)[\x20\x09-\x0D]*$'))
    OR (n <= 8 AND regexp_matches(line, '(?i)^[\x20\x09-\x0D>|*-]*(home|menu|next|previous|prev|back|back to top|skip to (main )?content|login|log in|sign in|sign up|register|subscribe|share|print|search|read more|contact us|sitemap)([\x20\x09-\x0D>|*-]|$)'))
    OR (n <= 30 AND regexp_matches(line, '(?i)(all rights reserved|is licensed under|^licensed under|^released under|terms of (use|service)|privacy policy|cookie policy|we use cookies|enable javascript|copyright (\(c\)|©)|lorem ipsum)'))
    OR (n >= 4 AND regexp_matches(line, '^[^a-z]*[A-Z][^a-z]*[A-Z]{3}[^a-z]*$'))
    OR regexp_matches(line, '!!+[\x20\x09-\x0D]*$') AS failed
  FROM lines WHERE n > 0),
sums AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (failed) AS failed,
         coalesce(sum(chars) FILTER (failed), 0) AS lost
  FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(s.dups, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(s.failed, 0)::BIGINT AS n_failed_lines, coalesce(s.lost, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN sums s USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars * 100 <= word_chars * 40 AS kept
FROM base
"""

NEAR_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings
  UNION SELECT e.b, p.r FROM reach p JOIN linked e ON e.a = p.id WHERE p.r < e.b),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, l.c AS component_id, e.vec_id = l.c AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN counts n ON n.id = e.vec_id
"""

EXACT_DUPLICATES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g USING (t)
"""

RESAMPLED = r"""
WITH steps AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
  FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 'raw' AS kind, doc_id AS id, text FROM documents
        UNION ALL SELECT 'target', item_id, text FROM benchmark)),
single AS (SELECT kind, id, unnest(w) AS word FROM w),
bytes AS (
  SELECT word, list_transform(range(0, octet_length(encode(word))),
      lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM single)),
hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], b),
      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, steps),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 'raw') AS s, count(*) FILTER (kind = 'target') AS t
  FROM single JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((c.t + 1) * (a.s + 10000))::DOUBLE / ((c.s + 1) * (a.t + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts c, sums a),
means AS (
  SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM single JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'raw' GROUP BY id),
scored AS (
  SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight,
         coalesce(m.weight, 0)::BIGINT + floor(-1000 * ln(-ln(
             (('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN means m ON m.id = d.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS want
           FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN p.r <= p.want THEN p.r END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""


def _clusters(rounds: int) -> str:
    """Each round is a statement of its own over the one before: distances, nearest, floored means."""
    ctes = [r"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (
    SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8))"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (
  SELECT r, vec_id, x, d.least AS distance, d.c AS cluster FROM (
    SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x,
           min(struct_pack(least := list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - q.x[i]) * (v.x[i] - q.x[i])))::BIGINT,
                           c := q.c)) AS d
    FROM v, c{k} q GROUP BY v.r))""")
        if k < rounds:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT q.c, coalesce(m.x, q.x) AS x FROM c{k} q LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS x FROM (
      SELECT cluster, i, ((sum(x[i])::BIGINT - (sum(x[i])::BIGINT % count(*) + count(*)) % count(*)) // count(*)) AS m
      FROM a{k}, range(1, 65) p(i) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = q.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(q.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} q ON q.c = a.cluster
"""


CLUSTERS = _clusters(10)
