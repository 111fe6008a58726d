"""The same results in DuckDB SQL, where SQL can express the method."""

MIX = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
    least(4096, greatest(1, (CAST(sum(size) AS BIGINT) + 1999999) // 2000000)) AS n_shards FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
levels AS (
  SELECT 2 * words / weight AS stops,
    (1.5::DOUBLE * (SELECT sum(words) FROM sources) - coalesce(sum(2 * words) OVER before, 0))
      / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY 2 * words / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT *, least(CAST(2 * words AS DOUBLE), weight * (SELECT level FROM levels WHERE level <= stops ORDER BY stops, level LIMIT 1)) AS target
  FROM weighed),
placed AS (
  SELECT s.*, a.words AS source_size, a.target, a.place, CAST('0x' || key[:8] AS BIGINT) % n_shards AS shard
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
shards AS (
  SELECT place, any_value(source) AS source, shard, CAST(sum(size) AS BIGINT) AS words,
    CASE WHEN sum(size) > 0 THEN greatest(1, (2 * CAST(sum(size) AS BIGINT) + 64) // 128) ELSE 0 END AS blocks
  FROM placed GROUP BY place, shard),
ideals AS (
  SELECT a.place, sum(blocks) AS blocks, CASE WHEN any_value(a.words) > 0 THEN any_value(target) * sum(blocks) / any_value(a.words) ELSE 0 END AS ideal
  FROM aimed a JOIN shards s USING (place) GROUP BY a.place),
quotients AS (SELECT place, ideal / (2 * k - 1) AS quotient FROM ideals, range(1, CAST(2 * blocks + 1 AS BIGINT)) t(k) WHERE ideal > 0),
quotas AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place, row_number() OVER (ORDER BY quotient DESC, place) AS seat FROM quotients)
  WHERE seat <= floor((SELECT sum(ideal ORDER BY place) FROM ideals) + 0.5) GROUP BY place),
parts AS (
  SELECT place, shard, quotient, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard) AS seat, quota
  FROM (SELECT s.place, s.shard, quota, (CAST(quota * s.blocks AS DOUBLE) / i.blocks) / (2 * k - 1) AS quotient
    FROM shards s JOIN ideals i USING (place) JOIN quotas USING (place), range(1, CAST(2 * s.blocks + 1 AS BIGINT)) t(k))),
dealt AS (SELECT place, shard, count(*) AS seats FROM parts WHERE seat <= quota GROUP BY place, shard),
runs AS (
  SELECT s.place, s.shard, s.words, s.blocks AS b, coalesce(seats, 0) // greatest(s.blocks, 1) AS whole,
    coalesce(seats, 0) % greatest(s.blocks, 1) AS extra,
    CAST('0x' || md5('mix|' || coalesce(source, '') || '|' || shard)[:8] AS BIGINT) % greatest(s.blocks, 1) AS first
  FROM shards s LEFT JOIN dealt USING (place, shard)),
spans AS (
  SELECT *, first * words // greatest(b, 1) AS low1, least(first + extra, b) * words // greatest(b, 1) AS high1,
    greatest(0, first + extra - b) * words // greatest(b, 1) AS high2 FROM runs),
streamed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(whole * size + greatest(0, least(stop, high1) - greatest(stop - size, low1))
    + greatest(0, least(stop, high2) - (stop - size)) AS BIGINT) AS taken
FROM streamed JOIN spans USING (place, shard)"""

BACKOFF = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (
  SELECT id, len(w) AS m, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
own1 AS (SELECT id, c, count(*) AS n FROM places GROUP BY ALL),
own2 AS (SELECT id, b, c, count(*) AS n FROM places WHERE b IS NOT NULL GROUP BY ALL),
own3 AS (SELECT id, a, b, c, count(*) AS n FROM places WHERE a IS NOT NULL GROUP BY ALL),
else1 AS (SELECT id, c, sum(n) OVER (PARTITION BY c) - n AS n FROM own1),
else2 AS (SELECT id, b, c, sum(n) OVER (PARTITION BY b, c) - n AS n FROM own2),
else3 AS (SELECT id, a, b, c, sum(n) OVER (PARTITION BY a, b, c) - n AS n FROM own3),
scored AS (
  SELECT p.id, sum(CASE
    WHEN abc.n > 0 THEN ln(abc.n / ab.n)
    WHEN bc.n > 0 THEN ln(bc.n / b.n) + (least(i, 3) - 2) * ln(0.4::DOUBLE)
    WHEN c.n > 0 THEN ln(c.n / greatest((SELECT count(*) FROM places) - m, 1)) + (least(i, 3) - 1) * ln(0.4::DOUBLE)
    ELSE ln(1 / greatest((SELECT count(*) FROM places) - m, 1)) + least(i, 3) * ln(0.4::DOUBLE) END) AS score
  FROM places p
  LEFT JOIN else3 abc ON abc.id = p.id AND abc.a = p.a AND abc.b = p.b AND abc.c = p.c
  LEFT JOIN else2 ab ON ab.id = p.id AND ab.b = p.a AND ab.c = p.b
  LEFT JOIN else2 bc ON bc.id = p.id AND bc.b = p.b AND bc.c = p.c
  LEFT JOIN else1 b ON b.id = p.id AND b.c = p.b
  LEFT JOIN else1 c ON c.id = p.id AND c.c = p.c
  GROUP BY p.id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS score, round(score / nullif(len(w), 0), 6) AS per_word
FROM texts LEFT JOIN scored USING (id)"""

MIDDLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS b,
    CAST('0x' || d[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || d[25:32] AS BIGINT) % 100 AS h4 FROM texts),
cuts AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
pieces AS (SELECT *, left(t, p) AS prefix, substring(t, p + 1, m) AS middle, substring(t, p + m + 1) AS suffix FROM cuts),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM pieces)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM made"""

HARD_NEGATIVES = """
WITH clean AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
near AS (
  SELECT a.vec_id AS anchor_id, a.label, a.v, p.vec_id AS positive_id,
    CAST(list_dot_product(a.v, p.v) AS BIGINT) AS positive_score
  FROM clean a JOIN clean p ON a.label = p.label AND a.vec_id <> p.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM near
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) <= 5),
scored AS (
  SELECT a.vec_id AS anchor_id, n.vec_id AS negative_id, CAST(list_dot_product(a.v, n.v) AS BIGINT) AS negative_score
  FROM clean a JOIN clean n ON a.label <> n.label WHERE a.vec_id % 50 = 0),
windowed AS (
  SELECT anchor_id, positive_id, negative_id, positive_score, negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE 50 * positive_score <= 100 * negative_score AND 100 * negative_score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM windowed WHERE rank <= 3"""
