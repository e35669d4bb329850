"""DuckDB SQL with the same rows as the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT u, v FROM link UNION ALL SELECT v, u FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.v, r.root FROM reach r JOIN both_ways e ON e.u = r.node
), least_root AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, doc_id = root AS kept
FROM documents JOIN least_root ON node = doc_id LEFT JOIN n USING (doc_id)
"""

TOP_K = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> {n}) & 31 AS INTEGER) + 1, 1)"
_BASE32 = " || ".join(_DIGIT.format(n=n) for n in (15, 10, 5, 0))

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(
    list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)), lambda x: {_BASE32}), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_W = r"[^\x20\x09-\x0D]+"

RULES_BASE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l
  FROM documents
), x AS (
  SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d
), y AS (
  SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), z AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM y WHERE c IS NOT NULL
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM z, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN r USING (doc_id)
"""

#: The checksum of a number's digits, bit by bit: a byte is taken in, then eight steps follow (-1 each).
_STEP = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
_DIGITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
CRC32 = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_DIGITS}), {_STEP}), 4294967295)"

LM_BASE = rf"""
WITH d AS (
  SELECT doc_id, {CRC32} % 7 = 2 AS held_out, regexp_extract_all(coalesce({_LOWER}, ''), '{_W}') AS w FROM documents
), x AS (
  SELECT doc_id, held_out, unnest(w) AS a FROM d
), c AS (
  SELECT a, count(*) AS n FROM x WHERE NOT held_out GROUP BY a
), e AS (
  SELECT count(*) AS ends FROM d WHERE NOT held_out
), s AS (
  SELECT ends, ends + (SELECT sum(n) FROM c) AS tokens, (SELECT count(*) FROM c) + 1 AS kinds FROM e
), p AS (
  SELECT doc_id, sum(log10((coalesce(n, 0) + 1) / CAST(tokens + kinds + 1 AS DOUBLE))) AS b, count(n) AS k FROM x LEFT JOIN c USING (a), s GROUP BY doc_id
)
SELECT doc_id, held_out, CAST(len(w) + 1 AS BIGINT) AS n_tokens, coalesce(k, 0) + 1 AS n_known, CAST(tokens AS BIGINT) AS train_tokens,
  round(coalesce(b, 0) + log10((ends + 1) / CAST(tokens + kinds + 1 AS DOUBLE)), 5) AS base_score
FROM d LEFT JOIN p USING (doc_id), s
"""

SHARD_LAYOUT = "SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, true AS in_a_shard, true AS gapless FROM documents"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, 2 * CAST(source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * w) AS target FROM l
), b AS (
  SELECT *, CAST(floor(target + CAST(0.5 AS DOUBLE)) AS BIGINT) AS budget FROM t
), p AS (
  SELECT d.doc_id, d.size, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM p
"""

HARD_NEGATIVES = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM t a JOIN t c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), r AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""

#: The checksum of the bytes of a text, given as a list of numbers: a byte is taken in, then eight steps follow (-1 each).
_BYTES_CRC32 = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(bytes, lambda c: [c, -1, -1, -1, -1, -1, -1, -1, -1]))), {_STEP}), 4294967295)"

SPELLING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[a-z\x{{C0}}-\x{{FF}}]+') AS w FROM documents
), o AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM (SELECT doc_id, unnest(w) AS run FROM d) WHERE length(run) >= 5 GROUP BY doc_id, run
), b AS (
  SELECT run, k, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bytes FROM o
), h AS (
  SELECT run, k, {_BYTES_CRC32} AS h FROM b
), c AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, k FROM h
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), e AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i + 2 AS INTEGER)) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)
), y AS (
  SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.less = v.word
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.less = v.word
), z AS (
  SELECT word, count(*) AS n_near FROM y GROUP BY word
), f AS (
  SELECT y.word, near AS form, y.n AS form_n FROM y JOIN v USING (word) WHERE y.n >= 2 * v.n
  QUALIFY y.n = max(y.n) OVER (PARTITION BY y.word) AND row_number() OVER (PARTITION BY y.word ORDER BY y.n DESC, near) = 1
), r AS (
  SELECT word, word AS root FROM v UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root
), l AS (
  SELECT word, root FROM r WHERE root NOT IN (SELECT word FROM f)
)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM v JOIN l USING (word) LEFT JOIN z USING (word) LEFT JOIN f USING (word)
"""

SHARD_GROUPS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size FROM documents),
g AS (SELECT doc_id, count(*) OVER t AS n, sum(size) OVER t AS bytes, sum(size) OVER () AS total FROM d WINDOW t AS (PARTITION BY text))
SELECT doc_id, CASE WHEN bytes * 24 <= total THEN n END AS together, CAST(bytes AS BIGINT) AS bytes FROM g
"""
