"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, text, '')) AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source),
state AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER r, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS weights
  FROM totals
  WINDOW r AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(struct_pack(l := remaining, w := weights), (cap / weight, source IS NULL, coalesce(source, ''))) AS first
  FROM state WHERE NOT weight * remaining > cap * weights),
shares AS (
  SELECT source, source_size,
    CASE WHEN weight * remaining > cap * weights THEN cap
         ELSE least(weight * first.l / first.w, cap) END AS target
  FROM state, level),
ranked AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, floor(s.target + 0.5)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
    + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM ranked
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE len({_WORDS.format('text')}) > 0),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items)),
widths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, widths)),
hits AS (SELECT rid, item_id, s, spots.n FROM spots JOIN windows USING (n, words)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

# chr(92) is the backslash.  Control strings in the order in which the template escapes them.
_ESCAPED = "replace({0}, chr(92), chr(92) || chr(92))"
for _c in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

OP8 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM told
"""

# Base32 of the SHA-1: 40 hexadecimal digits to 160 bits, taken by fives.
OP2 = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
keepers AS (SELECT sha, payload_bytes, max(page_id) AS keeper FROM hashed GROUP BY ALL),
bits AS (
  SELECT sha, array_to_string(list_transform(range(1, 41), lambda i: format('{:04b}', instr('0123456789abcdef', sha[i]) - 1)), '') AS b
  FROM (SELECT DISTINCT sha FROM hashed)),
named AS (
  SELECT sha, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT, 1)), '') AS payload_digest
  FROM bits)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM hashed JOIN keepers USING (sha, payload_bytes) JOIN named USING (sha)
"""

OP5 = r"""
WITH used AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS r
  FROM used q JOIN used c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

# Shingles as texts, pairs by an inverted join, and all documents that links reach.
OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s
  FROM docs),
tokens AS (SELECT rid, len(s) AS n, unnest(s) AS h FROM sets),
pairs AS (SELECT a.rid AS x, b.rid AS y, any_value(a.n) + any_value(b.n) AS both_n, count(*) AS c FROM tokens a JOIN tokens b ON a.h = b.h AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 90 * (both_n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid, rid AS seen FROM sets UNION SELECT r.rid, e.y FROM reach r JOIN edges e ON r.seen = e.x)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets JOIN reach USING (rid) JOIN sets o ON o.rid = reach.seen GROUP BY sets.rid, sets.doc_id, len(sets.s)
"""

ORACLES = {"op1_mixing": OP1, "op3_jaccard": OP3, "op2_warc": OP2, "op5_topk": OP5, "op4_decontamination": OP4, "op8_chat": OP8}
