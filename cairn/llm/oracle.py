"""The registered queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
#: DuckDB's lower() also changes letters beyond A-Z.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(s) AS n, array_to_string(s, ' ') AS s FROM (
    SELECT item_id, w[k:k + 9] AS s FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, k, sizes.n AS n, array_to_string(w[k:k + sizes.n - 1], ' ') AS s
  FROM doc, sizes, unnest(range(1, len(w) - sizes.n + 2)) t(k)),
hit AS (SELECT place.doc_id, place.k, place.n, win.item_id FROM place JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP6 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') || CASE WHEN len(w) < 5 THEN ' ' || len(w) ELSE '' END AS s
  FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(k) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)"""

#: The schedule covers each source's stream up to its rounded target, so the words taken follow from
#: the stream alone.
_OP5 = f"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM doc GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM src),
ranked AS (
  SELECT *, row_number() OVER by_need AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (by_need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (by_need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed WINDOW by_need AS (ORDER BY cap / weight, source IS NULL, source)),
free AS (SELECT min(place) AS place, min_by(rate, place) AS rate FROM ranked WHERE rate * weight < cap),
plan AS (
  SELECT source, source_size, CASE WHEN ranked.place >= free.place THEN free.rate * weight ELSE cap::DOUBLE END AS target
  FROM ranked, free),
stream AS (
  SELECT doc.*, source_size, target, (coalesce(sum(size) OVER (PARTITION BY doc.source
      ORDER BY md5(concat_ws(':', '5', doc.source, doc_id::VARCHAR, size::VARCHAR))
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first
  FROM doc JOIN plan ON doc.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, round(target)::BIGINT - first)) + greatest(0, least(size, round(target)::BIGINT - source_size - first))
   + greatest(0, least(size, round(target)::BIGINT - 2 * source_size - first)))::BIGINT AS taken
FROM stream"""

_OP8 = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS s FROM doc, unnest(range(0, len(h) // 2 - 49)) t(p)),
early AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM win JOIN early USING (s) WHERE first < doc_id),
run AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM (
    SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (
  SELECT doc_id, n, min(p) AS a, max(p) + 50 AS b, coalesce(lag(max(p) + 50) OVER (PARTITION BY doc_id ORDER BY n), 0) AS before
  FROM run GROUP BY doc_id, n),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM span JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)"""

#: crc32 (unsigned) of the ASCII text in {0}, bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(
  list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: 0::UBIGINT)),
    lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))::BIGINT"""

#: Every prefix of a rebuilt conversation is a list of its turns' digests.
_OP11 = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS own, n, turn FROM conv c JOIN turns b ON b.conv_id = c.base AND b.n <= c.h
  UNION ALL SELECT c.conv_id, 1, n, turn FROM conv c JOIN turns o ON o.conv_id = c.conv_id AND o.n > c.h),
rebuilt AS (SELECT conv_id, list(turn ORDER BY own, n) AS s FROM parts GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(s, []) AS s FROM conv LEFT JOIN rebuilt USING (conv_id)),
path AS (SELECT conv_id, d, len(s) AS n, s[1:d] AS key, s[1:d - 1] AS up, s[d].t AS last FROM whole, unnest(range(len(s) + 1)) u(d)),
node AS (
  SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM path GROUP BY key, d),
kids AS (SELECT up AS key, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up, d),
full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * octet_length(encode(coalesce(last, ''))) AS own FROM node LEFT JOIN kids USING (key, d)),
below AS (
  SELECT key[1:a] AS key, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM full_node, unnest(range(d + 1)) u(a) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below USING (key, d) LEFT JOIN node up ON up.key = f.up AND up.d = f.d - 1"""

_OP12 = (_OP6.replace("w[k:k + 4]", "w[k:k + 2]").replace("len(w) < 5", "len(w) < 3").replace("len(w) - 4", "len(w) - 2")
         .replace(">= 85 *", ">= 90 *").replace(", doc_id = component_id AS kept", ""))

#: Equal words on one diagonal; of the periods of one stretch the smallest counts.
_OP13 = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
tail AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h FROM doc),
word AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] AS s
  FROM tail, unnest(range(n)) t(i)),
cell AS (
  SELECT x.doc_id, x.i - y.i AS q, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i > y.i
  WHERE 4 * (x.i - y.i) <= x.n),
diagonal AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM cell) GROUP BY doc_id, q, k),
run AS (
  SELECT doc_id, start, length, min(q) AS period FROM diagonal WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS top,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(start + period, start + length)) t(i)),
kept AS (
  SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period,
  (1000 * top.l // top.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(words, '')) AS collapsed_sha256
FROM doc LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def all_oracles() -> dict[str, str]:
    return {"op1_benchmark_decontamination": _OP1, "op5_source_mixing": _OP5, "op6_minhash_near_dedup": _OP6,
            "op8_suffix_array_dedup": _OP8, "op11_conversation_prefix_trie": _OP11,
            "op12_ngram_jaccard_join": _OP12, "op13_periodic_runs": _OP13}
