"""DuckDB SQL of the queries over resampling, licenses and conversations."""

from __future__ import annotations

from latewin.llm.licenses import PHRASES, TEMPLATES, make_templates
from latewin.llm.resampling import Resampling

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (
    rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

#: CRC-32 has no function of its own: its table of 256 remainders, and a fold over the bytes.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab
)"""


def _crc32(text: str) -> str:
    raw = f"hex(encode({text}))"
    octets = (
        f"list_transform(range(length({raw}) // 2),"
        f" lambda i: ('0x' || substr({raw}, i * 2 + 1, 2))::BIGINT)"
    )
    folded = (
        f"list_reduce(list_prepend(4294967295::BIGINT, {octets}),"
        " lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"
    )
    return f"xor({folded}, 4294967295::BIGINT)"


_R = Resampling()
RESAMPLING_SQL = f"""
WITH {_CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), w AS (SELECT r, unnest(words) AS word FROM d),
b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (
  SELECT word, {_crc32("word")} % {_R.buckets} AS bucket
  FROM (SELECT word FROM w UNION SELECT word FROM b), crc
), s AS (SELECT bucket, count(*) AS n FROM w JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS held,
             (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS wanted),
g AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (held + {_R.buckets}))
    / ((s.n + 1)::DOUBLE * (wanted + {_R.buckets}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), z
), m AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY r
), e AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || sha256('{_R.seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM d LEFT JOIN m USING (r)
), x AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0)))::BIGINT AS score FROM e
), p AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER () * {_R.percent} // 100 AS drawn
  FROM x WHERE n_features >= {_R.least_words}
)
SELECT x.doc_id, x.n_features, x.weight, x.score, p.place AS rank
FROM x LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.place <= p.drawn
"""


def _license_sql() -> str:
    made = make_templates()
    words = ", ".join(
        f"({k}, '{t.label}', {len(t.words)}, {t.least}, {len(set(t.words))}, '{w.decode()}')"
        for k, t in enumerate(made[: len(TEMPLATES)])
        for w in sorted(set(t.words))
    )
    phrases = ", ".join(f"('{label}', '{text}', {len(text.split())})" for label, text in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
t(k, label, size, least, m, word) AS (VALUES {words}),
h AS (
  SELECT r, k, label, size, least, m,
    count(DISTINCT word) OVER (PARTITION BY r, k ORDER BY pos
      RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS inside
  FROM w JOIN t USING (word)
), b AS (
  SELECT r, list(DISTINCT label) AS own, max(inside / m) AS best FROM h WHERE inside >= least GROUP BY r
), f(label, phrase, size) AS (VALUES {phrases}), c AS (
  SELECT r, label, pos FROM (
    SELECT r, pos, label, phrase, array_to_string(words[pos + 1 : pos + size], ' ') AS here
    FROM w JOIN d USING (r), f
  ) WHERE here = phrase
), p AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
    list(DISTINCT label) AS base FROM c GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',')
    AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN p USING (r)
"""


LICENSE_SQL = _license_sql()

TRIE_SQL = f"""
WITH {_CRC_TABLE}, t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) - 1 AS pos,
    sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS turn_sha,
    octet_length(encode(coalesce(text, '')))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc
), u AS (
  SELECT c.conv_id, pos, turn_sha, bytes FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos < h
  UNION ALL SELECT c.conv_id, pos, turn_sha, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
), q AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(turn_sha, '') OVER o AS path, bytes
  FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), e AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (
    SELECT conv_id, max(path) AS path FROM q GROUP BY conv_id) GROUP BY path
), n AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes
  FROM q GROUP BY path
), k AS (
  SELECT path[1 : (depth - 1) * 64] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), l AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)
), s AS (
  SELECT path[1 : up * 64] AS path, sum((n_children = 0)::BIGINT) AS n_leaves,
    sum((n_convs - 1) * bytes) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM l) GROUP BY 1
)
SELECT l.conv_id, l.depth, a.conv_id AS parent_conv_id, l.n_convs, l.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM l JOIN s USING (path) LEFT JOIN e USING (path)
LEFT JOIN n a ON l.depth > 0 AND a.path = l.path[1 : (l.depth - 1) * 64]
"""

SQL = {
    "op11_resampling": RESAMPLING_SQL,
    "op12_licenses": LICENSE_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
