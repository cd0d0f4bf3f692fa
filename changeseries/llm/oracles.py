"""DuckDB SQL for the registered queries of this package that SQL can express."""

from __future__ import annotations

import functools

from changeseries.llm.mixing import MAX_EPOCHS, SEED
from changeseries.llm.quality import STOP_WORDS
from changeseries.llm.secrets import BASE_KINDS, FURTHER_KINDS, MAX_OWNERS, MAX_REPOSITORIES
from changeseries.llm.url_filters import PATTERN_RULES, compile_pattern


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_PATTERNS = ",\n".join(
    f"({_text(rule)}, {_text(regex)}, {exception})" for rule in PATTERN_RULES for regex, exception, _ in [compile_pattern(rule)]
)

OP1 = rf"""
WITH patterns(pattern, regex, exception) AS (VALUES {_PATTERNS}),
parts AS (
  SELECT page_id, url, strpos(url, '://') AS scheme_end,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, url, coalesce({_lower("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split),
hits AS (
  SELECT url, bool_or(exception) AS exception, min(pattern) AS blocking,
         min(pattern) FILTER (WHERE exception) AS allowing
  FROM (SELECT DISTINCT coalesce(url, '') AS url FROM pages) JOIN patterns
    ON regexp_matches({_lower("url")}, regex) GROUP BY url)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN hits.url IS NULL OR exception THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN coalesce(allowing, blocking) END AS pattern
FROM ruled LEFT JOIN hits ON coalesce(ruled.url, '') = hits.url
"""

OP2 = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM base)),
repeated AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS place FROM repeated WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT base.doc_id, lang, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda x: {_lower("x")} IN ({", ".join(map(_text, dict.fromkeys(STOP_WORDS)))}))) AS n_stop,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
    len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•‣▪]\s'))) AS n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses
  FROM base LEFT JOIN covered ON base.doc_id = covered.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars BETWEEN 2.0 * n_words AND 15.0 * n_words
    AND n_symbols / n_words <= 0.1
    AND (n_words < 60 OR n_stop / n_words >= 0.03 OR coalesce(lang NOT IN ('en', 'fr', 'de', 'es'), FALSE))
    AND n_dup_lines / n_lines <= 0.5
    AND (n_words < 60 OR n_bullets / n_lines <= 0.9)
    AND n_ellipses / n_lines <= 0.3
    AND n_capitals / word_chars <= 0.4
    AND n_exclamations / n_words <= 0.25 AS kept
FROM judged
"""

OP3 = rf"""
WITH base AS (SELECT doc_id, {WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM base)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
covered AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, i + unnest(range(0, 13)) AS place FROM windows JOIN firsts USING (w) WHERE doc_id > first) GROUP BY doc_id)
SELECT base.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(places, []), i)), ' ')) AS kept_sha256
FROM base LEFT JOIN covered ON base.doc_id = covered.doc_id
"""

OP5 = rf"""
WITH sizes AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS queued FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sizes GROUP BY source),
vessels AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, {MAX_EPOCHS} * source_size / weight AS height,
         (sum(source_size) OVER ())::BIGINT AS budget FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER lower, 0))::BIGINT / (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0))::BIGINT AS level,
         coalesce(sum(cap) OVER lower, 0) AS full_caps
  FROM vessels WINDOW lower AS (ORDER BY height, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, least(cap::DOUBLE, (SELECT level FROM levels WHERE level <= height ORDER BY height, full_caps LIMIT 1) * weight) AS target FROM levels),
queued AS (
  SELECT doc_id, sizes.source, size, queued, source_size, weight, budget, coalesce(target, 0.0) AS target,
    sum(size) OVER (PARTITION BY sizes.source ORDER BY queued, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
entries AS (
  SELECT *, (epoch * source_size + through)::BIGINT / weight AS finish FROM queued, unnest(range(0, {MAX_EPOCHS})) e(epoch)),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, queued, doc_id, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent
  FROM entries WHERE size > 0),
cut AS (SELECT finish, queued FROM served WHERE spent - size / 2 <= budget ORDER BY finish DESC, queued DESC LIMIT 1),
taken AS (
  SELECT doc_id, any_value(source) AS source, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
    (any_value(size) * count(*) FILTER (WHERE (finish, queued) <= (SELECT (finish, queued) FROM cut)))::BIGINT AS taken
  FROM entries GROUP BY doc_id)
SELECT doc_id, size, source_size, target, taken, source FROM taken
"""


def _kind_spans(kind, rank: int) -> str:
    pattern = kind.pattern.replace("(?<![0-9a-f])", "")
    needs = "".join(f" AND regexp_matches(value, {_text(n)})" for n in kind.needs)
    return rf"""
  SELECT doc_id, {rank} AS rank, {_text(kind.name)} AS kind, start, start + length(matched) AS stop, value FROM (
    SELECT doc_id, matched, value,
      (sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(matched)) OVER (
         PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
    FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS matched, unnest(v) AS value, unnest(list_slice(g, 1, len(m))) AS gap
      FROM (SELECT doc_id, regexp_extract_all(text, {_text(pattern)}, 0) AS m, regexp_extract_all(text, {_text(pattern)}, {kind.value_group}) AS v,
                   regexp_split_to_array(text, {_text(pattern)}) AS g FROM documents)))
  WHERE length(value) >= {kind.shortest}{needs}"""


_SPANS = " UNION ALL ".join(_kind_spans(kind, rank) for rank, kind in enumerate(BASE_KINDS + FURTHER_KINDS))

OP6 = rf"""
WITH spans AS ({_SPANS}),
base AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
    count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS listed
  FROM spans WHERE rank < {len(BASE_KINDS)} GROUP BY doc_id),
owners AS (
  SELECT value, count(DISTINCT coalesce(source, '')) AS n, count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) AS repositories
  FROM spans JOIN documents USING (doc_id) GROUP BY value),
shown AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans s JOIN owners USING (value)
  WHERE rank < {len(BASE_KINDS)} OR ((n = 1 OR (n <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES})) AND NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.rank < {len(BASE_KINDS)} AND b.start <= s.start AND s.stop <= b.stop))
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(shown.spans, '') AS spans
FROM documents d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN shown ON d.doc_id = shown.doc_id
"""

_HEX_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
_BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP8 = rf"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: [{_HEX_BITS}][strpos('0123456789abcdef', sha1(payload)[i])]), '') AS b FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE_32}', 1
    + 16 * b[5 * i + 1]::BIGINT + 8 * b[5 * i + 2]::BIGINT + 4 * b[5 * i + 3]::BIGINT + 2 * b[5 * i + 4]::BIGINT + b[5 * i + 5]::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

OP10 = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM base WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
reached AS (SELECT doc_id, doc_id AS other FROM base UNION SELECT doc_id, b FROM reached JOIN links ON other = a),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT smallest.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, smallest.doc_id = component_id AS kept
FROM smallest LEFT JOIN sizes ON smallest.doc_id = sizes.doc_id
"""

OP11 = rf"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (
  SELECT *, {_lower(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM split),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key GROUP BY doc_id
"""

OP12 = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.vector, b.vector)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

#: CRC-32 of nothing but four bits, the low half of a byte first.
_NIBBLES = [functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), n) for n in range(16)]

OP13 = rf"""
WITH table16 AS (SELECT {_NIBBLES}::BIGINT[] AS t),
split AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
wanted AS (
  SELECT list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
both_ AS (SELECT doc_id, TRUE AS pool, ws FROM split UNION ALL SELECT NULL, FALSE, ws FROM wanted),
runs AS (
  SELECT doc_id, pool, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS run
  FROM (SELECT doc_id, pool, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM both_, range(1, 4) AS sizes(size))),
counted AS (SELECT run, doc_id, pool, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(range(1, strlen(run) + 1), lambda i:
      [strpos('0123456789ABCDEF', hex(run)[2 * i]) - 1, strpos('0123456789ABCDEF', hex(run)[2 * i - 1]) - 1]))),
    lambda c, x: xor(t[1 + (xor(c, x) & 15)], c >> 4))) % 10000 AS bucket
  FROM (SELECT DISTINCT run FROM counted), table16),
placed AS (SELECT doc_id, pool, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (run) GROUP BY ALL),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE pool), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT pool), 0)::DOUBLE AS t
  FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM totals),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE pool GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(weight, 0)::BIGINT AS weight,
    (greatest(len(ws), 0) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM split LEFT JOIN weights USING (doc_id))
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN n_words >= 20 AND place <= 5 * sum((n_words >= 20)::INTEGER) OVER () // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM scored)
"""

ORACLES: dict[str, str] = {
    "op1_url_filters": OP1,
    "op2_quality_rules": OP2,
    "op3_substring_dedup": OP3,
    "op5_mixing": OP5,
    "op6_secret_scans": OP6,
    "op8_warc": OP8,
    "op10_minhash": OP10,
    "op11_line_dedup": OP11,
    "op12_hard_negatives": OP12,
    "op13_importance_resampling": OP13,
}
