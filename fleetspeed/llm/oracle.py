"""SQL twins of the queries of this package, for DuckDB over the same tables.

A trained classifier (op5), hashed seeds (op9) and a bootstrapped graph (op10) have none; tests hold them
against plain Python.  Repeated byte strings (op7) need bytes, which SQL texts don't give.
"""

from __future__ import annotations

from fleetspeed.llm.license_scan import NEEDED_PERCENT, PHRASES, TEMPLATES, stride_of

SPACED = r"[^\x20\x09-\x0D]+"

CHAT = r"""
WITH cleaned AS (
  SELECT conv_id, turn IS NULL AS late, coalesce(turn, 0) AS turn,
         coalesce(nullif(lower(trim(role)), ''), 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
),
turns AS (
  SELECT *, content || '<|im_end|>' AS said, row_number() OVER (PARTITION BY conv_id ORDER BY late, turn, speaker, content) - 1 AS n
  FROM cleaned
),
participants AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
pieces AS (
  SELECT t.conv_id, perspective, n // 1024 AS part, n, speaker, said,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                ELSE 'user name=' || speaker END || chr(10) AS head
  FROM turns t JOIN participants p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (
           PARTITION BY conv_id, perspective, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM pieces
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       count(*) FILTER (speaker = perspective) AS n_trained,
       string_agg(head || said || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(said) AS BIGINT), ',' ORDER BY n)
                FILTER (speaker = perspective), '') AS mask
FROM placed GROUP BY ALL
"""

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACED}')), 0) AS size FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source
),
ranked AS (
  SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS n FROM sources
),
steps AS (  -- the level if the first n - 1 sources stop pos twice their size
  SELECT n, cap, weight,
         (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
),
level AS (SELECT arg_min(level, n) AS level FROM steps WHERE weight * level <= cap),
targets AS (
  SELECT source, source_size, least(weight * level, cap) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(weight * level, cap) / source_size) AS INT) ELSE 0 END AS epochs
  FROM ranked, level
),
items AS (SELECT source, doc_id, sum(size) AS size FROM sized GROUP BY ALL),
marks AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 ELSE 0.5 END) AS weight FROM labels
          WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
keyed AS (
  SELECT i.*, -ln((CAST('0x' || substr(md5(coalesce(CAST(i.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
              / coalesce(m.weight, 1.0) AS key
  FROM items i LEFT JOIN marks m ON i.doc_id = m.doc_id
),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM keyed
),
chosen AS (
  SELECT s.source, s.doc_id FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  WHERE middle <= target - epochs * CAST(source_size AS DOUBLE)
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(d.size * (t.epochs + CASE WHEN c.source IS NOT NULL OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(t.epochs + CASE WHEN c.source IS NOT NULL OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS copies
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.doc_id IS NOT DISTINCT FROM c.doc_id
"""

RULES = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT r, regexp_extract_all(text, '{SPACED}') AS w FROM texts),
windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS pos, w FROM listed WHERE len(w) >= 3
),
counted AS (SELECT r, pos, count(*) OVER (PARTITION BY r, w[pos], w[pos + 1], w[pos + 2]) AS n FROM windows),
starts AS (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS next FROM counted WHERE n > 1),
repeats AS (SELECT r, sum(least(coalesce(next - pos, 3), 3)) AS n FROM starts GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
dups AS (SELECT r, count(line) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{SPACED}') GROUP BY r),
measured AS (
  SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t JOIN listed l ON t.r = l.r LEFT JOIN dups d ON t.r = d.r LEFT JOIN repeats p ON t.r = p.r
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 3 > n_words OR n_dup_lines * 2 > len(string_split(text, chr(10)))
            OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
            OR word_chars NOT BETWEEN n_words * 2 AND n_words * 20) AS kept
FROM judged
"""


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _licenses() -> str:
    templates = " UNION ALL ".join(
        f"SELECT '{label}' AS label, {stride_of(text)} AS stride, {_list(sorted(set(text.split())))} AS words" for label, text in TEMPLATES
    )
    phrases = " UNION ALL ".join(
        f"SELECT r, pos, '{label}' AS label FROM tokens WHERE "
        + " AND ".join(f"w[pos + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))
        for phrase, label in PHRASES
    )
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
tokens AS (SELECT r, w, unnest(range(0, len(w))) AS pos FROM texts),
places AS ({phrases}),
base AS (
  SELECT r, count(*) AS n, min(pos) AS low, max(pos) AS high, list(DISTINCT label) AS labels FROM places GROUP BY r
),
templates AS ({templates}),
blocks AS (
  SELECT r, stride, list_distinct(w[b * stride + 1 : b * stride + 2 * stride]) AS words
  FROM (SELECT r, w, stride, unnest(range(0, CAST(ceil(len(w) / stride) AS BIGINT))) AS b
        FROM texts, (SELECT DISTINCT stride FROM templates))
),
found AS (
  SELECT r, label, len(list_intersect(b.words, t.words)) / len(t.words) AS score
  FROM blocks b JOIN templates t
    ON b.stride = t.stride AND len(list_intersect(b.words, t.words)) * 100 >= {NEEDED_PERCENT} * len(t.words)
),
matched AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(matched.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score
FROM texts LEFT JOIN base ON texts.r = base.r LEFT JOIN matched ON texts.r = matched.r
"""


URLS = r"""
WITH captures AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host,
         1672531200 + (page_id * 7919) % 730 * 86400 + page_id % 86400 AS fetched
  FROM pages
),
hosts AS (
  SELECT host, regexp_replace(host, '^[^.]*\.', '') AS parent, CAST('0x' || substr(md5(host), 1, 4) AS BIGINT) AS x
  FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL)
),
entries AS (
  SELECT 'block' AS list, host AS pattern, 'add' AS action, x % 500 AS day FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT 'block', host, 'remove', x % 500 + 60 + x % 90 FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT 'block', host, 'add', x % 500 + 200 FROM hosts WHERE x % 6 = 0
  UNION ALL SELECT 'allow', host, 'add', x % 400 FROM hosts WHERE x % 7 = 0
  UNION ALL SELECT 'block', parent, 'add', x % 600 FROM hosts WHERE x % 11 = 0
),
moments AS (SELECT list, pattern, 1672531200 + day * 86400 AS since, max(action) AS action FROM entries GROUP BY ALL),
intervals AS (
  SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until FROM moments
),
domains AS (
  SELECT page_id, host, fetched, array_to_string(labels[n:], '.') AS pattern
  FROM (SELECT *, string_split(host, '.') AS labels, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS n
        FROM captures WHERE host IS NOT NULL)
),
best AS (
  SELECT page_id, max({'n': length(d.pattern), 'list': list, 'pattern': d.pattern, 'since': since}) AS b
  FROM domains d JOIN intervals i ON d.pattern = i.pattern AND action = 'add' AND fetched >= since AND (until IS NULL OR fetched < until)
  GROUP BY page_id
)
SELECT c.page_id, host, CASE b.list WHEN 'block' THEN 'blocked' WHEN 'allow' THEN 'allowed' ELSE 'kept' END AS verdict,
       b.pattern AS matched, fetched, CAST(b.since AS VARCHAR) AS since
FROM captures c LEFT JOIN best ON c.page_id = best.page_id
"""

NGRAMS = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACED}') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos : pos + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS pos FROM texts WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS key FROM shingles GROUP BY doc_id),
firsts AS (SELECT key, min(doc_id) AS doc_id FROM sets GROUP BY key),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM (SELECT * FROM shingles SEMI JOIN firsts USING (doc_id)) a
  JOIN (SELECT * FROM shingles SEMI JOIN firsts USING (doc_id)) b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common >= 85 * (x.n + y.n - common)
  UNION SELECT f.doc_id, s.doc_id FROM sets s JOIN firsts f USING (key) WHERE f.doc_id <> s.doc_id
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT a AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON a = doc_id GROUP BY a, n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": CHAT,
        "op2_source_mixing": MIX,
        "op3_quality_rules": RULES,
        "op4_license_scan": _licenses(),
        "op6_url_filters": URLS,
        "op8_ngram_join": NGRAMS,
    }
