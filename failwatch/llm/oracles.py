"""SQL (DuckDB) for the operators whose rows SQL can express on whole tables.

Each statement goes its own way: chats and archives are computed from the rows without a
template or file, near-duplicates by counting shared shingles, near lines by comparing
lines that share a half, spelling variants by words without one letter, phrases by counting all of
them and secrets by splitting texts.
"""

from __future__ import annotations

from functools import reduce

from failwatch.llm import phrases, secrets, spelling
from failwatch.llm.chat import CONTROL, END, LEARNED_ROLE, SEPARATOR, START
from failwatch.llm.line_dedup import MIN_WORDS
from failwatch.llm.warc import MIN_REVISIT


def _escaped(text: str) -> str:
    return reduce(
        lambda e, s: f"replace({e}, '{s}', '{s[0]}\\{s[1:]}')", CONTROL, f"replace({text}, '\\', '\\\\')"
    )


OP3 = f"""
WITH said AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
       (sum(length({_escaped('text')})
            + CASE WHEN before = role THEN {len(SEPARATOR)}
                   ELSE {len(START) + len(END) + 2} + length(replace({_escaped('role')}, chr(10), '\\n')) END))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

OP6 = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1),
           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS shingles
  FROM worded
),
docs AS (SELECT doc_id, len(shingles) AS n, sha256(array_to_string(shingles, chr(10))) AS same, shingles FROM shingled),
classes AS (
  SELECT same, min(doc_id) AS rep, any_value(n) AS n, any_value(shingles) AS shingles
  FROM docs WHERE n > 0 GROUP BY same
),
single AS (SELECT rep, n, unnest(shingles) AS shingle FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM single a JOIN single b ON a.shingle = b.shingle AND a.rep < b.rep
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT rep AS node, rep AS root FROM classes
  UNION
  SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.node WHERE r.root < e.b
),
components AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT d.doc_id, d.n AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM docs d LEFT JOIN classes c ON d.same = c.same AND d.n > 0 LEFT JOIN components ON c.rep = node"""

_HALVES = lambda n: f"[hash(1, {n}, w[1:({n}) // 2]), hash(2, {n}, w[-(({n}) - ({n}) // 2):])]"

OP7 = f"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines)))::INTEGER AS line_no FROM split),
lines AS (
  SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM numbered
),
places AS (SELECT array_to_string(w, ' ') AS line, {{'doc': doc_id, 'no': line_no}} AS place FROM lines WHERE len(w) > 0),
firsts AS (SELECT line, min(place) AS place, count(*) AS copies FROM places GROUP BY line),
long AS (
  SELECT place, string_split(line, ' ') AS w, len(w) AS n FROM firsts WHERE n >= {MIN_WORDS}
),
keyed AS (
  SELECT place, unnest(CASE WHEN n > {MIN_WORDS} THEN list_concat({_HALVES('n')}, {_HALVES('n - 1')})
                            ELSE {_HALVES('n')} END) AS half FROM long
),
pairs AS (
  SELECT DISTINCT a.place AS mine, b.place AS theirs FROM keyed a JOIN keyed b ON a.half = b.half AND b.place < a.place
),
compared AS (
  SELECT mine, theirs, a.n AS n, b.n AS m,
         CASE WHEN a.n >= b.n THEN a.w ELSE b.w END AS l, CASE WHEN a.n >= b.n THEN b.w ELSE a.w END AS s
  FROM pairs JOIN long a ON a.place = mine JOIN long b ON b.place = theirs WHERE abs(a.n - b.n) <= 1
),
differing AS (
  SELECT *, list_position(list_transform(list_zip(l, s), lambda x: x[1] IS DISTINCT FROM x[2]), true) AS p FROM compared
),
near AS (
  SELECT mine, min(theirs) AS earlier FROM differing
  WHERE l[p + 1:] = CASE WHEN n = m THEN s[p + 1:] ELSE s[p:] END GROUP BY mine
),
repeated AS (
  SELECT line, least(place, coalesce(earlier, place)) AS first FROM firsts LEFT JOIN near ON mine = place
)
SELECT place.doc AS doc_id, place.no AS line_no, first.doc AS first_doc_id, first.no AS first_line_no
FROM places JOIN repeated USING (line) WHERE first < place"""

OP8 = f"""
WITH paged AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
latest AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM paged),
told AS (SELECT *, n >= {MIN_REVISIT} AND page_id < last AS again FROM latest)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to, url FROM told"""

#: One letter of a run goes where this divides the run's crc32.
DAMAGE = 97

# The crc32 goes byte by byte through the table of its polynomial; letters are ASCII or C3 xx in UTF-8.
OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
      translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[{spelling.LETTERS}]+')) AS run FROM documents
),
each AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))) AS h
  FROM each, crc
),
damaged AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged GROUP BY word
  HAVING length(word) >= {spelling.LEAST_LETTERS} AND sum(n) >= {spelling.LEAST_COUNT}
),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
without AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS near FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, v.word FROM without w JOIN vocabulary v ON v.word = w.rest
  UNION SELECT v.word, w.word FROM without w JOIN vocabulary v ON v.word = w.rest
),
ranked AS (
  SELECT p.word, near, v.n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) AS place
  FROM pairs p JOIN vocabulary v ON v.word = near
),
told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN r.n >= {spelling.RATIO} * v.n THEN near END AS form,
         CASE WHEN r.n >= {spelling.RATIO} * v.n THEN r.n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
),
steps_on AS (
  SELECT word, word AS root FROM told
  UNION ALL SELECT s.word, t.form FROM steps_on s JOIN told t ON t.word = s.root WHERE t.form IS NOT NULL
),
ends AS (SELECT s.word, s.root FROM steps_on s JOIN told t ON t.word = s.root WHERE t.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)"""

OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(regexp_split_to_array(
      translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
single AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, {phrases.MOST_WORDS + 1})) AS size)
),
f AS (SELECT lang, size, phrase, count(*) AS n FROM single GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (
  SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= {phrases.LEAST_COUNT}
),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, a, c.w, c.size, k, x.n AS l, y.n AS r,
         ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, unnest([array_to_string(w[:size - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM candidates WHERE size = {phrases.MOST_WORDS}
),
around AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE longer IS NULL OR 100 * longer < {phrases.LARGER_SHARE} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept JOIN totals t USING (lang) QUALIFY rank <= {phrases.TOP}"""

_TRIED = [*((kind, *p) for kind, p in secrets.BASE.items()), ("live", secrets.LIVE, 0, 0)]
_MATCHES = " UNION ALL ".join(
    f"""SELECT row, owner, {no} AS kind_no, '{kind}' AS kind, {least} AS least,
       unnest(range(len(regexp_extract_all(text, $${pattern}$$)))) AS i,
       unnest(regexp_extract_all(text, $${pattern}$$)) AS whole, unnest(regexp_extract_all(text, $${pattern}$$, {group})) AS value,
       unnest(regexp_split_to_array(text, $${pattern}$$)[:-2]) AS between
FROM told WHERE regexp_matches(text, $${pattern}$$)"""
    for no, (kind, pattern, group, least) in enumerate(_TRIED)
)
_LIVE_HAS = " AND ".join(f"regexp_matches(value, '{has}')" for has in secrets.LIVE_HAS)

OP13 = f"""
WITH told AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents
),
matches AS ({_MATCHES}),
placed AS (
  SELECT *, sum(length(between) + length(whole)) OVER (PARTITION BY row, kind ORDER BY i) AS until FROM matches
),
found AS (
  SELECT row, owner, kind_no, kind, until - length(whole) AS since, until, value FROM placed
  WHERE length(value) >= least AND (kind <> 'live' OR ({_LIVE_HAS}))
),
owned AS (SELECT value, count(DISTINCT owner) AS owners FROM found GROUP BY value),
spans AS (
  SELECT row, kind_no, kind, since, kind || ':' || since || ':' || until AS span, owners <= {secrets.MOST_OWNERS} AS live FROM found f JOIN owned USING (value)
  WHERE kind <> 'live' OR (owners <= {secrets.MOST_OWNERS} AND NOT EXISTS (
      SELECT 1 FROM found b WHERE b.row = f.row AND b.kind <> 'live' AND b.since < f.until AND f.since < b.until))
),
by_row AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
         string_agg(span, ',' ORDER BY since, kind_no) FILTER (kind <> 'live') AS base, string_agg(span, ',' ORDER BY since, kind_no) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM told LEFT JOIN by_row USING (row)"""

ORACLE_SQL = {
    "op3_chat": OP3, "op6_minhash": OP6, "op7_line_dedup": OP7, "op8_warc": OP8,
    "op11_spelling": OP11, "op12_phrases": OP12, "op13_secrets": OP13,
}
