"""SQL counterparts of the registered queries, in DuckDB's dialect."""

from defectloom.llm.license_texts import NOTICES

# Written out here and not shared with the operators, so that a wrong rule shows.
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS own,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
  FROM documents
),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows)
  WHERE n > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM again, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, source, own, line, regexp_extract_all({_LOWER.format('line')}, '{_WORD}') AS parts
  FROM (SELECT doc_id, source, own, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}')
),
named AS (SELECT *, array_to_string(parts, ' ') AS norm FROM lines),
common AS (SELECT source, norm FROM named GROUP BY source, norm HAVING count(DISTINCT own) >= 20),
lost AS (
  SELECT doc_id, sum(len(parts)) AS lost
  FROM named n JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.norm = c.norm GROUP BY doc_id
),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM named GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(words) - coalesce(lost, 0) AS n_left
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_left >= 0.3 * n_words AS kept, CAST(n_left AS BIGINT) AS n_left
FROM judged
"""

_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
_SUFFIXES = "'ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk'"


def _level(name: str, source: str) -> str:
    """Prior strength of a level: spread of its outcomes beyond chance, within bounds."""
    return f"""{name}_strength AS (
  SELECT 1 / least(0.5::DOUBLE, greatest(0.001::DOUBLE, coalesce(
    sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0),
    0.001::DOUBLE))) - 1 AS s FROM {source})"""


OP4 = f"""
WITH parsed AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parsed),
found AS (
  SELECT page_id, {_LOWER.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
),
counts AS (
  SELECT host, count(*) AS n, sum(1 - quality) AS bad FROM found JOIN labels ON page_id = doc_id
  WHERE quality IS NOT NULL GROUP BY host
),
named AS (
  SELECT host, string_split(host, '.') AS parts, array_to_string(string_split(host, '.')[-2:], '.') AS two
  FROM (SELECT DISTINCT host FROM found)
),
hosts AS (
  SELECT host, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE parts[-1] END AS suffix,
         CASE WHEN two IN ({_SUFFIXES}) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
         coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad
  FROM named LEFT JOIN counts USING (host)
),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS prior FROM hosts GROUP BY suffix
),
{_level('suffix', 'suffixes')},
domains AS (
  SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value((t.s * x.prior + x.bad) / (t.s + x.n)) AS prior
  FROM hosts h JOIN suffixes x USING (suffix), suffix_strength t GROUP BY h.domain, h.suffix
),
{_level('domain', 'domains')},
priors AS (
  SELECT h.host, h.n, h.bad, (t.s * d.prior + d.bad) / (t.s + d.n) AS prior
  FROM hosts h JOIN domains d USING (domain), domain_strength t
),
{_level('host', 'priors')},
beta AS (SELECT host, t.s * prior + bad AS a, t.s * (1 - prior) + n - bad AS b FROM priors, host_strength t),
bar AS (SELECT least(0.5::DOUBLE, 1.5::DOUBLE * (sum(bad) + 1) / (sum(n) + 2)) AS x FROM hosts),
sides AS (
  SELECT host, a, b, x < (a + 1) / (a + b + 2) AS low,
         CASE WHEN x < (a + 1) / (a + b + 2) THEN x ELSE 1 - x END AS y,
         CASE WHEN x < (a + 1) / (a + b + 2) THEN a ELSE b END AS c, x
  FROM beta, bar
),
steps AS (
  SELECT host, exp(sum(ln((a + b + k) * y / (c + 1 + k))) OVER (PARTITION BY host ORDER BY k)) AS term
  FROM sides, (SELECT unnest(range(1000)) AS k)
),
series AS (SELECT host, 1 + sum(term) AS total FROM steps GROUP BY host),
tails AS (
  SELECT host, a, b, x, low,
         exp(c * ln(y) + (a + b - c) * ln(1 - y) + lgamma(a + b) - lgamma(a) - lgamma(b)) / c * total AS tail
  FROM sides JOIN series USING (host)
),
bounds AS (
  SELECT host, CASE WHEN a + b <= 10000 THEN CASE WHEN low THEN 1 - tail ELSE tail END > 0.95::DOUBLE
    ELSE a / (a + b) - 1.6448536269514722::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > x END AS blocked
  FROM tails
),
rules(rule_host, rule_path, verdict) AS (VALUES {', '.join(map(str, _RULES))}),
fitting AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, verdict FROM found, rules
  WHERE (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
),
longest AS (SELECT * FROM fitting QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM found LEFT JOIN longest USING (host, path) JOIN bounds USING (host)
"""


def _crc_table() -> list[int]:
    """The CRC-32 of each byte, by the reflected polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


OP6 = f"""
WITH crc_table AS (SELECT {_crc_table()}::BIGINT[] AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, strlen(text) + 8 AS size,
         list_transform(regexp_extract_all(hex(text), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d
),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda crc, x:
    xor(crc >> 8, t[(xor(crc, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM b, crc_table
),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c
),
sharded AS (SELECT *, CAST(least(23, before * 24 // total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({k}, {_quoted(name)}, {_quoted(text)})"
    for k, (name, text) in enumerate((name, text) for name in sorted(NOTICES) for text in NOTICES[name])
)
_PARTS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
OP5 = f"""
WITH templates AS (
  SELECT *, len(pairs) AS n, len(pairs) * 0.8 / 1.2 - 1e-9 AS need, floor(2 * len(w) * 1.2 / 0.8 + 1e-9) + 1 AS reach
  FROM (SELECT k, name, w, {_PAIRS} AS pairs
        FROM (SELECT k, name, {_PARTS.format('text')} AS w FROM (VALUES {_TEMPLATES}) AS v(k, name, text)))
),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
passages AS (
  SELECT DISTINCT doc_id, passage FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS passage FROM d
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM d
    UNION ALL SELECT doc_id, text FROM d)
),
cut AS (SELECT doc_id, passage, {_PARTS.format('passage')} AS w FROM passages),
paired AS (SELECT doc_id, passage, {_PAIRS} AS pairs FROM cut WHERE len(w) > 1),
scored AS (
  SELECT doc_id, passage, name, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS score
  FROM paired p JOIN templates t ON len(p.pairs) BETWEEN len(t.pairs) * 0.66 AND len(t.pairs) * 1.51
),
best AS (
  SELECT * FROM scored WHERE score >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id, passage ORDER BY score DESC, name) = 1
),
texts AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS seq
  FROM (SELECT doc_id, {_PARTS.format('text')} AS w FROM d) WHERE len(w) > 1
),
hits AS (
  SELECT doc_id, k, i, pair
  FROM (SELECT doc_id, unnest(range(len(seq))) AS i, unnest(seq) AS pair FROM texts)
  JOIN (SELECT k, unnest(pairs) AS pair FROM templates) USING (pair)
),
enough AS (
  SELECT doc_id, k FROM hits JOIN templates USING (k) GROUP BY doc_id, k, need HAVING count(DISTINCT pair) >= need
),
runs AS (
  SELECT doc_id, k, min(i) AS s, max(i) AS e
  FROM (SELECT doc_id, k, i, i - row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS run FROM hits SEMI JOIN enough USING (doc_id, k))
  GROUP BY doc_id, k, run
),
numbered AS (
  SELECT *, row_number() OVER own AS nth, sum(e - s + 1) OVER own AS upto FROM runs WINDOW own AS (PARTITION BY doc_id, k ORDER BY s)
),
spans AS (
  SELECT a.doc_id, t.k, t.name, t.n, t.pairs, a.s, b.e
  FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND a.k = b.k AND b.nth >= a.nth JOIN templates t ON t.k = a.k
  WHERE b.nth - a.nth <= t.reach // 2 AND (a.nth = b.nth OR b.e - a.s < t.reach) AND b.upto - a.upto + a.e - a.s + 1 >= t.need
),
windows AS (
  SELECT doc_id, k, name, s, e, 2.0::DOUBLE * len(list_intersect(own, pairs)) / (len(own) + n) AS score
  FROM (SELECT *, list_distinct(list_slice(seq, s + 1, e + 1)) AS own FROM spans JOIN texts USING (doc_id))
),
kept AS (
  SELECT doc_id, unnest(list_reduce(
    list([{{'s': s, 'e': e, 'name': name, 'score': score}}] ORDER BY score DESC, k, s DESC, e DESC),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s <= x[1].e AND x[1].s <= y.e)) = 0 THEN list_concat(acc, x) ELSE acc END
  )) AS x
  FROM windows WHERE score >= 0.8 GROUP BY doc_id
),
found AS (
  SELECT doc_id, list_sort(list(DISTINCT name)) AS names, max(score) AS score
  FROM (SELECT doc_id, name, score FROM best UNION ALL SELECT doc_id, x.name, x.score FROM kept) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(names), 0)::BIGINT AS n_licences, coalesce(array_to_string(names, ','), '') AS licences, score
FROM d LEFT JOIN found USING (doc_id)
"""

OP11 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
runs AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (SELECT unnest(range(1, 6)) AS k))
),
f AS (SELECT lang, phrase, k, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
halves AS (
  SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM longer)
),
best AS (
  SELECT h.lang, h.phrase, h.a, l.a AS l, r.a AS r, n, (1000::HUGEINT * h.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.rest
  JOIN totals t ON t.lang = h.lang
  QUALIFY row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY score, j) = 1
),
inner_parts AS (
  SELECT lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM longer))
),
held AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

OP12 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

# CRC-32 bit by bit: a list entry of -1 shifts, others are bytes.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({}, ''), lambda x:
  [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)
  WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""

# All ways through a turn: up to three inserted turns, then an edit, by the state before and after.
OP13 = f"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM own WHERE kind > 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM hurt
),
marked AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS turns
  FROM marked GROUP BY conv_id
),
inserts(start, state, m, lines) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
         (0, 2, 1, 'user:;'), (1, 2, 1, 'user:;'), (2, 3, 1, 'assistant:;'), (3, 2, 1, 'user:;'),
         (0, 3, 2, 'user:;assistant:;'), (1, 3, 2, 'user:;assistant:;'), (2, 2, 2, 'assistant:;user:;'), (3, 3, 2, 'user:;assistant:;')
),
edits(state, after, edit, cost, initial, role) AS (
  VALUES (0, 0, 'D', 4, NULL, NULL), (1, 1, 'D', 4, NULL, NULL), (2, 2, 'D', 4, NULL, NULL), (3, 3, 'D', 4, NULL, NULL),
         (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant'), (3, 2, 'R', 3, NULL, 'user'),
         (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL)
),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, struct_pack(c := 0::BIGINT, a := '', o := []::VARCHAR[]) AS s FROM counts
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.after, min(struct_pack(
           c := s.c + 3 * n.m + e.cost + CASE WHEN e.edit <> 'D' AND t.fault = 't' THEN 3 ELSE 0 END,
           a := s.a || repeat('I', n.m) || e.edit,
           o := s.o || list_filter(string_split(n.lines, ';'), lambda x: x <> '')
                || CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.role, t.role) || ':' || t.text] END))
  FROM walk w JOIN marked t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
  JOIN inserts n ON n.start = w.state JOIN edits e ON e.state = n.state
  WHERE (e.initial IS NULL OR e.initial = t.initial) AND (e.edit = 'D' OR t.fault NOT IN ('b', 'd'))
  GROUP BY w.conv_id, w.i, e.after
),
ended AS (
  SELECT w.conv_id, min(struct_pack(c := s.c + 3 * n.m, a := s.a || repeat('I', n.m),
                        o := s.o || list_filter(string_split(n.lines, ';'), lambda x: x <> ''))) AS s
  FROM walk w JOIN counts k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.turns = w.i
  JOIN inserts n ON n.start = w.state WHERE n.state IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.s.c, 0) AS cost,
       coalesce(e.s.a, '') AS audit, sha256(coalesce(array_to_string(e.s.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE: dict[str, str] = {
    "op4_host_reputation": OP4,
    "op5_licence_dice": OP5,
    "op6_byte_shards": OP6,
    "op8_line_frequency": OP8,
    "op11_misra_gries": OP11,
    "op12_chunk_recipes": OP12,
    "op13_branch_bound": OP13,
}
