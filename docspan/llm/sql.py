"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

from docspan.llm import licences, quality_rules, spelling

_WORDS = r"len(list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules_sql(limit: int = quality_rules.LIMIT, left: float = quality_rules.LEFT) -> str:
    """Rows of ``quality_rules`` with its usual parameters; doc_id is taken as a key."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, text, source FROM d),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
tri AS (SELECT doc_id, i, word, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2 FROM each WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w1, w2) > 1 THEN 1 ELSE 0 END AS again FROM tri),
marks AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM often),
repeats AS (SELECT doc_id, sum(m) AS n FROM marks GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
frequent AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > {limit}),
lost AS (SELECT l.doc_id, sum({_WORDS.format("l.line")}) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {left} * n_words AS kept
FROM m"""


def licence_scan_sql() -> str:
    """Rows of ``licence_scan`` from the rule tables alone: every sentence of every document goes through all rules."""
    laid = "coalesce(text, '')"
    for pattern, replacement in licences.LAYOUT:
        laid = f"regexp_replace({laid}, {_quoted(pattern)}, {_quoted(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    identifier = " ".join(f"WHEN regexp_full_match(f, {_quoted(rule)}) THEN {_quoted(name)}" for name, rule, _ in licences.SENTENCES)
    spdx = " ".join(f"WHEN {_quoted(name)} THEN {_quoted('spdx-' + full.lower())}" for name, full in licences.SPDX_NAMES.items())
    licence = " ".join(f"WHEN regexp_full_match(x, {_quoted(licences.rule_pattern(parts))}) THEN {_quoted(name)}" for name, parts in licences.LICENCES)
    beside = ", ".join(map(_quoted, licences.BESIDE))
    return rf"""
WITH s AS (SELECT doc_id, list_filter(string_split_regex({laid}, {_quoted(licences.SENTENCE_END)}), lambda x: regexp_matches(x, {_quoted(licences.WORDED)})) AS cut FROM documents),
e AS (SELECT doc_id, unnest(range(len(cut))) AS place, unnest(cut) AS sentence FROM s),
h AS (SELECT doc_id, place, contains(lower(sentence), '{licences.SPDX_LINE}') AS is_spdx, sentence, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(sentence), 'licence', 'license'),
  '[^a-z0-9.]+', ' ', 'g'), '([a-z])\.|\.([^0-9]|$)', '\1 \2', 'g'), ' +', ' ', 'g')) AS norm FROM e),
fit AS (SELECT *, CASE WHEN is_spdx THEN regexp_extract_all(regexp_extract(lower(sentence), '{licences.SPDX_LINE}(.*)', 1), '{licences.SPDX_WORD}')
  ELSE regexp_extract_all(norm, {_quoted(licences.any_sentence())}, 1) END AS fits FROM h),
told AS (SELECT *, CASE WHEN NOT is_spdx AND len(fits) = 0 AND contains(norm, 'license') THEN ['{licences.UNKNOWN}'] ELSE fits END AS found FROM fit),
each AS (SELECT doc_id, place, is_spdx, unnest(found) AS f, unnest(range(len(found))) AS k FROM told WHERE len(found) > 0),
i AS (SELECT doc_id, place, k, CASE WHEN is_spdx THEN CASE f {spdx} END WHEN f = '{licences.UNKNOWN}' THEN f ELSE CASE {identifier} END END AS id FROM each),
ids AS (SELECT * FROM i WHERE id IS NOT NULL),
g AS (SELECT doc_id, string_agg(id, ' ' ORDER BY place, k) AS sequence, string_agg(CAST(place AS VARCHAR), ' ' ORDER BY place, k) AS places,
  CAST(count(*) FILTER (WHERE id = '{licences.UNKNOWN}') AS BIGINT) AS n_unknown, bool_or(id = 'all-rights') AS reserved FROM ids GROUP BY doc_id),
l AS (SELECT *, place - lag(place) OVER (PARTITION BY doc_id ORDER BY place, k) > {licences.MOST_APART} AS far FROM ids WHERE id NOT IN ({beside})),
marked AS (SELECT doc_id, string_agg(CASE WHEN far THEN '|' ELSE '' END || '<' || id || '>', '' ORDER BY place, k) AS marked FROM l GROUP BY doc_id),
fits AS (SELECT doc_id, unnest(f) AS x, unnest(range(len(f))) AS k FROM (SELECT doc_id, regexp_extract_all(marked, {_quoted(licences.any_rule())}, 1) AS f FROM marked)),
of_rules AS (SELECT doc_id, k, CASE {licence} END AS licence FROM fits),
named AS (SELECT * FROM of_rules UNION ALL SELECT doc_id, 0, '{licences.RESERVED}' FROM g WHERE reserved AND doc_id NOT IN (SELECT doc_id FROM of_rules)),
firsts AS (SELECT doc_id, licence, min(k) AS k FROM named GROUP BY doc_id, licence),
every AS (SELECT doc_id, string_agg(licence, ' ' ORDER BY k) AS licences FROM named GROUP BY doc_id),
different AS (SELECT doc_id, string_agg(licence, ' AND ' ORDER BY k) AS licence FROM firsts GROUP BY doc_id)
SELECT d.doc_id, coalesce(different.licence, '') AS licence, coalesce(every.licences, '') AS licences, coalesce(g.sequence, '') AS sequence, coalesce(g.places, '') AS places,
  coalesce(g.n_unknown, 0) AS n_unknown
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN different USING (doc_id)"""


def spelling_groups_sql() -> str:
    """Rows of ``spelling_groups`` with its usual parameters. Neighbours are found by leaving out each code point of each word:
    two words that are equal with the same place left out differ by a replacement, a word that equals another with one left out
    by an insertion."""
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{spelling._UPPER}', '{spelling._LOWER}'), '[^{spelling.LETTERS}]+'),
  lambda r: length(r) >= {spelling.LEAST_LENGTH})) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
bytes AS (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM counted),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM sums),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, unnest(range(length(word))) AS k FROM words),
less AS MATERIALIZED (SELECT word, k, word[1:k] || word[k + 2:] AS rest FROM places),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
  UNION SELECT x.word, w.word FROM less x JOIN words w ON x.rest = w.word
  UNION SELECT w.word, x.word FROM less x JOIN words w ON x.rest = w.word
),
ranked AS (SELECT a, b, words.n AS n_b, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY words.n DESC, b) AS place FROM pairs JOIN words ON words.word = b),
formed AS MATERIALIZED (SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN n_b >= {spelling.TIMES} * n THEN b END AS form, CASE WHEN n_b >= {spelling.TIMES} * n THEN n_b END AS form_n
  FROM words LEFT JOIN ranked ON a = word AND place = 1),
chain AS (SELECT word, coalesce(form, word) AS root FROM formed UNION SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
