"""Note classification queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from docspan.functions.notes import PATTERN_FACTOR, RULES, UNIT
from docspan.operators import notes as N
from docspan.operators import rules as R
from docspan.plans.inputs import fixture, spread

_QUOTE = str.maketrans({"'": "''"})


def _score_sql() -> str:
    """One CASE-free sum per rule, in 1/UNIT, over columns text, lower_text and words."""
    parts = []
    for r in RULES:
        w = int(float(r.weight) * UNIT + 0.5)
        p = int(w * float(PATTERN_FACTOR) + 0.5)
        terms = []
        for k in r.keywords:
            q = k.translate(_QUOTE)
            terms.append(f"{w} * cast(contains(lower_text, '{q}') AS int)" if " " in k else f"{w} * cast(list_contains(words, '{q}') AS int)")
        for pattern, ignore_case in r.patterns:
            q = (("(?i)" if ignore_case else "") + pattern).translate(_QUOTE)
            terms.append(f"{p} * cast(regexp_matches(text, '{q}') AS int)")
        parts.append(f"{' + '.join(terms)} AS s_{r.rule_id}")
    return ",\n".join(parts)


_GREATEST = "greatest(" + ", ".join(f"s_{r.rule_id}" for r in RULES) + ")"
_CHOICE = "CASE WHEN is_code THEN 'usage' WHEN best = 0 THEN 'overview' " + " ".join(
    f"WHEN s_{r.rule_id} = best THEN '{r.rule_id}'" for r in RULES) + " END"
_ORDER = "CASE section_id " + " ".join(f"WHEN '{r.rule_id}' THEN {r.order}" for r in RULES) + " END"

# Blocks: fence parity by a running count of fence lines; a code block takes the lines between two fences.
BLOCKS_SQL = r"""
WITH note_lines AS (
  SELECT note_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line
  FROM (SELECT note_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM fx_notes)),
fenced AS (
  SELECT *, starts_with(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '```') AS is_fence FROM note_lines),
counted AS (
  SELECT *, coalesce(sum(is_fence::int) OVER (PARTITION BY note_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences
  FROM fenced),
grouped AS (
  SELECT note_id, n, line, (is_fence OR fences % 2 = 1) AS is_code,
    CASE WHEN is_fence AND fences % 2 = 1 THEN (fences + 1) // 2 WHEN is_fence OR fences % 2 = 1 THEN (fences + 2) // 2 ELSE -n END AS grp FROM counted),
raw_blocks AS (
  SELECT note_id, min(n) AS first_n, is_code, CASE WHEN is_code THEN string_agg(line, chr(10) ORDER BY n)
    ELSE trim(regexp_replace(min(line), '^\s*([-*•]|\d+[.)])\s+', ''), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) END AS text
  FROM grouped GROUP BY note_id, grp, is_code),
blocks AS (
  SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY first_n) AS block_no, text, is_code FROM raw_blocks WHERE text <> '')
"""

CLASSIFIED_SQL = BLOCKS_SQL + f""",
tokens AS (
  SELECT *, lower(text) AS lower_text, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9''-]*') AS words FROM blocks),
scores AS (SELECT note_id, block_no, text, is_code, {_score_sql()} FROM tokens),
chosen AS (SELECT *, {_GREATEST} AS best FROM scores),
classified AS (
  SELECT note_id, block_no, text, is_code, {_CHOICE} AS section_id,
    CASE WHEN is_code THEN 0.6 ELSE least(best / 600.0::double, 1.0::double) END AS confidence FROM chosen)
"""


def _notes(spark, sf):
    return spread(fixture(spark, sf, "fx_notes"))


def note_blocks(spark, sf):
    return N.segment_notes(_notes(spark, sf))


def note_classification(spark, sf):
    return N.classify_notes(N.segment_notes(_notes(spark, sf))).select(
        "note_id", "block_no", "section_id", F.round("confidence", 9).alias("confidence"))


def note_sections(spark, sf):
    return N.note_sections(_notes(spark, sf)).select(
        "note_id", "section_id", "section_title", "section_order", F.size("blocks").alias("n_blocks"),
        F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))


def note_stats(spark, sf):
    return N.note_stats(_notes(spark, sf))


def section_totals(spark, sf):
    return N.section_totals(N.classify_notes(N.segment_notes(_notes(spark, sf))))


# Rules of a user's own, beside one per region: id, order, weight, keywords and phrases, patterns (and whether case is ignored).
_USER_RULES = (
    ("money", 2, "0.001", ("billing", "the", "of the", "ger\\nPATCH"), ((r"billing|ledger", False),)),
    ("numbered", 3, "1.25", ("v2", "later"), ((r"\bv\d{1,3}\b", True), (r"\d", False))),
    ("shouted", 4, "0.5", ("run npm", "not support"), ((r"((foo|npm) )+install", False), (r"[A-Z]{3,}(_[A-Z]+)*", False), (r"serv(ice|er)s?", True))),
    ("latin", 5, "0.0005", ("de", "la", "et"), ((r"e{1,2}nt\b", True), (r"(que|qui)\w*", True))),
    ("usage", 90, "0.25", ("run",), ()),
)


def user_rules(spark, sf):
    """The rules above and one per region, whose name is its keyword."""
    own = spark.createDataFrame([(i, i.title(), o, Decimal(w), list(k), list(p)) for i, o, w, k, p in _USER_RULES], R.SCHEMA)
    regions = spark.read.parquet(f"{sf}/region.parquet").select(
        F.concat(F.lit("region-"), "r_regionkey").alias("rule_id"), F.initcap("r_name").alias("title"), (F.col("r_regionkey") + 10).cast("int").alias("rule_order"),
        F.lit(Decimal("0.75")).cast("decimal(18,6)").alias("weight"), F.array(F.lower("r_name"), F.lit("service")).alias("keywords"),
        F.array().cast("array<struct<pattern:string,ignore_case:boolean>>").alias("patterns"))
    return own.unionByName(regions)


def note_user_rules(spark, sf):
    """Classification under rules that are rows of a table."""
    return R.classify_by_rules(N.segment_notes(_notes(spark, sf)), user_rules(spark, sf)).select(
        "note_id", "block_no", "section_id", "section_title", F.round("confidence", 9).alias("confidence"))


def _sql_text(text: str) -> str:
    return "'" + text.translate(_QUOTE) + "'"


def _user_rules_sql() -> str:
    items = [(i, o, w, 0, k, w) for i, o, w, ks, _ in _USER_RULES for k in ks]
    items += [(i, o, w, 1, ("(?i)" if c else "") + p, str(Decimal(w) * PATTERN_FACTOR)) for i, o, w, _, ps in _USER_RULES for p, c in ps]
    rows = ", ".join(f"({_sql_text(i)}, {_sql_text(i.title())}, {o}, {kind}, {_sql_text(text)}, {points}::decimal(18,8))" for i, o, _, kind, text, points in items)
    return f"""(VALUES {rows}) UNION ALL
  SELECT 'region-' || r_regionkey, upper(r_name[1]) || lower(r_name[2:]), cast(r_regionkey + 10 AS int), 0, unnest([lower(r_name), 'service']), 0.75::decimal(18,8) FROM region"""


_TITLES = " ".join(f"WHEN '{r.rule_id}' THEN '{r.title}'" for r in RULES)

QUERIES = {
    "note_blocks": note_blocks,
    "note_classification": note_classification,
    "note_user_rules": note_user_rules,
    "note_sections": note_sections,
    "note_stats": note_stats,
    "section_totals": section_totals,
}
ORACLES = {
    "note_blocks": BLOCKS_SQL + "SELECT note_id, block_no, text, is_code FROM blocks",
    "note_classification": CLASSIFIED_SQL + "SELECT note_id, block_no, section_id, round(confidence, 9) AS confidence FROM classified",
    "note_user_rules": BLOCKS_SQL + f""",
tokens AS (SELECT *, lower(text) AS lower_text, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9''-]*') AS words FROM blocks),
rules(rule_id, title, rule_order, kind, item, points) AS ({_user_rules_sql()}),
hits AS (SELECT note_id, block_no, rule_id, title, rule_order, sum(points) AS score FROM tokens JOIN rules ON NOT is_code AND CASE
    WHEN kind = 1 THEN regexp_matches(text, item) WHEN contains(item, ' ') THEN contains(lower_text, item) ELSE list_contains(words, item) END GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY note_id, block_no ORDER BY score DESC, rule_order) AS place FROM hits)
SELECT t.note_id, t.block_no, CASE WHEN is_code THEN 'usage' ELSE coalesce(rule_id, 'money') END AS section_id,
  CASE WHEN is_code THEN 'Usage' ELSE coalesce(title, 'Money') END AS section_title,
  CASE WHEN is_code THEN 0.6 WHEN score IS NULL THEN 0.0 ELSE round(least(cast(score AS double) / 3, 1.0::double), 9) END::double AS confidence
FROM tokens t LEFT JOIN best b ON b.note_id = t.note_id AND b.block_no = t.block_no AND place = 1""",
    "note_sections": CLASSIFIED_SQL + f"""
SELECT note_id, section_id, CASE section_id {_TITLES} END AS section_title, {_ORDER} AS section_order, count(*) AS n_blocks,
  string_agg(text, chr(10) ORDER BY block_no) AS text FROM classified GROUP BY note_id, section_id""",
    "note_stats": CLASSIFIED_SQL + """
SELECT n.note_id, count(c.note_id) AS block_count, count(*) FILTER (WHERE c.confidence > 0) AS categorised
FROM fx_notes n LEFT JOIN classified c ON c.note_id = n.note_id GROUP BY n.note_id""",
    "section_totals": CLASSIFIED_SQL + f"""
SELECT section_id, {_ORDER} AS section_order, count(*) AS blocks, count(*) FILTER (WHERE confidence > 0) AS categorised
FROM classified GROUP BY section_id""",
}
