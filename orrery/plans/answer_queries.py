"""Registered queries over models' answers and case entries. Their texts are made of the given tables by one expression, which
Spark and DuckDB both read; the SQL then reads them by the rules, not by what is known to be in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, textops
from ..sources import sinks
from . import queries as base
from .fixture import Fixture

query = base.query

#: Object answers of each kind: thoughts, keys in brackets, lists without braces, broken JSON, JSON to be mended, none.
OBJECTS = """CASE s_suppkey % 7
  WHEN 0 THEN '<think>{"FINAL ANSWER": {"1. wrong": {}}}</think>So {"FINAL ANSWER": {"2. ' || s_name || '": {"a": "b"}, "1. ' || upper(s_name) || '": {}, "no number": {}}} done'
  WHEN 1 THEN 'lost thought</think>{"FINAL ANSWER": {"[3. ' || s_name || ' ]": {}, "10. UNKNOWN": {}, "4.Nothing ' || s_nationkey || '": 5}, "note": 1}'
  WHEN 2 THEN '  Ranked:' || chr(10) || '**1. ' || s_name || '** - text: x' || chr(10) || '"2. nothing like ' || s_suppkey || '": y' || chr(10) || '3. ab' || chr(10) || ' 4. ' || lower(s_name) || ' (old form)' || chr(10) || '5. Patient 7. ' || s_name || ' – text'
  WHEN 3 THEN '{"FINAL ANSWER": {"1. ' || s_name || '": {"a": }}}'
  WHEN 4 THEN '{"FINAL ANSWER": {"1. ' || s_name || '": {"a": ["b",],},' || chr(10) || '"2. UNKNOWN": {}}}'
  WHEN 5 THEN '{"OTHER ANSWER": {"1. ' || s_name || '": {}}}' END"""

#: Answers with candidates as objects and lists, whole and broken, and findings of the final answer.
CANDIDATES = """CASE s_suppkey % 7
  WHEN 0 THEN '{"Step 1": "x", "20 Candidate Rare Diseases": {"1. ' || s_name || '": "s", "2. nothing ' || s_suppkey || '": "t"}} FINAL ANSWER: {' || chr(10) || '"1. ' || s_name || ' (old)": {"Matched": ["HP:1", "HP:2"], "Unmatched": ["HP:3"]},' || chr(10) || '"2. Other": {"Matched": []}' || chr(10) || '} end } of {'
  WHEN 1 THEN '{"candidate diseases": ["1. ' || s_name || '", "Primary Sjögren syndrome", "none ' || s_suppkey || '", "", 5]} Final Answer' || chr(10) || '1. ' || s_name
  WHEN 2 THEN '20 Candidate Diseases are here: ["' || upper(s_name) || '", broken, "2. x"] FINAL ANSWER' || chr(10) || '1. a - b'
  WHEN 3 THEN 'no list; FINAL ANSWER {' || chr(10) || '"1. ' || s_name || '": "yes",' || chr(10) || '"2. other one": {"Matched": ["a"], "Unmatched": ["b"]}' || chr(10) || '} FINAL ANSWER {' || chr(10) || '"1. other one": 0, ' || chr(10) || '"2. ' || s_name || '": 1}'
  WHEN 4 THEN '"Candidate Rare Diseases": {"": 1} "20  candidate rare diseases": {"a ' || s_name || '": "b"}'
  WHEN 5 THEN 'FINAL ANSWER {' || chr(10) || '"1. ' || s_name || '": {"Matched": [' END"""


def _texts(x: Fixture, text: str) -> DataFrame:
    return x.table("supplier").select(F.col("s_suppkey").alias("answer_id"), F.expr(text).alias("text"))


def _resolved(x: Fixture) -> DataFrame:
    return x.alias.groupBy(F.lower("alias").alias("name")).agg(F.min("disease_id").alias("disease_id"))


_RESOLVED = "SELECT lower(alias) AS name, min(disease_id) AS disease_id FROM alias GROUP BY 1"


def _numbered(text: str) -> str:
    """DuckDB for ``numbered_names``."""
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: trim(l)), lambda l: regexp_matches(l, '^(\"|\\*{{1,2}})?\\d+\\.'))"
    bare = f"list_transform({lines}, lambda l: replace(regexp_replace(regexp_replace(l, '^\"?\\*{{0,2}}\\d+\\.\\s*', ''), '^Patient \\d+\\.\\s*', ''), '\"', ''))"
    ended = f"list_transform({bare}, lambda l: CASE WHEN contains(l, ' - ') THEN split_part(l, ' - ', 1) WHEN contains(l, ' – ') THEN split_part(l, ' – ', 1) ELSE split_part(l, ':', 1) END)"
    return f"list_filter(list_transform({ended}, lambda l: trim(regexp_replace(regexp_replace(l, '\\s*\\([^)]*\\)', '', 'g'), '\\*|''s', '', 'g'))), lambda l: length(l) > 2)"


_final = "list_extract(string_split(text, CASE WHEN contains(text, 'FINAL ANSWER') THEN 'FINAL ANSWER' WHEN contains(text, 'Final Answer') THEN 'Final Answer' END), -1)"
_object = {
    "object_text": f"SELECT s_suppkey AS answer_id, trim(regexp_replace(regexp_replace({OBJECTS}, '(?s)<think>.*?</think>', '', 'g'), '(?s).*?</think>', '', 'g')) AS text FROM supplier",
    "object_json": "SELECT answer_id, text, braces, CASE WHEN json_valid(braces) THEN braces WHEN json_valid(mended) THEN mended END AS j FROM (SELECT *, replace(replace(replace(replace(braces, '''', '\"'), chr(10), ''), ',}', '}'), ',]', ']') AS mended FROM (SELECT *, regexp_extract(text, '(?s)\\{.*\\}') AS braces FROM object_text))",
    "object_key": "SELECT answer_id, unnest(range(0, len(k))) AS pos, unnest(k) AS k FROM (SELECT answer_id, json_keys(j, '$.\"FINAL ANSWER\"') AS k FROM object_json WHERE braces <> '')",
    "object_name": "SELECT answer_id, pos, CAST(regexp_extract(k, p, 1) AS INT) AS idx, regexp_extract(k, p, 2) AS name FROM object_key, (SELECT '^\\s*\\[?\\s*(\\d+)\\s*\\.\\s*(.+?)\\s*\\]?\\s*$' AS p) WHERE regexp_matches(k, '^\\s*\\[?\\s*(\\d+)\\s*\\.\\s*(.+?)\\s*\\]?\\s*$')"
                   f" UNION ALL SELECT answer_id, unnest(range(0, len(k))), CAST(unnest(range(1, len(k) + 1)) AS INT), unnest(k) FROM (SELECT answer_id, {_numbered('text')} AS k FROM object_json WHERE braces = '')",
    "resolved": _RESOLVED,
}
_object["object_name"] = _object["object_name"].replace("regexp_extract(k, p, ", "regexp_extract(k, '^\\s*\\[?\\s*(\\d+)\\s*\\.\\s*(.+?)\\s*\\]?\\s*$', ").replace(", (SELECT '^\\s*\\[?\\s*(\\d+)\\s*\\.\\s*(.+?)\\s*\\]?\\s*$' AS p)", "")


@query("T15_object_answer_forms", "SELECT answer_id, idx, name FROM object_name WHERE name <> 'UNKNOWN'", _object)
def _(x):
    return answers.parse_object_answer(_texts(x, OBJECTS))


@query("T15_enriched_answer", f"""SELECT answer_id, case_no, coalesce(s.s_name, n.name) AS name, disease_id, CASE WHEN disease_id % 4 = 1 THEN 'category ' || s.s_nationkey ELSE '' END AS category,
  CASE WHEN disease_id % 2 = 0 THEN 'about ' || s.s_name ELSE '{answers.NO_DESCRIPTION}' END AS description, coalesce(p.profile, '') AS profile
  FROM (SELECT *, CAST(50 + row_number() OVER (PARTITION BY answer_id ORDER BY idx, pos) AS INT) AS case_no FROM object_name) n JOIN resolved r ON r.name = lower(n.name) JOIN supplier s ON s.s_suppkey = disease_id
  LEFT JOIN (SELECT disease_id, string_agg(bucket || ': ' || terms, ' | ' ORDER BY bucket || ': ' || terms) AS profile FROM ({base.TERM_PROFILE}) GROUP BY 1) p USING (disease_id)""", _object)
def _(x):
    k = F.col("s_suppkey")
    entry = x.table("supplier").select(k.alias("disease_id"), F.col("s_name").alias("standard_name"), F.when(k % 4 == 1, F.concat(F.lit("category "), F.col("s_nationkey").cast("string"))).alias("category"), F.when(k % 2 == 0, F.concat(F.lit("about "), "s_name")).when(k % 3 == 0, "").alias("description"))
    return answers.enrich_answer(_texts(x, OBJECTS), _resolved(x), entry, textops.term_profile(x.annotation, x.term))


@query("T07_thinking_forms", f"SELECT answer_id, regexp_extract(s, '(?s)<think>(.*?)</think>', 1) AS thought, regexp_replace(regexp_replace(s, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS rest FROM (SELECT s_suppkey AS answer_id, {OBJECTS} AS s FROM supplier)")
def _(x):
    thought, rest = textops.split_thinking(F.col("text"))
    return _texts(x, OBJECTS).select("answer_id", thought.alias("thought"), rest.alias("rest"))


_heads = [h.replace("'", "''") for h in answers.HEADINGS]
_keys = ", ".join(f"""nullif(regexp_extract_all(regexp_extract(text, '(?is){h}\\s*\\{{([^}}]+)\\}}', 1), '"([^"]+)"\\s*:', 1), [])""" for h in _heads)
_lists = ", ".join(f"""CASE WHEN regexp_matches(text, '(?is){h}\\s*\\[(.*?)\\]') THEN regexp_extract_all(regexp_extract(text, '(?is){h}\\s*\\[(.*?)\\]', 1), '"([^"]+)"', 1) END""" for h in _heads)
_candidate = {
    "candidate_text": f"SELECT s_suppkey AS answer_id, {CANDIDATES} AS text FROM supplier",
    "candidate": f"SELECT answer_id, CAST(unnest(range(1, len(k) + 1)) AS INT) AS idx, unnest(k) AS name FROM (SELECT answer_id, list_transform(list_filter(list_transform(coalesce({_keys}, {_lists}), lambda s: trim(s)), lambda s: s <> ''), lambda s: regexp_replace(s, '^\\d+\\.\\s*', '')) AS k FROM candidate_text)",
    "ranked": f"SELECT answer_id, CAST(unnest(range(1, len(k) + 1)) AS INT) AS idx, unnest(k) AS name FROM (SELECT answer_id, {_numbered(_final)} AS k FROM candidate_text)",
    "resolved": _RESOLVED,
}


@query("T04_ranked_answer_forms", "SELECT answer_id, idx, name FROM ranked", _candidate)
def _(x):
    return answers.parse_ranked_answer(_texts(x, CANDIDATES))


@query("T06_candidate_names", "SELECT answer_id, idx, name FROM candidate", _candidate)
def _(x):
    return answers.candidate_names(_texts(x, CANDIDATES))


@query("T06_answer_findings", """SELECT answer_id, idx, name, coalesce(array_to_string(CAST(json_extract(v, '$.Matched') AS VARCHAR[]), ','), '') AS matched, coalesce(array_to_string(CAST(json_extract(v, '$.Unmatched') AS VARCHAR[]), ','), '') AS unmatched
  FROM (SELECT r.answer_id, r.idx, r.name, arg_min(e.value, place) AS v FROM ranked r JOIN (SELECT answer_id, unnest(m) AS e, unnest(range(0, len(m))) AS place
    FROM (SELECT answer_id, map_entries(CASE WHEN json_valid(o) THEN CAST(CAST(o AS JSON) AS MAP(VARCHAR, JSON)) END) AS m FROM (SELECT answer_id, regexp_extract(text, '(?s)FINAL ANSWER[^{]*(\\{\\n.*?\\n\\})', 1) AS o FROM candidate_text))) k
    ON k.answer_id = r.answer_id AND contains(e.key, name) AND json_type(e.value) = 'OBJECT' GROUP BY ALL)""", _candidate)
def _(x):
    return answers.answer_findings(_texts(x, CANDIDATES)).withColumns({c: F.array_join(c, ",") for c in ("matched", "unmatched")})


@query("T08_validate_candidates", "SELECT answer_id, count(*) AS n_candidates, count(*) = 2 AS complete, coalesce(string_agg(c.name, '; ' ORDER BY idx) FILTER (WHERE disease_id IS NULL AND NOT contains(lower(c.name), 'sjögren')), '') AS unmatched FROM candidate c LEFT JOIN resolved r ON r.name = lower(c.name) GROUP BY 1", _candidate)
def _(x):
    return answers.validate_candidates(_texts(x, CANDIDATES), _resolved(x), 2)


_shown = "coalesce(nullif(" + base._label.format("frequency") + ", ''), 'Unknown')"
_k03 = {
    "shown": f"SELECT disease_id, term_id, {_shown} AS d FROM ann_rows WHERE qualifier <> 'NOT' AND frequency <> '' GROUP BY ALL UNION SELECT disease_id, term_id, 'Unknown' FROM ann_rows WHERE qualifier <> 'NOT' GROUP BY ALL HAVING max(frequency) = ''",
    "id_key": "SELECT g.group_id, g.disease_id, g.disease_id = min(g.disease_id) OVER (PARTITION BY g.group_id) AS least, (SELECT string_agg(alias, '|' ORDER BY pos, alias) FROM alias a WHERE a.disease_id = g.disease_id) AS names, t.terms FROM grp g LEFT JOIN (SELECT disease_id, string_agg(term_id || ':' || ds, ' ' ORDER BY term_id) AS terms FROM (SELECT disease_id, term_id, string_agg(d, '; ' ORDER BY d) AS ds FROM shown GROUP BY ALL) GROUP BY 1) t USING (disease_id)",
    "errors": "SELECT k.group_id, coalesce(string_agg(k.disease_id, ',' ORDER BY k.disease_id) FILTER (WHERE k.names IS DISTINCT FROM f.names), '') AS alias_errors, coalesce(string_agg(k.disease_id, ',' ORDER BY k.disease_id) FILTER (WHERE k.terms IS DISTINCT FROM f.terms), '') AS term_errors FROM id_key k JOIN id_key f ON f.group_id = k.group_id AND f.least GROUP BY 1",
    "spelt": "SELECT group_id, alias, min((disease_id, pos)) AS place FROM alias JOIN grp USING (disease_id) GROUP BY ALL",
    "term_text": "SELECT group_id, string_agg(term_id || ': ' || ds, ' | ' ORDER BY term_id) AS terms FROM (SELECT group_id, term_id, string_agg(DISTINCT d, '; ' ORDER BY d) AS ds FROM shown JOIN grp USING (disease_id) GROUP BY ALL) GROUP BY 1",
    "described": "SELECT group_id, string_agg(d, '|' ORDER BY place) AS descriptions FROM (SELECT group_id, CASE WHEN disease_id % 2 = 0 THEN 'about ' || s_nationkey ELSE '' END AS d, min(disease_id) AS place FROM grp JOIN supplier ON s_suppkey = disease_id GROUP BY ALL) GROUP BY 1",
}


@query("K03_case_entries", """SELECT g.group_id, string_agg(g.disease_id || '=' || s_name, '|' ORDER BY g.disease_id) AS standard_names, any_value(a.aliases) AS aliases, bool_or(g.disease_id % 7 = 0) AS is_rare, arg_min('type ' || s_nationkey, g.disease_id) FILTER (WHERE g.disease_id % 12 = 9) AS disease_type,
  any_value(d.descriptions) AS descriptions, any_value(e.alias_errors) AS alias_errors, any_value(e.term_errors) AS term_errors, any_value(t.terms) AS terms
  FROM grp g JOIN supplier ON s_suppkey = g.disease_id JOIN errors e ON e.group_id = g.group_id JOIN described d ON d.group_id = g.group_id LEFT JOIN term_text t ON t.group_id = g.group_id JOIN (SELECT group_id, string_agg(alias, '|' ORDER BY place) AS aliases FROM spelt GROUP BY 1) a ON a.group_id = g.group_id GROUP BY 1""", _k03)
def _(x):
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    s = x.table("supplier")
    typed = s.select(k.alias("disease_id"), F.when(k % 12 == 9, F.concat(F.lit("type "), nation)).when(k % 12 == 6, "").alias("disease_type"), (k % 7 == 0).alias("is_rare"))
    about = s.where(k % 2 == 0).select(k.alias("disease_id"), F.concat(F.lit(" about "), nation).alias("description"))
    pairs = lambda c, between: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit(between), e["value"])), "|" if between == "=" else " | ")
    ids = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return sinks.case_database(x.merged, x.alias, typed, x.groups, about).select(
        "group_id", pairs("standard_names", "=").alias("standard_names"), F.array_join("aliases", "|").alias("aliases"), "is_rare", "disease_type", F.array_join("descriptions", "|").alias("descriptions"), ids("alias_errors").alias("alias_errors"), ids("term_errors").alias("term_errors"), pairs("terms", ": ").alias("terms"))
