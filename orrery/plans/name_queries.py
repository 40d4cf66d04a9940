"""Registered queries of the rules for names over strings of each kind. One expression, which Spark and DuckDB both read, makes the
strings of the given tables by row number; the SQL states each rule on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import resolve
from ..sources import sinks
from . import queries as base
from .fixture import Fixture

query = base.query


def _strings(x: Fixture, table: str, key: str, text: str):
    return x.table(table).select(F.col(key), F.expr(text).alias("s"))


PLACEHOLDERS = "CASE o_orderkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' Moved to ' || o_orderkey WHEN 2 THEN o_orderpriority || ' REMOVED from database' WHEN 3 THEN 'was moved to ' || o_orderkey WHEN 4 THEN 'removed from data base' WHEN 5 THEN o_orderpriority END"


@query("F12_placeholder_forms", "SELECT o_orderkey, trim(coalesce(s, '')) = '' OR contains(lower(s), 'removed from database') OR starts_with(lower(trim(s)), 'moved to') AS is_placeholder FROM strings", {"strings": f"SELECT o_orderkey, {PLACEHOLDERS} AS s FROM orders"})
def _(x):
    return _strings(x, "orders", "o_orderkey", PLACEHOLDERS).select("o_orderkey", names.placeholder_name(F.col("s")).alias("is_placeholder"))


CODED = "CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (a) (' || p_size || ')' WHEN 2 THEN '(' || p_type || ') ' || p_name WHEN 3 THEN p_name || ' (' || p_size WHEN 4 THEN p_name || ' ()' WHEN 5 THEN '((' || p_size || '))' END"


@query("F13_code_forms", "SELECT p_partkey, CASE WHEN regexp_matches(s, '\\([^()]*\\)[^()]*$') THEN regexp_extract(s, '\\(([^()]*)\\)[^()]*$', 1) ELSE s END AS code FROM strings", {"strings": f"SELECT p_partkey, {CODED} AS s FROM part"})
def _(x):
    return _strings(x, "part", "p_partkey", CODED).select("p_partkey", names.extract_code(F.col("s")).alias("code"))


MARKED = "CASE c_custkey % 6 WHEN 0 THEN 'icon  ' || c_name || '   lives somewhere near MONDO:9 ' || c_mktsegment || ' street logo ' WHEN 1 THEN c_name WHEN 2 THEN 'a of ' || c_name || ' an at to by ' || c_mktsegment WHEN 3 THEN 'iconic imagery of ' || c_name || chr(10) || 'button' WHEN 4 THEN 'image icon logo button MONDO:9 ' || c_mktsegment END"


@query("F18_markup_forms", "SELECT c_custkey, CASE WHEN length(t) >= 30 AND len(list_filter(string_split(t, ' '), lambda w: length(w) > 3)) >= 3 THEN t END AS said FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(replace(coalesce(s, ''), 'MONDO:9', ''), '\\b(icon|image|logo|button)\\b', '', 'g'), '\\s+', ' ', 'g')) AS t FROM strings)", {"strings": f"SELECT c_custkey, {MARKED} AS s FROM customer"})
def _(x):
    return _strings(x, "customer", "c_custkey", MARKED).select("c_custkey", names.strip_markup(F.col("s"), F.lit("MONDO:9")).alias("said"))


NUMBERED = "CASE p_partkey % 8 WHEN 0 THEN ' 12. ' || p_name WHEN 1 THEN '3)' || p_name WHEN 2 THEN '- ' || p_name WHEN 3 THEN p_name || ' 4. x' WHEN 4 THEN '1. 2. ' || p_name WHEN 5 THEN p_size || ' ' || p_name WHEN 6 THEN '<-a' || chr(10) || 'b->' || p_type || '<-c-> d <-' || p_name END"


@query("F19_numbering_forms", "SELECT p_partkey, trim(regexp_replace(trim(s), '^(\\d+[.)]|[-*•])\\s*', '')) AS a, regexp_replace(s, '(?s)<-.*?->', '', 'g') AS b FROM strings", {"strings": f"SELECT p_partkey, {NUMBERED} AS s FROM part"})
def _(x):
    return _strings(x, "part", "p_partkey", NUMBERED).select("p_partkey", names.strip_numbering(F.col("s")).alias("a"), names.remove_arrow_block(F.col("s")).alias("b"))


CLASSES = "CASE s_suppkey % 4 WHEN 0 THEN 'Orphanet classification of ' || s_name WHEN 1 THEN ' Orphanet classification of rare ' || s_name || ' ' WHEN 2 THEN 'The Orphanet classification of ' || s_name END"


@query("F20_class_name_forms", "SELECT s_suppkey, CASE WHEN starts_with(trim(s), 'Orphanet classification of ') THEN substr(trim(s), 28) ELSE trim(s) END AS name FROM strings", {"strings": f"SELECT s_suppkey, {CLASSES} AS s FROM supplier"})
def _(x):
    return _strings(x, "supplier", "s_suppkey", CLASSES).select("s_suppkey", names.class_name_norm(F.col("s")).alias("name"))


_spelt = "SELECT disease_id, alias, pos FROM alias UNION ALL SELECT disease_id, lower(alias), pos - 5 FROM alias WHERE disease_id % 3 = 0 UNION ALL SELECT disease_id, upper(alias), pos + 5 FROM alias WHERE disease_id % 2 = 0"


@query("I05_first_spelling", "SELECT disease_id, arg_min(alias, pos) AS alias, min(pos) AS pos FROM spelt GROUP BY disease_id, lower(alias)", {"spelt": _spelt})
def _(x):
    lower = x.alias.where("disease_id % 3 = 0").select("disease_id", F.lower("alias").alias("alias"), (F.col("pos") - 5).alias("pos"))
    upper = x.alias.where("disease_id % 2 = 0").select("disease_id", F.upper("alias").alias("alias"), (F.col("pos") + 5).alias("pos"))
    return resolve.dedup_aliases(x.alias.unionByName(lower).unionByName(upper))


_ids = "CASE disease_id % 3 WHEN 0 THEN 'OMIM:' WHEN 1 THEN 'ORPHA:' ELSE 'MONDO:' END || disease_id"


@query("K04_public_nodes_linked", "SELECT i AS ID, arg_min(alias, pos) AS standard_name, CASE split_part(i, ':', 1) WHEN 'OMIM' THEN 'https://www.omim.org/entry/' || split_part(i, ':', 2) WHEN 'ORPHA' THEN 'https://www.orpha.net/en/disease/detail/' || split_part(i, ':', 2) ELSE '' END AS link FROM named GROUP BY i", {"named": f"SELECT {_ids} AS i, alias, pos FROM alias"})
def _(x):
    return sinks.public_disease_nodes(x.alias.select(F.expr(_ids).alias("disease_id"), "alias", "pos"))
