"""The column functions that SQL texts may call, as temporary SQL functions: their bodies are expressions, with no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import frequency as freq


def _case(value: str, pairs: dict) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}D"
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {shown(v)}" for k, v in pairs.items()) + " END"


def _with(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _numeric(token: str) -> str:
    number = lambda pattern, k: f"try_cast(nullif(regexp_extract(w, r'{pattern}', {k}), '') AS DOUBLE)"
    slash, of, share, span = r"^(\d+)/(\d+)$", r"^(\d+)\s*of\s*(\d+)$", r"^([\d.]+?)\s*%$", r"^(\d+)%?-(\d+)%$"
    ratio = lambda p: f"try_divide({number(p, 1)}, {number(p, 2)})"
    label = _case(f"upper(trim({token}))", {k: v[0].lower() for k, v in freq.CODES.items()})
    return _with("w", f"coalesce({label}, lower(trim({token})))", f"coalesce({_case('w', freq.WORDS)}, {ratio(slash)}, {number(share, 1)} / 100, {ratio(of)}, ({number(span, 1)} + {number(span, 2)}) / 200)")


def register(spark: SparkSession) -> list[str]:
    """Defines freq_type (F01), freq_numeric (F04), freq_max (F05) and poincare_distance (V03) for the session; gives their names."""
    square = lambda v: f"aggregate({v}, 0D, (acc, x) -> acc + x * x)"
    inside = lambda v: f"(1 - least({square(v)}, 1 - 1e-4D))"
    kinds = [(r"^\d+/\d+$", "fraction"), (r"^\d+(\.\d+)?%$", "percentage"), (r"^HP:\d+$", "hpo_id")]
    bodies = {
        "freq_type(s STRING) RETURNS STRING": _with("t", "trim(coalesce(s, ''))", "CASE WHEN t = '' THEN 'empty' " + " ".join(f"WHEN t RLIKE r'{p}' THEN '{k}'" for p, k in kinds) + " ELSE 'other' END"),
        "freq_numeric(s STRING) RETURNS DOUBLE": _numeric("s"),
        "freq_max(s STRING) RETURNS DOUBLE": f"array_max(transform(filter(transform(split(coalesce(s, ''), ';'), x -> trim(x)), x -> x <> ''), x -> {_numeric('x')}))",
        "poincare_distance(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>) RETURNS DOUBLE": _with("z", f"greatest(1 + 2 * {square('zip_with(u, v, (a, b) -> a - b)')} / ({inside('u')} * {inside('v')}), 1 + 1e-5D)", "ln(z + sqrt(z * z - 1))"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in bodies]
