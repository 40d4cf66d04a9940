"""Frequency notations as column expressions. Missing is NULL inside; -1 appears only where a file format asks for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct strings that may be broadcast; more are joined.
MOST_VALUES = 100_000

# Frequency codes with label and [low, middle, high].
CODES = {
    "HP:0040280": ("Obligate", 1.0, 1.0, 1.0),
    "HP:0040281": ("Very frequent", 0.8, 0.895, 0.99),
    "HP:0040282": ("Frequent", 0.3, 0.545, 0.79),
    "HP:0040283": ("Occasional", 0.05, 0.17, 0.29),
    "HP:0040284": ("Very rare", 0.01, 0.025, 0.04),
    "HP:0040285": ("Excluded", 0.0, 0.0, 0.0),
}
# Frequency words.
WORDS = {"very rare": 0.025, "rare": 0.05, "occasional": 0.17, "frequent": 0.545, "very frequent": 0.895, "obligate": 1.0}
HIGH_FREQUENCY = 0.17
COHORT = 5


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _look(pairs: dict, key: Column) -> Column:
    return F.try_element_at(_table(pairs), key)


def freq_type(s: Column) -> Column:
    """empty, fraction, percentage, hpo_id or other."""
    t = F.trim(F.coalesce(s, F.lit("")))
    return F.when(t == "", "empty").when(t.rlike(r"^\d+/\d+$"), "fraction").when(t.rlike(r"^\d+(\.\d+)?%$"), "percentage").when(t.rlike(r"^HP:\d+$"), "hpo_id").otherwise("other")


def label_of(code: Column) -> Column:
    return F.coalesce(_look({k: v[0] for k, v in CODES.items()}, code), code)


def tokens(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")


def freq_display(s: Column) -> Column:
    """Codes become labels; repeated parts go, in order."""
    return F.array_join(F.array_distinct(F.transform(tokens(s), label_of)), "; ")


def freq_format(values: Column, types: Column) -> Column:
    """Displays of a list of values with their types, distinct in order."""
    shown = F.zip_with(values, types, lambda v, t: F.when(t == "hpo_id", label_of(v)).otherwise(v))
    return F.array_distinct(F.filter(shown, lambda x: x.isNotNull() & (F.trim(x) != "")))


def freq_numeric(token: Column, profile: str = "graph") -> Column:
    """A token as a share; NULL if it can't be read. Profile ``pred`` reads that as 0, as well as fractions below 3 cases."""
    word = F.lower(F.when(F.lower(F.trim(token)).startswith("hp:"), label_of(F.upper(F.trim(token)))).otherwise(F.trim(token)))
    number = lambda pattern, k: F.nullif(F.regexp_extract(word, pattern, k), F.lit("")).try_cast("double")
    ratio = lambda p: F.try_divide(number(p, 1), number(p, 2))
    percent = F.nullif(F.regexp_extract(word, r"^([\d.]+?)\s*%$", 1), F.lit("")).try_cast("double") / 100
    span = (number(r"^(\d+)%?-(\d+)%$", 1) + number(r"^(\d+)%?-(\d+)%$", 2)) / 200
    slash, of = r"^(\d+)/(\d+)$", r"^(\d+)\s*of\s*(\d+)$"
    parsed = F.coalesce(_look(WORDS, word), ratio(slash), percent, ratio(of), span)
    if profile == "pred":
        few = F.coalesce(number(slash, 2) < 3, F.lit(False)) | F.coalesce(number(of, 2) < 3, F.lit(False))
        return F.when(few, 0.0).otherwise(F.coalesce(parsed, F.lit(0.0)))
    return parsed


def freq_max(s: Column, profile: str = "graph") -> Column:
    """The largest of the ``;``-separated tokens' shares; NULL if none can be read."""
    top = F.array_max(F.transform(tokens(s), lambda t: freq_numeric(t, profile)))
    return F.coalesce(top, F.lit(0.0)) if profile == "pred" else top


def freq_interval(code: Column) -> Column:
    pick = lambda i: _look({k: v[i] for k, v in CODES.items()}, code)
    return F.when(pick(1).isNotNull(), F.array(pick(1), pick(2), pick(3)))


def _steps(percent: Column) -> Column:
    return F.when(percent >= 60, 1.5).when(percent >= 30, 0.5).when(percent >= 10, 0.1).otherwise(0.0)


def freq_weight(s: Column, kind: Column) -> Column:
    """Weight of an annotation in steps; fractions of fewer than 5 cases weigh 0.3, what can't be read 1."""
    t = F.trim(F.coalesce(s, F.lit("")))
    low = F.lower(label_of(t))
    code = F.when(low.contains("frequent") | low.contains("obligate"), 1.5).when(low.contains("occasional"), 0.5).when(low.contains("very rare"), 0.1).when(low.contains("excluded"), 0.0).otherwise(1.0)
    above, below = F.split_part(t, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(t, F.lit("/"), F.lit(2)).try_cast("double")
    fraction = F.when(below.isNull() | (below <= 0), 1.0).when(below < 5, 0.3).otherwise(_steps(F.try_divide(above, below) * 100))
    percent = F.replace(t, F.lit("%"), F.lit("")).try_cast("double")
    return F.when(t == "", 1.0).when(kind == "hpo_id", code).when(kind == "percentage", F.when(percent.isNull(), 1.0).otherwise(_steps(percent))).when(kind == "fraction", fraction).otherwise(1.0)


def by_value(rows: DataFrame, column: str, parse: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with ``parse`` of a column as ``name``; each distinct string is parsed once, however many rows bear it."""
    from ..operators.lineage import cut

    key = F.coalesce(column, F.lit(""))
    values = cut(rows.select(key.alias("_value")).distinct().withColumn(name, parse(F.col("_value"))))
    few = F.broadcast(values) if values.count() <= MOST_VALUES else values.hint("merge")
    return rows.withColumn("_value", key).join(few, "_value").drop("_value")


def lr_freq_ratio(negated: Column, s: Column, salvage: bool = False, cohort: int = COHORT) -> Column:
    """struct(num, den) of the first token; NULL where it can't be read. Halves round to even."""
    t = F.trim(F.split_part(F.coalesce(s, F.lit("")), F.lit(";"), F.lit(1)))
    code = _look({k: v[2] for k, v in CODES.items()}, t)
    a = F.nullif(F.regexp_extract(t, r"^(\d+)/(\d+)$", 1), F.lit("")).try_cast("int")
    b0 = F.nullif(F.regexp_extract(t, r"^(\d+)/(\d+)$", 2), F.lit("")).try_cast("int")
    b = F.when(b0 == 0, cohort).otherwise(b0)
    p = F.nullif(F.regexp_extract(t, r"^(\d+(?:\.\d+)?)%$", 1), F.lit("")).try_cast("double")
    pn = F.greatest(F.lit(0), F.least(F.lit(cohort), F.bround(p * cohort / 100).cast("int")))
    turned = lambda n, d: F.when(~negated, n).when((n == 0) & F.lit(salvage), 0).otherwise(F.greatest(F.lit(0), d - n))
    out = lambda n, d: F.struct(n.cast("int").alias("num"), d.cast("int").alias("den"))
    return (
        F.when(t == "", out(F.when(negated, 0).otherwise(1), F.lit(1)))
        .when(code.isNotNull(), out(F.when(negated, 0).otherwise(F.bround(code * cohort)), F.lit(cohort)))
        .when(a.isNotNull(), out(F.least(F.greatest(turned(a, b), F.lit(0)), b), b))
        .when(p.isNotNull(), out(turned(pn, F.lit(cohort)), F.lit(cohort)))
    )


def case_freq_value(s: Column) -> Column:
    """A case table's frequency as a share; unknown words count as 1, unreadable ones are NULL."""
    t = F.trim(F.coalesce(s, F.lit("")))
    up = F.upper(t)
    # Words that say nothing.
    unknown = up.isin("UNKNOWN", "NA", "N/A", "NONE")
    words = _look({v[0].upper(): v[2] for v in CODES.values()}, up)
    a, b = (F.nullif(F.regexp_extract(t, r"^(\d+)/(\d+)$", k), F.lit("")).try_cast("double") for k in (1, 2))
    p = F.nullif(F.regexp_extract(t, r"^(\d+(?:\.\d+)?)%$", 1), F.lit("")).try_cast("double") / 100
    n = t.try_cast("double")
    bare = F.when((n >= 0) & (n <= 1), n).when((n > 1) & (n <= 100), n / 100)
    return F.when(t == "", None).when(unknown, 1.0).otherwise(F.coalesce(words, F.when(b > 0, F.least(a, b) / b), F.when(p.isNotNull(), F.least(p, F.lit(1.0))), bare))


def freq_bucket(x: Column) -> Column:
    """The named bucket of a share; values between buckets are Unknown."""
    return (
        F.when(x.isNull() | (x == -1), "Unknown").when(x == 0, "Excluded").when(x.between(0.01, 0.04), "Very rare").when(x.between(0.05, 0.29), "Occasional")
        .when(x.between(0.3, 0.79), "Frequent").when(x.between(0.8, 0.99), "Very frequent").when(x >= 1, "Obligate").otherwise("Unknown")
    )
