"""Names, ids and small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell disease names apart.
COMMON = (
    "syndrome disease disorder condition anomaly defect malformation abnormality deficiency insufficiency type form variant subtype class category "
    "autosomal dominant recessive x-linked y-linked inherited genetic congenital hereditary familial rare common frequent occasional very extremely with of and or"
).split()
SUFFIXES = (("syndrome", 9), ("disease", 7), ("disorder", 8))


def exclude_alias(alias: Column, has_name: Column) -> Column:
    """Whether an alias says nothing: blank, or a short upper-case code where a name is known."""
    t = F.trim(F.coalesce(alias, F.lit("")))
    code = (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) < 6)
    return (t == "") | (code & has_name)


def placeholder_name(s: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return (t == "") | t.contains("removed from database") | t.startswith("moved to")


def extract_code(s: Column) -> Column:
    """The text in the last parentheses, or all of it."""
    return F.when(s.rlike(r"\(([^()]*)\)[^()]*$"), F.regexp_extract(s, r"\(([^()]*)\)[^()]*$", 1)).otherwise(s)


def split_names(s: Column, pattern: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), pattern), lambda t: F.trim(t)), lambda x: x != "")


def norm_name(s: Column, compat: bool = True) -> Column:
    """Lower case without a closing syndrome, disease or disorder. ``compat`` takes one letter more before ``syndrome``."""
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    out = t
    for word, cut in reversed(SUFFIXES):
        n = cut if compat else len(word)
        out = F.when(t.endswith(word), F.trim(F.substr(t, F.lit(1), F.greatest(F.length(t) - n, F.lit(0))))).otherwise(out)
    return out


def key_tokens(s: Column) -> Column:
    words = F.transform(F.split(F.trim(F.lower(F.coalesce(s, F.lit("")))), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:!?()\[\]{}"'-]+|[.,;:!?()\[\]{}"'-]+$""", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMMON))


def lookup_tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9-]+"), lambda w: F.length(w) > 1)


def disease_link(i: Column) -> Column:
    number = F.split_part(i, F.lit(":"), F.lit(2))
    return F.when(i.startswith("OMIM:"), F.concat(F.lit("https://www.omim.org/entry/"), number)).when(i.startswith("ORPHA:"), F.concat(F.lit("https://www.orpha.net/en/disease/detail/"), number)).otherwise("")


def disease_db(i: Column) -> Column:
    return F.when(i.contains(":"), F.split_part(i, F.lit(":"), F.lit(1))).otherwise("other")


def strip_markup(s: Column, i: Column) -> Column:
    """Text without its own id and icon words, white space made single; NULL if too little is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(s, F.lit("")), i, F.lit("")), r"\b(icon|image|logo|button)\b", ""), r"\s+", " "))
    return F.when((F.length(t) >= 30) & (F.size(F.filter(F.split(t, " "), lambda w: F.length(w) > 3)) >= 3), t)


def strip_numbering(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(s), r"^\s*(\d+[.)]|[-*•])\s*", ""))


def remove_arrow_block(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<-.*?->", "")


def class_name_norm(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "^Orphanet classification of ", "")
