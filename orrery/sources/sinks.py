"""Tables that are written out: case libraries and graph files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators.kg import classification_flatten


def case_library(annotation: DataFrame, groups: DataFrame, first_of: DataFrame | None = None) -> DataFrame:
    """(group_id, terms, diseases): the terms of the least id of a group that has any (in ``first_of``), and all its ids."""
    owner = (annotation if first_of is None else first_of).select("disease_id").distinct().join(groups, "disease_id").groupBy("group_id").agg(F.min("disease_id").alias("disease_id"))
    terms = owner.join(annotation, "disease_id").groupBy("group_id").agg(F.array_sort(F.collect_set("term_id")).alias("terms"))
    return terms.join(groups.groupBy("group_id").agg(F.array_sort(F.collect_set("disease_id")).alias("diseases")), "group_id")


def case_database(merged: DataFrame, alias: DataFrame, typed: DataFrame, groups: DataFrame, description: DataFrame | None = None) -> DataFrame:
    """One row for a group; an annotated id without a group is its own. ``standard_names`` by id; ``names`` sorted, ``aliases`` in the
    order of ids and positions; ``terms`` with their distinct displays (``Unknown`` where an id has none); whether any id is rare;
    the first type that isn't empty, and the distinct descriptions ('' for none), in the order of ids; ``alias_errors`` and
    ``term_errors``, the ids whose aliases, or terms with displays, differ from the least id's; ``mismatch`` if annotated ids
    disagree on their number of terms. Ids are compared by digests, so a group's row holds an id's terms only once for all."""
    from ..functions.frequency import freq_display

    own = merged.select("disease_id").distinct().join(groups.hint("merge"), "disease_id", "left_anti").select("disease_id", F.col("disease_id").alias("group_id"))
    ids = groups.select("disease_id", "group_id").unionByName(own)
    parts = F.flatten(F.transform("frequencies", lambda f: F.split(freq_display(f), "; ")))
    shown = F.array_sort(F.array_distinct(F.filter(parts, lambda d: d != "")))
    displays = merged.select("disease_id", "term_id", F.when(F.size(shown) > 0, shown).otherwise(F.array(F.lit("Unknown"))).alias("d"))
    digest = lambda items: F.sha2(F.to_json(F.array_sort(F.collect_list(items))), 256)
    per_terms = displays.groupBy("disease_id").agg(digest(F.struct("term_id", "d")).alias("term_key"), F.count("*").alias("n"))
    per_alias = alias.groupBy("disease_id").agg(digest(F.struct("pos", "alias")).alias("alias_key"), F.min_by("alias", "pos").alias("standard_name"))
    about = (alias.where("false").select("disease_id", F.col("alias").alias("description")) if description is None else description.groupBy("disease_id").agg(F.min(F.trim("description")).alias("description")))
    one = ids
    for table in (per_terms, per_alias, typed.select("disease_id", "disease_type", "is_rare"), about):
        one = one.join(table.hint("merge"), "disease_id", "left")
    row = F.struct("disease_id", "term_key", "alias_key", F.coalesce("standard_name", F.lit("")).alias("standard_name"), "disease_type", F.coalesce("description", F.lit("")).alias("description"))
    grouped = one.groupBy("group_id").agg(F.array_sort(F.collect_list(row)).alias("s"), F.coalesce(F.bool_or("is_rare"), F.lit(False)).alias("is_rare"), (F.countDistinct("n") > 1).alias("mismatch"))
    odd = lambda key: F.transform(F.filter("s", lambda x: ~x[key].eqNullSafe(F.col("s")[0][key])), lambda x: x["disease_id"])
    types = F.filter(F.transform("s", lambda x: x["disease_type"]), lambda t: F.coalesce(t, F.lit("")) != "")
    entry = grouped.select(
        "group_id", F.map_from_entries(F.transform("s", lambda x: F.struct(x["disease_id"], x["standard_name"]))).alias("standard_names"), "is_rare", F.try_element_at(types, F.lit(1)).alias("disease_type"),
        F.array_distinct(F.transform("s", lambda x: x["description"])).alias("descriptions"), odd("alias_key").alias("alias_errors"), odd("term_key").alias("term_errors"), "mismatch")
    spelt = alias.join(ids.hint("merge"), "disease_id").groupBy("group_id", "alias").agg(F.min(F.struct("disease_id", "pos")).alias("at"))
    names_of = spelt.groupBy("group_id").agg(F.array_sort(F.collect_list("alias")).alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    united = displays.join(ids.hint("merge"), "disease_id").select("group_id", "term_id", F.explode("d").alias("d")).groupBy("group_id", "term_id").agg(F.array_join(F.array_sort(F.collect_set("d")), "; ").alias("d"))
    terms = united.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term_id", "d")))).alias("terms"))
    return entry.join(names_of.hint("merge"), "group_id", "left").join(terms.hint("merge"), "group_id", "left")


def public_disease_nodes(alias: DataFrame) -> DataFrame:
    first = alias.groupBy("disease_id").agg(F.min_by("alias", "pos").alias("standard_name"))
    return first.select(F.col("disease_id").alias("ID"), "standard_name", names.disease_link(F.col("disease_id").cast("string")).alias("link"))


def graph_edges(groups: DataFrame, edge: DataFrame, alt: DataFrame) -> DataFrame:
    """(sourceID, targetID, source, relationship): groups to their public ids, is-a, and exact alternative ids."""
    row = lambda df, a, b, source, kind: df.select(F.col(a).cast("string").alias("sourceID"), F.col(b).cast("string").alias("targetID"), F.lit(source).alias("source"), F.lit(kind).alias("relationship"))
    return row(groups, "group_id", "disease_id", "groups", "has_id").unionByName(row(edge, "child", "parent", "ontology", "is_a")).unionByName(row(alt, "alt_id", "primary_id", "ontology", "phenotype_exact"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str, key: str | None, value: str, within: str | None = None) -> None:
    """JSON dictionaries of ``key`` and ``value`` (without ``key``: lists of values), under the name ``within`` of an outer one if given:
    a file for each task, which ``large_json.entries`` reads together, so no task holds the whole."""
    rows = df.select(F.to_json(F.array(value)).alias("v"), *([F.to_json(F.array(F.col(key).cast("string"))).alias("k")] if key else []))
    left, right = ("{", "}") if key else ("[", "]")
    opened, closed = ('{"' + within + '": ' + left, right + "}") if within else (left, right)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = opened
        for batch in batches:
            values = [v[1:-1] for v in batch.column(0).to_pylist()]
            if key:
                values = [f"{k[1:-1]}: {v}" for k, v in zip(batch.column(1).to_pylist(), values)]
            out = []
            for v in values:
                out.append(before + v)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(opened if before == opened else "") + closed])], ["value"])

    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_classification(rows: DataFrame, path: str) -> None:
    """The flattened classification as a JSON dictionary by disorder (``json``) and as a file of joined categories (``csv``)."""
    flat = classification_flatten(rows)
    listed = lambda c: F.array_remove(F.split(c, r" \| "), "").alias(c)
    write_json(flat.select("disease_id", F.struct(*[listed(c) for c in ("name", "disorder_type", "classification", "category")]).alias("v")), f"{path}/json", "disease_id", "v")
    number = F.regexp_replace(F.col("disease_id").cast("string"), "^ORPHA:", "")
    write_csv(flat.select(number.alias("OrphaNumber"), F.element_at(F.split("name", r" \| "), 1).alias("Disorder_Name"), F.replace("category", F.lit(" | "), F.lit("|")).alias("Category")), f"{path}/csv")
