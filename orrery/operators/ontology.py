"""Ontology graph: edges, closure, categories, and lookups. Edges are (child, parent)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

MOST_EDGES = 1_000_000


def edges(term: DataFrame) -> DataFrame:
    """Parent links of term rows; alternative ids share the primary's, obsolete ids their replacement's."""
    own = term.select(F.col("term_id").alias("child"), F.explode("is_a").alias("parent"))
    out = own
    if "alt_ids" in term.columns:
        out = own.union(term.select(F.explode("alt_ids").alias("child"), "is_a").select("child", F.explode("is_a").alias("parent")))
    if "replaced_by" in term.columns:
        gone = term.where("is_obsolete and replaced_by is not null").select(F.col("term_id").alias("_gone"), "replaced_by")
        out = out.union(gone.join(own.hint("merge"), gone.replaced_by == own.child).select(F.col("_gone").alias("child"), "parent"))
    return out.distinct()


def names(term: DataFrame) -> DataFrame:
    """(term_id, name): alternative ids have the primary's name, obsolete ones "replacement;old"."""
    own = term.select("term_id", "name")
    alt = term.select(F.explode("alt_ids").alias("term_id"), "name")
    by = own.select(F.col("term_id").alias("replaced_by"), F.col("name").alias("_new"))
    old = term.where("is_obsolete and replaced_by is not null").join(by, "replaced_by").select("term_id", F.concat("_new", F.lit(";"), "name").alias("_name"))
    return own.union(alt).join(old, "term_id", "left").select("term_id", F.coalesce("_name", "name").alias("name")).distinct()


def closure(edge: DataFrame, most: int | None = None) -> DataFrame:
    """(term_id, ancestor_id, distance): all ancestors at their least distance. Up to MOST_EDGES edges go to every task, which climbs
    from the terms it holds; more are doubled by joins. Cycles end, and a term is not its own ancestor."""
    held = cut(edge.select("child", "parent").distinct())
    if held.count() > MOST_EDGES:
        return closure_by_doubling(held, most)
    above: dict = {}
    for r in held.collect():  # at most MOST_EDGES rows
        above.setdefault(r.child, []).append(r.parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for term in batch.column(0).to_pylist():
                level, seen, d = [term], {term}, 0
                while level and (most is None or d < most):
                    d += 1
                    level = [p for p in dict.fromkeys(p for t in level for p in above.get(t, ())) if p not in seen]
                    seen.update(level)
                    out += [(term, p, d) for p in level]
            ids = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], ids), pa.array([r[1] for r in out], ids), pa.array([r[2] for r in out], pa.int32())], ["term_id", "ancestor_id", "distance"])

    terms = held.select("child").distinct()
    kind = held.schema["child"].dataType.simpleString()
    return terms.repartition(terms.sparkSession.sparkContext.defaultParallelism, "child").mapInArrow(run, f"term_id {kind}, ancestor_id {kind}, distance int")


def closure_by_doubling(edge: DataFrame, most: int | None = None) -> DataFrame:
    """``closure`` of any number of edges.

    Once all pairs of up to ``length`` are known, those of up to twice that are a pair of exactly ``length`` and one more
    known pair, so a depth of d takes log d rounds. Each round is a written table; pairs met before are dropped, so
    cycles end, and the driver sees only whether there were new ones."""
    known = cut(edge.select(F.col("child").alias("term_id"), F.col("parent").alias("ancestor_id"), F.lit(1).alias("distance")).where("term_id <> ancestor_id").distinct())
    length = 1
    while most is None or length < most:
        onward = known.select(F.col("term_id").alias("_m"), F.col("ancestor_id").alias("_a"), F.col("distance").alias("_d"))
        met = known.where(F.col("distance") == length).join(onward.hint("merge"), F.col("ancestor_id") == F.col("_m"))
        met = met.select("term_id", F.col("_a").alias("ancestor_id"), (F.col("distance") + F.col("_d")).alias("distance")).where("term_id <> ancestor_id")
        if most is not None:
            met = met.where(F.col("distance") <= most)
        new = met.groupBy("term_id", "ancestor_id").agg(F.min("distance").alias("distance"))
        new = cut(new.join(known.select("term_id", "ancestor_id").hint("merge"), ["term_id", "ancestor_id"], "left_anti"))
        if new.isEmpty():
            break
        known, length = known.unionByName(new), 2 * length
    return known


def with_self(closure_: DataFrame, terms: DataFrame) -> DataFrame:
    return closure_.unionByName(terms.select("term_id", F.col("term_id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct())


def ancestors_within(closure_: DataFrame, depth: int) -> DataFrame:
    return closure_.where(F.col("distance") <= depth)


def only_child(edge: DataFrame) -> DataFrame:
    """(parent, child) of terms with exactly one child."""
    return edge.groupBy("parent").agg(F.countDistinct("child").alias("n"), F.min("child").alias("child")).where("n = 1").select("parent", "child")


def top_categories(closure_: DataFrame, terms: DataFrame, categories: DataFrame) -> DataFrame:
    """(term_id, categories): the listed categories among a term and its ancestors, joined by " | "."""
    hit = with_self(closure_, terms).join(categories.select(F.col("term_id").alias("ancestor_id"), F.col("name").alias("_name")), "ancestor_id")
    return hit.groupBy("term_id").agg(F.array_join(F.array_sort(F.collect_set("_name")), " | ").alias("categories"))


def canonical(query: DataFrame, alias: DataFrame, known: DataFrame, root) -> DataFrame:
    """Query rows with alternative ids replaced by primary ones; the root, unknown terms and repeats go."""
    primary = query.join(alias.select(F.col("alt_id").alias("term_id"), F.col("primary_id")), "term_id", "left").withColumn("term_id", F.coalesce("primary_id", "term_id")).drop("primary_id")
    return primary.join(known.select("term_id"), "term_id", "left_semi").where(F.col("term_id") != root).dropDuplicates()


def proportion_in_children(pairs: DataFrame, edge: DataFrame, closure_: DataFrame) -> DataFrame:
    """For pairs (query, term): 1 if equal, 1/children if direct, halved for each further level, else 0."""
    children = edge.groupBy(F.col("parent").alias("term")).agg(F.countDistinct("child").alias("_n"))
    near = closure_.select(F.col("term_id").alias("query"), F.col("ancestor_id").alias("term"), "distance")
    joined = pairs.join(near, ["query", "term"], "left").join(children, "term", "left")
    share = F.when(F.col("query") == F.col("term"), 1.0).when(F.col("distance").isNull(), 0.0).otherwise(1 / F.col("_n") * F.pow(F.lit(0.5), F.col("distance") - 1))
    return joined.select("query", "term", share.alias("share"))


def diseases_of_terms(annotation: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(term_id, group_id, disease_ids): the annotated groups of each asked term, with their ids in order."""
    return annotation.join(terms.select("term_id").distinct(), "term_id").join(groups, "disease_id").groupBy("term_id", "group_id").agg(F.array_sort(F.collect_set("disease_id")).alias("disease_ids"))


def term_info(terms: DataFrame, term_name: DataFrame, ic: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each asked term: name, information content and number of diseases."""
    return terms.select("term_id").distinct().join(term_name, "term_id").join(ic, "term_id", "left").join(counts, "term_id", "left").select("term_id", "name", "ic", F.coalesce("n_diseases", F.lit(0)).alias("n_diseases"))


def closest_annotated_ancestor(terms: DataFrame, closure_self: DataFrame, annotated: DataFrame, root) -> DataFrame:
    """(term_id, disease_id, ancestor_id): a term's nearest ancestor (or itself) below the root that ``annotated`` (disease_id,
    term_id) has for the disease, then the least id."""
    near = closure_self.join(terms.select("term_id").distinct().hint("merge"), "term_id", "left_semi").where(F.col("ancestor_id") != root)
    met = near.join(annotated.select("disease_id", F.col("term_id").alias("ancestor_id")), "ancestor_id")
    return met.groupBy("term_id", "disease_id").agg(F.min(F.struct("distance", "ancestor_id")).alias("b")).select("term_id", "disease_id", F.col("b.ancestor_id").alias("ancestor_id"))


def closest_or_root(pairs: DataFrame, closure_self: DataFrame, induced: DataFrame, root) -> DataFrame:
    """(term_id, disease_id, ancestor_id, f) of every given pair: the nearest ancestor that ``induced`` (disease_id, term_id, f) has for
    the disease; the root with 1 where there is none."""
    asked = pairs.select("term_id", "disease_id").distinct()
    near = closest_annotated_ancestor(asked, closure_self, induced, root).join(asked.hint("merge"), ["term_id", "disease_id"], "left_semi")
    shares = near.join(induced.withColumnRenamed("term_id", "ancestor_id").hint("merge"), ["disease_id", "ancestor_id"])
    return asked.join(shares.hint("merge"), ["term_id", "disease_id"], "left").select("term_id", "disease_id", F.coalesce("ancestor_id", F.lit(root)).alias("ancestor_id"), F.coalesce("f", F.lit(1.0)).alias("f"))


def disease_info(diseases: DataFrame, alias: DataFrame, typed: DataFrame, described: DataFrame, annotation: DataFrame) -> DataFrame:
    """One row for each asked disease: all names in order, type, description (empty if none) and each term's largest share."""
    names_ = alias.groupBy("disease_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"])).alias("names"))
    shares = annotation.groupBy("disease_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "freq"))).alias("shares"))
    rows = diseases.select("disease_id").distinct()
    for part in (names_, typed, described, shares):
        rows = rows.join(part.hint("merge"), "disease_id", "left")
    return rows.select("disease_id", "names", "disease_type", F.coalesce("description", F.lit("")).alias("description"), "shares")
