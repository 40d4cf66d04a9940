"""Derivation of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import climb, ontology


def association_count(annotation: DataFrame, groups: DataFrame, closure: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, n): distinct disease groups of a term or any descendant, at least 1."""
    by_group = annotation.join(groups, "disease_id").select("term_id", "group_id").distinct()
    up = by_group.join(ontology.with_self(closure, terms), "term_id").select("ancestor_id", "group_id").distinct()
    n = up.groupBy(F.col("ancestor_id").alias("term_id")).agg(F.count("*").alias("_n"))
    return terms.select("term_id").distinct().join(n, "term_id", "left").select("term_id", F.coalesce("_n", F.lit(1)).alias("n"))


def association_count_by_climb(annotation: DataFrame, groups: DataFrame, ontology_: climb.Terms, terms: DataFrame) -> DataFrame:
    """``association_count``: a group's pairs meet in one task, which climbs from them and counts; a row a task and term is shuffled after that."""
    by_group = annotation.select("disease_id", "term_id").join(groups.hint("merge"), "disease_id").where("group_id is not null and term_id is not null")
    n = climb.per_term(ontology_, by_group.select("group_id", "term_id"), "group_id").select("term_id", F.col("n").alias("_n"))
    return terms.select("term_id").distinct().join(n.hint("merge"), "term_id", "left").select("term_id", F.coalesce("_n", F.lit(1)).alias("n"))


def information_content(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(term_id, ic): -ln of the share of groups."""
    total = groups.agg(F.countDistinct("group_id").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("term_id", F.log(F.col("_all") / F.col("n")).alias("ic"))


def term_universe(annotation: DataFrame, closure: DataFrame, root) -> DataFrame:
    """Annotated terms, their ancestors and descendants, and everything under the root."""
    a = annotation.select("term_id").distinct()
    up = closure.join(a, "term_id").select(F.col("ancestor_id").alias("term_id"))
    down = closure.join(a.withColumnRenamed("term_id", "ancestor_id"), "ancestor_id").select("term_id")
    under = closure.where(F.col("ancestor_id") == root).select("term_id")
    return a.union(up).union(down).union(under).distinct()


def ic_minmax(ic: DataFrame) -> DataFrame:
    """Information content scaled to [0, 1]; 0.5 where it is constant."""
    span = ic.agg(F.min("ic").alias("_lo"), F.max("ic").alias("_hi"))
    return ic.crossJoin(F.broadcast(span)).select("term_id", F.when(F.col("_hi") > F.col("_lo"), (F.col("ic") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5).alias("ic_scaled"))


def disease_term_edges(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """By group and term: sorted displays, the largest share in 4 digits (blank if none), sources; a quote guards text with fractions."""
    rows = merged.join(groups, "disease_id").groupBy("group_id", "term_id").agg(F.flatten(F.collect_list("frequencies")).alias("f"), F.max("frequency_num").alias("top"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("s"))
    from ..functions.frequency import freq_display

    shown = F.array_join(F.array_sort(F.array_distinct(F.transform("f", freq_display))), "; ")
    return rows.select("group_id", "term_id", F.when(shown.contains("/"), F.concat(F.lit("'"), shown)).otherwise(shown).alias("frequency"), F.when(F.col("top").isNotNull(), F.format_string("%.4f", "top")).otherwise("").alias("frequency_max"), F.when(F.size("s") > 0, F.array_join("s", "; ")).otherwise("unknown").alias("source"))


def gene_term_edges(gene: DataFrame, annotation: DataFrame, closure: DataFrame, edge: DataFrame, groups: DataFrame) -> DataFrame:
    """Genes of annotated pairs and of annotated pairs below them; a term also inherits from the parent of which it is the only child."""
    pairs = annotation.select("disease_id", "term_id").distinct()
    own = gene.join(pairs, ["disease_id", "term_id"], "left_semi").select("gene_id", "disease_id", "term_id").distinct()
    above = own.join(closure.select("term_id", "ancestor_id"), "term_id").select("gene_id", "disease_id", F.col("ancestor_id").alias("term_id")).join(pairs, ["disease_id", "term_id"], "left_semi")
    both = own.unionByName(above).distinct()
    single = ontology.only_child(edge)
    handed = both.join(single.hint("merge"), both.term_id == single.parent).select("gene_id", "disease_id", F.col("child").alias("term_id")).join(pairs, ["disease_id", "term_id"], "left_semi")
    whole = both.unionByName(handed).distinct().join(groups, "disease_id")
    return whole.groupBy("gene_id", "term_id", "group_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("disease_id").cast("string"))), ";").alias("disease_ids"))


def gene_disease_edges(gene: DataFrame, groups: DataFrame) -> DataFrame:
    return gene.select(F.regexp_replace(F.col("gene_id").cast("string"), "^NCBIGene:", "").alias("gene_id"), "disease_id").distinct().join(groups, "disease_id").select("gene_id", "group_id").distinct()


def typed_weighted_graph(edge: DataFrame, annotation: DataFrame, gene_disease: DataFrame) -> DataFrame:
    """(u, v, kind, w): parents to children, diseases to terms, genes to diseases."""
    return (
        edge.select(F.col("parent").cast("string").alias("u"), F.col("child").cast("string").alias("v"), F.lit("is_a").alias("kind"), F.lit(1.0).alias("w"))
        .unionByName(annotation.select(F.col("disease_id").cast("string").alias("u"), F.col("term_id").cast("string").alias("v"), F.lit("has_symptom").alias("kind"), F.when(F.col("freq").between(0, 1), F.col("freq")).otherwise(0.5).alias("w")))
        .unionByName(gene_disease.select(F.col("gene_id").cast("string").alias("u"), F.col("disease_id").cast("string").alias("v"), F.lit("causes").alias("kind"), F.lit(1.0).alias("w")))
        .groupBy("u", "v", "kind").agg(F.max("w").alias("w"))
    )


def edge_training_weight(graph: DataFrame, scaled: DataFrame) -> DataFrame:
    """Weights for training: symptoms twice their share times the term's scaled content, is-a the child's or parent's."""
    ic = scaled.select(F.col("term_id").cast("string").alias("_t"), F.col("ic_scaled"))
    v = ic.select(F.col("_t").alias("v"), F.col("ic_scaled").alias("_v"))
    u = ic.select(F.col("_t").alias("u"), F.col("ic_scaled").alias("_u"))
    joined = graph.join(v, "v", "left").join(u, "u", "left")
    w = F.when(F.col("kind") == "has_symptom", F.col("w") * 2 * F.coalesce("_v", F.lit(0.5))).when(F.col("kind") == "is_a", F.coalesce("_v", "_u", F.lit(0.5))).otherwise(F.col("w"))
    return joined.select("u", "v", "kind", w.alias("weight"))


def numbered(df: DataFrame, order: str, out: str, first: int = 1) -> DataFrame:
    """Consecutive numbers in the order of a column: sorted by range, numbered within, and moved by the counts before."""
    from .lineage import cut

    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    inner = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_b"))
    return inner.join(F.broadcast(before), "_p").withColumn(out, (F.col("_n") + F.col("_b") + (first - 1)).cast("long")).drop("_p", "_n", "_b")


def negative_samples(edges: DataFrame, nodes: DataFrame, k: int, seed: int, epoch: int = 0) -> DataFrame:
    """For edges (edge_id, u, v) and nodes (node_id from 0, node): k corrupted tails and heads each, by integer arithmetic alone."""
    n = nodes.count()
    drawn = edges.select("edge_id", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1))).alias("i"))
    pick = F.pmod((F.col("edge_id") * 2654435761 + F.col("i") * 40503 + F.lit(seed * 97 + epoch * 7919)), F.lit(n))
    joined = drawn.withColumn("node_id", pick).join(nodes.hint("merge"), "node_id")
    tail = F.col("i") < k
    return joined.select("edge_id", "i", F.when(tail, F.col("u")).otherwise(F.col("node")).alias("u"), F.when(tail, F.col("node")).otherwise(F.col("v")).alias("v"))


def classification_flatten(rows: DataFrame) -> DataFrame:
    """By disorder: its names, types, classifications and categories, each joined by " | "."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ").alias(c)
    return rows.groupBy("disease_id").agg(*[joined(c) for c in ("name", "disorder_type", "classification", "category")])


def all_graph_diseases(annotation: DataFrame, gene_disease: DataFrame) -> DataFrame:
    return annotation.select("disease_id").union(gene_disease.select("disease_id")).distinct()
