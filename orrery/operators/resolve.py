"""Integration of sources and entity resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frequency as freq
from . import climb
from .lineage import cut, dealt_evenly, looked_up, small


def positive_annotations(rows: DataFrame) -> DataFrame:
    """(disease_id, term_id, n_rows) of pairs that are not negated."""
    ok = rows.where((F.coalesce("qualifier", F.lit("")) != "NOT") & F.col("disease_id").isNotNull() & F.col("term_id").isNotNull())
    return ok.groupBy("disease_id", "term_id").agg(F.count("*").alias("n_rows"))


def merge_frequency_values(rows: DataFrame, order: list[str]) -> DataFrame:
    """By pair, the distinct values, types and sources in the order of ``order``."""
    kept = rows.where(F.coalesce("qualifier", F.lit("")) != "NOT")
    listed = kept.groupBy("disease_id", "term_id").agg(F.array_sort(F.collect_list(F.struct(*order, "frequency", "source"))).alias("s"))
    values = F.array_distinct(F.filter(F.transform("s", lambda x: x["frequency"]), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))
    return listed.select("disease_id", "term_id", values.alias("frequencies"), F.transform(values, freq.freq_type).alias("frequency_types"), F.array_distinct(F.transform("s", lambda x: x["source"])).alias("sources"))


def frequency_numeric(merged: DataFrame) -> DataFrame:
    """Adds ``frequency_num``, the largest readable share, NULL if there is none."""
    return merged.withColumn("frequency_num", F.array_max(F.transform("frequencies", lambda f: freq.freq_max(f))))


def alias_table(sources: list[DataFrame]) -> DataFrame:
    """(disease_id, name, aliases): sources (disease_id, alias, pos) in order of precedence; the first name, and distinct aliases in order."""
    ranked = [s.select("disease_id", "alias", "pos", F.lit(i).alias("src")) for i, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    rows = rows.where(F.trim(F.coalesce("alias", F.lit(""))) != "")
    return rows.groupBy("disease_id").agg(F.min_by("alias", F.struct("src", "pos")).alias("name"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("src", "pos", "alias"))), lambda x: x["alias"])).alias("aliases"))


def dedup_aliases(alias: DataFrame) -> DataFrame:
    """Of spellings that differ in case, the first (by pos) of each id."""
    w = Window.partitionBy("disease_id", F.lower("alias")).orderBy("pos")
    return alias.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def entity_groups(alias: DataFrame) -> DataFrame:
    """(disease_id, group_id): ids that share a name, ignoring case, directly or through others; the group's id is its least.

    Each name links its ids to its least id, which gives a forest; large and small stars in turn (Kiveris and others, 2014)
    contract it until every id is linked to its group's least id. A round is a written table that has no more links than the
    one before, minima are combined before they are shuffled, and keys that hold much of a table are looked up by a broadcast."""
    links = cut(alias.select("disease_id", F.lower(F.trim("alias")).alias("a")).where("a <> '' and disease_id is not null").distinct())
    least = links.groupBy("a").agg(F.min("disease_id").alias("v"), F.count("*").alias("_n"))
    edges = cut(looked_up(links, least, "a").where("disease_id > v").select(F.col("disease_id").alias("u"), "v").distinct())
    state = None
    while True:
        edges = cut(small_stars(cut(large_stars(edges))))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    ids = alias.select("disease_id").where("disease_id is not null").distinct()
    return ids.join(edges.select(F.col("u").alias("disease_id"), "v").hint("merge"), "disease_id", "left").select("disease_id", F.coalesce("v", "disease_id").alias("group_id"))


def large_stars(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours; edges are (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("_n"))
    return looked_up(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_stars(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    met = looked_up(edges, least, "u")
    return met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).distinct()


def propagate_annotations(annotation: DataFrame, groups: DataFrame) -> DataFrame:
    """Every id of a group gets the group's pairs, with the largest share among them."""
    whole = annotation.join(groups, "disease_id").groupBy("group_id", "term_id").agg(F.max("freq").alias("freq"))
    return given_to_ids(whole, groups).select("disease_id", "term_id", "freq")


def given_to_ids(whole: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows (group_id, term_id, ...) of each group once for every id of it. These grow with the square of a group's size, so they
    come last and are not moved: a group's rows are dealt by term to a fixed number of tasks, and its ids go to them as one list."""
    pairs = groups.select("group_id", "disease_id").distinct()
    ids = cut(pairs.groupBy("group_id").agg(F.collect_list("disease_id").alias("_ids")).withColumn("_one", F.when(F.size("_ids") == 1, F.col("_ids")[0])))
    dealt = dealt_evenly(whole, "group_id", "term_id")
    several = dealt.join(small(ids.where("_one is null").select("group_id", "_ids")), "group_id").withColumn("disease_id", F.explode("_ids")).drop("_ids")
    single = whole.join(small(ids.where("_one is not null").select("group_id", F.col("_one").alias("disease_id"))), "group_id")
    return single.unionByName(several)


def annotations_of_groups(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """(disease_id, term_id, frequency, frequency_type, source, n_terms): every id of a group with all its terms. Frequency texts
    of its ids follow each other, by id, as do their types, unless one is a code (then the type is hpo_id); sources are listed
    once; ``n_terms`` counts the group's distinct terms. ``merged`` has frequencies, types and sources of (disease_id, term_id)."""
    some = lambda x: x != ""
    per_id = merged.select("disease_id", "term_id", F.array_join("frequencies", "; ").alias("f"), F.array_join("frequency_types", "; ").alias("t"), "sources").join(groups, "disease_id")
    listed = per_id.groupBy("group_id", "term_id").agg(F.array_sort(F.collect_list(F.struct("disease_id", "f", "t", "sources"))).alias("s"))
    types = F.transform("s", lambda x: x["t"])
    whole = listed.select(
        "group_id", "term_id", F.array_join(F.filter(F.transform("s", lambda x: x["f"]), some), "; ").alias("frequency"),
        F.when(F.exists(types, lambda t: t.contains("hpo_id")), "hpo_id").otherwise(F.array_join(F.filter(types, some), "; ")).alias("frequency_type"),
        F.array_join(F.array_distinct(F.flatten(F.transform("s", lambda x: x["sources"]))), "; ").alias("source"))
    sizes = whole.groupBy("group_id").agg(F.count("*").alias("n_terms"))
    return given_to_ids(whole.join(sizes.hint("merge"), "group_id"), groups).select("disease_id", "term_id", "frequency", "frequency_type", "source", "n_terms")


#: Frequency labels and their codes.
LABEL_CODES = {"excluded": "HP:0040285", "very rare": "HP:0040284", "rare": "HP:0040284", "occasional": "HP:0040283", "frequent": "HP:0040282", "very frequent": "HP:0040281", "obligate": "HP:0040280"}


def orphanet_annotations(rows: DataFrame) -> DataFrame:
    """(disease_id, term_id, frequency, frequency_type, source) of (orpha_code, term_id, frequency_label): labels, in any case and
    without what is in parentheses, become codes, other texts stay with their type. Rows without a code or a term, and
    excluded terms, go."""
    label = F.trim(F.split_part(F.coalesce("frequency_label", F.lit("")), F.lit("("), F.lit(1)))
    code = F.try_element_at(F.create_map(*[F.lit(v) for pair in LABEL_CODES.items() for v in pair]), F.lower(label))
    text = F.coalesce(code, label)
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    kept = rows.where(~blank("orpha_code") & (F.lower(F.trim(F.col("orpha_code").cast("string"))) != "nan") & ~blank("term_id")).withColumn("frequency", text).where(F.col("frequency") != LABEL_CODES["excluded"])
    return kept.select(F.concat(F.lit("ORPHA:"), F.trim(F.col("orpha_code").cast("string"))).alias("disease_id"), F.trim("term_id").alias("term_id"), "frequency", freq.freq_type(F.col("frequency")).alias("frequency_type"), F.lit("orphanet").alias("source"))


def type_of_namesakes(named: DataFrame, typed: DataFrame) -> DataFrame:
    """(disease_id, disease_type): an id without a type has that of the least id that bears the same name, ignoring case, and has one."""
    own = named.select("disease_id", F.lower("name").alias("_name")).join(typed.where("disease_type is not null").hint("merge"), "disease_id", "left")
    first = own.where("disease_type is not null and _name is not null").groupBy("_name").agg(F.min_by("disease_type", "disease_id").alias("_type"), F.count("*").alias("_n"))
    found = looked_up(own.where("disease_type is null and _name is not null").select("disease_id", "_name"), first, "_name")
    return own.join(found.select("disease_id", "_type").hint("merge"), "disease_id", "left").select("disease_id", F.coalesce("disease_type", "_type").alias("disease_type"))


def propagate_aliases(alias: DataFrame, groups: DataFrame) -> DataFrame:
    """Every id of a group gets the group's aliases; of spellings that differ in case the least."""
    whole = alias.join(groups, "disease_id").groupBy("group_id", F.lower("alias").alias("_k")).agg(F.min("alias").alias("alias"))
    return groups.join(whole, "group_id").select("disease_id", "alias")


def propagate_description(described: DataFrame, groups: DataFrame) -> DataFrame:
    """Every id gets its group's longest description; ties go to the least."""
    longest = described.join(groups, "disease_id").groupBy("group_id").agg(F.min_by("description", F.struct(-F.length("description"), "description")).alias("description"))
    return groups.join(longest, "group_id").select("disease_id", "description")


def propagate_type(typed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every id gets the type of its group's first typed id, and is rare if any member is."""
    whole = typed.join(groups, "disease_id").groupBy("group_id").agg(F.min_by("disease_type", F.when(F.col("disease_type").isNotNull(), F.col("disease_id"))).alias("disease_type"), F.bool_or("is_rare").alias("is_rare"))
    return groups.join(whole, "group_id").select("disease_id", "disease_type", "is_rare")


def lr_group_merge(models: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, preferred_id, term_id, freq): one model per group, the largest share of each term; OMIM before ORPHA before DECIPHER before others."""
    text = F.col("disease_id").cast("string")
    rank = F.when(text.startswith("OMIM"), 0).when(text.startswith("ORPHA"), 1).when(text.startswith("DECIPHER"), 2).otherwise(3)
    first = groups.groupBy("group_id").agg(F.min_by("disease_id", F.struct(rank.alias("r"), "disease_id")).alias("preferred_id"))
    return models.join(groups, "disease_id").groupBy("group_id", "term_id").agg(F.max("freq").alias("freq")).join(first, "group_id")


def augment_models(models: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables' pairs with the larger share."""
    return models.select("disease_id", "term_id", "freq").unionByName(more.select("disease_id", "term_id", "freq")).groupBy("disease_id", "term_id").agg(F.max("freq").alias("freq"))


def case_annotations(cases: DataFrame, prefixes: tuple[str, ...] = ("OMIM:", "ORPHA:")) -> DataFrame:
    """(disease_id, term_id) pairs of a case library, for ids with the given prefixes (all ids if there are none).

    A disease's cases meet in one task as lists of terms, and are unfolded there; pairs are not moved. The task holds a disease's
    distinct terms and about ``PAIRS`` more."""
    whole = isinstance(cases.schema["diseases"].dataType.elementType, T.IntegralType)
    text = lambda c: F.trim(c.cast("string"))
    rows = cases.select(F.explode("diseases").alias("disease_id"), "terms").where(F.size("terms") > 0)
    rows = rows if whole else rows.withColumn("disease_id", text(F.col("disease_id")))
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | text(F.col("disease_id")).startswith(p)
    kind, term = (rows.schema[c].dataType for c in ("disease_id", "terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            lists = batch.column(1)
            held.append(pa.table({"disease_id": batch.column(0).take(pc.list_parent_indices(lists)), "term_id": pc.list_flatten(lists)}))
            size += held[-1].num_rows
            if size > PAIRS:
                met = once(held)
                # the last disease's rows may go on
                last = pc.equal(met["disease_id"], batch.column(0)[-1]).fill_null(False) if batch.column(0)[-1].is_valid else pc.is_null(met["disease_id"])
                yield from met.filter(pc.invert(last)).to_batches(PAIRS)
                held, size = [met.filter(last)], 0
        if held:
            yield from once(held).to_batches(PAIRS)

    found = climb.dealt(rows.where(keep), "disease_id").mapInArrow(run, T.StructType([T.StructField("disease_id", kind), T.StructField("term_id", term.elementType)]))
    return found.select(text(F.col("disease_id")).alias("disease_id"), "term_id")


#: Pairs of a disease and a term that a task unfolds at once.
PAIRS = 1_000_000


def once(parts: list[pa.Table]) -> pa.Table:
    """The distinct rows of the tables."""
    rows = pa.concat_tables(parts).combine_chunks()
    return rows.group_by(rows.column_names, use_threads=False).aggregate([])


def filter_diseases(df: DataFrame, prefixes: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Rows of the target ids if there are any given, else of ids with one of the prefixes, ignoring case."""
    if targets is not None:
        return df.join(targets.select(F.lower(F.col("disease_id").cast("string")).alias("_t")).distinct(), F.lower(F.col("disease_id").cast("string")) == F.col("_t"), "left_semi")
    if prefixes:
        return df.where(F.lower(F.split_part(F.col("disease_id").cast("string"), F.lit(":"), F.lit(1))).isin([p.lower() for p in prefixes]))
    return df


def summary(annotation: DataFrame, merged: DataFrame) -> DataFrame:
    """Counts for a check of the integration."""
    a = annotation.agg(F.countDistinct("disease_id").alias("n_diseases"), F.countDistinct("term_id").alias("n_terms"), F.count("*").alias("n_pairs"))
    b = merged.agg(F.sum(F.size("frequencies")).alias("n_frequencies"), F.count_if(F.size("frequencies") == 0).alias("n_without"))
    return a.crossJoin(F.broadcast(b))


def add_gene_annotations(annotation: DataFrame, gene: DataFrame) -> DataFrame:
    """Annotated pairs and those that gene tables give."""
    return annotation.select("disease_id", "term_id").union(gene.select("disease_id", "term_id")).distinct()
