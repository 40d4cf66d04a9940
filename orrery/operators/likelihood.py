"""Likelihood-ratio ranking. A ratio depends on a query term and a disease alone, so it is computed once for each distinct term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frequency as freq
from . import climb, ontology, ratio_blocks, ratio_pairs
from .lineage import cut, small

# Fixed values of the model.
BACKGROUND, EXCLUDED_PRESENT, EXCLUDED_BOTH, FALSE_NEGATIVE, NO_COMMON_ORGAN, NO_MATCH, LOW, FLOOR = 1e-4, 1e-3, 1000.0, 0.01, 0.01, 0.5, 0.1, 0.3


class RULES:
    """The constants as ``ratio_blocks`` takes them."""

    BACKGROUND, EXCLUDED_PRESENT, EXCLUDED_BOTH, FALSE_NEGATIVE, NO_COMMON_ORGAN, NO_MATCH, LOW, FLOOR = BACKGROUND, EXCLUDED_PRESENT, EXCLUDED_BOTH, FALSE_NEGATIVE, NO_COMMON_ORGAN, NO_MATCH, LOW, FLOOR


def lr_models(rows: DataFrame, aspect: str | None = None, prefixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Annotations (disease_id, term_id, freq) with summed ratios of at most 1, and absent pairs; with ``aspect`` only rows of that
    aspect, with ``prefixes`` only diseases whose ids begin with one of them."""
    if aspect is not None:
        rows = rows.where(F.col("aspect") == aspect)
    if prefixes:
        rows = rows.where(F.split_part(F.col("disease_id").cast("string"), F.lit(":"), F.lit(1)).isin(*prefixes))
    negated = F.coalesce("qualifier", F.lit("")) == "NOT"
    present = freq.by_value(rows.where(~negated), "frequency", lambda s: freq.lr_freq_ratio(F.lit(False), s), "r").where("r is not null")
    model = present.groupBy("disease_id", "term_id").agg(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.sum("r.num"), F.sum("r.den")), F.lit(0.0))).alias("freq"))
    return model, rows.where(negated).select("disease_id", "term_id").distinct()


def spread(model: DataFrame, closure_self: DataFrame) -> DataFrame:
    """(disease_id, term_id, top, f): the largest share at or below a term, plain and halved for each level between."""
    up = model.join(closure_self, "term_id")
    return up.groupBy("disease_id", F.col("ancestor_id").alias("term_id")).agg(F.max("freq").alias("top"), F.max(F.col("freq") / F.pow(F.lit(2.0), "distance")).alias("f"))


def background_of(spread_: DataFrame, model: DataFrame) -> DataFrame:
    n = model.agg(F.countDistinct("disease_id").alias("_n"))  # one row
    raw = F.col("s") / F.col("_n")
    return spread_.groupBy("term_id").agg(F.sum("top").alias("s")).crossJoin(F.broadcast(n)).select("term_id", raw.alias("raw"), F.greatest(raw, F.lit(BACKGROUND)).alias("bg"))


def background_frequency(model: DataFrame, closure_self: DataFrame) -> DataFrame:
    """(term_id, raw, bg): a disease's largest share at or below a term, summed over diseases, by their number."""
    return background_of(spread(model, closure_self), model)


def background_by_climb(model: DataFrame, ontology_: climb.Terms) -> DataFrame:
    """``background_frequency``: a disease's annotations meet in one task, which climbs from them and sums."""
    n = model.agg(F.countDistinct("disease_id").alias("_n"))  # one row
    sums = climb.per_term(ontology_, model.where("disease_id is not null and term_id is not null"), "disease_id", "freq")
    raw = F.col("s") / F.col("_n")
    return sums.crossJoin(F.broadcast(n)).select("term_id", raw.alias("raw"), F.greatest(raw, F.lit(BACKGROUND)).alias("bg"))


def induced_by_climb(model: DataFrame, ontology_: climb.Terms, root) -> DataFrame:
    """``induced_frequency``, made in the task that holds a disease and not moved."""
    found = climb.climbed(ontology_, model.where("disease_id is not null and term_id is not null").withColumnRenamed("freq", "f"), "disease_id", ("f",), (0,))
    return found.where(F.col("term_id") != root)


def induced_frequency(model: DataFrame, closure_self: DataFrame, root) -> DataFrame:
    """(disease_id, term_id, f): the largest share halved for each level above an annotation; not for the root."""
    return spread(model, closure_self).where(F.col("term_id") != root).select("disease_id", "term_id", "f")


def no_common_organ(raw):
    return 0.002 + (F.coalesce(raw, F.lit(NO_COMMON_ORGAN)) - 0.01) * (0.098 / 0.09)


def lr_observed(terms: DataFrame, model: DataFrame, absent: DataFrame, edge: DataFrame, closure: DataFrame, root) -> DataFrame:
    """(term_id, disease_id, lr, match_type) of the pairs that any of the first five cases reaches; for others the ratio is NO_MATCH."""
    laid = ratio_blocks.laid_out(terms, model, absent, edge, root)
    if laid is not None:
        return ratio_blocks.all_ratios(laid, terms, RULES)
    held = ratio_pairs.model_of(terms, model, absent, edge, root, RULES)
    return lr_observed_by_joins(terms, model, absent, edge, closure() if callable(closure) else closure, root) if held is None else ratio_pairs.all_ratios(held, terms, RULES)


def lr_observed_by_joins(terms: DataFrame, model: DataFrame, absent: DataFrame, edge: DataFrame, closure: DataFrame, root) -> DataFrame:
    """The same for an ontology of any size.

    Each case gives rows tagged with its number; one aggregation by term and disease takes each case's value, and the
    first case that has one decides. The model, its spread up the ontology and the asked terms are written once."""
    model, t = cut(model), cut(terms.select("term_id").distinct())
    whole = cut(spread(model, ontology.with_self(closure, model.select("term_id").union(t))))
    bg = cut(background_of(whole, model))
    asked = closure.join(small(t), "term_id", "left_semi")
    up = ontology.with_self(asked, t)
    children = edge.groupBy(F.col("parent").alias("ancestor_id")).agg(F.countDistinct("child").alias("_n"))
    below = closure.select(F.col("term_id").alias("_d"), F.col("ancestor_id").alias("term_id"), "distance").join(small(t), "term_id", "left_semi").unionByName(t.select(F.col("term_id").alias("_d"), "term_id", F.lit(0).alias("distance")))
    shares = model.select(F.col("term_id").alias("ancestor_id"), "disease_id", "freq")
    nothing = F.lit(None).cast("struct<distance:int,ancestor_id:bigint,v:double>")
    row = lambda df, k, v, near=nothing: df.select("term_id", "disease_id", k.alias("k"), v.alias("v"), near.alias("near"))
    excluded = row(up.join(absent.withColumnRenamed("term_id", "ancestor_id"), "ancestor_id"), F.lit(1), F.lit(EXCLUDED_PRESENT))
    within = row(below.join(model.select(F.col("term_id").alias("_d"), "disease_id", "freq"), "_d"), F.when(F.col("distance") == 0, 2).otherwise(3), F.col("freq"))
    above = row(asked.join(shares, "ancestor_id").join(children.hint("merge"), "ancestor_id"), F.lit(4), F.col("freq") / F.col("_n") * F.pow(F.lit(0.5), F.col("distance") - 1))
    # an induced share comes with its own term's background
    induced = whole.join(bg, "term_id").select(F.col("term_id").alias("ancestor_id"), "disease_id", (F.col("f") / F.col("bg")).alias("ratio"))
    near = up.where(F.col("ancestor_id") != root).join(induced.hint("merge"), "ancestor_id")
    common = row(near, F.lit(5), F.lit(None).cast("double"), F.struct(F.col("distance").cast("int").alias("distance"), F.col("ancestor_id").cast("long").alias("ancestor_id"), F.col("ratio").alias("v")))
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"c{k}")
    met = excluded.unionByName(within).unionByName(above).unionByName(common).groupBy("term_id", "disease_id").agg(*[value(k) for k in range(1, 5)], F.min("near").alias("near"))
    joined = met.join(small(bg), "term_id", "left").withColumn("bg", F.coalesce("bg", F.lit(BACKGROUND)))
    case = [
        (F.col("c1").isNotNull(), F.col("c1"), "present but excluded in disease"),
        (F.col("c2").isNotNull(), F.col("c2") / F.col("bg"), "exact match"),
        (F.col("c3").isNotNull(), F.col("c3") / F.col("bg"), "disease term below query"),
        (F.col("c4") > 0, F.greatest(F.col("c4"), no_common_organ(F.col("raw"))) / F.col("bg"), "query below disease term"),
        (F.col("near").isNotNull(), F.greatest(F.lit(NO_COMMON_ORGAN), F.col("near.v")), "common ancestor"),
    ]
    lr, kind = F.lit(NO_MATCH), F.lit("no match below root")
    for cond, value_, said in reversed(case):
        lr, kind = F.when(cond, value_).otherwise(lr), F.when(cond, said).otherwise(kind)
    return joined.select("term_id", "disease_id", lr.alias("lr"), kind.alias("match_type"))


def lr_excluded(pairs: DataFrame, model: DataFrame, absent: DataFrame, closure: DataFrame) -> DataFrame:
    """For pairs (term_id, disease_id) of a term that the patient does not have: (term_id, disease_id, lr)."""
    mine = ontology.with_self(closure, model.select("term_id").union(pairs.select("term_id")).union(absent.select("term_id")))
    bg = background_frequency(model, mine)
    gone = absent.join(mine, "term_id").select(F.col("ancestor_id").alias("term_id"), "disease_id").distinct().withColumn("_gone", F.lit(True))
    tops = model.join(mine, "term_id").groupBy(F.col("ancestor_id").alias("term_id"), "disease_id").agg(F.max("freq").alias("_f"))
    up = closure.join(pairs.select("term_id").distinct(), "term_id", "left_semi").join(model.select(F.col("term_id").alias("ancestor_id"), "disease_id"), "ancestor_id").select("term_id", "disease_id").distinct().withColumn("_under", F.lit(True))
    keys = ["term_id", "disease_id"]
    j = pairs.distinct().join(gone.hint("merge"), keys, "left").join(tops.hint("merge"), keys, "left").join(up.hint("merge"), keys, "left").join(bg.hint("merge"), "term_id", "left").withColumn("bg", F.coalesce("bg", F.lit(BACKGROUND)))
    lr = F.when(F.col("_gone"), EXCLUDED_BOTH).when(F.col("bg") > 0.99, 1.0).when(F.col("_f").isNull() & F.col("_under").isNull(), 1 / (1 - F.col("bg"))).otherwise(F.greatest(F.lit(FALSE_NEGATIVE), 1 - F.coalesce("_f", F.lit(0.0))) / (1 - F.col("bg")))
    return j.select("term_id", "disease_id", lr.alias("lr"))


def with_posterior(sums: DataFrame, diseases: DataFrame) -> DataFrame:
    """The pretest probability is the same for all diseases."""
    n = diseases.select("disease_id").distinct().agg(F.count("*").alias("_n"))  # one row
    rows = sums.crossJoin(F.broadcast(n)).withColumn("log_lr", F.round("log_lr", 9))
    return rows.select("patient_id", "disease_id", "log_lr", (1 / (1 + (F.col("_n") - 1) * F.exp(-F.col("log_lr")))).alias("posterior"))


def posteriors(query: DataFrame, lr: DataFrame, diseases: DataFrame) -> DataFrame:
    """(patient_id, disease_id, log_lr, posterior) of the pairs that a case reaches: logs of floored ratios add up; terms that
    no case reaches add ln 0.5 each."""
    floored = F.greatest(F.when(F.col("lr") < LOW, F.greatest(F.col("lr"), F.lit(FLOOR))).otherwise(F.col("lr")), F.lit(1e-10))
    sizes = query.groupBy("patient_id").agg(F.countDistinct("term_id").alias("_q"))
    summed = query.distinct().join(lr.select("term_id", "disease_id", F.log(floored).alias("l")), "term_id").groupBy("patient_id", "disease_id").agg(F.sum("l").alias("_s"), F.count("*").alias("_m"))
    rows = summed.join(sizes.hint("merge"), "patient_id").select("patient_id", "disease_id", (F.col("_s") + (F.col("_q") - F.col("_m")) * F.log(F.lit(NO_MATCH))).alias("log_lr"))
    return with_posterior(rows, diseases)


def model_posteriors(query: DataFrame, model: DataFrame, absent: DataFrame, edge: DataFrame, closure: DataFrame, root, diseases: DataFrame, k: int | None = None) -> DataFrame:
    """``posteriors`` from the model itself; with ``k`` at least each patient's k likeliest diseases. Blocks of diseases are scored
    in their tasks, without a row for a term and a disease, unless the ontology is too large to be sent to them."""
    laid = ratio_blocks.laid_out(query, model, absent, edge, root)
    if laid is None:
        return posteriors(query, lr_observed_by_joins(query, model, absent, edge, closure, root), diseases)
    return with_posterior(ratio_blocks.log_sums(laid, query, RULES, k), diseases)


def pair_posteriors(pairs: DataFrame, query: DataFrame, model: DataFrame, absent: DataFrame, edge: DataFrame, closure: Callable[[], DataFrame], root, diseases: DataFrame) -> DataFrame:
    """``pairs`` (patient_id, disease_id and more) with their ``posterior``, null where no case is reached; other pairs are not computed unless the
    ontology is too large to be sent, or has a cycle."""
    held = ratio_pairs.model_of(query, model, absent, edge, root, RULES)
    if held is None:
        known = posteriors(query, lr_observed_by_joins(query, model, absent, edge, closure(), root), diseases)
        return pairs.join(known.select("patient_id", "disease_id", "posterior").hint("merge"), ["patient_id", "disease_id"], "left")
    return posterior_of_pairs(held, pairs, query, diseases)


def posterior_of_pairs(held: ratio_pairs.Model, pairs: DataFrame, query: DataFrame, diseases: DataFrame) -> DataFrame:
    n = diseases.select("disease_id").distinct().agg(F.count("*").alias("_n"))  # one row
    rows = ratio_pairs.with_log_sums(held, query, pairs, RULES).crossJoin(F.broadcast(n))
    return rows.withColumn("posterior", 1 / (1 + (F.col("_n") - 1) * F.exp(-F.round("log_lr", 9)))).drop("_n", "log_lr")


def group_posteriors(pairs: DataFrame, query: DataFrame, model: DataFrame, absent: DataFrame, edge: DataFrame, closure: Callable[[], DataFrame], root, groups: DataFrame, eligible: Column) -> DataFrame:
    """``with_group_posterior`` of ``pairs`` where only diseases that are ``eligible`` bear a posterior, computed for these pairs alone: their own,
    then where one is missing that of the group's least eligible id, then, for the few that it does not reach either, those of all others."""
    keys = ["patient_id", "disease_id"]
    held = ratio_pairs.model_of(query, model, absent, edge, root, RULES)
    asked = pairs.select(*keys).distinct()
    if held is None:
        known = posteriors(query, lr_observed_by_joins(query, model, absent, edge, closure(), root), groups)
        return with_group_posterior(asked, cut(known.where(eligible)), groups)
    members = cut(groups.where(eligible).select("group_id", "disease_id", F.row_number().over(Window.partitionBy("group_id").orderBy("disease_id")).alias("_i")))
    scored = lambda p: posterior_of_pairs(held, p, query, groups)
    own = asked.join(groups.hint("merge"), "disease_id", "left")
    own = cut(scored(own.where(eligible)).unionByName(own.where(~eligible).withColumn("posterior", F.lit(None).cast("double"))))
    lacking = own.where("posterior is null and group_id is not null").select("patient_id", "group_id").distinct()
    first = cut(scored(lacking.join(members.where("_i = 1").select("group_id", "disease_id").hint("merge"), "group_id")))
    rest = first.where("posterior is null").select("patient_id", "group_id").join(members.where("_i > 1").select("group_id", "disease_id").hint("merge"), "group_id")
    other = scored(rest).where("posterior is not null").groupBy("patient_id", "group_id").agg(F.min_by("posterior", "disease_id").alias("_g"))
    of_group = first.where("posterior is not null").select("patient_id", "group_id", F.col("posterior").alias("_g")).unionByName(other)
    return own.join(of_group.hint("merge"), ["patient_id", "group_id"], "left").select(*keys, F.coalesce("posterior", "_g", F.lit(0.0)).alias("posterior"))


def with_group_posterior(pairs: DataFrame, posterior: DataFrame, groups: DataFrame) -> DataFrame:
    """(patient_id, disease_id, posterior) of ``pairs``: a disease's own posterior, else that of the least id of its group that
    has one for the patient, else 0."""
    keys = ["patient_id", "disease_id"]
    held = posterior.select(*keys, "posterior")
    of_group = held.join(groups, "disease_id").groupBy("patient_id", "group_id").agg(F.min_by("posterior", "disease_id").alias("_g"))
    rows = pairs.select(*keys).distinct().join(groups, "disease_id", "left").join(held.hint("merge"), keys, "left").join(of_group.hint("merge"), ["patient_id", "group_id"], "left")
    return rows.select(*keys, F.coalesce("posterior", "_g", F.lit(0.0)).alias("posterior"))


def likeliest(posterior: DataFrame, k: int) -> DataFrame:
    """The k likeliest diseases of each patient."""
    w = Window.partitionBy("patient_id").orderBy(F.desc("log_lr"), F.asc("disease_id"))
    return posterior.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lr_rank(query: DataFrame, model: DataFrame, absent: DataFrame, edge: DataFrame, closure: DataFrame, root, diseases: DataFrame, k: int) -> DataFrame:
    """The k likeliest diseases of each patient."""
    return likeliest(model_posteriors(query, model, absent, edge, closure, root, diseases, k), k)


def lr_explain(lr: DataFrame) -> DataFrame:
    """(term_id, disease_id, explanation): the match type and the ratio, rounded half up to four digits as a decimal."""
    four = F.round(F.col("lr").cast("decimal(30,12)"), 4).cast("decimal(30,4)").cast("string")
    return lr.select("term_id", "disease_id", F.concat("match_type", F.lit(": LR "), four).alias("explanation"))
