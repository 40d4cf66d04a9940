"""The given tables in the roles of the domain, and the same roles as SQL for the oracles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frequency as freq
from ..operators import climb, kg, likelihood, ontology, resolve
from ..operators.lineage import dealt_evenly, kept


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def term(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("name"))

    @cached_property
    def edge(self) -> DataFrame:
        k = F.col("p_partkey")
        parents = F.when(k % 5 == 0, F.array(F.floor(k / 3), F.floor(k / 7))).otherwise(F.array(F.floor(k / 3)))
        return self.table("part").where(k > 0).select(k.alias("child"), F.explode(parents).alias("parent")).distinct()

    @cached_property
    def closure(self) -> DataFrame:
        return kept(self.spark, f"{self.dir} closure", lambda: ontology.closure(self.edge))

    @cached_property
    def parents(self) -> DataFrame:
        """The closure's rows of distance 1; the rest is not made."""
        return self.edge.where("child <> parent").select(F.col("child").alias("term_id"), F.col("parent").alias("ancestor_id"), F.lit(1).alias("distance"))

    @cached_property
    def annotation_rows(self) -> DataFrame:
        q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
        word = F.element_at(F.array(*[F.lit(w) for w in freq.WORDS]), q % 6 + 1)
        text = F.when(n == 0, F.concat(q.cast("string"), F.lit("/50"))).when(n == 1, F.concat(q.cast("string"), F.lit("%"))).when(n == 2, F.concat(F.lit("HP:004028"), (q % 6).cast("string"))).when(n == 3, word).otherwise("")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("disease_id"), F.col("l_partkey").alias("term_id"), F.when(F.expr("l_returnflag = 'R' and l_linenumber = 7"), "NOT").otherwise("").alias("qualifier"),
            text.alias("frequency"), F.concat(F.lit("src"), "l_linestatus").alias("source"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))

    @cached_property
    def annotation(self) -> DataFrame:
        return self.shares.groupBy("disease_id", "term_id").agg(F.max("freq").alias("freq"))

    @cached_property
    def shares(self) -> DataFrame:
        """The rows of ``annotation`` before the largest share of each pair is taken."""
        rows = self.annotation_rows.where("qualifier <> 'NOT'")
        return freq.by_value(rows, "frequency", freq.freq_max, "freq").select("disease_id", "term_id", "freq")

    @cached_property
    def absent(self) -> DataFrame:
        return self.annotation_rows.where("qualifier = 'NOT'").select("disease_id", "term_id").distinct()

    @cached_property
    def merged(self) -> DataFrame:
        return resolve.frequency_numeric(resolve.merge_frequency_values(self.annotation_rows, ["o", "l"]))

    @cached_property
    def alias(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        own = s.select(F.col("s_suppkey").alias("disease_id"), F.col("s_name").alias("alias"), F.lit(0).alias("pos"))
        more = s.where("s_suppkey % 3 = 0").join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("disease_id"), F.col("n_name").alias("alias"), F.lit(1).alias("pos"))
        return own.unionByName(more)

    @cached_property
    def groups(self) -> DataFrame:
        return kept(self.spark, f"{self.dir} groups", lambda: resolve.entity_groups(self.alias))

    @cached_property
    def query(self) -> DataFrame:
        o = self.table("orders").where("o_custkey % 20 = 0")  # the query set; everything else reads all rows
        return o.join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("patient_id"), F.col("l_partkey").alias("term_id")).distinct()

    @cached_property
    def case_rows(self) -> DataFrame:
        o = self.table("orders")
        return o.join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("case_id"), F.col("l_partkey").alias("term_id"), F.col("l_suppkey").alias("disease_id"))

    @cached_property
    def cases(self) -> DataFrame:
        rows = self.case_rows.groupBy("case_id").agg(F.array_sort(F.collect_set("term_id")).alias("terms"), F.array_sort(F.collect_set("disease_id")).alias("diseases"))
        return rows.withColumn("department", F.concat(F.lit("dept_"), (F.col("case_id") % 7).cast("string")))

    @cached_property
    def gene(self) -> DataFrame:
        o = self.table("orders")
        return o.join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 50).alias("gene_id"), F.col("l_partkey").alias("term_id"), F.col("l_suppkey").alias("disease_id")).distinct()

    @cached_property
    def embedding(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        n = e.agg(F.max("vec_id").alias("n"))  # one row
        numbered = dealt_evenly(self.term.select("term_id"), "term_id").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("term_id") % (F.col("n") + 1))
        return numbered.join(e, "vec_id").select("term_id", "v")

    @cached_property
    def ball(self) -> DataFrame:
        """The embeddings, drawn into the unit ball."""
        return self.embedding.withColumn("v", F.transform("v", lambda c: c / 16))

    @cached_property
    def ontology(self) -> climb.Terms | None:
        """The terms as arrays that are sent to all tasks; None where there are too many edges."""
        return climb.terms_of(self.edge, self.term)

    @cached_property
    def counts(self) -> DataFrame:
        if self.ontology is None:
            return kg.association_count(self.annotation, self.groups, self.closure, self.term)
        return kg.association_count_by_climb(self.annotation_rows.where("qualifier <> 'NOT'"), self.groups, self.ontology, self.term)

    @cached_property
    def background(self) -> DataFrame:
        model = likelihood.lr_models(self.annotation_rows)[0]
        return likelihood.background_frequency(model, ontology.with_self(self.closure, self.term)) if self.ontology is None else likelihood.background_by_climb(model, self.ontology)

    @cached_property
    def ic(self) -> DataFrame:
        return kept(self.spark, f"{self.dir} ic", lambda: kg.information_content(self.counts, self.groups))

    @cached_property
    def answers(self) -> DataFrame:
        """Answers as a model would write them, out of suppliers' names by nation."""
        s = self.table("supplier")
        line = F.concat(F.lit(". **"), "s_name", F.lit("** (type "), F.col("s_nationkey").cast("string"), F.lit(") - HP:00000"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("; HP:0001250"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("t")))), lambda x, i: F.concat((i + 1).cast("string"), x["t"]))
        return s.groupBy(F.col("s_nationkey").cast("long").alias("answer_id")).agg(F.concat(F.lit("<think>maybe</think>\nFINAL ANSWER\n"), F.array_join(listed, "\n")).alias("text"))


#: The roles as common table expressions.
def sql_freq(t: str) -> str:
    """DuckDB for ``freq_numeric`` of one token."""
    words = " ".join(f"WHEN '{w}' THEN {v}" for w, v in freq.WORDS.items())
    codes = " ".join(f"WHEN '{c}' THEN {freq.WORDS[v[0].lower()]}" for c, v in freq.CODES.items() if v[0].lower() in freq.WORDS)
    x = f"lower(trim({t}))"
    part = lambda p, k: f"try_cast(nullif(regexp_extract({x}, '{p}', {k}), '') AS DOUBLE)"
    slash, of, span = "^(\\d+)/(\\d+)$", "^(\\d+)\\s*of\\s*(\\d+)$", "^(\\d+)%?-(\\d+)%$"
    ratio = lambda p: f"{part(p, 1)} / nullif({part(p, 2)}, 0)"
    return f"coalesce(CASE {x} {words} END, CASE upper(trim({t})) {codes} END, {ratio(slash)}, {part('^([0-9.]+?)\\s*%$', 1)} / 100, {ratio(of)}, ({part(span, 1)} + {part(span, 2)}) / 200)"


_words = ", ".join(f"'{w}'" for w in freq.WORDS)
CTE = {
    "term": "SELECT p_partkey AS term_id, p_name AS name FROM part",
    "edge": "SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 7 FROM part WHERE p_partkey > 0 AND p_partkey % 5 = 0",
    "paths(term_id, ancestor_id, distance)": "SELECT child, parent, 1 FROM edge UNION ALL SELECT p.term_id, e.parent, p.distance + 1 FROM paths p JOIN edge e ON e.child = p.ancestor_id",
    "closure": "SELECT term_id, ancestor_id, min(distance) AS distance FROM paths GROUP BY ALL",
    "selfc": "SELECT * FROM closure UNION ALL SELECT term_id, term_id, 0 FROM term",
    "ann_rows": f"""SELECT l_suppkey AS disease_id, l_partkey AS term_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'NOT' ELSE '' END AS qualifier, 'src' || l_linestatus AS source, l_orderkey AS o, l_linenumber AS l,
      CASE l_linenumber % 5 WHEN 0 THEN CAST(l_quantity AS INT) || '/50' WHEN 1 THEN CAST(l_quantity AS INT) || '%' WHEN 2 THEN 'HP:004028' || (CAST(l_quantity AS INT) % 6) WHEN 3 THEN [{_words}][CAST(l_quantity AS INT) % 6 + 1] ELSE '' END AS frequency
      FROM lineitem""",
    "ann": f"SELECT disease_id, term_id, max({sql_freq('frequency')}) AS freq, count(*) AS n_rows FROM ann_rows WHERE qualifier <> 'NOT' GROUP BY ALL",
    "absent": "SELECT DISTINCT disease_id, term_id FROM ann_rows WHERE qualifier = 'NOT'",
    "alias": "SELECT s_suppkey AS disease_id, s_name AS alias, 0 AS pos FROM supplier UNION ALL SELECT s_suppkey, n_name, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0",
    "grp": "SELECT s_suppkey AS disease_id, CASE WHEN s_suppkey % 3 = 0 THEN min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 3 = 0) ELSE s_suppkey END AS group_id FROM supplier",
    "q": "SELECT DISTINCT o_custkey AS patient_id, l_partkey AS term_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 20 = 0",
    "case_rows": "SELECT o_custkey AS case_id, l_partkey AS term_id, l_suppkey AS disease_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "gene": "SELECT DISTINCT o_custkey % 50 AS gene_id, l_partkey AS term_id, l_suppkey AS disease_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "emb": "SELECT term_id, CAST(embedding AS DOUBLE[]) AS v FROM term JOIN embeddings ON term_id % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id",
    "counts": "SELECT t.term_id, greatest(count(DISTINCT g.group_id), 1) AS n FROM term t LEFT JOIN selfc s ON s.ancestor_id = t.term_id LEFT JOIN ann a ON a.term_id = s.term_id LEFT JOIN grp g ON g.disease_id = a.disease_id GROUP BY 1",
    "ic": "SELECT term_id, ln((SELECT count(DISTINCT group_id) FROM grp) / n) AS ic FROM counts",
    "single": "SELECT parent, min(child) AS child FROM edge GROUP BY 1 HAVING count(DISTINCT child) = 1",
    "cand1": "SELECT DISTINCT patient_id, disease_id FROM q JOIN ann USING (term_id) UNION SELECT patient_id, disease_id FROM q JOIN closure c ON c.term_id = q.term_id AND c.distance <= 1 JOIN ann a ON a.term_id = c.ancestor_id WHERE q.term_id NOT IN (SELECT term_id FROM ann)",
    "direct": "SELECT patient_id, disease_id, term_id AS query_term, term_id AS matched_term, 'direct' AS kind, freq FROM q JOIN ann USING (term_id)",
    "parent1": """SELECT patient_id, disease_id, query_term, matched_term, kind, freq FROM (SELECT q.patient_id, a.disease_id, q.term_id AS query_term, a.term_id AS matched_term, 'by parent' AS kind, a.freq, row_number() OVER (PARTITION BY q.patient_id, a.disease_id, q.term_id ORDER BY c.distance, c.ancestor_id) AS n
      FROM q JOIN closure c ON c.term_id = q.term_id AND c.distance <= 1 JOIN ann a ON a.term_id = c.ancestor_id JOIN cand1 k ON k.patient_id = q.patient_id AND k.disease_id = a.disease_id) x WHERE n = 1 AND (patient_id, disease_id, query_term) NOT IN (SELECT patient_id, disease_id, query_term FROM direct)""",
    "child1": """SELECT q.patient_id, a.disease_id, q.term_id AS query_term, a.term_id AS matched_term, 'by child' AS kind, a.freq FROM q JOIN single s ON s.parent = q.term_id JOIN ann a ON a.term_id = s.child JOIN cand1 k ON k.patient_id = q.patient_id AND k.disease_id = a.disease_id
      WHERE (q.patient_id, a.disease_id, q.term_id) NOT IN (SELECT patient_id, disease_id, query_term FROM direct UNION ALL SELECT patient_id, disease_id, query_term FROM parent1)""",
    "matches": "SELECT *, CASE WHEN freq > 0 THEN freq ELSE 0.5 END AS freq_used FROM (SELECT * FROM direct UNION ALL SELECT * FROM parent1 UNION ALL SELECT * FROM child1)",
    "summary": """SELECT m.patient_id, m.disease_id, count(*) AS n_match, sum(freq_used) AS freq_sum, coalesce(sum(i.ic) / nullif(any_value(t.total), 0), 0) AS ic_share, any_value(d.n) AS total_associations, any_value(t.nq) AS n_query
      FROM matches m JOIN ic i ON i.term_id = m.query_term JOIN (SELECT patient_id, sum(ic) AS total, count(*) AS nq FROM q JOIN ic USING (term_id) GROUP BY 1) t ON t.patient_id = m.patient_id
      JOIN (SELECT disease_id, count(DISTINCT term_id) AS n FROM ann GROUP BY 1) d ON d.disease_id = m.disease_id GROUP BY 1, 2""",
    "lr_rows": """SELECT disease_id, term_id, CASE WHEN frequency = '' THEN [1, 1] WHEN l % 5 = 0 THEN [CAST(split_part(frequency, '/', 1) AS INT), 50] WHEN l % 5 = 1 THEN [CAST(round_even(CAST(replace(frequency, '%', '') AS DOUBLE) * 5 / 100, 0) AS INT), 5]
      WHEN l % 5 = 2 THEN [CAST(round_even(CASE right(frequency, 1) WHEN '0' THEN 1.0 WHEN '1' THEN 0.895 WHEN '2' THEN 0.545 WHEN '3' THEN 0.17 WHEN '4' THEN 0.025 ELSE 0.0 END * 5, 0) AS INT), 5] END AS r FROM ann_rows WHERE qualifier <> 'NOT'""",
    "lr_model": "SELECT disease_id, term_id, least(1.0, sum(r[1]) / sum(r[2])) AS freq FROM lr_rows WHERE r IS NOT NULL GROUP BY ALL",
    "bg": "SELECT term_id, sum(f) / (SELECT count(DISTINCT disease_id) FROM lr_model) AS raw, greatest(sum(f) / (SELECT count(DISTINCT disease_id) FROM lr_model), 1e-4) AS bg FROM (SELECT disease_id, ancestor_id AS term_id, max(freq) AS f FROM lr_model JOIN selfc USING (term_id) GROUP BY ALL) GROUP BY 1",
    "induced": "SELECT disease_id, ancestor_id AS term_id, max(freq / power(2.0, distance)) AS f FROM lr_model JOIN selfc USING (term_id) WHERE ancestor_id <> 0 GROUP BY ALL",
    "qt": "SELECT DISTINCT term_id FROM q",
    "c1": "SELECT DISTINCT qt.term_id, a.disease_id FROM qt JOIN selfc s ON s.term_id = qt.term_id JOIN absent a ON a.term_id = s.ancestor_id",
    "c2": "SELECT term_id, disease_id, freq AS v FROM qt JOIN lr_model USING (term_id)",
    "c3": "SELECT qt.term_id, m.disease_id, max(m.freq) AS v FROM qt JOIN closure c ON c.ancestor_id = qt.term_id JOIN lr_model m ON m.term_id = c.term_id GROUP BY ALL",
    "c4": "SELECT qt.term_id, m.disease_id, max(m.freq / k.n * power(0.5, c.distance - 1)) AS v FROM qt JOIN closure c ON c.term_id = qt.term_id JOIN lr_model m ON m.term_id = c.ancestor_id JOIN (SELECT parent, count(DISTINCT child) AS n FROM edge GROUP BY 1) k ON k.parent = c.ancestor_id GROUP BY ALL",
    "c5": "SELECT term_id, disease_id, a, f FROM (SELECT qt.term_id, i.disease_id, i.term_id AS a, i.f, row_number() OVER (PARTITION BY qt.term_id, i.disease_id ORDER BY s.distance, s.ancestor_id) AS n FROM qt JOIN selfc s ON s.term_id = qt.term_id JOIN induced i ON i.term_id = s.ancestor_id) WHERE n = 1",
    "lr": """SELECT k.term_id, k.disease_id, CASE WHEN c1.term_id IS NOT NULL THEN 1e-3 WHEN c2.v IS NOT NULL THEN c2.v / coalesce(b.bg, 1e-4) WHEN c3.v IS NOT NULL THEN c3.v / coalesce(b.bg, 1e-4)
      WHEN c4.v > 0 THEN greatest(c4.v, 0.002 + (coalesce(b.raw, 0.01) - 0.01) * (0.098 / 0.09)) / coalesce(b.bg, 1e-4) WHEN c5.f IS NOT NULL THEN greatest(0.01, c5.f / coalesce(b5.bg, 1e-4)) ELSE 0.5 END AS lr,
      CASE WHEN c1.term_id IS NOT NULL THEN 'present but excluded in disease' WHEN c2.v IS NOT NULL THEN 'exact match' WHEN c3.v IS NOT NULL THEN 'disease term below query' WHEN c4.v > 0 THEN 'query below disease term' WHEN c5.f IS NOT NULL THEN 'common ancestor' ELSE 'no match below root' END AS match_type
      FROM (SELECT term_id, disease_id FROM c1 UNION SELECT term_id, disease_id FROM c2 UNION SELECT term_id, disease_id FROM c3 UNION SELECT term_id, disease_id FROM c4 UNION SELECT term_id, disease_id FROM c5) k
      LEFT JOIN c1 USING (term_id, disease_id) LEFT JOIN c2 USING (term_id, disease_id) LEFT JOIN c3 USING (term_id, disease_id) LEFT JOIN c4 USING (term_id, disease_id) LEFT JOIN c5 USING (term_id, disease_id) LEFT JOIN bg b ON b.term_id = k.term_id LEFT JOIN bg b5 ON b5.term_id = c5.a""",
}


def with_roles(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the expressions that it needs, directly or through others."""
    import re

    every = CTE | (extra or {})
    names = {k.split("(")[0]: k for k in every}
    need: set[str] = set()

    def add(sql: str) -> None:
        for word in set(re.findall(r"\b\w+\b", sql)):
            if word in names and word not in need:
                need.add(word)
                add(every[names[word]])

    add(body)
    # the same order as above keeps each after those it uses
    return ("WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in every.items() if k.split("(")[0] in need) + "\n" if need else "") + body
