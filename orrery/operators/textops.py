"""Text jobs over tables of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .lineage import cut


def extract_codes(text: Column, pattern: str = r"HP:\d{7}") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


#: Phrases, and bytes of phrases, that may be sent to every task.
MOST_PHRASES, MOST_BYTES = 500_000, 32_000_000
_automata: dict = {}


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def dictionary_annotate(docs: DataFrame, lexicon: DataFrame, most_words: int | None = None) -> DataFrame:
    """(doc_id, pos, n_words, term_id): lexicon phrases (phrase, term_id) in texts; where matches start together the longest stays.

    Phrases of up to ``most_words`` words count, by default all. An Aho-Corasick automaton of the phrases, between spaces, runs once
    over each text, so only matches become rows, and none is moved. A lexicon of more than ``MOST_PHRASES`` is dealt by first words into
    parts of checked size, each with an automaton and a run of its own: matches that start together are of one part. A part that first words
    alone make too large is joined with the runs of words."""
    phrases = lexicon.select(words_of(F.col("phrase")).alias("w"), "term_id").where(F.size("w") > 0)
    if most_words is not None:
        phrases = phrases.where(F.size("w") <= most_words)
    known = cut(phrases.groupBy(F.array_join("w", " ").alias("g")).agg(F.min("term_id").alias("term_id"), F.max(F.size("w")).alias("n")))
    texts = docs.select("doc_id", F.array_join(words_of(F.col("text")), " ").alias("t")).where("t <> ''")
    measure = [F.count("*"), F.coalesce(F.sum(F.octet_length("g")), F.lit(0))]
    count, size = known.agg(*measure).first()
    if not count:
        return docs.where("false").select("doc_id", F.lit(1).alias("pos"), F.lit(1).alias("n_words"), F.lit(None).cast(lexicon.schema["term_id"].dataType).alias("term_id"))
    if count <= MOST_PHRASES and size <= MOST_BYTES:
        return annotate_by_automaton(texts, known)
    n = 2 * max(-(-count // MOST_PHRASES), -(-size // MOST_BYTES))  # about half full
    known = cut(known.withColumn("_part", F.pmod(F.xxhash64(F.split_part("g", F.lit(" "), F.lit(1))), F.lit(n)).cast("int")))
    sizes = known.groupBy("_part").agg(*[m.alias(c) for m, c in zip(measure, ("c", "b"))]).collect()  # one row a part
    whole = [r["_part"] for r in sizes if r["c"] > MOST_PHRASES or r["b"] > MOST_BYTES]
    texts = cut(texts)
    found = [annotate_by_automaton(texts, known.where(F.col("_part") == r["_part"]).drop("_part")) for r in sizes if r["_part"] not in whole]
    if whole:
        found.append(annotate_by_joins(texts.withColumnRenamed("t", "text"), known.where(F.col("_part").isin(whole)).drop("_part")))
    return reduce(DataFrame.unionByName, found)


def annotate_by_automaton(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``dictionary_annotate`` of texts (doc_id, t), words between single spaces, for at most ``MOST_PHRASES`` phrases (g, term_id, n)."""
    term_type, doc_type = known.schema["term_id"].dataType.simpleString(), texts.schema["doc_id"].dataType.simpleString()
    held = known.select("g", "n", "term_id").toArrow()  # at most MOST_PHRASES
    arrow = held.schema.field("term_id").type
    shared = texts.sparkSession.sparkContext.broadcast(held)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata.clear()
            built = ahocorasick.Automaton()
            for g, n, term in zip(*[c.to_pylist() for c in shared.value.columns]):
                built.add_word(f" {g} ", (n, term))
            built.make_automaton()
            _automata[key] = built
        found = _automata[key]
        for batch in batches:
            rows, pos, width, term = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                here: dict[int, tuple] = {}
                at, words = 0, 0
                for end, (n, t) in found.iter(f" {text} "):
                    words += text.count(" ", max(at - 1, 0), end - 1) if end > at else 0  # spaces up to the match's end
                    at = max(at, end)
                    start = words + 2 - n
                    if here.get(start, (0,))[0] < n:
                        here[start] = (n, t)
                for start, (n, t) in here.items():
                    rows.append(i)
                    pos.append(start)
                    width.append(n)
                    term.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(pos, pa.int32()), pa.array(width, pa.int32()), pa.array(term, arrow)], ["doc_id", "pos", "n_words", "term_id"])

    return texts.mapInArrow(run, f"doc_id {doc_type}, pos int, n_words int, term_id {term_type}")


def annotate_by_joins(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The same for phrases (g, term_id, n) of any number: runs of words of each length that phrases have, joined with them."""
    lengths = [r.n for r in known.select("n").distinct().collect()]  # as many as lengths in words
    words = docs.select("doc_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = lambda pos: F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.size("w") - pos + 1), lambda n: F.struct(pos.alias("pos"), n.alias("n"), F.array_join(F.slice("w", pos, n), " ").alias("g")))
    grams = words.select("doc_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), at))).alias("x")).select("doc_id", "x.*")
    hits = grams.join(known.select("g", "term_id").hint("merge"), "g")
    best = hits.groupBy("doc_id", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), "term_id")).alias("b"))
    return best.select("doc_id", "pos", (-F.col("b.n")).alias("n_words"), F.col("b.term_id").alias("term_id"))


def name_resolver(asked: DataFrame, alias: DataFrame, similarity, threshold: float = 0.8, id_pattern: str = r"^[A-Za-z]+:\d+$") -> DataFrame:
    """(name, disease_id, sim): a name that is a known id is itself (1); else aliases that share enough key tokens (all of one
    or two, half of more), the most similar of at least ``threshold``, then the least id; -1 if there is none."""
    names_asked = asked.select("name").distinct()
    text_id = F.col("disease_id").cast("string")
    known = alias.select(text_id.alias("name"), "disease_id").distinct()
    own = names_asked.where(F.col("name").rlike(id_pattern)).join(known, "name").select("name", F.struct(F.lit(1.0).alias("sim"), "disease_id").alias("b"))
    tokens = names_asked.select("name", F.array_distinct(names.key_tokens(F.col("name"))).alias("t")).select("name", F.size("t").alias("n"), F.explode("t").alias("k"))
    index = alias.select("disease_id", "alias", F.explode(F.array_distinct(names.key_tokens(F.col("alias")))).alias("k"))
    shared = tokens.join(index.hint("merge"), "k").groupBy("name", "disease_id", "alias", "n").agg(F.count("*").alias("c"))
    fit = shared.where(F.when(F.col("n") <= 2, F.col("c") >= F.col("n")).otherwise(F.col("c") * 2 >= F.col("n"))).withColumn("sim", similarity(F.col("name"), F.col("alias")))
    best = fit.where(F.col("sim") >= threshold).groupBy("name").agg(F.min_by(F.struct("sim", "disease_id"), F.struct(-F.col("sim"), "disease_id")).alias("b"))
    found = best.unionByName(own).groupBy("name").agg(F.max("b").alias("b"))
    return names_asked.join(found.hint("merge"), "name", "left").select("name", F.coalesce("b.disease_id", F.lit(-1)).alias("disease_id"), F.coalesce("b.sim", F.lit(0.0)).alias("sim"))


def parse_disease_terms(answers: DataFrame) -> DataFrame:
    """(answer_id, idx, name, terms) of lines ``n. **Name** - HP:...;HP:...``."""
    lines = answers.select("answer_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\d+\.\s*\*\*"))
    return lines.select("answer_id", F.regexp_extract("line", r"^\s*(\d+)\.", 1).cast("int").alias("idx"), F.regexp_extract("line", r"\*\*(.+?)\*\*", 1).alias("name"), extract_codes(F.col("line")).alias("terms"))


def split_thinking(text: Column) -> tuple[Column, Column]:
    return F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1), F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def validate_answer(parsed: DataFrame, answers: DataFrame, sections: list[str], wanted: int = 20) -> DataFrame:
    n = parsed.groupBy("answer_id").agg(F.count("*").alias("n"))
    missing = F.filter(F.array(*[F.lit(s) for s in sections]), lambda s: ~F.contains(F.col("text"), s))
    return answers.join(n, "answer_id", "left").select("answer_id", F.coalesce("n", F.lit(0)).alias("n_candidates"), (F.coalesce("n", F.lit(0)) == wanted).alias("complete"), F.array_join(missing, ",").alias("missing"))


def render_prompt(query: DataFrame, term_name: DataFrame, ranking: DataFrame, template: str) -> DataFrame:
    """(patient_id, prompt): the template with {terms} and {candidates} filled in."""
    t = query.join(term_name, "term_id").groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("term_id").cast("string"), F.lit(" "), "name"))), "; ").alias("t"))
    c = ranking.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "disease_id"))), lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["disease_id"].cast("string"))), "\n").alias("c"))
    return t.join(c, "patient_id").select("patient_id", F.replace(F.replace(F.lit(template), F.lit("{terms}"), F.col("t")), F.lit("{candidates}"), F.col("c")).alias("prompt"))


def render_case_line(annotation: DataFrame, description: DataFrame) -> DataFrame:
    """(disease_id, line): description and terms with shares in falling order; shares above 0 and up to 0.17 go."""
    kept = annotation.where(~((F.col("freq") > 0) & (F.col("freq") <= 0.17)))
    terms = kept.groupBy("disease_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("freq", F.lit(0.0))).alias("f"), "term_id"))), lambda x: F.concat(x["term_id"].cast("string"), F.lit(" ("), F.format_string("%.3f", -x["f"]), F.lit(")"))), ", ").alias("t"))
    return terms.join(description, "disease_id", "left").select("disease_id", F.concat(F.coalesce("description", F.lit("[Information is missing]")), F.lit(": "), "t").alias("line"))


def render_few_shot(similar: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(patient_id, shots): the k most similar cases as sentences."""
    top = similar.withColumn("n", F.row_number().over(Window.partitionBy("patient_id").orderBy(F.desc("jaccard"), F.asc("case_id")))).where(F.col("n") <= k)
    line = F.concat(F.lit("Case "), F.col("case_id").cast("string"), F.lit(": "), F.array_join(F.transform("diseases", lambda d: d.cast("string")), ", "))
    return top.join(cases, "case_id").groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), " | ").alias("shots"))


def page_description(pages: DataFrame) -> DataFrame:
    """(page_id, description): the longest paragraph of a page (of equals the least), without its markup; NULL if there is none."""
    plain = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), "[ \\t\\r\\n]+", " "))
    paragraphs = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), plain)
    best = F.array_sort(F.transform(F.filter(paragraphs, lambda p: p != ""), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return pages.select("page_id", F.try_element_at(best, F.lit(1))["p"].alias("description"))


def term_profile(annotation: DataFrame, term_name: DataFrame) -> DataFrame:
    """(disease_id, bucket, terms): by frequency bucket the names of a disease's terms, in order."""
    from ..functions.frequency import freq_bucket

    rows = annotation.join(term_name, "term_id").select("disease_id", freq_bucket(F.col("freq")).alias("bucket"), "name")
    return rows.groupBy("disease_id", "bucket").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("terms"))


def terms_without_category(query: DataFrame, categories: DataFrame) -> DataFrame:
    """(patient_id, terms): a patient's terms that have no category, in order."""
    rows = query.join(categories.select("term_id").distinct().hint("merge"), "term_id", "left_anti").groupBy("patient_id").agg(F.array_sort(F.collect_list("term_id")).alias("t"))
    return rows.select("patient_id", F.array_join(F.transform("t", lambda v: v.cast("string")), ",").alias("terms"))


def pending_ids(library: DataFrame, done: DataFrame, skipped: tuple[str, ...] = ("CCRD", "DECIPHER")) -> DataFrame:
    ids = library.select(F.explode("diseases").alias("disease_id")).select(F.col("disease_id").cast("string").alias("disease_id")).distinct()
    for s in skipped:
        ids = ids.where(~F.col("disease_id").startswith(s))
    return ids.join(done.select(F.col("disease_id").cast("string").alias("disease_id")).hint("merge"), "disease_id", "left_anti")


def parse_json_answer(answers: DataFrame) -> DataFrame:
    """(answer_id, name, matched, unmatched): candidates of a JSON answer, given as an object by name or as a list."""
    item = "struct<name:string,matched:array<string>,unmatched:array<string>>"
    body = F.regexp_extract("text", r"(?s)[\[{].*[\]}]", 0)
    listed = F.from_json(body, f"array<{item}>")
    by_name = F.transform(F.map_entries(F.from_json(body, "map<string,struct<matched:array<string>,unmatched:array<string>>>")), lambda e: F.struct(e["key"].alias("name"), e["value"]["matched"].alias("matched"), e["value"]["unmatched"].alias("unmatched")))
    rows = answers.select("answer_id", F.explode(F.when(F.startswith(body, F.lit("[")), listed).otherwise(by_name)).alias("x"))
    return rows.select("answer_id", "x.name", F.coalesce("x.matched", F.expr("array()")).alias("matched"), F.coalesce("x.unmatched", F.expr("array()")).alias("unmatched"))
