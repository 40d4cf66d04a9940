"""Odd answers and case entries by hand."""

from orrery.operators import answers
from orrery.sources import sinks


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "answer_id int, text string")


def test_odd_answers_give_no_rows(spark):
    odd = texts(spark, None, "", "FINAL ANSWER", "{", "}{", '{"FINAL ANSWER": 5}', "</think>", '"Candidate Diseases": [')
    none = spark.createDataFrame([], "name string, disease_id long")
    for f in (answers.parse_ranked_answer, answers.parse_object_answer, answers.candidate_names, answers.answer_findings):
        assert f(odd).collect() == [] and f(odd.where("false")).collect() == []
    assert answers.validate_candidates(odd, none).collect() == []


def test_names_and_numbers(spark):
    got = answers.parse_object_answer(texts(spark, '{"FINAL ANSWER": {"3. c": 1, "1. b": 1, "1. a": 1, "99999999999. far": 1}}')).collect()
    assert [(r.idx, r.name) for r in got] == [(1, "b"), (1, "a"), (3, "c")]
    long = "FINAL ANSWER\n" + "\n".join(f"{i}. name {i} (x) - y" for i in range(1, 5001))
    got = answers.parse_ranked_answer(texts(spark, long)).collect()
    assert [(r.idx, r.name) for r in got] == [(i, f"name {i}") for i in range(1, 5001)]
    got = answers.candidate_names(texts(spark, '"Candidate Diseases": ["a \\"b\\"", 5, null, " 2. c "]')).collect()
    assert [r.name for r in got] == ['a "b"', "c"]


def test_validation_counts_and_lists_in_order(spark):
    known = spark.createDataFrame([("b", 1)], "name string, disease_id long")
    got = answers.validate_candidates(texts(spark, '"Candidate Diseases": {"z": "", "B": "", "a": "", "z": ""}'), known, 4).first()
    assert (got.n_candidates, got.complete, got.unmatched) == (4, True, "z; a; z")


def test_case_entries(spark):
    merged = spark.createDataFrame([(1, 7, ["HP:0040281; 1/2"]), (2, 7, []), (2, 8, ["1/2"]), (9, 7, ["rare"])], "disease_id int, term_id int, frequencies array<string>")
    alias = spark.createDataFrame([(1, "Z", 0), (2, "A", 0), (2, "Z", 1), (3, "Z", 0)], "disease_id int, alias string, pos int")
    typed = spark.createDataFrame([(1, "", False), (2, "t", True), (3, "u", False)], "disease_id int, disease_type string, is_rare boolean")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "disease_id int, group_id int")
    about = spark.createDataFrame([(1, " x "), (3, "x")], "disease_id int, description string")
    got = {r.group_id: r for r in sinks.case_database(merged, alias, typed, groups, about).collect()}
    one = got[1]
    assert one.standard_names == {1: "Z", 2: "A", 3: "Z"} and one.aliases == ["Z", "A"] and one.names == ["A", "Z"]
    assert one.terms == {7: "1/2; Unknown; Very frequent", 8: "1/2"} and one.is_rare and one.disease_type == "t"
    assert one.descriptions == ["x", ""] and one.alias_errors == [2] and one.term_errors == [2, 3] and one.mismatch
    assert got[9].terms == {7: "rare"} and got[9].aliases is None and got[9].standard_names == {9: ""} and got[9].term_errors == []
    assert sinks.case_database(merged.where("false"), alias.where("false"), typed.where("false"), groups.where("false")).collect() == []
