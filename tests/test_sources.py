"""Large JSON files cut at many places, and streams across watermarks, restarts and repeated batches."""

import datetime as dt
import json
import random

import pytest

from orrery.sources import large_json, readers, sinks
from orrery.streaming import ranks


@pytest.fixture
def small_cuts(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def values(r, n):
    kinds = [lambda: [r.random() for _ in range(r.randrange(5))], lambda: {"a,b": 'x\\"y,{', "n": [{"q": "]"}]}, lambda: 'long, text \\ " { [ é \n' * r.randrange(30), lambda: r.randrange(10), lambda: None, dict]
    return {f'k{i:04d},"{{': r.choice(kinds)() for i in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
def test_cuts_equal_the_plain_reader(spark, tmp_path, small_cuts, indent):
    d = values(random.Random(1), 120)

    def read(content, level=1):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(content, indent=indent, ensure_ascii=False))
        return large_json.entries(spark, str(path), level).orderBy("place").collect()

    rows = read(d)
    assert [(x.key, json.loads(x.value)) for x in rows] == list(d.items())
    rows = read(list(d.values()))
    assert [(x.key, json.loads(x.value)) for x in rows] == [(None, v) for v in d.values()]
    rows = read({"meta": {"v": 1}, "results": d, "x": 3, "z": [1, 2]}, 2)
    assert {x.key: json.loads(x.value) for x in rows if x.parent == "results"} == d
    assert [(x.parent, x.key, x.value) for x in rows if x.parent != "results"] == [("meta", "v", "1"), ("z", None, "1"), ("z", None, "2")]
    assert read({}) == [] and read([]) == []


def test_json_readers(spark, tmp_path, small_cuts):
    people = [[[f"HP:{i}"], [f"OMIM:{i}"] if i % 3 else []] for i in range(50)] + [[["HP:1"]], [["HP:2"], ["OMIM:2"], ["x"]]]
    (tmp_path / "p.json").write_text(json.dumps(people))
    got = [(x.patient_id, x.terms[0]) for x in readers.read_patients(spark, str(tmp_path / "p.json")).orderBy("patient_id").collect()]
    assert got == [(n + 1, f"HP:{i}") for n, i in enumerate(i for i in range(50) if i % 3)]
    (tmp_path / "r.json").write_text(json.dumps({"note": {"description": "no"}, "results": {"A": {"description": "x, y"}, "B": {"other": 1}}}))
    assert [tuple(x) for x in readers.read_descriptions(spark, str(tmp_path / "r.json")).collect()] == [("A", "x, y")]
    for content in ([{"sample_id": i, "text": "a, [" * i} for i in range(30)], {"samples": [{"sample_id": i, "text": "a, [" * i} for i in range(30)]}):
        (tmp_path / "s.json").write_text(json.dumps(content))
        assert sorted((x.sample_id, len(x.text)) for x in readers.read_predictions(spark, str(tmp_path / "s.json")).collect()) == [(i, 4 * i) for i in range(30)]
    rows = spark.createDataFrame([("a", 1.5), ('q"', None), ("é", 0.0)], "k string, v double").repartition(5)
    sinks.write_json(rows, str(tmp_path / "d"), "k", "v")
    assert sorted(tuple(x) for x in readers.read_json_dict(spark, str(tmp_path / "d"), "double").collect()) == [("a", 1.5), ('q"', None), ("é", 0.0)]


def test_counters_after_a_restart(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    rows = spark.createDataFrame([(i, i % 7, i % 3 == 0) for i in range(200)], "patient_id long, rank int, hit boolean")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path("in"))
    for part in ("patient_id < 90", "patient_id between 90 and 120", "patient_id > 120"):
        rows.where(part).repartition(3).write.mode("append").parquet(path("in"))
        ranks.running_counters(stream(), path("out"), path("cp")).awaitTermination()
    key = lambda df: sorted(tuple(x) for x in df.select("rank", "n", "hits").collect())
    assert key(ranks.counters(spark, path("out"))) == key(ranks.running_statistics(rows))
    ranks.running_counters(stream(), path("out"), path("cp")).awaitTermination()  # nothing new
    assert key(ranks.counters(spark, path("out"))) == key(ranks.running_statistics(rows))
    assert ranks.totals(ranks.counters(spark, path("out"))).first() == ranks.totals(ranks.running_statistics(rows)).first()


def test_intake_once(spark, tmp_path):
    """Late, repeated and replayed ids, across a restart and from a second stream with the same done table."""
    path = lambda name: str(tmp_path / name)
    at = lambda hour: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
    batches = [[(1, at(0)), (1, at(0.1)), (2, at(1)), (None, at(1))], [(1, at(9)), (3, at(10))], [(2, at(0)), (1, at(30)), (4, at(31)), (4, at(31)), (5, at(0))]]
    stream = lambda: spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path("in"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(path("in"))
        ranks.stream_intake(stream(), "id", path("done"), path("cp")).awaitTermination()
    schema = spark.createDataFrame([], "id long").schema
    taken = lambda: sorted(x.id for x in ranks.taken_in(spark, path("done"), schema).collect())
    assert taken() == [1, 2, 3, 4, 5]
    # all files replayed under a new checkpoint whose batch numbers meet old ones
    ranks.stream_intake(stream(), "id", path("done"), path("cp2")).awaitTermination()
    assert taken() == [1, 2, 3, 4, 5]
