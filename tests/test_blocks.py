"""Scores in blocks, streams and the closure against plain recomputation."""

import math
import random

from pyspark.sql import functions as F

from orrery.operators import blocks, likelihood, ontology, rank, ratio_blocks
from orrery.streaming import ranks


def vectors(r, n, scale):
    return {i: [r.uniform(-1, 1) * scale for _ in range(6)] for i in range(n)}


def far(u, v):
    square = lambda a: sum(x * x for x in a)
    inside = lambda a: min(square(a), 1 - 1e-4)
    x = max(1 + 2 * square([a - b for a, b in zip(u, v)]) / ((1 - inside(u)) * (1 - inside(v))), 1 + 1e-5)
    return math.log(x + math.sqrt(x * x - 1))


def test_chamfer(spark):
    r = random.Random(1)
    term = vectors(r, 60, 0.3)
    emb = spark.createDataFrame(list(term.items()), "term_id long, v array<double>")
    sets = lambda n: {i: sorted(r.sample(range(60), r.randint(1, 9))) for i in range(n)}
    patients, cases = sets(7), sets(25)
    rows = lambda d, k: spark.createDataFrame([(i, t) for i, ts in d.items() for t in ts], f"{k} long, term_id long")
    got = {(x.patient_id, x.case_id): (x.distance, x.rank) for x in rank.chamfer_similar_cases(rows(patients, "patient_id"), rows(cases, "case_id"), "case_id", emb, 5).collect()}
    for p, mine in patients.items():
        every = []
        for c, theirs in cases.items():
            there = sum(min(far(term[a], term[b]) for b in theirs) for a in mine) / len(mine)
            back = sum(min(far(term[a], term[b]) for a in mine) for b in theirs) / len(theirs)
            every.append((round((there + back) / 2, 6), c))
        assert [(got[p, c][0], c) for _, c in sorted(every)[:5]] == sorted(every)[:5]


def cosine(u, v):
    norm = lambda a: math.sqrt(sum(x * x for x in a))
    return sum(a * b for a, b in zip(u, v)) / norm(u) / norm(v) if norm(u) and norm(v) else 0.0


def table(spark, d, weight=1.0):
    return spark.createDataFrame([(i, weight, v) for i, v in d.items()], "key long, w double, v array<double>")


def test_many_blocks(spark):
    r = random.Random(2)
    left, right = vectors(r, 50, 1), vectors(r, 70, 1) | {70: [0.0] * 6}
    want = {(i, j): cosine(u, v) for i, u in left.items() for j, v in right.items()}
    got = {(x.l, x.r): x.score for x in blocks.scan(table(spark, left), table(spark, right), blocks.Cosine, size=16, slab=20).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    above = blocks.scan(table(spark, left), table(spark, right), blocks.Cosine, least=0.5, size=16, slab=20).collect()
    assert {(x.l, x.r) for x in above} == {p for p, s in want.items() if s > 0.5}
    assert blocks.scan(table(spark, left), table(spark, right).where("key < 0"), blocks.Cosine, 3).count() == 0
    assert blocks.scan(table(spark, left).where("key < 0"), table(spark, right), blocks.Cosine, 3).count() == 0


def test_bounds_leave_out_only_what_cannot_be_among_the_best(spark):
    """Clustered entries of several rows, ties and repeated entries: the k best are all there, and most pairs are never scored."""
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(8)]
    near = lambda c, scale: [x * scale + r.gauss(0, 0.01) for x in c]
    for kind, scale, pair in ((blocks.Cosine, 1.0, cosine), (blocks.Ball, 0.3, lambda u, v: -far(u, v))):
        entries = {i: [near(centres[i % 8], scale) for _ in range(1 + i % 3)] for i in range(160)}
        entries |= {200 + i: entries[i] for i in range(30)}
        asked = {i: [near(centres[i % 8], scale) for _ in range(1 + i % 2)] for i in range(24)}
        rows = lambda d: spark.createDataFrame([(i, 1.0 + n, v) for i, vs in d.items() for n, v in enumerate(vs)], "key long, w double, v array<double>")
        report = {}
        got = {}
        for x in blocks.scan(rows(asked), rows(entries), kind, 5, size=120, slab=20, report=report).collect():
            got.setdefault(x.l, {})[x.r] = x.score
        assert report["pairs"] == len(asked) * len(entries) and report["pruned"] > 0.5 * report["pairs"]
        for i, us in asked.items():
            def score(vs, us=us):
                if kind is blocks.Cosine:
                    return sum((1.0 + n) * max(cosine(u, v) for v in vs) for n, u in enumerate(us)) / sum(1.0 + n for n in range(len(us)))
                return (sum(max(pair(u, v) for v in vs) for u in us) / len(us) + sum(max(pair(u, v) for u in us) for v in vs) / len(vs)) / 2
            want = {j: score(vs) for j, vs in entries.items()}
            least = sorted(want.values())[-5]
            assert all(j in got[i] and abs(got[i][j] - s) < 1e-7 for j, s in want.items() if s >= least)


def test_ratios_in_blocks_and_by_joins(spark, monkeypatch):
    """The same ratios and sums, whether blocks of diseases go through the ontology or rows are joined; and with a cycle."""
    r = random.Random(6)
    edges = {(i, r.randrange(i)) for i in range(1, 60) for _ in range(2)}
    edge = spark.createDataFrame(sorted(edges), "child long, parent long")
    model = {(d, r.randrange(60)): r.choice([0.0, 0.1, 0.5, 1.0]) for d in range(23) for _ in range(6)}
    absent = {(r.randrange(23), r.randrange(60)) for _ in range(12)} - set(model)
    frame = spark.createDataFrame([(*k, v) for k, v in model.items()], "disease_id long, term_id long, freq double")
    gone = spark.createDataFrame(sorted(absent), "disease_id long, term_id long")
    query = spark.createDataFrame(sorted({(p, r.randrange(70)) for p in range(9) for _ in range(12)}), "patient_id long, term_id long")
    closure = ontology.closure(edge)
    args = (query, frame, gone, edge, closure, 0)
    key = lambda rows: {(x.term_id, x.disease_id): (round(x.lr, 9), x.match_type) for x in rows.collect()}
    monkeypatch.setattr(ratio_blocks, "CELLS", 300)
    monkeypatch.setattr(ratio_blocks, "SLAB", 40)
    assert ratio_blocks.laid_out(query, frame, gone, edge, 0) is not None
    want = key(likelihood.lr_observed_by_joins(*args))
    assert key(likelihood.lr_observed(*args)) == want and len({k for _, k in want.values()}) >= 5
    diseases = frame.select("disease_id")
    whole = likelihood.posteriors(query, likelihood.lr_observed_by_joins(*args), diseases)
    sums = lambda rows: {(x.patient_id, x.disease_id): round(x.log_lr, 7) for x in rows.collect()}
    assert sums(likelihood.model_posteriors(*args, diseases)) == sums(whole)
    assert sums(likelihood.lr_rank(*args, diseases, 4)) == sums(likelihood.likeliest(whole, 4))
    looped = edge.union(spark.createDataFrame([(5, 59)], "child long, parent long"))
    assert ratio_blocks.laid_out(query, frame, gone, looped, 0) is None
    monkeypatch.setattr(ratio_blocks, "MOST_EDGES", 50)
    assert sums(likelihood.lr_rank(*args, diseases, 4)) == sums(likelihood.likeliest(whole, 4))
    assert likelihood.lr_observed(query.where("false"), *args[1:]).count() == 0 and likelihood.lr_rank(query.where("false"), *args[1:], diseases, 4).count() == 0


def test_closure_with_cycles(spark):
    r = random.Random(3)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(70)} | {(i, i + 1) for i in range(60, 90)}
    want = {}
    for start in {a for a, _ in edges}:
        level, seen, d = {start}, {start}, 0
        while level:
            d += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            want |= {(start, b): d for b in level}
    table = spark.createDataFrame(list(edges), "child long, parent long")
    assert {(x.term_id, x.ancestor_id): x.distance for x in ontology.closure(table).collect()} == want
    assert {(x.term_id, x.ancestor_id): x.distance for x in ontology.closure(table, 3).collect()} == {k: d for k, d in want.items() if d <= 3}


def test_streams(spark, tmp_path):
    rows = [(i, i % 7 + 1, i % 3 == 0) for i in range(50)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "patient_id long, rank int, hit boolean").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("patient_id long, rank int, hit boolean").option("maxFilesPerTrigger", 1).parquet(src)
    q = ranks.running_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    one = ranks.totals(spark.table("running")).first()
    hits = sorted(k for _, k, h in rows if h)
    assert (one.n, one.hits, one.best_rank, one.worst_rank, one.median_rank) == (50, len(hits), hits[0], hits[-1], hits[len(hits) // 2])
    assert abs(one.mean_rank - sum(hits) / len(hits)) < 1e-6
    ids = str(tmp_path / "ids")
    spark.createDataFrame([(i % 10, "2024-01-01 00:00:00") for i in range(40)], "id long, ts string").repartition(2).write.parquet(ids)
    once = ranks.stream_pending(spark.readStream.schema("id long, ts string").parquet(ids), "id", "ts")
    q = once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x.id for x in spark.read.parquet(str(tmp_path / "out")).select(F.col("id")).collect()) == list(range(10))


def test_groups_with_a_hot_alias(spark, monkeypatch):
    """Chains, one name that half of the ids bear, blanks and repeated rows: the components, by their least id."""
    from orrery.operators import lineage, resolve

    r = random.Random(9)
    rows = [(i, "Common ") for i in range(0, 200, 2)] + [(i, f"n{i // 3}") for i in range(1, 200, 2)] + [(i, f"m{r.randrange(90)}") for i in range(1, 120, 2)] + [(7, " "), (7, None), (None, "common"), (500, "alone"), (500, "alone")]
    monkeypatch.setattr(lineage, "LEAST_HOT", 20)
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = {}
    for i, a in rows:
        if i is not None and a and a.strip():
            names.setdefault(a.strip().lower(), []).append(i)
    for ids in names.values():
        for i in ids:
            a, b = root(ids[0]), root(i)
            parent[max(a, b)] = min(a, b)
    got = {x.disease_id: x.group_id for x in resolve.entity_groups(spark.createDataFrame(rows, "disease_id long, alias string")).collect()}
    assert got == {i: root(i) for i in parent}
    assert resolve.entity_groups(spark.createDataFrame([], "disease_id long, alias string")).count() == 0


def test_closure_by_doubling(spark):
    r = random.Random(11)
    edge = spark.createDataFrame([(r.randrange(30), r.randrange(30)) for _ in range(60)], "child long, parent long")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(ontology.closure(edge)) == rows(ontology.closure_by_doubling(edge.distinct()))
    assert rows(ontology.closure(edge, 2)) == rows(ontology.closure_by_doubling(edge.distinct(), 2))
    assert ontology.closure(edge.where("child < 0")).count() == 0
