"""Repetition rules, hard negatives and lexical search: brute force, SQL through test_llm.py, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import lexical, negatives, registry, repetition

SF = "/root/testdata/sf0.001"


def longest_repeats(text, least):
    """Spans and the longest repeat by trying every start and length."""
    n, covered, best = len(text), set(), 0
    for i in range(n):
        length = 0
        while i + length < n and any(text.startswith(text[i : i + length + 1], j) for j in range(n) if j != i):
            length += 1
        if length >= least:
            best = max(best, length)
            covered |= set(range(i, i + length))
    return covered, best


def base_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_suffix_array_against_every_start():
    r = random.Random(1)
    for _ in range(150):
        text = "".join(r.choice(r.choice(["ab", "abc ", "aéb", "😀é", "a\x00b"])) for _ in range(r.randrange(0, 110)))
        text += r.choice(["", "x"]) + text[: r.randrange(len(text) + 1)] * r.randrange(2)
        for least in (7, 12):
            covered, best = longest_repeats(text, least)
            found = repetition.repeats(text.encode(), least)
            assert found.longest == best and covered == {p for a, b in found.spans.tolist() for p in range(a, b)}
    run = repetition.repeats(b"abcdefg" * 30_000)
    assert run.longest == 7 * 30_000 - 7 and run.spans.tolist() == [[0, 210_000]]


def test_quality_rules(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for x in registry.QUERIES["op11_quality_rules"](spark, SF).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base_counts(docs[x.doc_id])
        failed = x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words
        assert x.base_failed == failed and x.kept == (not failed and x.covered_chars <= 0.3 * len(docs[x.doc_id] or "") and x.longest_repeat <= 1000)
    r = random.Random(2)
    prose = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(900))
    odd = [(1, None), (2, ""), (3, "a a\n \na a\n" * 3), (4, prose), (4, prose), (None, prose + "\x0b" + prose[:1500]), (6, "ab" * 70_000), (7, "    ".join("word%d" % i for i in range(12))), (8, prose[:1000] + "\x00é" + prose[:420])]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in odd], "doc_id long, text string, repetition string, N_WORDS int")
    kept = repetition.keeping(rows)
    assert kept.columns == rows.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["4", "4", "7"]
    for x in repetition.measured(rows).select("text", "repetition_.*").collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base_counts(x.text) and x.n_chars == len(x.text or "")
    assert repetition.keeping(rows.where("doc_id < 0")).count() == 0


def mined(rows, every):
    """RESULT rows by plain loops; rows are (id, label, vector)."""
    held = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in rows if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for n, (a, label, v) in enumerate(held):
        if a is None or a % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, other) for m, (i, other, w) in enumerate(held) if m != n]
        order = sorted(scores, key=lambda s: (-s[0], last(s[1])))
        for p, pid, _ in [s for s in order if s[2] == label][:5]:
            fits = [s for s in order if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(a, pid, k + 1, i, p, s) for k, (s, i, _) in enumerate(fits)]
    return out


def test_hard_negatives_against_loops(spark):
    r = random.Random(4)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    rows = [(i, r.randrange(3), f32([r.gauss(0.4, 0.3) for _ in range(5)])) for i in range(260)]
    rows += [(300 + i, i % 2, f32([0.5] * 5)) for i in range(120)]  # one common vector
    rows += [(10, 1, rows[10][2]), (10, 1, rows[10][2]), (None, 1, f32([0.6] * 5)), (500, None, [1.0] * 5), (510, 1, None), (520, 1, [1.0, None, 1.0, 1.0, 1.0]), (530, 1, [1.0, float("nan"), 1.0, 1.0, 1.0]), (540, 1, [float("inf")] * 5)]
    table = spark.createDataFrame([(*x, "b", 0) for x in rows], "vec_id long, label int, vector array<float>, block string, Q int").repartition(6)
    key = lambda x: tuple(-1 if c is None else c for c in x)
    got = sorted(key(x) for x in negatives.mine(table, 10, size=32).collect())
    assert got == sorted(key(x) for x in mined(rows, 10)) and len(got) > 500
    for none in (table.where("vec_id < 0"), table.where("vec_id = 10 and label = 2"), table.withColumn("label", F.lit(None).cast("int"))):
        assert negatives.mine(none, 10).count() == 0
    assert negatives.mine(table.where("vec_id < 200").withColumn("label", F.lit(1)), 10).count() == 0  # no other label


def test_zone_maps_leave_out_far_blocks(spark):
    """In clustered vectors most blocks can't hold a positive or a window's product, and are not read."""
    r = random.Random(5)
    centres = [[r.choice([-1, 1]) * r.uniform(0.5, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, i % 3, [float(np.float32(c + r.gauss(0, 0.01))) for c in centres[i % 12]]) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")
    assert sorted(tuple(x) for x in negatives.mine(table, 40, size=50).collect()) == sorted(mined(rows, 40))
    blocks = negatives.blocks_of(negatives.quantised(table), 50)
    anchors = negatives.anchors_of(blocks, 40, 5, 8)
    slab = negatives.Slab(anchors.orderBy("block", "place").collect(), 8)
    held = blocks.select("lo", "hi").collect()
    reach = [negatives.bounds(slab.q, np.array(b.lo), np.array(b.hi))[1] >= slab.floor for b in held]
    assert np.mean(reach) < 0.5 and len(held) >= 24
    for b in blocks.select("lo", "hi", "q").collect():
        q = np.frombuffer(b.q, "<i4").reshape(-1, 8)
        low, high = negatives.bounds(slab.q, np.array(b.lo), np.array(b.hi))
        s = negatives.product(slab.q, q)
        assert (s >= low[:, None]).all() and (s <= high[:, None]).all()


def test_hilbert_curve():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = negatives.hilbert(points, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def ranked(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_lexical_search_against_loops(spark, block):
    """Ties, repeated rows and items, null ids, texts that are null, empty or long, letters beyond ASCII and clashing columns."""
    r = random.Random(6)
    words = ["the", "The", "İx", "éa", "ÉA", "b2", "c", "dd", "x y", "日本"]
    docs = [(i, r.choice([" ", "--", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(80)]
    docs += [(90, "the b2"), (91, "the b2"), (91, "the b2"), (None, "the b2"), (92, None), (93, ""), (94, "c " * 50_000)]
    items = [(1, "the B2, the"), (2, "éa ÉA 日本"), (2, "c dd"), (3, None), (4, "absent"), (5, "x y\x7fdd"), (None, "c")]
    table = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, terms string, N int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: tuple(-1 if c is None else c for c in x)
    got = sorted(key(x) for x in lexical.search(table, asked, items_in_block=block).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(key(x) for x in ranked(docs, items))
    for d, i in ((table.where("doc_id < 0"), asked), (table, asked.where("item_id < 0")), (table.where("text is null"), asked)):
        assert lexical.search(d, i).count() == 0
