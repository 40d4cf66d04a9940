"""Values of keys (diseases or groups) carried up and down the ontology within the task that holds the key.

A key's rows are dealt to one task, which climbs from its terms level by level over arrays of parents. Each (key, ancestor) is met once for each of
its children, and pairs are reduced before anything is shuffled, so no row is multiplied by its ancestors. Down the ontology
a task visits a disease's asked terms and their ancestors alone, each once, so work follows the pairs that are asked for.

The arrays go to all tasks as a broadcast of about 12 bytes an edge and 20 a term (long ids). An ontology of over ``MOST_EDGES``
edges, or with a cycle, gives None, and the caller joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, dealt_evenly

MOST_EDGES, CHUNK = 16_000_000, 500_000
NEVER = np.iinfo(np.int64).max // 2


def arrow_values(table: pa.Table | pa.RecordBatch, i: int) -> np.ndarray:
    c = table.column(i)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)


class Terms:
    """Terms in order of id; each one's parents are ``parents[first[t]:first[t + 1]]``, at lower levels than its own."""

    def __init__(self, ids: np.ndarray, child: np.ndarray, parent: np.ndarray, listed: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.listed = ids, listed
        level = np.zeros(n, np.int32)
        self.cyclic = bool((child == parent).any())
        for _ in range(n + 1):
            if self.cyclic:
                break
            deeper = level.copy()
            np.maximum.at(deeper, child, level[parent] + 1)
            if (deeper == level).all():
                break
            level = deeper
            self.cyclic = bool(level.max(initial=0) >= n)
        self.level = level
        order = np.argsort(child, kind="stable")
        self.parents = parent[order].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(child, minlength=n)))).astype(np.int32)
        self.children = np.maximum(np.bincount(parent, minlength=n), 1).astype(np.int32)

    def numbers(self, values: np.ndarray) -> np.ndarray:
        """The number of each id, -1 for those that are no term."""
        if not len(self.ids):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.ids, values), len(self.ids) - 1)
        return np.where(self.ids[at] == values, at, -1)

    def above(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parents of the terms, one after the other, and how many each has."""
        count = self.first[term + 1] - self.first[term]
        end = np.cumsum(count)
        return self.parents[np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[term] - (end - count), count)], count


def terms_of(edge: DataFrame, terms: DataFrame) -> Terms | None:
    """The ontology as arrays; ids are those of edges and of ``terms``, which are marked."""
    edges = cut(edge.select("child", "parent").where("child is not null and parent is not null").distinct())
    own = cut(terms.select("term_id").where("term_id is not null").distinct())
    if edges.count() > MOST_EDGES or own.count() > MOST_EDGES:
        return None
    e, t = edges.toArrow(), own.toArrow()  # at most MOST_EDGES rows
    child, parent, mine = arrow_values(e, 0), arrow_values(e, 1), arrow_values(t, 0)
    ids = np.unique(np.concatenate((child, parent, mine)))
    listed = np.zeros(len(ids), bool)
    listed[np.searchsorted(ids, mine)] = True
    made = Terms(ids, np.searchsorted(ids, child), np.searchsorted(ids, parent), listed)
    return None if made.cyclic else made


def met(code: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each code once, in order, with the largest of its values."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1)) if len(code) else np.zeros(0, int)
    return code[start], [np.maximum.reduceat(v[order], start) if len(start) else v for v in values]


def raised(o: Terms, key: np.ndarray, term: np.ndarray, values: list[np.ndarray], halved: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(key, term, values) of all terms and ancestors, with the largest value at or below; those numbered in ``halved`` are halved at
    each level. A term that is not listed counts for its ancestors alone."""
    n = len(o.ids)
    at_level: dict[int, list] = {}

    def put(code: np.ndarray, held: list[np.ndarray]) -> None:
        level = o.level[code % n]
        for d in np.unique(level).tolist():
            here = level == d
            at_level.setdefault(d, []).append((code[here], [v[here] for v in held]))

    def lift(code: np.ndarray, held: list[np.ndarray]) -> None:
        parents, count = o.above(code % n)
        if len(parents):
            put(np.repeat(code // n, count) * n + parents, [np.repeat(v / 2 if i in halved else v, count) for i, v in enumerate(held)])

    code = key.astype(np.int64) * n + term
    own = o.listed[term]
    put(code[own], [v[own] for v in values])
    lift(*met(code[~own], [v[~own] for v in values]))
    out: list = []
    for d in range(int(o.level.max(initial=0)), -1, -1):
        parts = at_level.pop(d, None)
        if parts:
            found = met(np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][i] for p in parts]) for i in range(len(values))])
            out.append(found)
            lift(*found)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [v[:0] for v in values]
    code = np.concatenate([p[0] for p in out])
    return code // n, code % n, [np.concatenate([p[1][i] for p in out]) for i in range(len(values))]


def whole_keys(batches: Iterator[pa.RecordBatch], o: Terms, n_values: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """From rows (key, term, values...) in order of key: distinct keys, and their rows as numbers of key and term with the largest
    values, about ``CHUNK`` at once; all of a key together, which is at most one row a term."""
    held: list[tuple] = []
    size = 0

    def flushed(last: bool):
        nonlocal held, size
        key, term, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [np.concatenate([h[2][i] for h in held]) for i in range(n_values)]
        keys, back = np.unique(key, return_inverse=True)
        code, values = met(back.astype(np.int64) * len(o.ids) + term, values)
        back, term = code // len(o.ids), code % len(o.ids)
        done = np.ones(len(code), bool) if last else back < len(keys) - 1
        rest = ~done
        held = [(keys[back[rest]], term[rest], [v[rest] for v in values])] if rest.any() else []
        size = 0  # rows of an open key are reduced again after CHUNK more
        return keys, back[done], term[done], [v[done] for v in values]

    for b in batches:
        term = o.numbers(arrow_values(b, 1))
        ok = term >= 0
        if ok.any():
            held.append((arrow_values(b, 0)[ok], term[ok], [arrow_values(b, 2 + i)[ok] for i in range(n_values)]))
            size += int(ok.sum())
        if size > CHUNK:
            found = flushed(False)
            if len(found[1]):
                yield found
    if held:
        yield flushed(True)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    return dealt_evenly(rows, key).sortWithinPartitions(key)


def climbed(o: Terms, rows: DataFrame, key: str, values: tuple[str, ...] = (), halved: tuple[int, ...] = ()) -> DataFrame:
    """(key, term_id, values...) of the rows' terms and all ancestors; rows are without nulls."""
    shared = rows.sparkSession.sparkContext.broadcast(o)
    columns = [key, "term_id", *values]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        for keys, k, t, v in whole_keys(batches, o, len(values)):
            k, t, v = raised(o, k, t, v, halved)
            for a in range(0, len(k), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k[a : a + CHUNK]]), pa.array(o.ids[t[a : a + CHUNK]]), *[pa.array(x[a : a + CHUNK]) for x in v]], columns)

    return dealt(rows.select(*columns), key).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def per_term(o: Terms, rows: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(term_id, n, s): how many keys have the term or one below it, and the sum of their largest ``value``; a task sums its keys first."""
    shared = rows.sparkSession.sparkContext.broadcast(o)
    columns = [key, "term_id", *([value] if value else [])]
    kind = rows.schema["term_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        n, s = np.zeros(len(o.ids), np.int64), np.zeros(len(o.ids))
        for _, k, t, v in whole_keys(batches, o, len(columns) - 2):
            _, t, v = raised(o, k, t, v)
            n += np.bincount(t, minlength=len(n))
            if v:
                s += np.bincount(t, v[0], minlength=len(n))
        for a in range(0, len(n), CHUNK):
            at = a + np.flatnonzero(n[a : a + CHUNK])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(o.ids[at]), pa.array(n[at]), pa.array(s[at])], ["term_id", "n", "s"])

    sums = dealt(rows.select(*columns), key).mapInArrow(run, f"term_id {kind}, n long, s double")
    return sums.groupBy("term_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
