"""SimHash near-duplicates, by binary trie self-joins on the fingerprints.

A fingerprint bit is 1 where more than half of a text's shingles (repeats included) have it set in their XXH64.
Texts are lower-cased in A-Z; words are runs without ASCII white space; a text of fewer words than a shingle
takes is one shingle, and a text without words has fingerprint zero, which links like any other.

``near_edges`` finds the pairs of distinct fingerprints that differ in at most ``limit`` bits. The fingerprint is
read as ``tables`` words of bits. Within a word at most ``budget`` bits may differ, so one of ``budget + 1`` blocks
of it is equal; rows meet in the cell of that block's value. In a cell, a binary trie over the sorted words is
joined with itself: node pairs are traversed together, differing bits add up, and a pair is pruned when they
exceed the budget, or when all below it is linked already. Leaves are pages of up to ``PAGE`` words, compared at
once. A cell gives a spanning forest of its links rather than all pairs, so a group of k near copies gives k - 1
rows. A cell of over ``CELL_ROWS`` rows is cut into blocks, and each pair of blocks is joined by a task of its own. With
one table the search misses nothing. With several, a pair is found in any of them.

Components come from alternating star contractions on the edges, as joins and minima; each round is a written
table. Null texts count as empty; a null id never names a component unless its component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact import LOWER, listed
from .scratch import documents, unused, written

PAGE = 64
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 14
#: Rows of a cell, and shingles of a candidate group, that one task takes; larger ones are cut into blocks.
CELL_ROWS, SET_ROWS = 1 << 19, 1 << 20


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further 64-bit hash of each shingle, from its first (the splitmix64 finaliser)."""
    # Its increment, multipliers and shifts.
    x = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The XXH64 of every shingle, repeats included."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    ends -= 1
    last = max(0, len(tokens) - words)
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[a:b], 42) for a, b in zip(starts[: last + 1].tolist(), (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist())], dtype=np.uint64)


def majority(h: np.ndarray, bits: int) -> bytes:
    """The fingerprint's ``bits`` (a multiple of 64), least significant first, of these shingles."""
    if not len(h):
        return bytes(bits // 8)
    out = []
    for i in range(bits // 64):
        x = mixed(h, i) if i else h
        counts = sum(np.unpackbits(x[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(x), BLOCK))
        out.append(np.packbits(counts * 2 > len(x), bitorder="little").tobytes())
    return b"".join(out)


def fingerprint(text: bytes, words: int, bits: int) -> bytes:
    return majority(shingles(text, words), bits)


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``fp`` (binary, ``bits`` bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([fingerprint(t or b"", words, bits) for t in listed(batch, text_col)], pa.binary())], [id_col, "fp"])

    plain = docs.select(id_col, text_col)
    return plain.mapInArrow(run, T.StructType([plain.schema[id_col], T.StructField("fp", T.BinaryType())]))


def blocks(width: int, budget: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of the budget + 1 blocks of a word."""
    cuts = [width * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def word_of(fps: np.ndarray, table: int, width: int) -> np.ndarray:
    """Word ``table`` of fingerprints given as rows of bytes; widths are whole bytes."""
    padded = np.zeros((len(fps), 8), np.uint8)
    padded[:, : width // 8] = fps[:, table * width // 8 : (table + 1) * width // 8]
    return padded.view(np.uint64).ravel()


def celled(tables: range, width: int, budget: int):
    """Each fingerprint once for every block of each of the words ``tables``, with the block's value as its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("fp").to_pylist()
            if not raw:
                continue
            fps = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            for table in tables:
                word = word_of(fps, table, width)
                for k, (low, size) in enumerate(blocks(width, budget)):
                    cell = (word >> np.uint64(low)) & np.uint64((1 << size) - 1)
                    cell |= np.uint64((table * (budget + 1) + k) << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("fp"), batch.column("root")], ["cell", "fp", "root"])

    return run


def linked(word: np.ndarray, fps: np.ndarray, known: np.ndarray, width: int, budget: int, limit: int) -> np.ndarray:
    """For each of the sorted words, the index of its component's first: the trie self-join of one cell.

    Rows of equal ``known`` are in one component from the start, so the traversal skips pairs of nodes that hold no others."""
    n = len(word)
    _, first, which = np.unique(known, return_index=True, return_inverse=True)
    root = first[which]

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        a, b = root[i], root[j]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            to = np.arange(n)
            for x in up:
                to[x] = find(x)
            root = to[root]

    def compare(a: int, b: int, c: int, d: int) -> None:
        near = np.bitwise_count(word[a:b, None] ^ word[None, c:d]) <= budget
        i, j = np.nonzero(np.triu(near, 1) if a == c else near)
        i, j = i + a, j + c
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if len(i):
            close = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= limit
            if close.any():
                join(i[close], j[close])

    def one(a: int, b: int, c: int, d: int) -> bool:
        r = root[a]
        return root[c] == r and bool((root[a:b] == r).all()) and bool((root[c:d] == r).all())

    stack = [(0, n, 0, n, width - 1, 0)]
    while stack:
        a, b, c, d, bit, differing = stack.pop()
        if b - a <= PAGE and d - c <= PAGE:
            if not one(a, b, c, d):
                compare(a, b, c, d)
            continue
        if one(a, b, c, d):
            continue
        if bit < 0:  # equal words throughout: page by page
            for x in range(a, b, PAGE):
                for y in range(x if a == c else c, d, PAGE):
                    if not one(x, min(b, x + PAGE), y, min(d, y + PAGE)):
                        compare(x, min(b, x + PAGE), y, min(d, y + PAGE))
            continue

        def half(lo: int, hi: int) -> int:
            return lo + int(np.searchsorted(word[lo:hi], np.uint64(((int(word[lo]) >> bit) | 1) << bit)))  # noqa: B023

        m = half(a, b)
        if a == c:
            if differing < budget and a < m < b:
                stack.append((a, m, m, b, bit - 1, differing + 1))
            stack += [(lo, hi, lo, hi, bit - 1, differing) for lo, hi in ((m, b), (a, m)) if lo < hi]
        else:
            k = half(c, d)
            pairs = [(a, m, c, k, 0), (m, b, k, d, 0)] + ([(a, m, k, d, 1), (m, b, c, k, 1)] if differing < budget else [])
            stack += [(p, q, r, s, bit - 1, differing + x) for p, q, r, s, x in reversed(pairs) if p < q and r < s]
    return root


def joined(width: int, budget: int, limit: int):
    """The links of each cell between roots, as a forest: rows come in order of cells."""

    def links(cell: int, raw: list[bytes], known: np.ndarray) -> list[tuple[int, int]]:
        if (known == known[0]).all():
            return []
        if len(raw) == 2:
            return [tuple(known.tolist())] if (int.from_bytes(raw[0]) ^ int.from_bytes(raw[1])).bit_count() <= limit else []
        fps = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        word = word_of(fps, (cell >> 32) // (budget + 1), width)
        order = np.argsort(word, kind="stable")
        root = linked(word[order], np.ascontiguousarray(fps[order]).view(np.uint64), known[order], width, budget, limit)
        # the least root of a component is its end of all edges, so cells that find the same component give the same edges
        held = list(zip(known[order].tolist(), root.tolist()))
        least: dict[int, int] = {}
        for x, r in held:
            least[r] = min(x, least.get(r, x))
        return list({(x, least[r]) for x, r in held if x != least[r]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _), held in runs(batches, ("cell", "part")):
            raw = [x for batch in held for x in batch.column("fp").to_pylist()]
            if len(raw) > 1:
                found = links(cell, raw, np.concatenate([batch.column("root").to_numpy() for batch in held]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of each run of equal ``keys`` (longs), as slices of batches; one run is held at a time."""
    here, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(int(c[a]) for c in columns)
            if key != here:
                if held:
                    yield here, held
                here, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield here, held


def in_blocks(rows: DataFrame, blocks: Column, key: str) -> DataFrame:
    """Adds ``block`` and ``part``: each row goes to its block, by a hash of ``key``, and to each pair of blocks with it."""
    own = rows.withColumn("_of", blocks).withColumn("block", F.pmod(F.xxhash64(key), F.col("_of")).cast("int"))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    spread = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_of").cast("int") - 1)).alias("_other"))
    return spread.withColumn("part", low.cast("long") * F.col("_of") + high).drop("_of", "_other")


def near_edges(distinct: DataFrame, tables: range = range(1), width: int = 64, budget: int = 2, limit: int = 2) -> DataFrame:
    """Edges (u, v) of roots that connect all distinct fingerprints (fp, root) within reach of one another, as the words ``tables`` find them."""
    cells = distinct.select("fp", "root").mapInArrow(celled(tables, width, budget), "cell long, fp binary, root long")
    if distinct.count() > CELL_ROWS:  # no cell has more rows
        # at most one row for each CELL_ROWS rows
        large = cells.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS)
        cells = in_blocks(cells.join(F.broadcast(written(large, "cells")), "cell", "left"), F.coalesce(F.ceil(F.col("_n") / CELL_ROWS), F.lit(1)), "fp").select("cell", "part", "fp", "root")
    else:
        cells = cells.withColumn("part", F.lit(0).cast("long"))
    return cells.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(joined(width, budget, limit), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` that is not its component's smallest node."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        """Large star: larger neighbours go to a node's smallest; small star: the node and its smaller ones do."""
        both = e.select(F.col("u").alias("n"), F.col("v").alias("w"))
        if large:
            both = both.union(e.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = both.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m")).hint("merge")
        met = both.join(least, "n")
        if large:
            return met.where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        pairs = met.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).union(met.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return pairs.where("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node points to one node only, which points nowhere."""
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x")).select("x.*")
        return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").isEmpty()

    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(down, "edges")
    while not settled(e):
        e = written(stars(stars(e, True), False), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(fps: DataFrame, id_col: str = "doc_id", **search) -> DataFrame:
    """Each row of ``fps`` (id, fp) with its ``component_id``: the smallest id that links reach.

    A fingerprint's node is its XXH64: one to one for 64 bits, and 64 bits of a hash for longer fingerprints."""
    fps = fps.withColumn("node", F.xxhash64("fp"))
    distinct = written(fps.groupBy("node", "fp").agg(F.min(id_col).alias("_least")), "fingerprints")
    roots = components(near_edges(distinct.select("fp", F.col("node").alias("root")), **search)).hint("merge")
    placed = distinct.select("node", "_least").join(roots, "node", "left").select("node", "_least", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = placed.select("node", "root").join(least.hint("merge"), "root").select("node", "component_id")
    return fps.join(named.hint("merge"), "node").drop("node")


#: The wide fingerprint for five-word shingles and a similarity of 0.8: 16 words of 24 bits.
TABLES = 16
WIDE = {"width": 24, "budget": 2}
#: The words are joined in so many steps; a later step links only what the earlier ones left apart.
STEPS = (range(2), range(2, TABLES))
SIMILARITY = 0.8
#: Pairs are candidates from this much below the similarity on: over four standard errors of what 384 bits estimate.
MARGIN = 0.2
#: Bits, as a power of two, of the map of rows whose shingles are compared: 4 MB.
MAP_BITS = 25
#: Groups of up to so many sets are compared pair by pair, larger ones through lists of the sets that hold a rare shingle.
#: Sets of up to SHORT shingles are found by their subsets, as a few shingles say too little to compare fingerprints.
FEW, SHORT = 12, 8


def reach(similarity: float, bits: int) -> int:
    """Differing bits expected of two texts whose sets of shingles have this Jaccard similarity."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def counted(h: np.ndarray) -> np.ndarray:
    """The shingles as a sorted set in which the second, third ... occurrence of one is an element of its own."""
    values, counts = np.unique(h, return_counts=True)
    each = np.repeat(values, counts)
    nth = (np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    return np.unique(np.where(nth == 0, each, mixed(each + nth * np.uint64(0xD6E8FEB86659FD93), 1)))


def subset_keys(x: np.ndarray, similarity: float) -> list[int]:
    """Hashes of all subsets of a set of up to SHORT elements that can be what it shares with another within reach; none for larger sets."""
    if not 0 < len(x) <= SHORT:
        return []
    least = -(-len(x) * round(similarity * 10**6) // 10**6)
    return [signed(xxhash.xxh64_intdigest(x[list(c)].tobytes(), 42)) for m in range(least, len(x) + 1) for c in combinations(range(len(x)), m)]


def shingle_sets(docs: DataFrame, words: int, bits: int | None, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the ``text``, with ``node`` (a hash of the counted shingles), their number ``n``, and ``fp`` over them with the
    ``subset_keys``, or without ``bits`` the ``shingles``."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [counted(shingles(t or b"", words)) for t in listed(batch, "text")]
            node = pa.array([signed(xxhash.xxh64_intdigest(x.tobytes(), 42)) for x in sets], pa.int64())
            n = pa.array([len(x) for x in sets], pa.int64())
            longs = pa.list_(pa.int64())
            last = [pa.array([majority(x, bits) for x in sets], pa.binary()), pa.array([subset_keys(x, similarity) for x in sets], longs)] if bits else [pa.array([x.view(np.int64) for x in sets], longs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), node, n, *last], [*names, *made.names])

    of_fp = [T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    made = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), *(of_fp if bits else [T.StructField("shingles", T.ArrayType(T.LongType()))])])
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *made.fields]))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def alike(sets: list[np.ndarray], block: list[int], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose exact Jaccard similarity (above 0) is reached; with two blocks, of pairs across them.

    Trees grow one at a time, and a set is compared only with those that no tree has yet, share one of its rarest elements
    and are long enough: a large group of near copies is done once its first members have met the others. Sets that share
    common elements but reach no one are still met by each, if they differ in few rare ones."""
    k, up = len(sets), list(range(len(sets)))
    across = len(set(block)) > 1
    scale = 10**6
    least = round(similarity * scale)
    sizes = np.array([len(x) for x in sets])
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))

    def enough(common, i, j):
        return common * scale >= (sizes[i] + sizes[j] - common) * least

    if k <= FEW:
        for i in range(k):
            for j in range(i + 1, k):
                if (not across or block[i] != block[j]) and find(i) != find(j) and enough(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), i, j):
                    join(i, j)
        return out
    # an empty set gets an element that only empty sets have
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(values))
    owner = np.concatenate([np.repeat(np.arange(k), sizes), np.flatnonzero(sizes == 0)])
    flat = np.concatenate([rank[inverse], np.full((sizes == 0).sum(), len(values))])
    order = np.lexsort((flat, owner))
    owner, flat = owner[order], flat[order]
    lengths = np.maximum(sizes, 1)
    first = np.cumsum(lengths) - lengths
    # sets within reach share one of their rarest elements: as many as may be missing, and one more
    heads = np.minimum(sizes + (-sizes * least // scale) + 1, lengths)
    in_head = np.arange(len(flat)) - np.repeat(first, lengths) < np.repeat(heads, lengths)
    blocks, left, inside = np.array(block), np.ones(k, bool), np.zeros(len(values) + 1, bool)
    n_left, indexed = k, 0

    def index() -> tuple[np.ndarray, np.ndarray]:
        chosen = in_head & left[owner]
        held = flat[chosen]
        return owner[chosen][np.argsort(held, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(values) + 1))])

    for seed in range(k):
        if not left[seed]:
            continue
        left[seed], n_left, todo = False, n_left - 1, [seed]
        while todo and n_left:
            i = todo.pop()
            if not indexed or 2 * n_left < indexed:
                (holder, starts), indexed = index(), n_left
            mine = flat[first[i] : first[i] + lengths[i]]
            probe = mine[: heads[i]]
            met = np.unique(holder[spans(starts[probe], starts[probe + 1] - starts[probe])])
            met = met[left[met]]
            if across:
                met = met[blocks[met] != blocks[i]]
            met = met[np.minimum(sizes[met], sizes[i]) * scale >= np.maximum(sizes[met], sizes[i]) * least]
            if not len(met):
                continue
            inside[mine] = True
            total = lengths[met]
            common = np.add.reduceat(inside[flat[spans(first[met], total)]].astype(np.int64), np.cumsum(total) - total)
            inside[mine] = False
            near = met[enough(common, i, met)].tolist()
            left[near] = False
            n_left -= len(near)
            todo += near
            out += [(i, j) for j in near]
    return out


def linking(similarity: float):
    """Links among the sets of each candidate group: rows come in order of (comp, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, ("comp", "part")):
            node = [x for b in held for x in b.column("node").to_pylist()]
            sets = [x.values.to_numpy() for b in held for x in b.column("shingles")]
            found = alike(sets, [x for b in held for x in b.column("block").to_pylist()], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], ["u", "v"])

    return run


def exact_links(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) of ``members`` (row, node, n, comp) that connect all within reach of one another in a ``comp``.

    ``texts`` (row, text) are read again where a bit map of fixed size has their row; only the sets of these are dealt out."""
    bit = F.pmod(F.xxhash64("row"), F.lit(1 << MAP_BITS))
    bits = members.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("map"))
    # one row for each bucket of 32,768 bits, so 1,024 rows at most
    marked = texts.withColumn("b", bit).withColumn("bucket", F.expr("bitmap_bucket_number(b)")).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.expr("substring(map, cast(bitmap_bit_position(b) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    wanted = marked.where(F.getbit(byte, F.pmod(F.expr("bitmap_bit_position(b)"), F.lit(8)).cast("int")) == 1).select("row", "text")
    sizes = members.groupBy("comp").agg(F.ceil(F.sum("n") / SET_ROWS).alias("blocks"))
    placed = members.select("row", "comp").join(sizes.hint("merge"), "comp")
    sets = placed.join(shingle_sets(wanted, words, None).hint("merge"), "row")
    dealt = in_blocks(sets, F.greatest("blocks", F.lit(1)), "node").select("comp", "part", "node", "block", "shingles")
    return dealt.repartition("comp", "part").sortWithinPartitions("comp", "part").mapInArrow(linking(similarity), "u long, v long")


def short_edges(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) from each fingerprint (at) of a short set to the least that has one of its subset keys."""
    keys = nodes.select("at", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("at").alias("v"), F.max("at").alias("top")).where("v < top").select("key", "v")
    return keys.join(shared.hint("merge"), "key").where("at <> v").select(F.col("at").alias("u"), "v").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group that chains of pairs of ``similarity`` or more connect: that with the smallest id (null
    last; of rows that repeat it, one). Similarity is the exact Jaccard similarity of the bags of shingles: shared
    occurrences by all. Texts without words, null ones too, are copies of one another. An empty table gives no rows; extra
    columns of any name pass through.

    Wide fingerprints of the sets find candidate groups by the trie self-join, with a margin; the first two words join most
    copies of a large group, so that the other words add few links to it. Sets of up to SHORT shingles, for which that
    search is not reliable, also meet by the subsets that they can share, so no pair of such sets is missed. Within a group all pairs are
    compared exactly: the sets of a group meet in one task, or, if they are many, by pairs of blocks in many tasks, and
    only pairs within reach link."""
    bits = TABLES * WIDE["width"]
    (row,) = unused(docs.columns, "row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    plain = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    nodes = written(shingle_sets(plain, words, bits, similarity).groupBy("node", "n", "fp").agg(least, F.first("keys").alias("keys")).withColumn("at", F.xxhash64("fp")), "nodes")
    comps = nodes.select("fp", F.col("at").alias("root")).distinct()
    searches = [lambda c: short_edges(nodes), *(lambda c, t=t: near_edges(c, t, limit=reach(similarity - MARGIN, bits), **WIDE) for t in STEPS)]
    for search in searches:
        roots = components(search(comps)).withColumnRenamed("root", "to")
        comps = written(comps.join(roots.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("fp", F.coalesce("to", "root").alias("root")), "comps")
    placed = nodes.select("node", "n", "fp", F.col("least.row").alias("row")).join(comps.withColumnRenamed("root", "comp").hint("merge"), "fp").select("node", "n", "row", "comp")
    several = placed.groupBy("comp").agg(F.count("*").alias("members")).where("members > 1").select("comp")
    members = written(placed.join(several.hint("merge"), "comp"), "members")
    links = components(exact_links(members, plain.select("row", "text"), words, similarity))
    final = nodes.select("node", "least").join(links.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("kept"))
    kept = written(final.select(F.col("kept.row").alias(row)), "kept")
    return keyed.join(kept.hint("merge"), row, "left_semi").drop(row)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles, and its component at 2 or fewer differing bits."""
    fps = written(fingerprints(documents(spark, sf_dir)), "simhash")
    shown = F.lower(F.concat(*[F.hex(F.substring("fp", i, 1)) for i in range(8, 0, -1)]))  # bytes are stored least significant first
    return grouped(fps).select("doc_id", shown.alias("fingerprint"), "component_id")
