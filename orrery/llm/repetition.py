"""Repetition within a text: a suffix array and its longest common prefixes find what occurs twice, and rules limit it.

The array is sorted by prefix doubling (Manber and Myers, with only undecided suffixes sorted again, as Larsson and
Sadakane do); the prefixes of neighbours come from the irreducible ones alone (Kärkkäinen, Manzini and Puglisi: their sum is
at most 2 n log n), the others are one less than their left neighbour's. A suffix's longest common prefix with either
neighbour is the innermost interval that holds it, so the union of these spans is the union of all maximal repeated
substrings. All work is on a whole text in the task that reads it, in arrays; no rows move.

A document is kept if it passes the base rule and repeats of at least ``LEAST`` code points cover at most ``MOST_COVERED`` of it
and none is longer than ``LONGEST``. Null and empty texts have no words and fail the base rule. Repeated rows get equal
results, and a repeat may overlap itself (a run of one letter repeats all but its last). Other columns are left alone. A
text takes about 80 bytes of memory for each of its bytes while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents, unused

#: The rules: the least repeat that counts, the share of a text that repeats may cover, and the longest repeat allowed.
LEAST, MOST_COVERED, LONGEST = 40, 0.3, 1000
#: Symbols of nine bits in a packed word; symbol 0 stands for the end of the text.
PACK, BITS = 7, 9
WINDOW = 5
SYMBOLS = b"#*$%&|<>"


class Repeats(NamedTuple):
    """Spans of code points (start, end) that are covered by repeats, and the longest repeat's length."""

    spans: np.ndarray
    longest: int


def packed(data: np.ndarray) -> np.ndarray:
    """For each byte the next ``PACK`` bytes as one number, in order of the text."""
    n = len(data)
    one = np.zeros(n + PACK, np.uint64)
    one[:n] = data
    one[:n] += np.uint64(1)
    bits = lambda k: np.uint64(BITS * k)
    two = one[:-1] << bits(1) | one[1:]
    three = two[:-1] << bits(1) | one[2:]
    four = two[:-2] << bits(2) | two[2:]
    return (four[:n] << bits(3)) | three[4 : 4 + n]


def suffix_array(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, from ``packed``; the places in it of those whose first bytes, nearly ``least`` of them, others
    share; and whether each of these is the first of those that share them."""
    n = len(keys)
    order = np.argsort(keys)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots, found, h = np.arange(n), keys[order], PACK
    while True:
        new = np.ones(len(slots), bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, new = slots[tied], new[tied]
        if h <= least:
            shared, first = slots, new
        if not len(slots):
            return order, shared, first
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key)
        order[slots], found = at[by], key[by]
        h *= 2


def common(keys: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes ``a`` and ``b``, pair by pair."""
    n, out, offset = len(keys), np.zeros(len(a), np.int64), 0
    left = np.arange(len(a))
    while len(left):
        x, y = a[left] + offset, b[left] + offset
        far = np.maximum(x, y)
        inside = far < n
        diff = np.where(inside, keys[np.minimum(x, n - 1)] ^ keys[np.minimum(y, n - 1)], np.uint64(1 << (BITS * PACK - 1)))
        ended = diff != 0
        # the highest bit that differs lies in the first symbol that differs; floats keep it, but for rounding up to a power of two
        top = np.frexp((diff[ended] & ~(diff[ended] >> np.uint64(1))).astype(np.float64))[1] - 1
        out[left[ended]] = offset + PACK - 1 - top // BITS
        left, offset = left[~ended], offset + PACK
        if len(left) <= 32 and offset >= 4 * PACK:
            for k in left:
                out[k] = offset + along(data, int(a[k]) + offset, int(b[k]) + offset)
            break
    return out


def along(data: np.ndarray, i: int, j: int) -> int:
    """The common prefix of two suffixes, in growing slices."""
    met, size = 0, 1024
    most = len(data) - max(i, j)
    while met < most:
        size = min(2 * size, most - met)
        differ = data[i + met : i + met + size] != data[j + met : j + met + size]
        first = int(differ.argmax())
        if differ[first]:
            return met + first
        met += size
    return most


def longest_prefixes(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of suffixes, rising, and the longest prefix of each that also begins elsewhere: all that are ``least`` or more."""
    keys = packed(data)
    order, slots, first = suffix_array(keys, least)
    if not len(slots):
        return slots, slots
    at = order[slots]
    before = np.where(first, -1, order[slots - 1])
    start = ~first & ((at == 0) | (before == 0) | (data[at - 1] != data[before - 1]))
    plcp = np.zeros(len(at), np.int64)
    plcp[start] = common(keys, data, at[start], before[start])
    # by place in the text: what is not irreducible is one less than its left neighbour's
    by = np.argsort(at)
    places = at[by]
    last = np.maximum.accumulate(np.where((start | first)[by], np.arange(len(by)), 0))
    lcp = np.empty(len(at), np.int64)
    lcp[by] = np.maximum(plcp[by][last] - (places - places[last]), 0)
    best = lcp.copy()
    best[:-1] = np.maximum(lcp[:-1], np.where(first[1:], 0, lcp[1:]))
    return places, best[by]


def repeats(text: bytes, least: int = LEAST) -> Repeats:
    """What of a text (UTF-8) repeats with at least ``least`` code points, at least ``PACK`` bytes."""
    n, none = len(text), Repeats(np.zeros((0, 2), np.int64), 0)
    if n <= least:
        return none
    data = np.frombuffer(text, np.uint8)
    at, length = longest_prefixes(data, least)
    at, length = at[length >= least], length[length >= least]
    if not len(at):
        return none
    begins = np.ones(n + 1, bool)
    begins[:n] = (data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(begins[:n])))  # code points that begin before a byte
    end = before[at + length] - ~begins[at + length]  # a code point that is cut off doesn't count
    whole = end - before[at]
    counts = whole >= least
    if not counts.any():
        return none
    change = np.zeros(before[n] + 1, np.int64)
    np.add.at(change, before[at][counts], 1)
    np.add.at(change, end[counts], -1)
    covered = np.concatenate(([0], np.cumsum(change[:-1]) > 0, [0]))
    return Repeats(np.flatnonzero(np.diff(covered)).reshape(-1, 2), int(whole.max()))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    key, values = ids, len(number)
    for k in range(1, window):
        if values * len(number) >= 1 << 62:
            met, key = np.unique(key, return_inverse=True)
            values = len(met)
        key, values = key[:-1] * len(number) + ids[k:], values * len(number)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n + 1, np.int64)
    twice[order[:-1][same]] = 1
    twice[order[1:][same]] = 1
    twice[window:] -= twice[:-window].copy()
    return int((np.cumsum(twice[:n]) > 0).sum())


def points(text: bytes) -> int:
    """Code points of a text in UTF-8."""
    return len(text) if text.isascii() else len(text.translate(None, bytes(range(0x80, 0xC0))))


def counted(text: bytes) -> dict[str, int]:
    """The counts of the base rule; words are runs of bytes other than ASCII white space."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return {
        "n_words": len(words), "word_chars": points(b"".join(words)), "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words),
    }


#: The columns that ``measured`` adds.
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_chars": "long", "covered_chars": "long", "longest_repeat": "long", "repeat_spans": "array<struct<start:long,end:long>>"}


def measured(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with a struct ``repetition`` of ``MEASURES`` (with underscores behind its name where that is taken)."""
    (name,) = unused(docs.columns, "repetition")
    kind = pa.struct([(k, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])) if k == "repeat_spans" else pa.int64()) for k in MEASURES])

    def one(text: bytes) -> dict:
        found = repeats(text, least)
        width = found.spans[:, 1] - found.spans[:, 0]
        return counted(text) | {"n_chars": points(text), "covered_chars": int(width.sum()), "longest_repeat": found.longest, "repeat_spans": [{"start": a, "end": b} for a, b in found.spans.tolist()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
            out = pa.array([one(t.as_py() or b"") for t in texts], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    fields = ", ".join(f"{k}: {v}" for k, v in MEASURES.items())
    schema = docs.select(*docs.columns, F.lit(None).cast(f"struct<{fields}>").alias(name)).schema
    return docs.mapInArrow(run, schema)


def verdicts(r: Column, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> tuple[Column, Column]:
    """Of a ``repetition``: whether the base rule fails, and whether the repeats are within the limits."""
    failed = (r["n_words"] < 10) | (100 * r["n_repeat_words"] > 20 * r["n_words"])
    fine = (r["covered_chars"] <= most_covered * r["n_chars"]) & (r["longest_repeat"] <= longest)
    return failed, fine


def keeping(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass the base rule and the limits, with their own columns."""
    m = measured(docs, text_col)
    failed, fine = verdicts(m[m.columns[-1]])
    return m.where(~failed & fine).select(*docs.columns)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the base counts, what its repeats cover, and whether it stays."""
    r = F.col("repetition")
    failed, fine = verdicts(r)
    names = [c for c in MEASURES if c not in ("n_chars", "repeat_spans")]
    return measured(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *[r[c].alias(c) for c in names], failed.alias("base_failed"), (~failed & fine).alias("kept"))
