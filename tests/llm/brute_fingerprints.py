"""Edited texts and the likeness of paragraph sets, re-stated for comparison."""

import hashlib
import re

import xxhash


def paragraphs(text):
    return {p.strip(" ") for p in re.split(r"(?<=[.!?;|])[ \t\n\x0b\f\r]+|[\r\n]+", text)} - {""}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def rows(docs):
    """docs: {doc_id: text} -> {doc_id: (n_chars, edited_sha256, near_edited, near_next)}"""
    ids = sorted(docs, reverse=True)
    out = {}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, other = docs[i] or "", docs[after] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + other[:h]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, other))
    return out


def read(printed):
    n, s, cells = printed.split(";")
    signed = lambda x, bits: x - (1 << bits) if x >> (bits - 1) else x
    out = {}
    for c in cells.split(",") if cells else []:
        slot, count, total = c.split(".")
        out[int(slot, 16)] = (signed(int(count, 16), 64), int(total, 16))
    return int(n), int(s), out


def peeled(left, right, bits=21):
    """(plus, minus) recovered from two published fingerprints, None if they are too small for one another."""
    (n, s, a), (m, z, b) = read(left), read(right)
    s = min(s, z)
    cells = {}
    for sketch, sign in ((a, 1), (b, -1)):
        for slot, (c, x) in sketch.items():
            at = (slot >> bits, slot & (s - 1))
            old = cells.get(at, (0, 0))
            cells[at] = (old[0] + sign * c, old[1] ^ x)

    def own(x):
        h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42))
        return [(t, (h >> (bits * t)) & (s - 1)) for t in range(3)]

    plus, minus, todo = set(), set(), list(cells)
    while todo:
        at = todo.pop()
        c, x = cells[at]
        if abs(c) == 1 and xxhash.xxh64_intdigest((x >> 16).to_bytes(8, "little"), 42) & 0xFFFF == x & 0xFFFF and at in own(x):
            (plus if c > 0 else minus).add(x)
            for p in own(x):
                k, y = cells.get(p, (0, 0))
                cells[p] = (k - c, y ^ x)
                todo.append(p)
    return (len(plus), len(minus)) if not any(c or x for c, x in cells.values()) else None
