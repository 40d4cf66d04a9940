"""SentencePiece encoding as a lattice, and decoding.

A text is its words one after another: spaces become U+2581, one more leads, and a word is a run of marks with what
follows up to the next mark or line end. No piece crosses such a border, so words are encoded on their own, in the task that
reads them: no row moves and nothing is written.

1. the distinct words of a batch that the task has not met are laid out as arrays of characters, about ``CHARS`` at once;
2. all their substrings up to the longest piece's length go down a trie of the pieces together, length by length; what they
   meet are the lattice's edges. A character that is no piece becomes an edge of unknown score;
3. the edges of all words are folded together. For a unigram model the fold is Viterbi: the best score and edge for each
   end, then the way back; ties keep the longer piece. For a model made by merges it takes, again and again, each word's
   best-scored edge over two neighbours, the leftmost of equals, as that model is defined. Unknown characters give byte pieces;
4. a task keeps the ids of at most ``MOST_WORDS`` words, and begins anew beyond.

``encode_words`` is the same lattice as a table: substrings joined with the pieces, folded in a higher-order ``aggregate``.

Which fold applies is read from the model file: summed scores do not give the encoding of a model made by merges (see
the README). Words of over ``LONG`` characters are folded by the same rule one by one, with memory in proportion.

Null and empty texts have no ids. A U+2581 in a text decodes to a space. Repeated rows give a row each.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact import listed
from .scratch import documents
from .secrets import bind

MARK = "▁"
MOST_PIECES = 300_000
LONG = 64
CHARS, MOST_WORDS = 100_000, 500_000
#: Ids in a batch of the result.
MOST_IDS = 1 << 22
#: An unknown character scores this much below the lowest score.
UNKNOWN = 10.0
_word = re.compile(rb"\n| *[^ \n]+| +")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte, control
    bytes_at: list[int]
    merges: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, k in zip(self.pieces, self.kinds) if k == "normal")

    def lookup(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k == "normal"}

    @property
    def unknown(self) -> float:
        return min(s for s, k in zip(self.scores, self.kinds) if k == "normal") - UNKNOWN


def made_by_merges(model_file: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    kind = model.trainer_spec
    if kind.model_type not in (kind.UNIGRAM, kind.BPE):
        raise ValueError("only unigram models and models made by merges are known")
    return kind.model_type == kind.BPE


def vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = p.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces; at most {MOST_PIECES} are broadcast")
    kinds = ["byte" if p.is_byte(i) else "control" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal" for i in range(n)]
    pieces = [p.id_to_piece(i) for i in range(n)]
    at = {x: i for i, x in enumerate(pieces)}
    crossing = [x for x, k in zip(pieces, kinds) if k == "normal" and re.search(f"[^{MARK}]{MARK}|\n", x)]
    if crossing:
        raise ValueError(f"pieces cross words: {crossing[:3]}")
    return Vocabulary(pieces, [p.get_score(i) for i in range(n)], kinds, [at[f"<0x{b:02X}>"] for b in range(256)], made_by_merges(model_file))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text; a space stands for the mark."""
    return _word.findall(b" " + text.replace(MARK.encode(), b" ")) if text else []


class Trie:
    """The pieces by their characters, as arrays."""

    def __init__(self, vocab: Vocabulary) -> None:
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds)):
            if k == "normal":
                at = 0
                for c in p:
                    at = nodes.setdefault(at << 21 | ord(c), len(nodes) + 1)
                ends[at] = i
        codes = np.fromiter(nodes.keys(), np.int64, len(nodes))
        order = np.argsort(codes)
        self.codes, self.next = codes[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.longest, self.merges, self.unknown = vocab.longest, vocab.merges, vocab.unknown
        self.scores, self.bytes_at = np.array(vocab.scores), np.array(vocab.bytes_at, np.int32)

    def lattice(self, chars: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each character and length the piece that is there, or -1; ``left`` characters remain in the word, itself included."""
        out = np.full((len(chars), self.longest), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for n in range(self.longest):
            inside = left[at] > n
            at, node = at[inside], node[inside]
            code = node << 21 | chars[at + n]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            there = self.codes[place] == code
            at, node = at[there], self.next[place[there]]
            if not len(at):
                break
            out[at, n] = self.piece[node]
        return out

    def merged(self, lattice: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of all words begin and end after all merges; ``word`` numbers each character's word."""
        begin = np.arange(len(word))
        end, done = begin + 1, []
        while len(begin):
            size = end[1:] - begin[:-1]
            at = np.flatnonzero((word[1:] == word[:-1]) & (size <= self.longest))
            found = lattice[begin[at], size[at] - 1]
            at, score = at[found >= 0], self.scores[found[found >= 0]]
            own = word[at]
            start = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1)) if len(own) else np.zeros(0, int)
            top = np.repeat(np.maximum.reduceat(score, start), np.diff(np.append(start, len(own)))) if len(own) else score
            best = at[score == top]
            best = best[np.concatenate(([True], np.diff(word[best]) > 0))] if len(best) else best
            end[best] = end[best + 1]
            keep = np.ones(len(begin), bool)
            keep[best + 1] = False
            joined = np.zeros(int(word[-1]) + 1, bool)
            joined[own] = True
            more = joined[word]
            done.append((begin[~more], end[~more]))
            keep &= more
            begin, end, word = begin[keep], end[keep], word[keep]
        begin, end = (np.concatenate([d[i] for d in done]) for i in range(2))
        order = np.argsort(begin)
        return begin[order], end[order]

    def best_paths(self, lattice: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the best-scored paths; words begin at ``first``."""
        number = np.arange(len(first))  # a word has a node more than it has characters
        score, came = np.full(len(lattice) + len(first), -np.inf), np.zeros(len(lattice) + len(first), np.int64)
        score[first + number] = 0.0
        for s in range(int(size.max(initial=0))):
            mine = np.flatnonzero(size > s)
            at = first[mine] + s
            node = at + mine
            for n in range(self.longest):
                piece = lattice[at, n]
                ok = piece >= 0 if n else np.ones(len(at), bool)
                to = node[ok] + n + 1
                reached = score[node[ok]] + np.where(piece[ok] >= 0, self.scores[piece[ok]], self.unknown)
                better = reached > score[to]
                score[to[better]], came[to[better]] = reached[better], node[ok][better]
        begins, ends, here = [], [], first + size + number
        while len(here):
            begins.append(came[here] - number)
            ends.append(here - number)
            here = came[here]
            more = here > first[number] + number
            here, number = here[more], number[more]
        begin, end = np.concatenate(begins), np.concatenate(ends)
        order = np.argsort(begin)
        return begin[order], end[order]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids, as little-endian 32-bit numbers, of each word (marks for spaces, not empty)."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        lattice = self.lattice(chars, (first + size)[word] - np.arange(len(chars)))
        begin, end = self.merged(lattice, word) if self.merges else self.best_paths(lattice, first, size)
        piece = lattice[begin, end - begin - 1]
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        count = np.where(piece >= 0, 1, at[begin + 1] - at[begin])
        offset = np.cumsum(count) - count
        ids = np.repeat(piece, count)
        lost = np.repeat(piece < 0, count)
        ids[lost] = self.bytes_at[raw[(np.repeat(at[begin] - offset, count) + np.arange(len(ids)))[lost]]]
        edges = (np.append(offset, len(ids))[np.append(np.searchsorted(begin, first), len(begin))] * 4).tolist()
        held = ids.astype("<i4").tobytes()
        return [held[a:b] for a, b in zip(edges[:-1], edges[1:])]


def bytes_of(c: Column, byte_ids: list[int]) -> Column:
    """The byte pieces of a character."""
    table = F.array(*[F.lit(i) for i in byte_ids])
    return F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.element_at(table, F.conv(F.substr(F.hex(c), i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))


def merged(edges: Column, word: Column, byte_ids: list[int]) -> Column:
    """Ids after all merges. ``edges`` as for viterbi; the state is the borders between pieces."""

    def step(borders: Column, _: Column) -> Column:
        joins = F.filter(edges, lambda x: (x["id"] >= 0) & (F.get(borders, (F.array_position(borders, x["s"]) + 1).cast("int")) == x["e"]) & F.array_contains(borders, x["s"]))
        best = F.array_max(F.transform(joins, lambda x: F.struct(x["score"].alias("score"), (-x["s"]).alias("left"), x["e"].alias("e"))))
        return bind(best, lambda m: F.when(m.isNull(), borders).otherwise(F.filter(borders, lambda v: (v <= -m["left"]) | (v >= m["e"]))))

    def piece(borders: Column, i: Column) -> Column:
        own = F.filter(edges, lambda x: (x["s"] == borders[i]) & (x["e"] == borders[i + 1]))[0]["id"]
        return bind(own, lambda d: F.when(d >= 0, F.array(d)).otherwise(bytes_of(F.substr(word, borders[i] + 1, F.lit(1)), byte_ids)))

    n = F.length(word)
    borders = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)
    return bind(borders, lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: piece(b, i))))


def viterbi(edges: Column, word: Column, byte_ids: list[int]) -> Column:
    """Ids of the best path. ``edges``: array<struct<e int, s int, id int, score double>> by end and start."""
    origin = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(-1).alias("s"), F.lit(-1).alias("id")))

    def step(best: Column, x: Column) -> Column:
        reached = F.struct((best[x["s"]]["v"] + x["score"]).alias("v"), x["s"].alias("s"), x["id"].alias("id"))
        return bind(reached, lambda r: F.when(x["e"] == F.size(best), F.concat(best, F.array(r))).when(r["v"] > best[x["e"]]["v"], F.concat(F.slice(best, 1, x["e"]), F.array(r))).otherwise(best))

    def back(state: Column, _: Column) -> Column:
        node = state["best"][state["at"]]
        ids = F.when(node["id"] >= 0, F.array(node["id"])).otherwise(bytes_of(F.substr(word, state["at"], F.lit(1)), byte_ids))
        return F.when(state["at"] == 0, state).otherwise(F.struct(node["s"].alias("at"), state["best"].alias("best"), F.concat(ids, state["ids"]).alias("ids")))

    best = F.aggregate(edges, origin, step)
    return bind(best, lambda b: F.aggregate(F.sequence(F.lit(1), F.length(word)), F.struct(F.length(word).alias("at"), b.alias("best"), F.expr("cast(array() as array<int>)").alias("ids")), back)["ids"])


def encode_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, ids) of distinct, non-empty words (spaces for marks)."""
    spark = words.sparkSession
    table = pa.table({"piece": [p for p, k in zip(vocab.pieces, vocab.kinds) if k == "normal"], "id": pa.array([i for i, k in enumerate(vocab.kinds) if k == "normal"], pa.int32()), "score": [s for s, k in zip(vocab.scores, vocab.kinds) if k == "normal"]})
    pieces = F.broadcast(spark.createDataFrame(table))
    marked = words.select("word", F.monotonically_increasing_id().alias("w"), F.translate("word", " ", MARK).alias("m"))
    starts = marked.select("w", "word", "m", F.explode(F.sequence(F.lit(0), F.length("m") - 1)).alias("s"))
    spans = starts.select("w", "word", "s", F.substr("m", F.col("s") + 1, F.lit(vocab.longest)).alias("rest"))
    subs = spans.select("w", "word", "s", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("n")).select("w", "word", "s", "n", F.substr("rest", F.lit(1), F.col("n")).alias("piece"))
    edges = subs.join(pieces, "piece", "left").where("id is not null or n = 1")
    edge = F.struct((F.col("s") + F.col("n")).alias("e"), "s", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(vocab.unknown)).alias("score"))
    lattice = edges.groupBy("w", "word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    fold = merged if vocab.merges else viterbi
    return lattice.select("word", fold(F.col("edges"), F.translate("word", " ", MARK), vocab.bytes_at).alias("ids"))


def best_path(word: str, lookup: dict[str, tuple[int, float]], longest: int, unknown: float, byte_ids: list[int]) -> list[int]:
    """The same recurrence over one word, for words that are too long for a lattice row."""
    n = len(word)
    score, start, piece = [0.0] + [float("-inf")] * n, [-1] * (n + 1), [-1] * (n + 1)
    for s in range(n):
        for e in range(s + 1, min(n, s + longest) + 1):
            found = lookup.get(word[s:e]) or ((-1, unknown) if e == s + 1 else None)
            if found and score[s] + found[1] > score[e]:
                score[e], start[e], piece[e] = score[s] + found[1], s, found[0]
    out: list[int] = []
    while n:
        out[:0] = [piece[n]] if piece[n] >= 0 else [byte_ids[b] for b in word[n - 1].encode()]
        n = start[n]
    return out


def all_merges(word: str, lookup: dict[str, tuple[int, float]], byte_ids: list[int]) -> list[int]:
    """The merges of one long word, by a heap over neighbours."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        if 0 <= a and after[a] < n:
            e = end[after[a]]
            found = lookup.get(word[a:e])
            if found:
                heapq.heappush(heap, (-found[1], a, e))

    for a in range(n - 1):
        offer(a)
    gone = [False] * n
    while heap:
        _, a, e = heapq.heappop(heap)
        if gone[a] or after[a] >= n or end[after[a]] != e or end[a] >= e:
            continue
        b = after[a]
        gone[b], end[a], after[a] = True, e, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        offer(before[a])
    out: list[int] = []
    for a in range(n):
        if not gone[a]:
            found = lookup.get(word[a : end[a]])
            out += [found[0]] if found else [byte_ids[x] for x in word[a].encode()]
    return out


def learn(words: list[bytes], known: dict[bytes, bytes], trie: Trie, lookup: dict[str, tuple[int, float]], byte_ids: list[int]) -> None:
    """Adds the ids of ``words`` to ``known``."""
    part: list[bytes] = []
    marked: list[str] = []
    size = 0

    def add() -> None:
        known.update(zip(part, trie.ids_of(marked)))

    for w in words:
        text = w.decode().replace(" ", MARK)
        if len(text) > LONG:
            path = all_merges(text, lookup, byte_ids) if trie.merges else best_path(text, lookup, trie.longest, trie.unknown, byte_ids)
            known[w] = np.array(path, "<i4").tobytes()
            continue
        part.append(w)
        marked.append(text)
        size += len(text)
        if size >= CHARS:
            add()
            part, marked, size = [], [], 0
    if part:
        add()


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids array<int>) of every row."""
    vocab = vocabulary(model_file)
    shared = docs.sparkSession.sparkContext.broadcast((Trie(vocab), vocab.lookup(), vocab.bytes_at))
    rows = docs.select(id_col, text_col)
    schema = T.StructType([rows.schema[id_col], T.StructField(text_col, T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}

        def batch(texts: pa.RecordBatch, out: list[bytes]) -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in out]))).astype(np.int64)
            if offsets[-1] >= 1 << 31:
                raise ValueError("a text has more ids than a batch can hold")
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(out), np.int32)), type=pa.list_(pa.field("element", pa.int32())))
            return pa.RecordBatch.from_arrays([texts.column(id_col), texts.column(text_col), ids], [id_col, text_col, "ids"])

        for b in batches:
            first, size, out = 0, 0, []
            texts = listed(b, text_col)
            for at in range(0, len(texts), 256):
                split = [words_of(t or b"") for t in texts[at : at + 256]]
                new = list({w for words in split for w in words if w not in known})
                if len(known) + len(new) > MOST_WORDS:
                    known.clear()
                    new = list({w for words in split for w in words})
                learn(new, known, *shared.value)
                for words in split:
                    out.append(b"".join([known[w] for w in words]))
                    size += len(out[-1]) // 4
                    if size >= MOST_IDS:
                        yield batch(b.slice(first, len(out)), out)
                        first, size, out = first + len(out), 0, []
            if out:
                yield batch(b.slice(first, len(out)), out)

    return rows.mapInArrow(run, schema)


def decoded(ids: list[int], shown: list[bytes]) -> bytes:
    text = b"".join([shown[i] for i in ids])
    return text[1:] if text.startswith(b" ") else text


def shown_pieces(vocab: Vocabulary) -> list[bytes]:
    """By id, the bytes a piece stands for."""
    byte = {i: bytes([b]) for b, i in enumerate(vocab.bytes_at)}
    return [byte[i] if k == "byte" else b"" if k == "control" else p.replace(MARK, " ").encode() for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds))]


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text that the ids stand for (binary: ids may not be whole characters)."""
    shown = shown_pieces(vocabulary(model_file))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(x or [], shown) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.binary())], [*names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Every document encoded, and decoded again: number and digest (of little-endian 32-bit ids), and whether the text came back."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    shown = shown_pieces(vocabulary(model_file))
    mark = MARK.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("ids")
            flat, ends = held.flatten().to_numpy(zero_copy_only=False), held.offsets.to_numpy()
            ids = [flat[a:b] for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist())]
            same = [decoded(x.tolist(), shown) == (t or b"").replace(mark, b" ") for x, t in zip(ids, listed(batch, "text"))]
            shas = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(shas), pa.array(same)], ["doc_id", "n_ids", "ids_sha256", "round_trip"])

    found = encode(documents(spark, sf_dir), model_file)
    return found.mapInArrow(run, T.StructType([found.schema["doc_id"], T.StructField("n_ids", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]))
