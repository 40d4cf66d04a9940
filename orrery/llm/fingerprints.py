"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in built-in functions only.

A text's paragraphs (lines, cut after sentence ends; blank ones aside) form a set of 64-bit digests: the upper 48
bits hash the paragraph, the lower 16 check them. A sketch has three parts of ``s`` cells, a power of two; a digest
goes to one cell of each part, which counts it and adds it by exclusive or. Only cells that hold something are kept,
as an array in order of slots, so a sketch can be roomy (``ROOM`` cells in a part for each digest) at no cost.

The fingerprint is the published sketch. Two fingerprints are compared by subtracting them: the roomier one is folded
to the other's size (slots modulo the smaller ``s``), equal slots meet in one sort, and what both texts have cancels.
Peeling takes all cells that hold one digest (count 1 or -1, the check holds, and the cell is one of the digest's own),
removes these digests from their cells, and goes on until nothing is left: what was removed are the digests that only
one text has. If cells remain, the two sketches were too small, and both are made anew from the digests, with four
times the room each time and another hash, up to ``TRIES`` times in all. By the odds of two digests sharing all three cells, the first try
fails for about one pair in 10,000 (more where sizes are very unlike), the second for one in a million, and each further one
for 64 times fewer; none of this was measured. Should even the last fail, the job stops with an error rather than give a guess.

The likeness of two texts is the share of their paragraphs that both have (1 for two texts without paragraphs); it
comes from the number of digests in the fingerprint and from what peeling recovers. All of it works within a row, in
time n log n of a text's paragraphs.

Null texts count as empty, a null id as the smallest; rows that repeat an id give a row each, and the one with the
smallest text lends the id's text to the document before it. Empty tables give no rows. Extra columns are not read.
An id that a good part of all rows bear is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import documents, written

CUT = r"(?<=[.!?;|])\s+|[\r\n]+"
#: Cells in a part for each digest, and at least; tries; rounds of one peeling; bits of a slot within its part.
ROOM, LEAST, TRIES, ROUNDS, BITS = 8, 64, 5, 24, 21
NULL_ID = -(1 << 63)
#: An id that more than one in this many rows bear is dealt out over as many tasks as ``SPREAD``.
HOT, SPREAD = 1024, 64
LONGS = "cast(array() as array<bigint>)"
NOTHING = "named_struct('slot', 0, 'c', 0, 'x', 0L)"

# The functions below give SQL text for expressions on arrays; a name that ends in _ is a lambda's variable.


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def check(d: str) -> str:
    return f"(xxhash64({d}) & 65535L)"


def digests(text: str) -> str:
    """The set of a text's paragraph digests."""
    parts = f"filter(transform(split({text}, r'{CUT}'), p_ -> trim(p_)), p_ -> p_ <> '')"
    return f"array_distinct(transform({parts}, p_ -> {let('d_', 'shiftrightunsigned(xxhash64(p_), 16)', 'shiftleft(d_, 16) | ' + check('d_'))}))"


def slot(h: str, part: int, s: str) -> str:
    return f"cast((shiftright({h}, {BITS * part}) & ({s} - 1)) | {part << BITS} as int)"


def entries(of: str, sign: int, s: str, seed: str) -> str:
    """The three cells of each digest."""
    three = ", ".join(f"named_struct('slot', {slot('eh_', t, s)}, 'c', {sign}, 'x', ed_)" for t in range(3))
    return f"flatten(transform({of}, ed_ -> {let('eh_', f'xxhash64(ed_, {seed})', f'array({three})')}))"


def combined(cells: str) -> str:
    """Cells with equal slots added up, in order of slots; cells that come to nothing go. A run's first cell stands for it."""
    plus = lambda a, v: f"named_struct('slot', {v}.slot, 'c', {a}.c + {v}.c, 'x', {a}.x ^ {v}.x)"
    next_same = lambda k: f"(ci_ + {k} < size(ce_) AND ce_[ci_ + {k}].slot = cv_.slot)"
    longer = f"aggregate(filter(slice(ce_, ci_ + 1, size(ce_)), cw_ -> cw_.slot = cv_.slot), {NOTHING}, (ca_, cw_) -> {plus('ca_', 'cw_')})"
    runs = f"transform(ce_, (cv_, ci_) -> CASE WHEN ci_ > 0 AND ce_[ci_ - 1].slot = cv_.slot THEN {NOTHING} WHEN NOT {next_same(1)} THEN cv_ WHEN NOT {next_same(2)} THEN {plus('cv_', 'ce_[ci_ + 1]')} ELSE {longer} END)"
    return f"filter({let('ce_', f'sort_array({cells})', runs)}, cv_ -> cv_.c <> 0 OR cv_.x <> 0)"


def cells_for(n: str) -> str:
    """Cells in a part for ``n`` digests: a power of two."""
    return f"cast(pow(2.0D, least(ceil(log2(greatest(cast({n} as double) * {ROOM}, {LEAST}))), {BITS})) as int)"


def sketch(of: str, s: str, seed: str) -> str:
    return combined(entries(of, 1, s, seed))


def subtracted(left: str, right: str, s: str) -> str:
    """The difference of two sketches, both folded into parts of ``s`` cells."""
    fold = lambda cells, sign: f"transform({cells}, fv_ -> named_struct('slot', fv_.slot & (({s} - 1) | {3 << BITS}), 'c', {sign}fv_.c, 'x', fv_.x))"
    return combined(f"concat({fold(left, '')}, {fold(right, '-')})")


def peel(cells: str, s: str, seed: str) -> str:
    """struct(cells, plus array<long>, minus array<long>, stuck): the digests of a difference; cells that remain mean failure.

    A cell that holds one digest is done once that is known, so only the other cells have digests taken out of them."""
    own = f"(shiftright(xxhash64(pv_.x, {seed}), shiftright(pv_.slot, {BITS}) * {BITS}) & ({s} - 1)) = (pv_.slot & {(1 << BITS) - 1})"
    one = f"abs(pv_.c) = 1 AND {check('shiftrightunsigned(pv_.x, 16)')} = (pv_.x & 65535L) AND {own}"
    marked = f"transform(ps_.cells, pv_ -> named_struct('v', pv_, 'one', {one}))"
    side = lambda sign: f"array_distinct(transform(filter(pm_, pw_ -> pw_.one AND pw_.v.c = {sign}), pw_ -> pw_.v.x))"
    found = f"named_struct('plus', {side(1)}, 'minus', {side(-1)}, 'rest', transform(filter(pm_, pw_ -> NOT pw_.one), pw_ -> pw_.v))"
    gone = let("po_", "transform(pf_.rest, pv_ -> pv_.slot)", f"filter(concat({entries('pf_.plus', -1, s, seed)}, {entries('pf_.minus', 1, s, seed)}), pe_ -> array_contains(po_, pe_.slot))")
    none = "(size(pf_.plus) = 0 AND size(pf_.minus) = 0)"
    less = f"named_struct('cells', CASE WHEN {none} OR size(pf_.rest) = 0 THEN pf_.rest ELSE {combined(f'concat(pf_.rest, {gone})')} END, 'plus', concat(ps_.plus, pf_.plus), 'minus', concat(ps_.minus, pf_.minus), 'stuck', {none})"
    turn = let("pf_", let("pm_", marked, found), less)
    first = f"named_struct('cells', {cells}, 'plus', {LONGS}, 'minus', {LONGS}, 'stuck', false)"
    return f"aggregate(sequence(1, {ROUNDS}), {first}, (ps_, pk_) -> CASE WHEN ps_.stuck OR size(ps_.cells) = 0 THEN ps_ ELSE {turn} END)"


def difference(left: str, right: str, left_digests: str, right_digests: str) -> str:
    """struct(whole, plus array<long>, minus array<long>) of two fingerprints struct(n, s, cells): the digests that only
    one has. The digests of the texts are read only if the fingerprints are too small for one another."""
    kept = "'l', ds_.l, 'r', ds_.r, 'a', ds_.a, 'b', ds_.b"
    first = f"named_struct('whole', false, 'plus', {LONGS}, 'minus', {LONGS}, 'l', {left}, 'r', {right}, 'a', {left_digests}, 'b', {right_digests})"
    size = f"CASE WHEN dk_ = 0 THEN least(ds_.l.s, ds_.r.s) ELSE cast(least({cells_for('(ds_.l.n + ds_.r.n)')} * pow(4.0D, dk_), {1 << BITS}) as int) END"
    cells = f"CASE WHEN dk_ = 0 THEN {subtracted('ds_.l.cells', 'ds_.r.cells', 'dz_')} ELSE {subtracted(sketch('ds_.a', 'dz_', 'dk_'), sketch('ds_.b', 'dz_', 'dk_'), 'dz_')} END"
    # at least as many digests differ as one text has more; over two for each slot cannot be peeled
    hopeless = "dk_ = 0 AND abs(ds_.l.n - ds_.r.n) > 2 * dz_"
    outcome = f"named_struct('whole', size(dp_.cells) = 0 AND size(dp_.plus) - size(dp_.minus) = ds_.l.n - ds_.r.n, 'plus', dp_.plus, 'minus', dp_.minus, {kept})"
    attempt = let("dz_", size, f"CASE WHEN {hopeless} THEN ds_ ELSE {let('dp_', peel(cells, 'dz_', 'dk_'), outcome)} END")
    return let("dd_", f"aggregate(sequence(0, {TRIES - 1}), {first}, (ds_, dk_) -> CASE WHEN ds_.whole THEN ds_ ELSE {attempt} END)", "named_struct('whole', dd_.whole, 'plus', dd_.plus, 'minus', dd_.minus)")


def fingerprint(of: str) -> str:
    """struct(n int, s int, cells): the number of digests, the cells in a part, and the sketch."""
    return let("gd_", of, let("gs_", cells_for("size(gd_)"), f"named_struct('n', size(gd_), 's', gs_, 'cells', {sketch('gd_', 'gs_', '0')})"))


def printed(fp: str) -> str:
    """A fingerprint as text: n, s, and the cells by slot; a cell is its slot, count and sum in hexadecimal."""
    return f"concat_ws(';', cast({fp}.n as string), cast({fp}.s as string), array_join(transform({fp}.cells, v_ -> concat(hex(v_.slot), '.', hex(v_.c), '.', hex(v_.x))), ','))"


def likeness(fp: str, d: str) -> str:
    """The share of common digests, from a fingerprint's number and a difference; an error if no try was large enough."""
    alike = f"cast(coalesce(try_divide({fp}.n - size({d}.plus), {fp}.n + size({d}.minus)), 1.0D) as double)"
    return f"CASE WHEN {d}.whole THEN {alike} ELSE cast(raise_error('no sketch was large enough for two texts') as double) END"


def following(docs: DataFrame) -> DataFrame:
    """(key, half, next_key, rows): by falling id, the id that follows (after the last, the first), the most characters a row of this id replaces, and its rows.

    Ids are dealt by range and written; a window works within a range, and a table with a row per range joins the ends."""
    ids = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).alias("half"), F.count("*").alias("rows")).repartitionByRange(F.desc("key")).select("key", "half", "rows", F.spark_partition_id().alias("part"))
    ids = written(ids, "order")
    ends = ids.groupBy("part").agg(F.max("key").alias("top"))
    overall = ends.agg(F.max("top").alias("overall"))
    after = ends.select("part", F.lead("top").over(Window.orderBy("part")).alias("after"))
    inner = ids.withColumn("within", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    placed = inner.join(F.broadcast(after), "part")  # one row per range of ids
    return placed.join(F.broadcast(overall), how="cross").select("key", "half", F.coalesce("within", "after", "overall").alias("next_key"), "rows")


def versions(docs: DataFrame) -> DataFrame:
    """Each row's id (key), length and digests (a), the digest of its edited text, and the digests of the edited (b) and the next text (c)."""
    order = following(docs)
    total = order.agg(F.sum("rows").alias("total"))
    # fewer than HOT ids can each bear more than one in HOT rows
    hot = written(order.join(F.broadcast(total), how="cross").where(F.col("rows") * HOT > F.greatest("total", F.lit(HOT * HOT))).select("key", F.lit(True).alias("hot")), "hot")
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("text"), F.lit(SPREAD))).otherwise(0).cast("int")
    dealt = docs.join(F.broadcast(hot), "key", "left").withColumn("share", share).repartition("key", "share")  # read by both branches: the texts are shuffled once, as long as no lambda lies below
    lenders = order.select(F.col("next_key").alias("key"), F.col("key").alias("to"), "half")
    single = lenders.join(F.broadcast(hot), "key", "left_anti").withColumn("share", F.pmod("half", F.lit(1)).cast("int"))  # 0, but no constant that would filter one branch
    one = dealt.groupBy("key", "share").agg(F.min("text").alias("text")).join(single.hint("merge"), ["key", "share"])
    many = docs.join(F.broadcast(hot), "key").groupBy("key").agg(F.min("text").alias("text")).join(lenders.hint("merge"), "key")
    lent = one.select("to", "half", "text").union(many.select("to", "half", "text"))
    gifts = lent.select(F.col("to").alias("key"), F.substr("text", F.lit(1), F.col("half").cast("int")).alias("head"), F.expr(digests("text")).alias("c"))
    shares = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    gifts = gifts.join(F.broadcast(hot), "key", "left").select("key", "head", "c", F.explode(shares).alias("share"))
    own = dealt.drop("hot").join(gifts.hint("merge"), ["key", "share"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("head", F.lit(1), half)))
    return edited.select("key", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.expr(digests("text")).alias("a"), F.expr(digests("edited")).alias("b"), "c")


def compare_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs`` (doc_id, text).

    The edited text has its last half replaced by the beginning, as long or whole, of the next text by falling id."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"))
    with_prints = versions(rows).withColumns({f"f{x}": F.expr(fingerprint(x)) for x in "abc"})
    near = lambda x: F.expr(let("nd_", difference("fa", f"f{x}", "a", x), likeness("fa", "nd_")))
    doc_id = F.nullif("key", F.lit(NULL_ID)).cast(docs.schema["doc_id"].dataType)
    return with_prints.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", F.expr(printed("fa")).alias("fingerprint"), F.expr(printed("fb")).alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"))


def op5_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how near it is to its edited text's and the next document's."""
    return compare_versions(documents(spark, sf_dir).select("doc_id", "text"))
