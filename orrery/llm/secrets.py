"""Secret scan: base patterns plus a battery of randomness tests, in built-in functions only.

Each text gives spans ``(start, end, kind)`` in code points, end exclusive. The base kinds are leftmost,
non-overlapping matches of a pattern. The added kind, ``random``, holds strings that look drawn at random
from the alphabet of the encoding inferred for them. Three tests hold a string against uniform draws from that alphabet:

* chi-squared: repeats of a symbol, against those that equally likely symbols give;
* runs: changes of class (upper, lower, digit, sign) between neighbours, against the alphabet's own rate;
* serial correlation of neighbours' places in the alphabet (counters and alphabets depend on each other).

The root of their sum of squares is small for random strings and grows with length for structured ones. The null hypothesis
is *structured text*: the p value is the share of structured strings of this encoding and length with a root as small, by a
line through logarithms (``NULL``, fitted by ``secret_null``). Within a document, the p values are weighted by length (longer
strings carry more evidence), and the Benjamini-Hochberg step-up at rate ``fdr`` says which strings count.

Null text counts as empty, an empty text has no spans, and every row gives one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents, unused

# The base patterns and the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run is matched whole, so shorter runs need not be listed to be dropped
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# By encoding, its alphabet's order, its number of equally likely symbols, and its rate of class changes.
ENCODINGS = {
    "hex": ("0123456789abcdef", 16.0, 0.46875),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32.0, 0.3047),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 64.0, 0.6445),
}
# Fixed values, fitted by secret_null: the mean of the logarithm under the null, as (constant, slope) in the length's logarithm,
# and its spread, likewise; the spread of longer strings is that of LONGEST symbols.
LONGEST = 96
NULL = {
    "hex": (0.4941, 0.7435, 0.6534, -0.0368),
    "base32": (-1.2699, 0.8334, 0.0091, 0.039),
    "base64": (0.4899, 0.5396, 0.863, -0.1499),
}
SPAN = "array<struct<start:int,kind:int,end:int,hit:string>>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with value computed once: a let-binding for expressions in lambdas."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's matches whose ``group`` has ``least`` characters or more."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(state["gaps"][i])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(state["hits"][i])).alias("end"), state["hits"][i].alias("hit"))
        out = F.when(F.length(state["tested"][i]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((start + F.length(state["hits"][i])).alias("at"), state["gaps"].alias("gaps"), state["hits"].alias("hits"), state["tested"].alias("tested"), out.alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    first = F.struct(F.lit(0).alias("at"), gaps.alias("gaps"), hits.alias("hits"), tested.alias("tested"), none.alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), first, step)["out"]
    return F.when(F.size(hits) > 0, walked).otherwise(none)


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by a rational approximation of erfc (relative error below 2e-7)."""
    # The coefficients of the approximation.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.5 * x)
        return bind(t, lambda t: t * F.exp(-x * x + reduce(lambda acc, k: acc * t + k, reversed(c[:-1]), F.lit(c[-1]))))

    return bind(z, lambda z: bind(F.abs(z) / F.sqrt(F.lit(2.0)), lambda x: F.when(z < 0, tail(x) / 2).otherwise(1 - tail(x) / 2)))


def encoding(hit: Column) -> Column:
    """hex, base32 or base64; null for strings that are all digits, or in which no letter occurs."""
    return (
        F.when(~hit.rlike("[A-Za-z]"), F.lit(None).cast("string"))
        .when(hit.rlike("^(?=.*[0-9])([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(hit.rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
        .otherwise(F.lit("base64"))
    )


def statistics(hit: Column, name: str) -> Column:
    """``n``, and the three tests of a string against uniform draws of the encoding ``name``: ``even``, ``runs``, ``serial``."""
    alphabet, k, rate = ENCODINGS[name]
    body = F.lower(hit) if name == "hex" else F.rtrim(hit, F.lit("="))
    n = F.length(body).cast("double")
    counts = F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"))
    repeats = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * (c - 1))
    even = F.try_divide(repeats - n * (n - 1) / k, F.sqrt(2 * n * (n - 1) / k * (1 - 1 / k)))
    classes = reduce(lambda text, x: F.regexp_replace(text, *x), (("[A-Z]+", "\u0001"), ("[a-z]+", "\u0002"), ("[0-9]+", "\u0003"), (r"[+/_=-]+", "\u0004")), body)
    changes = F.length(classes).cast("double") - 1
    runs = F.try_divide(F.abs(changes - rate * (n - 1)), F.sqrt(rate * (1 - rate) * (n - 1)))
    values = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))

    def correlation(x: Column) -> Column:
        size = F.size(x).cast("double")
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / size
        around = bind(mean, lambda m: F.transform(x, lambda v: v - m))
        return bind(around, lambda d: F.try_divide(
            F.aggregate(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v),
            F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v)) * F.sqrt(size))

    serial = bind(F.filter(values, lambda v: v > 0), lambda x: F.when(F.size(x) > 1, correlation(x)))
    constant = F.lit(9.0)  # one symbol throughout has no correlation, and is no random string
    return F.struct(n.alias("n"), F.coalesce(even, constant).alias("even"), F.coalesce(runs, constant).alias("runs"), F.abs(F.coalesce(serial, constant)).alias("serial"))


def distance(x: Column) -> Column:
    """The three tests as one: how far a string is from uniform draws. Fewer repeats than expected are no distance."""
    return F.sqrt(0.01 + F.greatest(x["even"], F.lit(0.0)) * F.greatest(x["even"], F.lit(0.0)) + x["runs"] * x["runs"] + x["serial"] * x["serial"])


def battery(hit: Column) -> Column:
    """The combined p value of a string under the null hypothesis that it is structured text; 1 where no encoding fits."""

    def p_value(name: str) -> Column:
        at, slope, base, up = NULL[name]
        return bind(statistics(hit, name), lambda x: normal_below(
            (F.log(distance(x)) - at - slope * F.log(x["n"])) / (base + up * F.least(F.log(x["n"]), F.log(F.lit(float(LONGEST)))))))

    return bind(encoding(hit), lambda e: reduce(lambda rest, name: F.when(e == name, p_value(name)).otherwise(rest), ENCODINGS, F.lit(1.0)))


def discovered(tests: Column, fdr: float) -> Column:
    """Of ``array<struct<start,end,p>>``, those that the length-weighted step-up procedure rejects."""
    total = F.aggregate(tests, F.lit(0.0), lambda s, t: s + (t["end"] - t["start"]))
    m = F.size(tests)
    scored = F.array_sort(F.transform(tests, lambda t: F.struct((t["p"] * total / (m * (t["end"] - t["start"]))).alias("q"), t["start"].alias("start"), t["end"].alias("end"))))
    return bind(scored, lambda s: bind(
        F.array_max(F.transform(s, lambda t, i: F.when(t["q"] <= fdr * (i + 1) / F.size(s), i + 1).otherwise(0))),
        lambda k: F.slice(s, 1, F.coalesce(k, F.lit(0)))))


def scan(docs: DataFrame, text: str = "text", fdr: float = 1e-3, out: str = "secret_spans") -> DataFrame:
    """Adds ``out``: ``array<struct<start int, kind int, end int>>``, by start and then kind (an index in KINDS).

    Null and empty texts have no spans. ``fdr`` is the false-discovery rate of the added kind in a document.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(located(whole, ASSIGN, 0, group=2, least=8), located(whole, ACCESS, 1, least=16), located(whole, HEX, 2))
    shape = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    first, more = unused([*docs.columns, out], "_base", "_more")
    found = docs.withColumn(first, base).withColumn(more, located(whole, CANDIDATE, 3))
    fresh = F.filter(more, lambda s: ~F.exists(first, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    tests = F.transform(fresh, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["hit"]).alias("p")))
    added = F.when(F.size(more) > 0, bind(tests, lambda t: F.transform(discovered(t, fdr), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))))
    spans = F.array_sort(F.concat(shape(F.col(first)), F.coalesce(added, F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))))
    return found.withColumn(out, spans).drop(first, more)


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", fdr: float = 1e-3) -> DataFrame:
    """Every secret in ``text`` becomes ``[kind]``; touching or overlapping spans become one. Other rows stay as they are, nulls too."""
    cols = docs.columns
    (spans,) = unused(cols, "_spans")

    def step(state: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit("]"))
        kept = F.concat(state["out"], F.substr(F.col(text), state["at"] + 1, s["start"] - state["at"]), mark)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], kept).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.when(F.size(spans) > 0, bind(done, lambda d: F.concat(d["out"], F.substr(F.col(text), d["at"] + 1, F.length(text))))).otherwise(F.col(text))
    return scan(docs, text, fdr, spans).withColumn(text, clean).select(*cols)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts and digest of the base kinds, and all spans."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("secret_spans")).alias("spans"),
    )
