"""Fits the null hypothesis of the secret scan: how structured strings look to its three tests.

``python -m orrery.llm.secret_null`` prints the fixed values of ``secrets.NULL``, and the rates they give on strings that had
no part in the fit. Structured strings come from the names and paths of Python's own library, alone and joined to paths,
compounds, constants and versions, and from dates, counters and padded numbers; random ones are drawn by encoding. Only
their statistics, as the scan's own columns give them, are used, and nothing of the input tables.
"""

from __future__ import annotations

import re
import sysconfig
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets

BANDS = 10
LENGTHS = (20, 24, 32, 48, 64, 96)
BOUNDS = (20, 28, 40, 64, 1000)
#: The share of structured strings that the fitted tail gives the same depth as a normal one.
DEPTH, SHARE = 3.09, 1e-3


def names(limit: int = 40_000) -> list[str]:
    """Words of the identifiers in Python's own modules, in order of their first use."""
    met: dict[str, None] = {}
    for path in sorted(Path(sysconfig.get_path("stdlib")).glob("*/*.py"))[:600]:
        if "test" not in str(path) and "site-packages" not in str(path):
            met.update(dict.fromkeys(re.findall(r"(?:def|class|import|self\.)\s*([A-Za-z_]\w+)", path.read_text("utf-8", "ignore"))))
    return list(met)[:limit]


def structured(rows: int, seed: int) -> list[str]:
    """Strings of 20 characters or more that people write: names, paths, compounds, constants, dates, padded numbers."""
    draw, own = np.random.default_rng(seed), names()
    words = sorted({w.lower() for x in own for w in re.findall("[A-Za-z][a-z]{2,}", x)})
    few = sorted({w for w in words if re.fullmatch("[a-f]+", w)}) + ["face", "bead", "added", "decade"]
    pick = lambda k, of=words: [of[i] for i in draw.integers(0, len(of), k)]
    number = lambda: str(draw.integers(0, 10 ** int(draw.integers(1, 5))))
    shapes = (
        lambda k: "/" * int(draw.integers(0, 2)) + "/".join(pick(k)),
        lambda k: "/".join(w + (number() if draw.random() < 0.3 else "") for w in pick(k)),
        lambda k: "/".join(pick(k, own)),
        lambda k: "-".join(pick(k)),
        lambda k: "_".join(pick(k)) + "_" + number(),
        lambda k: "_".join(pick(k)).upper(),
        lambda k: "".join(w.title() for w in pick(k)),
        lambda k: pick(1)[0] + "".join(w.title() for w in pick(k)) + number(),
        lambda k: "".join(pick(k)),
        lambda k: "".join(pick(k)).upper(),
        lambda k: "".join(pick(k)).upper() + "".join(map(str, draw.integers(2, 8, int(draw.integers(0, 5))))),
        lambda k: f"{'-'.join(pick(k))}-{draw.integers(0, 9)}-{draw.integers(0, 30)}-{draw.integers(0, 30)}",
        lambda k: f"{pick(1)[0]}/{draw.integers(1990, 2030)}/{draw.integers(1, 12):02}/{draw.integers(1, 28):02}/{'-'.join(pick(k))}",
        lambda k: f"{pick(1)[0]}-{draw.integers(1990, 2030)}{draw.integers(1, 12):02}{draw.integers(1, 28):02}T{draw.integers(0, 24):02}{draw.integers(0, 60):02}{draw.integers(0, 60):02}Z",
        lambda k: f"{pick(1)[0].upper()[:3]}-{draw.integers(0, 10**9):0{18 + k}}",
        lambda k: f"{int(draw.integers(0, 16**6)):0{20 + k}x}",
        lambda k: "".join(w + "0" * int(draw.integers(0, 6)) for w in pick(3 * k, few)) + number(),
        lambda k: (f"{int(draw.integers(0, 16**4)):04x}" * 16)[: 20 + 4 * k],
        lambda k: ("0123456789abcdef" * 8)[int(draw.integers(0, 16)) :][: 20 + 4 * k],
        lambda k: f"{draw.integers(1990, 2030)}{draw.integers(1, 12):02}{draw.integers(1, 28):02}{draw.integers(0, 10**6):012}{'abcdef'[int(draw.integers(0, 6))]}",
        lambda k: "".join(chr(65 + (i + k) % 26) + chr(97 + (i + k) % 26) for i in range(8 + 2 * k)),
        lambda k: "-".join(chr(65 + i % 26) + str(i % 10) for i in range(k, 2 * k + 7)),
    )
    out = (shapes[i % len(shapes)](int(draw.integers(2, 10))) for i in range(rows))
    return sorted({x for x in out if re.fullmatch(secrets.CANDIDATE, x)})


def drawn(rows: int, seed: int) -> list[str]:
    """Random strings, by encoding and length."""
    draw = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", secrets.ENCODINGS["base32"][0], secrets.ENCODINGS["base64"][0][:64]]
    return ["".join(np.array(list(alphabets[i % 3]))[draw.integers(0, len(alphabets[i % 3]), LENGTHS[i // 3 % len(LENGTHS)])]) for i in range(rows)]


def measured(spark: SparkSession, strings: list[str]) -> pd.DataFrame:
    df: DataFrame = spark.createDataFrame(pd.DataFrame({"hit": strings})).repartition(8)
    e = secrets.encoding(F.col("hit"))
    x = F.coalesce(*[F.when(e == name, secrets.statistics(F.col("hit"), name)) for name in secrets.ENCODINGS])
    return df.select("hit", e.alias("encoding"), x.alias("x")).where("x is not null").select("hit", "encoding", F.log("x.n").alias("n"), F.log(secrets.distance(F.col("x"))).alias("t")).toPandas()


def fitted(n: np.ndarray, t: np.ndarray) -> tuple[float, ...]:
    """The null's mean as a line in ``n``, and the spread that puts the lower tail's share where a normal one has it, likewise
    a line through bands of length, raised until no band has more."""
    slope, at = np.polyfit(n, t, 1)
    cuts = np.quantile(n, np.linspace(0, 1, BANDS + 1))
    within = [(n >= a) & (n <= b) for a, b in zip(cuts, cuts[1:])]
    mid = np.array([np.minimum(n[own], np.log(secrets.LONGEST)).mean() for own in within])
    wide = np.array([-np.quantile((t - at - slope * n)[own], SHARE) / DEPTH for own in within])
    up, base = np.polyfit(mid, wide, 1)
    base += max(0.0, float(np.max(wide - base - up * mid)))
    return tuple(round(float(v), 4) for v in (at, slope, base, up))


def share(frame: pd.DataFrame, null: tuple[float, ...]) -> float:
    """The share with p <= SHARE."""
    at, slope, base, up = null
    return float((((frame["t"] - at - slope * frame["n"]) / (base + up * np.minimum(frame["n"], np.log(secrets.LONGEST)))) <= -DEPTH).mean())


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    plain, random = measured(spark, structured(200_000, 1)), measured(spark, drawn(9_000, 2))
    held = plain["hit"].map(lambda x: zlib.crc32(x.encode()) % 2 == 0)
    for name in secrets.ENCODINGS:
        a, r = plain["encoding"] == name, random["encoding"] == name
        null = fitted(plain[a & ~held]["n"].to_numpy(), plain[a & ~held]["t"].to_numpy())
        print(f'    "{name}": {null},')
        for low, high in zip(BOUNDS, BOUNDS[1:]):
            own = plain[a & held & plain["hit"].str.len().between(low, high - 1)]
            print(f"        # {len(own)} held-out structured strings of {low} to {high - 1}: share with p <= {SHARE}: {share(own, null):.5f}")
        for k in LENGTHS:
            print(f"        # random strings of {k}: share with p <= {SHARE}: {share(random[r & (random['hit'].str.len() == k)], null):.3f}")


if __name__ == "__main__":
    main()
