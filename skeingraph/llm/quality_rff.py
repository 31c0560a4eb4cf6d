"""Quality classifier: random Fourier features of document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

A document becomes a short vector of statistics of its whole text. cos(x W + c) with random W and c
approximates a Gaussian kernel on the standardised vectors; every partition of the learning rows
sums Z'Z and Z'y, the driver adds a few of these sums and solves for the ridge weights. A part of
the learning rows that the weights haven't seen gives an isotonic curve from raw scores to
probabilities (a touch of the raw score is left in, so that order is strict where the curve is flat).

Learning takes at most about `per_class` labelled rows of each class, chosen by a hash of the id;
held-out ids (crc32 of the id, modulo 4, is 2) never. Scoring is one pass over all whole texts.

Defined results: null text counts as empty, whose statistics are 0, and has a score too; if a class
is missing from the labels, every score is the share of label 1 (0.5 without labels); repeated rows
give repeated results, a label repeated for an id counts each time; only the named columns are read.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.chars import BANG, DIGIT, LETTER, PIPE, SPACE, STOP, SYMBOL, UPPER, class_table, codes
from skeingraph.llm.language_id import held_out
from skeingraph.runtime import columns_of, map_columns, stored

FEATURES = 18
WIDTH = 256
GAMMA = 0.15
RIDGE = 1e-3
SEED = 11
PARTS = 8
MASKS = np.array([[bool(i & m) for i in range(256)] for m in (LETTER, UPPER, DIGIT, SPACE, SYMBOL, BANG, PIPE, STOP)], float)


def statistics(text: str | None) -> list[float]:
    """The document's vector; whole text, in pieces of a million characters."""
    text = text or ""
    counts = np.zeros(256)
    for lo in range(0, len(text), 1 << 20):
        counts += np.bincount(class_table()[codes(text[lo : lo + (1 << 20)])], minlength=256)
    letters, upper, digits, spaces, symbols, bangs, pipes, stops = (MASKS @ counts).tolist()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, nw, nl = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    distinct = len(set(words))
    same = sum(map(operator.eq, words, words[1:]))
    again = sum(map(operator.eq, words, words[2:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), min(sum(map(len, words)) / nw, 30), letters / n, upper / max(letters, 1), digits / n, spaces / n, min(symbols / nw, 4), min(bangs / nw, 4), min(pipes / nw, 2),
        min(stops / nw, 2), distinct / nw, np.log1p(distinct) / np.log(nw + 2), same / nw, again / nw, 1 - len(set(lines)) / nl, np.log1p(nw / nl), np.log1p(nl),
    ]


def fourier() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, np.sqrt(2 * GAMMA), (FEATURES, WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH)


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, with a column of ones."""
    w, c = fourier()
    z = np.sqrt(2 / WIDTH) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + c)
    return np.column_stack([np.ones(len(x)), z])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the nondecreasing step curve of least squares."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, weight
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of rows (y, x), summed in each partition and then over the few partitions."""
    schema = T.StructType([T.StructField("zz", T.BinaryType()), T.StructField("zy", T.BinaryType())])

    def start():
        return lambda ys, xs: ([(z := expand(np.array(xs), mean, scale)).T.dot(z).tobytes()], [(z.T @ np.array(ys, float)).tobytes()])

    zz, zy = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1)
    for r in map_columns(rows.select("y", "x").repartition(PARTS), schema, start, rows=1 << 20).toLocalIterator():
        zz += np.frombuffer(r["zz"]).reshape(zz.shape)
        zy += np.frombuffer(r["zy"])
    return zz, zy


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    known = columns_of(labels, id_col, label_col).toDF("id", "y").where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"flat": float(next(iter(n))) if n else 0.5}
    share = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, per_class / v)))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / F.lit(float(1 << 24)) < share[F.col("y")])
    texts = columns_of(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(drawn), "id")  # at most about 2 * per_class ids
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    turn = (F.crc32(F.col("id").cast("string").cast("binary")) % 4).alias("turn")
    each = map_columns(texts.select("id", F.col("y").cast("long"), turn, "text"), schema, lambda: lambda ids, ys, turns, ts: (ids, ys, turns, [list(map(float, statistics(t))) for t in ts]))
    rows = stored(each.groupBy("id", "y", "turn").agg(F.min("x").alias("x")))  # one row for each drawn id, however often it repeats
    learn = rows.where("turn <> 3")
    got = learn.select(*(f(F.col("x")[i]).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(FEATURES))).first()
    if got["m0"] is None:
        return {"flat": 0.5}
    mean, scale = (np.array([got[f"{k}{i}"] for i in range(FEATURES)]) for k in "ms")
    scale = np.where(scale > 1e-9, scale, 1.0)
    zz, zy = normal_equations(learn, mean, scale)
    beta = np.linalg.solve(zz + RIDGE * zz[0, 0] * np.eye(WIDTH + 1) / WIDTH, zy)
    model = {"mean": mean, "scale": scale, "beta": beta, "curve": None}
    kept = sorted((r["y"], list(r["x"])) for r in rows.where("turn = 3").select("y", "x").collect())  # within the bound of the drawn rows
    if len({y for y, _ in kept}) == 2:
        model["curve"] = isotonic(expand(np.array([x for _, x in kept]), mean, scale) @ beta, np.array([y for y, _ in kept], float))
    return model


def score_texts(model: dict, texts: list[str | None]) -> list[float]:
    if "flat" in model:
        return [model["flat"]] * len(texts)
    if not texts:
        return []
    raw = np.clip(expand(np.array([statistics(t) for t in texts]), model["mean"], model["scale"]) @ model["beta"], -0.5, 1.5)
    p = np.interp(raw, *model["curve"]) if model["curve"] else np.clip(raw, 0, 1)
    return np.clip(0.998 * p + 0.001 * (raw + 0.5), 0, 1).tolist()


def score(docs: DataFrame, model: dict, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(keys, texts):
        s = score_texts(model, texts)
        return keys, s, [int(x >= threshold) for x in s]

    return map_columns(columns_of(docs, id_col, text_col), schema, lambda: run)
