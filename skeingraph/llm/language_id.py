"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram abc becomes rot2(a) * rot1(b) * c: each
letter's vector is permuted by its place and the three are bound by elementwise product. A
document's vector bundles (sums) those of its trigrams; a language's prototype bundles the
normalised vectors of its learning documents. The prediction is the prototype of highest cosine.

Fitting reads whole texts of all learning documents, and so does the least score, whose quantile is
exact; prediction reads those of all documents; each is one pass without a shuffle of texts. What the
driver holds is a vector for each language.

Defined results: null text, empty text and text without a letter give `und` with score 0; so does
everything if nothing can be learned; ties go to the first language in order; repeated rows give
repeated results; only the named columns are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.chars import codes
from skeingraph.runtime import columns_of, keep_rows, map_columns, quantile

DIM = 512
LETTERS = 128
SEED = 20_240_511
#: Code points counted at a time; longer texts go through in several pieces.
PIECE = 1 << 20
UNKNOWN = "und"
SHORT = 20
MAX_LANGS = 1000
#: Unit vectors are summed as whole multiples of 1 / FIXED.
FIXED = 1 << 30


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@cache
def letter_table() -> np.ndarray:
    """A number for each code point: 0 for what is no letter, else one below LETTERS by its lower
    case; a-z and the letters of Latin-1 have their own, others share by hash."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low - 0xDF if 0xDF <= low <= 0xFF else 60 + (low * 2654435761 >> 7) % (LETTERS - 60)
    return table


@cache
def vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters' vectors as they stand first, second and third in a trigram."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIM))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of letters (runs of other characters count as one blank) and their counts."""
    found, table = [], letter_table()
    last = np.zeros(1, np.uint8)  # a blank stands before the text and after it
    for lo in range(0, len(text), PIECE):
        ids = table[codes(text[lo : lo + PIECE])]
        ids = np.concatenate([last, ids, np.zeros(int(lo + PIECE >= len(text)), np.uint8)])
        ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])].astype(np.int32)
        last = ids[-2:].astype(np.uint8)
        grams = np.sort(ids[:-2] * (LETTERS * LETTERS) + ids[1:-1] * LETTERS + ids[2:])
        if len(grams):
            at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            found.append((grams[at], np.diff(np.append(at, len(grams)))))
    if len(found) > 1:
        keys, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in found]))
    return found[0] if found else (np.zeros(0, np.int32), np.zeros(0))


def document_vector(text: str | None) -> np.ndarray | None:
    """The bundled trigrams, of length 1; None if there is no letter."""
    grams, counts = trigrams(text or "")
    if not grams.any():
        return None
    first, second, third = vectors()
    total = np.zeros(DIM, np.float32)
    for lo in range(0, len(grams), 4096):
        g = grams[lo : lo + 4096]
        bound = first[g >> 14] * second[g >> 7 & 127] * third[g & 127]
        total += counts[lo : lo + 4096].astype(np.float32) @ bound.astype(np.float32)
    return total / max(np.linalg.norm(total), 1e-9)


def learning(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame | None:
    """(id, text, lang) of the learning documents: all rows with a language that are not held out, of
    the `MAX_LANGS` most frequent languages."""
    d = columns_of(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    langs = [r["lang"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    if not langs:
        return None
    return d if len(langs) < MAX_LANGS else d.where(F.col("lang").isin(*langs))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from all rows with a language that are not held out. Sums are of whole numbers, so that
    their order, and how the rows are dealt to tasks, changes nothing."""
    found = learning(docs, id_col, text_col, lang_col)
    if found is None:
        return {}
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("part", T.ArrayType(T.LongType()))])

    def start():
        def run(texts, langs):
            sums: dict[str, np.ndarray] = {}
            for t, lang in zip(texts, langs, strict=True):
                v = document_vector(t)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * FIXED).astype(np.int64)
            return list(sums), [v.tolist() for v in sums.values()]

        return run

    parts = map_columns(found.select("text", "lang"), schema, start, 4096)
    total = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()  # DIM rows for each language
    out: dict[str, np.ndarray] = {}
    for r in total:
        out.setdefault(r["lang"], np.zeros(DIM))[r["at"]] = r["x"]
    return {k: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for k, v in sorted(out.items())}


def judge(model: dict[str, np.ndarray]):
    """From a text to its language and the cosine with that language's prototype (0 at least)."""
    names = list(model)
    matrix = np.stack(list(model.values())) if model else None

    def one(text: str | None) -> tuple[str, float]:
        v = document_vector(text) if model else None
        if v is None:
            return UNKNOWN, 0.0
        scores = matrix @ v
        best = int(scores.argmax())
        return names[best], float(min(1.0, max(0.0, scores[best])))

    return one


def predict(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def start():
        one = judge(model)
        return lambda keys, texts: (keys, *(map(list, zip(*map(one, texts), strict=True)) if keys else ([], [])))

    return map_columns(columns_of(docs, id_col, text_col), schema, start)


def least_score(docs: DataFrame, model: dict[str, np.ndarray], share: float = 0.001, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """Half of the cosine that all but this share of all learning documents with letters reach; texts
    of a language that was not learned, and junk of letters, are below it."""
    found = learning(docs, id_col, text_col, lang_col) if model else None
    if found is None:
        return 0.0
    scores = predict(found, model, "id", "text").where(F.col("lang_pred") != UNKNOWN).select("score")
    return quantile(scores, "score", share) / 2


def keep_known(docs: DataFrame, model: dict[str, np.ndarray], languages: set[str] | None = None, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose language is known, is one of `languages` (None: any) and has
    min_score; texts of fewer than `SHORT` characters need no score, as a word or two say too little."""

    def start():
        one = judge(model)

        def ok(text):
            lang, score = one(text)
            return lang != UNKNOWN and (languages is None or lang in languages) and (score >= min_score or len(text) < SHORT)

        return lambda texts: list(map(ok, texts))

    return keep_rows(docs, [text_col], start)
