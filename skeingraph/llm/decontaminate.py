"""Benchmark decontamination: size-partitioned MinHash containment search, checked exactly.

Items are partitioned by their number of distinct shingles into classes of a factor of two. For a
class of at most S shingles a document is searched as windows of 2 S shingles that move on by S,
so a passage of the item's length lies wholly in one, and the Jaccard similarity of item and window
stays above a bound that doesn't depend on the document's length. Single-row MinHash bands, as many
as the bound needs for the target recall, give candidates. Items of up to `FEW` shingles are below
that bound: they are looked up by their shingles. For each candidate the share of the item's
distinct shingles that the whole document has is then counted on the words themselves.

The benchmark is the stated query set: it is taken in blocks of at most `block` items, each
broadcast (about 8 KB an item) and held against all documents in one pass without a shuffle.

Defined results: pairs (document, item) with containment of at least the threshold, one for each
pair of ids (the best, if ids repeat); null or empty texts, of either side, contain nothing and are
contained in nothing; an item of fewer than five words is found in documents of just these words,
and with `short_anywhere` wherever they stand in a row (off by default: a benchmark answer of a word
or two would condemn most documents); empty tables give no pairs; only the named columns are read;
id_col and item_col must differ.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.shingles import SIZE, permutations, shingle_hashes, words_of
from skeingraph.runtime import columns_of, keep_rows, map_columns

THRESHOLD = 0.8
RECALL = 0.99999
BLOCK = 10_000
SEED = 77
#: Items of up to so many shingles are found by these, without windows; larger ones have half of the smallest class's size at least.
FEW = 3


def bands(threshold: float, recall: float) -> int:
    """Bands for the lowest similarity of an item of a class with a window that holds it: the
    smallest item has S/2 shingles, of which the window of 2 S has the threshold's share."""
    low = threshold * 0.5 / (2 + (1 - threshold) * 0.5)
    return math.ceil(math.log(1 - recall) / math.log(1 - low))


class Search:
    """What the executors hold of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float = THRESHOLD, recall: float = RECALL, short_anywhere: bool = False) -> None:
        self.threshold = threshold
        self.a, self.b = permutations(bands(threshold, recall), SEED)
        self.items: list[tuple[object, np.ndarray, list[str]]] = []
        self.few: dict[int, list[int]] = defaultdict(list)  # shingle -> items of few shingles
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # words -> their hash -> items of fewer words than a shingle
        self.found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # class -> MinHash value -> items
        for key, text in items:
            words = words_of(text)
            h = np.unique(shingle_hashes(words))
            if not len(h):
                continue
            if short_anywhere and len(words) < SIZE:
                self.short[len(words)][h.tolist()[0]].append(len(self.items))
            elif len(h) <= FEW:
                for v in h.tolist():
                    self.few[v].append(len(self.items))
            else:
                values = (h[:, None] * self.a + self.b).min(axis=0)
                at = self.found[max(3, int(len(h) - 1).bit_length())]
                for v in set(values.tolist()):
                    at[v].append(len(self.items))
            self.items.append((key, h, words))
        self.found = {c: dict(x) for c, x in sorted(self.found.items())}
        self.masks = {}
        for c, x in [*self.found.items(), (0, self.few)]:  # a quick look-up by the first bits
            self.masks[c] = np.zeros(1 << 18, bool)
            self.masks[c][(np.fromiter(x, np.uint64, len(x)) >> np.uint64(46)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of their class, or a shingle if they have few."""
        out: set[int] = set()
        if self.few:
            for v in h[self.masks[0][(h >> np.uint64(46)).astype(np.int64)]].tolist():
                out.update(self.few.get(v, ()))
        if not len(h) or not self.found:
            return out
        size, minima = 1 << min(self.found), None
        for lo in range(0, len(h), 512 * size):
            part = h[lo : lo + 512 * size]
            m = np.minimum.reduceat(part[:, None] * self.a + self.b, np.arange(0, len(part), size), axis=0)
            minima = m if minima is None else np.concatenate([minima, m])
        for c, values in self.found.items():
            while size < 1 << c:
                minima = np.minimum.reduceat(minima, np.arange(0, len(minima), 2), axis=0)
                size *= 2
            windows = np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima
            for v in windows[self.masks[c][(windows >> np.uint64(46)).astype(np.int64)]].tolist():
                out.update(values.get(v, ()))
        return out

    def hits(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item's id, its distinct shingles that the text has, its distinct shingles)."""
        words = words_of(text)
        h = shingle_hashes(words)
        out = []
        for i in sorted(self.candidates(h)):
            key, wanted, item_words = self.items[i]
            at = np.flatnonzero(np.isin(h, wanted)).tolist()
            size = min(SIZE, len(item_words))
            own = {tuple(item_words[k : k + size]) for k in range(len(item_words) - size + 1)}
            n = len(own & {tuple(words[k : k + SIZE]) for k in at})
            if n >= self.threshold * len(own) - 1e-9:
                out.append((key, n, len(own)))
        for size, items in self.short.items():
            runs = shingle_hashes(words, size) if len(words) >= size else h[:0]
            for at in np.flatnonzero(np.isin(runs, np.fromiter(items, np.uint64, len(items)))).tolist():
                out += [(self.items[i][0], 1, 1) for i in items[int(runs[at])] if self.items[i][2] == words[at : at + size]]
        return list(dict.fromkeys(out)) if self.short else out


def blocks(items: DataFrame, id_col: str, text_col: str, block: int):
    """The items in lists of about block at most."""
    rows = columns_of(items, id_col, text_col).toDF("id", "text").where(F.length("text") > 0)
    n = max(1, math.ceil(rows.count() / block))
    for k in range(n):
        yield sorted(((r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()), key=repr)


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, short_anywhere: bool = False) -> DataFrame:
    """(id, item id, n_shared, n_item, containment) of every pair at or above the threshold."""
    if id_col == item_col:
        raise ValueError("id_col and item_col must differ, as both are columns of the result")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, items.schema[item_col].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])
    texts = columns_of(docs, id_col, text_col)

    def one_block(part: list) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(part)

        def start():
            s = Search(held.value, threshold, recall, short_anywhere)

            def run(keys, texts):
                out = [(k, *hit) for k, t in zip(keys, texts, strict=True) for hit in s.hits(t)]
                return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [], [])

            return run

        return map_columns(texts, schema, start)

    found = reduce(DataFrame.unionAll, [one_block(p) for p in blocks(items, item_col, item_text_col, block)])
    best = found.groupBy(id_col, item_col).agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return best.select(id_col, item_col, "m.n_shared", "m.n_item", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, short_anywhere: bool = False) -> DataFrame:
    """The rows, with all columns, that contain no item."""
    for part in blocks(items, item_col, item_text_col, block):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def start(held=held):
            s = Search(held.value, threshold, recall, short_anywhere)
            return lambda texts: [not s.hits(t) for t in texts]

        docs = keep_rows(docs, [text_col], start)
    return docs
