"""Quality rules over lines: a linear-chain conditional random field marks each line as content or
boilerplate, Viterbi decoding finds the best sequence, and a document stays if enough of its
characters are content. Plain base rules (too few words, too many repeated words) come before.

The weights are fitted on a bounded sample of labelled documents (`per_class` of each quality
label, chosen by a hash of the id, held-out ids left out), from labels of lines: those of a document
begin with its label, but lines that repeat an earlier one, are full of symbols or state a licence
are boilerplate in any document. Then lines are latent: in each of `ROUNDS` rounds those that the
weights clearly put on the other side change it, the surest first, as long as more than half of the
document's characters keep the document's label. The field learns from spliced sequences: two
documents of different labels are cut into runs of lines, `RUN` on average, that take turns; so the
transitions stand for runs of lines and not for whole documents. Gradients are summed by
forward-backward over all sequences at once; scoring is one pass over whole texts.

Defined results: null and empty texts have no words, fail the base rules and are not kept; without
labelled rows of both classes every line counts as content; lines without a word have no label and
no weight; repeated rows give repeated results; only the named columns are read.
"""

from __future__ import annotations

import operator
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.chars import BANG, DIGIT, LETTER, PIPE, STOP, SYMBOL, UPPER, class_table, codes
from skeingraph.llm.language_id import held_out
from skeingraph.runtime import columns_of, keep_rows, map_columns

find_words = re.compile(r"[^\x20\x09-\x0D]+").findall
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FEATURES = 15
#: Columns of the features that mark boilerplate lines in any document.
SYMBOLS, AGAIN, LICENCE = 2, 12, 13
#: Average run of lines in spliced sequences; rounds of latent labels; the score from which a line is clearly of a label.
RUN, ROUNDS, CLEAR = 2.0, 2, 2.0


def words_of(text: str) -> list[str]:
    return find_words(text)


def repeated(words: list[str]) -> int:
    """How many words stand in a window of five that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    keys = np.fromiter(map(hash, zip(*(words[i:] for i in range(WINDOW)))), np.int64, n)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    seen: dict[tuple, int] = {}
    marked = np.zeros(len(words), bool)
    for i in at.tolist():  # equal hashes only: compare the words themselves
        w = tuple(words[i : i + WINDOW])
        if w in seen:
            marked[i : i + WINDOW] = True
            marked[seen[w] : seen[w] + WINDOW] = True
        else:
            seen[w] = i
    return int(marked.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = words_of(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += bool(words_of(line))
        else:
            lines.add(line)
    n, again = len(words), repeated(words)
    return n, sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, again, n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line that has a word, and the lines' lengths without line breaks.
    A line of more words says more: its row is multiplied by the root of their number (within bounds)."""
    if not text:
        return np.zeros((0, FEATURES)), np.zeros(0)
    lines = text.split("\n")
    classes = class_table()[codes(text)]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(length[:-1] + 1)])
    at = np.minimum(starts, len(classes) - 1)
    total = [np.add.reduceat((classes & m != 0).astype(np.int32), at) for m in (LETTER, UPPER, DIGIT, SYMBOL, BANG, PIPE, STOP)]
    split = [x.split() for x in lines]
    words = np.array(list(map(len, split)))
    twice = np.array([sum(map(operator.eq, x, x[1:])) for x in split], float)
    keep = np.flatnonzero((words > 0) & (length > 0))
    first: set[str] = set()
    again = np.array([x in first or first.add(x) is not None for x in lines], float)
    letters, upper, digits, symbols, bangs, pipes, stops = (x[keep].astype(float) for x in total)
    size, n = length[keep].astype(float), words[keep].astype(float)
    ends = np.array([lines[i].rstrip()[-1:] in ".?!\"'»”)" for i in keep.tolist()], float)
    licence = np.array([bool(re.search(r"(?i)licen[cs]ed? under|copyright|all rights reserved|cookie|https?://", lines[i])) for i in keep.tolist()], float)
    per = 1 / np.maximum(size, 1)
    rows = np.column_stack([
        np.ones(len(keep)), np.minimum(symbols * per * 10, 3), (symbols / n > 0.5), np.minimum(bangs * per * 10, 3), (bangs / n > 0.5), upper / np.maximum(letters, 1), (pipes / n > 0.2), digits * per,
        np.minimum(stops / n * 4, 2), ends, np.log1p(n) / 4, n < 4, again[keep], licence, twice[keep] / n,
    ]).astype(float)
    return rows * np.clip(np.sqrt(n / 12), 0.7, 3)[:, None], size


def batched(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many sequences (sorted by length, longest first) reach each place, and where each begins
    among all lines, which stand one sequence after the other."""
    return np.array([(lengths > t).sum() for t in range(int(lengths.max(initial=0)))], int), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)


def marginals_of(scores: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the labels of all lines, expected transitions over all sequences, and the log of
    each sequence's partition function; place by place over all sequences that reach it."""
    active, start = batched(lengths)
    a, b = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        before = a[at - 1]
        a[at] = scores[at] + np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
    for t in range(len(active) - 2, -1, -1):
        at = start[: active[t + 1]] + t
        after = scores[at + 1] + b[at + 1]
        b[at] = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
    z = np.logaddexp(*a[start + lengths - 1].T)
    each = np.repeat(z, lengths)
    follows = np.ones(len(scores), bool)
    follows[start] = False
    at = np.flatnonzero(follows)
    pairs = np.exp(a[at - 1][:, :, None] + move + (scores[at] + b[at])[:, None, :] - each[at][:, None, None]).sum(0)
    return np.exp(a + b - each[:, None]), pairs, z


def forward_backward(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The same for one sequence."""
    marginals, pairs, z = marginals_of(scores, move, np.array([len(scores)]))
    return marginals, pairs, float(z[0])


def maximise(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 60, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the content label against boilerplate, and of transitions, for sequences (features,
    labels), by gradient ascent with a step for each weight (Adagrad)."""
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(x) for x, _ in sequences])
    x, y = (np.concatenate(part) for part in zip(*sequences, strict=True))
    first = np.zeros(len(y), bool)
    first[batched(lengths)[1]] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    w, move = np.zeros(FEATURES), np.zeros((2, 2))
    gw, gm = np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(steps):
        marginals, pairs, _ = marginals_of(np.column_stack([np.zeros(len(x)), x @ w]), move, lengths)
        dw, dm = x.T @ (y - marginals[:, 1]) / len(y) - l2 * w, (seen - pairs) / len(y) - l2 * move
        gw, gm = gw + dw**2, gm + dm**2
        w, move = w + rate * dw / np.sqrt(gw), move + rate * dm / np.sqrt(gm)
    return w, move


def latent(scores: np.ndarray, size: np.ndarray, fixed: np.ndarray, label: int) -> np.ndarray:
    """Labels of a document's lines: the document's, except for the fixed ones (boilerplate) and those
    whose score is clearly against it, the surest first, while less than half of the characters leave."""
    y = np.where(fixed, 0, label)
    left = 0.5 * size.sum() - (size[y != label].sum())
    against = -scores if label else scores
    for i in np.argsort(-against, kind="stable"):
        if against[i] < CLEAR or left <= size[i]:
            break
        if y[i] == label:
            y[i], left = 1 - label, left - size[i]
    return y


def spliced(docs: list[tuple[np.ndarray, np.ndarray, int]], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of runs of lines from two documents (features, line labels, document's label) of
    different labels in turn; every line of the larger class comes once, the smaller class repeats."""
    sides = [[d for d in docs if d[2] == label] for label in (0, 1)]
    out = []
    for k in range(max(map(len, sides))):
        pair = [side[k % len(side)] for side in sides]
        at, turn, x, y = [0, 0], int(rng.integers(2)), [], []
        while at[0] < len(pair[0][1]) or at[1] < len(pair[1][1]):
            n = int(rng.geometric(1 / RUN))
            x.append(pair[turn][0][at[turn] : at[turn] + n])
            y.append(pair[turn][1][at[turn] : at[turn] + n])
            at[turn] += n
            turn = 1 - turn
        out.append((np.concatenate(x), np.concatenate(y)))
    return out


def fit_weights(sample: list[tuple[str, int]]) -> dict | None:
    """Weights from texts with their documents' labels. None if a class is missing."""
    rows = [(*line_features(t), q) for t, q in sample]
    rows = [r for r in rows if len(r[0])]
    if len({q for *_, q in rows}) < 2:
        return None
    fixed = [(x[:, [AGAIN, LICENCE, SYMBOLS]] > 0).any(axis=1) for x, _, _ in rows]
    w, move = np.zeros(FEATURES), np.zeros((2, 2))
    for _ in range(1 + ROUNDS):
        docs = [(x, latent(x @ w, size, f, q), q) for (x, size, q), f in zip(rows, fixed, strict=True)]
        w, move = maximise(spliced(docs, np.random.default_rng(3)))
    return {"w": w, "move": move}


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best labels; 0 boilerplate, 1 content."""
    (m00, m01), (m10, m11) = move.tolist()
    back, v0, v1 = [], 0.0, 0.0
    for i, (s0, s1) in enumerate(scores.tolist()):
        if i:
            a, b, c, d = v0 + m00, v1 + m10, v0 + m01, v1 + m11
            back.append((b > a, d >= c))
            v0, v1 = max(a, b), max(c, d)
        v0, v1 = v0 + s0, v1 + s1
    labels = [int(v1 >= v0)]
    for p in reversed(back):
        labels.append(int(p[labels[-1]]))
    return labels[::-1]


def content_share(text: str, model: dict | None) -> float:
    """The share of characters in lines marked as content; 1 if no line has a word."""
    x, size = line_features(text)
    if not len(x) or model is None:
        return 1.0
    scores = np.column_stack([np.zeros(len(x)), x @ model["w"]])
    scores[0, 1] += model.get("prior", 0.0)
    labels = viterbi(scores, model["move"])
    return float(size @ np.array(labels, float) / size.sum())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 300, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """Weights from about per_class labelled documents of each class of at most max_chars characters.
    Labels that repeat are taken once; the rows that are gathered have the bound however often ids repeat."""
    known = columns_of(labels, id_col, label_col).toDF("id", "q").where(F.col("q").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("q").cast("int").alias("q"))
    n = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    share = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, per_class / v)))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / F.lit(float(1 << 24)) < share[F.col("q")])
    texts = columns_of(docs, id_col, text_col).toDF("id", "text").where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "q").agg(F.min("text").alias("text")).collect()  # bounded by per_class and max_chars
    model = fit_weights([(r["text"], r["q"]) for r in sorted(rows, key=lambda r: (r["id"], r["text"]))])
    # The sample has as many of either class; a sequence begins with the odds that the labels have.
    return model and model | {"prior": float(np.clip(np.log(n[1] / n[0]), -3, 3))}


SCHEMA = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("content_share", T.DoubleType()))


def verdicts(docs: DataFrame, model: dict | None, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the base counts, base_failed, kept, content_share) for every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*x) for x in SCHEMA)])

    def start():
        def one(text):
            counts = base_counts(text or "")
            share = content_share(text or "", model)
            return *counts, not counts[-1] and share >= min_share, share

        return lambda keys, texts: (keys, *(map(list, zip(*map(one, texts), strict=True)) if keys else ([] for _ in SCHEMA)))

    return map_columns(columns_of(docs, id_col, text_col), schema, start)


def keep_good(docs: DataFrame, model: dict | None, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that pass the base rules and have enough content."""

    def start():
        ok = lambda t: not base_counts(t or "")[-1] and content_share(t or "", model) >= min_share
        return lambda texts: list(map(ok, texts))

    return keep_rows(docs, [text_col], start)
