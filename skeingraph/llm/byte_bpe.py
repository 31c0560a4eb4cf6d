"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merge loop keeps, for each merge rank, a bucket of positions in a doubly linked list of
parts. Two levels of bitmaps say which buckets hold anything: a word of 256 ranks, and a word of
words. Find-first-set on both gives the lowest rank in constant time, however long the pre-token
is; a pair is queued once it goes before both neighbours, and entries whose pair has changed since
they were queued are skipped when they surface. Work per
pre-token of n bytes is O(n log n), where a scan for the best pair would take O(n^2).

Defined results: null text encodes as empty (no ids, digest of nothing); rows are independent, so
repeated rows and ids give repeated results; an empty table gives an empty table; only the id and
text columns are read, so further columns of any name do no harm. Decoding leaves null ids out and
writes U+FFFD for an id that the vocabulary doesn't have.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeingraph.runtime import columns_of, map_columns

#: Pre-tokens of each of two ages that a Python worker keeps with their ids.
CACHE = 150_000
#: Characters after which a long text is cut, so that its pre-tokens needn't be held all at once.
SLICE = 1_000_000
# Fixed value: the pattern for which no match goes on over a single space between other characters.
CHUNK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = 8  # bits of a rank that one bitmap word covers


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`; read by the driver, a fixed size of about 1 MB."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


BIT = [1 << i for i in range(1 << 12)]  # enough for a million ranks
NONE = -1  # the order of a pair that isn't in the vocabulary


class Queue:
    """What `merge` needs of a vocabulary. An order is the last rank less the rank, so that the pair
    to merge next has the highest one and find-first-set is the length of a bitmap."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        last = max(ranks.values(), default=0)
        self.order = {piece: last - r for piece, r in ranks.items()}
        self.pairs = [[self.order.get(bytes((a, b)), NONE) for b in range(256)] for a in range(256)]
        self.words = [0] * ((last >> WORD) + 1)  # a bit for each bucket in use; all 0 between merges


def merge(piece: bytes, queue: Queue) -> tuple[int, ...]:
    """Ids of one pre-token. The queue is top (a bit for each word in use), words and buckets (heaps
    of positions, as the leftmost of a rank merges first). Only a pair that goes before both
    neighbours is queued, as any other has to wait for them; a merge changes two pairs, so that of
    four pairs it may let two into the queue."""
    whole = queue.ranks.get(piece)
    if whole is not None:
        return (whole,)
    order_of, words = queue.order.get, queue.words
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    # the order of the pair that begins here now; none at the last part, nor at n, which -1 finds too
    live = [queue.pairs[a][b] for a, b in zip(piece, piece[1:])]
    live += (NONE, NONE)
    top, buckets, last = 0, {}, NONE
    for i in range(n - 1):
        s = live[i]
        if s > last and s >= live[i + 1]:
            if s in buckets:
                buckets[s].append(i)
            else:
                buckets[s] = [i]
                words[s >> WORD] |= BIT[s & 255]
                top |= BIT[s >> WORD]
        last = s
    while top:
        word = top.bit_length() - 1
        bits = words[word]
        bit = bits.bit_length() - 1
        s = (word << WORD) + bit
        bucket = buckets[s]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[s]
            words[word] = bits = bits ^ BIT[bit]
            if not bits:
                top ^= BIT[word]
        if live[i] != s:  # stale
            continue
        gone, left = after[i], before[i]
        end = after[i] = after[gone]
        was, live[gone] = live[gone], NONE
        first = second = NONE  # positions to queue
        own = order_of(piece[i : after[end]], NONE) if end < n else NONE
        live[i] = own
        new = NONE
        if left >= 0:
            old, further = live[left], before[left]
            new = live[left] = order_of(piece[left:end], NONE)
            s = live[further]
            if new > s:
                if new >= own:
                    first = left
            elif old > s > live[before[further]] and further >= 0:
                first = further
        if end < n:
            before[end] = i
            s = live[end]
            if own >= s:
                if own > new:
                    second = i
            elif was >= s >= live[after[end]]:
                second = end
        for i in (first, second):
            if i >= 0:
                s = live[i]
                if s in buckets:
                    heappush(buckets[s], i)
                else:
                    buckets[s] = [i]
                    words[s >> WORD] |= BIT[s & 255]
                    top |= BIT[s >> WORD]
    out, i = [], 0
    while i < n:
        out.append(queue.ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class Pretokens(dict):
    """From a pre-token to its ids. When full, its entries become the elder ones, of which those come back that are met again."""

    def __init__(self, queue: Queue) -> None:
        super().__init__()
        self.queue, self.elder = queue, {}

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.elder.get(match)
        if ids is None:
            ids = merge(match.encode("utf-8"), self.queue)
        if len(match) < 64:
            if len(self) >= CACHE:
                self.elder = dict(self)
                self.clear()
            self[match] = ids
        return ids


class Encoder:
    """Encodes and decodes texts; keeps the ids of frequent pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.pieces = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in ranks.values()}
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile(r"\S(?= \S)").search if pattern == CHUNK_PATTERN else None
        self.pretokens = Pretokens(Queue(ranks))

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a long text that no match of CHUNK_PATTERN crosses; other patterns: the text."""
        lo = 0
        while self.cut and len(text) - lo > SLICE and (found := self.cut(text, lo + SLICE)):
            yield text[lo : found.end()]
            lo = found.end()
        yield text[lo:]

    def ids(self, text: str) -> list[int]:
        matches = chain.from_iterable(map(self.split, self.slices(text)))
        return list(chain.from_iterable(map(self.pretokens.__getitem__, matches)))

    def decode(self, ids: list[int]) -> bytes:
        return joined(self.pieces, ids)


def joined(pieces: dict[int, bytes], ids: list[int | None] | None) -> bytes:
    """The bytes of the ids; nothing for nulls, U+FFFD for ids that aren't known."""
    try:
        return b"".join(map(pieces.__getitem__, ids or ()))
    except KeyError:
        return b"".join(pieces.get(i, b"\xef\xbf\xbd") for i in ids or () if i is not None)


_encoders: dict[tuple[int, int, str], Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for each vocabulary in a worker, kept from task to task."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text; null text: no ids."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def start():
        e = encoder(held.value, pattern)
        return lambda keys, texts: (keys, [e.ids(t or "") for t in texts])

    return map_columns(columns_of(docs, id_col, text_col), schema, start)


def decode(tokens: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, content): the bytes that the ids stand for; null ids: empty."""
    held = tokens.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("content", T.BinaryType())])

    def start():
        pieces = {v: k for k, v in held.value.items()}
        return lambda keys, ids: (keys, [joined(pieces, x) for x in ids])

    return map_columns(columns_of(tokens, id_col, ids_col), schema, start)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def start():
        e = encoder(held.value, pattern)

        def run(keys, texts):
            out = []
            for t in texts:
                ids = e.ids(t or "")
                out.append((len(ids), hashlib.sha256(",".join(map(e.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()))
            return keys, *(map(list, zip(*out, strict=True)) if out else ([], [], []))

        return run

    return map_columns(columns_of(docs, id_col, text_col), schema, start)
