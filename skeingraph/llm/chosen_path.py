"""N-gram Jaccard self-join by chosen paths (Christiani, Pagh and Sivertsen's recursive join).

Every document is the set of its word shingles. A MinHash signature stands for a sample of the
set's tokens; a node of the search tree draws a few of the signature's places and splits its sets
by the tokens there, so two sets stay together with a probability that their similarity gives.
Runs start from different places. The number of runs, of a node's draws and of places follow from
the threshold, so that a pair at the threshold is found with the target recall even if its buckets
split as often as `DEPTH` allows (`missed`: nodes draw from the same places, which is counted in). Sets that are alone
leave at once; buckets up to `LIMIT` sets are compared by brute force; larger ones split again,
unless a child is hardly smaller than its parent: those sets are alike. Brute force goes in pairs of
blocks of bounded size, spread over tasks, and in two steps: sets without a partner whose signature
agrees in enough places leave (a pair at the threshold fails this in a tenth of the target's misses
at most), the others are compared on their whole shingle sets. All similarities are exact.

Large alike buckets hold families that share a template. Splitting on shared tokens ends there,
because most shared tokens are the template's; so it goes on with the others (`families`). A shingle
of more than `LIMIT` of these sets is common, the rest are rare. With c common ones among n, two
sets without a common rare shingle can only link if the sum of (1 + t) c - 2 t n is not negative.
Sets below 0 ("low") are therefore never compared with each other in a large bucket: those that
share a rare shingle meet in its list, a bucket of `LIMIT` sets at most (equal lists are one), and
nothing is lost. A family under the threshold costs in proportion to its size; what stays quadratic
are sets of which 2 t / (1 + t) or more is template, and those link to one another.

Copies (equal shingle sets) are joined as one set. Links are never written out pair by pair: each
set carries the ids of its leaves, so that a pair counts only in the first leaf that it shares, and
tasks return counts and a spanning edge for each set.

Defined results: a text without words (null and empty too) links with nothing and is a class of its
own; one of fewer than five words has one shingle; repeated rows are copies; null ids are kept and
are a value like any other; empty tables give empty tables; only the named columns are read, and
`keep_one` hands on all columns: repeated rows count as one, but texts without words all stay.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby, product
from operator import itemgetter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.components import components
from skeingraph.llm.shingles import permutations, shingle_hashes, words_of
from skeingraph.runtime import columns_of, give_back, map_columns, ship, stored

THRESHOLD = 0.8
RECALL = 0.99999
LIMIT = 1024
#: A block has about so many sets, or shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
DEPTH = 6
SALTS = 32
BATCH_BYTES = 8 << 20
#: Ids up to this number are broadcast (some 10 MB); more are joined by shuffle.
BROADCAST_ROWS = 200_000
SEED = 5


class Plan(NamedTuple):
    """Places that the roots take, one each; further places for splits; a node's draws of these; agreeing places that the screen asks for."""

    roots: int
    spare: int
    fanout: int
    agree: int

    @property
    def places(self) -> int:
        return self.roots + self.spare

    @property
    def alike(self) -> float:
        """A child with more than this share of its parent's sets ends the recursion: all children
        together would have as many pairs as the parent."""
        return self.fanout**-0.5


def binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def missed(threshold: float, roots: int, spare: int, fanout: int, splits: int) -> float:
    """The probability that a pair at the threshold shares no bucket after so many splits. All its
    nodes draw from the same spare places, so it is summed over how many of these agree."""
    total = 0.0
    for agreeing, share in enumerate(binomial(spare, threshold)):
        lost = 0.0
        for _ in range(splits):
            lost = sum(math.comb(agreeing, k) * math.comb(spare - agreeing, fanout - k) * lost**k for k in range(fanout + 1)) / math.comb(spare, fanout)
        total += share * (1 - threshold * (1 - lost)) ** roots
    return total


@cache
def plan(threshold: float, recall: float = RECALL) -> Plan:
    """The cheapest plan for the recall: few spare places, then few roots, then few draws."""
    most = 1 - recall
    least = max(2, math.ceil(math.log(most) / math.log(1 - threshold))) if threshold < 1 else 2
    for spare, more, fanout in product((24, 32, 48, 64, 96, 128), range(9), range(2, 7)):
        if missed(threshold, least + more, spare, fanout, DEPTH - 1) <= 0.9 * most:
            chances = binomial(least + more + spare, threshold)
            agree = max(a for a in range(len(chances)) if sum(chances[:a]) <= 0.1 * most)
            return Plan(least + more, spare, fanout, agree)
    raise ValueError(f"no plan reaches a recall of {recall} at a threshold of {threshold}")


def sketch(docs: DataFrame, places: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, set_id, n, sig): the text's hash, the shingle set's digest and size, its signature."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("set_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))])
    rows = columns_of(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("th"), "text")

    def start():
        a, b = permutations(places, SEED)

        def one(text):
            h = np.unique(shingle_hashes(words_of(text)))
            if not len(h):
                return None, 0, None
            low = np.full(places, np.iinfo(np.uint64).max, np.uint64)
            for lo in range(0, len(h), 4096):
                low = np.minimum(low, (h[lo : lo + 4096, None] * a + b).min(axis=0))
            return hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest(), len(h), low.view(np.int64).tolist()

        return lambda ids, ths, texts: (ids, ths, *(map(list, zip(*map(one, texts), strict=True)) if ids else ([], [], [])))

    return map_columns(rows, schema, start)


def token(place: Column, node: Column) -> Column:
    """The child that a node has for the token at a place of the signature."""
    return F.xxhash64(node, place, F.element_at("sig", (place + 1).cast("int")))


def sized(members: DataFrame) -> DataFrame:
    """Members of nodes that hold two sets or more, with the node's size."""
    n = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return stored(members.join(n, "node"))


def leaves(sets: DataFrame, by: Plan) -> DataFrame:
    """(set_id, node, size) of the buckets to be compared by brute force."""
    roots = [token(F.lit(p), F.lit(p)) for p in range(by.roots)]
    level = sized(sets.select("set_id", F.explode(F.array(*roots)).alias("node"), F.lit(None).cast("long").alias("parent")))
    out = []
    for depth in range(1, DEPTH + 1):
        done = (F.col("size") <= LIMIT) | (F.lit(depth == DEPTH)) | F.coalesce(F.col("size") > by.alike * F.col("parent"), F.lit(False))
        out.append(level.where(done).select("set_id", "node", "size"))
        large = level.where(~done)
        if large.isEmpty():
            break
        order = F.array_sort(F.array(*(F.struct(F.xxhash64("node", F.lit(p)).alias("by"), F.lit(p).alias("place")) for p in range(by.roots, by.places))))
        drawn = F.transform(F.slice(order, 1, by.fanout), lambda x: token(x["place"], F.col("node")))
        children = large.join(sets.select("set_id", "sig"), "set_id").select("set_id", F.explode(drawn).alias("node"), F.col("size").alias("parent"))
        level = sized(stored(children))
    joined = out[0]
    for x in out[1:]:
        joined = joined.unionAll(x)
    return joined


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left has in common with each of right, by products of 0/1
    matrices over the elements that two sets or more have, some thousands of them at a time."""
    n, sets = len(left), left if left is right else left + right
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = counts > 1
    column = np.cumsum(common) - 1
    use = common[inverse]
    column, owner = column[inverse[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, len(right)), np.float32)
    width = 4096
    for lo in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        total += m[:n] @ (m if left is right else m[n:]).T
    return total


def sides(group: list[dict]) -> tuple[list[dict], list[dict]]:
    """The two blocks of a task, each set once; the same list twice if it is one block."""
    seen: set[str] = set()
    rows = sorted((r for r in group if not (r["set_id"] in seen or seen.add(r["set_id"]))), key=lambda r: r["set_id"])
    if group[0]["left"] == group[0]["right"]:
        return rows, rows
    return [r for r in rows if r["block"] == r["left"]], [r for r in rows if r["block"] == r["right"]]


def screen(group: list[dict], agree: int) -> list[tuple[int, str]]:
    """(node, set_id) of the sets that agree with another one in enough places of the signature."""
    left, right = sides(group)
    if not left or not right or len(left) + len(right) < 3 - (left is not right):
        return []
    x, y = (np.array([r["sig"] for r in side], np.int64) for side in (left, right))
    same = np.zeros((len(x), len(y)), np.uint8)
    for p in range(x.shape[1]):
        same += x[:, p, None] == y[None, :, p]
    near = same >= agree
    if left is right:
        np.fill_diagonal(near, False)
        return [(r["node"], r["set_id"]) for r, hit in zip(left, near.any(axis=1), strict=True) if hit]
    return [(r["node"], r["set_id"]) for side, axis in ((left, 1), (right, 0)) for r, hit in zip(side, near.any(axis=axis), strict=True) if hit]


def compare(group: list[dict], threshold: float) -> list[tuple[str, int, str]]:
    """(set_id, links counted here, a set of its component here) for the sets of one task that link."""
    left, right = sides(group)
    if not left or not right:
        return []
    node = group[0]["node"]
    n, m = (np.array([len(r["shingles"]) for r in side], np.float64) for side in (left, right))
    shingles = [r["shingles"] for r in left]
    common = intersections(shingles, shingles if left is right else [r["shingles"] for r in right]).astype(np.float64)
    near = common >= threshold * (n[:, None] + m[None, :] - common) - 1e-9
    if left is right:
        np.fill_diagonal(near, False)
    if not near.any():
        return []
    below = lambda side, name: [np.array([x for x in r[name] if x < node], np.int64) for r in side]
    shared = lambda name: intersections(x := below(left, name), x if left is right else below(right, name))
    # Buckets where both sets are low don't count as shared: they aren't compared there.
    counted = near & (shared("nodes") - shared("apart") == 0)
    rows = left if left is right else left + right
    links = counted.sum(axis=1) if left is right else np.concatenate([counted.sum(axis=1), counted.sum(axis=0)])
    linked = near.any(axis=1) if left is right else np.concatenate([near.any(axis=1), near.any(axis=0)])
    buddy = list(range(len(rows)))

    def root(i: int) -> int:
        while buddy[i] != i:
            buddy[i] = buddy[buddy[i]]
            i = buddy[i]
        return i

    shift = 0 if left is right else len(left)
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(int(i)), root(int(j) + shift)
        if a != b:
            buddy[max(a, b)] = min(a, b)
    return [(r["set_id"], int(links[i]), rows[root(i)]["set_id"]) for i, r in enumerate(rows) if linked[i]]


def blocks(size: int, shingles: int) -> int:
    """How many blocks so many sets are split into."""
    return max(size > 0, -(-size // BLOCK), -(-shingles // BLOCK_SHINGLES))


def spread(key: str, high: int, low: int, is_low: bool) -> list[tuple[int, int, int]]:
    """(left, right, own block) of the tasks that a set takes part in: blocks of low sets come after
    the others, and meet those only."""
    own = high + int(key[:12], 16) % low if is_low else int(key[:12], 16) % high
    return [(min(own, other), max(own, other), own) for other in range(high if is_low else high + low)]


def by_task(rows: DataFrame, schema: T.StructType, work: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """work() on the rows of each (node, left, right), which come together by a shuffle and a sort;
    a task holds the rows of two blocks at a time."""
    ship(rows.sparkSession)
    keys = ["node", "left", "right"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def packed(out: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

        def read() -> Iterator[dict]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    for r in batch.slice(lo, 256).to_pylist():
                        if "shingles" in r:
                            r["shingles"] = np.frombuffer(r["shingles"], np.uint64)
                        yield r

        out: list[tuple] = []
        for _, group in groupby(read(), key=itemgetter(*keys)):
            out += work(list(group))
            if len(out) > 10_000:
                yield packed(out)
                out = []
        yield packed(out)
        out = []
        give_back()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def few(ids: DataFrame) -> DataFrame:
    """With a hint to broadcast, if a count shows that the (stored) ids are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


TASK = (("node", T.LongType()), ("left", T.LongType()), ("right", T.LongType()), ("block", T.LongType()), ("set_id", T.StringType()))


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of (stored) rows with rep_id and rep_th, besides these rows' other columns."""
    texts = columns_of(docs, id_col, text_col).toDF("id", "text")
    same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_th"))
    return texts.join(few(wanted.select("rep_id", "rep_th")), same, "left_semi").join(wanted, same).drop("id", "rep_id", "rep_th")


def reps(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th"))


def families(large: DataFrame, sets: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Members (set_id, node, low, h, l) of the large buckets that have to be compared there, and of
    the buckets of rare shingles. Counts are aggregated before they are shuffled; a common shingle's
    sets are never gathered, a rare one's list has `LIMIT` sets at most."""
    wanted = stored(reps(sets).join(large.select("set_id").distinct(), "set_id"))
    schema = T.StructType([T.StructField("set_id", T.StringType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def start():
        seen: set[str] = set()  # repeated rows come once from each task

        def run(ids, texts):
            new = [(i, t) for i, t in zip(ids, texts, strict=True) if not (i in seen or seen.add(i))]
            return [i for i, _ in new], [np.unique(shingle_hashes(words_of(t))).view(np.int64).tolist() for _, t in new]

        return run

    whole = stored(map_columns(texts_of(docs, wanted, id_col, text_col).select("set_id", "text"), schema, start, rows=64))
    each = whole.select("set_id", F.explode("shingles").alias("s"))
    common = stored(each.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT).select("s"))
    if common.count() <= BROADCAST_ROWS:
        marked = each.join(F.broadcast(common.withColumn("common", F.lit(1))), "s", "left")
    else:  # a common shingle has many rows: it is dealt to several tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        marked = each.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int")).join(common.select("s", F.lit(1).alias("common"), salts.alias("salt")), ["s", "salt"], "left").drop("salt")
    counts = marked.groupBy("set_id").agg(F.count("common").alias("c"), F.count("*").alias("n"))
    low = stored(counts.select("set_id", ((1 + threshold) * F.col("c") - 2 * threshold * F.col("n") < -1e-6).alias("low")))
    inside = large.select("set_id", "node").join(low, "set_id")
    sizes = inside.groupBy("node").agg(F.count_if(~F.col("low")).alias("h"), F.count_if("low").alias("l")).where("h > 0")
    kept = inside.join(sizes, "node").select("set_id", "node", "low", "h", "l")
    own = marked.where("common IS NULL").join(low.where("low").select("set_id"), "set_id", "left_semi")
    lists = own.groupBy("s").agg(F.sort_array(F.collect_set("set_id")).alias("members")).where(F.size("members") > 1).select("members").distinct()
    rare = lists.select(F.explode("members").alias("set_id"), F.xxhash64(F.lit("rare"), "members").alias("node"), F.lit(False).alias("low"), F.size("members").cast("long").alias("h"), F.lit(0).cast("long").alias("l"))
    return stored(kept.unionAll(rare))


def linked(docs: DataFrame, sets: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(set_id, n_links, buddy) partial results; shingles are made anew for the sets that pass the screen only."""
    by = plan(threshold)
    tree = leaves(sets, by)
    members = tree.where(F.col("size") <= LIMIT).select("set_id", "node", F.lit(False).alias("low"), F.col("size").alias("h"), F.lit(0).cast("long").alias("l"))
    large = tree.where(F.col("size") > LIMIT)
    if not large.isEmpty():
        members = stored(members.unionAll(families(large, sets, docs, threshold, id_col, text_col)))
    first = members.join(sets.select("set_id", "sig"), "set_id").select("node", "h", "l", "low", "set_id", "sig")

    def deal():
        def run(nodes, hs, ls, lows, set_ids, sigs):
            out = [(node, *task, key, sig) for node, h, l, low, key, sig in zip(nodes, hs, ls, lows, set_ids, sigs, strict=True) for task in spread(key, blocks(h, 0), blocks(l, 0), low)]
            return tuple(map(list, zip(*out, strict=True))) if out else ([],) * 6

        return run

    tasks = map_columns(first, T.StructType([*(T.StructField(*x) for x in TASK), T.StructField("sig", T.ArrayType(T.LongType()))]), deal)
    passed = stored(by_task(tasks, T.StructType([T.StructField("node", T.LongType()), T.StructField("set_id", T.StringType())]), lambda group: screen(group, by.agree)).distinct())
    passed = stored(passed.join(members.select("node", "set_id", "low"), ["node", "set_id"]).join(sets.select("set_id", "n"), "set_id"))
    high, low = ~F.col("low"), F.col("low")
    sizes = passed.groupBy("node").agg(F.count_if(high).alias("h"), F.count_if(low).alias("l"), F.coalesce(F.sum(F.when(high, F.col("n"))), F.lit(0)).alias("ht"), F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0)).alias("lt"))
    nodes = passed.drop("n").join(sizes, "node").groupBy("set_id").agg(F.collect_list(F.struct("node", "low", "h", "l", "ht", "lt")).alias("nodes"))
    active = stored(nodes.join(reps(sets), "set_id"))
    texts = texts_of(docs, active, id_col, text_col).select("set_id", "nodes", "text")
    result = T.StructType([T.StructField("set_id", T.StringType()), T.StructField("n_links", T.LongType()), T.StructField("buddy", T.StringType())])
    return by_task(sent(texts), result, lambda group: compare(group, threshold))


def sent(texts: DataFrame) -> DataFrame:
    """A row with the set's shingles for each task it takes part in, in batches of bounded bytes."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*(T.StructField(*x) for x in TASK), T.StructField("nodes", longs), T.StructField("apart", longs), T.StructField("shingles", T.BinaryType())])
    ship(texts.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        size, seen = 0, set()  # repeated rows come once from each task
        for key, nodes, text in (row for b in batches for lo in range(0, b.num_rows, 64) for row in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True)):
            if key in seen:
                continue
            seen.add(key)
            data = np.unique(shingle_hashes(words_of(text))).tobytes()
            ids, apart = sorted(x["node"] for x in nodes), sorted(x["node"] for x in nodes if x["low"])
            for x in nodes:
                for task in spread(key, blocks(x["h"], x["ht"]), blocks(x["l"], x["lt"]), x["low"]):
                    out.append((x["node"], *task, key, ids, apart, data))
                    size += len(data) + 8 * len(ids)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        out, seen, data = [], set(), b""
        give_back()

    return texts.mapInArrow(run, schema)


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketch's rows, and (set_id, rep, copies, n_links, first) of every shingle set: rep is the
    smallest (id, text hash) of the set, first that of all sets linked with it, directly or not."""
    rows = stored(sketch(docs, plan(threshold).places, id_col, text_col))
    sets = stored(rows.where("n > 0").groupBy("set_id").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    links = stored(linked(docs, sets, threshold, id_col, text_col))
    counts = links.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    roots = components(links.select(F.col("set_id").alias("a"), F.col("buddy").alias("b")))
    whole = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    first = whole.join(sets.select(F.col("set_id").alias("node"), "rep"), "node")
    low = first.groupBy("root").agg(F.min("rep").alias("first"))
    first = whole.join(low, "root").select(F.col("node").alias("set_id"), "first")
    out = sets.drop("sig", "n").join(counts, "set_id", "left").join(first, "set_id", "left")
    return rows, out.select("set_id", "rep", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", "rep").alias("first"))


def join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, copy_id, n_copies, class_id, n_links). copy_id is the smallest id
    with the same shingle set, n_copies their number, class_id the smallest id that links reach,
    n_links the number of other shingle sets with a similarity of the threshold or more."""
    rows, sets = classes(docs, threshold, id_col, text_col)
    joined = rows.select("id", "set_id").join(sets, "set_id", "left")
    known = F.col("rep").isNotNull()
    return joined.select(
        F.col("id").alias(id_col), F.when(known, F.col("rep.id")).otherwise(F.col("id")).alias("copy_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        F.when(known, F.col("first.id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the smallest id, with all columns; texts without words stay.
    Repeated rows (the same id and text) count as one."""
    rows, sets = classes(docs, threshold, id_col, text_col)
    joined = rows.where("n > 0").select("id", "th", "set_id").join(sets.select("set_id", "first"), "set_id")
    gone = stored(joined.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))).select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct())
    kept = docs.join(few(gone), docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_th"]), "left_anti")
    again = stored(rows.where("n > 0").groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("th").alias("again_th")))
    if again.isEmpty():
        return kept
    repeated = docs[id_col].eqNullSafe(again["again_id"]) & (F.xxhash64(docs[text_col]) == again["again_th"])
    return kept.join(few(again), repeated, "left_anti").unionAll(kept.join(few(again), repeated, "left_semi").dropDuplicates([id_col, text_col]))
