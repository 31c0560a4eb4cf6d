"""Chat formatting from reply trees.

Messages (conversation, message, parent, role, text, score) form trees. Iterative self-joins with
doubling steps find for every message its ancestors at distance 1, 2, 4, ...: a message's branch
score (the sum along its path) and depth come from joining each message with the one that its
current pointer names, and the pointers' lengths double each round, so the rounds are the logarithm
of the longest path. Leaves are ranked by mean score along the branch, and the messages of the
chosen branches are found by running the stored pointers backwards, longest first. Only ids, depths
and scores take part; texts join once, at the end.

The template writes a turn as `<|turn:ROLE|>` TEXT `<|end|>` and a line break. In texts `&` becomes
`&amp;`, `<` becomes `&lt;`, and the bracket of `[INST]` or `[/INST]` becomes `&#91;`; in roles also
`|`, `>` and line breaks. parse() reads turns and loss spans back from the formatted text alone.

Defined results: null text or role is empty; a null conversation id is one conversation; a message
whose parent is missing is a root; of repeated messages with one id (operator `branches`) the first
by role and text counts, while `linear` takes every row as a turn, ordered by turn, role and text;
ties in rank go to the smaller leaf; messages in a cycle have no root and are left out; an empty
table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.runtime import columns_of, map_columns, stored

LOSS_ROLE = "assistant"
TURN = re.compile(r"<\|turn:([^|<>]*)\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"\[(?=/?INST\])", "&#91;", text.replace("&", "&amp;").replace("<", "&lt;"))


def unescape(text: str) -> str:
    return text.replace("&#91;", "[").replace("&lt;", "<").replace("&#124;", "|").replace("&gt;", ">").replace("&#10;", "\n").replace("&amp;", "&")


def escape_role(role: str) -> str:
    return escape(role).replace("|", "&#124;").replace(">", "&gt;").replace("\n", "&#10;")


def write(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|turn:{escape_role(role)}|>{escape(text)}<|end|>\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in the output."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in TURN.finditer(formatted)]


def loss_spans(formatted: str, role: str = LOSS_ROLE) -> list[tuple[int, int]]:
    return [(a, b) for r, _, a, b in parse(formatted) if r == role]


def key_of(column: Column) -> Column:
    """Nulls as a value of their own, so that joins keep them."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes (k, id, parent, score) -> (k, id, depth, total) of all that reach a root, and for each
    round the pointers (k, id, up) that it made; up is 2^round steps above id."""
    level = nodes.select("k", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    done, hops, rounds = [level.where("up IS NULL").drop("up")], [], 0
    level = stored(level.where("up IS NOT NULL"))
    finished = stored(done[0])
    enough = finished.count().bit_length() + level.count().bit_length() + 1  # what is left after so many doublings runs in a cycle
    while not level.isEmpty() and rounds < enough:
        hops.append(level.select("k", "id", "up"))
        above = level.select("k", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        ends = finished.select("k", F.col("id").alias("up"), F.lit(None).cast(level.schema["up"].dataType).alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        joined = stored(level.join(above.unionAll(ends), ["k", "up"]).select("k", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total")))
        finished = finished.unionAll(joined.where("up IS NULL").drop("up"))
        level = joined.where("up IS NOT NULL")
        rounds += 1
    return finished, hops


def branches(messages: DataFrame, best: int | None = None, conv: str = "conv_id", msg: str = "msg_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """(conv, rank, msg, depth): the messages of each conversation's branches by rank, the best only
    if a number is given; rank 1 has the highest mean score from root to leaf."""
    m = columns_of(messages, conv, msg, parent, score).toDF("conv", "id", "parent", "score")
    nodes = m.select(key_of(F.col("conv")).alias("k"), "conv", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("id IS NOT NULL")
    nodes = nodes.groupBy("k", "id").agg(F.min("conv").alias("conv"), F.min_by("parent", F.coalesce(F.col("parent").cast("string"), F.lit(""))).alias("parent"), F.max("score").alias("score"))
    known = nodes.select(F.col("k").alias("known_k"), F.col("id").alias("p"))
    nodes = stored(nodes.join(known, F.expr("k = known_k AND parent = p"), "left").select("k", "conv", "id", F.col("p").alias("parent"), "score"))
    totals, hops = ancestors(nodes)
    leaves = totals.join(nodes.select("k", F.col("parent").alias("id")).where("id IS NOT NULL").distinct(), ["k", "id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.col("total") / F.col("depth")), "id")))
    on = stored((ranked.where(F.col("rank") <= best) if best else ranked).select("k", "rank", "id", "depth"))
    for step in range(len(hops) - 1, -1, -1):
        up = on.join(hops[step], ["k", "id"]).select("k", "rank", F.col("up").alias("id"), (F.col("depth") - 2**step).alias("depth"))
        on = stored(on.unionAll(up))
    return on.join(nodes.select("k", "id", "conv"), ["k", "id"]).select(F.col("conv").alias(conv), "rank", F.col("id").alias(msg), "depth")


def formatted(paths: DataFrame, texts: DataFrame, conv: str = "conv_id", msg: str = "msg_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, rank, formatted, loss) of each branch: the template's text and its loss spans."""
    p = paths.select(key_of(F.col(conv)).alias("k"), F.col(conv).alias("conv"), "rank", F.col(msg).alias("id"), "depth")
    t = columns_of(texts, conv, msg, role, text).toDF("conv", "id", "role", "text").select(key_of(F.col("conv")).alias("k"), "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.groupBy("k", "id").agg(F.min(F.struct("role", "text")).alias("m"))
    turns = p.join(t, ["k", "id"]).groupBy("k", "rank").agg(F.min("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("depth", "m.role", "m.text"))).alias("turns"))
    schema = T.StructType([T.StructField(conv, paths.schema[conv].dataType), T.StructField("rank", T.IntegerType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(convs, ranks, all_turns):
        out = [write([(x["role"], x["text"]) for x in turns]) for turns in all_turns]
        return convs, ranks, out, [[list(s) for s in loss_spans(x)] for x in out]

    return map_columns(turns.select("conv", "rank", "turns"), schema, lambda: run)


def linear(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations of plain turns as reply trees: (conv, msg_id, parent_id, score, role, text),
    each message the reply to the one before it."""
    r = columns_of(rows, conv, turn, role, text).toDF("conv_id", "turn", "role", "text")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    r = r.select("conv_id", number.alias("msg_id"), "role", "text")
    return r.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted texts."""
    schema = T.StructType([T.StructField(conv, chats.schema[conv].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def one(chat: str, spans: list) -> tuple:
        turns = parse(chat)
        loss = "".join(unescape(chat[a:b]) for a, b in spans)
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(chat)

    def run(convs, chats, spans):
        return convs, *(map(list, zip(*map(one, chats, spans), strict=True)) if convs else ([] for _ in range(5)))

    return map_columns(chats.select(conv, "formatted", "loss"), schema, lambda: run)
