"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` points on a ring of 2^64 places. A row's place is the hash of its text, so
equal texts lie together; it belongs to the shard of the next point clockwise, and where that shard
is full it goes on clockwise to the next shard with room. Capacities sum to the number of rows
(n div shards, one more for the first n mod shards), so counts differ by one at most: the law `rows`.

At scale only row counts of the ring's cells are gathered (2^GRID numbers and one for each
partition): stretches of rows in ring order are assigned to shards on the driver, cell by cell, and
overflow passes on as numbers. Rows get their rank in ring order from a range repartitioning by place and a
hash of the id (which splits any hot text over partitions), written to the shared folder, so that
the ranks are fixed before they are used; what is moved is a few numbers of each row, never texts.

Defined results: null text counts as no bytes and as the empty text's crc32 (0); null ids are values
like others; repeated rows are rows; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.runtime import columns_of, stored

VNODES = 64
GRID = 14  # bits of the place that choose the cell; points are rounded to cells
ROW_BITS = 33  # monotonically_increasing_id has the partition above these bits


def ring(shards: int, vnodes: int = VNODES) -> list[int]:
    """The owner of each cell of the ring: that of the first point in or after it, clockwise."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") >> (64 - GRID), s) for s in range(shards) for v in range(vnodes))
    cells = [c for c, _ in points]
    return [points[bisect.bisect_left(cells, cell) % len(points)][1] for cell in range(1 << GRID)]


def plan(counts: dict[int, int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, slot of from) for stretches of ranks within each cell. Cells are taken
    in ring order; what finds its owner full goes on clockwise, past the owners of later cells."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []

    def place(cell: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard])
        if take:
            out.append((cell, lo, lo + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return lo + take

    for cell in sorted(counts):
        lo = place(cell, 0, counts[cell], owner[cell])
        if lo < counts[cell]:
            waiting.append((cell, lo, counts[cell]))
    for cell, lo, hi in waiting:
        at = cell
        while lo < hi:
            full = owner[at]
            while room[owner[at]] == 0 or owner[at] == full:
                at = (at + 1) % len(owner)
            lo = place(cell, lo, hi, owner[at])
    return out


def shard(rows: DataFrame, shards: int = 16, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = rows.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = F.xxhash64(F.coalesce("text", F.lit("")))
    r = columns_of(rows, id_col, text_col).toDF("id", "text").select(
        "id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(place, 64 - GRID).cast("int").alias("cell"), place.alias("place"), F.xxhash64("id", F.lit(1)).alias("tie"),
    )
    keys = ["cell", "place", "tie", "id", "size", "text_crc32"]
    dealt = stored(r.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("place", "tie"))
    part = F.shiftright("at", ROW_BITS)
    counted = dealt.groupBy(part.alias("part"), "cell").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # at most partitions + cells
    counts: dict[int, int] = {}
    offsets = []
    for x in sorted(counted, key=lambda x: (x["cell"], x["part"])):
        offsets.append((x["part"], x["cell"], counts.get(x["cell"], 0) - x["first"]))
        counts[x["cell"]] = counts.get(x["cell"], 0) + x["n"]
    stretches = plan(counts, ring(shards, vnodes), shards)
    starts = spark.createDataFrame(offsets, "part int, cell int, offset long")
    moves = spark.createDataFrame(stretches, "cell int, lo long, hi long, shard int, slot long")
    ranked = dealt.withColumn("part", part.cast("int")).join(F.broadcast(starts), ["part", "cell"]).withColumn("rank", F.col("at") + F.col("offset"))
    placed = ranked.join(F.broadcast(moves), (ranked["cell"] == moves["cell"]) & (ranked["rank"] >= moves["lo"]) & (ranked["rank"] < moves["hi"]))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
