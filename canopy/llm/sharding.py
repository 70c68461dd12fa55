"""Byte-balanced shards by Karmarkar-Karp differencing over groups of equal texts.

A group (all rows with one text) is indivisible.  Groups are dealt by hash to
buckets of about ``bucket_groups`` groups.  Each bucket is differenced in one
task: partial partitions with the largest spread are combined, the largest
subset of one with the smallest of the other, until one partition is left.
The buckets' partitions are items of the same kind, so the next level combines
them in the same way, until one is left; a bucket's k subsets then each have a
shard.  A task holds ``bucket_groups`` items at any input size.

Defined cases: a null text is a group of its own size 1 with empty texts (size
is UTF-8 bytes plus 1); repeated rows get a slot each; null ids are allowed; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import cut, join_groups, table

SHARDS = 8
BUCKET_GROUPS = 20_000  # items differenced in one task
SLOT_ROWS = 20_000      # rows numbered in one window partition


def difference(items: list[tuple[list[int], list]], k: int) -> tuple[list[int], list[list]]:
    """Combine k-way partial partitions until one is left.

    ``items``: (k sums in falling order, k trees), a tree being a leaf, None
    or a pair of trees.  Returns the last sums and the leaves of each subset.
    """
    heap = [(s[-1] - s[0], i, s, t) for i, (s, t) in enumerate(items)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s1, t1 = heapq.heappop(heap)
        _, _, s2, t2 = heap[0]
        # opposite order: the largest subset of one meets the smallest of the other
        both = sorted(((s1[j] + s2[k - 1 - j], j) for j in range(k)), reverse=True)
        sums = [s for s, _ in both]
        trees = [(t1[j], t2[k - 1 - j]) if t1[j] is not None and t2[k - 1 - j] is not None
                 else t1[j] if t1[j] is not None else t2[k - 1 - j] for _, j in both]
        n += 1
        heapq.heapreplace(heap, (sums[-1] - sums[0], n, sums, trees))
    if not heap:
        return [0] * k, [[] for _ in range(k)]
    leaves = []
    for tree in heap[0][3]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            elif x is not None:
                out.append(x)
        leaves.append(out)
    return heap[0][2], leaves


def _level(items: DataFrame, k: int) -> DataFrame:
    """items (bucket, item, sums) -> (bucket, item, sub, part, total): item's subset ``sub`` is in the bucket's ``part``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # falling sums, ties in a fixed order: a retried task gives the same result
        pdf = pdf.sort_values("item", kind="stable")
        work = []
        for item, sums in zip(pdf["item"].tolist(), pdf["sums"]):
            order = sorted(range(len(sums)), key=lambda j: (-sums[j], j))
            pad = k - len(order)
            work.append(([int(sums[j]) for j in order] + [0] * pad, [[item, j] for j in order] + [None] * pad))
        sums, leaves = difference(work, k)
        rows = [(pdf["bucket"].iloc[0], item, j, part, sums[part]) for part, own in enumerate(leaves) for item, j in own]
        return pd.DataFrame(rows, columns=["bucket", "item", "sub", "part", "total"])

    return items.groupBy("bucket").applyInPandas(one, "bucket long, item long, sub int, part int, total long")


def assign_groups(groups: DataFrame, k: int, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(group_id, size) -> (group_id, shard); ``group_id`` is a long, one row each."""
    groups = cut(groups.select("group_id", "size"))
    n = groups.count()
    buckets = max(1, math.ceil(n / bucket_groups))
    items = groups.select(F.pmod(F.xxhash64("group_id"), F.lit(buckets)).alias("bucket"), F.col("group_id").alias("item"),
                          F.array("size").alias("sums"))
    levels = [cut(_level(items, k))]
    while buckets > 1:
        last = levels[-1]
        totals = (last.groupBy("bucket", "part").agg(F.max("total").alias("total"))
                  .groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("part", "total"))).alias("m"))
                  .select(F.col("bucket").alias("item"), F.transform(
                      F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("sums")))
        buckets = math.ceil(buckets / bucket_groups)
        levels.append(cut(_level(totals.select((F.col("item") % buckets).alias("bucket"), "item", "sums"), k)))
    out = levels[0].select(F.col("item").alias("group_id"), "bucket", "part")
    for up in levels[1:]:
        # one row per bucket and subset: adaptive execution broadcasts it where its measured size allows
        up = up.select(F.col("item").alias("bucket"), F.col("sub").alias("part"), F.col("bucket").alias("up"), F.col("part").alias("to"))
        out = out.join(up, ["bucket", "part"]).select("group_id", F.col("up").alias("bucket"), F.col("to").alias("part"))
    return out.select("group_id", F.col("part").alias("shard"))


def number_slots(df: DataFrame, shard: str, order: list[str], rows: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, without a task that holds a whole shard."""
    pieces = max(1, math.ceil(rows / slot_rows))
    df = df.withColumn("_piece", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(pieces)))
    sizes = df.groupBy(shard, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy(shard, "_piece").orderBy(*order)
    return (df.withColumn("_r", F.row_number().over(within)).join(sizes.drop("_n"), [shard, "_piece"])
            .withColumn("slot", F.col("_start") + F.col("_r") - 1).drop("_piece", "_start", "_r"))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    bucket_groups: int = BUCKET_GROUPS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(t, 256)
    # 60 bits of the digest name a group; two texts that share them would only be kept together
    rows = cut(df.select(F.col(id_col).alias("_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                         F.crc32(t.cast("binary")).alias("text_crc32"),
                         F.conv(F.substring(sha, 1, 15), 16, 10).cast("long").alias("group_id"),
                         F.monotonically_increasing_id().alias("_row")))
    groups = rows.groupBy("group_id").agg(F.sum("size").alias("size"))
    placed = join_groups(rows, assign_groups(groups, shards, bucket_groups), "group_id")
    out = number_slots(placed, "shard", ["_id", "_row"], rows.count(), slot_rows)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op8_sharding(spark, sf_dir):
    """All documents in eight shards of near equal bytes."""
    s = shard_documents(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))
